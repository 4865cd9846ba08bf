"""Orders and files that must not depend on the bounds that Spark samples."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lapreplay import queries
from lapreplay.operators import corpus
from lapreplay.sources import io

FOLDER = "/root/testdata/sf0.001"


def test_sorted_rows_are_numbered_from_one_run(spark):
    """Two runs of a sort may sample different bounds: the rows are sorted once, and stored, before they are counted and numbered."""
    df = spark.range(0, 20_000, 1, 6).withColumns({"x": F.xxhash64("id"), "more": F.concat(F.lit("text "), F.col("id"))})
    got = queries._numbered(df.orderBy("x"))
    assert "rangepartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert [r.place for r in sorted(got.select("x", "more", "place").collect())] == list(range(1, 20_001))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_laps_have_many_files(spark, monkeypatch, tmp_path):
    """No single task sorts all laps."""
    monkeypatch.setattr(queries, "folder", lambda s, name: f"file://{tmp_path}/{name}")
    queries.sample_stored_rows(spark, FOLDER)
    assert len(list((tmp_path / "laps").glob("part-*.parquet"))) == 4


def test_expanded_and_sorted_rows_keep_all_partitions(spark):
    """Tasks aren't merged by what they shuffle where that is much less than what they sort."""
    d = queries.the_dataset(spark, FOLDER)
    assert "REPARTITION_BY_NUM" in _plan(d) and "REPARTITION_BY_COL" not in _plan(d)
    assert "REPARTITION_BY_COL" not in _plan(corpus.sorted_for_storage(d))


def test_ranges_depend_on_rows_alone(spark):
    """However its rows are dealt, a race has the same ranges, in order."""
    d = queries.the_dataset(spark, FOLDER).localCheckpoint()
    many = d.withColumn("SnapshotLap", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(12).cast("long")))).withColumn("RoundNumber", (F.col("RoundNumber") % 3).cast("int"))

    def ranges(rows):
        at = corpus.in_ranges(rows, corpus.storage_bounds(rows, 1000), rows.count(), 1000).withColumn("p", F.spark_partition_id())
        key = F.struct("Season", "RoundNumber", corpus.storage_key())
        return [tuple(r) for r in at.groupBy("p").agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"), F.sum(F.xxhash64("RaceId", "Driver", "SnapshotLap").cast("decimal(38,0)")).alias("h")).orderBy("p").collect()]

    one = ranges(many.localCheckpoint())
    assert one == ranges(many.repartition(7).localCheckpoint())
    assert sum(r[1] for r in one) == 12 * 1963 and len(one) > 12 and max(r[1] for r in one) < 4000
    rank = lambda x: (x[0], x[1], x[2][0], x[2][1], x[2][2] or 0, x[2][3])
    assert all(rank(a[3]) <= rank(b[2]) for a, b in zip(one, one[1:]))


def test_stored_columns_have_one_encoding(spark, tmp_path):
    """Several are listed in an order that differs from executor to executor, so files of equal rows would differ by who wrote them."""
    path = f"file://{tmp_path}/d"
    io.write_race_dataset(queries.the_dataset(spark, FOLDER), path, check=False)
    files = [pq.read_metadata(f) for f in (tmp_path / "d").rglob("*.parquet")]
    columns = [m.row_group(g).column(c) for m in files for g in range(m.num_row_groups) for c in range(m.num_columns)]
    assert len(files) == 30 and {len(c.encodings) for c in columns} == {1}
