"""What a plan costs: jobs, shuffles, files read; and what survives a writer that dies."""

import os
import uuid

import pytest
from helpers import laps_of, race_rows, results_of, sessions_of
from pyspark.sql import functions as F
from test_replay import the_dataset

from lapreplay import fixtures
from lapreplay.operators import corpus, dataset, replay, rules, validate
from lapreplay.schemas import DatasetError, RaceDataError, ReplayError, TargetError
from lapreplay.sources import io

FOLDER = "/root/testdata/sf0.001"


def jobs_of(spark, work):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_checked_datasets_run_once(spark, tmp_path):
    tables = {}
    for f in (fixtures.laps, fixtures.results, fixtures.sessions):
        f(spark, FOLDER).write.parquet(f"file://{tmp_path}/{f.__name__}")
        tables[f.__name__] = spark.read.parquet(f"file://{tmp_path}/{f.__name__}")
    d, jobs = jobs_of(spark, lambda: dataset.build_race_dataset(**tables))
    assert d.count() == 1963 and jobs <= 5
    r, jobs = jobs_of(spark, lambda: replay.build_race_replay(tables["laps"]))
    assert r.count() == 1963 and jobs <= 5


def test_replays_shuffle_twice(spark):
    plan = replay.build_race_replay(laps_of(spark), check=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3 and "Join" not in plan
    plan = dataset.build_race_dataset(laps_of(spark), results_of(spark), sessions_of(spark), check=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3 and "Join" not in plan


def test_checks_sort_no_rows(spark):
    plan = dataset.check_dataset(the_dataset(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort " not in plan.replace("SortAggregate", "")


@pytest.mark.parametrize(
    "change, error, code",
    [
        (lambda laps, results, sessions: (laps, results.withColumn("Position", F.lit(1)), sessions), DatasetError, "winner_count"),
        (lambda laps, results, sessions: (laps, results.filter("Abbreviation <> 'BOT'"), sessions), TargetError, "missing_target"),
        (lambda laps, results, sessions: (laps, results.unionByName(results.filter("Position = 2")), sessions), TargetError, "duplicate_driver"),
        (lambda laps, results, sessions: (laps, results.withColumn("Position", F.when(F.col("Position") > 1, F.col("Position"))), sessions), TargetError, "missing_position"),
        (lambda laps, results, sessions: (laps, results.limit(0), sessions), TargetError, "result table is empty"),
        (lambda laps, results, sessions: (laps.filter("not (Driver = 'VER')").withColumn("Position", F.when(F.col("Driver") == "NOR", 1).otherwise(3)), results, sessions), DatasetError, "never finished"),
        (lambda laps, results, sessions: (laps.filter("not (Driver = 'VER' and LapNumber = 1)").withColumn("Position", F.when(F.col("Driver") == "NOR", 1).otherwise(3)), results, sessions), TargetError, "snapshot_winner_count"),
        (lambda laps, results, sessions: (laps, results, sessions.limit(0)), DatasetError, "no session"),
        (lambda laps, results, sessions: (laps, results, sessions.unionByName(sessions.withColumn("EventName", F.lit("x")))), DatasetError, "duplicate_session"),
        (lambda laps, results, sessions: (laps, results, sessions.withColumn("EventName", F.lit("\t"))), DatasetError, "blank_EventName"),
        (lambda laps, results, sessions: (laps.filter("Position > 1"), results, sessions), ReplayError, "no leader"),
        (lambda laps, results, sessions: (laps.unionByName(laps.limit(1)), results, sessions), RaceDataError, "duplicate_driver_lap|leader_count"),
    ],
)
def test_broken_tables(spark, change, error, code):
    with pytest.raises(error, match=code):
        dataset.build_race_dataset(*change(laps_of(spark), results_of(spark), sessions_of(spark)))


def test_broken_drafts_are_dropped(spark):
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(shared))
    with pytest.raises(ReplayError):
        replay.build_race_replay(laps_of(spark).withColumn("Position", F.lit(1)))
    assert set(os.listdir(shared)) == before


def files_read(df):
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        n = todo.pop()
        kind = n.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(n.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(n.plan())
        else:
            todo += [n.children().apply(i) for i in range(n.children().size())]
            if n.metrics().contains("numFiles"):
                found.append((n.toString(), n.metrics().apply("numFiles").value()))
    return found


def test_a_scan_of_one_race_reads_its_files(spark, tmp_path):
    root, sessions = f"file://{tmp_path}/landed", fixtures.sessions(spark, FOLDER)
    io.land_tables({"laps": fixtures.laps(spark, FOLDER)}, sessions, root)
    chosen = io.session_selection(spark.createDataFrame(sessions.collect()), 2024, 3, seasons=(2023, 2024))
    laps = io.scan_session(spark, root, chosen, ["laps"])["laps"]
    races = {(r.RaceId) for r in laps.collect()}
    assert len(races) == 1 and len(list((tmp_path / "landed" / "laps").glob("*/*"))) == 30
    mine = len(list((tmp_path / "landed" / "laps" / "_season=2024" / "_round=3").glob("*.parquet")))
    assert [n for _, n in files_read(laps)] == [mine]
    assert laps.columns == fixtures.laps(spark, FOLDER).columns


class Killed(BaseException):
    """The writer's process is gone."""


class Dies:
    """A file system that stops for good after some renames."""

    def __init__(self, fs, left):
        self.fs, self.left = fs, left

    def rename(self, a, b):
        if self.left[0] == 0:
            raise Killed
        self.left[0] -= 1
        return self.fs.rename(a, b)

    def delete(self, *a):
        if self.left[0] == 0:
            raise Killed
        return self.fs.delete(*a)

    def __getattr__(self, name):
        return getattr(self.fs, name)


@pytest.mark.parametrize("renames", range(1, 10))
def test_a_killed_writer_leaves_one_whole_state(spark, tmp_path, monkeypatch, renames):
    path = f"file://{tmp_path}/d"
    both = the_dataset(spark).unionByName(the_dataset(spark, "2024_02_test", 2024, 2))
    io.write_race_dataset(both, path)
    folder, left = io._folder, [renames]
    monkeypatch.setattr(io, "_folder", lambda s, p: (Dies(folder(s, p)[0], left), folder(s, p)[1]))
    try:
        io.write_race_dataset(both.withColumn("TyreLife", F.lit(5.0)), path, overwrite=True, check=False)
    except Killed:
        pass
    monkeypatch.undo()
    monkeypatch.setattr(io, "LEASE", 0)
    got = [{r.TyreLife for r in io.read_race_dataset(spark, path).filter(F.col("RoundNumber") == n).collect()} for n in (1, 2)]
    assert got == [{5.0}, {5.0}]
    assert sorted((r.race_id, r.verified) for r in io.verify_checksum(spark, path).collect()) == [("2024_01_test", True), ("2024_02_test", True)]
    assert not (tmp_path / "d-publish").exists()


def test_a_living_writer_is_waited_for(spark, tmp_path):
    import threading
    import time

    path = f"file://{tmp_path}/d"
    io.write_race_dataset(the_dataset(spark), path)
    note = tmp_path / "d-publish" / "note"
    note.parent.mkdir()
    note.write_text("{}")
    threading.Timer(1.5, note.unlink).start()
    began = time.time()
    assert io.read_race_dataset(spark, path).count() == 9 and time.time() - began > 1


def test_tree_digests_depend_on_the_bytes_alone(spark, tmp_path):
    spark.range(300_000).selectExpr("id", "xxhash64(id) as h").coalesce(1).write.parquet(f"file://{tmp_path}/a")
    (name,) = (tmp_path / "a").glob("*.parquet")
    digest = lambda: io.file_checksums(spark, f"file://{tmp_path}/a", whole=1000, leaf=50_000).first().sha256
    first = digest()
    assert first.startswith("t") and len(first) == 65
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
        spark.conf.set("spark.sql.files.openCostInBytes", "100000")
        assert io.file_checksums(spark, f"file://{tmp_path}/a", whole=1000, leaf=50_000).rdd.getNumPartitions() and digest() == first
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    (tmp_path / "a" / f".{name.name}.crc").unlink()
    raw = bytearray(name.read_bytes())
    for at in (5, len(raw) // 2, len(raw) - 1):
        raw[at] ^= 1
        name.write_bytes(raw)
        assert digest() != first
        raw[at] ^= 1
    name.write_bytes(raw)
    assert digest() == first
    lines = bytes(raw).split(b"\n")
    lines[3], lines[4] = lines[4], lines[3]
    name.write_bytes(b"\n".join(lines))
    assert digest() != first


def test_samples_of_stored_rows(spark, tmp_path):
    laps = laps_of(spark, race_rows()).withColumn("TyreLife", F.lit(-1.0)).withColumn("LapTime", F.col("LapTimeSeconds"))
    laps.coalesce(1).write.parquet(f"file://{tmp_path}/laps")
    stored = spark.read.parquet(f"file://{tmp_path}/laps")
    sample = lambda d: {r.code: r.sample_rows for r in validate.validate_laps(d, row_id=rules.STORED).collect()}["negative_tyre_life"]
    assert [x.rsplit(":", 1)[1] for x in sample(stored)] == [f"{i:012d}" for i in range(5)]
    with_place = rules.with_stored_place(stored).repartition(3).orderBy(F.rand(1))
    assert {r.code: r.sample_rows for r in validate.validate_laps(with_place, row_id=rules.PLACE).collect()}["negative_tyre_life"] == sample(stored)


def test_a_hot_round_is_split(spark):
    one = the_dataset(spark)
    many = one.select(*[c for c in one.columns if c not in ("SnapshotLap", "RoundNumber")], F.explode(F.sequence(F.lit(1).cast("long"), F.lit(2000).cast("long"))).alias("SnapshotLap"), F.lit(1).alias("RoundNumber"))
    few = many.filter("SnapshotLap < 40").withColumns({"RoundNumber": F.lit(2), "RaceId": F.lit("2024_02_x")})
    d = many.unionByName(few).select(*one.columns)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = corpus.sorted_for_storage(d).select(F.spark_partition_id().alias("p"), "RoundNumber", "SnapshotLap").groupBy("p").agg(F.count("*").alias("n"), F.min(F.struct("RoundNumber", "SnapshotLap")).alias("lo"), F.max(F.struct("RoundNumber", "SnapshotLap")).alias("hi")).orderBy("p").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    sizes = [r.n for r in got]
    assert len(sizes) == 4 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    assert all(tuple(a.hi) <= tuple(b.lo) for a, b in zip(got, got[1:]))


def test_a_stored_summary_reads_no_data(spark, tmp_path):
    path, d = f"file://{tmp_path}/d", the_dataset(spark).unionByName(the_dataset(spark, "2023_02_x", 2023, 2))
    io.write_race_dataset(d, path)
    got = io.stored_summary(spark, path)
    assert tuple(got.first()) == tuple(corpus.corpus_summary(d).first()) == (2, 2, 18, 6, 3, "2023_02_x", "2024_01_test")
    assert all("/d-parts/" in f for f in got.inputFiles())
    io.write_race_dataset(the_dataset(spark).filter("Driver <> 'BOT'"), path, overwrite=True)
    assert io.stored_summary(spark, path).first().row_count == 15


def test_kept_rows_are_not_stored_again(spark, tmp_path, monkeypatch):
    """Rows from files are dealt from there: a write neither stores them once more nor reads what it wrote for its manifests."""
    both = the_dataset(spark).unionByName(the_dataset(spark, "2024_02_test", 2024, 2))
    both.write.parquet(f"file://{tmp_path}/rows")
    d, dropped = spark.read.parquet(f"file://{tmp_path}/rows"), []
    keep = io.remove
    monkeypatch.setattr(io, "remove", lambda s, p: (dropped.append((p.rsplit("/", 1)[-1], io.exists(s, p))), keep(s, p)))
    monkeypatch.setattr(io, "dataset_manifest", None)
    m = io.write_race_dataset(d, f"file://{tmp_path}/d", kept=True)
    assert dict(dropped) == {"rows": False, "bounds": True}
    want = ("row_count", "snapshot_count", "driver_count", "snapshot_lap_min", "snapshot_lap_max", "winner_row_count")
    assert sorted(tuple(r[c] for c in ("race_id", *want)) for r in m.collect()) == [("2024_01_test", 9, 3, 3, 1, 3, 3), ("2024_02_test", 9, 3, 3, 1, 3, 3)]
    assert sorted(map(tuple, io.read_race_dataset(spark, f"file://{tmp_path}/d").collect()), key=str) == sorted(map(tuple, both.collect()), key=str)
    assert all(r.verified for r in io.verify_checksum(spark, f"file://{tmp_path}/d").collect())
    with pytest.raises(ValueError, match="checks"):
        io.write_draft(d, "d", "draft", checks=dataset.Checks(), kept=True)


def test_summary_parts_copy_no_rows(spark):
    """Rows are summed up by snapshot and by driver: neither copied for each distinct count, nor gathered as sets of drivers by snapshot."""
    d = the_dataset(spark)
    plan = corpus.summary_parts(d)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "collect_set" not in plan
    odd = d.withColumn("Driver", F.when(F.col("Driver") != "BOT", F.col("Driver")))
    (r,) = corpus.summary_parts(odd).collect()
    assert (r.rows, r.snapshots, sorted(r.drivers), r.first_snapshot, r.last_snapshot, r.winner_rows) == (9, 3, ["NOR", "VER"], 1, 3, 3)


@pytest.mark.parametrize("name", ["overwrite_guard", "recovered_publication", "stored_summary"])
def test_queries_run_a_plan_once(spark, monkeypatch, name):
    """A query that writes a dataset several times makes it once."""
    from lapreplay import queries

    made, files = [], []
    build, write = dataset.build_race_dataset, io.write_draft
    monkeypatch.setattr(dataset, "build_race_dataset", lambda *a, **k: (made.append(1), build(*a, **k))[1])
    monkeypatch.setattr(io, "write_draft", lambda d, *a, **k: (files.extend(d.inputFiles()), write(d, *a, **k))[1])
    assert queries.QUERIES[name](spark, FOLDER).count() and len(made) == 1
    assert files and not any("events.parquet" in f for f in files)


def test_identity_is_checked_by_groups(spark):
    """Blank and varying identities are counted from rows that share one, with what they were row by row."""
    plan = dataset.check_dataset(the_dataset(spark))._jdf.queryExecution().optimizedPlan().toString()
    rows = [line for line in plan.splitlines() if "count_if" in line or "count(if" in line]
    assert not any("xxhash64" in line or "btrim" in line for line in rows)
    bad = the_dataset(spark).withColumns({"EventName": F.when(F.col("Driver") == "BOT", "\t").when(F.col("Driver") == "NOR", None).otherwise(F.col("EventName")), "Season": F.when(F.col("SnapshotLap") > 1, F.col("Season")).otherwise(2023)})
    got = sorted((r.code, r.affected_rows) for r in dataset.check_dataset(bad).collect())
    assert got == [("blank_EventName", 6), ("varying_EventName", 1), ("varying_Season", 1)]


def test_sessions_are_asked_for_distinct_races(spark):
    """Laps are reduced to their races before the search for sessions without laps."""
    plan = validate.empty_tables(sessions_of(spark), laps_of(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [RaceId" in plan
    assert [r.RaceId for r in validate.empty_tables(sessions_of(spark).unionByName(sessions_of(spark, "x")), laps_of(spark)).collect()] == ["x"]
