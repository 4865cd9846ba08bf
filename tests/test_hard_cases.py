"""Empty tables, rows without a race, laps far apart, races without a session, and writes that fail midway."""

import pytest
from helpers import laps_of, race_rows, results_of, sessions_of
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_replay import the_dataset

from lapreplay.functions import coerce
from lapreplay.operators import clean, corpus, dataset, replay, rules, validate
from lapreplay.schemas import LAP_COLUMNS, ArtifactError, CleaningError, DatasetError, LapValidationError, ReplayError
from lapreplay.sources import io


def raw(spark, rows=None):
    return laps_of(spark, rows).withColumn("LapTime", coerce.interval((F.col("LapTimeSeconds") * 1e6).cast("long"))).select("RaceId", *LAP_COLUMNS)


def test_empty_table_is_an_error(spark):
    empty = raw(spark).limit(0)
    found = validate.validate_laps(empty).collect()
    assert [(r.RaceId, r.code, r.severity, r.affected_rows) for r in found] == [(None, "empty_lap_table", "error", 0)]
    assert validate.validate_laps(raw(spark)).filter("code = 'empty_lap_table'").count() == 0
    with pytest.raises(LapValidationError, match="empty_lap_table"):
        validate.require_valid(empty)
    with pytest.raises(CleaningError, match="empty_lap_table"):
        clean.clean_laps(empty)
    assert clean.clean_laps(empty, fail_on_input_errors=False).laps.count() == 0
    assert {r.code for r in validate.validate_laps(empty.drop("Stint"), row_id="LapNumber").collect()} == {"empty_lap_table"}


def test_rows_without_a_race(spark):
    rows = [(None, *r[1:]) for r in race_rows()[:2]] + [(None, "  ", *r[2:]) for r in race_rows()[2:4]] + race_rows()
    found = {(r.RaceId, r.code): r for r in validate.validate_laps(raw(spark, rows), row_id="LapNumber").collect()}
    assert found[None, "missing_driver"].affected_rows == 2 and len(found[None, "missing_driver"].sample_rows) == 2
    assert ("2024_01_test", "missing_driver") not in found
    with pytest.raises(ReplayError, match="missing_RaceId"):
        replay.build_race_replay(laps_of(spark, rows[:2] + race_rows()))


def test_laps_far_apart(spark):
    far = [("r", "A", 1, 1), ("r", "B", 1, 2), ("r", "A", 2_000_000_000, 1), ("r", "B", 1_999_999_999, 2), ("s", "A", 5, 1)]
    laps = spark.createDataFrame([(*x, 1, "SOFT", 1.0, "1", 90.0) for x in far], laps_of(spark).schema)
    got = sorted((r.RaceId, r.SnapshotLap, r.Driver, r.CompletedLaps) for r in replay.build_race_replay(laps).collect())
    assert got == [("r", 1, "A", 1), ("r", 1, "B", 1), ("r", 2_000_000_000, "A", 2_000_000_000), ("r", 2_000_000_000, "B", 1_999_999_999), ("s", 5, "A", 5)]


def test_laps_outside_the_spine(spark):
    """B is on track before the first and after the last lap that has a leader."""
    rows = [("r", "B", 1, 2), ("r", "A", 3, 1), ("r", "A", 6, 1), ("r", "B", 7, 2), ("r", "C", 6, 3), ("r", "D", 9, None)]
    laps = spark.createDataFrame([(*x, 1, "SOFT", 1.0, "1", 90.0) for x in rows], laps_of(spark).schema)
    got = sorted((r.SnapshotLap, r.Driver, r.CompletedLaps) for r in replay.build_race_replay(laps, check=False).collect())
    assert got == [(3, "A", 3), (3, "B", 1), (6, "A", 6), (6, "B", 1), (6, "C", 6)]


def test_races_without_a_session(spark, tmp_path):
    laps, results = laps_of(spark, race_rows() + race_rows("2024_02_other")), results_of(spark).unionByName(results_of(spark, "2024_02_other"))
    with pytest.raises(DatasetError, match="no session"):
        dataset.build_race_dataset(laps, results, sessions_of(spark))
    with pytest.raises(ArtifactError, match="no session"):
        io.write_cleaned_laps(laps, sessions_of(spark), f"file://{tmp_path}/laps")
    assert not (tmp_path / "laps").exists()
    report = io.cleaning_report(laps, validate.validate_laps(raw(spark)), validate.validate_laps(raw(spark)), sessions_of(spark).unionByName(sessions_of(spark, "2024_03_none")))
    assert {(r.RaceId, r.row_count, r.EventName) for r in report.collect()} == {("2024_01_test", 8, "Test"), ("2024_02_other", 8, None), ("2024_03_none", 0, "Test")}


@pytest.mark.parametrize("fails", ["write", "move"])
def test_a_failed_overwrite_changes_nothing(spark, tmp_path, monkeypatch, fails):
    path, d = f"file://{tmp_path}/d", the_dataset(spark)
    both = d.unionByName(the_dataset(spark, "2024_02_test", 2024, 2))
    io.write_race_dataset(both, path)
    before = {p.relative_to(tmp_path): p.read_bytes() for p in tmp_path.rglob("part-*")}
    new = both.withColumn("TyreLife", F.lit(5.0))
    if fails == "write":
        new = new.withColumn("TyreLife", F.when(F.col("RoundNumber") == 2, F.raise_error(F.lit("lost")).cast("double")).otherwise(5.0))
    else:
        calls, keep = [], io.race_checksums

        class Breaks:
            """The third rename fails."""

            def __init__(self, fs):
                self.fs = fs

            def rename(self, a, b):
                calls.append(str(b))
                return False if len(calls) == 3 else self.fs.rename(a, b)

            def __getattr__(self, name):
                return getattr(self.fs, name)

        folder = io._folder
        monkeypatch.setattr(io, "_folder", lambda s, p: (Breaks(folder(s, p)[0]), folder(s, p)[1]))
        assert keep
    with pytest.raises(Exception, match="lost|can't be moved"):
        io.write_race_dataset(new, path, overwrite=True, check=False)
    monkeypatch.undo()
    assert {p.relative_to(tmp_path): p.read_bytes() for p in tmp_path.rglob("part-*")} == before
    assert all(r.verified for r in io.verify_checksum(spark, path).collect()) and not list(tmp_path.glob("*draft*"))
    with pytest.raises(Exception, match="lost|can't be moved") if fails == "write" else pytest.raises(ArtifactError, match="exists"):
        io.write_race_dataset(new, f"{path}2" if fails == "write" else path, check=False)
    assert not (tmp_path / "d2").exists() and not (tmp_path / "d2-manifest").exists()


def test_overwriting_one_race_leaves_others(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    io.write_race_dataset(the_dataset(spark).unionByName(the_dataset(spark, "2024_02_test", 2024, 2)), path)
    m = io.write_race_dataset(the_dataset(spark).withColumn("TyreLife", F.lit(9.0)), path, overwrite=True)
    assert sorted((r.race_id, r.row_count) for r in m.collect()) == [("2024_01_test", 9), ("2024_02_test", 9)]
    got = io.read_race_dataset(spark, path).groupBy("RaceId").agg(F.max("TyreLife").alias("t")).collect()
    assert {r.RaceId: r.t for r in got} == {"2024_01_test": 9.0, "2024_02_test": 3.0}
    assert all(r.verified for r in io.verify_checksum(spark, path).collect())


def test_checksum_is_the_files(spark, tmp_path):
    import hashlib

    path = f"file://{tmp_path}/d"
    m = io.write_race_dataset(the_dataset(spark), path).first()
    (file,) = tmp_path.glob("d/*/*/part-*.parquet")
    assert m.dataset_sha256 == hashlib.sha256(file.read_bytes()).hexdigest()


def test_content_hash_tells_nulls_apart(spark):
    d = the_dataset(spark)
    h = lambda x: io.content_hash(x).first().content_hash
    assert h(d) == h(d.orderBy(F.col("Driver").desc()).repartition(3))
    blank = d.withColumns({"Compound": F.lit(None).cast("string"), "TrackStatus": F.lit("x")})
    other = d.withColumns({"Compound": F.lit("x"), "TrackStatus": F.lit(None).cast("string")})
    assert len({h(d), h(blank), h(other), h(d.withColumn("Compound", F.lit("\0"))), h(d.withColumn("Compound", F.lit(None).cast("string")))}) == 5


def test_typed_cells(spark):
    big = 2**53 + 1
    d = spark.createDataFrame([(big, str(big), float("nan"), 2.5), (None, " +7 ", 3.0, None)], "l long, t string, d double, f float")
    got = d.select(coerce.whole(F.col("l"), T.LongType()), coerce.whole(F.col("t")), coerce.number(F.col("d"), T.DoubleType()), coerce.whole(F.col("f"), T.FloatType())).collect()
    assert [tuple(r) for r in got] == [(big, big, None, None), (None, 7, 3.0, None)]


def test_missing_keys_and_summary(spark):
    a = spark.createDataFrame([("r", "A"), ("r", None), (None, "A"), ("r", "A")], "RaceId string, Driver string")
    assert sorted(map(tuple, rules.missing_keys(a, a.filter("RaceId is null"), ["RaceId", "Driver"]).collect()), key=str) == sorted([("r", "A"), ("r", None)], key=str)
    s = corpus.corpus_summary(the_dataset(spark).unionByName(the_dataset(spark, "2023_02_x", 2023, 2))).first()
    assert tuple(s) == (2, 2, 18, 6, 3, "2023_02_x", "2024_01_test")
    assert corpus.corpus_summary(the_dataset(spark).limit(0)).first().row_count == 0


def test_column_report(spark):
    d = laps_of(spark)
    got = {r.column: r.copies for r in validate.column_report(d.select("*", "Stint"), LAP_COLUMNS).collect()}
    assert got["Stint"] == 2 and got["LapTime"] == 0 and got["Driver"] == 1
