import pytest
from helpers import laps_of, results_of, sessions_of
from pyspark.sql import functions as F
from test_replay import the_dataset

from lapreplay.functions import coerce
from lapreplay.plans import flows
from lapreplay.schemas import LAP_COLUMNS, ArtifactError
from lapreplay.sources import io


def test_round_trip_and_tampering(spark, tmp_path):
    path, d = f"file://{tmp_path}/d", the_dataset(spark)
    m = io.write_race_dataset(d, path).first()
    assert (m.row_count, m.snapshot_count, m.driver_count, m.snapshot_lap_min, m.snapshot_lap_max, m.winner_row_count) == (9, 3, 3, 1, 3, 3)
    assert sorted(map(tuple, io.read_race_dataset(spark, path).collect()), key=str) == sorted(map(tuple, d.collect()), key=str)
    assert io.verify_checksum(spark, path).first().verified
    assert io.file_checksums(spark, path).count() >= 1
    with pytest.raises(ArtifactError, match="exists"):
        io.write_race_dataset(d, path)
    io.write_race_dataset(d, path, overwrite=True)
    changed = d.withColumn("TyreLife", F.col("TyreLife") + 1).withColumns({"_season": F.lit(2024), "_round": F.lit(1)})
    changed.write.mode("overwrite").partitionBy("_season", "_round").parquet(path)
    assert not io.verify_checksum(spark, path).first().verified


def test_absent_and_broken(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    for read in (io.read_race_dataset, io.read_manifest):
        with pytest.raises(ArtifactError):
            read(spark, path)
    (tmp_path / "bad-manifest").mkdir()
    (tmp_path / "bad-manifest" / "x.json").write_text("not json")
    with pytest.raises(Exception, match="(?i)malformed"):
        io.read_manifest(spark, f"file://{tmp_path}/bad").collect()


def test_flows(spark, tmp_path):
    raw = laps_of(spark).withColumn("LapTime", coerce.interval((F.col("LapTimeSeconds") * 1e6).cast("long"))).select("RaceId", *LAP_COLUMNS)
    m = flows.build_and_save_race_dataset(raw, results_of(spark), sessions_of(spark), f"file://{tmp_path}/built").first()
    assert (m.race_id, m.row_count) == ("2024_01_test", 9)
    assert flows.load_corpus(spark, f"file://{tmp_path}/built").count() == 9
    report = flows.prepare_race_data(raw, sessions_of(spark), f"file://{tmp_path}/prepared").first()
    assert (report.row_count, report.input_validation) == (8, "[]")
    assert spark.read.parquet(f"file://{tmp_path}/prepared/laps").count() == 8


def test_failed_write_leaves_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/failed"
    broken = the_dataset(spark).withColumn("TyreLife", F.when(F.col("SnapshotLap") == 3, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("TyreLife")))
    with pytest.raises(Exception, match="lost"):
        io.write_race_dataset(broken, path, check=False)
    assert not io.exists(spark, f"{path}-manifest") and not list(tmp_path.rglob("part-*.parquet"))


def test_inventory_files(spark, tmp_path):
    from lapreplay.operators import profile

    laps = laps_of(spark).withColumn("LapTime", F.col("LapTimeSeconds"))
    found = profile.race_inventory(sessions_of(spark), {"laps": laps, "results": results_of(spark), "weather": None})
    io.write_inventory(found, f"file://{tmp_path}/inventory")
    assert [p.name for p in tmp_path.glob("inventory/_race=*")] == ["_race=2024_test_race"]
    with pytest.raises(ArtifactError):
        io.write_inventory(found, f"file://{tmp_path}/inventory")
    with pytest.raises(ValueError):
        profile.race_inventory(sessions_of(spark), {"laps": None})
