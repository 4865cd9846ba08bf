import pytest
from helpers import laps_of, race_rows, results_of, sessions_of
from pyspark.sql import functions as F

from lapreplay.operators import corpus, dataset, replay, targets
from lapreplay.schemas import CorpusError, DatasetError, RaceDataError, ReplayError, TargetError


def rows(df):
    return {(r["SnapshotLap"], r["Driver"]): r for r in df.collect()}


def test_the_race(spark):
    got = rows(replay.build_race_replay(laps_of(spark)))
    assert len(got) == 9
    bot = got[3, "BOT"]
    assert (bot.CompletedLaps, bot.LapsBehindLeader, bot.Position, bot.LastLapTimeSeconds, bot.CumulativeLapTimeSeconds, bot.IsLeader) == (2, 1, 3, 91.0, 183.0, False)
    assert [got[3, d].CumulativeLapTimeSeconds for d in ("VER", "NOR")] == [267.0, 270.0]
    assert [got[n, "VER"].IsLeader for n in (1, 2, 3)] == [True] * 3


def test_gap_poisons_the_sum(spark):
    laps = laps_of(spark).withColumn("LapTimeSeconds", F.when((F.col("Driver") == "NOR") & (F.col("LapNumber") == 2), F.lit(None)).otherwise(F.col("LapTimeSeconds")))
    got = rows(replay.build_race_replay(laps))
    assert (got[2, "NOR"].CumulativeLapTimeSeconds, got[3, "NOR"].CumulativeLapTimeSeconds) == (None, None)
    assert (got[2, "NOR"].LastLapTimeSeconds, got[3, "NOR"].LastLapTimeSeconds) == (None, 89.0)


def test_range_keeps_sums(spark):
    got = rows(replay.build_race_replay(laps_of(spark), start_lap=2, end_lap=2))
    assert len(got) == 3 and got[2, "VER"].CumulativeLapTimeSeconds == 179.0


def test_later_laps_change_nothing_and_order_is_free(spark):
    late = laps_of(spark).withColumn("LapTimeSeconds", F.when(F.col("LapNumber") == 3, 500.0).otherwise(F.col("LapTimeSeconds")))
    a, b = rows(replay.build_race_replay(laps_of(spark))), rows(replay.build_race_replay(late))
    assert {k: v for k, v in a.items() if k[0] < 3} == {k: v for k, v in b.items() if k[0] < 3}
    assert rows(replay.build_race_replay(laps_of(spark, race_rows()[::-1]))) == a


def test_races_together_are_races_apart(spark):
    two = race_rows("a") + race_rows("b")
    both = replay.build_race_replay(laps_of(spark, two)).filter("RaceId = 'a'")
    assert sorted(map(tuple, both.collect()), key=str) == sorted(map(tuple, replay.build_race_replay(laps_of(spark, race_rows("a"))).collect()), key=str)


def test_unknown_position_leaves_leadership_unknown(spark):
    laps = laps_of(spark).withColumn("Position", F.when((F.col("Driver") == "NOR") & (F.col("LapNumber") == 2), F.lit(None)).otherwise(F.col("Position")))
    assert rows(replay.build_race_replay(laps))[2, "NOR"].IsLeader is None


@pytest.mark.parametrize(
    "column, value, code",
    [
        ("Driver", "' '", "missing_Driver"), ("LapNumber", "null", "missing_LapNumber"), ("LapNumber", "0", "non_positive_LapNumber"), ("LapNumber", "1.5D", "fractional_LapNumber"), ("LapNumber", "'x'", "non_numeric_LapNumber"),
        ("Position", "-1", "non_positive_Position"), ("Stint", "0", "non_positive_Stint"), ("TyreLife", "-1", "negative_TyreLife"), ("LapTimeSeconds", "0", "non_positive_LapTimeSeconds"), ("LapNumber", "1", "duplicate_driver_lap"),
    ],
)
def test_bad_laps(spark, column, value, code):
    at = "Driver = 'NOR' and LapNumber = 2"
    laps = laps_of(spark).withColumn(column, F.expr(f"if({at}, cast({value} as string), cast({column} as string))"))
    assert code in {r["code"] for r in replay.check_input(laps).collect()}
    with pytest.raises(ReplayError, match=code):
        replay.build_race_replay(laps)


def test_no_leader_no_laps_bad_range(spark):
    with pytest.raises(ReplayError):
        replay.build_race_replay(laps_of(spark).filter("Position > 1"))
    with pytest.raises(ReplayError):
        replay.build_race_replay(laps_of(spark, []))
    with pytest.raises(ReplayError):
        replay.build_race_replay(laps_of(spark), start_lap=3, end_lap=2)
    with pytest.raises(ReplayError):
        replay.build_race_replay(laps_of(spark).drop("Stint"))
    with pytest.raises(ReplayError):
        replay.select_snapshot(replay.build_race_replay(laps_of(spark)), 9)


def test_two_leaders(spark):
    with pytest.raises(ReplayError, match="leader_count"):
        replay.build_race_replay(laps_of(spark).withColumn("Position", F.lit(1)))


def test_labels(spark):
    t = targets.build_winner_targets(results_of(spark))
    assert {r.Driver: r.WonRace for r in t.collect()} == {"VER": True, "NOR": False, "BOT": False}
    r = replay.build_race_replay(laps_of(spark))
    assert targets.attach_winner_targets(r, t).filter("WonRace").count() == 3
    with pytest.raises(TargetError, match="without a label"):
        targets.attach_winner_targets(r, t.filter("Driver <> 'BOT'"))
    with pytest.raises(TargetError, match="already"):
        targets.attach_winner_targets(targets.attach_winner_targets(r, t), t)


@pytest.mark.parametrize("position, code", [("2", "winner_count"), ("null", "missing_position"), ("0", "non_positive_position"), ("1.5", "fractional_position")])
def test_bad_results(spark, position, code):
    bad = results_of(spark).withColumn("Position", F.expr(f"if(Abbreviation = 'VER', cast({position} as double), cast(Position as double))"))
    with pytest.raises(TargetError, match=code):
        targets.build_winner_targets(bad)


def the_dataset(spark, race="2024_01_test", season=2024, number=1):
    return dataset.build_race_dataset(laps_of(spark, race_rows(race)), results_of(spark, race), sessions_of(spark, race, season, number))


@pytest.mark.parametrize(
    "column, value, code",
    [
        ("CompletedLaps", "9", "completed_beyond_snapshot"), ("DataAvailableThroughLap", "null", "availability_mismatch"), ("LapsBehindLeader", "7", "deficit_mismatch"),
        ("WonRace", "null", "missing_target"), ("WonRace", "false", "snapshot_winner_count"), ("EventName", "' '", "blank_EventName"), ("EventName", "'Other'", "varying_EventName"), ("Driver", "'NOR'", "duplicate_key"),
    ],
)
def test_bad_dataset(spark, column, value, code):
    d = the_dataset(spark)
    kind = d.schema[column].dataType.simpleString()
    bad = d.withColumn(column, F.expr(f"if(Driver = 'VER' and SnapshotLap = 2, cast({value} as {kind}), {column})"))
    assert code in {r["code"] for r in dataset.check_dataset(bad).collect()}


def test_dataset_contract(spark):
    d = the_dataset(spark)
    assert d.count() == 9
    with pytest.raises(DatasetError, match="after the race"):
        dataset.validate_race_dataset(d.withColumn("Points", F.lit(1)))
    with pytest.raises(DatasetError, match="boolean"):
        dataset.validate_race_dataset(d.withColumn("WonRace", F.lit(1)))
    with pytest.raises(DatasetError, match="empty"):
        dataset.validate_race_dataset(d.limit(0))


def test_corpus(spark):
    parts = [the_dataset(spark, "2024_01_x", 2024, 1), the_dataset(spark, "2023_02_x", 2023, 2), the_dataset(spark, "2023_01_x", 2023, 1)]
    c = corpus.combine_race_datasets(parts)
    s = corpus.corpus_summary(c).first()
    assert tuple(s) == (3, 2, 27, 9, 3, "2023_01_x", "2024_01_x")
    assert [r.RaceId for r in corpus.sort_corpus(c).select("RaceId").collect()][::9] == ["2023_01_x", "2023_02_x", "2024_01_x"]
    split = {r.RaceId: r.Split for r in corpus.chronological_split(c, 2023, 1, (2024,)).select("RaceId", "Split").distinct().collect()}
    assert split == {"2023_01_x": "train", "2023_02_x": "validation", "2024_01_x": "test"}
    with pytest.raises(CorpusError, match="more than once"):
        corpus.combine_race_datasets([parts[0], parts[0]])
    with pytest.raises(CorpusError, match="differ"):
        corpus.combine_race_datasets([parts[0], parts[1].withColumn("Season", F.col("Season").cast("long"))])
    with pytest.raises(RaceDataError, match="collision"):
        corpus.combine_race_datasets([parts[0], the_dataset(spark, "2024_01_y", 2024, 1)])
    with pytest.raises(CorpusError, match="before"):
        corpus.chronological_split(c, 2024, 1, (2024,))
