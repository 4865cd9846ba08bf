import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapreplay.functions import coerce
from lapreplay.operators import clean, profile, validate
from lapreplay.schemas import CleaningError, LapValidationError
from lapreplay.sources import io


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column).first()[0]


@pytest.mark.parametrize("text, want", [(" 1 ", 1.0), ("1e3", 1000.0), ("inf", float("inf")), ("+5", 5.0), (".5", 0.5), ("", None), ("1,000", None), ("0x10", None), ("1d", None), ("1f", None), ("nan", None), ("x", None)])
def test_numbers(spark, text, want):
    assert one(spark, coerce.number(F.col("x")), text) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("00:01:38.100", 98.1), ("00:61:00", 3660.0), ("1 days 00:00:01", 86401.0), ("-00:00:01", -1.0), ("98.1s", 98.1), ("1min", 60.0), ("P0DT0H1M38.1S", 98.1),
        ("1:38.1", None), ("98.1", None), ("", None), ("abc", None),
    ],
)
def test_lap_times(spark, text, want):
    assert one(spark, coerce.seconds(coerce.lap_micros(F.col("x"), T.StringType())), text) == want


def test_lap_time_kinds(spark):
    assert one(spark, coerce.lap_micros(F.col("x"), T.LongType()), 98_100_000_000, "long") == 98_100_000
    df = spark.sql("select interval '0 00:01:38.1' day to second as x")
    assert df.select(coerce.lap_micros(F.col("x"), df.schema["x"].dataType)).first()[0] == 98_100_000
    assert one(spark, coerce.interval(F.col("x")), 98_100_000, "long").total_seconds() == 98.1


def test_trim_and_slug(spark):
    assert one(spark, coerce.trimmed(F.col("x")), "\t  a b　\n") == "a b"
    assert one(spark, coerce.slug(F.col("x")), "  São Paulo GP! ") == "são_paulo_gp"
    assert one(spark, coerce.slug(F.col("x")), "!!") == "unknown_event"
    assert one(spark, coerce.race_id(F.lit(2024), F.lit(123), F.col("x")), "A b") == "2024_123_a_b"
    assert one(spark, profile.season_of(F.col("x")), "2024-03-02 15:00:00") == 2024
    assert one(spark, coerce.whole(F.col("x")), "1.5") is None
    assert one(spark, coerce.fractional(coerce.number(F.col("x"))), "inf") is True


RAW = "RaceId string, Driver string, LapNumber double, LapTime string, Position double, Stint double, Compound string, TyreLife double, TrackStatus string, Extra string"


def raw(spark, **change):
    rows = [dict(RaceId="r", Driver=" ver ", LapNumber=1.0, LapTime="00:01:30.5", Position=1.0, Stint=1.0, Compound=" soft", TyreLife=1.0, TrackStatus=" 1 ", Extra="e"), dict(RaceId="r", Driver="NOR", LapNumber=1.0, LapTime="00:01:31", Position=2.0, Stint=1.0, Compound="", TyreLife=2.0, TrackStatus=None, Extra=None)]
    rows[1] |= change
    return spark.createDataFrame([tuple(r.values()) for r in rows], RAW)


def test_clean(spark):
    c = clean.clean_laps(raw(spark))
    r = {x.Driver: x for x in c.laps.collect()}
    assert (r["VER"].Compound, r["VER"].TrackStatus, r["VER"].LapTimeSeconds, r["VER"].LapNumber, r["VER"].Extra) == ("SOFT", "1", 90.5, 1, "e")
    assert r["NOR"].Compound is None and c.laps.count() == 2
    assert {x.code for x in c.before.collect()} == {"driver_whitespace", "missing_tyre_compound", "missing_track_status"}
    assert {x.code for x in c.after.collect()} == {"missing_tyre_compound", "missing_track_status"}


@pytest.mark.parametrize("change, code", [({"LapNumber": 1.5}, "fractional_lap_number"), ({"Position": 9.0}, "position_above_driver_count"), ({"LapTime": "abc"}, "invalid_lap_time"), ({"TyreLife": -1.0}, "negative_tyre_life"), ({"Driver": None}, "missing_driver"), ({"Stint": 0.0}, "invalid_stint_number"), ({"LapTime": "00:00:00"}, "non_positive_lap_time")])
def test_rules(spark, change, code):
    with pytest.raises(LapValidationError, match=code):
        validate.require_valid(raw(spark, **change))
    with pytest.raises(CleaningError):
        clean.clean_laps(raw(spark, **change))


def test_lenient_cleaning(spark):
    assert clean.clean_laps(raw(spark, TyreLife=-1.0), fail_on_input_errors=False).laps.count() == 2
    with pytest.raises(CleaningError, match="unreadable"):
        clean.clean_laps(raw(spark, LapTime="abc"), fail_on_input_errors=False)


def test_structure(spark):
    codes = lambda df: {r["code"] for r in validate.validate_laps(df).collect()}
    assert "missing_required_columns" in codes(raw(spark).drop("Stint"))
    twice = raw(spark).select("*", F.lit("x").alias("Driver"))
    assert codes(twice) == {"duplicate_column_names"}
    with pytest.raises(CleaningError, match="duplicate"):
        clean.clean_laps(twice)


def test_selection(spark):
    s = spark.createDataFrame([("a", 2023, 1, "Alpha", "R"), ("b", 2024, 7, "Beta", " r"), ("c", 2024, 8, "Beta", "Q")], "RaceId string, Season int, RoundNumber int, EventName string, SessionType string")
    pick = lambda *a, **k: [r.RaceId for r in io.session_selection(s, *a, seasons=(2023, 2024), **k).collect()]
    assert pick(2024, "7") == ["b"] and pick(2024, " Beta ") == ["b"] and pick(2024, "Beta", "q") == ["c"] and pick(default_season=2023) == ["a"]
    for bad in ((2025, 1), (2024, " "), (2024, 1, "X")):
        with pytest.raises(ValueError):
            pick(*bad)


def test_cells_are_read_once(spark):
    """Rules that share a cell share what is read from it: each pattern of a lap time is in the plan once or twice, not once for each part and rule."""
    from lapreplay.operators.clean import clean_columns
    from lapreplay.operators.validate import validate_laps

    rows = [("r", "A", "1", "2", "1", "SOFT", "1", "1", x) for x in ("1 days 00:01:02.5", "-00:00:01", "00:01:30", "1 min 2 s", "PT1M2.5S", "90", "1:2", "", "0:0:1.23456789", "+00:00:00", None)]
    laps = spark.createDataFrame(rows, "RaceId string, Driver string, LapNumber string, Position string, Stint string, Compound string, TyreLife string, TrackStatus string, LapTime string")
    got = [r.LapTimeSeconds for r in clean_columns(laps).collect()]
    assert got == [86462.5, -1.0, 90.0, 62.0, 62.5, None, None, None, 1.234567, 0.0, None]
    assert validate_laps(laps).filter("code = 'invalid_lap_time'").first().affected_rows == 3
    for df in (clean_columns(laps), validate_laps(laps)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert 1 <= plan.count("(\\d{1,9}) days") <= 2
