"""Every operator as a query over the shared tables, beside the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapreplay import fixtures
from lapreplay.fixtures import REPLAY_SQL
from lapreplay.fixtures import SQL as BASE
from lapreplay.functions import coerce
from lapreplay.operators import clean, corpus, dataset, profile, replay, rules, targets, validate
from lapreplay.plans import flows
from lapreplay.schemas import DATASET, LAP_COLUMNS, METADATA, REPLAY
from lapreplay.sources import io
from lapreplay.sources.staging import folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, more: str = ""):
    """Register the function by its name; ``sql`` selects from the fixtures and the tables that ``more`` adds."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {BASE}{', ' + more if more else ''} {sql}"
        return f

    return add


def cols(*names: str) -> str:
    return ", ".join(f'"{n}"' for n in names)


def rounded(df: DataFrame) -> DataFrame:
    """Sums of hundredths, as the nearest number of two decimals."""
    return df.withColumn("CumulativeLapTimeSeconds", F.round("CumulativeLapTimeSeconds", 2))


REPLAYED = REPLAY_SQL.format(n="replay", laps="laps")
GAPS = "laps_gaps AS (SELECT * FROM laps WHERE event_id % 11 <> 0), " + REPLAY_SQL.format(n="gaps_replay", laps="laps_gaps")
TARGETS = """targets AS (SELECT "RaceId", "Abbreviation" AS "Driver", "Position" = 1 AS "WonRace" FROM results)"""
DATA = f"""{REPLAYED}, {TARGETS}, data AS (SELECT {cols(*METADATA)}, {cols(*REPLAY)}, "WonRace" FROM replay JOIN targets USING ("RaceId", "Driver") JOIN sessions USING ("RaceId"))"""


def the_replay(spark, sf_dir, **more):
    return rounded(replay.build_race_replay(fixtures.laps(spark, sf_dir), check=False, **more))


def the_targets(spark, sf_dir):
    return targets.build_winner_targets(fixtures.results(spark, sf_dir), check=False)


def the_dataset(spark, sf_dir):
    f = fixtures
    return rounded(dataset.build_race_dataset(f.laps(spark, sf_dir), f.results(spark, sf_dir), f.sessions(spark, sf_dir), check=False))


def kept(df, name: str):
    """``df``, stored once in the shared folder and read from there, so that its plan isn't run by each of its readers."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def landed(spark, sf_dir):
    """Laps, results and sessions as stored tables."""
    return [kept(f(spark, sf_dir), f.__name__) for f in (fixtures.laps, fixtures.results, fixtures.sessions)]


# Sources


@query(f"""SELECT {cols("RaceId", "Driver", "LapNumber", "Position")} FROM laps WHERE "RaceId" IN (SELECT "RaceId" FROM sessions WHERE "Season" = 2024 AND "RoundNumber" = 3)""")
def scan_session(spark, sf_dir):
    root = folder(spark, "landed")
    io.land_tables({"laps": fixtures.laps(spark, sf_dir), "results": fixtures.results(spark, sf_dir)}, fixtures.sessions(spark, sf_dir), root)
    chosen = io.session_selection(fixtures.sessions(spark, sf_dir), 2024, 3, seasons=(2023, 2024))
    return io.scan_session(spark, root, chosen, weather=False, messages=False)["laps"].select("RaceId", "Driver", "LapNumber", "Position")


@query(f"""SELECT {cols("RaceId", "Driver", "LapNumber", "Position")} FROM laps WHERE "RaceId" IN (SELECT "RaceId" FROM sessions WHERE "Season" = 2023)""")
def scan_season(spark, sf_dir):
    """More sessions than a filter on partitions may name: the join prunes."""
    root, s = folder(spark, "landed"), fixtures.sessions(spark, sf_dir)
    io.land_tables({"laps": fixtures.laps(spark, sf_dir)}, s, root)
    chosen = io.session_selection(s, 2023, seasons=(2023, 2024))
    return io.scan_session(spark, root, chosen, ["laps"], most=3)["laps"].select("RaceId", "Driver", "LapNumber", "Position")


@query(f"""SELECT {cols(*METADATA)} FROM sessions WHERE "Season" = 2023 AND "EventName" = 'Day 2024-01-05'""")
def session_selection(spark, sf_dir):
    return io.session_selection(fixtures.sessions(spark, sf_dir), None, " Day 2024-01-05 ", seasons=(2023, 2024), default_season=2023).select(*METADATA)


@query("""SELECT "RaceId" FROM sessions WHERE "RoundNumber" = 7""")
def event_predicate(spark, sf_dir):
    return fixtures.sessions(spark, sf_dir).filter(io.event_predicate(F.lit(" 07 "))).select("RaceId")


@query("""SELECT "RaceId", CASE WHEN upper(trim(k)) IN ('R', 'Q', 'S', 'FP1', 'FP2', 'FP3') THEN upper(trim(k)) END AS "SessionType" FROM (SELECT "RaceId", CASE "RoundNumber" % 3 WHEN 0 THEN ' r' WHEN 1 THEN 'fp2 ' ELSE 'fp9' END AS k FROM sessions)""")
def session_type_predicate(spark, sf_dir):
    k = F.when(F.col("RoundNumber") % 3 == 0, " r").when(F.col("RoundNumber") % 3 == 1, "fp2 ").otherwise("fp9")
    return fixtures.sessions(spark, sf_dir).select("RaceId", io.session_type(k).alias("SessionType"))


@query("""SELECT "RaceId" FROM sessions WHERE "RoundNumber" % 3 = 0""")
def main_races_only(spark, sf_dir):
    k = F.when(F.col("RoundNumber") % 3 == 0, " r").otherwise("fp2 ")
    return io.main_races(fixtures.sessions(spark, sf_dir).withColumn("SessionType", k)).select("RaceId")


@query("""SELECT "RaceId", count(*) AS n FROM results GROUP BY 1""")
def table_toggle_scan(spark, sf_dir):
    root = folder(spark, "landed")
    fixtures.results(spark, sf_dir).write.parquet(f"{root}/results")
    tables = io.scan_session(spark, root, fixtures.sessions(spark, sf_dir), laps=False, weather=False, messages=False)
    return tables["results"].groupBy("RaceId").agg(F.count("*").alias("n"))


@query("""SELECT "RaceId", 'empty_lap_table' AS code, 0::BIGINT AS affected_rows FROM sessions WHERE "RoundNumber" % 4 = 0""")
def require_table(spark, sf_dir):
    s = fixtures.sessions(spark, sf_dir)
    some = fixtures.laps(spark, sf_dir).join(s.filter("RoundNumber % 4 <> 0"), "RaceId", "left_semi")
    return validate.empty_tables(s, some).select("RaceId", "code", "affected_rows")


@query(f"""SELECT c."RaceId", "Season", "RoundNumber", {cols("Driver", "LapNumber", "Position", "LapTimeSeconds")} FROM clean c JOIN sessions USING ("RaceId")""")
def write_cleaned_laps(spark, sf_dir):
    path = folder(spark, "cleaned")
    io.write_cleaned_laps(clean.clean_columns(fixtures.laps_raw(spark, sf_dir)), fixtures.sessions(spark, sf_dir), path)
    return spark.read.parquet(path).select("RaceId", "Season", "RoundNumber", "Driver", "LapNumber", "Position", "LapTimeSeconds")


@query("""SELECT "RaceId", "Season", "EventName", count(*) AS row_count, 10 AS n_columns, count(*) FILTER (WHERE trim("Driver") = '') AS unnamed FROM laps_raw JOIN sessions USING ("RaceId") GROUP BY ALL""")
def cleaning_report(spark, sf_dir):
    c = clean.clean_laps(fixtures.laps_raw(spark, sf_dir).withColumns({n: F.when(coerce.number(F.col(n)) % 1 == 0, F.col(n)) for n in ("LapNumber", "Position")}).withColumn("LapTime", F.when(F.col("LapTime") != "abc", F.col("LapTime"))), fail_on_input_errors=False)
    out = io.cleaning_report(c.laps, c.before, c.after, fixtures.sessions(spark, sf_dir))
    issues = F.from_json("output_validation", "array<struct<code:string,severity:string,message:string,affected_rows:bigint>>")
    unnamed = F.aggregate(F.filter(issues, lambda x: x["code"] == "missing_driver"), F.lit(0).cast("long"), lambda a, x: a + x["affected_rows"])
    return out.select("RaceId", "Season", "EventName", "row_count", F.size("columns").alias("n_columns"), unnamed.alias("unnamed"))


def stored(spark, sf_dir) -> str:
    """A dataset that was checked, written and given its manifests."""
    path = folder(spark, "dataset")
    io.write_race_dataset(the_dataset(spark, sf_dir), path)
    return path


def stored_from(spark, sf_dir):
    """A checked and stored dataset, and the rows that it was written from, which are kept for further writes."""
    path, d = folder(spark, "dataset"), kept(the_dataset(spark, sf_dir), "rows")
    io.write_race_dataset(d, path, kept=True)
    return path, d


@query("SELECT * FROM data", DATA)
def write_race_dataset(spark, sf_dir):
    return io.read_race_dataset(spark, stored(spark, sf_dir), check=False)


@query("SELECT * FROM data", DATA)
def read_race_dataset(spark, sf_dir):
    return io.read_race_dataset(spark, stored(spark, sf_dir))


MANIFEST = """SELECT 1 AS schema_version, "RaceId" AS race_id, count(*) AS row_count, count(DISTINCT "SnapshotLap") AS snapshot_count, count(DISTINCT "Driver") AS driver_count, min("SnapshotLap") AS snapshot_lap_min,
max("SnapshotLap") AS snapshot_lap_max, count(*) FILTER (WHERE "WonRace") AS winner_row_count, 'WonRace' AS target_column FROM data GROUP BY 2"""
_M = ("schema_version", "race_id", "row_count", "snapshot_count", "driver_count", "snapshot_lap_min", "snapshot_lap_max", "winner_row_count", "target_column")


@query(MANIFEST, DATA)
def dataset_manifest(spark, sf_dir):
    return io.dataset_manifest(the_dataset(spark, sf_dir)).select(*_M)


@query(MANIFEST, DATA)
def read_manifest(spark, sf_dir):
    return io.read_manifest(spark, stored(spark, sf_dir)).select(*_M)


@query("""SELECT "RaceId" AS race_id, "RoundNumber" <> 5 AS verified FROM sessions""")
def verify_checksum(spark, sf_dir):
    """The files of the fifth round are written anew with one label changed."""
    path = stored(spark, sf_dir)
    other = io.read_race_dataset(spark, path, check=False).filter("RoundNumber = 5").withColumn("WonRace", F.col("WonRace") | (F.col("Driver") == F.col("RaceId")))
    changed = other.withColumns({"_season": F.col("Season"), "_round": F.col("RoundNumber"), "TyreLife": F.col("TyreLife") + 1})
    changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_season", "_round").parquet(path)
    return io.verify_checksum(spark, path)


@query("""SELECT "RaceId" AS race_id, count(*) AS row_count, "Season" = 2024 AS replaced FROM data GROUP BY 1, "Season" """, DATA)
def atomic_commit(spark, sf_dir):
    """A second write replaces one season's races with their manifests; a third one fails and changes neither."""
    path, d = stored_from(spark, sf_dir)
    new = d.filter("Season = 2024").withColumn("EventName", F.concat(F.lit("New "), "EventName"))
    io.write_race_dataset(new, path, overwrite=True, kept=True)
    broken = d.filter("Season = 2023").withColumn("TyreLife", F.when(F.col("SnapshotLap") > 1, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("TyreLife")))
    try:
        io.write_race_dataset(broken, path, overwrite=True)
    except Exception as e:
        if "lost" not in str(e):
            raise
    manifest = io.read_manifest(spark, path).join(io.verify_checksum(spark, path).filter("verified"), "race_id")
    now = io.read_race_dataset(spark, path, check=False).groupBy(F.col("RaceId").alias("race_id")).agg(F.min(F.col("EventName").startswith("New ")).alias("replaced"))
    return manifest.join(now, "race_id").select("race_id", "row_count", "replaced")


@query("""SELECT "RaceId" AS race_id, "RoundNumber" <> 5 AS same FROM sessions""")
def tree_checksum(spark, sf_dir):
    """Trees of digests of all files, of a dataset and of one in which a label of the fifth round is changed."""
    path, d = stored_from(spark, sf_dir)
    paths = [path, folder(spark, "other")]
    other = d.withColumn("TyreLife", F.when(F.col("RoundNumber") == 5, F.col("TyreLife") + 1).otherwise(F.col("TyreLife")))
    io.write_race_dataset(other, paths[1], kept=True)
    a, b = (io.race_checksums(spark, p, whole=0, leaf=1 << 14).select("race_id", F.col("dataset_sha256").alias(n)) for p, n in zip(paths, "ab", strict=True))
    return a.join(b, "race_id").select("race_id", (F.col("a") == F.col("b")).alias("same"))


@query("""SELECT "RaceId" AS race_id, count(*) AS row_count, "Season" = 2024 AS replaced FROM data GROUP BY 1, "Season" """, DATA)
def recovered_publication(spark, sf_dir):
    """A writer has noted that it publishes one season's races, and died before it moved any: the next reader moves them."""
    path, d = stored_from(spark, sf_dir)
    new = d.filter("Season = 2024").withColumn("EventName", F.concat(F.lit("New "), "EventName"))
    draft = f"{path}-draft-lost"
    io.write_draft(new, path, draft, kept=True)
    io.noted(spark, io._folder(spark, path)[0], path, draft)
    io.recover(spark, path, lease=0)
    manifest = io.read_manifest(spark, path).join(io.verify_checksum(spark, path).filter("verified"), "race_id")
    now = io.read_race_dataset(spark, path, check=False).groupBy(F.col("RaceId").alias("race_id")).agg(F.min(F.col("EventName").startswith("New ")).alias("replaced"))
    return manifest.join(now, "race_id").select("race_id", "row_count", "replaced")


@query("SELECT * FROM data", DATA)
def overwrite_guard(spark, sf_dir):
    path, d = stored_from(spark, sf_dir)
    io.write_race_dataset(d, path, overwrite=True, kept=True)
    return io.read_race_dataset(spark, path, check=False)


@query("""SELECT "RaceId", t AS "table", "column", n AS rows, 0::BIGINT AS missing_values FROM (SELECT "RaceId", count(*) AS n FROM results GROUP BY 1), (VALUES ('results', 'Abbreviation'), ('results', 'Position')) v(t, "column")""")
def write_inventory(spark, sf_dir):
    path = folder(spark, "inventory")
    found = profile.race_inventory(fixtures.sessions(spark, sf_dir), {"laps": fixtures.laps(spark, sf_dir).withColumn("LapTime", F.col("LapTimeSeconds")), "results": fixtures.results(spark, sf_dir)})
    io.write_inventory(found, path)
    return spark.read.json(path).filter("table = 'results'").select("RaceId", "table", "column", "rows", "missing_values")


# Projections


def _raw(spark, sf_dir, *columns):
    return fixtures.laps_raw(spark, sf_dir).select("event_id", *columns)


@query("""SELECT "RaceId", "Driver", "LapNumber", "Position", "Stint", "Compound", "TyreLife", "TrackStatus", "LapTimeSeconds", event_id FROM clean""")
def clean_laps(spark, sf_dir):
    return clean.clean_columns(fixtures.laps_raw(spark, sf_dir)).drop("LapTime")


@query("""SELECT event_id, trim("Driver") AS driver, trim("TrackStatus") AS status FROM laps_raw""")
def trim_text(spark, sf_dir):
    return _raw(spark, sf_dir, coerce.trimmed(F.col("Driver")).alias("driver"), coerce.trimmed(F.col("TrackStatus")).alias("status"))


@query("""SELECT event_id, nullif(trim("Driver"), '') AS driver, nullif(trim("Compound"), '') AS compound FROM laps_raw""")
def blank_to_null(spark, sf_dir):
    return _raw(spark, sf_dir, coerce.text(F.col("Driver")).alias("driver"), coerce.text(F.col("Compound")).alias("compound"))


@query("""SELECT event_id, upper(nullif(trim("Driver"), '')) AS driver, upper(nullif(trim("Compound"), '')) AS compound FROM laps_raw""")
def upper_text(spark, sf_dir):
    return _raw(spark, sf_dir, coerce.text(F.col("Driver"), True).alias("driver"), coerce.text(F.col("Compound"), True).alias("compound"))


@query("""SELECT event_id, "LapNumber" AS lap, "Position" AS pos, "Stint" AS stint FROM clean""")
def to_whole_number(spark, sf_dir):
    return _raw(spark, sf_dir, *[coerce.whole(F.col(c)).alias(n) for c, n in (("LapNumber", "lap"), ("Position", "pos"), ("Stint", "stint"))])


@query("""SELECT code, count(*) AS n FROM (SELECT CASE WHEN "LapNumber" = 'x' THEN 'non_numeric_LapNumber' WHEN "LapNumber" = '0' THEN 'non_positive_LapNumber' WHEN "LapNumber" = '1.5' THEN 'fractional_LapNumber' END AS code FROM laps_raw
UNION ALL SELECT CASE WHEN "Position" = '0' THEN 'non_positive_Position' WHEN "Position" = '2.5' THEN 'fractional_Position' END FROM laps_raw UNION ALL SELECT 'non_positive_Stint' FROM laps_raw WHERE "Stint" = '-1'
UNION ALL SELECT 'negative_TyreLife' FROM laps_raw WHERE "TyreLife" = '-2') WHERE code IS NOT NULL GROUP BY 1""")
def strict_whole_number(spark, sf_dir):
    bad = replay.check_input(fixtures.laps_raw(spark, sf_dir).withColumn("LapTimeSeconds", F.lit(1.0)))
    return bad.filter(~F.col("code").isin("missing_Driver", "duplicate_driver_lap")).groupBy("code").agg(F.sum("affected_rows").alias("n"))


@query("""SELECT event_id, "TyreLife" AS life, "LapTimeSeconds" AS seconds FROM clean""")
def to_nullable_float(spark, sf_dir):
    c = clean.clean_columns(fixtures.laps_raw(spark, sf_dir))
    return c.select("event_id", F.col("TyreLife").alias("life"), F.col("LapTimeSeconds").alias("seconds"))


@query("""SELECT event_id, CASE WHEN "LapTime" = '00:00:00' THEN 0 WHEN "LapTime" <> 'abc' THEN lap_cs * 10000 END AS micros FROM laps_raw""")
def lap_time_to_duration(spark, sf_dir):
    raw = fixtures.laps_raw(spark, sf_dir)
    return raw.select("event_id", coerce.lap_micros(F.col("LapTime"), raw.schema["LapTime"].dataType).alias("micros"))


@query("""SELECT event_id, "LapTimeSeconds" AS seconds FROM clean""")
def duration_seconds(spark, sf_dir):
    c = clean.clean_columns(fixtures.laps_raw(spark, sf_dir))
    return c.select("event_id", coerce.seconds(coerce.lap_micros(F.col("LapTime"), c.schema["LapTime"].dataType)).alias("seconds"))


@query("""SELECT "RaceId", "Driver", "LapNumber", "Position", "Stint", "Compound", "TyreLife", "TrackStatus", "LapTimeSeconds" FROM clean""")
def select_standardized(spark, sf_dir):
    return clean.select_standardized(clean.clean_columns(fixtures.laps_raw(spark, sf_dir)))


@query("""SELECT event_id, upper(nullif(trim("Driver"), '')) AS driver, trim("Driver") = '' AS blank FROM laps_raw""")
def normalize_driver(spark, sf_dir):
    driver = coerce.text(F.col("Driver"), True)
    return _raw(spark, sf_dir, driver.alias("driver"), driver.isNull().alias("blank"))


@query("""SELECT * FROM replay WHERE "SnapshotLap" BETWEEN 2 AND 4""", REPLAYED)
def lap_range_filter(spark, sf_dir):
    return the_replay(spark, sf_dir, start_lap=2, end_lap=4)


@query("""SELECT * FROM replay WHERE "SnapshotLap" >= 3""", REPLAYED)
def minimum_snapshot_lap(spark, sf_dir):
    return the_replay(spark, sf_dir, start_lap=3)


@query("""SELECT * FROM replay WHERE "SnapshotLap" = 3""", REPLAYED)
def select_snapshot(spark, sf_dir):
    return replay.select_snapshot(the_replay(spark, sf_dir), 3, check=False)


@query("""SELECT "RaceId", "Abbreviation" AS "Driver" FROM results""")
def select_driver_column(spark, sf_dir):
    r = fixtures.results(spark, sf_dir).withColumn("Driver", F.lit("other"))
    return r.select("RaceId", F.col(targets.driver_column(r)).alias("Driver"))


@query("""SELECT "RaceId", "Driver", "WonRace" FROM targets WHERE "WonRace" """, TARGETS)
def winner_flag(spark, sf_dir):
    return the_targets(spark, sf_dir).filter("WonRace")


@query("""SELECT "RaceId", "SnapshotLap", "Driver", "IsLeader" FROM replay""", REPLAYED)
def leader_flag(spark, sf_dir):
    return the_replay(spark, sf_dir).select("RaceId", "SnapshotLap", "Driver", "IsLeader")


@query("""SELECT "RaceId", "SnapshotLap", "Driver", "LapsBehindLeader" FROM replay""", REPLAYED)
def laps_behind(spark, sf_dir):
    return the_replay(spark, sf_dir).select("RaceId", "SnapshotLap", "Driver", "LapsBehindLeader")


@query(f"SELECT {cols(*METADATA)} FROM sessions")
def race_identity(spark, sf_dir):
    s = fixtures.sessions(spark, sf_dir).withColumn("EventName", F.concat(F.lit(" "), "EventName", F.lit("\t")))
    return dataset.race_identity(s)


@query("""SELECT "RaceId" AS id FROM sessions""")
def race_id(spark, sf_dir):
    return fixtures.sessions(spark, sf_dir).select(coerce.race_id(F.col("Season"), F.col("RoundNumber"), F.col("EventName")).alias("id"))


@query("""SELECT "RoundNumber", "Season", CASE WHEN "RoundNumber" % 2 = 0 THEN 'Asked' ELSE "EventName" END AS "EventName", 'Race' AS "SessionName" FROM sessions""")
def event_metadata_fallback(spark, sf_dir):
    s = fixtures.sessions(spark, sf_dir).withColumns({"EventName": F.when(F.col("RoundNumber") % 2 == 0, " ").otherwise(F.col("EventName")), "SessionName": F.lit(None).cast("string")})
    return dataset.race_identity(s, "Asked").select("RoundNumber", "Season", "EventName", "SessionName")


@query("""SELECT event_id, CASE WHEN n >= 1 AND n % 1 = 0 THEN CAST(n AS INTEGER) END AS round FROM (SELECT event_id, TRY_CAST("LapNumber" AS DOUBLE) AS n FROM laps_raw)""")
def round_number_coerce(spark, sf_dir):
    return _raw(spark, sf_dir, coerce.positive_whole(F.col("LapNumber")).alias("round"))


@query("""SELECT event_id, CAST(year(ts) AS INTEGER) AS season FROM events""")
def season_from_event_date(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", profile.season_of(F.col("ts")).alias("season"))


@query("SELECT * FROM data", DATA)
def leak_guard(spark, sf_dir):
    d = the_dataset(spark, sf_dir)
    dataset.require_schema(d)
    return d.select(*DATASET)


# Joins


@query("""SELECT "RaceId", "SnapshotLap", "Driver", "CompletedLaps" FROM gaps_replay""", GAPS)
def snapshot_asof_join(spark, sf_dir):
    ready = replay.prepared_laps(fixtures.laps_gaps(spark, sf_dir))
    out = replay.snapshot_asof_join(replay.running(ready), replay.snapshot_spine(ready))
    return out.select("RaceId", "SnapshotLap", "Driver", F.col("LapNumber").alias("CompletedLaps"))


@query(f"""SELECT {cols("RaceId", *REPLAY)}, "WonRace" FROM replay JOIN targets USING ("RaceId", "Driver")""", f"{REPLAYED}, {TARGETS}")
def attach_winner_targets(spark, sf_dir):
    return targets.attach_winner_targets(the_replay(spark, sf_dir), the_targets(spark, sf_dir), check=False)


@query("""SELECT DISTINCT "RaceId", "Driver" FROM laps WHERE length("Driver") = 3 AND "LapNumber" >= 1 AND EXISTS (SELECT 1 FROM replay r WHERE r."RaceId" = laps."RaceId" AND r."Driver" = laps."Driver")""", REPLAYED)
def missing_targets(spark, sf_dir):
    return targets.missing_targets(the_replay(spark, sf_dir), the_targets(spark, sf_dir).filter("length(Driver) <> 3"))


@query("""SELECT "RaceId", count(*) AS row_count, count(*) FILTER (WHERE length("Driver") = 3) AS unmatched FROM replay GROUP BY 1""", REPLAYED)
def match_completeness(spark, sf_dir):
    out = targets.attach_winner_targets(the_replay(spark, sf_dir), the_targets(spark, sf_dir).filter("length(Driver) <> 3"), check=False)
    return targets.match_completeness(out)


# Aggregations and checks

_RULES = """n AS (SELECT *, TRY_CAST("LapNumber" AS DOUBLE) AS l, TRY_CAST("Position" AS DOUBLE) AS p, TRY_CAST("Stint" AS DOUBLE) AS s, TRY_CAST("TyreLife" AS DOUBLE) AS t, count(*) OVER (PARTITION BY "RaceId", "Driver", "LapNumber") AS copies FROM laps_raw),
dc AS (SELECT "RaceId", count(DISTINCT "Driver") AS drivers FROM laps_raw GROUP BY 1), issues AS (
SELECT "RaceId", code, severity, count(*) AS affected_rows FROM (
SELECT "RaceId", 'duplicate_driver_lap_rows' AS code, 'error' AS severity FROM n WHERE copies > 1
UNION ALL SELECT "RaceId", 'missing_driver', 'error' FROM n WHERE trim("Driver") = ''
UNION ALL SELECT "RaceId", 'driver_whitespace', 'warning' FROM n WHERE "Driver" <> trim("Driver")
UNION ALL SELECT "RaceId", 'invalid_lap_number', 'error' FROM n WHERE l IS NULL
UNION ALL SELECT "RaceId", 'non_positive_lap_number', 'error' FROM n WHERE l <= 0
UNION ALL SELECT "RaceId", 'fractional_lap_number', 'error' FROM n WHERE l % 1 <> 0
UNION ALL SELECT "RaceId", 'missing_position', 'warning' FROM n WHERE p IS NULL
UNION ALL SELECT "RaceId", 'non_positive_position', 'error' FROM n WHERE p <= 0
UNION ALL SELECT "RaceId", 'fractional_position', 'error' FROM n WHERE p % 1 <> 0
UNION ALL SELECT n."RaceId", 'position_above_driver_count', 'error' FROM n JOIN dc USING ("RaceId") WHERE p > drivers
UNION ALL SELECT "RaceId", 'invalid_stint_number', 'error' FROM n WHERE s <= 0 OR s % 1 <> 0
UNION ALL SELECT "RaceId", 'negative_tyre_life', 'error' FROM n WHERE t < 0
UNION ALL SELECT "RaceId", 'invalid_lap_time', 'error' FROM n WHERE "LapTime" = 'abc'
UNION ALL SELECT "RaceId", 'missing_lap_time', 'warning' FROM n WHERE "LapTime" IS NULL
UNION ALL SELECT "RaceId", 'non_positive_lap_time', 'error' FROM n WHERE "LapTime" = '00:00:00' OR lap_cs <= 0 AND "LapTime" <> 'abc'
UNION ALL SELECT "RaceId", 'missing_tyre_compound', 'warning' FROM n WHERE trim("Compound") = ''
UNION ALL SELECT "RaceId", 'missing_track_status', 'warning' FROM n WHERE "TrackStatus" IS NULL) GROUP BY ALL)"""


@query("SELECT * FROM issues", _RULES)
def validate_laps(spark, sf_dir):
    return validate.validate_laps(fixtures.laps_raw(spark, sf_dir)).drop("message")


@query("""SELECT code, CAST(sum(affected_rows) AS BIGINT) AS affected_rows FROM issues GROUP BY 1""", _RULES)
def count_violations(spark, sf_dir):
    return validate.validate_laps(fixtures.laps_raw(spark, sf_dir)).groupBy("code").agg(F.sum("affected_rows").alias("affected_rows"))


@query("""SELECT "RaceId", error_count, warning_count, error_count > 0 AS has_errors, warning_count > 0 AS has_warnings FROM (SELECT "RaceId", count(*) FILTER (WHERE severity = 'error') AS error_count, count(*) FILTER (WHERE severity = 'warning') AS warning_count FROM issues GROUP BY 1)""", _RULES)
def validation_summary(spark, sf_dir):
    return rules.summary(validate.validate_laps(fixtures.laps_raw(spark, sf_dir)))


@query("SELECT * FROM targets", TARGETS)
def build_winner_targets(spark, sf_dir):
    return the_targets(spark, sf_dir)


@query("""SELECT "RaceId", "Driver", "LapNumber", count(*) AS copies FROM laps_raw GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def duplicate_key_check(spark, sf_dir):
    return rules.duplicate_keys(fixtures.laps_raw(spark, sf_dir), ["RaceId", "Driver", "LapNumber"])


@query("""SELECT "RaceId", count(DISTINCT "Driver") AS drivers FROM laps_raw GROUP BY 1""")
def driver_count(spark, sf_dir):
    return fixtures.laps_raw(spark, sf_dir).groupBy("RaceId").agg(F.countDistinct("Driver").alias("drivers"))


@query("""SELECT "RaceId", 'leader_count' AS code, count(*) AS affected_rows FROM (SELECT "RaceId", "SnapshotLap", count(*) FILTER (WHERE "IsLeader" AND "SnapshotLap" % 2 = 0) AS n FROM replay GROUP BY 1, 2) WHERE n <> 1 GROUP BY 1""", REPLAYED)
def leader_count_check(spark, sf_dir):
    bad = the_replay(spark, sf_dir).withColumn("IsLeader", F.col("IsLeader") & (F.col("SnapshotLap") % 2 == 0))
    return replay.leader_count_check(bad).select("RaceId", "code", "affected_rows")


_WINNERS = """SELECT "RaceId", 'snapshot_winner_count' AS code, count(*) AS affected_rows FROM (SELECT "RaceId", "SnapshotLap", count(*) FILTER (WHERE "WonRace") AS n FROM gaps_replay JOIN targets USING ("RaceId", "Driver") GROUP BY 1, 2) WHERE n <> 1 GROUP BY 1"""


@query(_WINNERS, f"{GAPS}, {TARGETS}")
def winner_count_check(spark, sf_dir):
    out = targets.attach_winner_targets(replay.build_race_replay(fixtures.laps_gaps(spark, sf_dir), check=False), the_targets(spark, sf_dir), check=False)
    return targets.winner_count_check(out).select("RaceId", "code", "affected_rows")


def spoilt(spark, sf_dir):
    """A dataset that breaks rules."""
    d = the_dataset(spark, sf_dir)
    return d.withColumns({
        "CompletedLaps": F.when(F.col("Driver") == "U1", F.col("SnapshotLap") + 1).otherwise(F.col("CompletedLaps")), "EventName": F.when(F.col("Driver") == "U2", " ").otherwise(F.col("EventName")),
        "DataAvailableThroughLap": F.when(F.col("Driver") != "U3", F.col("DataAvailableThroughLap")), "WonRace": F.when(F.col("Driver") != "U4", F.col("WonRace")),
    })


_SPOILT = """, blank AS (SELECT "RaceId", 'blank_EventName' AS code, count(*) AS affected_rows FROM data WHERE "Driver" = 'U2' GROUP BY 1), varying AS (SELECT "RaceId", 'varying_EventName' AS code, 1::BIGINT AS affected_rows FROM data GROUP BY 1 HAVING count(*) FILTER (WHERE "Driver" = 'U2') BETWEEN 1 AND count(*) - 1)"""
_CHECKED = """SELECT * FROM (SELECT "RaceId", 'completed_beyond_snapshot' AS code, count(*) AS affected_rows FROM data WHERE "Driver" = 'U1' GROUP BY 1
UNION ALL SELECT "RaceId", 'deficit_mismatch', count(*) FROM data WHERE "Driver" = 'U1' GROUP BY 1 UNION ALL SELECT "RaceId", 'availability_mismatch', count(*) FROM data WHERE "Driver" = 'U3' GROUP BY 1
UNION ALL SELECT "RaceId", 'missing_target', count(*) FROM data WHERE "Driver" = 'U4' GROUP BY 1 UNION ALL FROM blank UNION ALL FROM varying
UNION ALL SELECT "RaceId", 'snapshot_winner_count', count(*) FROM (SELECT "RaceId", "SnapshotLap" FROM data GROUP BY 1, 2 HAVING count(*) FILTER (WHERE "WonRace" AND "Driver" <> 'U4') <> 1) GROUP BY 1)"""


@query("SELECT * FROM (FROM blank UNION ALL FROM varying)", DATA + _SPOILT)
def metadata_constancy(spark, sf_dir):
    return dataset.metadata_constancy(spoilt(spark, sf_dir)).select("RaceId", "code", "affected_rows")


@query(_CHECKED, DATA + _SPOILT)
def check_dataset(spark, sf_dir):
    return dataset.check_dataset(spoilt(spark, sf_dir)).select("RaceId", "code", "affected_rows")


@query(_CHECKED, DATA + _SPOILT)
def validate_races_in_corpus(spark, sf_dir):
    return corpus.check_corpus(spoilt(spark, sf_dir)).select("RaceId", "code", "affected_rows")


_ROUNDS = """SELECT "Season", r AS "RoundNumber", count(*) AS races, string_agg("RaceId", ',' ORDER BY "RaceId") AS race_ids FROM (SELECT "Season", CAST(("RoundNumber" + 1) // 2 AS INTEGER) AS r, "RaceId" FROM sessions) GROUP BY 1, 2 HAVING count(*) > 1"""


@query(_ROUNDS)
def season_round_uniqueness(spark, sf_dir):
    return corpus.season_round_uniqueness(fixtures.sessions(spark, sf_dir).withColumn("RoundNumber", F.expr("cast((RoundNumber + 1) div 2 as int)")))


@query("""SELECT race_ids AS "RaceId", 'season_round_collision' AS code, races AS affected_rows FROM clash""", f"clash AS ({_ROUNDS})")
def check_corpus(spark, sf_dir):
    d = the_dataset(spark, sf_dir).withColumn("RoundNumber", F.expr("cast((RoundNumber + 1) div 2 as int)"))
    return corpus.check_corpus(d).select("RaceId", "code", "affected_rows")


@query("""SELECT "RaceId", code, affected_rows FROM (SELECT "RaceId", 'missing_position' AS code, count(*) AS affected_rows FROM results WHERE "Position" % 5 = 0 GROUP BY 1 UNION ALL SELECT DISTINCT "RaceId", 'winner_count', 1::BIGINT FROM results WHERE "RaceId" LIKE '2024%')""")
def check_targets(spark, sf_dir):
    p = F.when(F.col("RaceId").like("2024%") & (F.col("Position") == 1), 2).when(F.col("Position") % 5 == 0, None).otherwise(F.col("Position"))
    return targets.check_results(fixtures.results(spark, sf_dir).withColumn("Position", p)).select("RaceId", "code", "affected_rows")


@query("""SELECT "RaceId", 'completed_beyond_snapshot' AS code, count(*) AS affected_rows FROM replay WHERE "Driver" = 'U1' GROUP BY 1 UNION ALL SELECT "RaceId", 'negative_deficit', count(*) FROM replay WHERE "Driver" = 'U2' GROUP BY 1""", REPLAYED)
def check_replay(spark, sf_dir):
    r = the_replay(spark, sf_dir)
    bad = r.withColumns({"CompletedLaps": F.when(F.col("Driver") == "U1", F.col("SnapshotLap") + 1).otherwise(F.col("CompletedLaps")), "LapsBehindLeader": F.when(F.col("Driver") == "U2", -1).otherwise(F.col("LapsBehindLeader"))})
    return replay.check_replay(bad).select("RaceId", "code", "affected_rows")


@query("""SELECT "RaceId", 2::BIGINT AS sources FROM sessions WHERE "Season" = 2023""")
def duplicate_race_check(spark, sf_dir):
    s = fixtures.sessions(spark, sf_dir)
    return corpus.duplicate_races([s, s.filter("Season = 2023")])


@query("""SELECT count(DISTINCT "RaceId") AS race_count, count(DISTINCT "Season") AS season_count, count(*) AS row_count, count(DISTINCT ("RaceId", "SnapshotLap")) AS snapshot_count, count(DISTINCT "Driver") AS driver_count, min("RaceId") AS first_race_id, max("RaceId") AS last_race_id FROM data""", DATA)
def stored_summary(spark, sf_dir):
    """One season is written again with a driver fewer, then as it was: each race's parts are those of its last write."""
    path, d = stored_from(spark, sf_dir)
    for new, check in ((d.filter("Season = 2024 and Driver <> 'U1'"), False), (d.filter("Season = 2024"), True)):  # the driver may be a race's winner
        io.write_race_dataset(new, path, overwrite=True, check=check, kept=True)
    return io.stored_summary(spark, path)


@query("""SELECT count(DISTINCT "RaceId") AS race_count, count(DISTINCT "Season") AS season_count, count(*) AS row_count, count(DISTINCT ("RaceId", "SnapshotLap")) AS snapshot_count, count(DISTINCT "Driver") AS driver_count, min("RaceId") AS first_race_id, max("RaceId") AS last_race_id FROM data""", DATA)
def corpus_summary(spark, sf_dir):
    return corpus.corpus_summary(the_dataset(spark, sf_dir))


@query("""SELECT "RaceId", c AS "column", n AS rows, CASE c WHEN 'Position' THEN p WHEN 'LapTime' THEN l WHEN 'TrackStatus' THEN s ELSE 0 END AS missing_values FROM (SELECT "RaceId", count(*) AS n, count(*) - count("Position") AS p, count(*) - count("LapTime") AS l, count(*) - count("TrackStatus") AS s FROM laps_raw GROUP BY 1), (VALUES ('Driver'), ('LapNumber'), ('LapTime'), ('Position'), ('Stint'), ('Compound'), ('TyreLife'), ('TrackStatus'), ('event_id')) v(c)""")
def table_profile(spark, sf_dir):
    return profile.table_profile(fixtures.laps_raw(spark, sf_dir), "laps").select("RaceId", "column", "rows", "missing_values")


@query("""SELECT "RaceId", "EventName", 'weather' AS "table", false AS available, 0::BIGINT AS rows FROM sessions UNION ALL SELECT "RaceId", "EventName", 'results', true, n FROM sessions JOIN (SELECT "RaceId", count(*) AS n FROM results GROUP BY 1) USING ("RaceId"), (VALUES (1), (2)) v(k)""")
def race_inventory(spark, sf_dir):
    laps = fixtures.laps(spark, sf_dir).withColumn("LapTime", F.col("LapTimeSeconds"))
    found = profile.race_inventory(fixtures.sessions(spark, sf_dir), {"laps": laps, "results": fixtures.results(spark, sf_dir), "weather": None})
    return found.filter("table <> 'laps'").select("RaceId", "EventName", "table", "available", "rows")


# Windows


@query("""SELECT "RaceId", "Driver", "LapNumber", gaps AS "MissingLapTimes" FROM run_replay""", REPLAYED)
def running_missing_count(spark, sf_dir):
    return replay.running(replay.prepared_laps(fixtures.laps(spark, sf_dir))).select("RaceId", "Driver", "LapNumber", "MissingLapTimes")


@query("""SELECT "RaceId", "Driver", "LapNumber", CASE WHEN gaps = 0 THEN s / 100 END AS "CumulativeLapTimeSeconds" FROM run_replay""", REPLAYED)
def cumulative_lap_time(spark, sf_dir):
    return rounded(replay.running(replay.prepared_laps(fixtures.laps(spark, sf_dir)))).select("RaceId", "Driver", "LapNumber", "CumulativeLapTimeSeconds")


@query("""SELECT "RaceId", "Driver", max("LapNumber") AS "CompletedLaps" FROM laps_gaps WHERE "LapNumber" <= 3 AND "RaceId" IN (SELECT "RaceId" FROM laps_gaps WHERE "LapNumber" = 3 AND "Position" = 1) GROUP BY 1, 2""", GAPS)
def latest_row_per_driver(spark, sf_dir):
    r = replay.build_race_replay(fixtures.laps_gaps(spark, sf_dir), start_lap=3, end_lap=3, check=False)
    return r.select("RaceId", "Driver", "CompletedLaps")


@query("""SELECT event_id, count(*) OVER (PARTITION BY "RaceId", "Driver", "LapNumber") > 1 AS repeated FROM laps_raw""")
def duplicate_mask(spark, sf_dir):
    return fixtures.laps_raw(spark, sf_dir).select("event_id", rules.repeated("RaceId", "Driver", "LapNumber").alias("repeated"))


_SAMPLES = """SELECT "RaceId", 'negative_tyre_life' AS code, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS samples FROM (SELECT "RaceId", event_id, row_number() OVER (PARTITION BY "RaceId" ORDER BY event_id) AS k FROM laps_raw WHERE "TyreLife" = '-2') WHERE k <= 5 GROUP BY 1"""


@query(_SAMPLES)
def sample_rows(spark, sf_dir):
    found = validate.validate_laps(fixtures.laps_raw(spark, sf_dir), row_id="event_id").filter("code = 'negative_tyre_life'")
    return found.select("RaceId", "code", F.concat_ws(",", "sample_rows").alias("samples"))


@query(_SAMPLES)
def sample_stored_rows(spark, sf_dir):
    """The rows are known by their files; the laps are stored in the order of their events and read in another."""
    path = folder(spark, "laps")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    top = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("event_id")).first()[0] or 0
    at = F.expr(f"cast(event_id div {top // parts + 1} as int)")  # stretches of events, a file each
    fixtures.laps_raw(spark, sf_dir).repartitionById(parts, at).sortWithinPartitions("event_id").write.parquet(path)
    laps = spark.read.parquet(path)
    found = validate.validate_laps(laps, row_id=rules.STORED).filter("code = 'negative_tyre_life'").select("RaceId", "code", F.explode("sample_rows").alias(rules.PLACE))
    events = rules.with_stored_place(laps).select(rules.PLACE, "event_id")
    found = found.join(events, rules.PLACE).groupBy("RaceId", "code").agg(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")).alias("s"))
    return found.select("RaceId", "code", F.concat_ws(",", "s").alias("samples"))


@query(_SAMPLES.replace("<= 5", "<= 2"))
def top5_sample(spark, sf_dir):
    bad = [rules.Rule("negative_tyre_life", "error", "below zero", coerce.number(F.col("TyreLife")) < 0)]
    found = rules.violations(fixtures.laps_raw(spark, sf_dir), bad, row_id="event_id", samples=2)
    return found.select("RaceId", "code", F.concat_ws(",", "sample_rows").alias("samples"))


# Orders: the sorted rows are numbered as they come, partition by partition


def _numbered(df):
    """``place``: each row's number in the order of the table itself.

    The sorted rows are stored first: ranges have sampled bounds, which differ where the plan runs twice.
    """
    at = df.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    path = folder(df.sparkSession, "sorted")
    at.write.parquet(path)
    at = df.sparkSession.read.schema(at.schema).parquet(path)
    rows = at.groupBy("_part").agg(F.count("*").alias("n"))  # as few rows as partitions
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = at.join(rows.withColumn("_before", before).drop("n"), "_part")
    return at.withColumn("place", F.col("_before") + F.col("_row").bitwiseAND((1 << 33) - 1) + 1)


@query("""SELECT "RaceId", "SnapshotLap", "Driver", row_number() OVER (ORDER BY "RaceId", "SnapshotLap", "Position" NULLS LAST, "Driver") AS place FROM replay""", REPLAYED)
def sort_replay(spark, sf_dir):
    return _numbered(replay.sort_replay(the_replay(spark, sf_dir))).select("RaceId", "SnapshotLap", "Driver", "place")


@query("""SELECT "RaceId", "Abbreviation" AS "Driver", "Position" = 1 AS "WonRace", row_number() OVER (ORDER BY "RaceId", "Position", "Abbreviation") AS place FROM results""")
def sort_targets(spark, sf_dir):
    return _numbered(targets.sort_targets(fixtures.results(spark, sf_dir))).select("RaceId", "Driver", "WonRace", "place")


@query("""SELECT "RaceId", "SnapshotLap", "Driver", row_number() OVER (ORDER BY "Season", "RoundNumber", "SnapshotLap", "Position" NULLS LAST, "Driver") AS place FROM data""", DATA)
def sort_corpus(spark, sf_dir):
    return _numbered(corpus.sort_corpus(the_dataset(spark, sf_dir))).select("RaceId", "SnapshotLap", "Driver", "place")


@query("""SELECT event_id, lead("LapNumber") OVER (PARTITION BY "RaceId", "Driver" ORDER BY "LapNumber") AS "NextLap" FROM laps""")
def working_order(spark, sf_dir):
    d = fixtures.laps(spark, sf_dir)
    return replay.running(d).select("event_id", "NextLap")


@query("""SELECT min("RaceId") AS first_race_id, max("RaceId") AS last_race_id FROM data""", DATA)
def first_last_race(spark, sf_dir):
    return corpus.corpus_summary(the_dataset(spark, sf_dir)).select("first_race_id", "last_race_id")


# Sets


@query("SELECT * FROM data", DATA)
def combine_race_datasets(spark, sf_dir):
    d = the_dataset(spark, sf_dir)
    return corpus.combine_race_datasets([d.filter("Season = 2024"), d.filter("Season = 2023")], check=False)


@query("""SELECT DISTINCT "RaceId", "LapNumber" AS "SnapshotLap" FROM laps_gaps WHERE "Position" = 1""", GAPS)
def snapshot_spine(spark, sf_dir):
    return replay.snapshot_spine(fixtures.laps_gaps(spark, sf_dir))


@query("""SELECT DISTINCT "RaceId", "Season", "RoundNumber" FROM data""", DATA)
def distinct_races(spark, sf_dir):
    return the_dataset(spark, sf_dir).select("RaceId", "Season", "RoundNumber").distinct()


@query("""SELECT DISTINCT "RaceId", "SnapshotLap" FROM data""", DATA)
def distinct_snapshots(spark, sf_dir):
    return the_dataset(spark, sf_dir).select("RaceId", "SnapshotLap").distinct()


@query("""SELECT DISTINCT "RaceId", "Driver" FROM laps EXCEPT SELECT "RaceId", "Driver" FROM laps WHERE "LapNumber" > 2""")
def set_difference(spark, sf_dir):
    """Drivers of a race who finished two laps at most."""
    d = fixtures.laps(spark, sf_dir)
    return rules.missing_keys(d, d.filter("LapNumber > 2"), ["RaceId", "Driver"])


@query("""SELECT "RaceId", 'RoundNumber int and RoundNumber bigint; Driver string and Position bigint; Position bigint and Driver string' AS differences, count(*) AS rows FROM data GROUP BY 1""", DATA)
def exact_schema_check(spark, sf_dir):
    """A dataset against one with two columns in another order and one of another type."""
    d = the_dataset(spark, sf_dir)
    swapped = [{"Driver": "Position", "Position": "Driver"}.get(c, c) for c in d.columns]
    found = corpus.schema_differences(d, d.withColumn("RoundNumber", F.col("RoundNumber").cast("long")).select(swapped))
    return d.groupBy("RaceId").agg(F.count("*").alias("rows")).withColumn("differences", F.lit("; ".join(found)))


_COPIES = """SELECT "RaceId", c AS "column", n AS copies FROM (SELECT DISTINCT "RaceId" FROM laps), (VALUES {}) v(c, n)"""


@query(_COPIES.format("('Driver', 1), ('LapNumber', 1), ('LapTime', 0), ('Position', 1), ('Stint', 1), ('Compound', 1), ('TyreLife', 1), ('TrackStatus', 1)"))
def require_columns(spark, sf_dir):
    """These laps have no lap times."""
    return validate.column_report(fixtures.laps(spark, sf_dir), LAP_COLUMNS)


@query(_COPIES.format("('Driver', 2), ('event_id', 2)"))
def reject_duplicate_columns(spark, sf_dir):
    d = fixtures.laps(spark, sf_dir).select("RaceId", "Driver", "event_id")
    return validate.column_report(d.select("*", F.upper("Driver").alias("Driver"), "event_id"), ["Driver"])


@query("""SELECT NULL::VARCHAR AS "RaceId", 'empty_lap_table' AS code, count(*) AS affected_rows FROM laps_raw WHERE "Stint" = '-9'""")
def empty_lap_table(spark, sf_dir):
    """No lap has that stint."""
    return validate.validate_laps(fixtures.laps_raw(spark, sf_dir).filter("Stint = '-9'")).select("RaceId", "code", "affected_rows")


@query("""SELECT NULL::VARCHAR AS "RaceId", 'duplicate_column_names' AS code, count(*) AS affected_rows FROM laps_raw""")
def duplicate_column_names(spark, sf_dir):
    """Nothing else is looked at in a table that has a name twice."""
    return validate.validate_laps(fixtures.laps_raw(spark, sf_dir).select("*", "Stint").drop("Compound")).select("RaceId", "code", "affected_rows")


@query("""SELECT "RaceId", code, affected_rows FROM issues WHERE code NOT IN ('missing_tyre_compound', 'invalid_stint_number') UNION ALL SELECT NULL, 'missing_required_columns', count(*) FROM laps_raw""", _RULES)
def missing_required_columns(spark, sf_dir):
    """Two columns are absent: all rows are affected, and the other columns' rules still count."""
    return validate.validate_laps(fixtures.laps_raw(spark, sf_dir).drop("Compound", "Stint")).select("RaceId", "code", "affected_rows")


@query("""SELECT "RaceId", code, count(*) AS affected_rows FROM (SELECT "RaceId", 'missing_target' AS code FROM results WHERE "Position" % 7 = 0 UNION ALL SELECT "RaceId", 'duplicate_driver' FROM results, (VALUES (1), (2)) WHERE "Position" = 2 UNION ALL SELECT DISTINCT "RaceId", 'winner_count' FROM results WHERE "RaceId" LIKE '2024%') GROUP BY ALL""")
def check_winner_targets(spark, sf_dir):
    """Some labels are missing, some drivers have two, and one season's races have no winner."""
    t = targets.build_winner_targets(fixtures.results(spark, sf_dir), check=False).join(fixtures.results(spark, sf_dir).select("RaceId", F.col("Abbreviation").alias("Driver"), "Position"), ["RaceId", "Driver"])
    t = t.withColumn("WonRace", F.when(F.col("Position") % 7 != 0, F.col("WonRace") & ~F.col("RaceId").startswith("2024")))
    return targets.check_targets(t.unionByName(t.filter("Position = 2"))).select("RaceId", "code", "affected_rows")


@query("""SELECT "RaceId", code, count(*) AS affected_rows FROM (SELECT CASE WHEN "RaceId" LIKE '2023%' THEN "RaceId" END AS "RaceId", unnest(CASE WHEN "TyreLife" = '-2' THEN ['negative_tyre_life'] ELSE [] END || CASE WHEN trim("Driver") = '' THEN ['missing_driver'] ELSE [] END) AS code FROM laps_raw) GROUP BY 1, 2""")
def laps_without_race(spark, sf_dir):
    """Laps of one season have lost their race; their broken rules still count."""
    d = fixtures.laps_raw(spark, sf_dir).withColumn("RaceId", F.when(F.col("RaceId").startswith("2023"), F.col("RaceId")))
    return validate.validate_laps(d).filter(F.col("code").isin("negative_tyre_life", "missing_driver")).select("RaceId", "code", "affected_rows")


# Whole flows


@query("SELECT * FROM replay", REPLAYED)
def build_race_replay(spark, sf_dir):
    return the_replay(spark, sf_dir)


@query("SELECT * FROM replay", REPLAYED)
def build_race_replay_checked(spark, sf_dir):
    return rounded(replay.build_race_replay(fixtures.laps(spark, sf_dir)))


_FAR = "laps_far AS (SELECT * REPLACE (\"LapNumber\" * 1000003 AS \"LapNumber\") FROM laps), " + REPLAY_SQL.format(n="far_replay", laps="laps_far")


@query("SELECT * FROM far_replay", _FAR)
def build_race_replay_sparse(spark, sf_dir):
    """Lap numbers a million apart."""
    return rounded(replay.build_race_replay(fixtures.laps(spark, sf_dir).withColumn("LapNumber", F.col("LapNumber") * 1000003), check=False))


@query("SELECT * FROM data", DATA)
def build_race_dataset_checked(spark, sf_dir):
    f = fixtures
    return rounded(dataset.build_race_dataset(f.laps(spark, sf_dir), f.results(spark, sf_dir), f.sessions(spark, sf_dir)))


@query("SELECT * FROM data", DATA)
def combine_checked(spark, sf_dir):
    d = io.read_race_dataset(spark, stored(spark, sf_dir), check=False)
    return corpus.combine_race_datasets([d.filter("Season = 2024"), d.filter("Season = 2023")])


@query("SELECT * FROM gaps_replay", GAPS)
def build_race_replay_gaps(spark, sf_dir):
    return rounded(replay.build_race_replay(fixtures.laps_gaps(spark, sf_dir), check=False))


@query("SELECT * FROM data", DATA)
def build_race_dataset(spark, sf_dir):
    return the_dataset(spark, sf_dir)


@query("""SELECT "RaceId", "EventName", count(*) AS row_count FROM laps_raw JOIN sessions USING ("RaceId") GROUP BY ALL""")
def prepare_race_data(spark, sf_dir):
    laps = fixtures.laps_raw(spark, sf_dir).withColumns({n: F.when(coerce.number(F.col(n)) % 1 == 0, F.col(n)) for n in ("LapNumber", "Position")}).withColumn("LapTime", F.when(F.col("LapTime") != "abc", F.col("LapTime")))
    return flows.prepare_race_data(laps, fixtures.sessions(spark, sf_dir), folder(spark, "prepared"), fail_on_input_errors=False).select("RaceId", "EventName", "row_count")


@query(MANIFEST, DATA)
def build_and_save_race_dataset(spark, sf_dir):
    laps, results, sessions = landed(spark, sf_dir)
    laps = laps.withColumn("LapTime", coerce.interval(F.round(F.col("LapTimeSeconds") * 1e6).cast("long"))).select("RaceId", *LAP_COLUMNS)
    return flows.build_and_save_race_dataset(laps, results, sessions, folder(spark, "built")).select(*_M)


@query("""SELECT "RaceId", CASE WHEN "Season" = 2024 THEN 'test' WHEN "RoundNumber" > 10 THEN 'validation' ELSE 'train' END AS "Split", count(*) AS n FROM data GROUP BY 1, 2""", DATA)
def chronological_split(spark, sf_dir):
    return corpus.chronological_split(the_dataset(spark, sf_dir), 2023, 5, (2024,), check=False).groupBy("RaceId", "Split").agg(F.count("*").alias("n"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay with winner labels: the flagship query."""
    return attach_winner_targets(spark, sf_dir)
