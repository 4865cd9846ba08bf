"""Lap tables made from the shared event and order tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("day", F.to_date("ts"))


def _race(df: DataFrame) -> DataFrame:
    d = F.dayofmonth("day")
    return df.withColumn("RaceId", F.format_string("%d_%02d_day_%s", F.when(d <= 15, 2023).otherwise(2024), F.when(d <= 15, d).otherwise(d - 15), F.date_format("day", "yyyy_MM_dd")))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.dayofmonth("day")
    days = _race(_events(spark, sf_dir).select("day").distinct())
    return days.select("RaceId", F.when(d <= 15, 2023).otherwise(2024).alias("Season"), F.when(d <= 15, d).otherwise(d - 15).alias("RoundNumber"), F.concat(F.lit("Day "), F.date_format("day", "yyyy-MM-dd")).alias("EventName"), F.lit("Race").alias("SessionName"))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _race(_events(spark, sf_dir))
    mine = Window.partitionBy("day", "user_id").orderBy("ts", "event_id")
    e = e.withColumn("LapNumber", F.row_number().over(mine).cast("long"))
    e = e.withColumn("Stint", 1 + F.count_if(F.col("event_type") == "purchase").over(mine.rowsBetween(Window.unboundedPreceding, -1)))
    e = e.withColumn("TyreLife", F.row_number().over(Window.partitionBy("day", "user_id", "Stint").orderBy("LapNumber")).cast("double"))
    return e.withColumn("Position", F.row_number().over(Window.partitionBy("day", "LapNumber").orderBy("ts", "event_id")).cast("long"))


def laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned laps, valid by construction."""
    k = F.get_json_object("props", "$.k").cast("long")
    cs = F.when(F.col("event_id") % 17 != 0, F.greatest(F.round(F.col("value") * 100).cast("long"), F.lit(1)))
    return _numbered(spark, sf_dir).select(
        "RaceId", F.concat(F.lit("U"), F.col("user_id")).alias("Driver"), "LapNumber", "Position", "Stint", F.upper("event_type").alias("Compound"), "TyreLife",
        (k % 7 + 1).cast("string").alias("TrackStatus"), (cs / 100).alias("LapTimeSeconds"), cs.alias("lap_cs"), "event_id",
    )


def laps_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laps with every eleventh event missing."""
    return laps(spark, sf_dir).filter("event_id % 11 <> 0")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _numbered(spark, sf_dir).groupBy("RaceId", "user_id").agg(F.max("LapNumber").alias("l"), F.max("ts").alias("t"), F.max("event_id").alias("e"))
    w = Window.partitionBy("RaceId").orderBy(F.col("l").desc(), "t", "e")
    return e.select("RaceId", F.concat(F.lit("U"), F.col("user_id")).alias("Abbreviation"), F.row_number().over(w).cast("long").alias("Position"))


def laps_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laps as texts, with planted defects."""
    m = F.col("event_id")
    at = lambda n: m % n == 0
    cs = F.col("lap_cs")
    clock = F.format_string("%02d:%02d:%02d.%02d", F.floor(cs / 360000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100)
    d = laps(spark, sf_dir)
    d = d.select(
        "RaceId",
        F.when(at(101), "").when(at(5), F.concat(F.lit(" "), F.lower("Driver"), F.lit(" "))).otherwise(F.col("Driver")).alias("Driver"),
        F.when(at(97), "x").when(at(89), "0").when(at(83), "1.5").otherwise(F.col("LapNumber").cast("string")).alias("LapNumber"),
        F.when(at(53) & cs.isNotNull(), "abc").when(at(47) & cs.isNotNull(), "00:00:00").when(cs.isNotNull(), clock).alias("LapTime"),
        F.when(at(79), None).when(at(73), "0").when(at(71), "2.5").when(at(67), "9999").otherwise(F.col("Position").cast("string")).alias("Position"),
        F.when(at(61), "-1").otherwise(F.col("Stint").cast("string")).alias("Stint"),
        F.when(at(43), "").otherwise(F.concat(F.lit(" "), F.lower("Compound"))).alias("Compound"),
        F.when(at(59), "-2").otherwise(F.col("TyreLife").cast("long").cast("string")).alias("TyreLife"),
        F.when(at(41), None).otherwise(F.concat(F.lit(" "), F.col("TrackStatus"))).alias("TrackStatus"), "event_id",
    )
    return d.unionByName(d.filter("event_id % 103 = 0"))


def laps_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laps of suppliers by month, for timing."""
    rest = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("RaceId", F.date_format("l_shipdate", "yyyy-MM"))
    x = x.withColumn("LapNumber", F.row_number().over(Window.partitionBy("RaceId", "l_suppkey").orderBy(*rest)).cast("long"))
    x = x.withColumn("Position", F.row_number().over(Window.partitionBy("RaceId", "LapNumber").orderBy(*rest, "l_suppkey")).cast("long"))
    return x.select("RaceId", F.concat(F.lit("S"), F.col("l_suppkey")).alias("Driver"), "LapNumber", "Position", F.lit(1).cast("long").alias("Stint"), F.col("l_returnflag").alias("Compound"), F.col("l_quantity").alias("TyreLife"), F.col("l_linestatus").alias("TrackStatus"), (F.round(F.col("l_extendedprice") * 100).cast("long") / 100).alias("LapTimeSeconds"))


#: The same tables as common table expressions.
SQL = """
ev AS (
  SELECT *, CAST(ts AS DATE) AS day, day(ts) AS d, printf('%d_%02d_day_%s', CASE WHEN day(ts) <= 15 THEN 2023 ELSE 2024 END, CASE WHEN day(ts) <= 15 THEN day(ts) ELSE day(ts) - 15 END, strftime(ts, '%Y_%m_%d')) AS "RaceId" FROM events
), sessions AS (
  SELECT DISTINCT "RaceId", CAST(CASE WHEN d <= 15 THEN 2023 ELSE 2024 END AS INTEGER) AS "Season", CAST(CASE WHEN d <= 15 THEN d ELSE d - 15 END AS INTEGER) AS "RoundNumber", 'Day ' || strftime(day, '%Y-%m-%d') AS "EventName", 'Race' AS "SessionName" FROM ev
), n1 AS (
  SELECT *, row_number() OVER (PARTITION BY day, user_id ORDER BY ts, event_id) AS "LapNumber",
         1 + count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY day, user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS "Stint" FROM ev
), n2 AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY day, user_id, "Stint" ORDER BY "LapNumber") AS DOUBLE) AS "TyreLife", row_number() OVER (PARTITION BY day, "LapNumber" ORDER BY ts, event_id) AS "Position" FROM n1
), laps AS (
  SELECT "RaceId", 'U' || user_id AS "Driver", "LapNumber", "Position", "Stint", upper(event_type) AS "Compound", "TyreLife", CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 + 1 AS VARCHAR) AS "TrackStatus",
         CASE WHEN event_id % 17 <> 0 THEN greatest(CAST(round(value * 100) AS BIGINT), 1) END AS lap_cs, CASE WHEN event_id % 17 <> 0 THEN greatest(CAST(round(value * 100) AS BIGINT), 1) / 100 END AS "LapTimeSeconds", event_id FROM n2
), results AS (
  SELECT "RaceId", 'U' || user_id AS "Abbreviation", row_number() OVER (PARTITION BY "RaceId" ORDER BY l DESC, t, e) AS "Position"
  FROM (SELECT "RaceId", user_id, max("LapNumber") AS l, max(ts) AS t, max(event_id) AS e FROM n2 GROUP BY 1, 2)
), raw1 AS (
  SELECT "RaceId",
    CASE WHEN event_id % 101 = 0 THEN '' WHEN event_id % 5 = 0 THEN ' ' || lower("Driver") || ' ' ELSE "Driver" END AS "Driver",
    CASE WHEN event_id % 97 = 0 THEN 'x' WHEN event_id % 89 = 0 THEN '0' WHEN event_id % 83 = 0 THEN '1.5' ELSE CAST("LapNumber" AS VARCHAR) END AS "LapNumber",
    CASE WHEN lap_cs IS NULL THEN NULL WHEN event_id % 53 = 0 THEN 'abc' WHEN event_id % 47 = 0 THEN '00:00:00' ELSE printf('%02d:%02d:%02d.%02d', lap_cs // 360000, lap_cs // 6000 % 60, lap_cs // 100 % 60, lap_cs % 100) END AS "LapTime",
    CASE WHEN event_id % 79 = 0 THEN NULL WHEN event_id % 73 = 0 THEN '0' WHEN event_id % 71 = 0 THEN '2.5' WHEN event_id % 67 = 0 THEN '9999' ELSE CAST("Position" AS VARCHAR) END AS "Position",
    CASE WHEN event_id % 61 = 0 THEN '-1' ELSE CAST("Stint" AS VARCHAR) END AS "Stint",
    CASE WHEN event_id % 43 = 0 THEN '' ELSE ' ' || lower("Compound") END AS "Compound",
    CASE WHEN event_id % 59 = 0 THEN '-2' ELSE CAST(CAST("TyreLife" AS BIGINT) AS VARCHAR) END AS "TyreLife",
    CASE WHEN event_id % 41 = 0 THEN NULL ELSE ' ' || "TrackStatus" END AS "TrackStatus", lap_cs, event_id FROM laps
), laps_raw AS (
  SELECT * FROM raw1 UNION ALL SELECT * FROM raw1 WHERE event_id % 103 = 0
), clean AS (
  SELECT "RaceId", upper(nullif(trim("Driver"), '')) AS "Driver", CASE WHEN n % 1 = 0 THEN CAST(n AS BIGINT) END AS "LapNumber", CASE WHEN p % 1 = 0 THEN CAST(p AS BIGINT) END AS "Position", CAST(s AS BIGINT) AS "Stint",
         upper(nullif(trim("Compound"), '')) AS "Compound", t AS "TyreLife", nullif(trim("TrackStatus"), '') AS "TrackStatus", cs / 100 AS "LapTimeSeconds", event_id
  FROM (SELECT *, TRY_CAST("LapNumber" AS DOUBLE) AS n, TRY_CAST("Position" AS DOUBLE) AS p, TRY_CAST("Stint" AS DOUBLE) AS s, TRY_CAST("TyreLife" AS DOUBLE) AS t, CASE WHEN "LapTime" = '00:00:00' THEN 0 WHEN "LapTime" <> 'abc' THEN lap_cs END AS cs FROM laps_raw)
)"""

#: Replay over a table of laps ``{laps}``, as a range join.
REPLAY_SQL = """
run_{n} AS (
  SELECT *, count(*) FILTER (WHERE lap_cs IS NULL) OVER w AS gaps, sum(lap_cs) OVER w AS s FROM {laps} WINDOW w AS (PARTITION BY "RaceId", "Driver" ORDER BY "LapNumber" ROWS UNBOUNDED PRECEDING)
), spine_{n} AS (
  SELECT DISTINCT "RaceId", "LapNumber" AS "SnapshotLap" FROM {laps} WHERE "Position" = 1
), {n} AS (
  SELECT "RaceId", "SnapshotLap", "Driver", "Position", "LapNumber" AS "CompletedLaps", "SnapshotLap" - "LapNumber" AS "LapsBehindLeader", "Stint", "Compound", "TyreLife", "TrackStatus", lap_cs / 100 AS "LastLapTimeSeconds",
         CASE WHEN gaps = 0 THEN s / 100 END AS "CumulativeLapTimeSeconds", "Position" = 1 AND "SnapshotLap" = "LapNumber" AS "IsLeader", "SnapshotLap" AS "DataAvailableThroughLap"
  FROM (SELECT r.*, "SnapshotLap", row_number() OVER (PARTITION BY r."RaceId", "Driver", "SnapshotLap" ORDER BY "LapNumber" DESC) AS k FROM run_{n} r JOIN spine_{n} p ON r."RaceId" = p."RaceId" AND r."LapNumber" <= p."SnapshotLap") WHERE k = 1
)"""
