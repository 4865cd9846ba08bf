"""Replay: what was known of each driver when the leader had finished lap N.

The as-of join is a merge. One grouped pass gathers each race's drivers and leader laps; every driver then has its own rows
and a row for each leader lap in one stream, sorted by lap, in which the latest row and the running totals are
carried forward. Laps are shuffled once, by race and driver; leader laps are expanded after that shuffle, so the work is linear in the
output, however far apart the laps are, and no race has to fit into one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapreplay.functions import coerce
from lapreplay.operators.rules import Rule, repeated, violations
from lapreplay.schemas import RACE, REPLAY, REPLAY_INPUT, ReplayError, positive_int, require_columns
from lapreplay.sources.staging import Checks


def prepared_laps(laps: DataFrame, race_keys: Sequence[str] = RACE) -> DataFrame:
    """The columns of a replay, typed. Cells that break a rule may become null: see ``input_rules``."""
    c, kinds = F.col, {f.name: f.dataType for f in laps.schema.fields}
    return laps.select(
        *race_keys, coerce.text(c("Driver"), upper=True).alias("Driver"), coerce.whole(c("LapNumber"), kinds["LapNumber"]).alias("LapNumber"), coerce.whole(c("Position"), kinds["Position"]).alias("Position"),
        coerce.whole(c("Stint"), kinds["Stint"]).alias("Stint"), coerce.text(c("Compound"), upper=True).alias("Compound"), coerce.number(c("TyreLife"), kinds["TyreLife"]).alias("TyreLife"),
        coerce.text(c("TrackStatus")).alias("TrackStatus"), coerce.number(c("LapTimeSeconds"), kinds["LapTimeSeconds"]).alias("LapTimeSeconds"),
    )


def input_rules(laps: DataFrame, race_keys: Sequence[str] = RACE) -> list[Rule]:
    """Rules that each row of a replay's laps must keep."""
    c, rules, kinds = F.col, [], {f.name: f.dataType for f in laps.schema.fields}
    for n, required in (("LapNumber", True), ("Position", False), ("Stint", False)):
        x = coerce.number(c(n), kinds[n])
        rules.append(Rule(f"non_numeric_{n}", "error", f"{n} isn't a number", c(n).isNotNull() & ~_nan(laps, n) & x.isNull()))
        if required:
            rules.append(Rule(f"missing_{n}", "error", f"{n} is missing", c(n).isNull() | _nan(laps, n)))
        rules += [Rule(f"non_positive_{n}", "error", f"{n} is zero or less", x <= 0), Rule(f"fractional_{n}", "error", f"{n} isn't whole", coerce.fractional(x))]
    for n in ("TyreLife", "LapTimeSeconds"):
        rules.append(Rule(f"non_numeric_{n}", "error", f"{n} isn't a number", c(n).isNotNull() & ~_nan(laps, n) & coerce.number(c(n), kinds[n]).isNull()))
    driver = coerce.text(c("Driver"), upper=True)
    rules += [
        Rule("missing_Driver", "error", "no driver is named", driver.isNull()),
        Rule("negative_TyreLife", "error", "TyreLife is below zero", coerce.number(c("TyreLife"), kinds["TyreLife"]) < 0),
        Rule("non_positive_LapTimeSeconds", "error", "LapTimeSeconds is zero or less", coerce.number(c("LapTimeSeconds"), kinds["LapTimeSeconds"]) <= 0),
        *[Rule(f"missing_{k}", "error", f"{k} is missing", c(k).isNull()) for k in race_keys],
    ]
    return rules


def check_input(laps: DataFrame, race_keys: Sequence[str] = RACE, row_id: str | None = None) -> DataFrame:
    """Rules that the laps of a replay must keep, broken ones per race."""
    kinds = {f.name: f.dataType for f in laps.schema.fields}
    key = {"_driver": coerce.text(F.col("Driver"), upper=True), "_lap": coerce.whole(F.col("LapNumber"), kinds["LapNumber"])}
    marked = laps.withColumns(key).withColumn("_copies", repeated(*race_keys, "_driver", "_lap"))
    again = Rule("duplicate_driver_lap", "error", "a driver has a lap more than once", F.col("_copies"))
    return violations(marked, [*input_rules(laps, race_keys), again], race_keys, row_id)


def _nan(df: DataFrame, name: str) -> Column:
    """NaN is a missing cell, not a text that isn't a number."""
    kind = df.schema[name].dataType.typeName()
    return F.isnan(F.col(name)) if kind in ("float", "double") else F.coalesce(F.lower(coerce.trimmed(F.col(name))) == "nan", F.lit(False))


def running(laps: DataFrame, race_keys: Sequence[str] = RACE) -> DataFrame:
    """Adds missing lap times so far, the sum of lap times (null after a gap), and the driver's next lap."""
    w = Window.partitionBy(*race_keys, "Driver").orderBy("LapNumber")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = laps.withColumns({"MissingLapTimes": F.count_if(F.col("LapTimeSeconds").isNull()).over(so_far), "_sum": F.sum("LapTimeSeconds").over(so_far), "NextLap": F.lead("LapNumber").over(w)})
    return out.withColumn("CumulativeLapTimeSeconds", F.when(F.col("MissingLapTimes") == 0, F.col("_sum"))).drop("_sum")


def leads(start_lap: int = 1, end_lap: int | None = None) -> Column:
    """Whether a row is a leader's, of a lap within the range."""
    positive_int(start_lap, "start_lap", ReplayError)
    if end_lap is not None and positive_int(end_lap, "end_lap", ReplayError) < start_lap:
        raise ReplayError("end_lap is before start_lap")
    out = (F.col("Position") == 1) & F.col("LapNumber").isNotNull() & (F.col("LapNumber") >= start_lap)
    return out if end_lap is None else out & (F.col("LapNumber") <= end_lap)


def snapshot_spine(laps: DataFrame, race_keys: Sequence[str] = RACE, start_lap: int = 1, end_lap: int | None = None) -> DataFrame:
    """The laps that a leader finished, within the range."""
    return laps.filter(leads(start_lap, end_lap)).select(*race_keys, F.col("LapNumber").alias("SnapshotLap")).distinct()


def snapshot_asof_join(laps: DataFrame, spine: DataFrame, race_keys: Sequence[str] = RACE) -> DataFrame:
    """For each snapshot lap and driver the latest row at or before it. Drivers without one are absent."""
    mine = laps.select(*race_keys, F.struct("Driver").alias("_driver"), F.lit(None).cast("long").alias("_snapshot"))
    both = mine.unionByName(spine.select(*race_keys, F.lit(None).cast(mine.schema["_driver"].dataType).alias("_driver"), F.col("SnapshotLap").cast("long").alias("_snapshot")))
    races = both.groupBy(*race_keys).agg(F.collect_set("_driver").alias("_drivers"), F.collect_set("_snapshot").alias("_spine"))
    return latest(merged(laps, races, race_keys))


def race_spines(laps: DataFrame, race_keys: Sequence[str] = RACE, start_lap: int = 1, end_lap: int | None = None) -> DataFrame:
    """Of each race its drivers, its leader laps in the range, and how many rows lead (``_leaders``): one grouped pass, combined before its shuffle."""
    lead = leads(start_lap, end_lap)
    rows = laps.select(*race_keys, F.struct("Driver").alias("_driver"), F.when(lead, F.col("LapNumber")).cast("long").alias("_snapshot"))
    return rows.groupBy(*race_keys).agg(F.collect_set("_driver").alias("_drivers"), F.collect_set("_snapshot").alias("_spine"), F.count("_snapshot").alias("_leaders"))


#: Kinds of rows in a merged stream, in their order at one lap.
LABEL, LAP, SNAPSHOT = 0, 1, 2


def merged(laps: DataFrame, races: DataFrame, race_keys: Sequence[str] = RACE, carried: Sequence[str] = (), labels: DataFrame | None = None) -> DataFrame:
    """The sorted stream of each driver: ``_kind``, ``_at`` (a lap), ``_lap`` (the lap row), ``_label`` and the race's ``carried`` columns on snapshot rows.

    ``_last``: the latest lap row so far; ``_told``: the label, of which ``labels`` has the driver's; ``_again``: whether the row
    before is of the same kind and lap. Rows without a race are left out.

    Spark would size the tasks by what is shuffled, which leaves out the expanded snapshots: all shuffle partitions are kept.
    """
    parts = int(laps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = {c: races.schema[c].dataType for c in carried}
    here = reduce(and_, [F.col(k).isNotNull() for k in race_keys])
    cells = F.struct(*[c for c in laps.columns if c not in (*race_keys, "Driver")]).alias("_lap")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    empty = [none("array<long>", "_spine"), *[none(k, c) for c, k in kinds.items()]]
    rows = laps.filter(here).select(*race_keys, "Driver", F.lit(LAP).alias("_kind"), cells, none("boolean", "_label"), *empty)
    asks = races.filter(here).select(*race_keys, F.explode("_drivers").alias("_d"), "_spine", *carried)
    rows = rows.unionByName(asks.select(*race_keys, "_d.Driver", F.lit(SNAPSHOT).alias("_kind"), none(rows.schema["_lap"].dataType, "_lap"), none("boolean", "_label"), "_spine", *carried))
    if labels is not None:
        rows = rows.unionByName(labels.filter(here).select(*race_keys, "Driver", F.lit(LABEL).alias("_kind"), none(rows.schema["_lap"].dataType, "_lap"), F.col("_label"), *empty))
    rows = rows.repartition(parts, *race_keys, "Driver").withColumn("_snapshot", F.explode_outer("_spine")).drop("_spine").filter((F.col("_kind") != SNAPSHOT) | F.col("_snapshot").isNotNull())
    rows = rows.withColumn("_at", F.coalesce("_snapshot", F.col("_lap.LapNumber").cast("long")))
    w = Window.partitionBy(*race_keys, "Driver").orderBy(F.col("_at").asc_nulls_first(), "_kind")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({
        "_last": F.last(F.when(F.col("_lap.LapNumber").isNotNull(), F.col("_lap")), ignorenulls=True).over(so_far), "_told": F.max("_label").over(so_far),
        "_missing": F.count_if((F.col("_kind") == LAP) & F.col("_lap")["LapTimeSeconds"].isNull()).over(so_far) if "LapTimeSeconds" in laps.columns else F.lit(0).cast("long"),
        "_sum": F.sum("_lap.LapTimeSeconds").over(so_far) if "LapTimeSeconds" in laps.columns else F.lit(None).cast("double"),
        "_again": (F.lag("_kind").over(w) == F.col("_kind")) & F.lag("_at").over(w).eqNullSafe(F.col("_at")),
    })


def latest(stream: DataFrame) -> DataFrame:
    """The stream's snapshot rows of drivers who are on track, with the columns of their latest laps."""
    own = [c for c in stream.columns if not c.startswith("_")]
    return stream.filter((F.col("_kind") == SNAPSHOT) & F.col("_last").isNotNull()).select(*own, "_last.*", F.col("_snapshot").alias("SnapshotLap"))


def snapshot_cells(race_keys: Sequence[str] = RACE) -> list[Column | str]:
    """The columns of a replay, of a snapshot beside the lap row that holds at it."""
    behind = F.col("SnapshotLap") - F.col("LapNumber")
    return [
        *race_keys, "SnapshotLap", "Driver", "Position", F.col("LapNumber").alias("CompletedLaps"), behind.alias("LapsBehindLeader"), "Stint", "Compound", "TyreLife", "TrackStatus",
        F.col("LapTimeSeconds").alias("LastLapTimeSeconds"), "CumulativeLapTimeSeconds", ((F.col("Position") == 1) & (behind == 0)).alias("IsLeader"), F.col("SnapshotLap").alias("DataAvailableThroughLap"),
    ]


def row_rules() -> list[Rule]:
    """Rules that each row of a replay must keep. Unknown laps don't break the cutoff or the deficit."""
    c = F.col
    return [
        Rule("completed_beyond_snapshot", "error", "a driver has more laps than the snapshot", c("CompletedLaps") > c("SnapshotLap")),
        Rule("negative_deficit", "error", "a driver is ahead of the leader", c("LapsBehindLeader") < 0),
        Rule("availability_mismatch", "error", "the availability isn't the snapshot's lap", F.coalesce(c("DataAvailableThroughLap") != c("SnapshotLap"), F.lit(True))),
    ]


def check_replay(replay: DataFrame, race_keys: Sequence[str] = RACE) -> DataFrame:
    """Rules that a replay must keep, broken ones per race."""
    again = Rule("duplicate_snapshot_driver", "error", "a driver is in a snapshot more than once", F.col("_copies"))
    rows = violations(replay.withColumn("_copies", repeated(*race_keys, "SnapshotLap", "Driver")), [again, *row_rules()], race_keys)
    return rows.unionByName(leader_count_check(replay, race_keys))


def leader_count_check(replay: DataFrame, race_keys: Sequence[str] = RACE) -> DataFrame:
    """Races with snapshots that haven't exactly one leader."""
    return one_each(replay, "IsLeader", "leader_count", "snapshots haven't exactly one leader", race_keys)


def one_each(df: DataFrame, flag: str, code: str, message: str, race_keys: Sequence[str] = RACE) -> DataFrame:
    """Races in which some snapshot hasn't exactly one row with a true ``flag``."""
    per = df.groupBy(*race_keys, "SnapshotLap").agg(F.count_if(flag).alias("_n"))
    return violations(per, [Rule(code, "error", message, F.col("_n") != 1)], race_keys)


def replay_rows(stream: DataFrame, race_keys: Sequence[str] = RACE, more: Sequence[str] = ()) -> DataFrame:
    """The replay of a merged stream."""
    rows = stream.filter((F.col("_kind") == SNAPSHOT) & F.col("_last").isNotNull()).select(
        *race_keys, "Driver", "_last.*", F.col("_snapshot").alias("SnapshotLap"), F.when(F.col("_missing") == 0, F.col("_sum")).alias("CumulativeLapTimeSeconds"), *more)
    return rows.select(*snapshot_cells(race_keys), *more)


def watched_laps(checks: Checks, laps: DataFrame, race_keys: Sequence[str] = RACE) -> DataFrame:
    return checks.watch(laps, [(r.code, r.message, r.breaks) for r in input_rules(laps, race_keys)], ReplayError, "the lap table is empty")


def watched_races(checks: Checks, races: DataFrame) -> DataFrame:
    """A race has one leader a snapshot where no more rows lead than there are leader laps, and one at least."""
    none = F.size("_spine") == 0
    return checks.watch(races, [("no_leader", "no leader lap is in the range", none & (F.size("_drivers") > 0)), ("leader_count", "snapshots haven't exactly one leader", F.col("_leaders") != F.size("_spine"))], ReplayError)


def watched_stream(checks: Checks, stream: DataFrame) -> DataFrame:
    return checks.watch(stream, [
        ("duplicate_driver_lap", "a driver has a lap more than once", F.col("_again") & (F.col("_kind") == LAP)), ("duplicate_snapshot_driver", "a driver is in a snapshot more than once", F.col("_again") & (F.col("_kind") == SNAPSHOT)),
    ], ReplayError)


def build_race_replay(laps: DataFrame, race_keys: Sequence[str] = RACE, start_lap: int = 1, end_lap: int | None = None, check: bool = True) -> DataFrame:
    """One row per race, leader lap and driver. Without ``check`` the plan is lazy.

    ``check`` runs it once, into a draft in the shared folder, and raises on broken rules of the laps or the result.
    """
    require_columns(laps, [*race_keys, *REPLAY_INPUT], ReplayError, "lap table")
    ready = prepared_laps(laps, race_keys)
    races = race_spines(ready, race_keys, start_lap, end_lap)
    if not check:
        return replay_rows(merged(ready, races, race_keys), race_keys)
    checks = Checks()
    ready = prepared_laps(watched_laps(checks, laps, race_keys), race_keys)
    races = watched_races(checks, races)
    replay = replay_rows(watched_stream(checks, merged(ready, races, race_keys)), race_keys)
    replay = checks.watch(replay, [(r.code, r.message, r.breaks) for r in row_rules()], ReplayError)
    return checks.staged(replay, "replay")


def sort_replay(replay: DataFrame, race_keys: Sequence[str] = RACE) -> DataFrame:
    """Order for reading: race, snapshot, position with unknown ones last, driver."""
    return replay.orderBy(*race_keys, "SnapshotLap", F.col("Position").asc_nulls_last(), "Driver")


def select_snapshot(replay: DataFrame, snapshot_lap: int, check: bool = True) -> DataFrame:
    """Rows of one snapshot lap, of all races."""
    positive_int(snapshot_lap, "snapshot_lap", ReplayError)
    require_columns(replay, REPLAY, ReplayError, "replay table")
    out = replay.filter(F.col("SnapshotLap") == snapshot_lap)
    if check and out.isEmpty():
        raise ReplayError(f"there is no snapshot of lap {snapshot_lap}")
    return out
