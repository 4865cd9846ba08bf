"""Rules for raw laps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapreplay.functions import coerce
from lapreplay.operators.rules import PLACE, STORED, Rule, duplicate_keys, enforce, repeated, violations, with_stored_place
from lapreplay.schemas import LAP_COLUMNS, RACE, LapValidationError


def copies_rule() -> Rule:
    return Rule("duplicate_driver_lap_rows", "error", "a driver has a lap more than once", F.col("_copies"))


def typed(df: DataFrame) -> DataFrame:
    """Adds the numbers (``_number_of_`` a column) and lap times (``_micros``) that ``lap_rules`` asks for: several rules share each, which is read from its text once."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    more = {f"_number_of_{n}": coerce.number(F.col(n), kinds[n]) for n in ("LapNumber", "Position", "Stint", "TyreLife") if n in kinds}
    return df.withColumns(more | ({"_micros": coerce.lap_micros(F.col("LapTime"), kinds["LapTime"])} if "LapTime" in kinds else {}))


def lap_rules(df: DataFrame) -> list[Rule]:
    """Rules for the columns that ``df``, which is ``typed``, has; it needs ``_drivers`` where it has drivers."""
    kinds, c = {f.name: f.dataType for f in df.schema.fields}, F.col
    have = lambda *names: all(n in kinds for n in names)
    blank = lambda n: F.coalesce(coerce.trimmed(c(n)) == "", F.lit(True))
    out = []
    if have("_copies"):
        out.append(copies_rule())
    if have("Driver"):
        out += [
            Rule("missing_driver", "error", "no driver is named", blank("Driver")),
            Rule("driver_whitespace", "warning", "white space surrounds the driver", F.coalesce(c("Driver").cast("string"), F.lit("")) != F.coalesce(coerce.trimmed(c("Driver")), F.lit(""))),
        ]
    if have("LapNumber"):
        n = c("_number_of_LapNumber")
        out += [
            Rule("invalid_lap_number", "error", "the lap number is missing or no number", n.isNull()),
            Rule("non_positive_lap_number", "error", "the lap number is zero or less", n <= 0),
            Rule("fractional_lap_number", "error", "the lap number isn't whole", coerce.fractional(n)),
        ]
    if have("Position"):
        n = c("_number_of_Position")
        out += [
            Rule("missing_position", "warning", "the position is missing or no number", n.isNull()),
            Rule("non_positive_position", "error", "the position is zero or less", n <= 0),
            Rule("fractional_position", "error", "the position isn't whole", coerce.fractional(n)),
        ]
        if have("Driver"):
            out.append(Rule("position_above_driver_count", "error", "the position is above the number of drivers", (c("_drivers") > 0) & (n > c("_drivers"))))
    if have("Stint"):
        n = c("_number_of_Stint")
        out.append(Rule("invalid_stint_number", "error", "the stint isn't a positive whole number", c("Stint").isNotNull() & ((n <= 0) | coerce.fractional(n))))
    if have("TyreLife"):
        out.append(Rule("negative_tyre_life", "error", "the tyre life is below zero", c("_number_of_TyreLife") < 0))
    if have("LapTime"):
        t = c("_micros")
        out += [
            Rule("invalid_lap_time", "error", "the lap time can't be read", c("LapTime").isNotNull() & t.isNull()),
            Rule("missing_lap_time", "warning", "the lap time is missing", c("LapTime").isNull()),
            Rule("non_positive_lap_time", "error", "the lap time is zero or less", t <= 0),
        ]
    out += [Rule(code, "warning", f"{what} is missing", blank(n)) for n, code, what in (("Compound", "missing_tyre_compound", "the compound"), ("TrackStatus", "missing_track_status", "the track status")) if have(n)]
    return out


def validate_laps(laps: DataFrame, race_keys: Sequence[str] = RACE, row_id: str | None = None) -> DataFrame:
    """Broken rules of each race; with ``row_id`` (a column, or STORED for rows read from files) also the first rows that break each.
 An empty table, names used twice and absent columns are reported for the table, under null keys.

    An empty table has no other issue, nor has one with a name used twice; both of those and absent columns affect all rows of
    the table. Rows without race keys are a race of their own. Copies are counted from the keys alone, unless samples of rows
    are asked for.
    """
    whole = laps.agg(F.count(F.lit(1)).alias("affected_rows")).filter("affected_rows > 0")
    note = lambda code, message: whole.select(*table_keys(laps, race_keys), F.lit(code).alias("code"), F.lit("error").alias("severity"), F.lit(message).alias("message"), "affected_rows")
    twice = sorted({x for x in laps.columns if laps.columns.count(x) > 1})
    if twice:
        return note("duplicate_column_names", f"columns appear twice: {', '.join(twice)}").unionByName(empty_table(laps, race_keys))
    missing = [x for x in LAP_COLUMNS if x not in laps.columns]
    if row_id == STORED:
        laps, row_id = with_stored_place(laps), PLACE
    df, key = laps, [*race_keys, "Driver", "LapNumber"]
    keyed = all(k in laps.columns for k in key)
    if "Driver" in df.columns:
        if keyed and row_id is not None:
            df = df.withColumn("_copies", repeated(*key))
        drivers = laps.groupBy(*[F.col(k).alias(f"_of_{k}") for k in race_keys]).agg(F.countDistinct("Driver").alias("_drivers"))
        df = df.join(drivers, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in race_keys]), "left")
    df = typed(df)
    out = violations(df, lap_rules(df), race_keys, row_id).unionByName(empty_table(laps, race_keys), allowMissingColumns=True)
    if keyed and row_id is None:
        rule = copies_rule()
        copies = duplicate_keys(laps, key).groupBy(*race_keys).agg(F.sum("copies").alias("affected_rows"))
        out = out.unionByName(copies.select(*race_keys, *[F.lit(getattr(rule, x)).alias(x) for x in ("code", "severity", "message")], "affected_rows"))
    if missing:
        out = out.unionByName(note("missing_required_columns", f"columns are absent: {', '.join(missing)}"), allowMissingColumns=True)
    return out


def table_keys(laps: DataFrame, race_keys: Sequence[str]) -> list[Column]:
    """Null race keys, of the table's types."""
    kind = lambda k: laps.schema[k].dataType if laps.columns.count(k) == 1 else "string"
    return [F.lit(None).cast(kind(k)).alias(k) for k in race_keys]


def empty_table(laps: DataFrame, race_keys: Sequence[str] = RACE) -> DataFrame:
    """One row under null keys where the whole table is empty; at most one row of each partition is read."""
    any_row = laps.select(F.lit(1).alias("_any")).limit(1).agg(F.count("*").alias("affected_rows")).filter("affected_rows = 0")
    return any_row.select(*table_keys(laps, race_keys), F.lit("empty_lap_table").alias("code"), F.lit("error").alias("severity"), F.lit("there are no laps").alias("message"), "affected_rows")


def column_report(df: DataFrame, needed: Sequence[str], race_keys: Sequence[str] = RACE) -> DataFrame:
    """Of each race with rows: how often each needed column, and each name used twice, is in the table. 1 is right.

    ``require_columns`` raises where this finds anything else.
    """
    names = [*dict.fromkeys([*needed, *(c for c in df.columns if df.columns.count(c) > 1)])]
    cells = F.array(*[F.struct(F.lit(n).alias("column"), F.lit(df.columns.count(n)).alias("copies")) for n in names])
    return df.select(*race_keys).distinct().select(*race_keys, F.inline(cells))


def empty_tables(sessions: DataFrame, laps: DataFrame, race_keys: Sequence[str] = RACE) -> DataFrame:
    """Races of ``sessions`` without a lap."""
    empty = sessions.join(laps.select(*race_keys).distinct(), list(race_keys), "left_anti").select(*race_keys)
    return empty.select(*race_keys, F.lit("empty_lap_table").alias("code"), F.lit("error").alias("severity"), F.lit("the race has no laps").alias("message"), F.lit(0).cast("long").alias("affected_rows"))


def require_valid(laps: DataFrame, race_keys: Sequence[str] = RACE) -> None:
    """Raise where a rule of severity error is broken."""
    enforce(validate_laps(laps, race_keys), LapValidationError)
