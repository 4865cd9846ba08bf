"""Profiles of tables: rows, columns, types and missing cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapreplay.functions import coerce
from lapreplay.operators.rules import enforce
from lapreplay.operators.validate import empty_tables
from lapreplay.schemas import LAP_COLUMNS, RACE, RaceDataError, require_columns


def table_profile(df: DataFrame, name: str, race_keys: Sequence[str] = RACE) -> DataFrame:
    """A row per race and column: the column's type, the race's rows and its missing cells (null or NaN), in one pass."""
    fields = [f for f in df.schema.fields if f.name not in race_keys]
    missing = lambda f: F.col(f.name).isNull() | (F.isnan(f.name) if f.dataType.typeName() in ("float", "double") else F.lit(False))
    counts = df.groupBy(*race_keys).agg(F.count("*").alias("rows"), *[F.count_if(missing(f)).alias(f"_m{i}") for i, f in enumerate(fields)])
    cells = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"), F.col(f"_m{i}").alias("missing_values")) for i, f in enumerate(fields)]
    return counts.select(*race_keys, F.lit(name).alias("table"), "rows", F.inline(F.array(*cells)))


def race_inventory(sessions: DataFrame, tables: Mapping[str, DataFrame | None], race_keys: Sequence[str] = RACE, check: bool = True) -> DataFrame:
    """Profiles of all tables of each race beside its metadata. An absent table is None; laps must be there."""
    laps = tables.get("laps")
    if laps is None:
        raise RaceDataError("there is no lap table")
    if check:
        require_columns(laps, [c for c in LAP_COLUMNS if c != "Stint"], RaceDataError, "lap table")
        enforce(empty_tables(sessions, laps, race_keys), RaceDataError)
    out = None
    for name, df in tables.items():
        if df is None:
            row = sessions.select(*race_keys, F.lit(name).alias("table"), F.lit(False).alias("available"), F.lit(0).cast("long").alias("rows"), F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("dtype"), F.lit(None).cast("long").alias("missing_values"))
        else:
            row = table_profile(df, name, race_keys).withColumn("available", F.lit(True))
        out = row if out is None else out.unionByName(row)
    return out.join(sessions, list(race_keys))


def season_of(event_date):
    """Year of an event's date, null where it can't be read."""
    return F.year(F.try_to_timestamp(event_date.cast("string")))


def event_slug(name, empty: str = "unknown_event"):
    return coerce.slug(name, empty)
