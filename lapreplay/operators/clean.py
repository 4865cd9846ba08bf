"""Cleaning of raw laps: text trimmed, numbers and lap times typed, no row dropped."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapreplay.functions import coerce
from lapreplay.operators.rules import Rule, enforce, violations
from lapreplay.operators.validate import validate_laps
from lapreplay.schemas import LAP_COLUMNS, RACE, REPLAY_INPUT, CleaningError, require_columns


class CleanedLaps(NamedTuple):
    """All lazy: cleaned laps, and the issues found before and after."""

    laps: DataFrame
    before: DataFrame
    after: DataFrame


def clean_columns(laps: DataFrame) -> DataFrame:
    """``laps`` with its known columns cleaned and ``LapTimeSeconds`` added. Others stay, and so do all rows."""
    kinds, c = {f.name: f.dataType for f in laps.schema.fields}, F.col
    micros = c("_micros")
    return laps.withColumn("_micros", coerce.lap_micros(c("LapTime"), kinds["LapTime"])).withColumns({
        "Driver": coerce.text(c("Driver"), upper=True), "Compound": coerce.text(c("Compound"), upper=True), "TrackStatus": coerce.text(c("TrackStatus")),
        **{n: coerce.whole(c(n), kinds[n]) for n in ("LapNumber", "Position", "Stint")},
        "TyreLife": coerce.number(c("TyreLife"), kinds["TyreLife"]), "LapTime": coerce.interval(micros), "LapTimeSeconds": coerce.seconds(micros),
    }).drop("_micros")


def lost_cells(laps: DataFrame, race_keys: Sequence[str] = RACE) -> DataFrame:
    """Cells that cleaning can't type: fractions and lap times that can't be read."""
    kinds, c = {f.name: f.dataType for f in laps.schema.fields}, F.col
    rules = [Rule(f"fractional_{n}", "error", f"{n} isn't whole", coerce.fractional(coerce.number(c(n), kinds[n]))) for n in ("LapNumber", "Position", "Stint")]
    rules.append(Rule("unreadable_LapTime", "error", "the lap time can't be read", c("LapTime").isNotNull() & coerce.lap_micros(c("LapTime"), kinds["LapTime"]).isNull()))
    return violations(laps, rules, race_keys)


def clean_laps(laps: DataFrame, race_keys: Sequence[str] = RACE, fail_on_input_errors: bool = True) -> CleanedLaps:
    """Clean the laps of all races. Strict: raise on errors in the raw laps, else only on cells that can't be typed."""
    require_columns(laps, [*race_keys, *LAP_COLUMNS], CleaningError, "lap table")
    before = validate_laps(laps, race_keys)
    enforce(before if fail_on_input_errors else lost_cells(laps, race_keys), CleaningError)
    cleaned = clean_columns(laps)
    return CleanedLaps(cleaned, before, validate_laps(cleaned, race_keys))


def select_standardized(laps: DataFrame, race_keys: Sequence[str] = RACE) -> DataFrame:
    """The eight columns that replay needs, in their order, after the race keys."""
    require_columns(laps, REPLAY_INPUT, CleaningError, "lap table")
    return laps.select(*race_keys, *REPLAY_INPUT)
