"""Winner labels: from final results to replay rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapreplay.functions import coerce
from lapreplay.operators.replay import one_each
from lapreplay.operators.rules import Rule, enforce, repeated, violations
from lapreplay.schemas import DRIVER_NAMES, RACE, TARGET, TargetError, require_columns


def driver_column(results: DataFrame) -> str:
    """The first of the names that results may have for drivers."""
    for name in DRIVER_NAMES:
        if name in results.columns:
            return name
    raise TargetError(f"the results have none of {', '.join(DRIVER_NAMES)}")


def prepared_results(results: DataFrame, race_keys: Sequence[str] = RACE) -> DataFrame:
    require_columns(results, [*race_keys, "Position"], TargetError, "result table")
    name = driver_column(results)
    return results.select(*race_keys, coerce.text(F.col(name), upper=True).alias("Driver"), F.col("Position").alias("_raw"), coerce.number(F.col("Position")).alias("_n"), coerce.whole(F.col("Position")).alias("FinalPosition"))


def result_rules(results: DataFrame) -> list[Rule]:
    """Rules that each row of results must keep: a driver and a positive whole position."""
    n = coerce.number(F.col("Position"))
    return [
        Rule("missing_driver", "error", "no driver is named", coerce.text(F.col(driver_column(results))).isNull()),
        Rule("missing_position", "error", "the final position is missing or no number", n.isNull()),
        Rule("non_positive_position", "error", "the final position is zero or less", n <= 0),
        Rule("fractional_position", "error", "the final position isn't whole", coerce.fractional(n)),
    ]


def check_results(results: DataFrame, race_keys: Sequence[str] = RACE) -> DataFrame:
    """Broken rules of results: every driver once with a positive whole position, one winner a race."""
    df = prepared_results(results, race_keys)
    marked = results.withColumn("_driver", coerce.text(F.col(driver_column(results)), upper=True)).withColumn("_copies", repeated(*race_keys, "_driver"))
    again = Rule("duplicate_driver", "error", "a driver is classified more than once", F.col("_driver").isNotNull() & F.col("_copies"))
    c = F.col
    return violations(marked, [*result_rules(results), again], race_keys).unionByName(winners(df, c("FinalPosition") == 1, race_keys))


def winners(df: DataFrame, flag, race_keys: Sequence[str] = RACE) -> DataFrame:
    """Races that haven't exactly one row with ``flag``."""
    per = df.groupBy(*race_keys).agg(F.count_if(flag).alias("_n"))
    return violations(per, [Rule("winner_count", "error", "there isn't exactly one winner", F.col("_n") != 1)], race_keys)


def build_winner_targets(results: DataFrame, race_keys: Sequence[str] = RACE, check: bool = True) -> DataFrame:
    """Whether each driver won."""
    df = prepared_results(results, race_keys)
    if check:
        if results.isEmpty():
            raise TargetError("the result table is empty")
        enforce(check_results(results, race_keys), TargetError)
    return df.select(*race_keys, "Driver", (F.col("FinalPosition") == 1).alias(TARGET))


def sort_targets(results: DataFrame, race_keys: Sequence[str] = RACE) -> DataFrame:
    """Labels in the order of the final positions, then drivers."""
    df = prepared_results(results, race_keys).orderBy(*race_keys, "FinalPosition", "Driver")
    return df.select(*race_keys, "Driver", (F.col("FinalPosition") == 1).alias(TARGET))


def check_targets(targets: DataFrame, race_keys: Sequence[str] = RACE) -> DataFrame:
    """Broken rules of labels: none unknown, every driver once, one winner a race."""
    require_columns(targets, [*race_keys, "Driver", TARGET], TargetError, "target table")
    if not isinstance(targets.schema[TARGET].dataType, T.BooleanType):
        raise TargetError(f"{TARGET} must be boolean")
    df = targets.withColumn("Driver", coerce.text(F.col("Driver"), upper=True)).withColumn("_copies", repeated(*race_keys, "Driver"))
    rules = [
        Rule("missing_driver", "error", "no driver is named", F.col("Driver").isNull()),
        Rule("missing_target", "error", "the label is missing", F.col(TARGET).isNull()),
        Rule("duplicate_driver", "error", "a driver has more than one label", F.col("Driver").isNotNull() & F.col("_copies")),
    ]
    return violations(df, rules, race_keys).unionByName(winners(df, F.col(TARGET), race_keys))


def missing_targets(replay: DataFrame, targets: DataFrame, race_keys: Sequence[str] = RACE) -> DataFrame:
    """Drivers of a replay without a label."""
    named = lambda df: df.select(*race_keys, coerce.text(F.col("Driver"), upper=True).alias("Driver"))
    return named(replay).distinct().join(named(targets), [*race_keys, "Driver"], "left_anti")


def match_completeness(labelled: DataFrame, race_keys: Sequence[str] = RACE) -> DataFrame:
    """Rows and unlabelled rows of each race."""
    return labelled.groupBy(*race_keys).agg(F.count("*").alias("row_count"), F.count_if(F.col(TARGET).isNull()).alias("unmatched"))


def winner_count_check(labelled: DataFrame, race_keys: Sequence[str] = RACE) -> DataFrame:
    """Races with snapshots that haven't exactly one winner."""
    return one_each(labelled, TARGET, "snapshot_winner_count", "snapshots haven't exactly one winner", race_keys)


def attach_winner_targets(replay: DataFrame, targets: DataFrame, race_keys: Sequence[str] = RACE, check: bool = True) -> DataFrame:
    """The replay with each driver's label. Labels of drivers who never finished a lap are legal."""
    require_columns(replay, [*race_keys, "SnapshotLap", "Driver"], TargetError, "replay table")
    if TARGET in replay.columns:
        raise TargetError(f"the replay has {TARGET} already")
    if check:
        for df, what in ((replay, "replay"), (targets, "target")):
            if df.isEmpty():
                raise TargetError(f"the {what} table is empty")
        enforce(check_targets(targets, race_keys), TargetError)
        lost = missing_targets(replay, targets, race_keys).limit(5).collect()
        if lost:
            raise TargetError(f"drivers without a label: {', '.join(str(r['Driver']) for r in lost)}")
    labels = targets.select(*race_keys, coerce.text(F.col("Driver"), upper=True).alias("Driver"), TARGET)
    out = replay.withColumn("Driver", coerce.text(F.col("Driver"), upper=True)).join(labels, [*race_keys, "Driver"], "left").select(*replay.columns, TARGET)
    if check:
        if not out.filter(F.col("SnapshotLap").isNull()).isEmpty():
            raise TargetError("a snapshot lap is missing")
        enforce(winner_count_check(out, race_keys), TargetError)
    return out
