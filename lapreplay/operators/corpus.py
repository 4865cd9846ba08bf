"""Corpora: datasets of many races as one table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapreplay.functions import coerce
from lapreplay.operators.dataset import check_dataset, require_schema
from lapreplay.operators.rules import enforce
from lapreplay.schemas import DATASET, TARGET, CorpusError

ORDER = ("Season", "RoundNumber", "SnapshotLap")


def schema_differences(a: DataFrame, b: DataFrame) -> list[str]:
    """Where the columns of ``b`` differ from those of ``a`` in name, order or type."""
    pairs = lambda df: [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    x, y = pairs(a), pairs(b)
    if len(x) != len(y):
        return [f"{len(x)} and {len(y)} columns"]
    return [f"{p[0]} {p[1]} and {q[0]} {q[1]}" for p, q in zip(x, y, strict=True) if p != q]


def duplicate_races(datasets: Sequence[DataFrame]) -> DataFrame:
    """Races that several of the datasets hold."""
    named = [d.select("RaceId").distinct().withColumn("_source", F.lit(i)) for i, d in enumerate(datasets)]
    return reduce(DataFrame.unionByName, named).groupBy("RaceId").agg(F.count("*").alias("sources")).filter("sources > 1")


def season_round_uniqueness(corpus: DataFrame) -> DataFrame:
    """Rounds that more than one race claims."""
    pairs = corpus.select("Season", "RoundNumber", "RaceId").distinct()
    return pairs.groupBy("Season", "RoundNumber").agg(F.count("RaceId").alias("races"), F.concat_ws(",", F.sort_array(F.collect_set("RaceId"))).alias("race_ids")).filter("races > 1")


def check_corpus(corpus: DataFrame) -> DataFrame:
    """Broken rules of all races at once, in grouped passes."""
    rounds = season_round_uniqueness(corpus)
    clash = rounds.select(F.col("race_ids").alias("RaceId"), F.lit("season_round_collision").alias("code"), F.lit("error").alias("severity"), F.lit("races share a round").alias("message"), F.col("races").alias("affected_rows"))
    return check_dataset(corpus).unionByName(clash)


def validate_race_corpus(corpus: DataFrame) -> None:
    """Raise where a corpus breaks its contract."""
    require_schema(corpus)
    if corpus.isEmpty():
        raise CorpusError("the corpus is empty")
    for name in ("Season", "RoundNumber"):
        if corpus.schema[name].dataType.typeName() not in ("byte", "short", "integer", "long"):
            raise CorpusError(f"{name} must be an integer")
    if corpus.filter(coerce.text(F.col("RaceId")).isNotNull()).isEmpty():
        raise CorpusError("no race is named")
    enforce(check_corpus(corpus), CorpusError)


def combine_race_datasets(datasets: Sequence[DataFrame], check: bool = True) -> DataFrame:
    """One corpus of the datasets, in ranges of its order that are sorted within.

    All must have the contract's columns in its order and equal types. No race may be in two of them.
    """
    if not datasets:
        raise CorpusError("there are no datasets")
    for d in datasets:
        if tuple(d.columns) != DATASET:
            raise CorpusError("a dataset's columns aren't the contract's, in its order")
        if differences := schema_differences(datasets[0], d):
            raise CorpusError(f"datasets differ: {'; '.join(differences)}")
    if check and (twice := duplicate_races(datasets).limit(5).collect()):
        raise CorpusError(f"races given more than once: {', '.join(r['RaceId'] for r in twice)}")
    corpus = reduce(DataFrame.union, datasets)
    if check:
        validate_race_corpus(corpus)
    return sorted_for_storage(corpus)


def storage_order() -> list[Column]:
    return [F.col(c) for c in ORDER] + [F.col("Position").asc_nulls_last(), F.col("Driver")]


def sorted_for_storage(corpus: DataFrame) -> DataFrame:
    """The order of ``sort_corpus`` in ranges of the whole key, whose bounds Spark samples: a round or snapshot with most rows has several.

    Files written from it are in order, one after the other. There are as many ranges as shuffle partitions: sorted rows shrink so
    much in a shuffle that ranges merged by what they shuffle would be large in memory.
    """
    return corpus.repartitionByRange(int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")), *storage_order()).sortWithinPartitions(*storage_order())


#: Rows of a stored range.
RANGE_ROWS = 1 << 18


def storage_bounds(corpus: DataFrame, size: int = RANGE_ROWS) -> DataFrame:
    """Of each race the number of its first range (``_first``) and the keys where its next ones begin (``_bounds``), one for every ``size`` rows.

    The bounds are quantiles of those keys whose hashes are multiples of a number, some 256 a range: equal corpora have equal ranges,
    however their rows are dealt, which bounds that Spark samples have not.
    """
    c, race = F.col, ["Season", "RoundNumber"]
    races = corpus.groupBy(*race).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(*race).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each race
    races = races.withColumn("_first", F.floor(before / size)).withColumn("_cuts", F.floor(c("_n") / size))
    some = corpus.filter(F.pmod(F.xxhash64(*ORDER, "Position", "Driver"), F.lit(max(1, size // 256))) == 0).select(*race, storage_key().alias("_key"))
    by = Window.partitionBy(*race)
    some = some.withColumns({"_i": F.row_number().over(by.orderBy("_key")), "_m": F.count("*").over(by)})
    same = lambda a, b: (a["Season"].eqNullSafe(b["Season"])) & (a["RoundNumber"].eqNullSafe(b["RoundNumber"]))
    cut = lambda i: F.floor(i * (c("_cuts") + 1) / c("_m"))
    cuts = races.filter("_cuts > 0").select(c("Season").alias("_s"), c("RoundNumber").alias("_r"), "_cuts")
    some = some.join(cuts, some["Season"].eqNullSafe(cuts["_s"]) & some["RoundNumber"].eqNullSafe(cuts["_r"])).filter((cut(c("_i")) > cut(c("_i") - 1)) & (c("_i") < c("_m")))
    bounds = some.groupBy(*race).agg(F.sort_array(F.collect_list("_key")).alias("_bounds"))
    return races.join(bounds, same(races, bounds), "left").select(races["Season"].alias("_s"), races["RoundNumber"].alias("_r"), "_first", "_bounds")


def storage_key() -> Column:
    """The order within a race as one value."""
    return F.struct("SnapshotLap", F.col("Position").isNull().alias("unplaced"), "Position", "Driver")


def in_ranges(corpus: DataFrame, bounds: DataFrame, rows: int, size: int = RANGE_ROWS) -> DataFrame:
    """The ``rows`` of a corpus in the ranges of ``storage_bounds``, a task each: in order from range to range, not sorted within."""
    here = F.col("_s").eqNullSafe(F.col("Season")) & F.col("_r").eqNullSafe(F.col("RoundNumber"))
    at = corpus.join(bounds, here).withColumn("_key", storage_key())
    later = F.coalesce(F.size(F.filter("_bounds", lambda b: b <= F.col("_key"))), F.lit(0))
    place = (F.col("_first") + F.when(F.col("_bounds").isNotNull(), later).otherwise(0)).cast("int")
    return at.repartitionById(rows // size + 1, place).select(*corpus.columns)


def sort_corpus(corpus: DataFrame) -> DataFrame:
    return corpus.orderBy(*storage_order())


def corpus_summary(corpus: DataFrame) -> DataFrame:
    """One row: races, seasons, rows, snapshots, drivers, first and last race. Counts are exact.

    One pass groups rows by snapshot and one by driver, both before their shuffle; all else is counted from the snapshots.
    """
    place = F.struct("Season", "RoundNumber", "RaceId")
    snapshots = corpus.groupBy("RaceId", "Season", "RoundNumber", "SnapshotLap").agg(F.count("*").alias("n"))
    races = snapshots.groupBy("RaceId", "Season", "RoundNumber").agg(F.sum("n").alias("n"), F.count("SnapshotLap").alias("s"))
    whole = races.agg(
        F.countDistinct("RaceId").alias("race_count"), F.countDistinct("Season").alias("season_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum("s"), F.lit(0)).alias("snapshot_count"),
        F.min_by("RaceId", place).alias("first_race_id"), F.max_by("RaceId", place).alias("last_race_id"),
    )
    drivers = corpus.groupBy("Driver").agg(F.lit(1).alias("one")).agg(F.count("Driver").alias("driver_count"))
    names = ("race_count", "season_count", "row_count", "snapshot_count", "driver_count", "first_race_id", "last_race_id")
    return whole.unionByName(drivers, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in names])


def summary_parts(corpus: DataFrame) -> DataFrame:
    """What each race adds to a summary: rows, snapshots and its set of drivers. Parts of races that are stored apart merge by ``merged_summary``.

    The first and last snapshot and the winners' rows are for its manifest. Rows are grouped by snapshot and by driver, both before their shuffle.
    """
    race = ("RaceId", "Season", "RoundNumber")
    snapshots = corpus.groupBy(*race, "SnapshotLap").agg(F.count("*").alias("n"), F.count_if(TARGET).alias("w"))
    races = snapshots.groupBy(*race).agg(
        F.sum("n").alias("rows"), F.count("SnapshotLap").alias("snapshots"), F.min("SnapshotLap").alias("first_snapshot"), F.max("SnapshotLap").alias("last_snapshot"), F.sum("w").alias("winner_rows"),
    )
    drivers = corpus.select(*race, "Driver").distinct().groupBy(*race).agg(F.collect_list("Driver").alias("drivers"))
    numbers = [c for c in races.columns if c not in race]
    return races.unionByName(drivers, allowMissingColumns=True).groupBy(*race).agg(*[F.max(c).alias(c) for c in numbers], F.first("drivers", ignorenulls=True).alias("drivers"))


def merged_summary(parts: DataFrame) -> DataFrame:
    """``corpus_summary`` of all races that have parts."""
    place = F.struct("Season", "RoundNumber", "RaceId")
    whole = parts.agg(
        F.countDistinct("RaceId").alias("race_count"), F.countDistinct("Season").alias("season_count"), F.coalesce(F.sum("rows"), F.lit(0)).alias("row_count"), F.coalesce(F.sum("snapshots"), F.lit(0)).alias("snapshot_count"),
        F.min_by("RaceId", place).alias("first_race_id"), F.max_by("RaceId", place).alias("last_race_id"),
    )
    drivers = parts.select(F.explode("drivers").alias("Driver")).distinct().agg(F.count("Driver").alias("driver_count"))
    names = ("race_count", "season_count", "row_count", "snapshot_count", "driver_count", "first_race_id", "last_race_id")
    return whole.unionByName(drivers, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in names])


def chronological_split(corpus: DataFrame, validation_season: int, last_n_races: int, test_seasons: Sequence[int], check: bool = True) -> DataFrame:
    """The corpus with ``Split``: whole races, validation the last of its season, test whole seasons, train all before validation.

    Races that are neither are ``unused``.
    """
    if not test_seasons or validation_season >= min(test_seasons):
        raise CorpusError("the validation season must be before all test seasons")
    races = split_races(corpus, validation_season, last_n_races, test_seasons)
    if check and races.filter("Split = 'validation'").isEmpty():
        raise CorpusError("no race of the validation season is there")
    return corpus.join(races.select("RaceId", "Split"), "RaceId").select(*corpus.columns, "Split")


def split_races(corpus: DataFrame, validation_season: int, last_n_races: int, test_seasons: Sequence[int]) -> DataFrame:
    """The split of each race."""
    races = corpus.select("RaceId", "Season", "RoundNumber").distinct()
    last = F.row_number().over(Window.partitionBy("Season").orderBy(F.col("RoundNumber").desc(), F.col("RaceId").desc()))
    validation = (F.col("Season") == validation_season) & (F.col("_last") <= last_n_races)
    kind = F.when(F.col("Season").isin(*test_seasons), "test").when(validation, "validation").when(F.col("Season") <= validation_season, "train").otherwise("unused")
    return races.withColumn("_last", last).withColumn("Split", kind).drop("_last")
