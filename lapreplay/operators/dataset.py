"""Race datasets: replay, label and race identity in one table of fixed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapreplay.functions import coerce
from lapreplay.operators.replay import LABEL, SNAPSHOT, leads, merged, prepared_laps, replay_rows, watched_laps, watched_races, watched_stream
from lapreplay.operators.rules import Rule, duplicate_keys, enforce
from lapreplay.operators.targets import prepared_results, result_rules
from lapreplay.schemas import DATASET, DATASET_KEY, METADATA, POST_RACE, REPLAY, REPLAY_INPUT, TARGET, DatasetError, RaceDataError, ReplayError, TargetError, require_columns
from lapreplay.sources.staging import Checks


def race_identity(sessions: DataFrame, requested_event: str | None = None, requested_session: str = "Race") -> DataFrame:
    """Identity columns of each session. Blank names fall back to what was asked for; bad numbers are null."""
    c = F.col
    event = F.coalesce(coerce.text(c("EventName")), F.lit(requested_event))
    out = sessions.select(coerce.positive_whole(c("Season")).alias("Season"), coerce.positive_whole(c("RoundNumber")).alias("RoundNumber"), event.alias("EventName"), F.coalesce(coerce.text(c("SessionName")), F.lit(requested_session)).alias("SessionName"))
    return out.select(coerce.race_id(c("Season"), c("RoundNumber"), c("EventName")).alias("RaceId"), "Season", "RoundNumber", "EventName", "SessionName")


def check_identity(sessions: DataFrame) -> DataFrame:
    """Sessions whose season or round isn't a positive whole number, or whose event has no name."""
    c = F.col
    bad = coerce.positive_whole(c("Season")).isNull() | coerce.positive_whole(c("RoundNumber")).isNull() | coerce.text(c("EventName")).isNull()
    return sessions.filter(bad)


def row_rules() -> list[Rule]:
    """Rules that each row of a dataset must keep. Unknown deficits and availabilities break theirs."""
    c = F.col
    bad = lambda x: F.coalesce(x, F.lit(True))
    return [
        Rule("completed_beyond_snapshot", "error", "a driver has more laps than the snapshot", c("CompletedLaps") > c("SnapshotLap")),
        Rule("availability_mismatch", "error", "the availability isn't the snapshot's lap", bad(c("DataAvailableThroughLap") != c("SnapshotLap"))),
        Rule("deficit_mismatch", "error", "the deficit isn't the snapshot's lap less the completed ones", bad(c("LapsBehindLeader") != c("SnapshotLap") - c("CompletedLaps"))),
        Rule("missing_target", "error", "the label is missing", c(TARGET).isNull()),
    ]


def blank(name: str) -> Column:
    """Whether an identity column is missing or blank."""
    return F.col(name).isNull() | F.coalesce(coerce.trimmed(F.col(name)) == "", F.lit(False))


def digest(name: str) -> Column:
    """A number for a value, null for null. Numbers, unlike texts, are compared in a hashed aggregation, without a sort."""
    return F.when(F.col(name).isNotNull(), F.xxhash64(name))


def check_dataset(dataset: DataFrame) -> DataFrame:
    """Broken rules of race datasets, of any number of races.

    One pass sums up all rules but one by identity and snapshot, before its shuffle, and then by race: what is asked of identity columns is
    asked once of their rows together, not of each. Copies of a key are counted apart, from the keys alone; no rows are sorted.
    """
    c, rules = F.col, row_rules()
    alike = dataset.groupBy(*METADATA, "SnapshotLap").agg(*[F.count_if(r.breaks).alias(f"n{i}") for i, r in enumerate(rules)], F.count_if(TARGET).alias("wins"), F.count("*").alias("rows"))
    per = alike.groupBy("RaceId", "SnapshotLap").agg(
        *[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(rules))], F.sum("wins").alias("wins"),
        *[f for m in METADATA for f in (F.sum(F.when(blank(m), c("rows")).otherwise(0)).alias(f"b_{m}"), F.min(digest(m)).alias(f"lo_{m}"), F.max(digest(m)).alias(f"hi_{m}"))],
    )
    races = per.groupBy(c("RaceId").alias("_race")).agg(
        *[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(rules))], F.count_if(c("wins") != 1).alias("unwon"),
        *[f for m in METADATA for f in (F.sum(f"b_{m}").alias(f"b_{m}"), (F.min(f"lo_{m}") != F.max(f"hi_{m}")).cast("long").alias(f"v_{m}"))],
    )
    issue = lambda code, message, n: F.struct(F.lit(code).alias("code"), F.lit("error").alias("severity"), F.lit(message).alias("message"), F.coalesce(n, F.lit(0)).cast("long").alias("affected_rows"))
    cells = [issue(r.code, r.message, c(f"n{i}")) for i, r in enumerate(rules)]
    cells += [issue(f"{code}_{m}", f"{m} {what}", c(f"{p}_{m}")) for m in METADATA for p, code, what in (("b", "blank", "is missing or blank"), ("v", "varying", "isn't one value"))]
    cells.append(issue("snapshot_winner_count", "snapshots haven't exactly one winner", c("unwon")))
    found = races.select(c("_race").alias("RaceId"), F.inline(F.array(*cells)))
    copies = duplicate_keys(dataset, DATASET_KEY).groupBy("RaceId").agg(F.sum("copies").alias("n"))
    return found.unionByName(copies.select("RaceId", F.inline(F.array(issue("duplicate_key", "a driver is in a snapshot more than once", c("n")))))).filter("affected_rows > 0")


def metadata_constancy(dataset: DataFrame) -> DataFrame:
    """Identity columns that are missing, blank or not the same on all rows of a race."""
    c = F.col
    aggs = []
    for m in METADATA:
        aggs += [F.count_if(blank(m)).alias(f"b_{m}"), (F.min(m) != F.max(m)).cast("long").alias(f"v_{m}")]
    per = dataset.groupBy(F.col("RaceId").alias("_race")).agg(*aggs).withColumnRenamed("_race", "RaceId")
    cells = [F.struct(F.lit(f"{code}_{m}").alias("code"), F.lit("error").alias("severity"), F.lit(f"{m} {what}").alias("message"), F.coalesce(c(f"{p}_{m}"), F.lit(0)).alias("affected_rows")) for m in METADATA for p, code, what in (("b", "blank", "is missing or blank"), ("v", "varying", "isn't one value"))]
    return per.select("RaceId", F.inline(F.array(*cells))).filter("affected_rows > 0")


def require_schema(dataset: DataFrame) -> None:
    """Raise unless the columns are a dataset's, with none that is known only after the race."""
    require_columns(dataset, DATASET, DatasetError, "dataset")
    late = sorted(POST_RACE & set(dataset.columns))
    if late:
        raise DatasetError(f"columns known only after the race: {', '.join(late)}")
    if not isinstance(dataset.schema[TARGET].dataType, T.BooleanType):
        raise DatasetError(f"{TARGET} must be boolean")


def validate_race_dataset(dataset: DataFrame) -> None:
    """Raise where a race dataset breaks its contract."""
    require_schema(dataset)
    if dataset.isEmpty():
        raise DatasetError("the dataset is empty")
    enforce(check_dataset(dataset), DatasetError)


def require_sessions(rows: DataFrame, sessions: DataFrame, error: type[RaceDataError]) -> None:
    """Raise where rows belong to no session: a join to the sessions would drop them without a word."""
    lost = rows.select("RaceId").join(sessions.select("RaceId"), "RaceId", "left_anti").limit(1).collect()
    if lost:
        raise error(f"there is no session for race {lost[0]['RaceId']!r}")


def planned_dataset(laps: DataFrame, results: DataFrame, sessions: DataFrame, start_lap: int = 1, end_lap: int | None = None, check: bool = True) -> tuple[DataFrame, Checks]:
    """The plan of ``build_race_dataset``, and the checks that are measured when it runs (none without ``check``).

    What laps, results and sessions say of a race meets in one grouped pass. The labels ride in the drivers' streams, so nothing
    else is shuffled: a race's rows get its identity where they are made.
    """
    require_columns(laps, ["RaceId", *REPLAY_INPUT], ReplayError, "lap table")
    require_columns(sessions, METADATA, RaceDataError, "session table")
    checks, c = Checks(), F.col
    races = race_facts(prepared_laps(laps), prepared_results(results), sessions, start_lap, end_lap)
    if check:
        laps = watched_laps(checks, laps)
        results = checks.watch(results, [(r.code, r.message, r.breaks) for r in result_rules(results)], TargetError, "the result table is empty")
        on_track = F.size("_drivers") > 0
        races = checks.watch(watched_races(checks, races), [
            ("winner_count", "there isn't exactly one winner", (c("_results") > 0) & (c("_wins") != 1)),
            ("no_session", "there is no session for the race", on_track & (c("_sessions") == 0)), ("duplicate_session", "a race has more than one session", c("_sessions") > 1),
            ("missing_target", "no driver of the race has a label", on_track & (c("_results") == 0)),
            ("snapshot_winner_count", "the winner never finished a lap", on_track & (F.size("_winners") == 1) & ~F.coalesce(F.array_contains("_drivers", F.get("_winners", F.lit(0))), F.lit(False))),
        ], DatasetError)
    rows = merged(prepared_laps(laps), races.filter(c("_session").isNotNull()), carried=["_session"], labels=prepared_results(results).select("RaceId", "Driver", (c("FinalPosition") == 1).alias("_label")))
    if check:
        rows = checks.watch(watched_stream(checks, rows), [
            ("duplicate_driver", "a driver is classified more than once", c("_again") & (c("_kind") == LABEL)), ("missing_target", "the label is missing", (c("_kind") == SNAPSHOT) & c("_last").isNotNull() & c("_told").isNull()),
            ("snapshot_winner_count", "snapshots haven't exactly one winner", (c("_kind") == SNAPSHOT) & c("_told") & c("_last").isNull()),
        ], TargetError)
    out = replay_rows(rows, more=["_session", "_told"]).select("RaceId", "_session.*", *REPLAY, c("_told").alias(TARGET)).select(*DATASET)
    if check:
        out = checks.watch(out, [*[(r.code, r.message, r.breaks) for r in row_rules()], *[(f"blank_{m}", f"{m} is missing or blank", blank(m)) for m in METADATA]], DatasetError, "the dataset is empty")
    return out, checks


def race_facts(laps: DataFrame, results: DataFrame, sessions: DataFrame, start_lap: int = 1, end_lap: int | None = None) -> DataFrame:
    """All that is known of each race: what ``race_spines`` says, its winners, how many results and sessions it has, and its identity."""
    c = F.col
    laps = laps.select("RaceId", F.struct("Driver").alias("_driver"), F.when(leads(start_lap, end_lap), c("LapNumber")).cast("long").alias("_snapshot"))
    won = F.coalesce(c("FinalPosition") == 1, F.lit(False))
    results = results.select("RaceId", F.lit(1).alias("_result"), F.when(won, F.struct("Driver")).alias("_winner"))
    sessions = sessions.select("RaceId", F.struct(*METADATA[1:]).alias("_session"))
    rows = laps.unionByName(results, allowMissingColumns=True).unionByName(sessions, allowMissingColumns=True)
    return rows.groupBy("RaceId").agg(
        F.collect_set("_driver").alias("_drivers"), F.collect_set("_snapshot").alias("_spine"), F.count("_snapshot").alias("_leaders"), F.collect_set("_winner").alias("_winners"), F.count("_winner").alias("_wins"),
        F.count("_result").alias("_results"), F.count("_session").alias("_sessions"), F.max("_session").alias("_session"),
    )


def build_race_dataset(laps: DataFrame, results: DataFrame, sessions: DataFrame, start_lap: int = 1, end_lap: int | None = None, check: bool = True) -> DataFrame:
    """Datasets of all races of ``sessions``. Without ``check`` the plan is lazy.

    ``check`` runs it once, into a draft in the shared folder, and raises on broken rules of any table or of the result.
    """
    out, checks = planned_dataset(laps, results, sessions, start_lap, end_lap, check)
    return checks.staged(out, "dataset") if check else out
