"""Landed tables in, datasets and their manifests out.

Tables are folders of Parquet below one root, by season and round. A dataset and its manifests are written beside their place, checked
there, and moved into it race by race under a note that says so: a move that fails is undone, and one that was never made is
made by the next reader.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapreplay.functions import coerce
from lapreplay.operators.corpus import in_ranges, merged_summary, storage_bounds, storage_order, summary_parts
from lapreplay.operators.dataset import require_schema, require_sessions, validate_race_dataset
from lapreplay.schemas import DATASET, DATASET_SCHEMA, METADATA, SESSION_TYPES, TARGET, ArtifactError, RaceDataError
from lapreplay.sources.staging import Checks, remove

SCHEMA_VERSION = 1
MANIFEST = (
    "schema_version int, race_id string, dataset_file string, dataset_sha256 string, row_count long, snapshot_count long, driver_count long, snapshot_lap_min long, "
    "snapshot_lap_max long, winner_row_count long, target_column string, columns array<string>, dtypes map<string,string>"
)

PARTS = "RaceId string, Season int, RoundNumber int, rows long, snapshots long, drivers array<string>"

#: One encoding for each column: Parquet lists several in the order of a hash set, which differs between executors, and so would files of equal rows.
ONE_ENCODING = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false"}


def event_predicate(event: Column, sessions_event: str = "EventName", sessions_round: str = "RoundNumber") -> Column:
    """Whether a session is the asked-for event: text of digits is a round, other text a name."""
    asked = coerce.trimmed(event)
    number = F.when(asked.rlike(r"^\d+$"), asked.try_cast("int"))
    return F.when(number.isNotNull(), (number >= 1) & (F.col(sessions_round) == number)).otherwise((asked != "") & (F.col(sessions_event) == asked))


def session_type(c: Column) -> Column:
    """A session type in its plain form, null where it is none."""
    t = F.upper(coerce.trimmed(c))
    return F.when(t.isin(*SESSION_TYPES), t)


def session_selection(sessions: DataFrame, season: int | None = None, event: str | int | None = None, kind: str | None = None, *, seasons: Sequence[int], default_season: int | None = None, default_event: str | int | None = None, default_kind: str = "R") -> DataFrame:
    """Sessions of a season in scope, an event (name or round) and a type; what isn't given is the default."""
    season = default_season if season is None else season
    event = default_event if event is None else event
    kind = (default_kind if kind is None else kind).strip().upper()
    if season is not None and season not in seasons:
        raise RaceDataError(f"season {season} is out of scope")
    if kind not in SESSION_TYPES:
        raise RaceDataError(f"there is no session type {kind!r}")
    if isinstance(event, str) and not event.strip():
        raise RaceDataError("the event has no name")
    out = sessions.filter(F.col("Season").isin(*seasons))
    if season is not None:
        out = out.filter(F.col("Season") == season)
    if event is not None:
        out = out.filter(event_predicate(F.lit(str(event))))
    return out.filter(session_type(F.col("SessionType")) == kind) if "SessionType" in sessions.columns else out


def main_races(sessions: DataFrame) -> DataFrame:
    """Main races only."""
    return sessions.filter(session_type(F.col("SessionType")) == "R")


def land_tables(tables: Mapping[str, DataFrame], sessions: DataFrame, root: str, overwrite: bool = False) -> None:
    """Write tables below ``root``, a folder for each season and round, so that a scan of some sessions opens these alone.

    Rows of races that no session knows are an error: they have no place.
    """
    places = sessions.select("RaceId", F.col("Season").cast("int").alias("_season"), F.col("RoundNumber").cast("int").alias("_round"))
    for name, df in tables.items():
        overwrite_guard(df.sparkSession, [f"{root}/{name}"], overwrite)
        require_sessions(df, sessions, ArtifactError)
        write = df.join(places, "RaceId").write.partitionBy("_season", "_round").option("partitionOverwriteMode", "dynamic")
        write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{root}/{name}")


def in_places(places: Sequence[tuple[int, int]]) -> Column:
    """A filter on partitions: the given seasons and rounds."""
    seasons: dict[int, list[int]] = {}
    for season, number in places:
        seasons.setdefault(season, []).append(number)
    return reduce(or_, [(F.col("_season") == s) & F.col("_round").isin(sorted(n)) for s, n in seasons.items()], F.lit(False))


def scan_session(spark: SparkSession, root: str, chosen: DataFrame, tables: Sequence[str] = ("laps", "results", "weather", "messages"), most: int = 10_000, **wanted: bool) -> dict[str, DataFrame]:
    """The tables of the chosen sessions, each read only if wanted (``laps=False`` leaves laps out).

    Of tables landed by season and round only the folders of the chosen sessions are listed in the plan and read: up to ``most``
    sessions by a filter on partitions, more by a join on them, which Spark turns into such a filter when it runs. A semi-join on the
    race keeps other races of a folder out.
    """
    names = [t for t in tables if wanted.get(t, True)]
    keys = chosen.select("RaceId", *[F.col(c).cast("int").alias(n) for c, n in (("Season", "_season"), ("RoundNumber", "_round")) if c in chosen.columns])
    found = {t: spark.read.parquet(f"{root}/{t}") for t in names}
    landed = [t for t, df in found.items() if len(keys.columns) == 3 and {"_season", "_round"} <= {*df.columns}]
    places = keys.select("_season", "_round").distinct().limit(most + 1).collect() if landed else []
    for t in landed:
        if len(places) <= most:
            found[t] = found[t].filter(in_places([tuple(p) for p in places]))
    return {t: df.join(keys, keys.columns if t in landed else "RaceId", "left_semi").select(*[c for c in df.columns if c not in ("_season", "_round")]) for t, df in found.items()}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def overwrite_guard(spark: SparkSession, paths: Sequence[str], overwrite: bool) -> None:
    """Raise where output is there already and may not be replaced."""
    found = [] if overwrite else [p for p in paths if exists(spark, p)]
    if found:
        raise ArtifactError(f"output exists: {', '.join(found)}")


def write_cleaned_laps(laps: DataFrame, sessions: DataFrame, path: str, overwrite: bool = False) -> None:
    """Cleaned laps by season and round. Overwriting replaces the written races and leaves others."""
    overwrite_guard(laps.sparkSession, [path], overwrite)
    require_sessions(laps, sessions, ArtifactError)
    keyed = laps.drop("Season", "RoundNumber").join(sessions.select("RaceId", "Season", "RoundNumber"), "RaceId")
    write = keyed.write.partitionBy("Season", "RoundNumber")
    write.option("partitionOverwriteMode", "dynamic").mode("overwrite" if overwrite else "errorifexists").parquet(path)


def cleaning_report(cleaned: DataFrame, before: DataFrame, after: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row per race: identity, rows, columns, types, and the issues before and after as JSON.

    A race without laps has 0 rows; laps without a session have a row without identity.
    """
    fields = [f for f in cleaned.schema.fields if f.name != "RaceId"]
    dtypes = F.to_json(F.create_map(*[F.lit(x) for f in fields for x in (f.name, f.dataType.simpleString())]))
    rows = cleaned.groupBy("RaceId").agg(F.count("*").alias("row_count"))

    def issues(df: DataFrame, name: str) -> DataFrame:
        cells = F.struct("code", "severity", "message", "affected_rows")
        return df.groupBy("RaceId").agg(F.to_json(F.sort_array(F.collect_list(cells))).alias(name), F.count_if(F.col("severity") == "error").alias(f"{name}_errors"))

    out = sessions.select("RaceId", "Season", "EventName", "SessionName").join(rows, "RaceId", "full").fillna({"row_count": 0})
    for df, name in ((before, "input_validation"), (after, "output_validation")):
        out = out.join(issues(df, name), "RaceId", "left").fillna({name: "[]", f"{name}_errors": 0})
    return out.withColumns({"columns": F.array(*[F.lit(f.name) for f in fields]), "dtypes": dtypes})


def write_race_dataset(dataset: DataFrame, path: str, overwrite: bool = False, check: bool = True, checks: Checks | None = None, kept: bool = False) -> DataFrame:
    """Write datasets by season and round, with their manifests below ``<path>-manifest`` and parts of a summary below ``<path>-parts``; returns the manifests.

    All is written to a draft beside ``path``, checked there (``checks``: rules that the write itself measures) and published as a
    whole. Overwriting replaces the written races, data and manifest, and leaves others. What fails on the way leaves both folders as
    they were; what dies while it publishes is finished by whoever opens the dataset next. ``kept``: see ``write_draft``.
    """
    spark = dataset.sparkSession
    recover(spark, path)
    overwrite_guard(spark, [path, f"{path}-manifest"], overwrite)
    if check:
        require_schema(dataset)
    draft = f"{path}-draft-{uuid.uuid4().hex}"
    try:
        write_draft(dataset, path, draft, check, checks, kept)
        publish(spark, path, draft)
    finally:
        _folder(spark, draft)[0].delete(_folder(spark, draft)[1], True)
    return read_manifest(spark, path)


def write_draft(dataset: DataFrame, path: str, draft: str, check: bool = True, checks: Checks | None = None, kept: bool = False) -> None:
    """Write what is to be published at ``path`` to ``draft``: ``data``, ``manifest`` and ``parts`` (of a summary) by season and round. Raises on broken rules.

    The plan runs once: its rows are stored, and counted, asked for bounds and dealt from there. ``kept`` says that they come from files that
    nobody changes meanwhile, by a plan that is cheap to run and gives the same rows each time; they aren't stored once more then.
    """
    spark, rows = dataset.sparkSession, dataset
    if checks and kept:
        raise ValueError("checks are measured while rows are stored")
    if not kept:
        dataset.write.parquet(f"{draft}/rows")
        if checks:
            checks.enforce()
        rows = spark.read.schema(dataset.schema).parquet(f"{draft}/rows")
    storage_bounds(rows).write.parquet(f"{draft}/bounds")
    stored = in_ranges(rows, spark.read.parquet(f"{draft}/bounds"), rows.count()).withColumns({"_season": F.col("Season"), "_round": F.col("RoundNumber")})
    stored.sortWithinPartitions("_season", "_round", *storage_order()).write.options(**ONE_ENCODING).partitionBy("_season", "_round").parquet(f"{draft}/data")
    for name in ("rows", "bounds"):
        remove(spark, f"{draft}/{name}")
    written = spark.read.schema(DATASET_SCHEMA).parquet(f"{draft}/data").select(*DATASET)
    if check:
        validate_race_dataset(written)
    parts = summary_parts(written).withColumns({"_season": F.col("Season"), "_round": F.col("RoundNumber")})
    parts.repartition("_season", "_round").write.partitionBy("_season", "_round").parquet(f"{draft}/parts")
    races = spark.read.schema(f"{PARTS}, first_snapshot long, last_snapshot long, winner_rows long").parquet(f"{draft}/parts").drop("_season", "_round")
    sums = race_checksums(spark, f"{draft}/data", races)
    manifest = parts_manifest(races, path).drop("dataset_sha256").join(sums, "race_id").select(*[f.name for f in spark.createDataFrame([], MANIFEST).schema], "_season", "_round")
    manifest.repartition("_season", "_round").write.partitionBy("_season", "_round").json(f"{draft}/manifest")


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


#: Seconds after which a note of a publication belongs to a writer that has died.
LEASE = 600


def publish(spark: SparkSession, path: str, draft: str) -> None:
    """Move a draft's races, data and manifests, to their place.

    A note in ``<path>-publish`` comes first: from then on the draft is the dataset's next state, and whoever finds the note
    after its writer has died makes the moves that are left. Only folders are renamed, two a race. Where a move fails, all are
    undone and the note is removed.
    """
    fs, hadoop = _folder(spark, path)[0], spark._jvm.org.apache.hadoop.fs.Path
    note = noted(spark, fs, path, draft)
    done: list[tuple] = []
    try:
        moved(spark, fs, path, draft, done)
    except Exception:
        for a, b in reversed(done):
            fs.rename(b, a)
        fs.delete(note, False)
        for folder in (note.getParent(), hadoop(path), hadoop(f"{path}-manifest"), hadoop(f"{path}-parts")):
            _forget_empty(fs, folder)
        raise
    fs.delete(note, False)
    _forget_empty(fs, note.getParent())


def noted(spark: SparkSession, fs, path: str, draft: str):
    """The note of a publication: written in the draft and renamed, so that it is there as a whole or not at all."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    note = hadoop(f"{path}-publish/{uuid.uuid4().hex}")
    out = fs.create(hadoop(f"{draft}/note"), False)
    out.write(bytearray(json.dumps({"draft": draft}).encode()))
    out.close()
    fs.mkdirs(note.getParent())
    if not fs.rename(hadoop(f"{draft}/note"), note):
        raise ArtifactError(f"the publication of {draft} can't be noted")
    return note


def moved(spark: SparkSession, fs, path: str, draft: str, done: list[tuple]) -> None:
    """Make the moves of a publication that are left to make. What was in a race's place goes to the draft's ``replaced`` first."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path

    def move(a, b) -> None:
        fs.mkdirs(b.getParent())
        if not fs.rename(a, b):
            raise ArtifactError(f"{a} can't be moved to {b}")
        done.append((a, b))

    for kind, target in (("data", path), ("manifest", f"{path}-manifest"), ("parts", f"{path}-parts")):
        if not fs.exists(hadoop(f"{draft}/{kind}")):
            continue
        for season in fs.listStatus(hadoop(f"{draft}/{kind}")):
            if not season.isDirectory():
                continue
            for part in fs.listStatus(season.getPath()):
                tail = f"{season.getPath().getName()}/{part.getPath().getName()}"
                if fs.exists(hadoop(f"{target}/{tail}")):
                    move(hadoop(f"{target}/{tail}"), hadoop(f"{draft}/replaced/{kind}/{tail}"))
                move(part.getPath(), hadoop(f"{target}/{tail}"))


def recover(spark: SparkSession, path: str, lease: float | None = None) -> None:
    """Finish publications whose writers have died, so that what is read is one whole state.

    A note younger than ``lease`` seconds (``LEASE`` by default) may have a living writer: it is waited for.
    """
    lease = LEASE if lease is None else lease
    fs, notes = _folder(spark, f"{path}-publish")
    while fs.exists(notes) and (found := list(fs.listStatus(notes))):
        for note in sorted(found, key=lambda f: f.getModificationTime()):
            if time.time() - note.getModificationTime() / 1000 < lease:
                time.sleep(0.2)
                break
            text = spark.read.text(note.getPath().toString(), wholetext=True).first()
            draft = json.loads(text[0])["draft"]
            moved(spark, fs, path, draft, [])
            fs.delete(note.getPath(), False)
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(draft), True)
    _forget_empty(fs, notes)


def _forget_empty(fs, folder) -> None:
    """Remove a folder of a rolled back write that nothing is left in."""
    if not fs.exists(folder):
        return
    for f in fs.listStatus(folder):
        if f.isDirectory() and not fs.listStatus(f.getPath()):
            fs.delete(f.getPath(), False)
    if not fs.listStatus(folder):
        fs.delete(folder, False)


def read_race_dataset(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """Datasets of all races below ``path``."""
    recover(spark, path)
    if not exists(spark, path):
        raise ArtifactError(f"there is no dataset at {path}")
    out = spark.read.schema(DATASET_SCHEMA).parquet(path).select(*DATASET)
    if check:
        validate_race_dataset(out)
    return out


def content_hash(df: DataFrame, key: str = "RaceId") -> DataFrame:
    """A digest of each race's rows that no order or file layout changes: the xor and sum of 64-bit row hashes, and the rows."""
    row = F.xxhash64(*DATASET, *[F.col(c).isNull() for c in DATASET])  # hashes skip nulls
    return df.groupBy(key).agg(F.concat_ws(":", F.hex(F.bit_xor(row)), F.sum(row.cast("decimal(38,0)")).cast("string"), F.count("*").cast("string")).alias("content_hash"))


def race_checksums(spark: SparkSession, path: str, races: DataFrame | None = None, **more: int) -> DataFrame:
    """``race_id, dataset_sha256, _season, _round`` of stored races: SHA-256 of the race's file, or of its files' sums where it has several.

    A folder holds one race; ``race_id`` comes from its rows, or from ``races`` where these are known.
    """
    at = lambda c, name: F.regexp_extract(c, rf"/{name}=(-?\d+)/", 1).cast("int").alias(f"{name}")
    sums = file_checksums(spark, path, **more).select(at("path", "_season"), at("path", "_round"), F.struct(F.element_at(F.split("path", "/"), -1), "sha256").alias("f"))
    sums = sums.groupBy("_season", "_round").agg(F.transform(F.sort_array(F.collect_list("f")), lambda f: f["sha256"]).alias("sums"))
    sums = sums.select("_season", "_round", F.when(F.size("sums") == 1, F.get("sums", F.lit(0))).otherwise(F.sha2(F.concat_ws(",", "sums"), 256)).alias("dataset_sha256"))
    if races is None:
        races = spark.read.schema(DATASET_SCHEMA).parquet(path)
    races = races.groupBy(F.col("RaceId").alias("race_id"), F.col("Season").alias("_season"), F.col("RoundNumber").alias("_round")).agg(F.lit(1).alias("_one")).drop("_one")
    return races.join(sums, ["_season", "_round"])


def dataset_manifest(dataset: DataFrame, path: str = "") -> DataFrame:
    """The manifest of each race, in one grouped pass. ``dataset_sha256`` is null until the race is stored."""
    rows = dataset.groupBy("RaceId").agg(
        F.first("Season").alias("_s"), F.first("RoundNumber").alias("_r"), F.count("*").alias("row_count"), F.countDistinct("SnapshotLap").alias("snapshot_count"), F.countDistinct("Driver").alias("driver_count"),
        F.min("SnapshotLap").alias("snapshot_lap_min"), F.max("SnapshotLap").alias("snapshot_lap_max"), F.count_if(TARGET).alias("winner_row_count"),
    )
    return manifest_of(rows, dataset.select(*DATASET).schema, path)


def parts_manifest(parts: DataFrame, path: str) -> DataFrame:
    """``dataset_manifest`` of stored races, from the parts of their summary: their rows aren't read again."""
    rows = parts.select(
        "RaceId", F.col("Season").alias("_s"), F.col("RoundNumber").alias("_r"), F.col("rows").alias("row_count"), F.col("snapshots").alias("snapshot_count"), F.size("drivers").cast("long").alias("driver_count"),
        F.col("first_snapshot").alias("snapshot_lap_min"), F.col("last_snapshot").alias("snapshot_lap_max"), F.col("winner_rows").alias("winner_row_count"),
    )
    return manifest_of(rows, DATASET_SCHEMA, path)


def manifest_of(rows: DataFrame, schema: T.StructType, path: str) -> DataFrame:
    """Manifests, of what was counted of each race."""
    types = F.create_map(*[F.lit(x) for f in schema.fields for x in (f.name, f.dataType.simpleString())])
    file = F.format_string(f"{path}/_season=%d/_round=%d", "_s", "_r")
    return rows.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.col("RaceId").alias("race_id"), file.alias("dataset_file"), F.lit(None).cast("string").alias("dataset_sha256"), "row_count", "snapshot_count", "driver_count", "snapshot_lap_min", "snapshot_lap_max",
        "winner_row_count", F.lit(TARGET).alias("target_column"), F.array(*[F.lit(c) for c in DATASET]).alias("columns"), types.alias("dtypes"),
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifests of the datasets at ``path``; anything that isn't such an object raises when read."""
    recover(spark, path)
    if not exists(spark, f"{path}-manifest"):
        raise ArtifactError(f"there is no manifest at {path}-manifest")
    out = spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(f"{path}-manifest")
    return out.drop("_season", "_round")


def stored_summary(spark: SparkSession, path: str) -> DataFrame:
    """``corpus_summary`` of the datasets at ``path``, from what was stored of each race: their rows aren't read."""
    recover(spark, path)
    if not exists(spark, f"{path}-parts"):
        raise ArtifactError(f"there are no parts of a summary at {path}-parts")
    return merged_summary(spark.read.schema(PARTS).parquet(f"{path}-parts"))


def verify_checksum(spark: SparkSession, path: str) -> DataFrame:
    """Whether the files of each race in the manifests still are what these say, by SHA-256. Files that are gone aren't."""
    recover(spark, path)
    now = race_checksums(spark, path).select("race_id", F.col("dataset_sha256").alias("_now"))
    out = read_manifest(spark, path).join(now, "race_id", "left")
    return out.select("race_id", F.coalesce(F.col("_now") == F.col("dataset_sha256"), F.lit(False)).alias("verified"))


def file_checksums(spark: SparkSession, path: str, whole: int = 64 << 20, leaf: int = 4 << 20) -> DataFrame:
    """SHA-256 of every Parquet file below ``path``, ``path, sha256``: of its bytes up to ``whole`` bytes, of a tree of digests beyond.

    No task holds a file: larger ones are read as lines, in as many pieces as Spark likes. A line's digest belongs to the stretch
    of ``leaf`` bytes that it begins in, a stretch's digest is made of those of its lines in order, and the file's of its stretches' and its
    length. So the digest depends on the bytes alone, not on how they were dealt. Digests of either kind differ in their first letter.
    """
    named = lambda r: r.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    small = named(spark.read.format("binaryFile")).load(path).filter(F.col("length") <= whole).select("path", F.sha2("content", 256).alias("sha256"))
    return small.unionByName(tree_checksums(named(spark.read.option("lineSep", "\n")).text(path).filter(F.col("_metadata.file_size") > whole), leaf))


def tree_checksums(lines: DataFrame, leaf: int) -> DataFrame:
    """Digests of files that were read as lines: see ``file_checksums``."""
    m = F.col("_metadata")
    d = lines.select(
        m["file_path"].alias("path"), m["file_size"].alias("length"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("line"), (F.octet_length("value") + 1).cast("long").alias("bytes"),
        F.sha2(F.col("value").cast("binary"), 256).alias("sum"),
    )
    inside = Window.partitionBy("path", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("at", F.coalesce(F.sum("bytes").over(inside), F.lit(0)))
    blocks = d.groupBy("path", "block").agg(F.sum("bytes").alias("size"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each piece of a file
    blocks = blocks.select("path", "block", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    d = d.join(blocks, ["path", "block"]).withColumn("at", F.col("at") + F.col("before"))
    inner = lambda key, cells: F.sha2(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct(key, "sum"))), lambda x: x["sum"]), *cells), 256)
    leaves = d.groupBy("path", "length", F.floor(F.col("at") / leaf).alias("leaf")).agg(inner("at", []).alias("sum"))
    return leaves.groupBy("path", "length").agg(F.concat(F.lit("t"), inner("leaf", [F.first("length").cast("string")])).alias("sha256")).select("path", "sha256")


def write_inventory(inventory: DataFrame, path: str, overwrite: bool = False) -> None:
    """Profiles as JSON, a folder per race."""
    overwrite_guard(inventory.sparkSession, [path], overwrite)
    keyed = inventory.withColumn("_race", F.format_string("%d_%s_%s", "Season", coerce.slug(F.col("EventName")), coerce.slug(F.col("SessionName"), "unknown")))
    keyed.write.partitionBy("_race").mode("overwrite" if overwrite else "errorifexists").json(path)


def read_sessions(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/sessions").select(*METADATA)
