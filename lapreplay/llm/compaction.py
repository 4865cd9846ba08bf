"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable shards. Shards of one size tier are merged, oldest first and across arrivals,
tier by tier, until they have the target size; what is left over then is merged as well. Every change writes new
files and then a manifest with the next version, which appears whole or not at all; readers follow one manifest and never
see half a change.
"""

from __future__ import annotations

import json
import math
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapreplay.llm.common import scratch

#: From this share of the target on a shard counts as full.
FULL = 0.75


def numbered(rows: Iterator[pa.RecordBatch], small: int) -> Iterator[pa.RecordBatch]:
    """Adds ``shard``: the task's rows in order, cut once a shard has ``small`` bytes."""
    shard, size = None, 0
    for batch in rows:
        numbers = []
        first = batch.column("seq").to_pylist()
        for seq, n in zip(first, batch.column("bytes").to_pylist(), strict=True):
            if shard is None or size >= small:
                shard, size = seq, 0  # named after its first row
            numbers.append(shard)
            size += n
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], [*batch.schema.names, "shard"])


class ShardStore:
    """A folder of shards with versioned manifests, for tables of one schema.

    ``target``: bytes of text in a full shard. ``fan``: shards of a tier that make one of the next; arrivals are cut into
    ``target / fan**2``. Any number of writers: the second commit of one version fails and changes nothing. The driver
    holds a line for each shard of a version, some 150 bytes, so choose ``target`` to match: 1 GB for 100 TB.
    """

    def __init__(self, spark: SparkSession, path: str, target: int = 64 << 20, fan: int = 4):
        self.spark, self.path, self.target, self.fan = spark, path.rstrip("/"), target, fan
        self.small = max(1, target // fan**2)
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> list[dict]:
        """Shards of a version (the newest), oldest rows first: folder, number, first row, bytes, rows and tier."""
        found = self.versions()
        version = version if version is not None else (found[-1] if found else None)
        if version is None:
            return []
        lines = self.spark.read.text(f"{self.path}/manifests/v{version:010d}.json").collect()  # a short line for each shard
        return sorted((json.loads(r[0]) for r in lines if r[0]), key=lambda s: s["first"])

    def commit(self, shards: list[dict], after: int) -> int:
        """Make ``shards`` the version after ``after``: a draft is renamed into place by a rename that never replaces a file."""
        hadoop, gateway = self.spark._jvm.org.apache.hadoop.fs, self.spark.sparkContext._gateway
        version = after + 1
        draft, name = self._path(f"{self.path}/drafts/{uuid.uuid4().hex}"), self._path(f"{self.path}/manifests/v{version:010d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray("".join(json.dumps(s) + "\n" for s in shards).encode()))
        out.close()
        self._fs.mkdirs(self._path(f"{self.path}/manifests"))
        context = hadoop.FileContext.getFileContext(draft.makeQualified(self._fs.getUri(), self._fs.getWorkingDirectory()).toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, name, gateway.new_array(hadoop.Options.Rename, 0))
        except Exception as e:
            self._fs.delete(draft, False)
            if self._fs.exists(name):
                raise RuntimeError(f"version {version} was committed by another writer") from e
            raise
        return version

    def tier(self, size: int) -> int:
        """0 up to ``small`` bytes, then one more for each factor of ``fan``."""
        return max(0, math.ceil(math.log(max(size, 1) / (1.25 * self.small), self.fan)))

    def _write(self, rows: DataFrame) -> list[dict]:
        """Write rows, each shard's by one task and in order, to a new folder; what the manifest says about them."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.sortWithinPartitions("shard", "arrival", "seq").write.partitionBy("shard").option("compression", "zstd").parquet(f"{self.path}/{folder}")
        schema = "arrival int, seq bigint, bytes bigint, shard bigint"
        place = F.min(F.struct("arrival", "seq")).alias("first")
        sizes = self.spark.read.schema(schema).parquet(f"{self.path}/{folder}").groupBy("shard").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"), place)
        return [{"folder": folder, "shard": r["shard"], "first": list(r["first"]), "bytes": r["bytes"], "rows": r["rows"], "tier": self.tier(r["bytes"])} for r in sizes.toLocalIterator()]

    def append(self, table: DataFrame, text_col: str = "text") -> int:
        """Add rows as small shards, without a shuffle. All columns are kept, in a struct, so names can't clash."""
        version = (self.versions() or [0])[-1]
        arrival = version + 1  # the version that brings the rows
        size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long")
        rows = table.select(F.lit(arrival).alias("arrival"), F.monotonically_increasing_id().alias("seq"), size.alias("bytes"), F.struct("*").alias("doc"))
        schema = T.StructType([*rows.schema.fields, T.StructField("shard", T.LongType())])
        new = self._write(rows.mapInArrow(partial(numbered, small=self.small), schema))
        return self.commit((self.manifest(version) if version else []) + new, version)

    def runs(self, shards: list[dict], finish: bool = False) -> list[list[dict]]:
        """Runs to merge: ``fan`` shards of one tier, or fewer that fill a target. With ``finish``, all that aren't full."""
        full = FULL * self.target
        tiers = defaultdict(list)
        for s in shards:
            if s["bytes"] < full:
                tiers[0 if finish else s["tier"]].append(s)
        out = []
        for tier in sorted(tiers):
            run, size = [], 0
            for s in tiers[tier]:
                if size >= full and size + s["bytes"] > self.target or len(run) == self.fan and not finish:
                    out.append(run)
                    run, size = [], 0
                run.append(s)
                size += s["bytes"]
            if len(run) > 1 and (finish or size >= full or len(run) == self.fan):
                out.append(run)
        return out

    def compact(self, finish: bool = True, clean: bool = False) -> int:
        """Merge until no tier has ``fan`` shards, each round in one job; the version that this leaves.

        ``finish`` then merges the few shards that are left below the target's size, so that one at most stays below it; a
        store that gets many arrivals a day may leave that to a nightly call. What is read is immutable, and what is
        written unseen until the commit, so a lost executor or driver costs time only. ``clean`` removes shards that the
        newest version doesn't name after each round: for stores whose older versions nobody reads.
        """
        while True:
            version = (self.versions() or [0])[-1]
            shards = self.manifest(version) if version else []
            runs = self.runs(shards) or (self.runs(shards, finish=True) if finish else [])
            if not runs:
                return version
            number = {(s["folder"], s["shard"]): k for k, run in enumerate(runs) for s in run}
            plan = self.spark.createDataFrame([(f, s, k) for (f, s), k in number.items()], "folder string, shard long, run int")
            rows = self._rows([s for run in runs for s in run]).join(F.broadcast(plan), ["folder", "shard"])
            # A run is as large as a shard and goes to one task of its own.
            rows = rows.repartitionById(len(runs), F.col("run")).select("arrival", "seq", "bytes", "doc", F.col("run").cast("long").alias("shard"))
            self.commit([s for s in shards if (s["folder"], s["shard"]) not in number] + self._write(rows), version)
            if clean:
                self.clean()

    def _rows(self, shards: list[dict]) -> DataFrame:
        """Rows of these shards with ``folder``, ``shard`` and their ``position`` there."""
        paths = [f"{self.path}/{s['folder']}/shard={s['shard']}" for s in shards]
        at = F.col("_metadata.file_path")
        place = (F.regexp_extract(at, r"(data/[0-9a-f]+)/shard=", 1).alias("folder"), F.regexp_extract(at, r"/shard=(\d+)/", 1).cast("long").alias("shard"))
        return self.spark.read.parquet(*paths).select("*", *place, F.col("_metadata.row_index").alias("position"))

    def read(self, version: int | None = None) -> DataFrame | None:
        """Rows of a version: ``arrival, seq, bytes, doc, folder, shard, position``. None where the store has no shard."""
        shards = self.manifest(version)
        return self._rows(shards) if shards else None

    def clean(self, keep: int = 1) -> None:
        """Delete shards that none of the newest ``keep`` versions names. Readers of older ones must have finished."""
        found = self.versions()
        named = {(s["folder"], f"shard={s['shard']}") for v in found[-keep:] for s in self.manifest(v)}
        folders = {x for x, _ in named}
        for v in found[:-keep]:
            self._fs.delete(self._path(f"{self.path}/manifests/v{v:010d}.json"), False)
        for f in self._fs.listStatus(self._path(f"{self.path}/data")):
            folder = f"data/{f.getPath().getName()}"
            if folder not in folders:
                self._fs.delete(f.getPath(), True)
                continue
            for s in self._fs.listStatus(f.getPath()):
                if s.getPath().getName().startswith("shard=") and (folder, s.getPath().getName()) not in named:
                    self._fs.delete(s.getPath(), True)


def shard_documents(docs: DataFrame, target: int = 64 << 20, fan: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Append ``docs`` to a fresh store, compact it, and say where each row is, from the files.

    Every row is there once, nulls and repeated ids included, with the checksum of its text (null for a null text).
    ``shard`` names a shard by its place in the manifest, ``position`` a row's place within it, in order of arrival.
    An empty table gives an empty one.
    """
    store = ShardStore(docs.sparkSession, scratch(docs.sparkSession, "shards"), target, fan)
    store.append(docs, text_col)
    store.compact(clean=True)
    rows = store.read()
    if rows is None:
        return docs.limit(0).select(F.col(id_col).alias("doc_id"), F.lit(0).cast("long").alias("shard"), F.lit(0).alias("tier"), F.lit(0).cast("long").alias("position"), F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("text_crc32"))
    names = docs.sparkSession.createDataFrame([(s["folder"], s["shard"], k, s["tier"]) for k, s in enumerate(store.manifest())], "folder string, shard long, name long, tier int")
    rows = rows.select(F.col(f"doc.{id_col}").alias("doc_id"), "folder", "shard", "position", F.col("bytes").alias("n_bytes"), F.crc32(F.col(f"doc.{text_col}").cast("binary")).alias("text_crc32"))
    return rows.join(F.broadcast(names), ["folder", "shard"]).select("doc_id", F.col("name").alias("shard"), "tier", "position", "n_bytes", "text_crc32")
