"""Token ids in grammar-compressed shards, by Re-Pair.

A shard holds consecutive documents. In each round the id pairs that are frequent enough get a new
nonterminal each and are replaced all over the shard, never across documents; rounds go on, over nonterminals
too, until no pair is frequent. A shard stores its rules with the length that each expands to, so that any slice
of any document is decoded without the rest.

A shard is one row of a Parquet file; ``payload`` has, as little-endian 32-bit numbers: the magic number, the
first nonterminal, the number of documents, of rules and of symbols; then the position of each document's first
symbol and the end, each document's tokens, the rules' left and right sides, their lengths, and the symbols.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapreplay.llm.common import scratch, text_rows
from lapreplay.llm.tokens import batches, encoder, ragged

MAGIC = 0x52505431
_BUCKETS = 17


class Symbols:
    """A shard's symbols while its grammar grows. A symbol stays where its first id was; ``width`` ids on the next one begins."""

    def __init__(self, docs: list[np.ndarray]):
        self.lengths = np.array([len(x) for x in docs], "<u4")
        self.seq = np.concatenate(docs).astype("u4") if docs else np.zeros(0, "u4")
        n = len(self.seq)
        self.start = np.zeros(n + 1, bool)  # of documents, and the end
        self.start[np.append(np.cumsum(self.lengths, dtype="i8") - self.lengths, n)] = True
        self.width, self.alive = np.ones(n, "i4"), np.ones(n, bool)
        self.before = np.arange(-1, n, dtype="i4")
        self.left, self.right, self.name = (np.zeros(1 << _BUCKETS, "u4") for _ in range(3))

    def frequent(self, at: np.ndarray, least: int, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the pairs that begin ``at``: where frequent ones are, where their second symbols, their buckets, counts by bucket, and
        the places of pairs that may be frequent, but share a bucket with another pair this ``turn``."""
        to = at + (self.width.take(at) if turn > 1 else 1)
        inside = np.flatnonzero(~self.start.take(to)) if turn > 1 else at
        if len(inside) < len(at):
            at, to = at.take(inside), to.take(inside)
        left, right = self.seq.take(at), self.seq.take(to)
        bucket = ((left * np.uint32(0x9E3779B1 + 2 * turn) + right * np.uint32(0x85EBCA77 + 2 * turn)) >> np.uint32(32 - _BUCKETS)).astype("i8")
        every = np.bincount(bucket, minlength=1 << _BUCKETS)
        few = np.flatnonzero((every >= least).take(bucket))
        if 2 * len(few) < len(at):
            at, to, left, right, bucket = (x.take(few) for x in (at, to, left, right, bucket))
        self.left[bucket], self.right[bucket] = left, right  # one pair for each bucket
        own = (self.left.take(bucket) == left) & (self.right.take(bucket) == right)
        mine = np.flatnonzero(own)
        count = np.bincount(bucket.take(mine), minlength=1 << _BUCKETS)
        mine = mine.take(np.flatnonzero((count >= least).take(bucket.take(mine))))
        others = np.flatnonzero(~own)
        others = at.take(others.take(np.flatnonzero((every - count >= least).take(bucket.take(others)))))
        return at.take(mine), to.take(mine), bucket.take(mine), count, others

    def replace(self, at: np.ndarray, to: np.ndarray, names: np.ndarray) -> None:
        """One symbol for each pair."""
        self.seq[at] = names
        self.width[at] += self.width.take(to)
        self.alive[to] = False
        self.before[at + self.width.take(at)] = at

    def touched(self, at: np.ndarray, *more: np.ndarray) -> np.ndarray:
        """Where pairs begin that new symbols ``at`` are part of, and ``more`` places, as far as they still are symbols."""
        before = self.before.take(at)
        some = np.zeros(len(self.seq), bool)
        for x in (at, before.take(np.flatnonzero(before >= 0)), *more):
            some[x] = True
        return np.flatnonzero(some & self.alive)


def chosen(at: np.ndarray, to: np.ndarray, bucket: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which of the pairs to replace: of two that overlap, the more frequent one. In a run of one pair (``a a a``) it is every second one."""
    rank = (count.take(bucket) << _BUCKETS) + bucket
    close = to[:-1] == at[1:]
    over = np.sign(rank[1:] - rank[:-1]) * close
    beaten = np.append(over, 0) > 0
    beaten[1:] |= over < 0
    place = np.arange(len(at))
    same = np.append(False, close & (over == 0))
    return ~beaten & ((place - np.maximum.accumulate(np.where(same, 0, place))) & 1 == 0)


def compress(docs: list[np.ndarray], least: int = 8) -> bytes:
    """A shard's payload. Pairs are replaced until none occurs ``least`` times.

    The frequent pairs of a round are replaced together, not one by one, and later rounds look only at pairs that the round
    before changed: that costs a few percent of the symbols and spares a pass for each rule.
    """
    x = Symbols(docs)
    base = first = int(x.seq.max()) + 1 if len(x.seq) else 1
    sides, sizes = [np.zeros((0, 2), "<u4")], [np.ones(first, "<u4")]
    at, turn, idle = np.flatnonzero(~x.start[1:]), 0, 0
    enough = max(2, least // 2)  # some pairs lose most of their places to others
    while len(at) and idle < 4:
        turn += 1
        at, to, bucket, count, others = x.frequent(at, least, turn)
        keep = chosen(at, to, bucket, count)
        used = np.bincount(bucket.take(np.flatnonzero(keep)), minlength=1 << _BUCKETS)
        keep &= (used >= enough).take(bucket)
        taken, left_out = np.flatnonzero(keep), at.take(np.flatnonzero(~keep))
        if not len(taken):
            at, idle = others, idle + 1
            continue
        idle = 0
        made = np.flatnonzero(used >= enough)
        x.name[made] = base + np.arange(len(made), dtype="u4")
        base += len(made)
        rules = np.stack([x.left[made], x.right[made]], 1)
        span = np.concatenate(sizes)
        sizes = [span, span[rules[:, 0]] + span[rules[:, 1]]]
        sides.append(rules)
        at, to = at.take(taken), to.take(taken)
        x.replace(at, to, x.name.take(bucket.take(taken)))
        at = x.touched(at, left_out, others)
    rules, sizes, where = np.concatenate(sides), np.concatenate(sizes)[first:], np.flatnonzero(x.alive)
    seq, start = x.seq[where], x.start[where]
    head = np.array([MAGIC, first, len(docs), len(rules), len(seq)], "<u4")
    some = x.lengths > 0  # an empty document begins where the next one does
    where = np.append(np.append(np.flatnonzero(start), len(seq))[np.cumsum(some) - some], len(seq))
    return b"".join(v.astype("<u4").tobytes() for v in (head, where, x.lengths, rules[:, 0], rules[:, 1], sizes, seq))


class Shard:
    """Reads a payload."""

    def __init__(self, payload: bytes):
        x = np.frombuffer(payload, "<u4")
        if len(x) < 5 or x[0] != MAGIC:
            raise ValueError("not a shard of token ids")
        self.first, docs, rules, symbols = (int(v) for v in x[1:5])
        parts = np.split(x[5:], np.cumsum([docs + 1, docs, rules, rules, rules]))
        self.where, self.lengths, self.left, self.right, self.sizes, self.symbols = parts
        if len(self.symbols) != symbols:
            raise ValueError("the shard is cut off")
        self._whole: list[np.ndarray] | None = None

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """All ids that ``symbols`` stand for: a round replaces every nonterminal by its two sides."""
        while (deep := symbols >= self.first).any():
            ends = np.cumsum(deep + 1)
            out = np.empty(ends[-1], "<u4")
            out[ends - 1] = np.where(deep, self.right[np.where(deep, symbols - self.first, 0)] if len(self.right) else 0, symbols)
            out[ends[deep] - 2] = self.left[symbols[deep] - self.first]
            symbols = out
        return symbols

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of document ``k``; only the symbols that reach into that slice are expanded."""
        symbols = self.symbols[self.where[k] : self.where[k + 1]]
        span = np.ones(len(symbols), "i8")
        deep = symbols >= self.first
        span[deep] = self.sizes[symbols[deep] - self.first]
        ends = np.cumsum(span)
        stop = int(self.lengths[k]) if stop is None else min(stop, int(self.lengths[k]))
        if start >= stop:
            return np.zeros(0, "<u4")
        a, b = np.searchsorted(ends, [start, stop - 1], "right")
        skipped = int(ends[a] - span[a])
        return self.expand(symbols[a : b + 1])[start - skipped : stop - skipped]

    def documents(self) -> Iterator[np.ndarray]:
        """Ids of all documents in turn. Each rule is expanded once."""
        known, starts = [np.arange(self.first, dtype="<u4")], np.zeros(self.first + len(self.sizes), "i8")
        starts[: self.first] = np.arange(self.first)
        spans = np.append(np.ones(self.first, "i8"), self.sizes)
        starts[self.first :] = self.first + np.cumsum(self.sizes.astype("i8")) - self.sizes
        known.append(self.expand(np.arange(self.first, self.first + len(self.sizes), dtype="<u4")))
        ids = np.concatenate(known)[ragged(starts[self.symbols], spans[self.symbols])]
        ends = np.cumsum(self.lengths.astype("i8"))
        for a, b in zip(ends - self.lengths, ends, strict=True):
            yield ids[a:b]


def shard_batches(rows: Iterator[pa.RecordBatch], path: str, end_id: int, shard_tokens: int) -> Iterator[pa.RecordBatch]:
    """Shards of the partition's documents, in their order. A shard ends once it has ``shard_tokens``."""
    task, number, held, names, size = TaskContext.get().partitionId(), 0, [], [], 0

    def shard() -> pa.RecordBatch:
        cells = [[task], [number], [names], [size], [compress(held)]]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cells, (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.binary()), strict=True)], ["part", "shard", "doc_ids", "n_tokens", "payload"])

    for batch in rows:
        ids, texts = batch.column("_id").to_pylist(), batch.column("_text").to_pylist()
        for at, part in batches(texts):
            for k, x in enumerate(encoder(path).encode(part)):
                held.append(np.append(x, np.uint32(end_id)))
                names.append(ids[at + k])
                size += len(x) + 1
                if size >= shard_tokens:
                    yield shard()
                    number, held, names, size = number + 1, [], [], 0
    if held:
        yield shard()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, shard_tokens: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents, in ascending order of id, as shards below ``path``.

    Null texts are empty: the end id alone. Null ids come first; rows that repeat an id follow each other. An empty
    table makes no shard. Ids of documents must be integers.
    """
    d = text_rows(docs, id_col, text_col).withColumn("_id", F.col("_id").cast("long"))
    d = d.repartitionByRange("_id").sortWithinPartitions("_id")
    shards = d.mapInArrow(partial(shard_batches, path=tokenizer, end_id=end_id, shard_tokens=shard_tokens), "part int, shard int, doc_ids array<long>, n_tokens long, payload binary")
    shards.write.parquet(path)


def read_back(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for r in batch.to_pylist():
            docs = list(Shard(r["payload"]).documents())
            lengths = np.array([len(x) for x in docs], "i8")
            n = len(docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, r["part"], "i4")), pa.array(np.full(n, r["shard"], "i4")), pa.array(r["doc_ids"], pa.int64()), pa.array(np.cumsum(lengths) - lengths), pa.array(lengths), pa.array([zlib.crc32(x) for x in docs], pa.int64())],
                ["part", "shard", "doc_id", "before", "n_tokens", "ids_crc32"],
            )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """What the shards below ``path`` hold, document by document: start among all ids, length and checksum."""
    schema = "part int, shard int, doc_ids array<long>, n_tokens long, payload binary"
    shards = spark.read.schema(schema).parquet(path)
    sizes = shards.select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # as few rows as tasks wrote shards
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    before = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", "shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("shard_start"))
    docs = shards.select("part", "shard", "doc_ids", "payload").mapInArrow(read_back, "part int, shard int, doc_id long, before long, n_tokens long, ids_crc32 long")
    out = docs.join(sizes, ["part", "shard"]).join(parts, "part")
    return out.select("doc_id", (F.col("part_start") + F.col("shard_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 1, **more) -> DataFrame:
    """Write ``docs`` to a fresh folder and read the files back."""
    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id, **more)
    return read_tokens(docs.sparkSession, path)
