"""Language-model scores by tries of n-grams.

Documents become blocks of word numbers once. Words are counted over all training documents; trigrams are counted block by
block and dealt by their middle word to shards, of which each becomes a trie (see ``elias_fano``). The words of all
documents are dealt the same way, so that a task opens one trie, maps it, and finds all it needs there.

Words are told apart by 64-bit hashes, and numbered once they are counted; a word that no training text has is number -1.
Probabilities interpolate three levels: a discount, taken off the documents that hold an
n-gram, goes to the level below, and the lowest one is the contract's own ``(c + 1) / (N + V + 1)``. Counting documents, not
places, keeps a text that repeats itself from vouching for its own words.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Callable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapreplay.llm.common import forget, scratch, store, text_rows, written
from lapreplay.llm.decontaminate import lower_ascii
from lapreplay.llm.elias_fano import Trie, build, packed, runs, unpacked

#: The end of a text, and what stands before its first word. Sorts before every hash.
END = -(1 << 63)
BLOCK = "block long, ids array<{}>, rows binary, lengths binary, held binary, words binary, seq binary"
WORDS = "word long, n long, part int, place long"
PIECE = "shard int, salt int, tokens long, payload binary"
#: Sums of log probabilities of a block's texts, of those that a shard has words of: their places in the block, and the sums.
SUMS = "block long, at binary, sums binary"


class Model(NamedTuple):
    """A trained model: the folder of its tries and word counts, and its sums. ``heavy``: words of several shards; ``salts``: readers by shard."""

    path: str
    tokens: int
    kinds: int
    shards: int
    heavy: dict[int, int]
    salts: dict[int, int]


def hashed_words(text) -> F.Column:
    words = F.filter(F.split(lower_ascii(text), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def squeezed(columns: list[np.ndarray]) -> bytes:
    """Numbers below 2**32, compressed: all first bytes of a column, then all second ones, and so on."""
    raw = packed([np.ascontiguousarray(c.astype("<u4").view("u1").reshape(-1, 4).T).ravel() for c in columns])
    return np.array([len(raw)], "i8").tobytes() + pa.compress(raw, "zstd", asbytes=True)


def opened(payload: bytes) -> list[np.ndarray]:
    """The columns of ``squeezed``."""
    raw = unpacked(pa.decompress(payload[8:], int(np.frombuffer(payload, "i8", 1)[0]), "zstd", asbytes=True))
    return [np.ascontiguousarray(c.reshape(4, -1).T).view("<u4").ravel().astype("i8") for c in raw]


def to_blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of at most ``size`` words. A longer text is cut, and each cut begins with the two words before it."""
    part, number = TaskContext.get().partitionId(), 0
    held, names, rows, seqs, n, kind = [], [], [], [], 0, None

    def block() -> pa.RecordBatch:
        nonlocal number
        words, seq = np.unique(np.concatenate(seqs), return_inverse=True)
        cells = [np.array(rows, "i8"), np.array([len(x) for x in seqs], "u4"), np.array(held, "u1"), words]
        number += 1
        return pa.RecordBatch.from_arrays([pa.array([(part << 32) + number]), pa.array([names], pa.list_(kind)), *[pa.array([x.tobytes()], pa.binary()) for x in cells], pa.array([squeezed([seq])], pa.binary())], [f.split()[0] for f in BLOCK.split(", ")])

    for batch in batches:
        ids, own, held_out, lists = (batch.column(c) for c in ("_row", "_id", "held_out", "_words"))
        ids, own, held_out, kind = ids.to_pylist(), own.to_pylist(), held_out.to_pylist(), own.type
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        for k, row in enumerate(ids):
            text = np.concatenate([[END, END], flat[ends[k] : ends[k + 1]], [END]]).astype("i8", copy=False)
            for at in range(2, len(text), size):
                cut = text[at - 2 : at + size]
                if n and n + len(cut) - 2 > size:
                    yield block()
                    held, names, rows, seqs, n = [], [], [], [], 0
                rows.append(row)
                names.append(own[k])
                held.append(held_out[k])
                seqs.append(cut)
                n += len(cut) - 2
    if seqs:
        yield block()


class Block:
    """A stored block. ``v``, ``u``, ``w``: of each word its place in the block's list, the word before it and the one before that; ``of``: its text."""

    def __init__(self, row: dict):
        self.rows, self.held = np.frombuffer(row["rows"], "i8"), np.frombuffer(row["held"], "u1") > 0
        lengths = np.frombuffer(row["lengths"], "u4").astype("i8")
        (seq,) = opened(row["seq"])
        inner = np.ones(len(seq), bool)
        first = np.cumsum(lengths) - lengths
        inner[first] = inner[first + 1] = False
        at = np.flatnonzero(inner)
        self.w, self.v, self.u, self.of = seq[at], seq[at - 1], seq[at - 2], np.repeat(np.arange(len(lengths)), lengths - 2)

    def trained(self, some: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """The training texts' trigrams ``v, u, w`` (with ``some`` only those of such ``v``), the texts that hold each, and its places."""
        mine = np.flatnonzero(~self.held[self.of] if some is None else ~self.held[self.of] & some[self.v])
        key = (self.v[mine] << 42) | (self.u[mine] << 21) | self.w[mine]
        order = np.argsort(key)
        key, of = key[order], self.of[mine][order]
        at = runs(key)
        rank = np.cumsum(np.bincount(at, minlength=len(key)))[: len(key)] - 1 if len(key) else key
        pairs = np.sort(rank * len(self.rows) + of)
        held = np.bincount(pairs[runs(pairs)] // len(self.rows), minlength=len(at)) if len(at) else key
        key = key[at]
        return key >> 42, (key >> 21) & 0x1FFFFF, key & 0x1FFFFF, held, np.diff(np.append(at, len(rank)))


def each_block(f: Callable[[dict], Iterator[pa.RecordBatch]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                yield from f({k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()} | {"schema": batch.schema})

    return run


def block_words(row: dict) -> Iterator[pa.RecordBatch]:
    """Each word of a block with its places in training texts."""
    b, words = Block(row), np.frombuffer(row["words"], "i8")
    n = np.bincount(b.w[~b.held[b.of]], minlength=len(words))
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), row["block"])), pa.array(words), pa.array(n)], ["block", "word", "n"])


def listed(row: dict) -> Iterator[pa.RecordBatch]:
    """Each word of a block with its place in it."""
    words = np.frombuffer(row["words"], "i8")
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), row["block"])), pa.array(words), pa.array(np.arange(len(words), dtype="i4"))], ["block", "word", "at"])


def mixed(number: np.ndarray) -> np.ndarray:
    """Numbers that say nothing of the order of ``number``."""
    x = number.astype("u8") * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) >> np.uint64(8)


def spread(number: np.ndarray, v: np.ndarray, u: np.ndarray, shards: int, heavy: dict[int, int]) -> np.ndarray:
    """The shard of each pair: that of ``v``; pairs of a heavy ``v`` are spread by ``u`` over the shards that follow."""
    x = mixed(number)
    home = (x % np.uint64(shards)).astype("i8")
    wide = np.ones(len(number), "i8")
    for h, n in heavy.items():
        wide[number == h] = n
    other = ((x >> np.uint64(20)) % np.uint64(1 << 30)).astype("i8")
    return (home[v] + other[u] % wide[v]) % shards


def pieces(shard: np.ndarray, n: int, v: np.ndarray, u: np.ndarray, w: np.ndarray, words: list[np.ndarray], more: np.ndarray, tokens: np.ndarray, salt: Callable[[int], int]) -> Iterator[pa.RecordBatch]:
    """What goes to each shard, of triples in ascending order. ``words``: the block's numbers, and more about each; a piece has its own list of those it needs."""
    order = np.argsort(shard, kind="stable")
    ends = np.cumsum(np.bincount(shard, minlength=n))
    by_number = np.argsort(words[0], kind="stable")
    for s in np.flatnonzero(np.diff(np.append(0, ends))).tolist():
        mine = order[(ends[s - 1] if s else 0) : ends[s]]
        used = np.zeros(len(by_number), bool)
        for c in (v, u, w):
            used[c[mine]] = True
        kept = by_number[used[by_number]]
        new = np.zeros(len(by_number), "i8")
        new[kept] = np.arange(len(kept))
        first, *rest = [x[kept] for x in words]
        steps = [np.diff(x, prepend=0) & 0xFFFFFFFF for x in (first + 1, new[v[mine]], new[u[mine]])]  # small ones, of sorted columns; -1 is a number too
        payload = squeezed([steps[0], *rest, *steps[1:], new[w[mine]], more[mine]])
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([salt(s)], pa.int32()), pa.array([int(tokens[mine].sum())]), pa.array([payload], pa.binary())], ["shard", "salt", "tokens", "payload"])


def piece(payload: bytes) -> list[np.ndarray]:
    """The columns of a piece: its words' numbers, more about each, ``v, u, w`` (places among the words) and more about each triple."""
    first, *rest, v, u, w, more = opened(payload)
    return [np.cumsum(first) - 1, *rest, *[np.cumsum(x) & 0xFFFFFFFF for x in (v, u)], w, more]


def train_pieces(row: dict, shards: int, heavy: dict[int, int]) -> Iterator[pa.RecordBatch]:
    b, number = Block(row), np.array(row["number"], "i8")
    v, u, w, c, n = b.trained()
    if len(v):
        yield from pieces(spread(number, v, u, shards, heavy), shards, v, u, w, [number], c, n, lambda s: 0)


def heavy_pairs(row: dict, heavy: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """The followers of heavy words."""
    b, number = Block(row), np.array(row["number"], "i8")
    v, _, w, c, _ = b.trained(np.isin(number, np.array([*heavy], "i8")))
    key = v * len(number) + w
    order = np.argsort(key)
    at = runs(key[order])
    total = np.add.reduceat(c[order], at) if len(at) else key
    key = key[order][at]
    yield pa.RecordBatch.from_arrays([pa.array(number[key // len(number)]), pa.array(number[key % len(number)]), pa.array(total.astype("i8"))], ["v", "w", "c"])


def grown(table: pa.Table, whole: pa.Table, discount: float) -> pa.Table:
    """The trie of one shard."""
    got = [piece(p) for p in table.column("payload").to_pylist()]
    rest = [whole.column(k).to_numpy() for k in "vwc"] if len(whole) else [np.zeros(0, "i8")] * 3
    if not got:
        return pa.table({"shard": pa.array([], pa.int32()), "tokens": pa.array([], pa.int64()), "trie": pa.array([], pa.binary())})
    numbers = [x[0] for x in got]
    words = np.unique(np.concatenate([*numbers, *rest[:2]]))
    places = [np.searchsorted(words, x) for x in numbers]
    v, u, w = (np.concatenate([p[x[k]] for p, x in zip(places, got, strict=True)]) for k in (1, 2, 3))
    c = np.concatenate([x[4] for x in got])
    trie = build(words, v, u, w, c, discount, (np.searchsorted(words, rest[0]), np.searchsorted(words, rest[1]), rest[2]))
    return pa.table({"shard": table.column("shard").slice(0, 1), "tokens": pa.array([sum(table.column("tokens").to_pylist())]), "trie": pa.array([np.array([len(trie)], "i8").tobytes() + pa.compress(trie, "zstd", asbytes=True)], pa.binary())})


def token_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out=None, block_tokens: int = 3 << 18) -> DataFrame:
    """``docs`` as written blocks of word numbers. ``held_out``: a condition on ``docs`` for texts that don't train."""
    if not 0 < block_tokens <= 1 << 20:
        raise ValueError("block_tokens must be in 1..1048576")
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    d = text_rows(docs.withColumn("_held_out", held), id_col, text_col, held_out="_held_out")
    d = d.select(F.monotonically_increasing_id().alias("_row"), "_id", "held_out", hashed_words(F.col("_text")).alias("_words"))
    return written(d.mapInArrow(partial(to_blocks, size=block_tokens), BLOCK.format(d.schema["_id"].dataType.simpleString())), "token-blocks")


def word_counts(blocks: DataFrame, path: str) -> DataFrame:
    """Counts of the words of training texts, stored below ``path``. ``part`` and ``place`` number them once they are."""
    counted = blocks.mapInArrow(each_block(block_words), "block long, word long, n long").filter("n > 0").groupBy("word").agg(F.sum("n").alias("n"))
    placed = counted.select("word", "n", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place"))
    return store(placed, f"{path}/words")


def counted_blocks(blocks: DataFrame, path: str) -> DataFrame:
    """``blocks`` with the count and number of each of their words in a model's training texts, instead of its hash; written."""
    words = blocks.sparkSession.read.schema(WORDS).parquet(f"{path}/words")
    sizes = words.groupBy("part").agg(F.count("*").alias("size"))  # as few rows as the table has files
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    words = words.join(F.broadcast(sizes.select("part", before.alias("before"))), "part").select("word", "n", (F.col("before") + F.col("place")).alias("number"))
    mine = blocks.select("block", "words").mapInArrow(each_block(listed), "block long, word long, at int")
    # A word's place in its block and its number share a long, so that half as much goes back to the blocks.
    cells = F.struct((F.shiftleft(F.col("at").cast("long"), _PLACE) + F.col("number")).alias("at"), "n")
    known = written(mine.join(words, "word").groupBy("block").agg(F.collect_list(cells).alias("known")), "known")
    counted = blocks.withColumn("size", F.expr("octet_length(words) div 8")).drop("words").join(known, "block", "left")
    kind = blocks.schema["ids"].dataType.simpleString()
    out = written(counted.mapInArrow(numbered, f"block long, ids {kind}, rows binary, lengths binary, held binary, seq binary, n array<long>, number array<long>"), "counted-blocks")
    forget(known)
    return out


#: Bits of a word's number beside its place in a block.
_PLACE = 42


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the counts and numbers of their words in order; 0 and -1 of words that no training text has."""
    for batch in batches:
        for i in range(len(batch)):
            part = batch.slice(i, 1)
            known, n, number = part.column("known"), np.zeros(part.column("size")[0].as_py(), "i8"), np.full(part.column("size")[0].as_py(), -1, "i8")
            if known.null_count == 0:
                cells = known.flatten()
                key = cells.field("at").to_numpy()
                at = key >> _PLACE
                n[at], number[at] = cells.field("n").to_numpy(), key & ((1 << _PLACE) - 1)
            lists = [pa.array([x], pa.list_(pa.int64())) for x in (n, number)]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("block", "ids", "rows", "lengths", "held", "seq")], *lists], ["block", "ids", "rows", "lengths", "held", "seq", "n", "number"])


def train(blocks: DataFrame, path: str | None = None, **more) -> Model:
    """A model of the training texts of ``blocks``, written below ``path`` (a fresh shared folder when None). More: see ``grow``."""
    path = path or scratch(blocks.sparkSession, "lm")
    word_counts(blocks, path)
    return grow(counted_blocks(blocks, path), path, **more)


def planned(counted: DataFrame, path: str, shard_tokens: int) -> Model:
    """Sums, shards and heavy words of a model to be. A shard has some ``shard_tokens`` tokens; words with more are heavy: their pairs are spread over as many shards as it takes."""
    spark = counted.sparkSession
    words = spark.read.schema(WORDS).parquet(f"{path}/words")
    tokens, kinds = (int(x or 0) for x in words.agg(F.sum("n"), F.count("*")).first())
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // shard_tokens))
    often = counted.select(F.explode(F.arrays_zip("number", "n")).alias("w")).filter(F.col("w.n") > max(1, tokens // shards)).select("w.number", "w.n").distinct()
    heavy = {r["number"]: min(shards, -(-r["n"] * shards // max(tokens, 1))) for r in often.collect()}  # fewer than there are shards
    return Model(path, tokens, kinds, shards, heavy, {})


def followers(counted: DataFrame, model: Model) -> DataFrame:
    """Counts of what follows the heavy words, for each of their shards: ``shard, v, w, c``."""
    spark, shards = counted.sparkSession, model.shards
    if not model.heavy:
        return spark.createDataFrame([], "shard int, v long, w long, c long")
    homes = [(h, int(mixed(np.array([h]))[0]) % shards, n) for h, n in model.heavy.items()]
    pairs = counted.mapInArrow(each_block(partial(heavy_pairs, heavy=model.heavy)), "v long, w long, c long").groupBy("v", "w").agg(F.sum("c").alias("c"))
    pairs = written(pairs, "heavy-pairs").join(F.broadcast(spark.createDataFrame(homes, "v long, home long, n long")), "v")
    return pairs.select(F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: ((F.col("home") + i) % shards).cast("int"))).alias("shard"), "v", "w", "c")


def grow(counted: DataFrame, path: str, shard_tokens: int = 2_000_000, discount: float = 0.9) -> Model:
    """Write the tries of all trigrams of the blocks' training texts below ``path``, where the words' counts are.

    Trigrams are counted by block before they are dealt, and the followers of heavy words before that. ``discount`` (below 1) is what
    each n-gram leaves to the level below. Nothing is pruned.
    """
    model = planned(counted, path, shard_tokens)
    dealt = counted.mapInArrow(each_block(partial(train_pieces, shards=model.shards, heavy=model.heavy)), PIECE)
    tries = dealt.groupBy("shard").cogroup(followers(counted, model).groupBy("shard")).applyInArrow(partial(grown, discount=discount), "shard int, tokens long, trie binary")
    tries = store(tries, f"{path}/tries")
    sizes = tries.filter(F.col("tokens") > 2 * shard_tokens).select("shard", "tokens").collect()  # fewer than there are shards
    return model._replace(salts={r["shard"]: -(-r["tokens"] // (2 * shard_tokens)) for r in sizes})


def heavy_contexts(row: dict, heavy: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """How often two heavy words follow each other in a block."""
    b, number = Block(row), np.array(row["number"], "i8")
    some = np.isin(number, np.array([*heavy], "i8"))
    mine = np.flatnonzero(some[b.v] & some[b.u])
    key, n = np.unique(b.v[mine] * len(number) + b.u[mine], return_counts=True)
    yield pa.RecordBatch.from_arrays([pa.array(number[key // len(number)]), pa.array(number[key % len(number)]), pa.array(n)], ["v", "u", "n"])


def own_scored(counted: DataFrame, path: str, shard_tokens: int = 2_000_000, discount: float = 0.9) -> tuple[DataFrame, Model]:
    """Scores of the texts that the model is made of, by the same tries as ``grow`` and ``scored`` together, and the model's sums.

    The words that are to be scored hold the training texts' too, so they are dealt once: a task makes its shard's trie and asks it.
    Where two words follow each other so often that they alone would overfill a shard, the trigrams are counted before they are
    dealt instead, and the words asked are spread.
    """
    model = planned(counted, path, shard_tokens)
    if model.heavy:
        pairs = counted.mapInArrow(each_block(partial(heavy_contexts, heavy=model.heavy)), "v long, u long, n long").groupBy("v", "u").agg(F.sum("n").alias("n"))
        if not pairs.filter(F.col("n") > shard_tokens).isEmpty():
            return scored(counted, model := grow(counted, path, shard_tokens, discount)), model
    dealt = counted.mapInArrow(each_block(partial(asked, model=model)), PIECE + ", block long, held binary")
    learn = partial(learned, total=model.tokens + model.kinds + 1, discount=discount)
    sums = dealt.groupBy("shard").cogroup(followers(counted, model).groupBy("shard")).applyInArrow(learn, SUMS)
    return summed(counted, sums, model), model


def learned(pieces: pa.Table, whole: pa.Table, total: int, discount: float) -> pa.Table:
    """The trie of one shard, of its training texts, and what it says of each block."""
    got = [small(p.as_py()) for p in pieces.column("payload")]
    if not got:
        return by_block([], [], [])
    rest = [whole.column(k).to_numpy() for k in "vwc"] if len(whole) else [np.zeros(0, "i8")] * 3
    held = [np.frombuffer(h.as_py(), "u1") > 0 for h in pieces.column("held")]
    before = np.cumsum([0, *map(len, held)])
    held, n_texts = np.concatenate(held), int(before[-1])
    words = np.unique(np.concatenate([*[x[0] for x in got], *rest[:2]]))
    counts = np.zeros(len(words))
    v, u, w, of = (np.empty(sum(len(x[5]) for x in got), "i4") for _ in range(4))
    at = 0
    for n, x in zip(before.tolist(), got, strict=False):
        place, some = np.searchsorted(words, x[0]), slice(at, at := at + len(x[5]))
        counts[place] = x[1]
        v[some], u[some], w[some], of[some] = place[x[2]], place[x[3]], place[x[4]], x[5] + n
    del got
    v, u, w, triple, of = distinct(v, u, w, of, len(words))
    texts = triple.astype("i8")[~held[of]] * n_texts + of[~held[of]]
    texts.sort()
    c = np.bincount(texts[runs(texts)] // n_texts, minlength=len(v)) if len(texts) else np.zeros(len(v), "i8")
    del texts
    known = words[words >= 0]  # the others are in no training text
    off = len(words) - len(known)
    mine = np.flatnonzero(c)
    trie = build(known, v[mine] - off, u[mine] - off, w[mine] - off, c[mine], discount, (np.searchsorted(known, rest[0]), np.searchsorted(known, rest[1]), rest[2]))
    del c, mine
    with tempfile.TemporaryFile() as f:
        f.write(trie)
        f.flush()
        del trie
        logs = np.log10(Trie(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)).probabilities(words, (counts + 1) / total, v, u, w))
    del v, u, w
    sums, n = np.bincount(of, logs[triple], n_texts), np.bincount(of, minlength=n_texts)
    return by_block(pieces.column("block").to_pylist(), *[[x[i:j] for i, j in zip(before[:-1], before[1:], strict=True)] for x in (sums, n)])


def by_block(blocks: list[int], sums: list[np.ndarray], n: list[np.ndarray]) -> pa.Table:
    """A row for each block's piece: which texts have words in it (``n``), and their sums."""
    at = [np.flatnonzero(x) for x in n]
    cells = [pa.array([x.tobytes() for x in c], pa.binary()) for c in ([a.astype("u4") for a in at], [x[a] for x, a in zip(sums, at, strict=True)])]
    return pa.table([pa.array(blocks, pa.int64()), *cells], ["block", "at", "sums"])


def block_sums(rows: pa.Table, sums: pa.Table) -> pa.Table:
    """What all shards say of the texts of a block, by row."""
    names = np.frombuffer(rows.column("rows")[0].as_py(), "i8")
    total = np.zeros(len(names))
    for at, x in zip(sums.column("at"), sums.column("sums"), strict=True):
        total[np.frombuffer(at.as_py(), "u4")] += np.frombuffer(x.as_py(), "f8")
    return pa.table({"_row": pa.array(names), "score": pa.array(total)})


def small(payload: bytes) -> list[np.ndarray]:
    """A piece whose places take four bytes each."""
    number, n, *places = piece(payload)
    return [number, n, *[x.astype("i4") for x in places]]


def distinct(v: np.ndarray, u: np.ndarray, w: np.ndarray, of: np.ndarray, words: int) -> tuple[np.ndarray, ...]:
    """The distinct triples in ascending order, and for each token, by triple, the place of its triple and its text."""
    bits = max(words - 1, 1).bit_length()
    key = v.astype("i8") * (1 << bits) + u
    if 3 * bits > 63:  # pairs by rank instead
        key = np.unique(key, return_inverse=True)[1]
    key <<= bits
    key |= w
    order = np.argsort(key)
    key = key[order]
    at = runs(key)
    first = order[at]
    triple = np.repeat(np.arange(len(at), dtype="i4"), np.diff(np.append(at, len(key))))
    return *(x[first].astype("i8") for x in (v, u, w)), triple, of[order]


def asked(row: dict, model: Model) -> Iterator[pa.RecordBatch]:
    """A block's words for the shards that score them, with the words' counts."""
    b, number, n = Block(row), np.array(row["number"], "i8"), np.array(row["n"], "i8")
    order = np.argsort((b.v << 42) | (b.u << 21) | b.w)
    v, u, w, of = (x[order] for x in (b.v, b.u, b.w, b.of))
    for out in pieces(spread(number, v, u, model.shards, model.heavy), model.shards, v, u, w, [number, np.minimum(n, (1 << 32) - 1)], of, np.ones(len(v), "i8"), lambda s: row["block"] % model.salts.get(s, 1)):
        yield out.append_column("block", pa.array([row["block"]])).append_column("held", pa.array([row["held"]], pa.binary()))


def answered(pieces: pa.Table, tries: pa.Table, total: int) -> pa.Table:
    """What a shard's trie says of each block. It is mapped from an unnamed file, gone when the task is done with it."""
    sums, n = [], []
    with tempfile.TemporaryFile() as f:
        trie = None
        if len(tries):
            raw = tries.column("trie")[0].as_py()
            f.write(pa.decompress(raw[8:], int(np.frombuffer(raw, "i8", 1)[0]), "zstd"))
            del raw
            f.flush()
            trie = Trie(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        for payload in pieces.column("payload"):
            number, count, v, u, w, of = piece(payload.as_py())
            alone = (count + 1) / total
            p = trie.probabilities(number, alone, v, u, w) if trie else alone[w]
            sums.append(np.bincount(of, np.log10(p)))
            n.append(np.bincount(of))
    return by_block(pieces.column("block").to_pylist(), sums, n)


def alone(row: dict, model: Model) -> Iterator[pa.RecordBatch]:
    """Tokens, known tokens and base score of each text."""
    b, n = Block(row), np.array(row["n"], "i8")
    logs = np.log10((n + 1) / (model.tokens + model.kinds + 1))
    known, base = (np.bincount(b.of, x[b.w], len(b.rows)) for x in (n > 0, logs))
    ids = pa.array(row["ids"], row["schema"].field("ids").type.value_type)
    yield pa.RecordBatch.from_arrays([pa.array(b.rows), ids, pa.array(b.held), pa.array(np.bincount(b.of, minlength=len(b.rows))), pa.array(known.astype("i8")), pa.array(base)], ["_row", "doc_id", "held_out", "n_tokens", "n_known", "base_score"])


def score(blocks: DataFrame, model: Model) -> DataFrame:
    """The log10 probability of each text of ``blocks``, in all and by its words alone."""
    return scored(counted_blocks(blocks, model.path), model)


def scored(counted: DataFrame, model: Model) -> DataFrame:
    spark: SparkSession = counted.sparkSession
    dealt = counted.mapInArrow(each_block(partial(asked, model=model)), PIECE + ", block long, held binary")
    tries = spark.read.parquet(f"{model.path}/tries").select("shard", "trie")
    salts = F.broadcast(spark.createDataFrame([*model.salts.items()], "shard int, salts int"))  # fewer than there are shards
    tries = tries.join(salts, "shard", "left").select("shard", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"), "trie")
    total = model.tokens + model.kinds + 1
    sums = dealt.groupBy("shard", "salt").cogroup(tries.groupBy("shard", "salt")).applyInArrow(partial(answered, total=total), SUMS)
    return summed(counted, sums, model)


def summed(counted: DataFrame, sums: DataFrame, model: Model) -> DataFrame:
    """One row for each text, of what its blocks say of it and the shards' sums."""
    kind = counted.schema["ids"].dataType.elementType.simpleString()
    base = counted.mapInArrow(each_block(partial(alone, model=model)), f"_row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double")
    sums = counted.select("block", "rows").groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(block_sums, "_row long, score double")
    every = base.unionByName(sums, allowMissingColumns=True).groupBy("_row")
    return every.agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2) -> DataFrame:
    """Scores of every whole text by a model of all texts but those whose id's CRC-32 modulo ``folds`` is ``held_fold``.

    Null texts are empty and have one token, the end; rows that repeat an id are texts of their own; a null id trains;
    an empty table gives an empty one.
    """
    held = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == held_fold
    blocks = token_blocks(docs, id_col, text_col, held)
    path = scratch(docs.sparkSession, "lm")
    word_counts(blocks, path)
    counted = counted_blocks(blocks, path)
    forget(blocks)
    out, model = own_scored(counted, path)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
