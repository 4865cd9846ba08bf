"""Alignment of two tokenizers' tokens by the bytes they cover.

Where a token of either ends at one place, the text has a shared cut. Cuts are found by divide and conquer: of an interval, the ends
of the first tokenizer's tokens are tried from the middle on, each looked up among the second's by bisection; the
first that both have splits the interval in two, and one without any is a leaf: a group of tokens that only match as a whole. All
intervals of a batch of texts go down together, and an end that failed is never tried again.

What a pair of ids is worth, the number of documents that have it linked, is counted over all documents, and comes back to each
block of documents for the pairs in it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapreplay.llm.common import text_rows, written
from lapreplay.llm.elias_fano import packed, runs, unpacked
from lapreplay.llm.tokens import Encoder, batches, ragged

#: Words that a worker remembers at most; it then starts afresh.
REMEMBERED = 600_000
_UNITS = re.compile(" *[^ ]+| +")
_PAIR = 32  # bits of the second id in a pair's number


class ByteTokens:
    """Tokens of a byte-level vocabulary: ids, and the bytes of each id."""

    def __init__(self, path: str):
        self.encoder = Encoder(path)
        self.encoder.library.encode_special_tokens = True  # their strings are plain text
        back = {c: b for b, c in self.encoder.letters.items()}
        size = self.encoder.library.get_vocab_size()
        tokens = [self.encoder.library.id_to_token(i) or "" for i in range(size)]
        self.lengths = np.array([len(t) if all(c in back for c in t) else len(t.encode()) for t in tokens], "i8")
        self.names = [str(i) for i in range(size)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.encoder.encode(texts)


class PieceTokens:
    """Tokens of a sentencepiece model, by words: no piece of the vocabulary has a space after another character, so words are
    encoded apart, each once. A model with such a piece takes texts whole. The model adds the space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(size)]
        self.by_words = not any("▁" in p.lstrip("▁") for p in pieces)
        self.bytes = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.lengths = np.array([len(b) for b in self.bytes], "i8")
        self.names = [str(i) for i in range(size)]
        self.space = self.library.piece_to_id("▁")
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.starts, self.sizes, self.flat, self.right = np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "u4"), np.zeros(0, bool)

    def learn(self, new: list[str]) -> None:
        """Encode words, each with the spaces before it, and note whether their tokens' bytes are theirs."""
        ids = self.library.encode([x[1:] for x in new], num_threads=1)
        ids = [[self.space] if x == " " else i for x, i in zip(new, ids, strict=True)]
        right = [b"".join(map(self.bytes.__getitem__, i)) == x.encode() for x, i in zip(new, ids, strict=True)]
        self.sizes = np.append(self.sizes, np.array([len(i) for i in ids], "i8"))
        self.flat = np.append(self.flat, np.array([y for i in ids for y in i], "u4"))
        self.right = np.append(self.right, np.array(right, bool))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def encode(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of each text with a space before it; None where their bytes aren't the text's."""
        if not self.by_words:
            ids = self.library.encode([t[1:] for t in texts], num_threads=1)
            return [np.array(i, "u4") if b"".join(map(self.bytes.__getitem__, i)) == t.encode() else None for t, i in zip(texts, ids, strict=True)]
        if len(self.numbers) > REMEMBERED:
            self.forget()
        numbers, old, parts = self.numbers, len(self.sizes), []
        for t in texts:
            parts.append(np.array([numbers.setdefault(x, len(numbers)) for x in _UNITS.findall(t)], "i8"))
        if len(numbers) > old:
            self.learn(list(numbers)[old:])
        out = []
        for p in parts:
            out.append(self.flat[ragged(self.starts[p], self.sizes[p])] if self.right[p].all() else None)
        return out


@lru_cache(maxsize=2)
def tokenizers(first: str, second: str) -> tuple[ByteTokens, PieceTokens]:
    return ByteTokens(first), PieceTokens(second)


def shared_cuts(a: np.ndarray, b: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which ends of ``a`` are ends of ``b`` too, by divide and conquer. Both ascend; ``last``: the places in ``a`` of the texts' last ends.

    An interval has the ends ``lo..hi`` of ``a`` yet to try; the next ones to try, from its middle outwards, are ``down`` and ``up``.
    """
    cut = np.zeros(len(a), bool)
    cut[last] = True  # both tokenizers' tokens end where a text does
    lo, hi = np.append(0, last[:-1] + 1), last - 1
    up = (lo + hi + 1) >> 1
    down, turn = up - 1, 0
    while True:
        some = np.flatnonzero((down >= lo) | (up <= hi))  # the others are leaves
        if not len(some):
            return cut
        if len(some) < len(lo):
            lo, hi, down, up = lo[some], hi[some], down[some], up[some]
        right = (up <= hi) & ((down < lo) | (turn % 2 == 0))
        probe = np.where(right, up, down)
        up, down, turn = up + right, down - ~right, turn + 1
        end = a[probe]
        hit = b[np.searchsorted(b, end)] == end  # bisection; the last end is in both
        if hit.any():
            cut[probe[hit]] = True
            lo, hi = np.concatenate([lo[~hit], lo[hit], up[hit]]), np.concatenate([hi[~hit], down[hit], hi[hit]])
            fresh = int(hit.sum())
            middle = (lo[-2 * fresh :] + hi[-2 * fresh :] + 1) >> 1
            up, down = np.append(up[~hit], middle), np.append(down[~hit], middle - 1)


class Aligned:
    """The groups and links of a batch of texts, given the ids of their tokens of either kind."""

    def __init__(self, first: list[np.ndarray], second: list[np.ndarray], lengths: tuple[np.ndarray, np.ndarray]):
        self.n = [np.array([len(x) for x in ids], "i8") for ids in (first, second)]
        self.ids = [np.concatenate(ids).astype("i8") for ids in (first, second)]
        self.ends = [np.cumsum(n[i]) for n, i in zip(lengths, self.ids, strict=True)]
        a, b = self.ends
        last = np.cumsum(self.n[0]) - 1
        self.cut = shared_cuts(a, b, last)
        self.at = np.flatnonzero(self.cut)  # the last token of each group
        self.bt = np.searchsorted(b, a[self.at])
        self.of = np.repeat(np.arange(len(first)), self.n[0])
        self.groups = np.bincount(self.of[self.at], minlength=len(first))

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text and ids of each pair of tokens that share a byte: one pair for each stretch between neighbouring ends of either kind."""
        a, b = self.ends
        ends = np.sort(np.append(a, np.delete(b, self.bt)))
        i = np.searchsorted(a, ends)
        return self.of[i], self.ids[0][i], self.ids[1][np.searchsorted(b, ends)]

    def texts(self, names: list[str]) -> Iterator[str]:
        """The groups of each text, written out. ``names``: the ids of either kind, each with every mark that may follow it."""
        (a, b), size = self.ids, len(names) // 4
        end = np.zeros(len(b), bool)
        end[self.bt] = True
        codes = np.zeros(len(a) + len(b), "i8")
        before = np.append(0, self.bt + 1)  # of the second kind's tokens, by group
        through = self.at + 1  # of the first kind's
        codes[np.arange(len(a)) + before[np.cumsum(self.cut) - self.cut]] = a + size * self.cut
        codes[np.arange(len(b)) + through[np.cumsum(end) - end]] = b + size * (2 + end)
        stop = np.cumsum(self.n[0] + self.n[1])
        for s, e in zip((stop - self.n[0] - self.n[1]).tolist(), stop.tolist(), strict=True):
            yield "".join(map(names.__getitem__, codes[s:e].tolist()))[:-1]


COLUMNS = ("block", "ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "df", "payload")


def aligned_blocks(rows: Iterator[pa.RecordBatch], first: str, second: str, chars: int) -> Iterator[pa.RecordBatch]:
    """Blocks of aligned texts of some ``chars`` characters: each text's counts and digest, and how often each pair of ids is linked in it."""
    one, two = tokenizers(first, second)
    size = max(len(one.names), len(two.names))
    padded = [x.names + [""] * (size - len(x.names)) for x in (one, two)]
    names = [n + mark for x, marks in zip(padded, (",|", ",;"), strict=True) for mark in marks for n in x]
    bits = size.bit_length()
    part, number, have, n = TaskContext.get().partitionId(), 0, [], 0

    def block() -> pa.RecordBatch:
        nonlocal number
        number += 1
        ids = pa.concat_arrays([h[0] for h in have])
        counts = [np.concatenate([h[1][k] for h in have]) for k in range(4)]
        pair, times, each = (np.concatenate([h[k] for h in have]) for k in (3, 4, 5))
        pairs, local = np.unique(pair, return_inverse=True)
        raw = packed([each.astype("u4"), local.astype("u4" if len(pairs) > 65536 else "u2"), times.astype("u4")])
        payload = np.array([len(raw)], "i8").tobytes() + pa.compress(raw, "zstd", asbytes=True)
        pairs = ((pairs >> bits) << _PAIR) | (pairs & ((1 << bits) - 1))
        many = lambda x: pa.array([x], pa.list_(pa.int64()))
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([
            pa.array([(part << 32) + number]), lists, *map(many, counts), pa.array([[x for h in have for x in h[2]]], pa.list_(pa.string())), many(pairs), many(np.bincount(local, minlength=len(pairs))),
            pa.array([payload], pa.binary()),
        ], list(COLUMNS))

    for batch in rows:
        ids, texts = batch.column("_id"), batch.column("_text").to_pylist()
        for at, some in batches(texts, 1_000_000):
            whole = [" " + t for t in some]
            second_ids = [x if t else None for t, x in zip(some, two.encode(whole), strict=True)]
            good = [k for k, x in enumerate(second_ids) if x is not None]
            counts = [np.zeros(len(some), "i8") for _ in range(4)]
            shas, each = [""] * len(some), np.zeros(len(some), "i8")
            pair = times = np.zeros(0, "i8")
            if good:
                x = Aligned(one.encode([whole[k] for k in good]), [second_ids[k] for k in good], (one.lengths, two.lengths))
                for c, v in zip(counts, (*x.n, x.groups, x.n[0] + x.n[1] - x.groups), strict=True):
                    c[good] = v
                for k, t in zip(good, x.texts(names), strict=True):
                    shas[k] = hashlib.sha256(t.encode()).hexdigest()
                of, i, j = x.links()
                key = np.sort((of << (2 * bits)) | (i << bits) | j)
                start = runs(key)
                times, key = np.diff(np.append(start, len(key))), key[start]
                each[good] = np.bincount(key >> (2 * bits), minlength=len(good))
                pair = key & ((1 << (2 * bits)) - 1)
            have.append((ids.slice(at, len(some)), counts, shas, pair, times, each))
            n += sum(map(len, some)) + len(some)
            if n >= chars:
                yield block()
                have, n = [], 0
    if have:
        yield block()


def with_counts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each text of a block; ``worth``: of the block's pairs, in order, twice the documents that have each, and 1 more if none of its first id has more."""
    for batch in rows:
        for i in range(len(batch)):
            r = {k: batch.column(k)[i] for k in batch.schema.names}
            raw = r["payload"].as_py()
            each, local, times = (x.astype("i8") for x in unpacked(pa.decompress(raw[8:], int(np.frombuffer(raw, "i8", 1)[0]), "zstd", asbytes=True)))
            worth = np.array(r["worth"].as_py() or [], "i8")[local] if len(local) else local
            of = np.repeat(np.arange(len(each)), each)
            sums = [np.zeros(len(each), "i8") for _ in range(2)]
            for total, x in zip(sums, (times * (worth & 1), times * (worth >> 1)), strict=True):
                np.add.at(total, of, x)
            ids = r["ids"].values
            yield pa.RecordBatch.from_arrays([ids, *[r[c].values for c in COLUMNS[2:7]], *map(pa.array, sums)], ["doc_id", *COLUMNS[2:7], "n_best", "count_sum"])


def align(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 6_000_000) -> DataFrame:
    """Groups, links and what these are worth, of every whole text: tokens of the byte-level vocabulary ``first`` against the sentencepiece model ``second``.

    Null and empty texts, and texts that the model changes, have no tokens: zeros and an empty string. Rows that repeat an id are
    texts of their own and count each; null ids stay null; an empty table gives an empty one.
    """
    d = text_rows(docs, id_col, text_col)
    kind = d.schema["_id"].dataType.simpleString()
    schema = f"block long, ids array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, pairs array<long>, df array<long>, payload binary"
    blocks = written(d.mapInArrow(partial(aligned_blocks, first=first, second=second, chars=block_chars), schema), "aligned")
    counts = blocks.select(F.explode(F.arrays_zip("pairs", "df")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.df").alias("n"))
    counts = written(counts.withColumn("a", F.shiftright("pair", _PAIR)), "pair-counts")
    best = counts.groupBy("a").agg(F.max("n").alias("best"))
    worth = counts.join(best, "a").select("pair", (2 * F.col("n") + (F.col("n") == F.col("best")).cast("long")).alias("worth"))
    mine = blocks.select("block", F.explode("pairs").alias("pair")).join(worth, "pair")
    mine = mine.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pair", "worth"))).alias("w")).select("block", F.col("w.worth").alias("worth"))
    out = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return blocks.drop("pairs", "df").join(mine, "block", "left").mapInArrow(with_counts, out)
