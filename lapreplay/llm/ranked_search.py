"""Ranked search of documents for each query item, term at a time with limited accumulators.

Documents become blocks of postings of the items' terms, and their counts are summed over all documents. A task then takes
its blocks one by one. In a block, an item's terms are processed from the rarest on; once the most that the terms still to come
can add is below the score of the kth best document so far, no document gets a new accumulator, and those that have one
are still updated to their exact scores. The kth best score of a task's earlier blocks holds in its later ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapreplay.llm.common import text_rows, written
from lapreplay.llm.decontaminate import word_hashes
from lapreplay.llm.elias_fano import packed, runs, unpacked

#: Bytes of item terms that one pass over the documents may send to all tasks; more items take more passes.
TERM_BYTES = 8_000_000


def postings(batches: Iterator[pa.RecordBatch], terms: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of documents of some ``size`` words: the postings of ``terms`` (sorted hashes), sorted by term, and by term their documents."""
    rows, lengths, found, n = [], [], [], 0

    def block() -> pa.RecordBatch:
        term, doc, tf = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(term, kind="stable")
        df = np.bincount(term, minlength=len(terms))
        some = np.flatnonzero(df)
        cells = [np.array(lengths, "i8"), some.astype("u4"), df[some].astype("u4"), doc[order].astype("u4"), tf[order].astype("u4")]
        raw = packed(cells)
        return pa.RecordBatch.from_arrays([
            pa.array([rows], pa.list_(pa.int64())), pa.array([sum(x > 0 for x in lengths)]), pa.array([sum(lengths)]), pa.array([terms[some]], pa.list_(pa.int64())), pa.array([df[some]], pa.list_(pa.int64())),
            pa.array([np.array([len(raw)], "i8").tobytes() + pa.compress(raw, "zstd", asbytes=True)], pa.binary()),
        ], ["rows", "n_docs", "n_words", "terms", "df", "payload"])

    for batch in batches:
        ids, lists = batch.column("_row").to_pylist(), batch.column("_words")
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        at = np.minimum(np.searchsorted(terms, flat), max(len(terms) - 1, 0))
        known = terms[at] == flat if len(terms) else np.zeros(len(flat), bool)
        for k, row in enumerate(ids):
            mine = slice(ends[k], ends[k + 1])
            each = np.sort(at[mine][known[mine]])
            first = runs(each)
            found.append((each[first], np.full(len(first), len(rows)), np.diff(np.append(first, len(each)))))
            rows.append(row)
            lengths.append(int(ends[k + 1] - ends[k]))
            n += lengths[-1]
            if n >= size:
                yield block()
                rows, lengths, found, n = [], [], [], 0
    if rows:
        yield block()


class Best:
    """The best documents of one item so far: ``scores`` and ``rows``, in no order, and the score that a document must reach."""

    def __init__(self, k: int):
        self.k, self.scores, self.rows, self.floor = k, np.zeros(0, "i8"), np.zeros(0, "i8"), 1

    def add(self, scores: np.ndarray, rows: np.ndarray) -> None:
        """Keep the k best. Equal scores at the end all stay: only the ids, which are compared later, decide between them."""
        scores, rows = np.append(self.scores, scores), np.append(self.rows, rows)
        if len(scores) > self.k:
            self.floor = max(self.floor, int(np.partition(scores, -self.k)[-self.k]))
            kept = scores >= self.floor
            scores, rows = scores[kept], rows[kept]
        self.scores, self.rows = scores, rows


def search(best: Best, wanted: np.ndarray, impacts: list[tuple[np.ndarray, np.ndarray, int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact scores of a block's documents that may be among an item's best.

    ``wanted``: the item's terms that the block has, rarest first. ``impacts``: by term its documents, what it adds to the score
    of each, and the most of that.
    """
    score, made = np.zeros(n, "i8"), np.zeros(n, bool)
    left = sum(impacts[t][2] for t in wanted.tolist())
    creating = True
    for t in wanted.tolist():
        doc, add, most = impacts[t]
        if creating:
            kth = best.floor
            if left < kth or int(made.sum()) >= best.k:
                if made.any() and int(made.sum()) >= best.k:
                    kth = max(kth, int(np.partition(score[made], -best.k)[-best.k]))
                creating = left >= kth
        if creating:
            made[doc] = True
            score[doc] += add
        else:
            own = made[doc]
            score[doc[own]] += add[own]
        left -= most
    at = np.flatnonzero(made & (score >= best.floor))
    return score[at], at


def ranked(batches: Iterator[pa.RecordBatch], items: list[tuple[int, np.ndarray]], weights: np.ndarray, docs: int, words: int, k: int) -> Iterator[pa.RecordBatch]:
    """Each item's best documents of a task. ``items``: number and terms, rarest first."""
    best = [Best(k) for _ in items]
    for batch in batches:
        for rows, payload in zip(batch.column("rows"), batch.column("payload"), strict=True):
            rows, raw = np.array(rows.as_py(), "i8"), payload.as_py()
            n, some, df, doc, tf = (x.astype("i8") for x in unpacked(pa.decompress(raw[8:], int(np.frombuffer(raw, "i8", 1)[0]), "zstd", asbytes=True)))
            m = 50 + (50 * n * docs) // max(words, 1)
            ends = np.cumsum(df)
            add = np.repeat(weights[some], df) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
            most = np.maximum.reduceat(add, ends - df) if len(df) else df
            impacts = [(doc[e - c : e], add[e - c : e], int(x)) for e, c, x in zip(ends.tolist(), df.tolist(), most.tolist(), strict=True)]
            place = np.full(len(weights), -1)
            place[some] = np.arange(len(some))
            for b, (_, terms) in zip(best, items, strict=True):
                mine = place[terms]
                scores, at = search(b, mine[mine >= 0], impacts, len(n))
                b.add(scores, rows[at])
    for b, (item, _) in zip(best, items, strict=True):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.rows), item)), pa.array(b.rows), pa.array(b.scores)], ["_item", "_row", "score"])


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = 500_000, term_bytes: int = TERM_BYTES) -> DataFrame:
    """The ``k`` best documents of each item, all that score above 0 if there are fewer; equal scores by ascending id.

    Items are taken in blocks of at most ``term_bytes`` of terms, which go to all tasks; each block takes one pass. Null texts have
    no terms; rows that repeat an id, of items too, are ranked each by itself, in the order of their rows; null ids come
    after others; items without a match have no row; empty tables give an empty one.
    """
    d = text_rows(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("_row"), "_id", word_hashes(F.col("_text")).alias("_words"))
    asked = text_rows(items, item_col, item_text_col).select(F.monotonically_increasing_id().alias("_item"), F.col("_id").alias("item_id"), F.array_distinct(word_hashes(F.col("_text"))).alias("terms"))
    asked = written(asked, "items")
    size = 8 * (asked.agg(F.sum(F.size("terms") + 2)).first()[0] or 0)
    passes = -(-size // term_bytes) or 1
    named = written(d.select("_row", "_id"), "rows")
    parts = []
    for i in range(passes):
        some = asked.filter(F.pmod(F.xxhash64("_item"), F.lit(passes)) == i)
        parts.append(written(best_of(d, some, k, block_words).join(named, "_row"), "best"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    order = Window.partitionBy("_item").orderBy(F.col("score").desc(), F.col("_id").asc_nulls_last(), "_row")
    out = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return out.join(asked.select("_item", "item_id"), "_item").select("item_id", "rank", F.col("_id").alias("doc_id"), "score")


def best_of(d: DataFrame, asked: DataFrame, k: int, block_words: int) -> DataFrame:
    """What may be among the ``k`` best documents of each item: ``_item, _row, score``, of each task of the last pass."""
    wanted = [(r["_item"], np.array(r["terms"], "i8")) for r in asked.select("_item", "terms").collect()]  # TERM_BYTES at most
    terms = np.unique(np.concatenate([t for _, t in wanted])) if wanted else np.zeros(0, "i8")
    blocks = d.select("_row", "_words").mapInArrow(partial(postings, terms=terms, size=block_words), "rows array<long>, n_docs long, n_words long, terms array<long>, df array<long>, payload binary")
    blocks = written(blocks, "postings")
    docs, words = (int(x or 0) for x in blocks.agg(F.sum("n_docs"), F.sum("n_words")).first())
    held = blocks.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy("t.terms").agg(F.sum("t.df").alias("df")).collect()  # the items' terms at most
    df = np.zeros(len(terms), "i8")
    for r in held:
        df[np.searchsorted(terms, r["terms"])] = r["df"]
    weights = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * n + 1))) for n in df.tolist()], "i8")
    places = [(item, np.searchsorted(terms, t)) for item, t in wanted]
    places = [(item, t[np.argsort(df[t], kind="stable")]) for item, t in places]
    return blocks.select("rows", "payload").mapInArrow(partial(ranked, items=places, weights=weights, docs=docs, words=words, k=k), "_item long, _row long, score long")


#: The same result in SQL, over the tables ``documents`` and ``benchmark``.
SQL = r"""
WITH d AS (
  SELECT doc_id, unnest(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM documents
), b AS (
  SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM benchmark
), tf AS (
  SELECT doc_id, term, count(*)::BIGINT AS tf FROM d GROUP BY ALL
), len AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL
), total AS (
  SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM len
), w AS (
  SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total WHERE term IN (SELECT term FROM b) GROUP BY term, big_n
), scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l))))::BIGINT AS score
  FROM b JOIN w USING (term) JOIN tf USING (term) JOIN len USING (doc_id), total GROUP BY ALL
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 50
"""
