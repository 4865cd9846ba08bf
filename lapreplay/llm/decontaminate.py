"""Benchmark decontamination by winnowing.

Test items are cut into windows of ten words. A window's fingerprint is the smallest hash among its six
five-word grams, so a shared window always has a shared fingerprint, and runs of windows with one
fingerprint travel as one row. Document fingerprints are joined to those of the items; each hit is then
extended to the windows of its run, which are compared by the hash of all ten words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapreplay.llm.common import BROADCAST_ROWS, ngram_hashes, text_rows, written

#: Everything that isn't part of a word, before lower-casing.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GRAM, WINDOW = 5, 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(w: Column) -> Column:
    """A-Z in lower case, nothing else changed; most words are ASCII, for which lower() does that."""
    return F.when(F.length(w) == F.octet_length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))


def word_hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, BREAK, -1), lambda w: w != ""), lambda w: F.xxhash64(lower_ascii(w)))


def runs(d: DataFrame) -> DataFrame:
    """Adds ``_runs``: for each run of windows with one fingerprint, the fingerprint, first position and window hashes."""
    d = d.withColumn("_grams", ngram_hashes(F.col("_words"), GRAM))
    heads = F.slice("_grams", F.lit(1), F.greatest(F.size("_grams") - (WINDOW - GRAM), F.lit(0)))  # one for each window
    gram = lambda i, j: F.get(F.col("_grams"), i + j)
    d = d.withColumn("_least", F.transform(heads, lambda _, i: F.least(*[gram(i, j) for j in range(WINDOW - GRAM + 1)])))
    d = d.withColumn("_whole", F.transform(heads, lambda g, i: F.xxhash64(g, gram(i, WINDOW - GRAM))))
    same = lambda x, i: F.coalesce(F.get(F.col("_least"), i - 1) == x, F.lit(False))
    starts = F.filter(F.transform("_least", lambda x, i: F.when(~same(x, i), i)), lambda i: i.isNotNull())
    d = d.withColumn("_starts", starts)
    # Both sizes are the same. Each array is named twice here, else Catalyst would move its making into the lambda.
    size = F.greatest(F.size("_least"), F.size("_whole"))
    end = lambda j: F.coalesce(F.get(F.col("_starts"), j + 1), size)
    run = lambda s, j: F.struct(F.get(F.col("_least"), s).alias("fp"), s.alias("at"), F.slice(F.col("_whole"), s + 1, end(j) - s).alias("whole"), F.lit(WINDOW).alias("n"))
    return d.withColumn("_runs", F.transform("_starts", run))


def short_grams(d: DataFrame, sizes: list[int]) -> Column:
    """Runs of one window for each gram of the given sizes below ten words."""
    one = lambda n: lambda h, i: F.struct(h.alias("fp"), i.alias("at"), F.array(h).alias("whole"), F.lit(n).alias("n"))
    return F.concat(*[F.transform(ngram_hashes(F.col("_words"), n), one(n)) for n in sizes])


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Windows of the test items: ``item, fp, whole, n``. Items of fewer than ten words are one window; of none, no row."""
    d = text_rows(items, id_col, text_col).filter(F.col("_id").isNotNull()).select("_id", word_hashes(F.col("_text")).alias("_words"))
    long = runs(d.filter(F.size("_words") >= WINDOW)).select(F.col("_id").cast("string").alias("item"), F.explode_outer("_runs").alias("r"))
    long = long.select("item", F.lit(WINDOW).alias("n"), "r.fp", F.explode_outer("r.whole").alias("whole"))
    short = d.filter(F.size("_words").between(1, WINDOW - 1)).select(F.col("_id").cast("string").alias("item"), F.size("_words").alias("n"), "_words")
    whole = F.when(F.lit(False), F.lit(0).cast("long"))
    for n in range(1, WINDOW):
        whole = whole.when(F.col("n") == n, F.get(ngram_hashes(F.col("_words"), n), F.lit(0)))
    short = short.select("item", "n", whole.alias("fp"), whole.alias("whole"))
    return long.unionByName(short).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Words of each document that lie in a window of a test item, and the items.

    The item windows are broadcast while they take no more than ``broadcast_rows`` do with 24 bytes of id, and joined by shuffle beyond.
    A null text has no words; repeated ids give a row each; items with a null id are left out; an empty table of
    items hits nothing. Items with the same text all count.
    """
    d = text_rows(docs, id_col, text_col)
    d = d.select(F.monotonically_increasing_id().alias("_row"), "_id", word_hashes(F.col("_text")).alias("_words"))
    return hits(d, item_windows(items, item_col, item_text_col), broadcast_rows).drop("_spans")


def hits(d: DataFrame, windows: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``d``: ``_row, _id, _words`` (word hashes). Adds up hits; ``_spans`` has the covered windows, in words."""
    windows = written(windows, "windows")
    size = windows.agg(F.sum(F.octet_length(F.col("item").cast("string")) + 24)).first()[0] or 0
    small = size <= 48 * broadcast_rows  # bytes: windows of items with ids of usual length
    sized = F.broadcast if small else lambda x: x
    short = sorted(r["n"] for r in windows.filter(F.col("n") < WINDOW).select("n").distinct().collect())  # nine at most
    every = F.concat(F.col("_runs"), short_grams(d, short)) if short else F.col("_runs")
    mark = F.struct(F.lit(None).cast("long").alias("fp"), F.lit(-1).alias("at"), F.array().cast("array<bigint>").alias("whole"), F.lit(0).alias("n"))
    # The mark keeps documents that hit nothing. An inner explode would get a filter on the array's size, pushed down as all of its making.
    d = runs(d).select("_row", "_id", F.size("_words").cast("long").alias("n_words"), F.explode_outer(F.array_append(every, mark)).alias("r"))
    d = d.select("_row", "_id", "n_words", "r.fp", "r.at", "r.whole", "r.n")
    d = d.join(sized(windows.select("fp").distinct().withColumn("_known", F.lit(True))), "fp", "left")
    d = d.filter(F.col("_known") | (F.col("at") == -1))
    d = d.select("_row", "_id", "n_words", "at", "n", F.posexplode_outer("whole").alias("k", "whole"))
    d = d.join(sized(windows.select("item", "whole", "n").distinct()), ["whole", "n"], "left")
    d = d.filter(F.col("item").isNotNull() | (F.col("at") == -1))
    start = F.col("at") + F.coalesce("k", F.lit(0))
    span = F.when(F.col("item").isNotNull(), F.struct(start.alias("s"), (start + F.col("n")).alias("e")))
    d = d.groupBy("_row").agg(F.first("_id").alias("_id"), F.max("n_words").alias("n_words"), F.collect_set(span).alias("_spans"), F.collect_set("item").alias("_items"))
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end"))
    add = lambda a, x: F.struct((a["sum"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["end"]))).alias("sum"), F.greatest(a["end"], x["e"]).alias("end"))
    covered = F.aggregate(F.sort_array("_spans"), zero, add, lambda a: a["sum"])
    return d.select(
        F.col("_id").alias("doc_id"), "n_words", covered.cast("long").alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.sort_array("_items")), 256).alias("items_sha256"), (F.size("_items") > 0).alias("contaminated"), "_spans",
    )


def without_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The documents that hold no window of a test item, all columns kept. Rows are matched by id and text."""
    key = [F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))]
    tagged = docs.select(F.struct(key[0].alias("id"), key[1].alias("hash")).alias("_key"), F.col(text_col).alias("_t"))
    clean = decontaminate(tagged, items, "_key", "_t", **more).filter("not contaminated")
    clean = clean.select(F.col("doc_id.id").alias("_kept"), F.col("doc_id.hash").alias("_hash")).distinct()
    return docs.join(clean, key[0].eqNullSafe(clean["_kept"]) & (key[1] == clean["_hash"]), "left_semi")


#: The same result in SQL, over the tables ``documents`` and ``benchmark``.
SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id::VARCHAR AS item, n, list_slice(w, i, i + n - 1) AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)
), hit AS (
  SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, g)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_items, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
