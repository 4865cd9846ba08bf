"""Host-level quality rules.

Every document is measured and tried against per-document rules. Failures are summed by host, each
rule's failure rate is shrunk towards an empirical beta prior fitted over all hosts, and the verdict on
the host is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapreplay.llm.common import ngram_hashes, text_rows, written

#: ASCII white space between words.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
WINDOW = 8
RULES = ("short", "repeats", "symbols", "same_lines")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Measures and rule failures of each document; a null text has no words.

    Returns ``_id, _host`` and the measures, one row per input row, repeated ids included.
    """
    d = text_rows(docs, id_col, text_col, _host=host_col)
    d = d.select(
        "_id", "_host",
        F.transform(F.filter(F.split("_text", SPACE, -1), lambda w: w != ""), lambda w: F.xxhash64(w)).alias("_words"),
        F.filter(F.split("_text", "\n", -1), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0).alias("_lines"),
        F.length(F.regexp_replace("_text", SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", SYMBOLS, "")).cast("long").alias("n_symbols"),
    )
    d = d.select(
        "_id", "_host", "word_chars", "n_symbols",
        F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        ngram_hashes(F.col("_words"), WINDOW).alias("_windows"),
    )
    # Few documents repeat a window at all: only they sort theirs.
    d = d.withColumn("_repeats", F.size("_windows") > F.size(F.array_distinct("_windows")))
    d = d.withColumn("_sorted", F.when(F.col("_repeats"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda p, at: F.coalesce(F.get(F.col("_sorted"), at)["h"] == p["h"], F.lit(False))
    d = d.withColumn("_starts", F.when(F.col("_repeats"), F.sort_array(F.transform(F.filter("_sorted", lambda p, j: same(p, j - 1) | same(p, j + 1)), lambda p: p["i"]))))
    step = lambda s, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_starts"), j + 1) - s, F.lit(WINDOW)))
    covered = F.aggregate(F.transform("_starts", step), F.lit(0), lambda a, x: a + x)
    d = d.withColumn("n_repeat_words", F.coalesce(F.when(F.col("_repeats"), covered), F.lit(0)).cast("long"))
    return d.select(
        "_id", "_host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
        (F.col("n_words") < 20).alias("fails_short"),
        (100 * F.col("n_repeat_words") > 30 * F.col("n_words")).alias("fails_repeats"),
        (10 * F.col("n_symbols") > F.col("word_chars")).alias("fails_symbols"),
        (2 * F.col("n_dup_lines") > F.col("n_lines")).alias("fails_same_lines"),
    )


def host_verdicts(measures: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """One row per host: documents, each rule's shrunk failure rate, and whether any is above ``max_rate``.

    The beta prior of a rule has the pooled rate as mean and the spread of host rates, beyond what
    binomial noise explains, as variance (method of moments). Rows without a host belong to none.
    """
    hosts = measures.filter(F.col("_host").isNotNull()).groupBy("_host").agg(
        F.count("*").alias("n_docs"), *[F.count_if(f"fails_{r}").alias(f"k_{r}") for r in RULES]
    )
    hosts = written(hosts, "hosts")
    moments = hosts.agg(
        F.count("*").alias("hosts"), F.sum("n_docs").alias("n"), F.avg(1 / F.col("n_docs")).alias("inv"),
        *[F.sum(f"k_{r}").alias(f"k_{r}") for r in RULES],
        *[F.var_pop(F.col(f"k_{r}") / F.col("n_docs")).alias(f"v_{r}") for r in RULES],
    ).first()  # fmt: skip  # one row
    rates = []
    for r in RULES:
        a, b = beta_prior(moments["n"] or 0, moments[f"k_{r}"] or 0, moments[f"v_{r}"] or 0.0, moments["inv"] or 0.0)
        rates.append(((F.col(f"k_{r}") + a) / (F.col("n_docs") + (a + b))).alias(f"rate_{r}"))
    hosts = hosts.select("_host", "n_docs", *rates)
    return hosts.withColumn("host_rejected", F.greatest(*[F.col(f"rate_{r}") for r in RULES]) > max_rate)


def beta_prior(n: int, k: int, variance: float, inverse: float) -> tuple[float, float]:
    """Parameters of the beta prior from pooled counts and the variance of host rates. Strength stays within 2 and 1000."""
    mean = (k + 0.5) / (n + 1)
    own = max(variance - mean * (1 - mean) * inverse, 1e-9)
    strength = min(max(mean * (1 - mean) / own - 1, 2.0), 1000.0)
    return mean * strength, (1 - mean) * strength


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = 0.5) -> DataFrame:
    """Measures, rule failures and verdict of every document.

    A host is rejected when its shrunk rate of failing one rule is above ``max_rate``. One half is where a document of the host
    is more likely to break that rule than to keep it.

    ``base_failed``: fewer than 20 words, or over 30 % of the words in repeated 8-word windows. ``kept``: not
    ``base_failed`` and the host isn't rejected. Documents without a host are judged alone; null text fails as
    empty; repeated ids give a row each; an empty table gives an empty one.
    """
    measures = written(measure(docs, id_col, text_col, host_col), "measures")
    hosts = host_verdicts(measures, max_rate).select("_host", "host_rejected")
    out = measures.join(hosts, "_host", "left")
    failed = F.col("fails_short") | F.col("fails_repeats")
    rejected = F.coalesce(F.col("host_rejected"), F.lit(False))
    return out.select(
        F.col("_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~rejected).alias("kept"), rejected.alias("host_rejected"),
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = 0.5) -> DataFrame:
    """The documents that ``quality_rules`` keeps, with all their columns.

    Rows are matched by id, text and host, so rows that repeat an id are judged by their own text.
    """
    key = [F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(host_col))]
    tagged = docs.select(F.struct(key[0].alias("col1"), key[1].alias("col2")).alias("_key"), F.col(text_col).alias("_t"), F.col(host_col).alias("_h"))
    good = quality_rules(tagged, "_key", "_t", "_h", max_rate).filter("kept")
    good = good.select(F.col("doc_id.col1").alias("_id"), F.col("doc_id.col2").alias("_hash")).distinct()
    return docs.join(good, key[0].eqNullSafe(good["_id"]) & (key[1] == good["_hash"]), "left_semi")


#: The same result in SQL, over the table ``documents``.
SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), g AS (
  SELECT doc_id, i, list_slice(words, i, i + 7) AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1
), rep AS (
  SELECT doc_id, sum(least(8, coalesce(nx - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM r) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, source, len(words)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)
), f AS (
  SELECT *, (n_words < 20)::INT AS k1, (100 * n_repeat_words > 30 * n_words)::INT AS k2, (10 * n_symbols > word_chars)::INT AS k3, (2 * n_dup_lines > n_lines)::INT AS k4 FROM m
), long AS (
  SELECT source, 1 AS r, k1 AS k FROM f UNION ALL SELECT source, 2, k2 FROM f UNION ALL SELECT source, 3, k3 FROM f UNION ALL SELECT source, 4, k4 FROM f
), h AS (
  SELECT source, r, count(*) AS n, sum(k) AS k FROM long WHERE source IS NOT NULL GROUP BY source, r
), p AS (
  SELECT r, (sum(k) + 0.5) / (sum(n) + 1) AS mean, var_pop(k / n) AS v, avg(1 / n) AS inv FROM h GROUP BY r
), s AS (
  SELECT r, mean, least(greatest(mean * (1 - mean) / greatest(v - mean * (1 - mean) * inv, 1e-9) - 1, 2), 1000) AS z FROM p
), verdict AS (
  SELECT source, max((k + mean * z) / (n + z)) > 0.5 AS rejected FROM h JOIN s USING (r) GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, k1 + k2 > 0 AS base_failed,
       k1 + k2 = 0 AND NOT coalesce(rejected, false) AS kept, coalesce(rejected, false) AS host_rejected
FROM f LEFT JOIN verdict USING (source)
"""
