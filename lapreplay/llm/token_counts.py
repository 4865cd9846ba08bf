"""Token counts through a digest cache.

The cache is a table of (text digest, tokenizer digest, tokens). Documents are joined to it by the
digest of their normalised text and of the tokenizer's file; only distinct misses are encoded, and
their counts are appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapreplay.llm.common import scratch, text_rows, written
from lapreplay.llm.tokens import batches, encoder

CACHE = "digest binary, tokenizer string, n_tokens bigint"


def tokenizer_digest(path: str) -> str:
    """Names the tokenizer's version: the digest of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def count_batches(rows: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        digests, texts = batch.column("digest"), batch.column("_text").to_pylist()
        for at, part in batches(texts):
            yield pa.RecordBatch.from_arrays([digests.slice(at, len(part)), pa.array(encoder(path).counts(part))], ["digest", "n_tokens"])


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", blanks_count: bool | None = None) -> DataFrame:
    """Tokens of every document by the vocabulary file ``tokenizer`` (a path that all executors can open).

    ``cache``: a folder that keeps counts from call to call; a fresh one when None. For vocabularies that drop
    white space, texts that differ in it alone share an entry. Null texts count as empty, with 0 tokens; repeated ids
    give a row each; an empty table gives an empty one and leaves the cache as it was. A text is encoded once even if
    its copies are a third of all rows: copies meet after each task has dropped its own. Counts of the few digests that
    make up more than 1/5,000 of the rows each are sent to all tasks; only the other rows are shuffled to their counts.
    """
    spark = docs.sparkSession
    cache = cache or scratch(spark, "token-cache")
    version = tokenizer_digest(tokenizer)
    blanks_count = (not encoder(tokenizer).words_only) if blanks_count is None else blanks_count
    d = text_rows(docs, id_col, text_col)
    normal = F.col("_text") if blanks_count else F.trim(F.regexp_replace("_text", r"[ \t\n\r]+", " "))
    keyed = d.select("_id", F.octet_length("_text").cast("long").alias("n_bytes"), normal.alias("_text"))
    keyed = keyed.withColumn("digest", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)))
    stored = known(spark, cache, version)
    distinct = keyed.select("digest", "_text").dropDuplicates(["digest"])
    misses = distinct.join(stored.select("digest"), "digest", "left_anti") if not stored.isEmpty() else distinct
    counted = misses.mapInArrow(partial(count_batches, path=tokenizer), "digest binary, n_tokens bigint")
    counted.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    narrow = written(keyed.select("_id", "n_bytes", "digest"), "digests")
    often = narrow.groupBy("digest").agg(F.count("*").alias("copies")).filter(F.col("copies") > max(1000, narrow.count() // 5000))
    stored, often = known(spark, cache, version), written(often.select("digest"), "often")  # 5,000 rows at most
    hot = stored.join(F.broadcast(often), "digest", "left_semi")
    rest = narrow.join(F.broadcast(often), "digest", "left_anti").join(stored, "digest")
    out = narrow.join(F.broadcast(hot), "digest").unionByName(rest)
    return out.select(F.col("_id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def known(spark, cache: str, version: str) -> DataFrame:
    """Counts by ``digest`` of one tokenizer version."""
    return read_cache(spark, cache).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def read_cache(spark, cache: str) -> DataFrame:
    """All entries; none where the folder has yet to be made. Concurrent appends may repeat an entry."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(cache)
