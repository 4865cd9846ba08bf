"""From raw documents to packed training sequences, in five stages.

Each stage reads all that its predecessor kept: quality rules, one document of each group of near copies (five-word
shingles, similarity 0.8), no benchmark passages, personal data replaced, best-fit packing. Every result is written
and read again, so a lost executor costs the stage it hits at most; what a stage wrote on the way is removed after it.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapreplay.llm import decontaminate, pack, pii, prefix_join, quality_rules
from lapreplay.llm.common import written_alone


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return prefix_join.one_of_each(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in training sequences."""
    import public_tokenizers

    return pack.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", rules), ("near copies", copies), ("benchmark leaks", leaks), ("personal data", privacy), ("packing", packing)]

#: SQL can't express the boosted trees nor the packing; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written_alone(spark, partial(stage, spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
