"""Queries over the shared tables, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from lapreplay.llm import align_tokens, compaction, decontaminate, html_text, lm_score, pack, pii, prefix_join, quality_crf, quality_rules, ranked_search, token_counts, token_files


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op6_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_join.similar_classes(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.shard_documents(table(spark, sf_dir, "documents"))


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens.align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def importable(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``query``, whose tasks find this package where the driver has it, whatever the working directory."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
        env = spark.sparkContext.environment
        if root not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))
        return query(spark, sf_dir)

    return run


_ALL = (op1_quality_rules, op2_token_files, op3_html_text, op4_decontaminate, op5_pii, op6_prefix_join, op7_token_counts, op8_quality_crf, op9_pack, op10_compaction, op11_lm_scores, op12_ranked_search, op13_align_tokens)
QUERIES = {f.__name__: importable(f) for f in _ALL} | {"pipeline": importable(corpus_pipeline.run)}

SQL = {"op1_quality_rules": quality_rules.SQL, "op4_decontaminate": decontaminate.SQL, "op12_ranked_search": ranked_search.SQL}
