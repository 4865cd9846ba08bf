"""Rules on rows, and what breaks them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapreplay.schemas import RACE, RaceDataError

ISSUES = ("code", "severity", "message", "affected_rows")
#: As ``row_id``: rows are known by the file that holds them and their place in it.
STORED = "_metadata"
PLACE = "_place"


class Rule(NamedTuple):
    """``breaks`` is true for rows that break the rule; null counts as unbroken."""

    code: str
    severity: str
    message: str
    breaks: Column


def violations(df: DataFrame, rules: Sequence[Rule], keys: Sequence[str] = RACE, row_id: str | None = None, samples: int = 5) -> DataFrame:
    """Broken rules per key with their rows counted, in one pass; with ``row_id`` also its first values as texts."""
    counts = df.groupBy(*keys).agg(*[F.count_if(r.breaks).alias(f"n{i}") for i, r in enumerate(rules)])
    cells = [F.struct(F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"), F.lit(r.message).alias("message"), F.col(f"n{i}").alias("affected_rows")) for i, r in enumerate(rules)]
    out = counts.select(*keys, F.inline(F.array(*cells))).filter("affected_rows > 0")
    if row_id is None:
        return out
    broken = F.array_compact(F.array(*[F.when(r.breaks, F.lit(r.code)) for r in rules]))
    rows = df.select(*keys, F.col(row_id).alias("_row"), broken.alias("_codes")).select(*keys, "_row", F.explode("_codes").alias("code"))
    first = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "code").orderBy("_row"))).filter(F.col("_k") <= samples)
    listed = first.groupBy(*keys, "code").agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_row"))), lambda x: x["_row"].cast("string")).alias("sample_rows"))
    listed = listed.select(*[F.col(k).alias(f"_of_{k}") for k in (*keys, "code")], "sample_rows")  # keys may be null
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in (*keys, "code")])
    return out.join(listed, same, "left").select(*keys, *ISSUES, "sample_rows")


def with_stored_place(df: DataFrame) -> DataFrame:
    """Adds ``_place``, file name and row number, to rows that come from files, in whatever order: texts that sort as the rows are stored."""
    place = F.concat_ws(":", F.element_at(F.split("_metadata.file_path", "/"), -1), F.lpad(F.col("_metadata.row_index").cast("string"), 12, "0"))
    return df.select("*", place.alias(PLACE))


def enforce(issues: DataFrame, error: type[RaceDataError]) -> None:
    """Raise ``error`` naming the first broken rules of severity error; warnings never raise."""
    found = issues.filter("severity = 'error'").limit(5).collect()
    if found:
        raise error("; ".join(f"{r['code']}: {r['message']} ({r['affected_rows']} rows)" for r in found))


def summary(issues: DataFrame, keys: Sequence[str] = RACE) -> DataFrame:
    """Errors and warnings per key."""
    kind = lambda s: F.count_if(F.col("severity") == s)
    out = issues.groupBy(*keys).agg(kind("error").alias("error_count"), kind("warning").alias("warning_count"))
    return out.withColumns({"has_errors": F.col("error_count") > 0, "has_warnings": F.col("warning_count") > 0})


def repeated(*key: str) -> Column:
    """True for all copies of rows that share a key; nulls equal each other."""
    return F.count("*").over(Window.partitionBy(*key)) > 1


def missing_keys(df: DataFrame, others: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct keys of ``df`` that ``others`` lacks; null keys equal each other."""
    there = others.select(*[F.col(k).alias(f"_of_{k}") for k in key])
    return df.select(*key).distinct().join(there, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in key]), "left_anti")


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that several rows have, and how many."""
    return df.groupBy(*key).agg(F.count("*").alias("copies")).filter("copies > 1")
