"""Checks that are measured while a result is written, and the draft that holds it until they are known.

``Checks`` attaches rules to points of a plan as observed metrics. One write of the plan's result to a draft
runs it and measures all of them; then the draft is read in place of the plan, or dropped and the first broken rules
raised. Rules only ask whether a count is zero, so tasks that run twice after a lost executor change no verdict.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lapreplay.schemas import RaceDataError


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path that the driver and all executors see. Only a driver without executors may use its own folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='lapreplay-')}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Watch(NamedTuple):
    """What is asked at one point of a plan. ``some``: the message where no row comes by, or None."""

    observation: Observation
    rules: Sequence[tuple[str, str]]
    error: type[RaceDataError]
    some: str | None


def counted(observation: Observation) -> dict[str, int]:
    """What was counted, nothing where Spark left that part of the plan out, since no row can reach it."""
    try:
        return observation.get
    except Py4JJavaError as e:
        if "toPyRow" not in str(e):
            raise
        return {}


class Checks:
    """Rules attached to a plan, in the order in which they are to be raised."""

    def __init__(self) -> None:
        self.watches: list[Watch] = []

    def watch(self, df: DataFrame, rules: Sequence[tuple[str, str, Column]], error: type[RaceDataError], some: str | None = None) -> DataFrame:
        """``df``, whose rows that break a rule (code, message, condition) are counted when the plan runs."""
        w = Watch(Observation(f"checks-{uuid.uuid4().hex}"), [(code, message) for code, message, _ in rules], error, some)
        self.watches.append(w)
        return df.observe(w.observation, F.count(F.lit(1)).alias("rows"), *[F.count_if(breaks).alias(f"n{i}") for i, (_, _, breaks) in enumerate(rules)])

    def enforce(self) -> None:
        """Raise the first five broken rules. The plan must have run."""
        for w in self.watches:
            got = counted(w.observation)
            if w.some and not got.get("rows"):
                raise w.error(w.some)
            broken = [f"{code}: {message} ({got[f'n{i}']} rows)" for i, (code, message) in enumerate(w.rules) if got.get(f"n{i}")]
            if broken:
                raise w.error("; ".join(broken[:5]))

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        """``df``, computed once into a draft and read from it. The draft is dropped where a rule is broken."""
        spark, path = df.sparkSession, folder(df.sparkSession, name)
        try:
            df.write.parquet(path)
            self.enforce()
        except BaseException:
            remove(spark, path)
            raise
        return spark.read.schema(df.schema).parquet(path)
