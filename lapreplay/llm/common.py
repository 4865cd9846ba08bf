"""Shared folder, written intermediate tables and column preparation."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in rows, that these operators broadcast. Callers count first; past it Spark joins by shuffle.
BROADCAST_ROWS = 1_000_000
#: Whether Spark removes the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that go to a Python worker at a time.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Paths of tables that the current ``written_alone`` has written, by thread.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)
_settings = threading.RLock()


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: spark.checkpoint.dir. Where it is unset, a driver without executors uses its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lapreplay-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later reads survive lost executors and compute nothing twice.

    The folder belongs to the application, whose results may read from it until they are stored: remove it after that.
    """
    path = scratch(df.sparkSession, name)
    out = store(df, path)
    made = _made.get()
    if made is not None:
        made.append(path)
    return out


def store(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to ``path`` and read it back. The shuffle files of the write go when it has ended."""
    conf = df.sparkSession.conf
    with _settings:  # of a session that several threads may share: each setting is put back by the one that changed it
        _writers[0] += 1
        if _writers[0] == 1:
            _before.update({k: conf.get(k) for k in (CLEANUP, BATCH_ROWS)})
            conf.set(CLEANUP, "true")  # nothing reads the shuffles of this write again
            conf.set(BATCH_ROWS, "1000" if int(_before[BATCH_ROWS]) <= 0 else str(min(1000, int(_before[BATCH_ROWS]))))  # rows here hold texts and sets
    try:
        df.write.parquet(path)
    finally:
        with _settings:
            _writers[0] -= 1
            if not _writers[0]:
                for k, v in _before.items():
                    conf.set(k, v)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Writes under way, and what the settings were before the first of them.
_writers = [0]
_before: dict[str, str] = {}


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def forget(df: DataFrame) -> None:
    """Remove a written table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, path)


def written_alone(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``make()``, written like above; the tables that were written to make it are removed then."""
    before, mine = _made.get(), []
    _made.set(mine)
    try:
        out = written(make(), name)
    finally:
        _made.set(before)
    for p in mine[:-1]:
        remove(spark, p)
    if before is not None:
        before.append(mine[-1])
    return out


def text_rows(docs: DataFrame, id_col: str, text_col: str, **more: str) -> DataFrame:
    """Only the columns an operator needs, under internal names, so that other columns can't clash. Null text is empty."""
    return docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"),
        *[F.col(c).alias(name) for name, c in more.items()],
    )


def ngram_hashes(hashes: Column, n: int) -> Column:
    """Hash of every run of ``n`` elements of an array of word hashes; empty for shorter arrays."""
    heads = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (n - 1), F.lit(0)))
    return F.transform(heads, lambda _, i: F.xxhash64(*[F.get(hashes, i + j) for j in range(n)]))
