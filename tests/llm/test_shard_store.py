"""Shards over many arrivals: target-sized files, versions that stay readable, one winner of two commits."""

import pytest
from pyspark.sql import functions as F

from lapreplay.llm.compaction import FULL, ShardStore, shard_documents


def arrival(spark, k, rows=10, size=100):
    return spark.range(k * rows, (k + 1) * rows, 1, 1).select(F.col("id").alias("doc_id"), F.lpad(F.col("id").cast("string"), size, "x").alias("text"))


def ids(df):
    return sorted(r.doc_id for r in df.select("doc.doc_id").collect())


def test_many_small_arrivals(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", target=16_000, fan=4)
    assert store.manifest() == [] and store.read() is None and store.compact() == 0
    before = [store.append(arrival(spark, k)) for k in range(64)]
    assert len(store.manifest()) == 64
    store.compact()
    shards = store.manifest()
    assert len(shards) == 4 and all(s["bytes"] == 16_000 for s in shards)
    assert sum(s["rows"] for s in shards) == 640 and ids(store.read()) == list(range(640))
    for v in (1, 17, 64):
        assert ids(store.read(before[v - 1])) == list(range(10 * v))
    rows = store.read().select("folder", "shard", "position", "arrival", "seq").orderBy("folder", "shard", "position").collect()
    for a, b in zip(rows, rows[1:], strict=False):
        assert (a.folder, a.shard) != (b.folder, b.shard) or (a.arrival, a.seq) < (b.arrival, b.seq) and b.position == a.position + 1
    store.clean()
    assert store.versions() == [store.versions()[-1]] and ids(store.read()) == list(range(640))


def test_leftovers(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", target=16_000, fan=4)
    store.append(spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), F.lit("x" * 100).alias("text")))
    store.append(arrival(spark, 50, rows=7))
    store.compact(finish=False)
    open_ = [s for s in store.manifest() if s["bytes"] < FULL * 16_000]
    assert len(open_) > 1 and not store.runs(store.manifest())
    store.compact()
    assert sum(s["bytes"] < FULL * 16_000 for s in store.manifest()) <= 1 and store.read().count() == 407
    last = store.versions()[-1]
    assert store.compact() == last  # nothing is left to do


def test_two_writers(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    one, two = ShardStore(spark, path), ShardStore(spark, path)
    version = one.append(arrival(spark, 0))
    held = two.manifest(version)
    two.append(arrival(spark, 1))
    with pytest.raises(RuntimeError, match="another writer"):
        one.commit(held, version)
    assert ids(one.read()) == list(range(20)) and ids(one.read(version)) == list(range(10))
    assert not list((tmp_path / "s" / "drafts").glob("[0-9a-f]*"))


def test_long_text_and_small_target(spark):
    rows = [(1, "y" * 300_000), (2, None), (3, ""), (None, "z"), (1, "y" * 300_000)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 1_000).collect()
    assert sorted((str(r.doc_id), r.n_bytes) for r in got) == sorted((str(i), len(t or "")) for i, t in rows)
    assert len({(r.shard, r.position) for r in got}) == len(rows)
