"""Grammars of token shards: against replacing one pair at a time, and on hostile shards."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from lapreplay.llm import token_files, tokens
from lapreplay.llm.queries import vocabulary

DIVIDE = 1 << 31


def one_at_a_time(docs, least):
    """Symbols left when the most frequent pair is replaced, again and again, while it occurs ``least`` times."""
    seq = np.array([x for i, d in enumerate(docs) for x in (*d.tolist(), DIVIDE + i)], "u8")
    name = 1 << 20
    while True:
        pairs = seq[:-1] << np.uint64(32) | seq[1:]
        inside = (seq[:-1] < DIVIDE) & (seq[1:] < DIVIDE)
        found, count = np.unique(pairs[inside], return_counts=True)
        if not len(found) or count.max() < least:
            return int((seq < DIVIDE).sum())
        best = found[count.argmax()]
        at, last, take = np.flatnonzero(inside & (pairs == best)), -2, []
        for i in at.tolist():
            if i > last + 1:
                take.append(i)
                last = i
        if len(take) < least // 2:
            return int((seq < DIVIDE).sum())
        seq[take] = name
        name += 1
        keep = np.ones(len(seq), bool)
        keep[np.array(take) + 1] = False
        seq = seq[keep]


@pytest.fixture(scope="module")
def docs():
    rows = sorted(pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist(), key=lambda r: r["doc_id"])
    ids = tokens.Encoder(vocabulary("word_bpe_49k.json")).encode([r["text"] or "" for r in rows[:60]])
    return [np.append(x, np.uint32(1)).astype("<u4") for x in ids]


def test_as_small_as_one_pair_at_a_time(docs):
    shard = token_files.Shard(token_files.compress(docs))
    assert all((a == b).all() for a, b in zip(docs, shard.documents(), strict=True))
    assert len(shard.symbols) <= 1.05 * one_at_a_time(docs, 8) < sum(map(len, docs))


def test_no_frequent_pair_is_left(docs):
    shard = token_files.Shard(token_files.compress(docs))
    inside = np.ones(len(shard.symbols) - 1, bool)
    inside[shard.where[1:-1].astype("i8") - 1] = False
    pairs = (shard.symbols[:-1].astype("u8") << np.uint64(32) | shard.symbols[1:])[inside]
    found, count = np.unique(pairs, return_counts=True)
    assert (count >= 8).mean() < 0.001  # but for pairs that overlap others at most places


@pytest.mark.parametrize("kind", ["one id", "two ids", "copies", "all different", "short"])
def test_hostile_shards(kind):
    rng = np.random.default_rng(1)
    long = rng.integers(0, 50_000, 20_000)
    docs = {
        "one id": [np.full(300_001, 7)], "two ids": [np.tile([1, 2], 100_000), np.array([2])], "copies": [long] * 12,
        "all different": [np.arange(100_000)], "short": [np.array([i % 3]) for i in range(5_000)] + [np.zeros(0, "i8")],
    }[kind]
    docs = [d.astype("<u4") for d in docs]
    shard = token_files.Shard(token_files.compress(docs))
    assert all((a == b).all() for a, b in zip(docs, shard.documents(), strict=True))
    k = len(docs) // 2
    n = len(docs[k])
    assert (shard.document(k, n // 3, n // 2) == docs[k][n // 3 : n // 2]).all()
    if kind in ("one id", "two ids", "copies"):
        assert shard.sizes.max() >= 4_096 and len(shard.symbols) < 0.1 * sum(map(len, docs))
