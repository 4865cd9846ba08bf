"""Prefix hashes that most sets share, ordered paths of links, and rows that repeat an id."""

import itertools
import random

import pytest

from lapreplay.llm import components, prefix_join


def brute_force(texts, n, num, den):
    sets = {i: {tuple(t.split()[k : k + n]) for k in range(max(1, len(t.split()) - n + 1))} for i, t in texts}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {i: top(i) for i in sets}


@pytest.mark.parametrize("seed", [1, 2])
def test_chunks_of_hot_hashes(spark, monkeypatch, seed):
    """One base text with few or many words changed: all share hashes, some link, others lie just below the threshold."""
    for name, value in (("FEW", 5), ("MANY", 11), ("SAMPLE", 1), ("HOT", 4), ("BLOCK", 16)):
        monkeypatch.setattr(prefix_join, name, value)
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(160):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            words[rng.randrange(120)] = f"x{rng.randrange(40)}"
        texts.append((i, " ".join(words)))
    texts += [(500 + i, " ".join([*base[:60], *(f"y{i // 2}z{j}" for j in range(60 + i % 2))])) for i in range(60)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in prefix_join.similar_classes(d).collect()}
    want = brute_force(texts, 3, 90, 100)
    assert got == want and 1 < len(set(want.values())) < len(texts)


def test_hot_hashes_are_found(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(prefix_join, "SAMPLE", 1)
    texts = [(i, " ".join([*(f"w{j}" for j in range(80)), f"own{i}"])) for i in range(100)] + [(1000 + i, f"short text {i}") for i in range(50)]
    sets, _ = prefix_join.grouped(spark.createDataFrame(texts, "doc_id long, text string"), 3, 90, 100, "doc_id", "text")
    tokens, counts = prefix_join.hot_tokens(sets, spark.sparkContext.broadcast(np.zeros(0, "i8")), 90, 100)
    assert len(tokens) and (np.diff(tokens) > 0).all() and (counts >= 40).all() and counts.max() <= 100


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    rounds = []
    keep = components.written
    monkeypatch.setattr(components, "written", lambda df, name: (rounds.append(name), keep(df, name))[1])
    links = spark.range(400).selectExpr("id as a", "id + 1 as b").unionByName(spark.createDataFrame([(7000 - i, 9000) for i in range(50)], "a long, b long"))
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(401)}, **{7000 - i: 6951 for i in range(50)}, 9000: 6951}
    assert rounds.count("least") <= 14


def test_one_row_of_each(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a, 1), (5, a, 2), (9, a + " more", 3), (7, b, 4), (7, a, 5), (7, "", 6), (7, "", 7), (None, b, 8), (None, None, 9), (8, "other words", 10)]
    got = prefix_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, v int"))
    assert got.columns == ["doc_id", "text", "v"]
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert kept == sorted([(5, a), (7, b), (7, ""), (None, None), (8, "other words")], key=str)


def test_clashing_names(spark):
    d = spark.createDataFrame([(1, "one two three four", 1, 2, 3, 4, 5)], "doc_id long, text string, _h int, _doc int, _kept int, root int, first int")
    assert prefix_join.one_of_each(d).collect() == d.collect()


def test_a_large_group_lists_few_pairs(spark, monkeypatch):
    """Changes of their own come first in the order of hashes, so first shared hashes tear the group; a second block mends that."""
    pairs = []
    keep = prefix_join.written

    def written(df, name):
        out = keep(df, name)
        if name == "pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(prefix_join, "written", written)
    rng, size = random.Random(5), 500
    base, texts = [f"w{i}" for i in range(150)], []
    for i in range(size):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 3])):
            words[rng.randrange(150)] = f"x{rng.randrange(6)}"
        texts.append((i, " ".join(words)))
    _, keys = prefix_join.grouped(spark.createDataFrame(texts, "doc_id long, text string"), 5, 80, 100, "doc_id", "text")
    want = brute_force(texts, 5, 80, 100)
    assert keys.select("root").distinct().count() == len(set(want.values()))
    assert pairs[0] < 4 * size
