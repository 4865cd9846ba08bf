"""Chains of very many lines, and chains cut in blocks of any length."""

import itertools
import time

import numpy as np

from lapreplay.llm import quality_crf


def enumerated(score, transition):
    n = len(score)
    paths = np.array(list(itertools.product((0, 1), repeat=n)))
    z = paths @ score + transition[paths[:, :-1], paths[:, 1:]].sum(1)
    p = np.exp(z - np.logaddexp.reduce(z))
    pair = np.zeros((2, 2))
    np.add.at(pair, (paths[:, :-1], paths[:, 1:]), p[:, None] * np.ones(n - 1))
    return p @ paths, pair


def test_blocks_change_nothing():
    rng = np.random.default_rng(0)
    for counts in ([1], [2, 9, 1], [8, 7, 3, 10], [10]):
        score, transition = rng.normal(0, 2, sum(counts)), rng.normal(0, 1, (2, 2))
        ends = np.cumsum(counts)
        want = [enumerated(score[e - n : e], transition) for e, n in zip(ends, counts)]
        for block in (1, 2, 3, 4, 512):
            p, pair = quality_crf.marginals(score, np.array(counts), transition, block)
            assert np.allclose(p, np.concatenate([w[0] for w in want])) and np.allclose(pair, sum(w[1] for w in want))


def test_a_million_lines():
    rng = np.random.default_rng(1)
    counts = np.array([1_000_000, 3])
    score = rng.normal(0, 1, counts.sum())
    began = time.time()
    p, pair = quality_crf.marginals(score, counts, np.array([[1.0, -1.0], [-1.0, 1.0]]))
    assert time.time() - began < 20  # 1.5 s on an idle machine; a step for each line took a minute
    assert np.isfinite(p).all() and abs(pair.sum() - (counts - 1).sum()) < 1e-3


def test_learned_texts_are_bounded_by_lines(spark):
    docs = spark.createDataFrame([(i, "good line of words here\n" * 3 if i % 2 else "$$ ## !!") for i in range(1, 30)] + [(100, "\n" * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 30)] + [(100, 1)], "doc_id long, quality int")
    model = quality_crf.fit(docs, labels)
    without = quality_crf.fit(docs.filter("doc_id < 100"), labels)
    assert np.allclose(model.weights, without.weights)
    assert quality_crf.quality_scores(docs, labels).count() == 30
