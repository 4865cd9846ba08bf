"""The grouping search improves on best fit in descending order where that leaves room."""

import numpy as np
import pytest

from lapreplay.llm import pack


def best_fit_descending(lengths, size):
    bins = np.full(len(lengths), -1)
    pack.best_fit(np.argsort(-lengths, kind="stable"), lengths, bins, [], size)
    return int(bins.max()) + 1


def triplets(n, size, rng):
    """Items that fill ``n`` bins without a gap, three to a bin."""
    out = []
    for _ in range(n):
        a = int(rng.integers(size * 38 // 100, size * 49 // 100))
        b = int(rng.integers((size - a) * 2 // 5, (size - a) // 2 + 1))
        out += [a, b, size - a - b]
    return np.array(out)


def right(bins, lengths, size):
    return len(bins) == len(lengths) and bins.min() == 0 and np.bincount(bins, lengths).max() <= size and np.bincount(bins).min() > 0


@pytest.mark.parametrize("n", [40, 200])
def test_fewer_bins_than_its_seeds(n):
    lengths = triplets(n, 1024, np.random.default_rng(n))
    seeds = best_fit_descending(lengths, 1024)
    bins = pack.evolve(lengths, [], 5, 1024)
    assert right(bins, lengths, 1024)
    assert bins.max() + 1 <= seeds - 0.05 * n and bins.max() + 1 <= 1.04 * n


def test_never_worse_than_its_parents():
    rng = np.random.default_rng(2)
    for k in range(20):
        lengths = rng.integers(1, 1024, int(rng.integers(1, 300)))
        bins = pack.evolve(lengths, [], k, 1024)
        assert right(bins, lengths, 1024) and bins.max() + 1 <= best_fit_descending(lengths, 1024)
        again = pack.evolve(lengths, [bins], k + 1, 1024)
        assert right(again, lengths, 1024) and again.max() <= bins.max()


def test_children_hold_every_item_once():
    rng = np.random.default_rng(3)
    lengths = triplets(50, 1024, rng)
    a, b = pack.evolve(lengths, [], 1, 1024, generations=0), np.arange(len(lengths))
    for child in (pack.crossover(a, b, lengths, 1024, rng), pack.crossover(b, a, lengths, 1024, rng), pack.mutation(a, lengths, 1024, rng), pack.mutation(b, lengths, 1024, rng, 500)):
        assert right(child, lengths, 1024)


def test_exchange_fills_bins():
    lengths = np.array([700, 300, 500, 324])
    bins, loads = np.array([0, 0, -1, -1]), np.array([1000])
    loose = pack.exchange(np.array([2, 3]), lengths, bins, loads, 1024)
    assert sorted(loose.tolist()) == [1, 2] and bins.tolist() == [0, -1, -1, 0] and loads.tolist() == [1024]
