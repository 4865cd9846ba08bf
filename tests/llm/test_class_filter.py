"""Near copies of short texts: sets of other sizes ask for fewer shared prefix hashes."""

import random

import pytest

from lapreplay.llm import prefix_join


def smallest_of_group(texts: list[str], n: int, num: int, den: int) -> list[int]:
    """Smallest index that links reach, by comparing every pair."""
    words = [t.split() for t in texts]
    sets = [{tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in words]
    up = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                    up[i] = up[j] = min(up[i], up[j])
    return up


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_one_word_more_by_brute_force(spark, n, num, den):
    rng, texts, want = random.Random(7), [], []
    for size in range(1, 41):  # shingles
        for k in range(6):
            words = [f"w{size}x{k}x{rng.randrange(10**6)}" for _ in range(size + n - 1)]
            group = [" ".join(w) for w in (words, [*words, "more"], words[:-1] or words, [*words[:-1], "other"])]
            want += [len(texts) + x for x in smallest_of_group(group, n, num, den)]
            texts += group
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in prefix_join.similar_classes(docs, n, num, den).collect()}
    assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100)])
def test_needed_by_all_partners(num, den):
    own = [prefix_join.shared_at_least(prefix_join.prefix_length(n, num, den)) for n in range(1, 400)]
    for n in range(1, 300):
        partners = [m for m in range(1, 400) if den * min(n, m) >= num * max(n, m)]
        assert prefix_join.needed(n, num, den) == min(min(own[n - 1], own[m - 1]) for m in partners)
