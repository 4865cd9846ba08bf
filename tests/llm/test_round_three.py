"""Elias-Fano sequences, language-model scores, ranked search and token alignment against brute force, and their odd inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from lapreplay.llm import align_tokens, elias_fano, lm_score, queries, ranked_search

FOLDER = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "the same words here"), (3, "the same words here"), (None, "the words ▁ \x00 \U0001f600 x"), (4, "  spaced   out \n\n text "), (5, "one " * 3000), (6, "<|endoftext|> <s> <0x41> café 　 ﬁ"), (7, " ")]


def odd(spark):
    """Nulls, empties, repeated rows, a long text, and columns named like inner ones."""
    d = spark.createDataFrame(ODD, "doc_id long, text string")
    return d.selectExpr("doc_id", "text", "1 as _id", "'x' as _text", "2 as _row", "true as held_out", "3 as block", "4 as n", "5 as score", "6 as rank", "7 as _words")


@pytest.mark.parametrize("n, top", [(0, 1), (1, 1), (1, 1 << 40), (1000, 1000), (1000, 1 << 62), (5000, 7001), (3, 1 << 63)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.choice(top, n, replace=False) if top < 1 << 20 else rng.integers(0, top, n, "u8")).astype("u8")
    s = elias_fano.EliasFano(elias_fano.unpacked(elias_fano.packed(elias_fano.encode(values, top))))
    assert (s.all() == values).all() and s.n == n
    asked = np.concatenate([values, values + np.uint64(1), rng.integers(0, top, 300, "u8"), [0, top - 1, top + 1000]]).astype("u8")
    at, found = s.find(asked)
    want = np.searchsorted(values, asked)
    assert (at == want).all()
    assert (found == np.isin(asked, values)).all()


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def brute_scores(rows, discount=0.9):
    """Scores by row, of (id, text) rows."""
    texts = [(i, words(t) + [None], zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else False) for i, t in rows]
    c = Counter(w for _, ws, held in texts if not held for w in ws)
    total, kinds = sum(c.values()), len(c)
    three = Counter()
    for _, ws, held in texts:
        if not held:
            x = [None, None, *ws]
            three.update(set(zip(x, x[1:], x[2:])))
    two, n3, k3, n2, k2 = Counter(), Counter(), Counter(), Counter(), Counter()
    for (u, v, w), n in three.items():
        two[v, w] += n
        n3[u, v] += n
        k3[u, v] += 1
    for (v, w), n in two.items():
        n2[v] += n
        k2[v] += 1
    for i, ws, held in texts:
        base = [(c[w] + 1) / (total + kinds + 1) for w in ws]
        score, x = 0.0, [None, None, *ws]
        for u, v, w, p in zip(x, x[1:], x[2:], base):
            if n2[v]:
                p = max(two[v, w] - discount, 0) / n2[v] + discount * k2[v] / n2[v] * p
            if n3[u, v]:
                p = max(three[u, v, w] - discount, 0) / n3[u, v] + discount * k3[u, v] / n3[u, v] * p
            score += math.log10(p)
        yield (str(i), held, len(ws), sum(c[w] > 0 for w in ws), total), sum(map(math.log10, base)), score


def same_scores(got, rows):
    key = lambda r: (str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"])
    got, want = sorted((key(r), r["base_score"], r["score"]) for r in got), sorted(brute_scores(rows))
    assert [g[0] for g in got] == [w[0] for w in want]
    for g, w in zip(got, want):
        assert abs(g[1] - w[1]) < 1e-9 * (1 + abs(w[1])) and abs(g[2] - w[2]) <= 6e-4 * g[0][2]  # codes round down by 1/1024 of a halving
    return want


def test_lm_scores(spark):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()]
    want = same_scores(queries.QUERIES["op11_lm_scores"](spark, FOLDER).collect(), docs)
    held = [w for w in want if w[0][1]]
    assert sum(w[2] for w in held) > sum(w[1] for w in held)  # the model tells more than the words alone


@pytest.mark.parametrize("shard, counts_first", [(300, True), (700, False)])
def test_lm_scores_in_small_parts(spark, monkeypatch, shard, counts_first):
    """Words of many shards: pairs of words that would overfill one have their trigrams counted before they are dealt."""
    own, grow, grown = lm_score.own_scored, lm_score.grow, []
    monkeypatch.setattr(lm_score, "own_scored", lambda blocks, path: own(blocks, path, shard_tokens=shard))
    monkeypatch.setattr(lm_score, "grow", lambda *a, **b: grown.append(1) or grow(*a, **b))
    rows = [(i, f"a b a c a d{i} a e{i % 3} a a " + ("a a a a a a" if counts_first else "")) for i in range(60)]
    got = lm_score.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    same_scores(got, rows)
    assert bool(grown) == counts_first


def test_lm_texts_longer_than_a_block(spark):
    rows = [(i, " ".join(f"w{(i * j) % 7}" for j in range(50))) for i in range(1, 6)]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = []
    for size in (7, 3 << 18):
        blocks = lm_score.token_blocks(d, block_tokens=size)
        model = lm_score.train(blocks)
        got = {r.doc_id: r for r in lm_score.score(blocks, model).collect()}
        found.append({i: (r.n_tokens, r.n_known, round(r.base_score, 9)) for i, r in got.items()})
    assert found[0] == found[1] and set(found[0]) == {1, 2, 3, 4, 5} and found[0][1][0] == 51


def test_lm_probabilities_sum_to_one_at_most():
    rng = np.random.default_rng(1)
    tri = np.unique(rng.integers(0, 6, (200, 3)), axis=0)
    c = rng.integers(1, 5, len(tri))
    trie = elias_fano.Trie(elias_fano.build(np.arange(6), tri[:, 1], tri[:, 0], tri[:, 2], c, 0.9))
    floor = np.full(6, 1 / 7)
    for v in range(6):
        for u in range(6):
            p = trie.probabilities(np.arange(6), floor, np.full(6, v), np.full(6, u), np.arange(6))
            assert 0.9 < p.sum() + 1 / 7 and p.sum() <= 1


def test_odd_scores(spark):
    same_scores(lm_score.lm_scores(odd(spark)).collect(), ODD)
    assert lm_score.lm_scores(odd(spark).limit(0)).collect() == []


def brute_rank(rows, items, k):
    term = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    docs = [(i, Counter(term(t))) for i, t in rows]
    df = Counter(t for _, c in docs for t in c)
    n_docs, n_words = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    for item, text in items:
        found = []
        for place, (i, c) in enumerate(docs):
            m = 50 + (50 * sum(c.values()) * n_docs) // max(n_words, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(term(text)) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, place))
        for rank, (score, no, i, _) in enumerate(sorted(found)[:k], 1):
            yield item, rank, None if no else i, -score


@pytest.mark.parametrize("k, block, bytes_", [(50, 500_000, 8_000_000), (3, 300, 2_000)])
def test_ranks(spark, k, block, bytes_):
    """With small blocks, few places and several passes the accumulators' limit bites."""
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{FOLDER}/benchmark.parquet").to_pylist()]
    got = ranked_search.rank_documents(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/benchmark.parquet"), k=k, block_words=block, term_bytes=bytes_)
    assert sorted(map(tuple, got.collect())) == sorted(brute_rank(docs, items, k))


def test_odd_ranks(spark):
    items = [(1, "same x SPACED"), (1, "words"), (None, None), (2, "absent"), (3, "one words")]
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as _item", "2 as terms", "3 as _id")
    got = ranked_search.rank_documents(odd(spark), asked, k=2).collect()
    by = lambda rows: sorted(rows, key=str)
    assert by(map(tuple, got)) == by(brute_rank(ODD, items, 2))
    assert ranked_search.rank_documents(odd(spark).limit(0), asked).collect() == [] == ranked_search.rank_documents(odd(spark), asked.limit(0)).collect()


def brute_groups(rows):
    """n_a, n_b, n_groups, n_links, sha, n_best, count_sum of each row."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    all_links, out = [], []
    for _, text in rows:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if b"".join(map(piece, y)) != (" " + text).encode() if text else True:
            x = y = []
        ends = [np.cumsum([0, *[len(a.id_to_token(i)) for i in x]]), np.cumsum([0, *[len(piece(i)) for i in y]])]
        links = [(p, q) for j, p in enumerate(x) for k, q in enumerate(y) if max(ends[0][j], ends[1][k]) < min(ends[0][j + 1], ends[1][k + 1])] if len(x) < 400 else fast_links(x, y, *ends)
        cuts = sorted({*ends[0].tolist()} & {*ends[1].tolist()})
        place = [{e: k for k, e in enumerate(z.tolist())} for z in ends]
        groups = [",".join(map(str, x[place[0][s] : place[0][e]])) + "|" + ",".join(map(str, y[place[1][s] : place[1][e]])) for s, e in zip(cuts, cuts[1:])]
        all_links.append(links)
        out.append([len(x), len(y), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""])
    count = Counter(p for links in all_links for p in set(links))
    best = Counter()
    for (p, _), n in count.items():
        best[p] = max(best[p], n)
    return [(*o, sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links)) for o, links in zip(out, all_links)]


def fast_links(x, y, ends_x, ends_y):
    out, j, k = [], 0, 0
    while j < len(x) and k < len(y):
        out.append((x[j], y[k]))
        step = ends_x[j + 1] - ends_y[k + 1]
        j, k = j + (step <= 0), k + (step >= 0)
    return out


def test_alignment(spark):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()]
    got = sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) for r in queries.QUERIES["op13_align_tokens"](spark, FOLDER).collect())
    assert got == sorted((i, *x) for (i, _), x in zip(docs, brute_groups(docs)))


def test_odd_alignment(spark):
    run = lambda d, **more: align_tokens.align(d, queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model"), **more)
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) for r in run(odd(spark), block_chars=100).collect()]
    assert sorted(got, key=str) == sorted(((i, *x) for (i, _), x in zip(ODD, brute_groups(ODD))), key=str)
    assert run(odd(spark).limit(0)).collect() == []


def test_shared_cuts():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        ends = lambda: np.append(np.sort(rng.choice(np.arange(1, n), int(rng.integers(0, n)), replace=False)) if n > 1 else [], n).astype("i8")
        texts = [(ends(), ends()) for _ in range(int(rng.integers(1, 4)))]
        a, b = (np.concatenate([t[k] + i * 100 for i, t in enumerate(texts)]) for k in (0, 1))
        last = np.cumsum([len(t[0]) for t in texts]) - 1
        # texts follow each other without a gap in bytes; the gaps here stand for nothing
        assert (align_tokens.shared_cuts(a, b, last) == np.isin(a, b)).all()


@pytest.mark.parametrize("words", [9, 1 << 22])
def test_distinct_triples(words):
    """Places too wide to share a number are ranked by pair; the result is the same."""
    rng = np.random.default_rng(3)
    v, u, w, of = rng.integers(0, 9, (4, 500)).astype("i4")
    a, b, c, triple, text = lm_score.distinct(v, u, w, of, words)
    rows = sorted(zip(v.tolist(), u.tolist(), w.tolist()))
    assert list(zip(a.tolist(), b.tolist(), c.tolist())) == sorted(set(rows))
    assert [(a[i], b[i], c[i]) for i in triple] == rows
    assert sorted(zip(triple.tolist(), text.tolist())) == sorted((sorted(set(rows)).index(r[:3]), r[3]) for r in zip(v.tolist(), u.tolist(), w.tolist(), of.tolist()))
