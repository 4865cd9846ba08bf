"""Small and hostile inputs for every operator: nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapreplay.llm import compaction, components, decontaminate, html_text, pack, pii, prefix_join, quality_crf, quality_rules, token_counts, token_files, tokens
from lapreplay.llm.queries import vocabulary

LONG = "word " * 30_000
ROWS = [(1, None, None), (2, "", "a"), (3, "one two three", "a"), (3, "one two three", "a"), (None, "no id here", "b"), (4, LONG, None), (5, "naïve Σας \U0001f600 x\x1cy <|endoftext|>  z", "b"), (6, " \n\t\n ", "b")]
CLASH = ("n_words", "_text", "_id", "key", "token", "host", "item", "sequence", "shard", "seq", "bytes", "_kept", "n", "_row")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumns({c: F.lit(i) for i, c in enumerate(CLASH)})


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (None, "word word"), (4, "word " * 12), (5, "One, Two")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality int")


def everything(docs, items, labels):
    byte, word = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
    return {
        "rules": lambda d: quality_rules.quality_rules(d), "decontaminate": lambda d: decontaminate.decontaminate(d, items), "shuffled": lambda d: decontaminate.decontaminate(d, items, broadcast_rows=0),
        "pii": lambda d: pii.find_pii(d), "join": lambda d: prefix_join.similar_classes(d), "join by shuffle": lambda d: prefix_join.similar_classes(d, broadcast_rows=0), "counts": lambda d: token_counts.token_counts(d, word),
        "byte counts": lambda d: token_counts.token_counts(d, byte), "quality": lambda d: quality_crf.quality_scores(d, labels), "files": lambda d: token_files.token_files(d, word), "shards": lambda d: compaction.shard_documents(d, 1 << 12),
    }


def test_every_row_comes_back(docs, items, labels):
    ids = sorted((r[0] for r in ROWS), key=str)
    for name, f in everything(docs, items, labels).items():
        assert sorted((r.doc_id for r in f(docs).collect()), key=str) == ids, name
        assert f(docs.limit(0)).count() == 0, name
    placed = pack.pack(docs, vocabulary("byte_bpe_50k.json")).collect()
    assert {r.doc_id for r in placed} == set(ids) and pack.pack(docs.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0
    for f in (quality_rules.keep_good, prefix_join.one_of_each, lambda d: decontaminate.without_leaks(d, items), pii.redact):
        out = f(docs)
        assert out.columns == docs.columns and out.count() <= len(ROWS) and f(docs.limit(0)).count() == 0


def test_short_items(docs, items):
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, items).collect() if r.contaminated}
    assert (got[3].n_hit, got[3].n_items) == (2, 2)  # both items of the words one and two
    assert (got[4].n_hit, got[4].n_items) == (30_000, 1)
    assert set(got) == {3, 4}
    assert decontaminate.decontaminate(docs, items.limit(0)).filter("contaminated").count() == 0


def test_windows_against_brute_force(spark):
    rng = random.Random(5)
    words = "a b c d É".split()
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(40)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(0, 16)))) for i in range(12)] + [(99, texts[3][1])]
    got = decontaminate.decontaminate(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    for r in got:
        w, hit, found = cut(dict(texts)[r.doc_id]), set(), set()
        for i, t in items:
            x = cut(t)
            n = min(10, len(x))
            for a, b in itertools.product(range(len(x) - n + 1 if x else 0), range(len(w) - n + 1)):
                if x[a : a + n] == w[b : b + n]:
                    hit |= set(range(b, b + n))
                    found.add(i)
        assert (r.n_hit, r.n_items) == (len(hit), len(found))


def test_hosts(spark):
    bad = [(i, "spam " * 100, "bad.example") for i in range(30)]
    good = [(100 + i, " ".join(f"w{i}x{j}" for j in range(40)), "bad.example" if i == 0 else "good.example") for i in range(30)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(bad + good, "doc_id long, text string, source string")).collect()}
    assert got[0].base_failed and got[0].n_repeat_words == 100
    assert not got[100].base_failed and got[100].host_rejected and not got[100].kept
    assert all(got[100 + i].kept for i in range(1, 30))
    a, b = quality_rules.beta_prior(1000, 100, 0.01, 0.01)
    assert 0.09 < a / (a + b) < 0.11


def test_encoder_is_the_librarys():
    rng = random.Random(1)
    alphabet = ["a", "B", "é", " ", "  ", "\n", "\t", "'s", "'", "1", "½", ".", "…", "\xa0", "\x85", "\x1c", "ß", "Σ", "中", "́", "<|endoftext|>", "<|", "ª", "Ÿ"]
    texts = ["", *("".join(rng.choices(alphabet, k=rng.randint(1, 14))) for _ in range(1500))]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = tokens.Encoder(vocabulary(name))
        want = [x.ids for x in e.library.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in e.encode(texts)] == want
        assert e.counts(texts).tolist() == [len(x) for x in want]


def test_grammar_round_trip():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 6, n).astype("<u4") for n in (0, 1, 2, 500, 3000)] + [np.zeros(999, "<u4"), np.zeros(0, "<u4")]
    shard = token_files.Shard(token_files.compress(docs))
    assert len(shard.left) and len(shard.symbols) < sum(map(len, docs))
    for k, (a, b) in enumerate(zip(docs, shard.documents(), strict=True)):
        assert a.tolist() == b.tolist() == shard.document(k).tolist()
    assert shard.document(4, 1234, 1300).tolist() == docs[4][1234:1300].tolist()
    with pytest.raises(ValueError):
        token_files.Shard(b"nothing of the kind!")


def test_crossover_keeps_every_item():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 1024, 400)
    best = pack.evolve(lengths, [], 7, 1024)
    load = np.bincount(best, lengths)
    assert load.max() <= 1024 and len(best) == 400 and len(load) <= 1.03 * lengths.sum() / 1024 + 1
    other = np.arange(400)
    child = pack.crossover(best, other, lengths, 1024, rng)
    assert np.bincount(child, lengths).max() <= 1024 and (child >= 0).all()


def test_components(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def test_near_copies_by_brute_force(spark):
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(160)]
    texts = [(i, " ".join(f"n{i}" if rng.random() < i % 7 * 0.006 else w for w in base)) for i in range(150)] + [(1000 + i, " ".join([*base[:40], *(f"x{i}y{j}" for j in range(80))])) for i in range(100)]
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in texts}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in prefix_join.similar_classes(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    root = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: root.get(i, i) for i in sets}


def test_cache_is_used(spark, tmp_path):
    d, path, word = spark.createDataFrame([(1, "a  b"), (2, "a b"), (3, "c")], "doc_id long, text string"), f"file://{tmp_path}/cache", vocabulary("word_bpe_49k.json")
    a = token_counts.token_counts(d, word, path).collect()
    assert token_counts.read_cache(spark, path).count() == 2
    spark.read.parquet(path).withColumn("n_tokens", F.lit(77).cast("long")).write.parquet(f"file://{tmp_path}/other")
    assert {r.n_tokens for r in token_counts.token_counts(d, word, f"file://{tmp_path}/other").collect()} == {77}
    assert {r.n_tokens for r in a} == {1, 2}


def test_pages():
    page = "<html><head><title>t</title></head><body><header>Top</header><div class='cookie-notice'>We</div><nav>m</nav><main><article><h1>T</h1><p>One &lt; two<p>Three <b>bold</b>\n x<ul><li>a<li>b</ul><form>q</form><div id=shareBar>S</div><aside>z</aside><script>if(a<b){'</p>'}</script>tail</article><section id='comments'><p>hi</section></main><footer>f</footer>"
    assert html_text.extract(page, None) == "T\nOne < two\nThree bold x\na\nb\ntail"
    same = "<body><article><p>{}</p><div class=x>Follow us</div><p>more {}</p></article></body>"
    template = None
    for i in range(8):
        s = html_text.shape(html_text.parse(same.format(i, i)))
        template = html_text.merge(template, s) if template else s
    assert html_text.extract(same.format("a", "b"), html_text.placed(template)) == "a\nmore b"
    assert [html_text.extract(x, None) for x in ("", "plain", "<p>a", "<!-- a", "<ScRipt>z</sCript>k")] == ["", "plain", "a", "", "k"]


def test_pages_without_host(spark):
    d = spark.createDataFrame([(1, None, "<p>a"), (2, "http://h.example/x", None), (2, "http://h.example/x", "<p>b"), (None, "no url", "<p>c")], "page_id long, url string, html string").withColumn("host", F.lit(1))
    assert sorted((r.text, r.n_chars) for r in html_text.main_text(d).collect()) == [("", 0), ("a", 1), ("b", 1), ("c", 1)]
    assert html_text.main_text(d.limit(0)).count() == 0


def test_crf_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    score, t = rng.normal(size=5), rng.normal(size=(2, 2))
    counts = np.array([2, 3])
    p, _ = quality_crf.marginals(score, counts, t)
    at = 0
    for n in counts:
        total, good = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(score[at + i] * v for i, v in enumerate(y)) + sum(t[a, b] for a, b in itertools.pairwise(y)))
            total, good = total + w, good + w * np.array(y)
        assert np.allclose(p[at : at + n], good / total)
        at += n


def test_redaction(spark):
    d = spark.createDataFrame([(1, "mail a@b.co, ip 1.2.3.4 and +1 (743) 555-3824."), (2, None), (3, "plain")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(d).collect()}
    assert got == {1: "mail <EMAIL>, ip <IP> and <PHONE>.", 2: None, 3: "plain"}
