"""Registered queries on the smallest tables: against SQL where there is some, else against brute force."""

import hashlib
import html
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from helpers import duck, same

from lapreplay.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return sorted(pq.read_table(f"{FOLDER}/documents.parquet").to_pylist(), key=lambda r: r["doc_id"])


def run(spark, name):
    return queries.QUERIES[name](spark, FOLDER).collect()


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary(name))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    same(queries.QUERIES[name](spark, FOLDER), duck(FOLDER), queries.SQL[name])


def test_token_files(spark, docs):
    got, t, start = {r.doc_id: r for r in run(spark, "op2_token_files")}, library("word_bpe_49k.json"), 0
    assert len(got) == len(docs)
    for d in docs:
        ids = np.array([*t.encode(d["text"], add_special_tokens=False).ids, 1], "<u4")
        r = got[d["doc_id"]]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids))
        start += len(ids)


def test_html(spark):
    got = {r.page_id: r for r in run(spark, "op3_html_text")}
    for p in pq.read_table(f"{FOLDER}/pages.parquet").to_pylist():
        article = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("<p>|</p>|<br>|<h1>|</h1>", article)]
        assert got[p["page_id"]].text == "\n".join(b for b in blocks if b)


def shingles(text, n):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text)]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def groups(docs, n, num, den):
    """Smallest id that links reach, by comparing all documents."""
    sets = {d["doc_id"]: shingles(d["text"], n) for d in docs}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and den * len(a & b) >= num * len(a | b):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return top


def test_prefix_join(spark, docs):
    sets = {d["doc_id"]: shingles(d["text"], 3) for d in docs}
    top = groups(docs, 3, 90, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, "op6_prefix_join")}
    assert got == {i: (len(s), top(i)) for i, s in sets.items()}
    assert len({c for _, c in got.values()}) < len(got)


def test_token_counts(spark, docs):
    t = library("word_bpe_49k.json")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in run(spark, "op7_token_counts")}
    for d in docs:
        n = len(t.encode(d["text"], add_special_tokens=False).ids)
        assert got[d["doc_id"]] == (len(d["text"].encode()), n, n > 2048)


def test_quality(spark):
    folder = "/root/testdata/sf0.01"  # more labels
    docs = pq.read_table(f"{folder}/documents.parquet").to_pylist()
    got = queries.QUERIES["op8_quality_crf"](spark, folder).collect()
    label = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    unseen = [r for r in got if r.doc_id in label and r.held_out]
    assert len(unseen) >= 50 and sum(r.predicted == label[r.doc_id] for r in unseen) >= 0.95 * len(unseen)
    good, bad = ([r.score for r in unseen if label[r.doc_id] == y] for y in (1, 0))
    assert sum((a > b) + 0.5 * (a == b) for a in good for b in bad) >= 0.95 * len(good) * len(bad)


def test_pack(spark, docs):
    t, by, seqs, total = library("byte_bpe_50k.json"), defaultdict(list), defaultdict(list), 0
    for r in run(spark, "op9_pack"):
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    for d in docs:
        ids = np.array([*t.encode(d["text"], add_special_tokens=False).ids, 2], "<u4")
        pieces, at = sorted(by[d["doc_id"]], key=lambda r: r.piece), 0
        total += len(ids)
        assert [p.length for p in pieces[1:]] == [1024] * (len(pieces) - 1)
        for k, p in enumerate(pieces):
            assert (p.piece, p.start, p.ids_crc32) == (k, at, zlib.crc32(ids[at : at + p.length]))
            at += p.length
        assert at == len(ids)
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(seqs) <= -(-total // 1024) + 3


def test_compaction(spark, docs):
    got = run(spark, "op10_compaction")
    assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((d["doc_id"], zlib.crc32(d["text"].encode())) for d in docs)
    assert len({(r.shard, r.position) for r in got}) == len(got)


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) < 256 for p in m.split("."))
    if kind == "phone":
        return 8 <= len(digits) <= 15
    total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1]))
    return kind == "email" or 16 <= len(digits) <= 19 and total % 10 == 0


def spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PII.items() for m in re.finditer(p, text or "") if holds(k, m[0])]


def test_pii(spark):
    folder = "/root/testdata/sf0.01"  # the smallest tables hold no secrets
    docs = pq.read_table(f"{folder}/documents.parquet").to_pylist()
    got = {r.doc_id: r for r in queries.QUERIES["op5_pii"](spark, folder).collect()}
    for d in docs:
        want, r = spans(d["text"]), got[d["doc_id"]]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in want) for k in PII]
        assert set(want) <= set(r.spans.split(",")) | {""}
    secret = [d["doc_id"] for d in docs if re.search(r'token = "[0-9a-f]{40}"', d["text"])]
    assert secret and all("key:" in got[i].spans for i in secret)


def test_pipeline(spark, docs):
    import corpus_pipeline
    from lapreplay.llm.common import written

    table, kept = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    columns = table.columns
    for name, stage in corpus_pipeline.STAGES:
        table = written(stage(spark, table, FOLDER), "stage")
        kept.append(table)
        assert name == "packing" or table.columns == columns
    rules, copies, leaks, private, packed = kept
    good = {r.doc_id for r in run(spark, "op1_quality_rules") if r.kept}
    assert {r.doc_id for r in rules.collect()} == good
    left = [d for d in docs if d["doc_id"] in good]
    top = groups(left, 5, 80, 100)
    assert {r.doc_id for r in copies.collect()} == {d["doc_id"] for d in left if top(d["doc_id"]) == d["doc_id"]} and len(left) > copies.count()
    clean = {r.doc_id for r in run(spark, "op4_decontaminate") if not r.contaminated}
    assert {r.doc_id for r in leaks.collect()} == {r.doc_id for r in copies.collect()} & clean
    assert all(not spans(r.text) and r.n_chars == len(r.text) for r in private.collect())
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in private.collect()}
