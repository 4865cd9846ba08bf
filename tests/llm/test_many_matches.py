"""A text with very many matches takes time in proportion, and its spans are the plain ones."""

import re
import time

from pyspark.sql import functions as F

from lapreplay.llm import pii


def plain_email(text):
    return [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]


def fixed(monkeypatch):
    """Trees that choose every number of three digits or more, and no other candidate."""
    tree = (pii.FEATURES.index("digits") + 1, 2.5, (1, 0.5, -9.0, -9.0), (1, 0.5, 9.0, 9.0))
    monkeypatch.setattr(pii, "fit", lambda docs, max_docs=400: pii.Trees([tree], 0.0, {pii.KINDS.index("number"): 0.0}))


def test_spans_beside_base(spark, monkeypatch):
    fixed(monkeypatch)
    text = "a1234@b.cc 999 and 10.0.0.1 5555 \U0001f600 777 12 x88888@y.org,6666"
    got = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    base = {(m.start(), m.end()) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"10\.0\.0\.1") for m in re.finditer(p, text)}
    want = {(m.start(), m.end()) for m in re.finditer(r"[0-9](?:[\x20().-]{0,2}[0-9])+", text) if sum(c.isdigit() for c in m[0]) >= 3}
    want = {s for s in want if not any(b[0] < s[1] and s[0] < b[1] for b in base)}
    spans = [x.split(":") for x in got.spans.split(",")]
    assert {(int(s), int(e)) for k, s, e in spans if k == "number"} == want
    assert {(int(s), int(e)) for k, s, e in spans if k != "number"} == base


def test_a_hundred_thousand_matches(spark, monkeypatch):
    fixed(monkeypatch)
    text = " ".join(f"{i % 1000:03d}," if i % 10 else f"u{i}@h.de" for i in range(100_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    pii.find_pii(docs.limit(0)).collect()
    began = time.time()
    got = pii.find_pii(docs).select("n_email", "spans").first()
    assert time.time() - began < 60  # some 10 s on an idle machine; hours where work grows with the square
    spans = [x.split(":") for x in got.spans.split(",")]
    assert [(int(s), int(e)) for k, s, e in spans if k == "email"] == plain_email(text) and got.n_email == 10_000
    numbers = [(int(s), int(e)) for k, s, e in spans if k == "number"]
    assert len(numbers) == 90_000 and all(text[s:e] == text[s : s + 3] and text[s:e].isdigit() for s, e in numbers[::97])
    began = time.time()
    clean = pii.redact(docs).first().text
    assert time.time() - began < 60
    assert clean == " ".join("<NUMBER>," if i % 10 else "<EMAIL>" for i in range(100_000))


def test_sweeps_and_parts(spark):
    d = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda x: x.cast("int")).alias("a"), F.lit("0123456789\u00e4" * 20000).alias("t"))
    sums = d.select(F.flatten(pii.running(F.col("a"))).alias("s")).first().s
    assert d.select(pii.at_place(pii.running(F.col("a")), F.lit(700))).first()[0] == 701 * 702 // 2
    assert sums == [i * (i + 1) // 2 for i in range(1, 1001)]
    text = "0123456789\u00e4" * 20000
    places = [(0, 0), (0, 5), (1000, 1030), (1023, 1024), (1024, 1024), (65530, 140000), (219990, 220000), (220000, 220000)]
    d = d.select(pii.parts_of(F.col("t")).alias("p"))
    got = d.select(*[pii.between(F.col("p"), F.lit(a), F.lit(b)).alias(f"c{i}") for i, (a, b) in enumerate(places)]).first()
    assert list(got) == [text[a:b] for a, b in places]
    assert spark.range(1).select(pii.between(pii.parts_of(F.lit("")), F.lit(0), F.lit(0))).first()[0] == ""
