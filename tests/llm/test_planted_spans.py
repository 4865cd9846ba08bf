"""Trees for personal data: on planted spans of other documents, and how chosen spans that overlap are resolved."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapreplay.llm import pii
from lapreplay.llm.common import text_rows


def docs(spark, scale):
    return text_rows(spark.read.parquet(f"/root/testdata/{scale}/documents.parquet"), "doc_id", "text")


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(docs(spark, "sf0.001"), max_docs=200)


def test_planted_in_other_documents(spark, model):
    """The trees see sf0.001; the spans are planted into sf0.01. Values that both plant are random numbers apart."""
    rows = pii.labelled(docs(spark, "sf0.01"), max_docs=200).collect()
    x = np.array([[r[f] for f in ("k", *pii.FEATURES)] for r in rows], "f8")
    y, z = np.array([r.y for r in rows]), pii.total(x, model.trees, model.base)
    assert len(rows) > 1_000 and set(model.thresholds) == {4, 5, 6}
    for k, t in model.thresholds.items():
        mine, taken = x[:, 0] == k, z >= t
        assert y[mine & taken].mean() >= 0.95, pii.KINDS[k]
        assert taken[mine & (y == 1)].mean() >= 0.9, pii.KINDS[k]


def test_the_sum_in_sql_is_the_trees(spark, model):
    d = pii.with_spans(pii.planted(docs(spark, "sf0.001"), 20)).select(F.explode("_cands").alias("c"))
    rows = d.select("c.*", pii.margin(F.col("c"), model).alias("z")).collect()
    x = np.array([[r[f] for f in ("k", *pii.FEATURES)] for r in rows], "f8")
    want = pii.total(x, model.trees, model.base) - np.array([model.thresholds[r.k] for r in rows])
    assert np.allclose([r.z for r in rows], want)


def test_no_feature_gives_the_label_away(spark):
    rows = pii.labelled(docs(spark, "sf0.001"), max_docs=200).collect()
    y = np.array([r.y for r in rows])
    for f in pii.FEATURES:
        v = np.array([r[f] for r in rows])
        best = max(max((y == (v >= c)).mean(), (y == (v < c)).mean()) for c in np.unique(v))
        assert best < 0.97, f


def test_overlaps_become_one(spark):
    always = pii.Trees([(0, 4.5, (0, 0.5, 0.0, 1.0), (0, 5.5, 5.0, 3.0))], 0.0, {4: 0.0, 5: 0.0, 6: 0.0})  # margins 1, 5, 3 for contact, key, number
    rows = [
        (1, [(0, 5, 9)], [(6, 0, 3), (5, 2, 6), (6, 10, 16), (5, 12, 19), (4, 18, 25), (6, 30, 40)]),
        (2, [], []), (3, [], [(6, 3, 4), (6, 4, 5)]),
    ]
    zero = ", ".join(f"0 as {f}" for f in pii.FEATURES)
    d = spark.createDataFrame(rows, "id int, b array<struct<k:int,s:int,e:int>>, c array<struct<k:int,s:int,e:int>>")
    d = d.select("id", F.col("b").alias("_base"), F.expr(f"transform(c, x -> struct(x.k as k, x.s as s, x.e as e, {zero}))").alias("_cands"))
    got = {r.id: [tuple(x) for x in r.out] for r in pii.with_chosen(d, always).select("id", F.col("_chosen").alias("out")).collect()}
    assert got == {1: [(0, 5, 9), (6, 0, 3), (5, 10, 25), (6, 30, 40)], 2: [], 3: [(6, 3, 4), (6, 4, 5)]}


def test_nothing_to_plant_in(spark):
    rows = [(1, "short"), (2, None), (3, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.spans for r in pii.find_pii(d).collect()} == {1: "", 2: "", 3: ""}
    assert pii.fit(text_rows(d, "doc_id", "text")).thresholds == {}
