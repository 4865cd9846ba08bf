"""Addresses that are written with a marker for the at sign are proposed as candidates."""

import pytest

from lapreplay.llm import pii

FORMS = ["john[at]example.com", "john(at)example.com", "john [at] example.com", "john (at) example.com", "john[at] example.com", "john (at)example.com", "j" * 80 + "[at]example.com", "j" * 80 + " (at) example.com", "jörg(at)büro@höst", "a@b", "j" * 80 + "@höst"]


@pytest.mark.parametrize("around", ["{}", "write to {} today", "x@y {} z"])
def test_forms(spark, around):
    rows = [(i, around.format(f)) for i, f in enumerate(FORMS)] + [(99, "no [at] (at) @ here at all"), (100, "w" * 100_000)]
    got = {r["_id"]: r["_f_contact"] for r in pii.matches(spark.createDataFrame(rows, "_id long, _text string"), ("contact",)).collect()}
    for i, f in enumerate(FORMS):
        assert any(x.s <= rows[i][1].index(f) and x.e >= rows[i][1].index(f) + len(f) for x in got[i]), f
    assert got[100] == []
