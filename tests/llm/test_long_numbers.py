"""Personal data in texts of very long numbers, number tables and host names."""

from lapreplay.llm import pii

LONG = ["7" * 100_000, "12 " * 50_000, "x@a" + ".b" * 50_000, "1-" * 50_000 + "1"]


def test_long_runs(spark):
    docs = spark.createDataFrame([*enumerate(LONG), (9, "mail me@example.com, card 4111 1111 1111 1111")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert set(got) == {0, 1, 2, 3, 9}
    assert [got[i].n_email for i in (0, 1, 2, 3, 9)] == [0, 0, 1, 0, 1] and [got[i].n_card for i in (0, 1, 2, 3, 9)] == [0, 0, 0, 0, 1]
    assert f"email:0:{len(LONG[2])}" in got[2].spans
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[2] == "<EMAIL>" and clean[9] == "mail <EMAIL>, card <CARD>"
