"""Counts of digests that very many rows share."""

from lapreplay.llm import token_counts
from lapreplay.llm.queries import vocabulary


def test_hot_digests(spark):
    rows = [(i, "the same text over and over") for i in range(1500)] + [(5000 + i, f"text number {i} " * (i % 5)) for i in range(200)]
    path = vocabulary("word_bpe_49k.json")
    got = {r.doc_id: r for r in token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    assert len(got) == len(rows)
    for i, text in rows:
        assert (got[i].n_bytes, got[i].n_tokens) == (len(text), len(t.encode(text, add_special_tokens=False).ids))
