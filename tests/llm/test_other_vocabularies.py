"""Vocabularies that cut texts in a way of their own go to the library whole."""

import json
import random

import pytest

from lapreplay.llm import tokens
from lapreplay.llm.queries import vocabulary


def changed(told, how):
    if how == "numbers together":
        told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L}]+|[\p{N}]+|[^\s\p{L}\p{N}]+"
    elif how == "upper case kept":
        told["normalizer"] = {"type": "NFC"}
    elif how == "no normalizer":
        told["normalizer"] = None
    return told


@pytest.mark.parametrize("how", ["numbers together", "upper case kept", "no normalizer", "as it is"])
def test_another_cut(tmp_path, how):
    with open(vocabulary("word_bpe_49k.json"), encoding="utf-8") as f:
        told = changed(json.load(f), how)
    path = tmp_path / "vocabulary.json"
    path.write_text(json.dumps(told), encoding="utf-8")
    e, rng = tokens.Encoder(str(path)), random.Random(3)
    assert e.in_pieces == (how == "as it is")
    texts = ["", "Lap 2024 of 78", *("".join(rng.choices(["A", "b", "é", "12", " ", "\n", ".", "'s", "ß", "\t", "中"], k=rng.randint(1, 20))) for _ in range(300))]
    want = [x.ids for x in e.library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in e.encode(texts)] == want and e.counts(texts).tolist() == [len(x) for x in want]
