"""Token ids by the tokenizers library, piece by piece.

The vocabularies here cut a text into pieces by a pattern and encode each piece alone. A worker numbers
the pieces it meets, has the library's model encode new ones, and puts texts together from what it remembers. Texts
outside Latin-1, or with strings of special tokens, go to the library whole, and so do all texts where a vocabulary's
file cuts in another way than the two patterns below.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np

#: Pieces that a worker remembers at most; it then starts afresh.
REMEMBERED = 800_000
# The vocabularies' own patterns, for Latin-1 texts.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
_LATIN = re.compile("[\t\n\r -~¡-ÿ]*")
_SPACED = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_WORDS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
# How a vocabulary's file says that it cuts texts by these patterns.
_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
_CUTS_SPACED = (None, _LEVEL | {"use_regex": True})
_CUTS_WORDS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, _LEVEL | {"use_regex": False}]},
)


class _Numbers(dict):
    """Gives each new key the next number."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of runs that begin at ``starts`` and have ``lengths``, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Encoder:
    """Ids of texts for the vocabulary file at ``path``, without added special tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        cuts = (told.get("normalizer"), told.get("pre_tokenizer"))
        self.words_only = cuts == _CUTS_WORDS  # white space and case don't count
        self.in_pieces = told["model"]["type"] == "BPE" and (self.words_only or cuts == _CUTS_SPACED)
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}  # bytes as a vocabulary writes them
        self.forget()

    def _ids(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def forget(self) -> None:
        self.numbers = _Numbers()
        self.starts, self.lengths, self.flat = np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "<u4")

    def _learn(self) -> None:
        """Encode the pieces that have got a number since the last call."""
        new = list(self.numbers)[len(self.lengths) :] if len(self.numbers) > len(self.lengths) else []
        if not new:
            return
        lines = "\0".join(new).encode().decode("latin-1").translate(self.letters).split(self.letters[0])
        if len(lines) != len(new):  # a piece holds that character itself
            lines = [x.encode().decode("latin-1").translate(self.letters) for x in new]
        model = self.library.model.tokenize
        ids = [[t.id for t in model(x)] for x in lines]
        self.lengths = np.append(self.lengths, np.fromiter(map(len, ids), "i8", len(ids)))
        self.flat = np.append(self.flat, np.fromiter(chain.from_iterable(ids), "u4"))
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        """Numbers of the pieces of all texts, how many each text has, and the ids of texts encoded whole."""
        if len(self.numbers) > REMEMBERED:
            self.forget()
        number, find, parts, counts, whole = self.numbers.__getitem__, (_WORDS if self.words_only else _SPACED).findall, [], [], {}
        for k, t in enumerate(texts):
            if not self.in_pieces or not _LATIN.fullmatch(t) or "<|" in t and any(s in t.lower() for s in self.specials):
                whole[k] = np.array(self._ids(t), "<u4")
                counts.append(0)
                continue
            cut = find(t.lower() if self.words_only else t)
            parts.append(np.fromiter(map(number, cut), "i4", len(cut)))
            counts.append(len(cut))
        self._learn()
        return np.concatenate(parts) if parts else np.zeros(0, "i4"), np.array(counts, "i8"), whole

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        pieces, counts, whole = self._pieces(texts)
        total = np.append(0, np.cumsum(self.lengths[pieces]))
        ends = np.cumsum(counts)
        out = total[ends] - total[ends - counts]
        for k, ids in whole.items():
            out[k] = len(ids)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        pieces, counts, whole = self._pieces(texts)
        lengths = self.lengths[pieces]
        flat = self.flat[ragged(self.starts[pieces], lengths)]
        total, ends = np.append(0, np.cumsum(lengths)), np.cumsum(counts)
        a, b = total[ends - counts], total[ends]
        return [whole[k] if k in whole else flat[a[k] : b[k]] for k in range(len(texts))]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The worker's own encoder for ``path``."""
    return Encoder(path)


def batches(texts: list[str], chars: int = 4_000_000) -> Iterable[tuple[int, list[str]]]:
    """Slices of ``texts`` of about ``chars`` characters, each with its first position."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]
