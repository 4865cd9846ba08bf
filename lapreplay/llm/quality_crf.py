"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. A line's score comes from its own features and those of the lines before and after
it; a transition matrix ties neighbours. Training takes the document's label for all of its lines. A document's
score is the mean of its lines' marginals, weighted by length, and calibrated on the training rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapreplay.llm.common import text_rows
from lapreplay.llm.tokens import batches

# Classes of UTF-8 bytes: 0 others, 1 lower case, 2 upper case, 3 digits, 4 symbols, 5 bars, 6 exclamation marks, 7 other punctuation
_CLASS = np.zeros(256, "u1")
for _k, _chars in enumerate((b"", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b"#*$%&<>~^=+_\\/@{}[]", b"|", b"!", b".,;:?'\"()-")):
    _CLASS[list(_chars)] = _k
FEATURES = 18


class Lines(NamedTuple):
    """Lines of several documents in turn: features with neighbours', weights, and each document's number of lines."""

    x: np.ndarray
    weight: np.ndarray
    counts: np.ndarray


class Model(NamedTuple):
    weights: np.ndarray
    transition: np.ndarray
    slope: float
    shift: float


def line_features(texts: list[str]) -> Lines:
    """Features of all lines. An empty text has one empty line."""
    counts, words, kinds, repeated, sizes = [], [], [], [], []
    for t in texts:
        lines = t.split("\n")
        counts.append(len(lines))
        met: dict[str, int] = {}
        for line in lines:
            met[line] = met.get(line, 0) + 1
        for line in lines:
            w = line.split()
            words.append(len(w))
            kinds.append(len(set(w)))
            repeated.append(met[line] > 1)
            sizes.append(len(line.encode()))
    data = np.frombuffer("\n".join(texts).encode(), "u1")
    n, sizes = len(sizes), np.array(sizes, "i8")
    of = np.repeat(np.arange(n), sizes + 1)[: len(data)]  # each line with its line feed
    by = np.bincount(of * 8 + _CLASS[data], minlength=n * 8).reshape(n, 8).astype("f4") if len(data) else np.zeros((n, 8), "f4")
    words, kinds, size = np.array(words, "f4"), np.array(kinds, "f4"), np.maximum(sizes, 1).astype("f4")
    letters = np.maximum(by[:, 1] + by[:, 2], 1)
    odd, upper, unique = by[:, 4] / size, by[:, 2] / letters, kinds / np.maximum(words, 1)
    own = np.stack([
        np.ones(n), np.log1p(words) / 5, words == 0, unique, (unique < 0.7) & (words > 8), (unique < 0.4) & (words > 8), odd, odd > 0.02, odd > 0.08,
        upper, upper > 0.3, upper > 0.7, by[:, 3] / size, by[:, 5] / size, (by[:, 5] > 1), by[:, 6] / size > 0.02, by[:, 7] / size, np.array(repeated) & (words > 0),
    ], 1).astype("f4")
    ends = np.cumsum(counts)
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[ends - counts], after[ends - 1] = 0, 0
    return Lines(np.concatenate([own, before, after], 1), size, np.array(counts))


#: Lines of a chain that are taken one after the other. Longer chains are cut into such blocks, which go side by side.
BLOCK = 512


def through(vector: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Row vectors times matrices, of logarithms of weights."""
    return np.logaddexp(vector[:, :1] + matrix[..., 0, :], vector[:, 1:] + matrix[..., 1, :])


def marginals(score: np.ndarray, counts: np.ndarray, transition: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Probability that each line is good, and the sum of pair marginals; ``score`` is that of good over bad.

    Chains are cut into blocks. Each block but a chain's first becomes a matrix, from the label before it to its last line's; going
    over these from block to block, forth and back, gives what enters each block, and the lines in it follow from that.
    """
    node = np.stack([np.zeros_like(score), score], 1)
    forward, backward = np.empty_like(node), np.zeros_like(node)
    parts = -(-counts // block)
    of = np.repeat(np.arange(len(counts)), parts)
    turn = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)  # a block's number in its chain
    starts = (np.cumsum(counts) - counts)[of] + turn * block
    size = np.minimum(counts[of] - turn * block, block)
    order = np.argsort(-size, kind="stable")
    starts, size, turn, of = starts[order], size[order], turn[order], of[order]
    active = [int(np.searchsorted(-size, -t, "left")) for t in range(int(size[0]) if len(size) else 0)]  # blocks with more than t lines
    later = turn > 0
    matrix = np.zeros((len(of), 2, 2))
    if later.any():
        for t, m in enumerate(active):
            k = np.flatnonzero(later[:m])
            here = node[starts[k] + t][:, None, :]
            matrix[k] = transition + here if not t else np.logaddexp(matrix[k][:, :, :1] + transition[0], matrix[k][:, :, 1:] + transition[1]) + here
    enter, leave = np.zeros((len(of), 2)), np.zeros((len(of), 2))
    by_turn = np.argsort(turn, kind="stable")
    ends = np.cumsum(np.bincount(turn)) if len(turn) else []
    at_turn = [by_turn[(ends[i - 1] if i else 0) : ends[i]] for i in range(len(ends))]
    place = np.zeros(len(counts), "i8")  # of each chain's block that was looked at last

    def fill(blocks: np.ndarray) -> None:
        """The lines of blocks, given what enters them."""
        some = np.zeros(len(of), bool)
        some[blocks] = True
        for t, m in enumerate(active):
            k = np.flatnonzero(some[:m])
            at = starts[k] + t
            forward[at] = node[at]
            if t:
                forward[at] += through(forward[at - 1], transition)
            else:
                on = later[k]
                forward[at[on]] += through(enter[k[on]], transition)

    for i, blocks in enumerate(at_turn):
        if i == 0:
            fill(blocks)
            out = forward[starts + size - 1]
        else:
            enter[blocks] = out[place[of[blocks]]]
            out[blocks] = through(enter[blocks], matrix[blocks])
        place[of[blocks]] = blocks
    if later.any():
        fill(np.flatnonzero(later))
    for i in range(len(at_turn) - 1, 0, -1):  # what a block's last line gets from the lines after it
        blocks = at_turn[i]
        before = at_turn[i - 1]
        place[of[before]] = before
        leave[place[of[blocks]]] = np.logaddexp(matrix[blocks][:, :, 0] + leave[blocks][:, :1], matrix[blocks][:, :, 1] + leave[blocks][:, 1:])
    backward[starts + size - 1] = leave
    for t in range(len(active) - 2, -1, -1):
        m = active[t + 1]
        at = starts[:m] + t
        nxt = node[at + 1] + backward[at + 1]
        backward[at] = np.logaddexp(transition[:, 0] + nxt[:, :1], transition[:, 1] + nxt[:, 1:])
    both = forward + backward
    total = np.logaddexp(both[:, 0], both[:, 1])
    inner = np.ones(len(score), bool)
    inner[(np.cumsum(counts) - 1)] = False
    i = np.flatnonzero(inner)
    pair = forward[i][:, :, None] + transition + (node[i + 1] + backward[i + 1])[:, None, :] - total[i][:, None, None]
    return np.exp(both[:, 1] - total), np.exp(pair).sum(0)


def document_means(p: np.ndarray, weight: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean marginal of each document's lines, weighted by length, as log-odds."""
    starts = np.cumsum(counts) - counts
    mean = np.add.reduceat(p * weight, starts) / np.add.reduceat(weight, starts)
    mean = np.clip(mean, 1e-6, 1 - 1e-6)
    return np.log(mean / (1 - mean))


def train(lines: Lines, good: np.ndarray, steps: int = 120, rate: float = 0.1, ridge: float = 1e-3) -> Model:
    """Adam on the mean log-likelihood of all-good and all-bad documents, then a logistic calibration of their scores."""
    y = np.repeat(good.astype("f8"), lines.counts)
    docs, x = len(good), lines.x.astype("f8")
    weigh = np.repeat(1.0 / lines.counts, lines.counts)  # long documents don't outweigh the others
    inner = np.maximum(lines.counts - 1, 0)
    seen = np.diag([inner[good == 0].sum(), inner[good == 1].sum()]).astype("f8")
    theta, m, v = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
    pairs = max(int(inner.sum()), 1)
    for step in range(1, steps + 1):
        p, pair = marginals(x @ theta[:-4], lines.counts, theta[-4:].reshape(2, 2))
        grad = np.append(x.T @ ((y - p) * weigh) / docs, ((seen - pair) / pairs).ravel()) - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    p, _ = marginals(x @ theta[:-4], lines.counts, theta[-4:].reshape(2, 2))
    z = document_means(p, lines.weight, lines.counts)
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton's method
        q = 1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30)))
        g = np.array([(z * (good - q)).mean() - 1e-3 * (slope - 1), (good - q).mean() - 1e-3 * shift])
        h = np.array([[(q * (1 - q) * z * z).mean(), (q * (1 - q) * z).mean()], [(q * (1 - q) * z).mean(), (q * (1 - q)).mean()]]) + 2e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        slope, shift = slope + step[0], shift + step[1]
    return Model(theta[:-4], theta[-4:].reshape(2, 2), max(float(slope), 1e-3), float(shift))


def scores(texts: list[str], model: Model) -> np.ndarray:
    lines = line_features(texts)
    p, _ = marginals(lines.x @ model.weights, lines.counts, model.transition)
    z = document_means(p, lines.weight, lines.counts)
    return 1 / (1 + np.exp(-(model.slope * z + model.shift)))


def score_batches(rows: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        ids, texts = batch.column("_id"), batch.column("_text").to_pylist()
        for at, part in batches(texts):
            yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)), pa.array(scores(part, model))], ["_id", "score"])


def feature_batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        ids, goods, texts = batch.column("_id"), batch.column("good"), batch.column("_text").to_pylist()
        for at, part in batches(texts):
            lines = line_features(part)
            ends = np.cumsum(lines.counts)
            cells = [x.astype("f4").tobytes() for x in np.split(lines.x, ends[:-1])]
            weights = [x.astype("f4").tobytes() for x in np.split(lines.weight, ends[:-1])]
            yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)), goods.slice(at, len(part)), pa.array(cells, pa.binary()), pa.array(weights, pa.binary())], ["_id", "good", "x", "weight"])


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_chars: int = 200_000, max_lines: int = 2_000) -> Model:
    """Model of at most ``max_docs`` labelled documents that aren't held out, those with the smallest hashes of their ids.

    Of these, texts of more than ``max_chars`` characters or ``max_lines`` lines aren't learned from, which bounds what the driver
    holds: 216 bytes a line, 1.3 GB at most.

    Rows with a null id or label are left out. Without both labels the scores are the share of good rows.
    """
    spark = docs.sparkSession
    named = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("good")).filter(F.col("_id").isNotNull() & F.col("good").isNotNull() & ~held_out("_id"))
    named = named.groupBy("_id").agg(F.max("good").alias("good"))
    chosen = named.orderBy(F.xxhash64("_id"), "_id").limit(max_docs).collect()
    if not chosen:
        return Model(np.zeros(3 * FEATURES), np.zeros((2, 2)), 1.0, 0.0)
    small = spark.createDataFrame(chosen, named.schema)
    rows = text_rows(docs, id_col, text_col).join(F.broadcast(small), "_id").filter((F.length("_text") <= max_chars) & (F.length("_text") - F.length(F.translate("_text", "\n", "")) < max_lines)).dropDuplicates(["_id"]).select("_id", "good", "_text")
    kind = rows.schema["_id"].dataType.simpleString()
    rows = sorted(rows.mapInArrow(feature_batches, f"_id {kind}, good int, x binary, weight binary").collect(), key=lambda r: r["_id"])
    if len({r["good"] for r in rows}) < 2:
        share = (sum(r["good"] for r in rows) + 1) / (len(rows) + 2)
        return Model(np.zeros(3 * FEATURES), np.zeros((2, 2)), 1e-3, float(np.log(share / (1 - share))))
    x = [np.frombuffer(r["x"], "f4").reshape(-1, 3 * FEATURES) for r in rows]
    lines = Lines(np.concatenate(x), np.concatenate([np.frombuffer(r["weight"], "f4") for r in rows]), np.array([len(v) for v in x]))
    return train(lines, np.array([r["good"] for r in rows]))


def held_out(id_col: str):
    """Rows that no label is learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_docs: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Score of every document. Null texts count as empty; rows that repeat an id get a row each; null ids aren't held out; an empty table gives an empty one."""
    model = fit(docs, labels, max_docs, id_col, text_col, label_col)
    d = text_rows(docs, id_col, text_col)
    kind = d.schema["_id"].dataType.simpleString()
    out = d.mapInArrow(partial(score_batches, model=model), f"_id {kind}, score double")
    return out.select(F.col("_id").alias("doc_id"), F.coalesce(held_out("_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
