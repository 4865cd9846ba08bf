"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Documents are cut into pieces of at most the sequence length; full pieces fill a sequence alone. The
remainders are dealt by hash into blocks of bounded size. Each block is evolved on several islands: crossover
injects whole well-filled bins of one parent into another and drops the bins that then hold duplicates; mutation
dissolves bins that aren't full. What is displaced is exchanged for smaller items of other bins where that fills
them better, and the rest is best-fitted. After each epoch an island's elite moves to its neighbour.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapreplay.llm.common import text_rows, written
from lapreplay.llm.tokens import batches, encoder

STATE = "block long, island int, bins int, items array<long>, rest array<int>, full array<long>, bin array<int>"


def cut_batches(rows: Iterator[pa.RecordBatch], path: str, end_id: int, size: int) -> Iterator[pa.RecordBatch]:
    """Ids of each document and the end id, cut from the back; only lengths and checksums leave the task."""
    for batch in rows:
        ids, texts = batch.column("_id"), batch.column("_text").to_pylist()
        for at, part in batches(texts):
            lengths, sums = [], []
            for x in encoder(path).encode(part):
                x = np.append(x, np.uint32(end_id)).astype("<u4", copy=False)
                first = len(x) % size or size
                lengths.append(len(x))
                sums.append([zlib.crc32(x[:first]), *[zlib.crc32(x[i : i + size]) for i in range(first, len(x), size)]])
            yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)), pa.array(lengths, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], ["_id", "n", "sums"])


def best_fit(order: np.ndarray, lengths: np.ndarray, bins: np.ndarray, loads: list[int], size: int) -> None:
    """Put the items of ``order``, largest first, each into the bin that it fills best; opens bins as needed."""
    rooms: list[list[int]] = [[] for _ in range(size + 1)]
    mask = 0
    for b, load in enumerate(loads):
        rooms[size - load].append(b)
        mask |= 1 << (size - load)
    for item in order.tolist():
        need = int(lengths[item])
        fits = mask >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, b = size, len(loads)
            loads.append(0)
        bins[item] = b
        loads[b] += need
        rooms[room - need].append(b)
        mask |= 1 << (room - need)


def exchange(loose: np.ndarray, lengths: np.ndarray, bins: np.ndarray, loads: np.ndarray, size: int, steps: int = 64) -> np.ndarray:
    """Swap displaced items, one or two at a time, for one smaller item of a bin that they fill better; what is loose after that.

    The best of at most ``steps`` swaps comes first. Each one makes the displaced items smaller, so fewer bins are opened for them.
    """
    placed = np.flatnonzero(bins >= 0)
    for _ in range(min(4 * len(loose), steps)):
        loose = loose[np.argsort(lengths[loose], kind="stable")]
        n, k = lengths[loose], len(loose)
        first, second = np.triu_indices(min(k, 40), 1)
        sums = np.concatenate([n, n[first] + n[second]])
        order = np.argsort(sums, kind="stable")
        own = lengths[placed]
        room = size - loads[bins[placed]]
        best = np.searchsorted(sums[order], own + room, "right") - 1
        gain = np.where(best >= 0, sums[order[best]] - own, 0)
        gain[room == 0] = 0
        full = gain == room  # a bin that is then full can't be bettered
        score = np.where(gain > 0, gain + full * size, 0)
        at = int(score.argmax()) if len(score) else 0
        if not len(score) or score[at] <= 0:
            break
        item, which = placed[at], int(order[best[at]])
        given = [which] if which < k else [int(first[which - k]), int(second[which - k])]
        b = bins[item]
        loads[b] += gain[at]
        bins[loose[given]], bins[item] = b, -1
        placed = np.append(np.delete(placed, at), loose[given])
        loose = np.append(np.delete(loose, given), item)
    return loose


def rebuilt(child: np.ndarray, loose: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """``child`` with its loose items exchanged and best-fitted, and bins numbered anew."""
    kept = np.ones(len(child), bool)
    kept[loose] = False
    out = np.full(len(child), -1)
    names, out[kept] = np.unique(child[kept], return_inverse=True)
    loads = np.bincount(out[kept], lengths[kept], len(names)).astype("i8")
    loose = exchange(loose, lengths, out, loads, size)
    full = loads.tolist()
    best_fit(loose[np.argsort(-lengths[loose], kind="stable")], lengths, out, full, size)
    return out


def crossover(giver: np.ndarray, taker: np.ndarray, lengths: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """A child of ``taker`` with some of the well-filled bins of ``giver``."""
    load = np.bincount(giver, lengths, giver.max() + 1)
    good = (load >= max(np.median(load), 0.98 * size)) & (rng.random(len(load)) < rng.choice([0.02, 0.1, 0.5]))
    given = good[giver]
    spoilt = np.zeros(taker.max() + 1, bool)
    spoilt[taker[given]] = True
    loose = np.flatnonzero(spoilt[taker] & ~given)
    return rebuilt(np.where(given, giver, taker + len(load)), loose, lengths, size)


def mutation(parent: np.ndarray, lengths: np.ndarray, size: int, rng: np.random.Generator, dissolved: int = 6) -> np.ndarray:
    """``parent`` with some bins dissolved, mostly ones that aren't full."""
    load = np.bincount(parent, lengths)
    weight = (size - load) / size + 0.02
    out = rng.choice(len(load), min(dissolved, len(load)), replace=False, p=weight / weight.sum())
    out = np.union1d(out, [load.argmin()])
    return rebuilt(parent, np.flatnonzero(np.isin(parent, out)), lengths, size)


def fitness(bins: np.ndarray, lengths: np.ndarray, size: int) -> tuple[int, float]:
    load = np.bincount(bins, lengths)
    return -len(load), float(((load / size) ** 2).sum())


def evolve(lengths: np.ndarray, parents: list[np.ndarray], seed: int, size: int, population: int = 4, generations: int = 12) -> np.ndarray:
    """The fittest assignment of items to bins after some generations. Stops early at the lower bound."""
    rng = np.random.default_rng(seed)
    people = list(parents)
    while len(people) < population:  # best fit in descending order, then in orders that are noisier and noisier
        noise = len(people) * 0.02 * size
        order, bins = np.argsort(-(lengths + rng.random(len(lengths)) * noise), kind="stable"), np.full(len(lengths), -1)
        best_fit(order, lengths, bins, [], size)
        people.append(bins)
    rank = lambda x: fitness(x, lengths, size)
    people.sort(key=rank, reverse=True)
    least = -(-int(lengths.sum()) // size)
    for turn in range(generations):
        if people[0].max() + 1 <= least:
            break
        a, b = rng.choice(len(people), 2, replace=False)
        people.append(crossover(people[a], people[b], lengths, size, rng) if turn % 3 == 0 else mutation(people[min(a, b)], lengths, size, rng))
        people.sort(key=rank, reverse=True)
        people.pop()
    return people[0]


def island_epoch(size: int, epoch: int):
    """The function of (key, rows) that evolves one island for one epoch."""
    return lambda key, rows: evolve_group(key, rows, size, epoch)


def evolve_group(key: tuple, rows: pd.DataFrame, size: int, epoch: int) -> pd.DataFrame:
    """One island's epoch. The first takes the block's items, later ones the island's own elite and its neighbour's."""
    block, island = (int(k) for k in key)
    if epoch:
        rows = rows.sort_values("bins", kind="stable")
        items, rest, full = (np.asarray(rows[c].iloc[0]) for c in ("items", "rest", "full"))
        parents = [np.asarray(x)[rest > 0] for x in rows["bin"]]
    else:
        rows = rows.sort_values("item")
        items, rest, full, parents = rows["item"].to_numpy(), rows["rest"].to_numpy(), rows["full"].to_numpy(), []
    bins = np.full(len(items), -1)
    if (rest > 0).any():
        bins[rest > 0] = evolve(rest[rest > 0].astype("i8"), parents, (block * 1009 + island) * 31 + epoch, size)
    return pd.DataFrame({"block": [block], "island": [island], "bins": [int(bins.max()) + 1], "items": [items], "rest": [rest], "full": [full], "bin": [bins]})


def placed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequence and offset of each remainder of a block's winner, and the first sequence of its full pieces."""
    for batch in rows:
        for r in batch.to_pylist():
            bins, rest, full = np.array(r["bin"], "i8"), np.array(r["rest"], "i8"), np.array(r["full"], "i8")
            order = np.argsort(bins, kind="stable")
            before = np.cumsum(rest[order]) - rest[order]
            first = np.append(True, bins[order][1:] != bins[order][:-1])
            offset = np.zeros(len(bins), "i8")
            offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
            base = r["block"] << 32
            yield pa.RecordBatch.from_arrays([pa.array(np.array(r["items"], "i8")), pa.array(base + bins), pa.array(offset), pa.array(base + r["bins"] + np.cumsum(full) - full)], ["item", "sequence", "offset", "first_full"])


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 1024, block_items: int = 4096, islands: int = 2, epochs: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Places of all pieces of all documents in sequences of at most ``size`` tokens.

    A document's first piece holds the remainder. A null text is one end id. Rows that repeat an id are packed
    each by itself; null ids stay null; an empty table gives an empty one. A document of any length is cut within
    one task, and only lengths and checksums of its pieces travel.
    """
    d = text_rows(docs, id_col, text_col)
    kind = d.schema["_id"].dataType.simpleString()
    cut = d.mapInArrow(partial(cut_batches, path=tokenizer, end_id=end_id, size=size), f"_id {kind}, n long, sums array<long>")
    cut = written(cut.withColumn("item", F.monotonically_increasing_id()), "pieces")
    blocks = max(1, -(-cut.count() // block_items))
    items = cut.select(F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"), "item", (F.col("n") % size).cast("int").alias("rest"), F.expr(f"n div {size}").alias("full"))
    state = items.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))
    state = state.groupBy("block", "island").applyInPandas(island_epoch(size, 0), STATE)
    for epoch in range(1, epochs):
        state = written(state, "islands")
        moved = state.withColumn("island", ((F.col("island") + 1) % islands).cast("int"))
        state = state.unionByName(moved).groupBy("block", "island").applyInPandas(island_epoch(size, epoch), STATE)
    winner = F.min_by(F.struct("block", "bins", "items", "rest", "full", "bin"), F.struct("bins", "island")).alias("w")
    best = state.groupBy("block").agg(winner).select("w.*")
    places = best.mapInArrow(placed, "item long, sequence long, offset long, first_full long")
    rest = F.col("n") % size
    out = cut.join(places, "item").select("_id", "n", "sequence", "offset", "first_full", rest.alias("rest"), F.posexplode("sums").alias("piece", "ids_crc32"))
    first = (F.col("piece") == 0) & (F.col("rest") > 0)
    fulls = F.col("piece") - (F.col("rest") > 0).cast("int")  # full pieces before this one
    return out.select(
        F.col("_id").alias("doc_id"), "piece",
        F.when(first, 0).otherwise(F.col("rest") + fulls * size).cast("long").alias("start"),
        F.when(first, F.col("rest")).otherwise(size).cast("long").alias("length"), "ids_crc32",
        F.when(first, F.col("sequence")).otherwise(F.col("first_full") + fulls).cast("long").alias("sequence_id"),
        F.when(first, F.col("offset")).otherwise(0).cast("long").alias("offset"),
    )
