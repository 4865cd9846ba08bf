"""N-gram Jaccard join on a prefix tree.

A document is its set of word n-grams, each a 64-bit hash, in one global order: hashes that many documents
hold come last, the rest ascend. Sets that reach the threshold share one of their first n - ceil(t n) + 1
hashes (the prefix), so documents meet by prefix hash.

1. Sets are made once; copies with equal sets are one class. Hashes that are frequent among the low ends of
   all sets go to the end of the order. With l - 1 more hashes in the prefix, similar sets share l of them, by the l
   of the smaller set: a class with fewer hashes that any other has than its smallest partner asks for leaves here.
2. Classes with the same first shared prefix hash form a block of bounded size. A block puts its sets into a
   prefix tree and looks every set up in it: subtrees share the overlap counted so far and are left out once
   what remains can't reach the threshold. A block returns a spanning forest of its links. Classes of a crowd are in a block of
   their commonest prefix hash too.
3. Only pairs that these links leave apart can still matter. They meet at each prefix hash that they share,
   a 512-bit parity sketch rules out most, and the rest are compared exactly.

A prefix hash may belong to a third of all sets. Rows of such hashes are dealt by key as well. In step 3 the sets outside
its largest component are cut into small chunks, all of its sets into larger ones, and each pair of chunks is a group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapreplay.llm.common import BROADCAST_ROWS, text_rows, written, written_alone
from lapreplay.llm.components import components

#: Words that a worker remembers hashes of; it then starts afresh.
REMEMBERED = 400_000
FREQUENT_LIMIT = 1_000_000
BLOCK = 512
#: Sets whose commonest prefix hash more than so many share are in a second block, of that hash.
CROWD = 64
SKETCH = 512
#: Sets of a prefix hash that one group of step 3 compares at most, or so: outside the largest component, and all.
FEW, MANY = 512, 2048
#: One in so many sets is looked at for prefix hashes that very many sets share; the result doesn't depend on what it finds.
SAMPLE, HOT = 50, 40
#: One more than 1/SHARED of the prefix: how many prefix hashes similar sets share, with the prefix that much longer.
SHARED = 2


class _Hashes(dict):
    """Hash of each word; A-Z count as a-z, and nothing else is changed."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word.lower())  # of bytes: ASCII letters only
        return h


class Shingler:
    """Sets of word n-grams, as distinct signed 64-bit hashes in ascending order. The text is UTF-8."""

    def __init__(self, n: int):
        self.n, self.hashes = n, _Hashes()
        self.factors = np.array([pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) | 1 for j in range(n)], "u8")

    def __call__(self, text: bytes) -> np.ndarray:
        if len(self.hashes) > REMEMBERED:
            self.hashes.clear()
        words = text.split()  # at ASCII white space
        if not words:
            return np.zeros(0, "i8")
        h = np.fromiter(map(self.hashes.__getitem__, words), "u8", len(words))
        n = min(self.n, len(h))  # fewer words are one n-gram
        x = np.full(len(h) - n + 1, n, "u8")
        for j in range(n):
            x += h[j : len(h) - n + 1 + j] * self.factors[j]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        return np.unique(x.view("i8"))


def prefix_length(n, num: int, den: int):
    """Sets with a Jaccard similarity of num/den or more share one of so many first elements."""
    return n - -(-num * n // den) + 1


def shared_at_least(p):
    """How many of its longer prefix's hashes a set of prefix length ``p`` must share."""
    return p // SHARED + 1


def needed(n, num: int, den: int):
    """How many of its longer prefix's hashes a set of ``n`` shares with any similar one: as many as the smallest such set asks for."""
    return shared_at_least(prefix_length(-(-num * n // den), num, den))


def packed(tokens: np.ndarray) -> bytes:
    """Eight bytes each."""
    return tokens.astype("<i8").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8")


def sketch(tokens: np.ndarray, bits: int = SKETCH) -> bytes:
    """Parity of how many tokens fall to each bit: two sketches differ in no more bits than their sets in elements."""
    return np.packbits((np.bincount(tokens & (bits - 1), minlength=bits) & 1).astype(bool)).tobytes()


def set_batches(rows: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Sets of the documents; ``key`` names the set."""
    shingles = Shingler(n)
    for batch in parts_of(rows):
        sizes, keys, tokens = [], [], []
        for text in batch.column("_text").to_pylist():
            x = shingles(text)
            sizes.append(len(x))
            keys.append(xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63))
            tokens.append(packed(x))
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("h"), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(tokens, pa.binary())], ["_id", "h", "n", "key", "tokens"])


def parts_of(rows: Iterator[pa.RecordBatch], size: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches in slices: their sets, as Python objects, take more memory than the batch itself."""
    for batch in rows:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def once(rows: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows with a set, one for each key that the task meets."""
    seen: set[int] = set()
    for batch in parts_of(rows):
        for r in batch.to_pylist():
            if r["n"] and r["key"] not in seen:
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(r["key"])
                yield r


def low_end(r: dict, num: int, den: int) -> np.ndarray:
    """Twice the prefix from the low end of a set."""
    return unpacked(r["tokens"][: 16 * prefix_length(r["n"], num, den)])


def low_tokens(rows: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in once(rows):
        held.append(low_end(r, num, den))
        size += len(held[-1])
        if size > 500_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held))], ["token"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held))], ["token"])


def prefixes(rows: Iterator[pa.RecordBatch], frequent, num: int, den: int, hot=None) -> Iterator[pa.RecordBatch]:
    """The prefix of each set: hashes that aren't frequent come first. With ``hot``, ``salt`` deals rows of hot hashes by key."""
    often = frequent.value
    held, size = [], 0

    def out() -> pa.RecordBatch:
        sizes = [len(x[0]) for x in held]
        token, key, n = np.concatenate([x[0] for x in held]), np.repeat([x[1] for x in held], sizes), np.repeat([x[2] for x in held], sizes)
        if hot is None:
            return pa.RecordBatch.from_arrays([pa.array(token)], ["token"])
        tokens, counts = hot.value
        keys = counts[np.minimum(np.searchsorted(tokens, token), len(tokens) - 1)] * is_in(token, tokens) if len(tokens) else np.zeros(len(token), "i8")
        salt = np.where(keys > 0, (key & 0xFFFFFFFF) % np.maximum(keys // MANY, 1) + 1, 0)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (token, key, n, salt, keys)], ["token", "key", "n", "salt", "keys"])

    for r in once(rows):
        p = prefix_length(r["n"], num, den)
        p += shared_at_least(p) - 1
        low = low_end(r, num, den)
        found = low[~is_in(low, often)]
        if len(found) < p:
            every = unpacked(r["tokens"])
            late = is_in(every, often)
            found = np.append(every[~late], every[late])
        held.append((found[:p], r["key"], r["n"]))
        size += p
        if size > 300_000:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def is_in(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)
    return ordered[at] == x


def whole_runs(rows: Iterator[pa.RecordBatch], columns: list[str], alone=lambda table: None) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Of rows sorted by ``token`` and ``key``: tables in which no token is cut off, each key once, and where its runs begin.

    Only tokens of several keys are kept, or those that ``alone`` says. A table holds a batch or two unless one token has
    more, and tokens come in parts of bounded size.
    """
    rest, waiting = None, 0
    for batch in rows:
        table = pa.Table.from_batches([batch]).select(columns)
        rest = table if rest is None else pa.concat_tables([rest, table])
        waiting += batch.num_rows
        if waiting < 20_000:
            continue
        token = rest.column("token").to_numpy()
        if cut := int(np.searchsorted(token, token[-1])):  # the last run may go on
            yield several(rest.slice(0, cut), alone)
            rest, waiting = rest.slice(cut), rest.num_rows - cut
        else:
            waiting = 0
    if rest is not None and rest.num_rows:
        yield several(rest, alone)


def several(table: pa.Table, alone) -> tuple[pa.Table, np.ndarray]:
    token, key = table.column("token").to_numpy(), table.column("key").to_numpy()
    at = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (key[1:] != key[:-1])))  # copies stand side by side
    heads = np.flatnonzero(np.append(True, token[at][1:] != token[at][:-1]))
    sizes = np.diff(np.append(heads, len(at)))
    keep = sizes > 1
    if (more := alone(table)) is not None:
        keep |= more[at[heads]]
    at = at[np.repeat(keep, sizes)]
    return table.take(pa.array(at)), np.append(0, np.cumsum(sizes[keep]))


def shared_rows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix rows whose token more than one key has, with the number of keys; of hot tokens, all rows and about their number."""
    for table, ends in whole_runs(rows, ["token", "key", "n", "keys"], lambda t: t.column("keys").to_numpy() > 0):
        sizes = np.diff(ends)
        keys = np.maximum(np.repeat(sizes, sizes), table.column("keys").to_numpy())
        yield from table.drop_columns(["keys"]).append_column("keys", pa.array(keys, pa.int64())).to_batches()


class Node:
    """A node of the prefix tree: a run of tokens, what follows, sets that end here, most tokens still to come."""

    __slots__ = ("run", "next", "ends", "deepest")

    def __init__(self, run: np.ndarray, deepest: int):
        self.run, self.next, self.ends, self.deepest = run, {}, [], deepest


def insert(root: Node, ids: np.ndarray, name: int) -> None:
    node, at = root, 0
    node.deepest = max(node.deepest, len(ids))
    while at < len(ids):
        child = node.next.get(int(ids[at]))
        if child is None:
            node.next[int(ids[at])] = child = Node(ids[at:], 0)
            node, at = child, len(ids)
            break
        m = min(len(child.run), len(ids) - at)
        other = np.flatnonzero(child.run[:m] != ids[at : at + m])
        same = int(other[0]) if len(other) else m
        if same < len(child.run):  # split
            upper = Node(child.run[:same], child.deepest + len(child.run) - same)
            child.run = child.run[same:]
            upper.next[int(child.run[0])] = child
            node.next[int(ids[at])] = upper
            child = upper
        node, at = child, at + same
        node.deepest = max(node.deepest, len(ids) - at)
    node.ends.append(name)


def look_up(root: Node, ids: np.ndarray, n: int, sizes: np.ndarray, mark: np.ndarray, num: int, den: int) -> list[int]:
    """Sets in the tree whose similarity to ``ids`` (of size ``n``) is num/den or more."""
    mark[ids] = True
    found, todo = [], [(child, 0, 0) for child in root.next.values()]
    while todo:
        node, depth, both = todo.pop()
        both += int(np.count_nonzero(mark[node.run]))
        depth += len(node.run)
        found += [e for e in node.ends if both * (num + den) >= num * (n + int(sizes[e]))]
        if node.next:
            left = min(node.deepest, len(ids) - int(np.searchsorted(ids, node.run[-1], "right")))
            if (both + left) * (num + den) >= num * (n + depth + left):
                todo += [(child, depth, both) for child in node.next.values()]
    mark[ids] = False
    return found


def block_links(rows: pa.Table, num: int, den: int) -> pa.Table:
    """A spanning forest of the links within a block, each link to one set of the tree."""
    rows = rows.sort_by([("n", "ascending"), ("key", "ascending")])
    key, sizes = rows.column("key").to_numpy(), rows.column("n").to_numpy()
    sets = [unpacked(t) for t in rows.column("tokens").to_pylist()]
    names, count = np.unique(np.concatenate(sets), return_counts=True)
    place = np.empty(len(names), "i8")
    place[np.argsort(-count, kind="stable")] = np.arange(len(names))  # what many share comes first
    sets = [np.sort(place[np.searchsorted(names, s)]) for s in sets]
    mark = np.zeros(len(names), bool)
    root, up = Node(np.zeros(0, "i8"), 0), list(range(len(sets)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, s in enumerate(sets):
        for j in look_up(root, s, int(sizes[i]), sizes, mark, num, den):
            a, b = top(i), top(j)
            if a != b:
                up[max(a, b)] = min(a, b)
        insert(root, s, i)
    tops = np.array([top(i) for i in range(len(sets))])
    far = np.flatnonzero(tops != np.arange(len(sets)))
    return pa.table({"a": pa.array(key[far], pa.int64()), "b": pa.array(key[tops[far]], pa.int64())})


def block_function(num: int, den: int):
    return lambda rows: block_links(rows, num, den)


def residual_pairs(rows: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs of a group's keys in different components that sizes and sketches allow: of ``left`` with ``right`` ones.

    A pair that also shares one of the few tokens before comes from there. Those further back aren't looked at: similar
    sets share most of their tokens, so few pairs come twice.
    """
    for table, ends in whole_runs(rows, ["token", "key", "n", "root", "sketch", "before", "rest", "left", "right"]):
        key, n, root, rest, is_left, is_right = (table.column(c).to_numpy() for c in ("key", "n", "root", "rest", "left", "right"))
        bits = np.frombuffer(b"".join(table.column("sketch").to_pylist()), "<u8").reshape(len(key), -1)
        earlier, left, right = table.column("before"), [], []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            some, every = a + np.flatnonzero(is_left[a:b]), a + np.flatnonzero(is_right[a:b])
            for first in range(0, len(some), 128):  # rows of the pairs at a time
                i, j = some[first : first + 128][:, None], every[None, :]
                able = (root[i] != root[j]) & (~rest[j] | (key[i] < key[j])) & (np.minimum(n[i], n[j]) * den >= np.maximum(n[i], n[j]) * num)
                x, y = np.nonzero(able)
                x, y = some[x + first], every[y]
                far = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype="i8")
                near = far * (num + den) <= (n[x] + n[y]) * (den - num)
                for p, q in zip(x[near].tolist(), y[near].tolist(), strict=True):
                    if not set(earlier[p].as_py()) & set(earlier[q].as_py()):
                        left.append(int(key[p]))
                        right.append(int(key[q]))
                if len(left) > 50_000:
                    yield pairs_of(left, right)
                    left, right = [], []
        if left:
            yield pairs_of(left, right)


def pairs_of(left: list[int], right: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def chunk_pairs(rows: DataFrame) -> DataFrame:
    """``rows`` has ``token, key, root`` and of the token ``keys, most`` (sets of its largest component) and ``big`` (that component).

    Every set outside the largest component must meet all others. These sets come in chunks of ``FEW``, all sets in chunks
    of ``MANY``, and each pair of chunks is a group: ``token`` then names it, ``left`` and ``right`` say a row's part in it.
    A token of few sets is one group.
    """
    few, many = (F.greatest(F.ceil(c / size), F.lit(1)).cast("int") for c, size in ((F.col("keys") - F.col("most"), FEW), (F.col("keys"), MANY)))
    rest = F.col("root") != F.col("big")
    own, place = F.pmod(F.xxhash64("key", F.lit(2)), few).cast("int"), F.pmod(F.xxhash64("key", F.lit(3)), many).cast("int")
    cell = lambda i, j, left, right: F.struct(i.alias("i"), j.alias("j"), left.alias("left"), right.alias("right"))
    yes, no = F.lit(True), F.lit(False)
    lefts = F.when(F.col("rest"), F.transform(F.sequence(F.lit(0), F.col("many") - 1), lambda j: cell(F.col("own"), j, yes, j == F.col("place")))).otherwise(F.array().cast("array<struct<i:int,j:int,left:boolean,right:boolean>>"))
    rights = F.transform(F.filter(F.sequence(F.lit(0), F.col("few") - 1), lambda i: ~F.col("rest") | (i != F.col("own"))), lambda i: cell(i, F.col("place"), no, yes))
    d = rows.withColumns({"rest": rest, "few": few, "many": many, "own": own, "place": place})
    d = d.withColumn("cell", F.explode(F.concat(lefts, rights)))
    group = F.xxhash64("token", "cell.i", "cell.j")
    return d.select(group.alias("token"), "key", "n", "root", "sketch", "before", "rest", F.col("cell.left").alias("left"), F.col("cell.right").alias("right"))


def closer(rows: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """The pairs that their long sketches allow. The longer one is folded to the length of the other."""
    for batch in parts_of(rows):
        keep = []
        for r in batch.to_pylist():
            x, y = np.frombuffer(r["x"], "u1"), np.frombuffer(r["y"], "u1")
            while len(x) > len(y):
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            while len(y) > len(x):
                y = y[: len(y) // 2] ^ y[len(y) // 2 :]
            far = int(np.bitwise_count(x ^ y).sum(dtype="i8"))
            keep.append(far * (num + den) <= (r["nx"] + r["ny"]) * (den - num))
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def compare(rows: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """The pairs that are similar, by their sets."""
    for batch in parts_of(rows):
        keep = []
        for r in batch.to_pylist():
            x, y = unpacked(r["x"]), unpacked(r["y"])
            keep.append(int(is_in(x, y).sum()) * (num + den) >= num * (r["nx"] + r["ny"]))
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def with_sides(pairs: DataFrame, data: DataFrame) -> DataFrame:
    """``pairs`` beside ``n`` and ``data`` (as ``x``, ``y``) of both keys."""
    side = lambda end, size, name: data.select(F.col("key").alias(end), F.col("n").alias(size), F.col("data").alias(name))
    return pairs.select("a", "b").join(side("a", "nx", "x"), "a").join(side("b", "ny", "y"), "b").select("a", "b", "nx", "ny", "x", "y")


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose keys are in different components, with these as ``ra``, ``rb``."""
    of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))
    out = pairs.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    return out.select("a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb")).filter("ra <> rb")


def similar_classes(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Size of each document's set of word ``n``-grams, and the smallest id that links reach.

    Documents link when 100 * intersection >= 90 * union (num, den). A text of fewer words is one n-gram. Without
    words it is empty, links with nothing, and its component is its own id; so is a null. Rows that repeat an id
    link like any others. Null ids never name a component unless all of it is null. An empty table gives an empty one.
    Sets of 64-bit hashes are compared and named by 64 bits.
    """
    sets, keys = grouped(docs, n, num, den, id_col, text_col, broadcast_rows)
    least = keys.groupBy("root").agg(F.min("least").alias("component"))
    keys = keys.join(least, "root").select("key", "component")
    out = sets.select("_id", "n", "key").join(keys, "key", "left")
    return out.select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("_id")).alias("component_id"))


def grouped(docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """Each document's set (``_id, h, n, key, tokens``; ``h`` digests the text), and of each distinct set ``key, root, least`` (its smallest id)."""
    d = text_rows(docs, id_col, text_col)
    kind = d.schema["_id"].dataType.simpleString()
    d = d.select("_id", F.xxhash64("_text").alias("h"), F.col("_text").cast("binary").alias("_text"))
    sets = written(d.mapInArrow(partial(set_batches, n=n), f"_id {kind}, h long, n long, key long, tokens binary"), "sets")
    roots = written_alone(docs.sparkSession, lambda: components(class_links(sets, num, den, broadcast_rows)), "roots")
    keys = sets.filter("n > 0").groupBy("key").agg(F.min("_id").alias("least"))
    keys = keys.join(roots, keys["key"] == roots["node"], "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    return sets, written(keys, "keys")


def class_links(sets: DataFrame, num: int, den: int, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Links ``a, b`` between keys of ``sets`` that join the same keys as all links do."""
    spark = sets.sparkSession
    counts = written(sets.select("n", "key", "tokens").mapInArrow(partial(low_tokens, num=num, den=den), "token long").groupBy("token").agg(F.count("*").alias("c")).filter("c > 64"), "frequent")
    # At most FREQUENT_LIMIT hashes are sent to all tasks: the threshold rises until they are few enough.
    least = 64
    while counts.filter(F.col("c") > least).count() > FREQUENT_LIMIT:
        least *= 2
    # Eight bytes each.
    often = spark.sparkContext.broadcast(np.sort(np.array([r["token"] for r in counts.filter(F.col("c") > least).select("token").toLocalIterator()], "i8")))
    hot = spark.sparkContext.broadcast(hot_tokens(sets, often, num, den))
    heads = sets.select("n", "key", "tokens").mapInArrow(partial(prefixes, frequent=often, num=num, den=den, hot=hot), "token long, key long, n long, salt long, keys long")
    heads = heads.repartition("token", "salt").sortWithinPartitions("token", "key")
    shared = written(heads.mapInArrow(shared_rows, "token long, key long, n long, keys long"), "shared")
    partner = F.ceil(F.lit(num) * F.col("n") / den)  # ``needed`` in SQL
    prefix = partner - F.ceil(F.lit(num) * partner / den) + 1
    first = shared.groupBy("key").agg(F.min(F.struct("token", "keys")).alias("t"), F.count("*").alias("c"), F.first("n").alias("n")).filter(F.col("c") >= F.floor(prefix / SHARED) + 1)
    first = written(first.select("key", F.col("t.token").alias("block"), F.col("t.keys").alias("keys")), "first")
    near = F.broadcast(first) if first.count() <= broadcast_rows else first
    own = sets.select("key", "n", "tokens").join(near, "key").groupBy("key").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("block").alias("block"), F.first("keys").alias("keys"))
    own = written(own, "candidates")
    # The first shared hash of a near copy may be one of its few changes, which hardly any other has: where its commonest one has
    # many sets, it is in a block of that too. Else a large group would be left in pieces, and step 3 would list all their pairs.
    homes = shared.groupBy("key").agg(F.max(F.struct("keys", "token")).alias("t")).filter(F.col("t.keys") > CROWD)
    homes = written(homes.select("key", F.col("t.token").alias("block"), F.col("t.keys").alias("keys")), "homes")
    crowded = F.broadcast(homes) if homes.count() <= broadcast_rows else homes
    again = in_blocks(own.select("key", "n", "tokens").join(crowded, "key"), num, den)
    links = written(in_blocks(own, num, den).unionByName(again), "block-links")
    roots = written(components(links), "roots")
    shared = shared.join(near.select("key"), "key", "left_semi")
    rows = shared.join(roots, shared["key"] == roots["node"], "left").select("token", "key", "n", F.coalesce("root", "key").alias("root"))
    # The largest component of each token, and how many of its sets are there; tokens of one component are done.
    tokens = rows.groupBy("token", "root").agg(F.count("*").alias("c")).groupBy("token")
    tokens = tokens.agg(F.sum("c").alias("keys"), F.max("c").alias("most"), F.max_by("root", F.struct("c", "root")).alias("big")).filter("keys > most")
    rows = rows.join(tokens, "token")
    lists = rows.groupBy("key").agg(F.first("n").alias("n"), F.first("root").alias("root"), F.sort_array(F.collect_set(F.struct("token", "keys", "most", "big"))).alias("all"))
    lists = lists.join(own.select("key", "tokens").mapInArrow(sketches, "key long, sketch binary"), "key")
    before = F.transform(F.slice("all", F.greatest(F.col("i") - 3, F.lit(1)), F.least(F.col("i"), F.lit(4))), lambda t: t["token"])
    rows = lists.select("key", "n", "root", "sketch", "all", F.posexplode("all").alias("i", "t")).select("key", "n", "root", "sketch", before.alias("before"), "t.*")
    rows = chunk_pairs(rows).repartition("token").sortWithinPartitions("token", "key")
    pairs = written(rows.mapInArrow(partial(residual_pairs, num=num, den=den), "a long, b long").distinct(), "pairs")
    schema = "a long, b long"
    wide = own.select("key", "tokens").mapInArrow(partial(sketches, scale=4), "key long, sketch binary")
    wide = own.select("key", "n").join(wide.withColumnRenamed("sketch", "data"), "key")
    close = written(with_sides(pairs, wide).mapInArrow(partial(closer, num=num, den=den), schema), "close")
    sets_of = own.select("key", "n", F.col("tokens").alias("data"))
    exact = lambda some: written(with_sides(some, sets_of).mapInArrow(partial(compare, num=num, den=den), schema), "similar")
    one = apart(close, roots).groupBy(F.least("ra", "rb").alias("x"), F.greatest("ra", "rb").alias("y")).agg(F.min(F.struct("a", "b")).alias("p")).select("p.*")
    links = written(links.unionByName(exact(one)), "links")
    return links.unionByName(exact(apart(close, written(components(links), "roots"))))


def in_blocks(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links ``a, b`` within the blocks of ``sets`` (``block, keys, key, n, tokens``), a spanning forest of each.

    A block of many is cut up by hash; every part also gets the same few of its sets, to which most others link.
    """
    parts = F.ceil(F.col("keys") / BLOCK).cast("int")
    hub = F.pmod(F.xxhash64("key", F.lit(1)), F.greatest(F.lit(1), (F.col("keys") / 16).cast("int"))) == 0
    part = F.when(hub, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("key"), parts).cast("int")))
    blocks = sets.select("block", F.explode(part).alias("part"), "key", "n", "tokens").groupBy("block", "part")
    return blocks.applyInArrow(block_function(num, den), "a long, b long")


def hot_tokens(sets: DataFrame, often, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix hashes that very many sets share, ascending, and about how many: at most 10,000, found by one in ``SAMPLE`` sets."""
    some = sets.filter(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(SAMPLE)) == 0).select("n", "key", "tokens")
    counts = some.mapInArrow(partial(prefixes, frequent=often, num=num, den=den), "token long").groupBy("token").agg(F.count("*").alias("c")).filter(F.col("c") >= HOT)
    found = sorted((r["token"], r["c"] * SAMPLE) for r in counts.orderBy(F.col("c").desc(), "token").limit(10_000).collect())
    return np.array([t for t, _ in found], "i8"), np.array([c for _, c in found], "i8")


def sketches(rows: Iterator[pa.RecordBatch], scale: int = 0) -> Iterator[pa.RecordBatch]:
    """Sketches of the sets: of 512 bits, or with ``scale`` of the power of two from so many times the size up."""
    for batch in parts_of(rows):
        sets = [unpacked(t) for t in batch.column("tokens").to_pylist()]
        found = [sketch(s, max(SKETCH, 1 << (scale * len(s)).bit_length()) if scale else SKETCH) for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.binary())], ["key", "sketch"])


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near copies, the one with the smallest id, all columns kept.

    Documents without words stay. Of rows that repeat an id and a text one stays; rows that repeat an id with different
    texts are told apart. A null id counts as the largest, and as equal to other null ids.
    """
    keep = written_alone(docs.sparkSession, lambda: kept_rows(*grouped(docs, n, num, den, id_col, text_col)), "kept")
    digest = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    # Keys without nulls: the join and what follows then share one shuffle.
    out = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(id_col).isNull().alias("_none"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_name"), digest.alias("_h"))
    out = out.join(keep, ["_none", "_name", "_h"], "left_semi").dropDuplicates(["_none", "_name", "_h"])
    return out.select(*[F.col("_doc")[c].alias(c) for c in docs.columns])


def kept_rows(sets: DataFrame, keys: DataFrame) -> DataFrame:
    """``_none, _name`` (of the id) and ``_h`` of the row that stays of each group, and of all rows without words."""
    rows = sets.select("_id", "h", "n", "key").join(keys.select("key", "root"), "key", "left")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), "h")).alias("first")
    groups = rows.filter("n > 0").groupBy("root").agg(first).select(F.col("first.id").alias("_id"), F.col("first.h").alias("_h"))
    every = groups.unionByName(rows.filter("n = 0").select("_id", F.col("h").alias("_h")))
    return every.select(F.col("_id").isNull().alias("_none"), F.coalesce(F.col("_id").cast("string"), F.lit("")).alias("_name"), "_h").distinct()
