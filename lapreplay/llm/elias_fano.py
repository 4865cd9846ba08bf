"""Elias-Fano sequences and an n-gram trie made of them, over any buffer of bytes (a mapped file, say)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Steps of a quantised probability to a factor of two.
STEPS = 1024


def packed(arrays: Sequence[np.ndarray]) -> bytes:
    """Arrays as one buffer: their number, the kind and size of each, then their bytes, each from a multiple of eight on."""
    head = [len(arrays)]
    parts = []
    for a in arrays:
        head += [int.from_bytes(a.dtype.str[1:].encode().ljust(8, b"\0"), "little"), len(a)]
        raw = a.tobytes()
        parts.append(raw + bytes(-len(raw) % 8))
    return np.array(head, "i8").tobytes() + b"".join(parts)


def unpacked(buffer) -> list[np.ndarray]:
    """The arrays of such a buffer, as views of it."""
    count = int(np.frombuffer(buffer, "i8", 1)[0])
    head = np.frombuffer(buffer, "i8", 2 * count, 8)
    at, out = 8 * (1 + 2 * count), []
    for kind, n in head.reshape(-1, 2).tolist():
        t = np.dtype(kind.to_bytes(8, "little").rstrip(b"\0").decode())
        out.append(np.frombuffer(buffer, t, n, at))
        at += -(-n * t.itemsize // 8) * 8
    return out


def encode(values: np.ndarray, universe: int) -> list[np.ndarray]:
    """A sorted sequence of numbers below ``universe``: its sizes, the packed low bits of each, and the high bits in unary."""
    n = len(values)
    values = values.astype("u8", copy=False)
    low = max(0, (universe // max(n, 1)).bit_length() - 1)
    words = np.zeros(-(-n * low // 64) + 2, "u8")
    if n and low:
        bits = values & np.uint64((1 << low) - 1)
        at = np.arange(n, dtype="i8") * low
        word, off = at >> 6, (at & 63).astype("u8")
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        words[word[starts]] = np.bitwise_or.reduceat(bits << off, starts)
        over = np.flatnonzero(off.astype("i8") + low > 64)
        words[word[over] + 1] |= bits[over] >> (np.uint64(64) - off[over])
    high = (values >> np.uint64(low)).astype("i8")
    unary = np.zeros(n + ((universe - 1) >> low if universe else 0) + 1, bool)
    unary[high + np.arange(n)] = True
    return [np.array([n, low, len(unary)], "i8"), words, np.packbits(unary, bitorder="little")]


class EliasFano:
    """A stored sequence. ``ends``, how many elements have at most each high part, is a directory made when it is opened."""

    def __init__(self, parts: Sequence[np.ndarray]):
        (self.n, self.low, size), self.words, unary = parts[0].tolist(), parts[1], parts[2]
        zeros = np.flatnonzero(np.unpackbits(unary, count=size, bitorder="little") == 0)
        self.ends = zeros - np.arange(len(zeros))
        self.mask = np.uint64((1 << self.low) - 1)

    def lows(self, i: np.ndarray) -> np.ndarray:
        """The low bits of the elements ``i``."""
        at = i * self.low
        word, off = at >> 6, (at & 63).astype("u8")
        rest = (self.words[word + 1] << np.uint64(1)) << (np.uint64(63) - off)  # nothing where off is 0
        return ((self.words[word] >> off) | rest) & self.mask

    def all(self) -> np.ndarray:
        """The whole sequence."""
        i = np.arange(self.n)
        high = np.searchsorted(self.ends, i, "right").astype("u8")
        return (high << np.uint64(self.low)) | self.lows(i)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Successor search: the place of the first element that isn't below each of ``x``, and whether it is equal to it.

        The high part leads to a run of elements by the directory; the low bits are searched in it by halving.
        """
        x = x.astype("u8", copy=False)
        high = np.minimum((x >> np.uint64(self.low)).astype("i8"), len(self.ends))
        beyond = high >= len(self.ends)
        high = np.where(beyond, max(len(self.ends) - 1, 0), high)
        if not self.n:
            return np.zeros(len(x), "i8"), np.zeros(len(x), bool)
        hi = self.ends[high].copy()
        lo = np.where(high > 0, self.ends[high - 1], 0)
        lo[beyond] = hi[beyond] = self.n
        want, end = x & self.mask, hi.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.lows(mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        found = lo < end
        at = np.flatnonzero(found)
        found[at] = self.lows(lo[at]) == want[at]
        return lo, found


def quantised(p: np.ndarray) -> np.ndarray:
    """Probabilities as multiples of 1/STEPS of a halving, rounded down, so that sums never pass one."""
    return np.minimum(np.ceil(-np.log2(p) * STEPS), 65535).astype("u2")


def runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, "i8")


def build(words: np.ndarray, v: np.ndarray, u: np.ndarray, w: np.ndarray, c: np.ndarray, discount: float, whole: tuple[np.ndarray, ...] | None = None) -> bytes:
    """A trie of the trigrams ``u v w`` (places in ``words``, ascending distinct numbers) that ``c`` documents hold each.

    Levels: the words; the contexts ``v``; the followers ``w`` of each with the discounted probability after it; the words
    ``u`` before each; and below each pair ``u v`` its followers, named by their place among the followers of ``v``. A pointer
    says where a context's followers, and the words before it, begin. ``whole``: pairs ``v, w, c`` that replace what
    the trigrams say of these ``v``, of which other tries have the rest.
    """
    d = max(len(words), 1)
    pair = v * d + u
    if (pair[1:] < pair[:-1]).any():
        order = np.argsort(pair)
        pair, v, u, w, c = (x[order] for x in (pair, v, u, w, c))
    key = np.cumsum(np.append(0, pair[1:] != pair[:-1])) * d + w if len(pair) else pair
    if (key[1:] < key[:-1]).any():
        order = np.argsort(key)
        key, v, u, w, c = (x[order] for x in (key, v, u, w, c))
    at = runs(key)
    c = np.add.reduceat(c, at) if len(at) else c
    v, u, w = v[at], u[at], w[at]
    v2, w2, c2 = v, w, c
    if whole is not None and len(whole[0]):
        rest = ~np.isin(v, whole[0])
        v2, w2, c2 = (np.append(a[rest], b) for a, b in zip((v, w, c), whole, strict=True))
    key2 = v2 * d + w2
    order = np.argsort(key2)
    key2, v2, c2 = key2[order], v2[order], c2[order]
    at = runs(key2)
    c2 = np.add.reduceat(c2, at) if len(at) else c2
    key2, v2 = key2[at], v2[at]
    first = runs(v2)
    contexts, follow = v2[first], np.append(first, len(v2))
    kinds = np.diff(follow)
    total = np.add.reduceat(c2, first) if len(first) else c2
    of = np.searchsorted(contexts, v)  # the context of each trigram
    node = runs(v * d + u)
    node_of, before = of[node], np.searchsorted(of[node], np.arange(len(contexts) + 1))
    total3 = np.add.reduceat(c, node) if len(node) else c
    kinds3 = np.diff(np.append(node, len(c)))
    base = np.cumsum(kinds[node_of]) - kinds[node_of] if len(node) else node
    place = np.searchsorted(key2, v * d + w) - follow[of]
    n1, each = len(contexts), np.repeat(np.arange(len(contexts)), kinds)
    level = lambda values, top: encode(values, max(int(top), 1))
    return packed([
        *level(words, words[-1] + 1 if len(words) else 1), *level(contexts, d), *level(each * d + key2 % d, n1 * d), *level(follow, len(key2) + 1), *level(node_of * d + u[node], n1 * d), *level(before, len(node) + 1),
        *level(np.repeat(base, kinds3) + place, int(base[-1] + kinds[node_of[-1]]) if len(node) else 1),
        quantised(discount * kinds / total), quantised((c2 - discount) / np.repeat(total, kinds)), quantised(discount * kinds3 / total3), quantised((c - discount) / np.repeat(total3, kinds3)),
    ])


class Trie:
    """A stored trie. Probabilities are interpolated: what a level's discount leaves goes to the level below."""

    def __init__(self, buffer):
        parts = unpacked(buffer)
        self.words, self.contexts, self.followers, follow, self.befores, before, self.trigrams = (EliasFano(parts[3 * i : 3 * i + 3]) for i in range(7))
        self.left2, self.p2, self.left3, self.p3 = parts[21:]
        self.d = max(self.words.n, 1)
        self.follow, self.before = follow.all().astype("i8"), before.all().astype("i8")
        kinds = np.diff(self.follow)
        each = np.repeat(kinds, np.diff(self.before))
        self.base = np.cumsum(each) - each
        self.value = np.exp2(-np.arange(65536) / STEPS)

    def probabilities(self, words: np.ndarray, floor: np.ndarray, v: np.ndarray, u: np.ndarray, w: np.ndarray, step: int = 1 << 18) -> np.ndarray:
        """Of each ``w`` after ``u v``, which are places in ``words`` (numbers, -1 for none); ``floor`` has the words' own probabilities.

        Words are looked up once, triples in turns of ``step``, and a pair ``u v`` once for all its neighbours.
        """
        name, known = self.words.find(np.maximum(words, 0))
        known &= words >= 0
        context, seen = self.contexts.find(np.where(known, name, 0))
        seen &= known
        p = floor[w]
        for at in range(0, len(v), step):
            at += np.flatnonzero(seen[v[at : at + step]])
            p[at] = self._followed(context[v[at]], name, known, u[at], w[at], p[at])
        return p

    def _followed(self, context: np.ndarray, name: np.ndarray, known: np.ndarray, u: np.ndarray, w: np.ndarray, floor: np.ndarray) -> np.ndarray:
        pair, have = self.followers.find(context * self.d + name[w])
        have &= known[w]
        p = np.where(have, self.value[self.p2[np.where(have, pair, 0)]], 0) + self.value[self.left2[context]] * floor
        key = np.where(known[u], context * self.d + name[u], -1)
        first = runs(key)
        node, there = self.befores.find(np.maximum(key[first], 0))
        there &= key[first] >= 0
        each = np.diff(np.append(first, len(key)))
        node, i = np.repeat(node, each), np.flatnonzero(np.repeat(there, each))
        node = node[i]
        below, hit = self.trigrams.find(self.base[node] + (pair[i] - self.follow[context[i]]))
        hit &= have[i]
        p[i] = np.where(hit, self.value[self.p3[np.where(hit, below, 0)]], 0) + self.value[self.left3[node]] * p[i]
        return p
