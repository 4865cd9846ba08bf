"""Personal data: fixed formats, and candidate spans judged by boosted trees.

Generators of high recall propose spans (numbers, addresses, keys) that may overlap the fixed formats and each
other. Boosted trees score each by its format and context. There are no labels for personal data, so the trees are fitted
to planted spans: values of known kinds, personal or not, written into contexts that a sample of the documents gives.
The same rows, kept out of the fit, calibrate a threshold for each kind of span. Chosen spans that overlap become one.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapreplay.llm.common import text_rows, written

KINDS = ("email", "ip", "card", "phone", "contact", "key", "number")
_LOCAL = r"[A-Za-z0-9._%+-]"
_AT = r"[\[(]at[\])]"
# A match begins where a run begins or the last match ended: the same matches as without that, in linear time.
# Repeated groups are possessive: Java matches others by recursion, and a long text overflows the stack.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]+){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "contact": rf"(?:(?<![^\s@])|\G)(?:(?!{_AT})[^\s@])++(?:@|\x20?{_AT}\x20?(?:[^\s@]++@)?)[^\s@]++",
    "key": r"(?:(?<![A-Za-z0-9_/+=-])|\G)[A-Za-z0-9_/+=-]{16,}+",
    "number": r"[0-9](?:[\x20().-]{0,2}[0-9])++",
}
#: What a text must contain for a pattern to match at all.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"(?:[0-9][\x20-]?){15}[0-9]", "phone": r"\+[0-9]", "contact": r"@|[\[(]at[\])]", "key": "[0-9]", "number": "[0-9]"}
SPAN = "array<struct<s:int,e:int,m:string,before:string,after:string>>"
FEATURES = ("size", "digits", "letters", "upper", "other", "kinds", "hex", "at", "named", "assigned", "joined", "dots", "groups", "check")
WORDS = r"(?i)(?:token|secret|passw|api.?key|key|tel|phone|fax|card|iban|ssn|account|mail|contact)"


class Trees(NamedTuple):
    """Boosted trees of depth two: (feature, cut, [feature, cut, low, high] below, the same above), and the thresholds by kind."""

    trees: list[tuple]
    base: float
    thresholds: dict[int, float]


def matches(d: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Adds ``_f_<kind>``: the matches with their places in code points and the text around them."""
    text = F.col("_text")
    able = {k: (F.instr(text, NEEDS[k]) > 0) if k == "email" else text.rlike(NEEDS[k]) for k in kinds}
    d = d.select("*", *[F.when(able[k], F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))).alias(f"_m_{k}") for k in kinds])
    gaps = [F.when(F.size(f"_m_{k}") > 0, F.split(text, PATTERNS[k], -1)).alias(f"_g_{k}") for k in kinds]
    d = d.select("*", *gaps)

    # Lengths of each match with the gap before it, and where it ends.
    gap = lambda k, i: F.coalesce(F.get(F.col(f"_g_{k}"), i), F.lit(""))
    length = lambda k: lambda m, i: F.length(gap(k, i)) + F.length(m)
    none = F.array().cast("array<int>")
    d = d.select("*", *[F.coalesce(F.transform(f"_m_{k}", length(k)), none).alias(f"_l_{k}") for k in kinds])
    d = d.select("*", *[running(F.col(f"_l_{k}")).alias(f"_e_{k}") for k in kinds])

    def placed(k: str) -> Column:
        end = lambda i: F.coalesce(at_place(F.col(f"_e_{k}"), i), F.lit(0))
        span = lambda m, i: F.struct((end(i) - F.length(m)).alias("s"), end(i).alias("e"), m.alias("m"), F.right(gap(k, i), F.lit(30)).alias("before"), F.left(gap(k, i + 1), F.lit(1)).alias("after"))
        return F.coalesce(F.transform(f"_m_{k}", span), F.array().cast(SPAN))

    return d.select("*", *[placed(k).alias(f"_f_{k}") for k in kinds]).drop(*[f"_{x}_{k}" for k in kinds for x in "mgle"])


#: Items that a sweep takes at a time. Appending to an array copies it, so outputs are gathered by chunks: linear for any length.
CHUNK = 256


def swept(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """What a sweep over an array puts out, an array for each chunk of items. ``step``: from state and item to the next state and an array.

    ``items`` is a plain column: it is named twice, so Spark makes it once, before.
    """
    none, several = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(CHUNK)), lambda i: F.slice(items, i + 1, CHUNK))

    def one(a: Column, x: Column) -> Column:
        then, out = step(a["st"], x)
        return F.struct(then.alias("st"), F.concat(a["out"], out).alias("out"))

    def chunk(a: Column, x: Column) -> Column:
        inner = F.aggregate(x, F.struct(a["st"].alias("st"), none.alias("out")), one)
        return F.get(F.transform(F.array(inner), lambda r: F.struct(r["st"].alias("st"), F.concat(a["out"], F.array(r["out"])).alias("out"))), F.lit(0))

    return F.aggregate(chunks, F.struct(state.alias("st"), several.alias("out")), chunk, lambda a: a["out"])


def running(lengths: Column) -> Column:
    """Sums of an array of numbers up to each, by chunks."""
    return swept(lengths, F.lit(0), lambda a, x: (a + x, F.array(a + x)), "int")


def at_place(chunks: Column, i: Column) -> Column:
    """The element at ``i`` of what a sweep with one output for each item has put out."""
    return F.get(F.get(chunks, (i / CHUNK).cast("int")), i % CHUNK)


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    at = F.sequence(F.lit(0), F.length(digits) - 1)
    digit = lambda i: F.substring(F.reverse(digits), i + 1, F.lit(1)).cast("int")
    value = lambda i: F.when(i % 2 == 0, digit(i)).otherwise(F.when(digit(i) > 4, 2 * digit(i) - 9).otherwise(2 * digit(i)))
    return F.aggregate(F.transform(at, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """Whether a match of a fixed format holds."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def with_spans(d: DataFrame) -> DataFrame:
    """``d`` has ``_text``. Adds ``_base`` (spans of the fixed formats by kind, then start) and ``_cands`` with features."""
    d = matches(d, tuple(PATTERNS))
    short = lambda k: lambda x: F.struct(F.lit(KINDS.index(k)).alias("k"), x["s"].alias("s"), x["e"].alias("e"))
    holds = lambda k: lambda x: valid(k, x["m"])
    judged = lambda k: lambda x: features(KINDS.index(k), x)
    base = F.concat(*[F.transform(F.filter(f"_f_{k}", holds(k)), short(k)) for k in KINDS[:4]])
    cands = F.concat(*[F.transform(f"_f_{k}", judged(k)) for k in KINDS[4:]])
    return d.select("*", base.alias("_base"), cands.alias("_cands")).drop(*[f"_f_{k}" for k in PATTERNS])


def features(kind: int, x: Column) -> Column:
    """Format and context of a candidate."""
    m = x["m"]
    without = lambda chars: F.length(m) - F.length(F.regexp_replace(m, chars, ""))
    cells = {
        "size": F.length(m), "digits": without("[0-9]"), "letters": without("[A-Za-z]"), "upper": without("[A-Z]"), "other": without("[^A-Za-z0-9]"),
        "kinds": F.size(F.array_distinct(F.split(m, ""))), "hex": m.rlike("^[0-9a-fA-F]+$").cast("int"), "at": F.instr(m, "@"),
        "named": x["before"].rlike(WORDS).cast("int"), "assigned": x["before"].rlike(r"[=:]\s*[\"']?$").cast("int"),
        "joined": (x["before"].rlike(r"[A-Za-z0-9]$") | x["after"].rlike("[A-Za-z0-9]")).cast("int"), "dots": without(r"\."),
        "groups": F.size(F.split(m, "[^0-9]++")), "check": F.when(without("[0-9]").between(13, 19), luhn(F.regexp_replace(m, "[^0-9]", "")).cast("int")).otherwise(-1),
    }
    return F.struct(F.lit(kind).alias("k"), x["s"].alias("s"), x["e"].alias("e"), *[cells[f].cast("int").alias(f) for f in FEATURES])


def planted(docs: DataFrame, max_docs: int = 400, slots: int = 12) -> DataFrame:
    """``docs`` has ``_text``. Snippets with one value each: ``_text, ps, pe`` (its place) and ``y`` (whether it is personal).

    The contexts come from the ``max_docs`` distinct texts with the smallest hashes, ``slots`` places from each, so their
    number is bounded whatever the table. What is planted where follows from the hash too: equal tables give equal rows.
    """
    d = docs.filter(F.length("_text") >= 20).select("_text", F.xxhash64("_text").alias("h"))
    last = d.select("h").distinct().orderBy("h").limit(max_docs).agg(F.max("h")).first()[0]
    d = d.filter(F.col("h") <= (last if last is not None else 0)).groupBy("h").agg(F.min("_text").alias("_text"))
    d = d.select("h", "_text", F.explode(F.sequence(F.lit(1), F.lit(slots))).alias("slot")).withColumn("r", F.xxhash64("h", "slot"))
    at = F.pmod("r", F.length("_text")).cast("int") + 1
    before = F.regexp_replace(F.substring(F.col("_text"), F.greatest(at - 60, F.lit(1)), F.least(at - 1, F.lit(60))), r"\S*$", "")
    after = F.regexp_replace(F.substring(F.col("_text"), at, F.lit(40)), r"^\S+", "")
    d = written(d.select("r", before.alias("before"), after.alias("after"), F.translate(F.substring(F.col("_text"), at, F.lit(60)), "\n\t\r \"'0123456789.,;:@()[]-/_+=", "").alias("run")), "contexts")
    d = written(d.select("*", F.posexplode(values(F.col("r"), F.col("run"))).alias("i", "v")).filter(F.pmod(F.xxhash64("r", F.lit("value")), F.lit(COUNT)) == F.col("i")), "values")
    cue = F.get(F.col("v.cues"), F.pmod(F.xxhash64("r", F.lit("cue")), F.size("v.cues")).cast("int"))
    d = d.withColumn("head", F.concat("before", F.when(F.length("before") == 0, "").otherwise(" "), cue))
    start = F.length("head")
    return written(d.select(F.concat("head", "v.value", F.when(cue.endswith('"'), '" ').otherwise(" "), "after").alias("_text"), start.alias("ps"), (start + F.length("v.value")).alias("pe"), F.col("v.y").alias("y")), "planted")


#: What may stand before a planted value: of personal ones, of others, and before either.
CUES = {
    "phone": ("Tel. ", "phone: ", "fax ", "call me at ", "mobile ", "", "", ""), "account": ("account ", "SSN ", "IBAN ", "account no. ", "", ""),
    "secret": ('token = "', "api_key=", 'password: "', "secret: ", "Authorization: Bearer ", "key ", "", ""), "mail": ("mail ", "contact: ", "write to ", "", "", ""),
    "plain": ("in ", "on ", "about ", "version ", "page ", "No. ", "see ", "of ", "", "", "", "call ", "the key ", "account of "),
}
COUNT = 32


def values(r: Column, run: Column) -> Column:
    """The planted values for the random number ``r``: an array of ``COUNT`` structs of value, label and cues. ``run`` is a run of letters."""
    wide = lambda name: F.abs(F.xxhash64(r, F.lit(name)) % 1_000_000_000).cast("string")
    digits = lambda n, name: F.substring(F.concat(*[F.lpad(wide(f"{name}{i}"), 9, "7") for i in range(1 + n // 9)]), 1, n)
    coded = lambda n, name: F.substring(F.sha2(F.concat(r.cast("string"), F.lit(name)), 256), 1, n)
    mixed = lambda n, name: F.substring(F.translate(F.base64(F.unhex(F.sha2(F.concat(r.cast("string"), F.lit(name)), 512))), "\r\n", ""), 1, n)
    join = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    one = lambda y, cues, value: F.struct(value.alias("value"), F.lit(y).alias("y"), F.array(*[F.lit(c) for c in CUES[cues]]).alias("cues"))
    year = join(F.when(r % 2 == 0, "19").otherwise("20"), digits(2, "y"))
    month, day = (F.lpad((F.pmod(F.xxhash64(r, F.lit(n)), F.lit(top)) + 1).cast("string"), 2, "0") for n, top in (("m", 12), ("d", 28)))
    word = F.when(F.length(run) >= 4, run).otherwise("someothername")
    cut = F.lower(F.regexp_replace(F.substring(word, 1, 9), "[^A-Za-z]", "n"))
    fails = lambda n: F.concat(digits(n - 1, "c"), F.when(luhn(F.concat(digits(n - 1, "c"), F.lit("4"))), "5").otherwise("4"))
    out = [
        one(1, "phone", join("0", digits(2, "a"), "-", digits(3, "b"), "-", digits(4, "c"))), one(1, "phone", join("(0", digits(3, "a"), ") ", digits(7, "b"))),
        one(1, "phone", join("0", digits(3, "a"), " ", digits(3, "b"), " ", digits(4, "c"))), one(1, "phone", join(digits(3, "a"), ".", digits(3, "b"), ".", digits(4, "c"))),
        one(1, "phone", join("00", digits(2, "a"), " ", digits(9, "b"))), one(1, "account", join(digits(3, "a"), "-", digits(2, "b"), "-", digits(4, "c"))),
        one(1, "account", digits(10, "a")), one(1, "account", digits(11, "a")), one(1, "account", join("DE", digits(2, "a"), digits(9, "b"), digits(9, "c"))),
        one(1, "secret", coded(32, "a")), one(1, "secret", coded(40, "a")), one(1, "secret", F.upper(coded(40, "a"))), one(1, "secret", coded(64, "a")),
        one(1, "secret", mixed(24, "a")), one(1, "secret", mixed(44, "a")), one(1, "secret", join("sk_", mixed(32, "a"))),
        one(1, "mail", join(cut, "[at]", coded(6, "b"), ".com")), one(1, "mail", join(cut, " (at) mail.", cut, ".org")), one(1, "mail", join(cut, "ö@", cut, "ß.de")),
        one(0, "plain", year), one(0, "plain", join(year, "-", month, "-", day)), one(0, "plain", join(day, ".", month, ".", year)), one(0, "plain", join(digits(2, "a"), " ", digits(3, "b"))),
        one(0, "plain", join(digits(1, "a"), ".", digits(3, "b"), ".", digits(3, "c"))), one(0, "plain", digits(6, "a")), one(0, "plain", join(digits(1, "a"), ".", digits(2, "b"), ".", digits(1, "c"), ".", digits(1, "d"))),
        one(0, "plain", fails(16)), one(0, "plain", join(word, word, word, word)), one(0, "plain", join(cut, "/", cut, "/file_", digits(2, "a"))), one(0, "plain", join(cut, "_", cut, "_", cut, "_", digits(1, "a"))),
        one(0, "plain", join("@", cut)), one(0, "plain", join(cut, "@", digits(2, "a"))),
    ]
    return F.array(*out)


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 16, rate: float = 0.4, ridge: float = 1.0) -> tuple[list[tuple], float]:
    """Gradient boosting of trees of depth two with logistic loss; leaves are Newton steps."""
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    z, trees = np.full(len(y), base), []
    cuts = [(f, c) for f in range(x.shape[1]) for c in np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 25)).round(0)) + 0.5]

    def best(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
        gain = lambda a: g[a].sum() ** 2 / (h[a].sum() + ridge)
        return max(cuts, key=lambda fc: gain(rows & (x[:, fc[0]] < fc[1])) + gain(rows & (x[:, fc[0]] >= fc[1])))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        top = best(np.ones(len(y), bool), g, h)
        tree = [*top]
        for rows in (x[:, top[0]] < top[1], x[:, top[0]] >= top[1]):
            f, c = best(rows, g, h)
            low, high = rows & (x[:, f] < c), rows & (x[:, f] >= c)
            leaf = [rate * g[a].sum() / (h[a].sum() + ridge) for a in (low, high)]
            z[low] += leaf[0]
            z[high] += leaf[1]
            tree.append((f, float(c), float(leaf[0]), float(leaf[1])))
        trees.append(tuple(tree))
    return trees, base


def total(x: np.ndarray, trees: list[tuple], base: float) -> np.ndarray:
    z = np.full(len(x), base)
    for f, c, *sides in trees:
        for rows, (g, d, low, high) in zip((x[:, f] < c, x[:, f] >= c), sides, strict=True):
            z += np.where(rows, np.where(x[:, g] < d, low, high), 0)
    return z


def labelled(docs: DataFrame, max_docs: int = 400) -> DataFrame:
    """Candidates that cover most of a planted value: ``y``, ``h`` and the features."""
    d = with_spans(planted(docs, max_docs)).select("_text", "ps", "pe", "y", F.explode("_cands").alias("c"))
    covered = F.least("c.e", "pe") - F.greatest("c.s", "ps")
    d = d.filter(covered * 10 >= (F.col("pe") - F.col("ps")) * 7)
    return d.select("y", F.xxhash64("_text", "c.k").alias("h"), *[F.col(f"c.{f}").alias(f) for f in ("k", *FEATURES)])


def fit(docs: DataFrame, max_docs: int = 400, precision: float = 0.98) -> Trees:
    """Trees from what is planted in at most ``max_docs`` texts; every third row calibrates.

    A kind's threshold is the lowest score from which on ``precision`` of its calibration rows are personal. A kind for
    which there is none, and all kinds where a table has no text to plant in, choose nothing.
    """
    got = labelled(docs, max_docs).orderBy("h").collect()  # some ten rows a text
    if len({r["y"] for r in got}) < 2:
        return Trees([], 0.0, {})
    y = np.array([r["y"] for r in got], "f8")
    x = np.array([[r[f] for f in ("k", *FEATURES)] for r in got], "f8")
    kept = np.arange(len(y)) % 3 == 0  # in the order of hashes
    if len({*y[~kept]}) < 2:
        return Trees([], 0.0, {})
    trees, base = boost(x[~kept], y[~kept])
    z, found = total(x[kept], trees, base), {}
    for k in range(4, len(KINDS)):
        mine = x[kept][:, 0] == k
        found[k] = threshold(z[mine], y[kept][mine], precision)
    return Trees(trees, base, {k: t for k, t in found.items() if t is not None})


def threshold(z: np.ndarray, y: np.ndarray, precision: float) -> float | None:
    """The lowest score from which on ``precision`` of the rows are positive, half way to the next lower score."""
    order = np.argsort(-z, kind="stable")
    z, right = z[order], np.cumsum(y[order])
    last = np.append(z[1:] != z[:-1], True)  # rows of one score go together
    good = np.flatnonzero(last & (right >= precision * np.arange(1, len(z) + 1)) & (right > 0))
    if not len(good):
        return None
    cut = good[-1]
    return float(z[cut] - 1 if cut + 1 == len(z) else (z[cut] + z[cut + 1]) / 2)


def margin(c: Column, model: Trees) -> Column:
    """By how much a candidate's score passes its kind's threshold. The trees are nested conditions: the sum stays in the JVM."""
    at = lambda f: c[("k", *FEATURES)[f]]
    z = F.lit(model.base)
    for f, cut, *sides in model.trees:
        low, high = (F.when(at(g) < d, a).otherwise(b) for g, d, a, b in sides)
        z = z + F.when(at(f) < float(cut), low).otherwise(high)
    cut = F.lit(float("inf"))
    for k, t in model.thresholds.items():
        cut = F.when(c["k"] == k, F.lit(t)).otherwise(cut)
    return z - cut


def with_chosen(d: DataFrame, model: Trees) -> DataFrame:
    """Adds ``_chosen``, all spans to redact: the fixed formats, and beside them the candidates that the trees choose.

    Chosen candidates that overlap make one span, of the kind of the longest; of equally long ones, of the kind that passes
    its threshold by most.
    """
    if not model.thresholds:
        return d.withColumn("_chosen", F.col("_base"))
    judged = F.filter(F.transform("_cands", lambda c: F.struct(c["s"].alias("s"), F.lit(1).alias("c"), c["e"].alias("e"), c["k"].alias("k"), margin(c, model).alias("z"))), lambda c: c["z"] >= 0)
    span = lambda k, s, e: F.struct(k.alias("k"), s.alias("s"), e.alias("e"))
    none = F.struct(F.lit(0).alias("k"), F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit(0).alias("n"), F.lit(0.0).alias("z"))
    empty = F.array().cast("array<struct<k:int,s:int,e:int>>")

    def add(a: Column, c: Column) -> tuple[Column, Column]:
        touch = c["s"] < a["e"]
        pick = lambda x, y: F.when(touch, x).otherwise(y)
        size = c["e"] - c["s"]
        better = (size > a["n"]) | ((size == a["n"]) & (c["z"] > a["z"]))
        best = lambda x, y: pick(F.when(better, x).otherwise(y), x)
        then = F.struct(
            best(c["k"], a["k"]).alias("k"), pick(a["s"], c["s"]).alias("s"), pick(F.greatest(a["e"], c["e"]), c["e"]).alias("e"), best(size, a["n"]).alias("n"), best(c["z"], a["z"]).alias("z"),
        )
        return then, F.when(touch | (a["e"] == 0), empty).otherwise(F.array(span(a["k"], a["s"], a["e"])))

    last = F.array(F.struct(F.lit(END).alias("s"), F.lit(1).alias("c"), F.lit(END).alias("e"), F.lit(0).alias("k"), F.lit(0.0).alias("z")))  # it brings out the one before it
    d = with_free(d.withColumn("_judged", judged)).withColumn("_free", F.concat(F.sort_array("_free"), last))
    d = d.withColumn("_chosen", F.concat("_base", F.flatten(swept(F.col("_free"), none, add, "struct<k:int,s:int,e:int>"))))
    return d.drop("_judged", "_free")


#: Beyond all places in a text.
END = (1 << 31) - 1


def with_free(d: DataFrame) -> DataFrame:
    """Adds ``_free``: of the candidates in ``_judged`` those that no base span overlaps.

    Both are swept in order of their starts, once to meet base spans that begin before a candidate, and back to meet those that
    begin in it.
    """
    kind = "struct<s:int,c:int,e:int,k:int,z:double>"
    empty = F.array().cast(f"array<{kind}>")
    marks = F.transform("_base", lambda b: F.struct(b["s"].alias("s"), F.lit(0).alias("c"), b["e"].alias("e"), b["k"].alias("k"), F.lit(0.0).alias("z")))
    ahead = lambda a, x: (F.when(x["c"] == 0, F.greatest(a, x["e"])).otherwise(a), F.when((x["c"] == 0) | (x["s"] >= a), F.array(x)).otherwise(empty))
    back = lambda a, x: (F.when(x["c"] == 0, x["s"]).otherwise(a), F.when((x["c"] == 1) & (x["e"] <= a), F.array(x)).otherwise(empty))
    alone = (F.size("_base") == 0) | (F.size("_judged") == 0)
    d = d.withColumn("_both", F.when(alone, empty).otherwise(F.sort_array(F.concat(marks, F.col("_judged")))))
    d = d.withColumn("_both", F.reverse(F.flatten(swept(F.col("_both"), F.lit(0), ahead, kind))))
    return d.withColumn("_free", F.when(alone, F.col("_judged")).otherwise(F.flatten(swept(F.col("_both"), F.lit(END), back, kind)))).drop("_both")


def as_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))
    return F.concat_ws(",", F.transform(F.sort_array(spans), one))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 400) -> DataFrame:
    """Spans of personal data in every document, in code points, ends exclusive.

    Null texts are empty; rows that repeat an id get a row each; an empty table gives an empty one. Spans of one
    kind never overlap; of different kinds only those of fixed formats may. The trees are fitted first, to ``max_docs`` texts.
    """
    d = text_rows(docs, id_col, text_col)
    model = fit(d, max_docs)
    d = with_chosen(with_spans(d), model)
    count = lambda k: F.size(F.filter("_base", lambda x: x["k"] == k)).cast("long")
    return d.select(
        F.col("_id").alias("doc_id"), *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])],
        F.sha2(as_text(F.col("_base")), 256).alias("base_sha256"), as_text(F.col("_chosen")).alias("spans"),
    )


#: Code points in a part of a text. A place in a string is found by counting from its start, so a long one is cut, and each cut again.
PART = 1024


def parts_of(text: Column) -> Column:
    cut = lambda t, size, step: F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(step)), lambda i: F.substring(t, i + 1, F.lit(step)))
    return F.flatten(F.transform(cut(text, F.length(text), 64 * PART), lambda t: cut(t, F.lit(64 * PART), PART)))


def between(parts: Column, start: Column, end: Column) -> Column:
    """The code points ``start`` to ``end`` of a text in parts."""
    first = (start / PART).cast("int")
    return F.substring(F.concat_ws("", F.slice(parts, first + 1, (end / PART).cast("int") - first + 1)), start % PART + 1, end - start)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 400) -> DataFrame:
    """``docs`` with every span replaced by its kind in capitals and brackets, all other columns as they were.

    Spans that touch or overlap are replaced as one, by the kind of the first. Null texts stay null; rows that repeat others are
    redacted each; an empty table gives an empty one.
    """
    model = fit(text_rows(docs, id_col, text_col), max_docs)
    names = docs.columns
    d = docs.select(F.struct(*[F.col(c) for c in names]).alias("_row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    d = with_chosen(with_spans(d), model).withColumn("_all", F.sort_array(F.transform("_chosen", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k")))))
    kinds = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS], F.lit(""))
    d = d.withColumn("_parts", parts_of(F.col("_text")))
    piece = lambda p, x: F.array(between(F.col("_parts"), p, x["s"]), F.get(kinds, x["k"]))
    add = lambda p, x: (F.greatest(p, x["e"]), F.when((x["s"] < p) & (p > 0), F.array().cast("array<string>")).otherwise(piece(p, x)))
    last = F.array(F.struct(F.length("_text").alias("s"), F.length("_text").alias("e"), F.lit(len(KINDS)).alias("k")))  # of no kind: it brings the rest of the text
    d = d.withColumn("_items", F.concat("_all", last))
    whole = F.concat_ws("", F.flatten(swept(F.col("_items"), F.lit(0), add, "string")))
    text = F.when(F.col(f"_row.{text_col}").isNull(), None).when(F.size("_all") == 0, F.col("_text")).otherwise(whole)
    return d.select(*[text.alias(c) if c == text_col else F.col(f"_row.{c}").alias(c) for c in names])
