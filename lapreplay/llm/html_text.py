"""Main text of web pages by wrapper induction.

A page becomes a tree of its block elements. Trees of a host's pages are aligned by simple tree matching into
one template, in which neighbours of one shape are one repeated node. A template node counts the text and the link
text that its pages put there. Nodes whose text is the same on nearly all pages are constant, and lists of links are
menus; the others are slots. The main part of a template is the node that names an article and has a share of the slots' text, or else
the one below which the slots have most of it. A page is then aligned to its host's template (a page alone to its own tree):
what fills the main part is its text. Inside it constant blocks go, but for headings and the like, and names of furniture count
only where they say nothing else; outside it such names drop a block, and so do menus.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapreplay.llm.common import written

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*>)", re.DOTALL)
_ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_MAY_HIDE = re.compile(r"hidden|display", re.IGNORECASE)
_ANY_ATTRIBUTE = re.compile(r"([^\s>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]*)))?")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.IGNORECASE)
RAW = frozenset("script style noscript template textarea title iframe svg canvas object select option button xmp".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
FURNITURE = frozenset("head nav footer aside form menu dialog fieldset".split())
#: Words in class, id or role of elements that aren't main text.
NAMES = frozenset(
    "ad ads advert advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification alert sidebar menu menubar nav navbar navigation "
    "breadcrumb breadcrumbs comment comments disqus reply replies respond discussion share sharing social related recommended newsletter subscribe signup popup modal overlay login search pagination pager footer masthead skip toolbar widget".split()
)
#: Of these names the ones that sections of an article have as ids.
SECTIONS = frozenset("discussion related notice search sharing social login signup respond reply replies notification promotion overlay skip".split())
#: Words beside a name of furniture that leave it one.
BESIDE = frozenset("area bar block body box button buttons container content form group inner item items label left link links list main outer panel post posts right row section title top bottom wrap wrapper".split())
#: Constant blocks that belong to a text all the same.
KEPT = frozenset("h1 h2 h3 h4 h5 h6 th dt caption figcaption legend summary".split())
#: A named article is the main part if it has such a share of the slots' text.
NAMED = 0.1
CLOSES_P = BLOCKS - frozenset("caption tbody td tfoot th thead tr legend summary html body head".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: A slot must have been seen on so many pages, and its text be one on such a share of them, to be constant.
LEAST_PAGES, SAME = 4, 0.9
#: A node with such a share of link text is a menu. One below which such a share of the slots' text lies holds the main part.
LINKED, MAIN = 0.6, 0.6
#: Blocks deeper than this belong to their parent's node, in templates only. A template keeps the nodes of most pages.
DEEPEST, NODES = 60, 1_500
#: Larger tables of child pairs are not filled: children are then aligned one after the other.
CELLS = 20_000
WRITTEN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dl table caption figcaption".split())


class Block:
    """A block element: label, whether it is furniture by its own name, its text runs and blocks in order, and its link text's size."""

    __slots__ = ("label", "tag", "skip", "items", "linked")

    def __init__(self, tag: str, label: str, skip: bool):
        self.tag, self.label, self.skip, self.items, self.linked = tag, label, skip, [], 0


def names_of(attributes: str) -> tuple[str, ...]:
    found = " ".join(x for m in _ATTRIBUTE.finditer(attributes) for x in m.groups() if x)
    return tuple(dict.fromkeys(w.lower() for w in re.split(r"[^A-Za-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", found)) if w))


def furniture(attributes: str) -> bool:
    """Whether a block inside an article is furniture by one of its names: a class, role or id of which every word says so."""
    for m in _ATTRIBUTE.finditer(attributes):
        own_id = m[0][:2].lower() == "id"
        for token in (m[1] or m[2] or m[3] or "").split():
            words = [w.lower() for w in re.split(r"[^A-Za-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token)) if w]
            said = [w for w in words if w in NAMES and not (own_id and w in SECTIONS)]
            if said and all(w in NAMES or w in BESIDE for w in words):
                return True
    return False


def hidden(attributes: str) -> bool:
    """Whether an element has the attribute hidden, aria-hidden of true, or display:none in its style."""
    if not _MAY_HIDE.search(attributes):
        return False
    for m in _ANY_ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _NOT_SHOWN.search(value):
            return True
    return False


def parse(page: str) -> Block:
    """Tree of the page's blocks; broken markup is closed as browsers do for paragraphs, items and cells."""
    root = Block("", "", False)
    stack, run, at, link, count = [root], [], 0, -1, Counter()
    low = None

    def flush() -> None:
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if text:
                stack[-1].items.append(text)

    def end_link() -> None:
        nonlocal link
        if link >= 0:
            stack[-1].linked += sum(map(len, run[link:]))
            link = -1

    def close(tags: set[str] | frozenset[str], stop: set[str] | frozenset[str] = frozenset()) -> None:
        if not any(count[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                flush()
                count.subtract(b.tag for b in stack[k:])
                del stack[k:]
                return
            if stack[k].tag in stop:
                return

    for m in _TAG.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            run.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in RAW:
            if not m[1] and not m[3].endswith("/>"):
                low = low or page.lower()
                if len(low) != len(page):  # lower-casing can lengthen a text
                    low = re.sub("[A-Z]", lambda c: c[0].lower(), page)
                end = low.find(f"</{tag}", at)
                at = len(page) if end < 0 else (page.find(">", end) + 1 or len(page))
            continue
        if tag == "a":
            end_link()
            link = -1 if m[1] else len(run)
            continue
        if tag == "br" or tag == "hr" or tag in BLOCKS:
            open_link = link >= 0
            end_link()
            link = 0 if open_link and tag not in BLOCKS else -1
        if tag == "br" or tag == "hr":
            flush()
        elif tag not in BLOCKS:
            continue
        elif m[1]:
            flush()
            close({tag})
        else:
            flush()
            if tag in CLOSES_P:
                close({"p"}, CLOSES_P - {"p"})
            if tag in SIBLINGS:
                close(SIBLINGS[tag], SCOPES[tag])
            names = names_of(m[3]) if "=" in m[3] else ()
            inside = count["article"] or count["main"]
            skip = tag in FURNITURE or tag == "header" and not inside or tag not in ("html", "body", "article", "main") and ((furniture(m[3]) if inside else any(n in NAMES for n in names)) or hidden(m[3]))
            block = Block(tag, " ".join((tag, *names)), skip)
            stack[-1].items.append(block)
            stack.append(block)
            count[tag] += 1
    if at < len(page):
        run.append(page[at:])
    end_link()
    flush()
    return root


#: A template node: its label, pages, own text (its checksum), votes for that text, pages with any own text, children,
#: characters of own text, and of those the ones in links.
LABEL, PAGES, TEXT, VOTES, FILLED, KIDS, CHARS, LINKS = range(8)


def shape(block: Block, depth: int = 0) -> list:
    """The page's tree as a template of one page; neighbours with one label and children are one node. No deeper than ``DEEPEST``."""
    own = [x for x in block.items if isinstance(x, str)]
    kids: list[list] = []
    linked = block.linked
    for x in block.items:
        if isinstance(x, str):
            continue
        if depth == DEEPEST:
            own += [t for b in walk(x) for t in b.items if isinstance(t, str)]
            linked += sum(b.linked for b in walk(x))
            continue
        s = shape(x, depth + 1)
        if kids and alike(kids[-1], s):
            kids[-1] = merge(kids[-1], s, same_page=True)
        else:
            kids.append(s)
    text = zlib.crc32("\n".join(own).encode()) if own else None
    chars = sum(map(len, own))
    return [block.label, 1, text, int(bool(own)), int(bool(own)), kids, chars, min(linked, chars)]


def walk(block: Block) -> Iterator[Block]:
    """``block`` and all blocks in it, in page order."""
    todo = [block]
    while todo:
        b = todo.pop()
        yield b
        todo += [x for x in reversed(b.items) if not isinstance(x, str)]


def alike(a: list, b: list) -> bool:
    """Whether neighbours are a repetition: of one label, with children of the same labels."""
    return a[LABEL] == b[LABEL] and {k[LABEL] for k in a[KIDS]} == {k[LABEL] for k in b[KIDS]}


def match(a: list, b: list) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: the size of the largest matching of two trees, and the pairs of children in it."""
    if a[LABEL] != b[LABEL]:
        return 0, []
    x, y = a[KIDS], b[KIDS]
    m, n = len(x), len(y)
    if not m or not n:
        return 1, []
    labels = [k[LABEL] for k in x]
    if labels == [k[LABEL] for k in y] and len(set(labels)) == m:  # one way to match
        return 1 + sum(match(p, q)[0] for p, q in zip(x, y, strict=True)), [(i, i) for i in range(m)]
    if m * n > CELLS:
        return in_turn(x, y)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    w = [[match(p, q)[0] for q in y] for p in x]
    for i in range(m):
        for j in range(n):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + w[i][j])
    pairs, i, j = [], m, n
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return 1 + best[m][n], pairs[::-1]


def in_turn(x: list[list], y: list[list]) -> tuple[int, list[tuple[int, int]]]:
    """Children with very many siblings: each is matched to the next one of its label."""
    places: dict[str, list[int]] = {}
    for j in range(len(y) - 1, -1, -1):
        places.setdefault(y[j][LABEL], []).append(j)
    pairs, last = [], -1
    for i, k in enumerate(x):
        waiting = places.get(k[LABEL], [])
        while waiting and waiting[-1] <= last:
            waiting.pop()
        if waiting and waiting[-1] - last < 50:
            last = waiting.pop()
            pairs.append((i, last))
    return 1 + len(pairs), pairs


def merge(a: list, b: list, same_page: bool = False) -> list:
    """Template of both trees. What only one has is kept. A text that differs makes a slot of the node."""
    _, pairs = match(a, b)
    x, y = a[KIDS], b[KIDS]
    kids, i, j = [], 0, 0
    for p, q in [*pairs, (len(x), len(y))]:
        kids += x[i:p] + y[j:q]
        if p < len(x) and q < len(y):
            kids.append(merge(x[p], y[q], same_page))
        i, j = p + 1, q + 1
    chars, links = a[CHARS] + b[CHARS], a[LINKS] + b[LINKS]
    if same_page:  # a run's text is that of all its members
        own = [t for t in (a[TEXT], b[TEXT]) if t is not None]
        text = zlib.crc32(repr(own).encode()) if len(own) > 1 else own[0] if own else None
        return [a[LABEL], 1, text, int(bool(own)), int(bool(own)), kids, chars, links]
    # The commoner text stays the node's own (a majority vote, which merges in any order).
    if a[TEXT] == b[TEXT]:
        text, same = a[TEXT], a[VOTES] + b[VOTES]
    elif a[VOTES] >= b[VOTES]:
        text, same = a[TEXT], a[VOTES] - b[VOTES]
    else:
        text, same = b[TEXT], b[VOTES] - a[VOTES]
    return [a[LABEL], a[PAGES] + b[PAGES], text, same, a[FILLED] + b[FILLED], kids, chars, links]


def nodes(t: list) -> Iterator[list]:
    todo = [t]
    while todo:
        t = todo.pop()
        yield t
        todo += t[KIDS]


def pruned(t: list) -> list:
    """The template without its rarest nodes where it has more than ``NODES``: they would tell nothing of the host."""
    pages = sorted((n[PAGES] for n in nodes(t)), reverse=True)
    if len(pages) <= NODES:
        return t
    least = pages[NODES] + 1

    def cut(n: list) -> list:
        return [*n[:KIDS], [cut(k) for k in n[KIDS] if k[PAGES] >= least], *n[CHARS:]]

    return cut(t)


def constant(node: list) -> bool:
    """Whether nearly all pages that have this node have one text in it: a vote won by that margin."""
    return node[TEXT] is not None and node[FILLED] >= LEAST_PAGES and node[VOTES] >= (2 * SAME - 1) * node[FILLED]


class Place:
    """A template node as pages use it: whether its text goes, whether it is a menu, and whether the main part begins here."""

    __slots__ = ("label", "drop", "menu", "main", "kids", "mass")

    def __init__(self, node: list):
        self.label, self.main = node[LABEL], False
        self.kids = [Place(k) for k in node[KIDS]]
        self.drop = constant(node)
        own = 0 if self.drop or node[LINKS] > LINKED * node[CHARS] else node[CHARS]
        chars, links = (sum(n[c] for n in nodes(node)) for c in (CHARS, LINKS))
        self.menu = node[PAGES] >= LEAST_PAGES and links > LINKED * chars
        self.mass = 0 if self.menu else own + sum(k.mass for k in self.kids)

    def tag(self) -> str:
        return self.label.split(" ")[0]


def main_place(root: Place) -> Place:
    """Where the slots' text is: from the root down into the one child that has most of it, until text stands there itself."""
    node = root
    while node.kids:
        written = node.mass - sum(k.mass for k in node.kids if k.tag() not in WRITTEN)
        best = max(node.kids, key=lambda k: k.mass)
        if written > 0.05 * node.mass or best.mass < MAIN * node.mass or best.tag() in ("ul", "ol", "menu", "tbody", "tr"):
            break
        node = best
    return node


def placed(template: list) -> Place:
    """The template as pages use it."""
    root = Place(guarded(template))
    for part in named_places(root) or [main_place(root)]:
        part.main = True
    return root


def named_places(root: Place) -> list[Place]:
    """The outermost nodes of the first kind of ``article`` and ``main`` that has a share of the slots' text."""
    for tag in ("article", "main"):
        found, todo = [], [root]
        while todo:
            p = todo.pop()
            if p.tag() == tag:
                found.append(p)
            else:
                todo += p.kids
        if found and sum(p.mass for p in found) > NAMED * root.mass:
            return found
    return []


def guarded(node: list) -> list:
    """Where a main part has few slots, or a whole page hardly any text in some, the pages are copies: nothing in it is constant."""
    tag = node[LABEL].split(" ")[0]
    if tag in ("article", "main", "body"):
        found = [(not constant(n), n[CHARS]) for n in nodes(node) if n[FILLED]]
        some, every = sum(slot for slot, _ in found), len(found)
        chars, whole = sum(n for slot, n in found if slot), sum(n for _, n in found)
        if (2 * some < every or not some) and (tag != "body" or 5 * chars < whole):
            return forget(node)
    return [*node[:KIDS], [guarded(k) for k in node[KIDS]], *node[CHARS:]]


def forget(node: list) -> list:
    return [node[LABEL], node[PAGES], None, 0, node[FILLED], [forget(k) for k in node[KIDS]], *node[CHARS:]]


def extract(page: str, template: Place | None) -> str:
    """Main text of a page, blocks joined by line feeds."""
    root = parse(page)
    own = None
    for place in (template, False):
        if place is False:  # no template, or one that the page doesn't fit: its own tree
            place = own = placed(shape(root))
        if place is not None:
            parts = main_parts(root, place)
            named = find(root, ("article",)) or find(root, ("main",))
            if parts and named and not all(any(b is x for p in parts for x in walk(p)) for b in named):
                continue  # the template's main part isn't where the page itself has one
            text = lines(root, place, {id(b) for b in parts})
            if text:
                return "\n".join(text)
    # Nothing stands out: all but furniture.
    named = find(root, ("article",)) or find(root, ("main",)) or find(root, ("body",)) or [root]
    return "\n".join(lines(root, own if find(root, ("article", "main")) else None, {id(b) for b in named}) or lines(root, None, {id(b) for b in named}))


def main_parts(root: Block, template: Place) -> list[Block]:
    """The page's blocks that are aligned to the template's main part."""
    out, todo = [], [(root, template)]
    while todo:
        item, place = todo.pop()
        if item.skip or place is None or place.menu and not place.main:
            continue
        if place.main:
            out.append(item)
            continue
        kids = [x for x in item.items if not isinstance(x, str)]
        places = places_of(kids, place) if kids else {}
        todo += [(x, places.get(id(x))) for x in reversed(kids)]
    return out


def find(root: Block, tags: tuple[str, ...]) -> list[Block]:
    """Outermost blocks with these tags and any text, outside furniture."""
    out, todo = [], [root]
    while todo:
        block = todo.pop()
        if block.skip:
            continue
        if block.tag in tags:
            if any_text(block):
                out.append(block)
        else:
            todo += [x for x in reversed(block.items) if not isinstance(x, str)]
    return out


def any_text(block: Block) -> bool:
    todo = [block]
    while todo:
        b = todo.pop()
        for x in b.items:
            if isinstance(x, str):
                return True
            if not x.skip:
                todo.append(x)
    return False


def lines(root: Block, template: Place | None, main: set[int]) -> list[str]:
    """Text of the blocks ``main`` that isn't constant on the page's places in the template."""
    out, todo = [], [(root, template, False)]
    while todo:
        item, place, inside = todo.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        if item.skip:
            continue
        inside = inside or id(item) in main
        kids = [x for x in item.items if not isinstance(x, str)]
        places = places_of(kids, place) if place is not None and kids else {}
        shown = inside and not (place is not None and place.drop and item.tag not in KEPT)
        todo += [(x, places.get(id(x)), inside) for x in reversed(item.items) if shown or not isinstance(x, str)]
    return out


def places_of(kids: list[Block], place: Place) -> dict[int, Place]:
    """The template node of each child: runs of alike children are aligned to the node's children in order."""
    runs: list[list[Block]] = []
    sets: list[frozenset[str]] = []
    for k in kids:
        labels = frozenset(x.label for x in k.items if not isinstance(x, str))
        if runs and runs[-1][0].label == k.label and sets[-1] == labels:
            runs[-1].append(k)
        else:
            runs.append([k])
            sets.append(labels)
    thin = lambda label, below: [label, 1, None, 0, 0, [[x, 1, None, 0, 0, [], 0, 0] for x in below], 0, 0]
    own = thin("", ())
    own[KIDS] = [thin(r[0].label, dict.fromkeys(x.label for x in r[0].items if not isinstance(x, str))) for r in runs]
    there = thin("", ())
    there[KIDS] = [thin(k.label, dict.fromkeys(x.label for x in k.kids)) for k in place.kids]
    _, pairs = match(own, there)
    return {id(b): place.kids[j] for i, j in pairs for b in runs[i]}


def host_of(url):
    return F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def page_templates(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One template for each host that the task meets."""
    held: dict[str, list] = {}
    for batch in rows:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            s = shape(parse(page))
            held[host] = pruned(merge(held[host], s) if host in held else s)
        if len(held) > 500:
            yield sent(held)
            held = {}
    if held:
        yield sent(held)


def sent(held: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([json.dumps(t) for t in held.values()])], ["host", "template"])


def merge_group(rows: pd.DataFrame) -> pd.DataFrame:
    whole = None
    for t in sorted(rows["template"]):
        whole = pruned(merge(whole, json.loads(t))) if whole else json.loads(t)
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "template": [json.dumps(whole)]})


@lru_cache(maxsize=256)
def _read(template: str) -> Place:
    return placed(json.loads(template))


def text_batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        found = [extract(p, _read(t) if t else None) for p, t in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_url"), pa.array(found, pa.string())], ["_id", "_url", "text"])


def templates(pages: DataFrame, parts: int = 32) -> DataFrame:
    """``pages`` has ``host, html``. One template per host.

    Tasks send one template of bounded size per host they meet, never pages. A host's templates are merged in ``parts``
    groups first, so that no task merges those of all tasks for a host that has most pages.
    """
    partial = pages.filter("host <> ''").select("host", "html").mapInArrow(page_templates, "host string, template string")
    partial = partial.withColumn("part", F.pmod(F.xxhash64("template"), F.lit(parts)))
    some = partial.groupBy("host", "part").applyInPandas(merge_group, "host string, template string")
    return some.groupBy("host").applyInPandas(merge_group, "host string, template string")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Main text of every page.

    Null html is empty. Pages without a host get no template, only the rules on names and tags. Rows that repeat an id
    get a row each; an empty table gives an empty one. Templates are broadcast up to ``broadcast_bytes``.
    """
    d = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    known = written(templates(d), "templates")
    size = known.agg(F.sum(F.octet_length("template") + F.octet_length("host") + 64)).first()[0] or 0
    known = F.broadcast(known) if size <= broadcast_bytes else known
    kind = d.schema["_id"].dataType.simpleString()
    out = d.join(known, "host", "left").select("_id", "_url", "html", "template").mapInArrow(text_batches, f"_id {kind}, _url string, text string")
    return out.select(F.col("_id").alias("page_id"), F.col("_url").alias("url"), "text", F.length("text").cast("long").alias("n_chars"))
