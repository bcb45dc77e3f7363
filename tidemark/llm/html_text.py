"""Main text of web pages by wrapper induction over the pages of each host.

A page becomes a tree of containers with slots of text. A host's most common trees, with and
without articles, are its reference; simple tree matching aligns every page of the host with it, whole, list items and table
cells included. Text of containers that match none of the reference is content. Text that is the same
in its slot on most pages of the host is template, in articles and out of them; other text is content.
Containers that say what they are (menus, footers, adverts, forms, comments ...) are never content; of those
that say nothing, slots that are short or dense with links beside the host's large ones are not, either.
A page with articles has text outside them only in slots that vary over the host's pages.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, fresh, table

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|textarea|title|iframe|select|object)\b[^>]*(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_CONTAINERS = frozenset("html head body div section article main nav header footer aside form ul ol li dl table tbody thead tr td th blockquote pre figure details dialog menu button fieldset label center".split())
_BREAKS = frozenset("p br hr h1 h2 h3 h4 h5 h6 dt dd summary figcaption caption option img input address".split())
_REPEATED = frozenset("li tr td th".split())
_NEVER = frozenset("head nav footer aside form menu dialog button fieldset label".split())
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
#: Whole tokens of a class, id or role.
_NOISE = re.compile(
    r"nav|navbar|navigation|menus?|breadcrumbs?|masthead|top-?bar|footer|contentinfo|side-?bar|aside|complementary|widgets?|ads?|adverts?|advertisement|advertising|adsense|sponsor(?:ed)?|promo(?:tion)?s?"
    r"|banner|cookies?|consent|gdpr|notices?|alert|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommend(?:ed|ations)?|comments?|respond|replies|reply|disqus|popup|modal|overlay|pagination|pager|search|skip-?link"
    r"|cookie[-_](?:banner|bar|notice|consent)|(?:share|social|sharing)[-_](?:buttons?|bar|links?)|related[-_](?:posts?|articles?|links?|stories)|disqus[-_]thread",
    re.IGNORECASE,
)
_HEADER = re.compile(r"header|site-?head(?:er)?", re.IGNORECASE)
#: Containers that hold whole pages or their main text, whatever their names say.
_WHOLE = frozenset("html body main article".split())
#: Containers of noise that pages are sometimes wrapped in.
_WRAPPERS = frozenset("form fieldset".split())


def _any(pattern: re.Pattern, names: str) -> bool:
    return any(map(pattern.fullmatch, names.split()))


class Block(NamedTuple):
    """Text of a container; state: 0 plain, 1 in an article, -1 in a container of noise; links: words in links."""

    node: int
    order: int
    state: int
    text: str
    links: int


def parse(page: str | None, names: bool = True) -> tuple[list[tuple[int, str]], list[Block]]:
    """Containers as (parent, label), the root first, and blocks of text. Without ``names`` neither tags nor
    names say anything: every block is plain.

    An article or main lifts the noise of names and forms around it; within an article or main, and in
    menus, footers and the like by tag, noise stays noise (comments are articles, too)."""
    nodes: list[tuple[int, str]] = [(-1, "#")]
    blocks: list[Block] = []
    stack: list[tuple[str, int, int, bool]] = [("#", 0, 0, True)]  # tag, node, state (-2: never lifted), outside article and main
    count = [0]
    buffer: list[str] = []
    linked: list[str] = []
    in_link = False

    def flush() -> None:
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                _, node, state, _ = stack[-1]
                blocks.append(Block(node, count[node], max(state, -1) if names else 0, text, len(" ".join(linked).split())))
                count[node] += 1
            linked.clear()

    def write(piece: str) -> None:
        buffer.append(piece)
        if in_link:
            linked.append(piece)

    at = 0
    page = page or ""
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            write(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if tag == "a":
            in_link = not m["close"]
        if tag in _BREAKS:
            flush()
        elif tag in _CONTAINERS:
            flush()
            if m["close"]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
                continue
            if tag == "li" and stack[-1][0] == "li":
                stack.pop()
            _, parent, state, outside = stack[-1]
            said = " ".join(" ".join(next(filter(None, x), "") for x in _NAMES.findall(m["attrs"] or "")).split())
            if tag in _WHOLE:
                if tag in ("main", "article"):
                    if state == -1 and outside:
                        state = 0
                    if state == 0 and tag == "article":
                        state = 1
                    outside = False
            elif tag in _NEVER and tag not in _WRAPPERS:
                state = -2
            elif tag in _WRAPPERS or (said and _any(_NOISE, said)):
                state = min(state, -1)
            elif state == 0 and (tag == "header" or (said and _any(_HEADER, said))):
                state = -1
            nodes.append((parent, f"{tag}.{said}" if said and tag not in _WHOLE else tag))
            count.append(0)
            stack.append((tag, len(nodes) - 1, state, outside))
        elif m["raw"]:
            pass
    if at < len(page):
        write(page[at:])
    flush()
    return nodes, blocks


def children(nodes: list[tuple[int, str]]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in nodes]
    for i, (parent, _) in enumerate(nodes[1:], 1):
        out[parent].append(i)
    return out


class Shapes:
    """Numbers for equal subtrees, so that each pair of them is compared once."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.of: list[tuple[str, tuple[int, ...]]] = []
        self.size: list[int] = []
        self.height: list[int] = []
        self.score: dict[tuple[int, int], int] = {}

    def read(self, nodes: list[tuple[int, str]]) -> list[int]:
        """The number of each node's subtree; children stand behind their parents."""
        below, out = children(nodes), [0] * len(nodes)
        for i in range(len(nodes) - 1, -1, -1):
            key = (nodes[i][1], tuple(out[c] for c in below[i]))
            if key not in self.number:
                self.number[key] = len(self.of)
                self.of.append(key)
                self.size.append(1 + sum(self.size[c] for c in key[1]))
                self.height.append(1 + max((self.height[c] for c in key[1]), default=0))
            out[i] = self.number[key]
        return out

    def ends(self, xs: Sequence[int], ys: Sequence[int]) -> tuple[int, int]:
        """How many first and last siblings are equal subtrees; to pair these with each other is best."""
        n, k, e = min(len(xs), len(ys)), 0, 0
        while k < n and xs[k] == ys[k]:
            k += 1
        while e < n - k and xs[-1 - e] == ys[-1 - e]:
            e += 1
        return k, e

    def weights(self, xs: Sequence[int], ys: Sequence[int]) -> tuple[dict[int, int], np.ndarray, np.ndarray]:
        """The score of each different one of xs against each of ys."""
        rows, (kinds, at) = {x: i for i, x in enumerate(dict.fromkeys(xs))}, np.unique(np.asarray(ys, dtype=np.int64), return_inverse=True)
        return rows, np.array([[self.pair(x, y) for y in kinds.tolist()] for x in rows], dtype=np.int64), at

    def pair(self, x: int, y: int) -> int:
        return self.size[x] if x == y else self.score[x, y] if self.of[x][0] == self.of[y][0] else 0

    def table(self, xs: Sequence[int], ys: Sequence[int], *, whole: bool) -> np.ndarray:
        """Best scores of the first i of xs with the first j of ys; for all i, or for the last only."""
        rows, w, at = self.weights(xs, ys)
        last = np.zeros(len(ys) + 1, dtype=np.int64)
        out = [last]
        for x in xs:
            now = last.copy()
            np.maximum(last[1:], last[:-1] + w[rows[x]][at], out=now[1:])
            last = np.maximum.accumulate(now)
            if whole:
                out.append(last)
        return np.array(out) if whole else last

    def prepare(self, x: int, y: int) -> None:
        """Scores of x and y and of the pairs below them that they need."""
        todo, needed = [(x, y)], set()
        while todo:
            x, y = todo.pop()
            if x == y or self.of[x][0] != self.of[y][0] or (x, y) in needed or (x, y) in self.score:
                continue
            needed.add((x, y))
            xs, ys = self.of[x][1], self.of[y][1]
            k, e = self.ends(xs, ys)
            todo += [(p, q) for p in set(xs[k : len(xs) - e]) for q in set(ys[k : len(ys) - e])]
        for x, y in sorted(needed, key=lambda xy: self.height[xy[0]]):
            xs, ys = self.of[x][1], self.of[y][1]
            k, e = self.ends(xs, ys)
            equal = sum(self.size[c] for c in (*xs[:k], *xs[len(xs) - e :]))
            xs, ys = xs[k : len(xs) - e], ys[k : len(ys) - e]
            self.score[x, y] = 1 + equal + (int(self.table(xs, ys, whole=False)[-1]) if xs and ys else 0)

    def align(self, xs: Sequence[int], ys: Sequence[int], cells: int = 1 << 21) -> list[tuple[int, int]]:
        """Places of paired siblings; long rows are halved, so that no table has more than ``cells``."""
        out, todo = [], [(0, 0, list(xs), list(ys))]
        while todo:
            a, b, xs, ys = todo.pop()
            k, e = self.ends(xs, ys)
            out += [(a + i, b + i) for i in range(k)] + [(a + len(xs) - i, b + len(ys) - i) for i in range(1, e + 1)]
            a, b, xs, ys = a + k, b + k, xs[k : len(xs) - e], ys[k : len(ys) - e]
            if not xs or not ys:
                continue
            if len(xs) > 1 and len(xs) * len(ys) > cells:
                half = len(xs) // 2
                cut = int(np.argmax(self.table(xs[:half], ys, whole=False) + self.table(xs[half:][::-1], ys[::-1], whole=False)[::-1]))
                todo += [(a, b, xs[:half], ys[:cut]), (a + half, b + cut, xs[half:], ys[cut:])]
                continue
            m, i, j = self.table(xs, ys, whole=True), len(xs), len(ys)
            while i and j:
                if (w := self.pair(xs[i - 1], ys[j - 1])) and m[i][j] == m[i - 1][j - 1] + w:
                    i, j = i - 1, j - 1
                    out.append((a + i, b + j))
                elif m[i][j] == m[i - 1][j]:
                    i -= 1
                else:
                    j -= 1
        return out


def match_trees(a: list[tuple[int, str]], b: list[tuple[int, str]], shapes: Shapes | None = None) -> dict[int, int]:
    """Simple tree matching: pairs of nodes of a and b, order and ancestry kept, as many as can be.
    Nodes stand in document order. Trees of any size and depth are matched whole."""
    shapes = shapes or Shapes()
    na, nb = shapes.read(a), shapes.read(b)
    if a[0][1] != b[0][1]:
        return {}
    shapes.prepare(na[0], nb[0])
    ca, cb = children(a), children(b)
    pairs: dict[int, int] = {}
    todo = [(0, 0)]
    while todo:
        x, y = todo.pop()
        if na[x] == nb[y]:
            pairs.update((x + i, y + i) for i in range(shapes.size[na[x]]))
            continue
        pairs[x] = y
        todo += [(ca[x][i], cb[y][j]) for i, j in shapes.align([na[c] for c in ca[x]], [nb[c] for c in cb[y]])]
    return pairs


def merge_trees(a: list[tuple[int, str]], b: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """``a`` with what ``b`` has besides, each where it stands in b."""
    pairs = match_trees(b, a)
    ca, cb = children(a), children(b)
    out: list[tuple[int, str]] = []
    todo: list[tuple[int | None, int | None, int]] = [(0, 0 if pairs else None, -1)]
    while todo:
        x, y, parent = todo.pop()
        out.append((parent, a[x][1] if x is not None else b[y][1]))
        at, xs, below = len(out) - 1, ca[x] if x is not None else [], []
        done = 0
        for q in cb[y] if y is not None else []:
            if q in pairs:
                until = xs.index(pairs[q], done)
                below += [(p, None, at) for p in xs[done:until]]
                done = until + 1
            below.append((pairs.get(q), q, at))
        todo += reversed(below + [(p, None, at) for p in xs[done:]])
    return out


def skeleton(nodes: list[tuple[int, str]]) -> str:
    """The whole tree as text, for counting."""
    return "\n".join(f"{p} {label}" for p, label in nodes)


def outline(nodes: list[tuple[int, str]]) -> int:
    """A number that trees share which differ in items, rows and cells only."""
    kept: list[int] = []  # for each node the number of its nearest kept one
    lines, n = [], 0
    for p, label in nodes:
        up = kept[p] if p >= 0 else -1
        if label.split(".", 1)[0] in _REPEATED:
            kept.append(up)
        else:
            kept.append(n)
            n += 1
            lines.append(f"{up} {label}")
    return crc32("\n".join(lines).encode("utf-8", "surrogatepass"))


def from_skeleton(text: str) -> list[tuple[int, str]]:
    return [(int(p), label) for p, label in (x.split(" ", 1) for x in text.split("\n"))] if text else [(-1, "#")]


class Aligner:
    """Aligns pages with references; equal pairs of trees are matched once."""

    def __init__(self, limit: int = 5000):
        self.known: dict[tuple[str, str], dict[int, int]] = {}
        self.shapes = Shapes()
        self.limit = limit

    def slots(self, nodes: list[tuple[int, str]], reference: str | None) -> dict[int, int]:
        """For each container of the page its node of the reference, where it has one."""
        key = (skeleton(nodes), reference or "")
        if key not in self.known:
            if len(self.known) >= self.limit or len(self.shapes.of) + len(self.shapes.score) > 100 * self.limit:
                self.known.clear()
                self.shapes = Shapes()
            self.known[key] = match_trees(nodes, from_skeleton(reference or ""), self.shapes)
        return self.known[key]


def template_key(node: int, text: str) -> int:
    return node << 32 | crc32(text.encode("utf-8", "surrogatepass"))


def extract(page: str | None, reference: str | None, template: frozenset | set, aligner: Aligner, varying: frozenset | set = frozenset(), furniture: frozenset | set = frozenset(), names: bool = True) -> str:
    """The text of ``page`` outside noise, template and, where neither tags nor names say what it is, outside
    ``furniture``. On a page with articles, text outside them must be in a slot known to be ``varying``."""
    nodes, blocks = parse(page, names)
    slots = aligner.slots(nodes, reference) if template or varying or furniture else {}
    articles = any(b.state == 1 for b in blocks)
    return " ".join(
        b.text
        for b in blocks
        if b.state >= 0 and (b.node not in slots or template_key(slots[b.node], b.text) not in template) and (b.state == 1 or ((not articles or slots.get(b.node) in varying) and slots.get(b.node) not in furniture))
    )


def furniture(reference: str, words: dict[int, float], links: dict[int, float], *, small: float = 0.1, few: float = 30.0, dense: float = 0.5) -> list[int]:
    """Slots that are around the content, by what their text is like, whatever it says.

    ``words`` has the mean words of a slot on the pages that have it, ``links`` how many of them are in links. A slot with a
    quarter of the words of the largest that is not ``dense`` with links is content, with all below it. Of the
    rest, slots dense with links are furniture, and those of ``few`` words that are ``small`` beside the largest.
    """
    nodes = from_skeleton(reference)
    largest = max((w for n, w in words.items() if links.get(n, 0.0) < dense * w), default=0.0)
    inside = [False] * len(nodes)
    for n, (parent, _) in enumerate(nodes):
        w = words.get(n, 0.0)
        inside[n] = (parent >= 0 and inside[parent]) or (w > 0 and w >= 0.25 * largest and links.get(n, 0.0) < dense * w)
    return sorted(n for n, w in words.items() if n < len(nodes) and w > 0 and not inside[n] and (links.get(n, 0.0) >= dense * w or (w < few and w < small * largest)))


_SLOT, _FILLED, _WHOLE_TEXT, _TEXT, _WORDS, _LINKS = range(6)


def evidence(nodes: list[tuple[int, str]], blocks: list[Block], slots: dict[int, int]) -> dict[tuple[int, int], int]:
    """What one page says of its host's slots, by (kind, key): that it has a slot, that the slot has
    text outside noise, all of that text, and each block of it, as 1 each; and how many words and words in links it has."""
    held: dict[int, list[Block]] = {}
    for b in blocks:
        if b.state >= 0 and b.node in slots:
            held.setdefault(slots[b.node], []).append(b)
    out = {(_SLOT, template_key(slot, "")): 1 for slot in slots.values()}
    for slot, own in held.items():
        out |= {(_FILLED, template_key(slot, "")): 1, (_WHOLE_TEXT, template_key(slot, "\n".join(b.text for b in own))): 1}
        out |= {(_TEXT, template_key(slot, b.text)): 1 for b in own}
        out |= {(_WORDS, template_key(slot, "")): sum(len(b.text.split()) for b in own), (_LINKS, template_key(slot, "")): sum(b.links for b in own)}
    return out


def induce(pages: DataFrame, host: str, *, least_pages: int = 4, share: float = 0.5, names: bool = True) -> DataFrame:
    """One row per host: its reference tree, its template, as keys of node and text, its varying slots and its furniture.

    The reference joins the most common trees of pages with and without articles, each that of the
    most common outline. All pages count, with articles
    or without, copies of one page of a host together as one. Trees and texts are counted where they
    lie before they are shuffled, so a host that has a third of all pages is no burden. A text is
    template if more than ``share`` of the host's pages that have the slot, and ``least_pages`` at
    least, have it there; a slot varies if as many have text there that is not the slot's most common
    whole text. That bounds both by the slots of a tree. Only text outside marked noise is counted.
    """
    (page, same) = fresh(pages, "page", "same")
    hashed = pages.select(host, "html", F.xxhash64("html").alias(page))
    copies = hashed.groupBy(F.col(host).alias("h"), F.col(page).alias("x")).agg(F.count(F.lit(1)).alias(same)).where(F.col(same) > 1)
    copies = Scratch(pages.sparkSession).put(copies, "copies")
    once = hashed.join(copies, (F.col(host) == F.col("h")) & (F.col(page) == F.col("x")), "left").select(host, "html", (1 / F.coalesce(same, F.lit(1))).alias("part"))

    def trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parsed = [parse(h, names) for h in b["html"]]
            yield pd.DataFrame(
                {
                    host: b[host],
                    "article": [any(x.state == 1 for x in blocks) for _, blocks in parsed],
                    "outline": [outline(nodes) for nodes, _ in parsed],
                    "reference": [skeleton(nodes) for nodes, _ in parsed],
                    "part": b["part"],
                }
            )

    @F.pandas_udf("string")
    def merged(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([skeleton(merge_trees(from_skeleton(x), from_skeleton(y))) if x and y else x or y for x, y in zip(a, b, strict=True)], dtype=object)

    counted = once.mapInPandas(trees, f"{host} string, article boolean, outline long, reference string, part double").groupBy(host, "article", "outline", "reference").agg(F.round(F.sum("part"), 6).alias("n"))
    kinds = counted.groupBy(host, "article", "outline").agg(F.max_by("reference", F.struct("n", "reference")).alias("reference"), F.round(F.sum("n"), 6).alias("n"))
    best = [F.max_by("reference", F.when(c, F.struct("n", "reference"))).alias(k) for k, c in (("with", F.col("article")), ("without", ~F.col("article")))]
    references = kinds.groupBy(host).agg(*best, F.round(F.sum("n"), 6).alias("n_pages")).select(host, merged("without", "with").alias("reference"), "n_pages")
    references = Scratch(pages.sparkSession).put(references, "references")

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = Aligner()
        for b in batches:
            n: dict[tuple[str, int, int], float] = {}
            for h, ref, part, page_ in zip(b[host], b["reference"], b["part"], b["html"], strict=True):
                nodes, blocks = parse(page_, names)
                for (kind, key), amount in evidence(nodes, blocks, aligner.slots(nodes, ref)).items():
                    n[h, kind, key] = n.get((h, kind, key), 0.0) + part * amount
            yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=[host, "kind", "key", "n"])

    joined = once.join(references.where(F.col("n_pages") >= least_pages), host)
    keys = joined.select(host, "reference", "part", "html").mapInPandas(texts, f"{host} string, kind int, key long, n double").groupBy(host, "kind", "key").agg(F.round(F.sum("n"), 6).alias("n"))
    keys = Scratch(pages.sparkSession).put(keys.where((F.col("n") >= least_pages) | (F.col("kind") >= _WORDS)).withColumn("slot", F.shiftright("key", 32)), "evidence")
    of = lambda kind: F.when(F.col("kind") == kind, F.col("n"))
    slots = keys.groupBy(host, "slot").agg(F.max(of(_SLOT)).alias("pages"), F.coalesce(F.max(of(_FILLED)) - F.coalesce(F.max(of(_WHOLE_TEXT)), F.lit(0)), F.lit(0)).alias("changing"))
    most = lambda n: (n >= least_pages) & (n > share * F.col("pages"))
    common = keys.where(F.col("kind") == _TEXT).join(slots, [host, "slot"]).where(most(F.col("n")))
    templates = common.groupBy(host).agg(F.collect_list("key").alias("template"))
    varying = slots.where(most(F.col("changing"))).groupBy(host).agg(F.collect_list("slot").alias("varying"))
    lengths = keys.groupBy(host, "slot").agg(F.max(of(_SLOT)).alias("pages"), F.max(of(_WORDS)).alias("words"), F.coalesce(F.max(of(_LINKS)), F.lit(0.0)).alias("links")).where("pages is not null and words is not null")
    lengths = lengths.groupBy(host).agg(F.collect_list(F.struct("slot", (F.col("words") / F.col("pages")).alias("words"), (F.col("links") / F.col("pages")).alias("links"))).alias("lengths"))

    @F.pandas_udf("array<long>")
    def around(reference: pd.Series, slots_: pd.Series) -> pd.Series:
        return pd.Series([furniture(r, {x["slot"]: x["words"] for x in s}, {x["slot"]: x["links"] for x in s}) if s is not None else [] for r, s in zip(reference, slots_, strict=True)], dtype=object)

    none = F.array().cast("array<long>")
    out = references.join(templates, host, "left").join(varying, host, "left").join(lengths, host, "left")
    return out.select(host, "reference", F.coalesce("template", none).alias("template"), F.coalesce(F.col("varying").cast("array<long>"), none).alias("varying"), around("reference", "lengths").alias("furniture"))


def main_text(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", text_col: str = "text", share: float = 0.5, names: bool = True) -> DataFrame:
    """``pages`` with ``text_col``, the main text, instead of the html; other columns stay.

    Null and empty pages, and pages without main text, have an empty text. A null or hostless url
    counts as one host of its own. Rows with equal ids are treated one by one; no text is cut.
    """
    host, page = fresh(pages, "host", "page")
    named = pages.withColumn(host, F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit("")))
    wrappers = Scratch(pages.sparkSession).put(induce(named.select(F.col(host).alias("host"), F.col(html_col).alias("html")), "host", share=share, names=names), "wrappers")
    useful = wrappers.where((F.size("template") > 0) | (F.size("varying") > 0) | (F.size("furniture") > 0)).select(F.col("host").alias("h"), F.col("reference").alias(page), "template", "varying", "furniture")

    def run(pages_: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        aligner = Aligner()
        whole = lambda x: frozenset(() if x is None else x)
        for html, *wrapper in pages_:
            yield pd.Series([extract(h, r, whole(t), aligner, whole(v), whole(f), names) for h, r, t, v, f in zip(html, *wrapper, strict=True)], dtype=object)

    run.__annotations__ = {"pages_": Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    extracted = F.pandas_udf(run, "string")
    keep = [c for c in pages.columns if c not in (html_col, text_col)]
    out = named.join(useful, F.col(host) == F.col("h"), "left")
    return out.select(*[named[c] for c in keep], extracted(named[html_col], F.col(page), F.col("template"), F.col("varying"), F.col("furniture")).alias(text_col))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages; odd rows as ``main_text`` says."""
    out = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
