"""Main text of web pages by wrapper induction.

Pages of one host come from few templates, told apart by a page's set of label paths. Each host has up to EXEMPLARS pages
as exemplars: of the path sets that cover most (pages times paths) the page of least hash of its id and address; pages
without text are none. Every page's block tree is aligned with the first exemplar's and with that of the nearest path
set by simple tree matching (Yang 1991: equal labels, then the best ordered matching of children). Counts over all pages of
a host, summed across partitions, make the wrapper, so a host of any size is never gathered:

* where aligned texts agree on most of the pages, the node is template, unless nothing but such nodes is in an exemplar (its
  pages are copies); where they vary, it is a slot;
* the slot of the article is the deepest container that holds CORE of what varies on the host's pages, with the headline
  if one such container has it.

A page's text is what the article's slot holds without template nodes. Only what a wrapper can't tell is left to names:
parts that vary and say what they are (menus, headers, footers, asides, notices, adverts, forms, comments), and the article's
place on pages whose host has no wrapper or that don't align with it.

Exemplars and wrappers meet their pages by host: sent to all executors while their bytes are below BROADCAST_BYTES; beyond,
both are dealt out by host, hot hosts over several tasks, each of which gets the host's wrapper once, before its pages.

Results: a row per page: page_id, url, text, n_chars. Null and empty pages have an empty text; a null or odd url makes
a host of its own name; repeated rows give repeated results; no pages give none; further columns are ignored. Hosts of
fewer than LEAST pages have no wrapper. Trees have at most html.DEPTH levels, so deep pages align like others. Matching is
exact for lists of any length; those of more than MATCH child pairs take linear memory.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, steps, table
from tessera.llm.html import Node, parse, text_size

#: Pages a node must be seen on, and the share of them that agree on its text, to be template.
LEAST, AGREE = 5, 0.8
#: Exemplars of a host, and path sets of a host that a task remembers.
EXEMPLARS, REMEMBERED = 4, 16
MATCH, BROADCAST_BYTES = 40_000, 16 << 20
#: Share of a host's varying text that the article's slot holds; characters of parsed exemplars that a worker remembers.
CORE, PARSED = 0.7, 4 << 20
#: Pages of a host that one task takes at most where wrappers are dealt out, or so that at most DEALT hosts are split.
HOT, DEALT = 4096, 100_000
CONTAINERS = {"div", "section", "article", "main", "td", "center"}
sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000))  # for trees of DEPTH levels
DROPPED = {"nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "fieldset", "datalist", "head"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "status"}
SAYING = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe",
    "subscription", "signup", "login", "paywall", "sidebar",
    "widget", "widgets", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "toolbar", "masthead", "header", "footer", "related",
    "recommended", "recommendations", "share", "sharing", "social", "pagination", "pager", "search", "skip", "copyright",
}
COMMENTS = {"comment", "comments", "reply", "replies", "disqus", "respond", "discussion"}
MAIN = {"article", "body", "entry", "main", "post", "story", "content"}
_WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")


def says(node: Node, whole: int) -> bool:
    """Whether an element says that it is no part of the article. Names other than of comments count only on elements
    that hold no more than half of the page's `whole` characters: what holds the article may be named after its place
    beside a sidebar."""
    if node.tag in DROPPED or "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true" or node.attrs.get("role", "").lower() in ROLES:
        return True
    if node.tag in ("html", "body", "main") or not node.attrs:
        return False
    names = {w.lower() for k in ("class", "id") for w in _WORD.findall(node.attrs.get(k, ""))}
    return bool(names & COMMENTS) or bool(names & SAYING) and 2 * text_size(node) <= whole


def _titled(node: Node) -> list[Node]:
    """Headings of an article's own header."""
    todo, out = [node], []
    while todo:
        x = todo.pop()
        if x.tag in ("h1", "h2"):
            out.append(x)
        elif x.tag not in ("nav", "form", "aside"):
            todo += reversed(x.children)
    return out


def main_node(root: Node, whole: int, kinds: tuple[str, ...] = ("article", "main", "named")) -> Node:
    """The element that holds the article: the largest article, else the main element, else the one that says so, else all."""
    found: dict[str, list[Node]] = {"article": [], "main": [], "named": []}
    todo = [root]
    while todo:
        x = todo.pop()
        if x is not root and says(x, whole):
            continue
        if x.tag == "article":
            found["article"].append(x)
        elif x.tag == "main" or x.attrs.get("role") == "main":
            found["main"].append(x)
        elif x.tag in ("div", "section", "td") and x.attrs:
            names = [w.lower() for k in ("class", "id") for w in _WORD.findall(x.attrs.get(k, ""))]
            if set(names) & MAIN:
                found["named"].append(x)
        todo += reversed(x.children)
    for kind in kinds:
        if found[kind]:
            return max(found[kind], key=text_size)
    return root


def without(root: Node, template: set[int]) -> None:
    """Takes template texts out of a tree."""
    todo = [root] if template else []
    while todo:
        x = todo.pop()
        x.children = [c for c in x.children if id(c) not in template]
        todo += x.children


def blocks(root: Node, slot: Node | None = None, named: bool = True) -> list[str]:
    """Texts of the article in page order; slot: where the host's wrapper has it; named: whether names count."""
    whole = text_size(root)
    if named:
        top = main_node(slot, whole, ("article", "main")) if slot else main_node(root, whole)
    else:
        top = slot or root
    inside = top.tag == "article" or top is not root
    out: list[str] = []
    todo = [top]
    while todo:
        x = todo.pop()
        if not x.tag:
            if inside or x.linked * 2 <= len(x.text):
                out.append(x.text)
        elif named and x is not top and says(x, whole):
            if inside and (x.tag == "header" or "header" in x.attrs.get("class", "")):
                todo += reversed(_titled(x))
        else:
            todo += reversed(x.children)
    return out


def preorder(root: Node) -> list[Node]:
    todo, out = [root], []
    while todo:
        x = todo.pop()
        out.append(x)
        todo += reversed(x.children)
    return out


#: Weight of a paired node beside that of a paired equal text.
NODE = 1 << 32


def _shape(node: Node, known: dict[int, tuple]) -> tuple[int, int, list[Node]]:
    """Hash of a tree's labels, its nodes, and its texts."""
    if id(node) not in known:
        parts = [_shape(c, known) for c in node.children]
        texts = [t for x in parts for t in x[2]] if node.tag else [node]
        known[id(node)] = hash((node.label, *(x[0] for x in parts))), 1 + sum(x[1] for x in parts), texts
    return known[id(node)]


#: Paired nodes; True for all nodes of two trees of one shape.
Pairs = list[tuple[Node, Node, bool]]


def _equal(ta: list[Node], tb: list[Node]) -> int:
    return ta[0].text == tb[0].text if len(ta) == 1 else sum(p.text == q.text for p, q in zip(ta, tb, strict=True))


def _align(a: Node, b: Node, ka: dict, kb: dict) -> tuple[int, Pairs]:
    """The best ordered matching of two trees of equal labels: most nodes, then most equal texts."""
    (sa, size, ta), (sb, _, tb) = _shape(a, ka), _shape(b, kb)
    if sa == sb:  # all nodes pair in one way only
        return size * NODE + _equal(ta, tb), [(a, b, True)]
    total, pairs = _lists(a.children, b.children, ka, kb)
    return NODE + total, [(a, b, False), *pairs]


def _same(p: Node, q: Node, ka: dict, kb: dict) -> bool:
    x, y = _shape(p, ka), _shape(q, kb)
    return x[0] == y[0] and all(t.text == u.text for t, u in zip(x[2], y[2], strict=True))


def _lists(x: list[Node], y: list[Node], ka: dict, kb: dict) -> tuple[int, Pairs]:
    """The best ordered matching of two lists. Equal ends are in one of the best; long rests are halved (Hirschberg 1975)."""
    total, head, tail = 0, [], []
    i, j = 0, 0
    while i < min(len(x), len(y)) and _same(x[i], y[i], ka, kb):
        s, p = _align(x[i], y[i], ka, kb)
        total, i = total + s, i + 1
        head += p
    while j < min(len(x), len(y)) - i and _same(x[-1 - j], y[-1 - j], ka, kb):
        s, p = _align(x[-1 - j], y[-1 - j], ka, kb)
        total, j = total + s, j + 1
        tail += p
    x, y = x[i : len(x) - j], y[i : len(y) - j]
    if len(x) * len(y) > MATCH and len(x) > 1:
        half = len(x) // 2
        front, back = _row(x[:half], y, ka, kb), _row(x[:half - 1 : -1], y[::-1], ka, kb)
        at = int(np.argmax(front + back[::-1]))
        rest = [_lists(x[:half], y[:at], ka, kb), _lists(x[half:], y[at:], ka, kb)]
    else:
        rest = [_table(x, y, ka, kb)]
    return total + sum(s for s, _ in rest), head + [p for _, r in rest for p in r] + tail


def _row(x: list[Node], y: list[Node], ka: dict, kb: dict) -> np.ndarray:
    """Weights of the best matchings of the whole of x with every beginning of y."""
    row = np.zeros(len(y) + 1, np.int64)
    labels, kinds = {}, {}
    for j, q in enumerate(y):
        labels.setdefault(q.label, []).append(j)
        kinds.setdefault(_shape(q, kb)[0], []).append(j)
    texts = {k: (np.array(js), np.array([[hash(t.text) for t in _shape(y[j], kb)[2]] for j in js], np.int64)) for k, js in kinds.items()}
    for p in x:
        w = np.zeros(len(y), np.int64)
        shape, size, own = _shape(p, ka)
        if shape in texts:
            js, t = texts[shape]
            w[js] = size * NODE + (t == np.array([hash(u.text) for u in own], np.int64)).sum(axis=1)
        for j in labels.get(p.label, ()):
            if not w[j]:
                w[j] = _align(p, y[j], ka, kb)[0]
        row[1:] = np.maximum(row[1:], row[:-1] + w)
        row = np.maximum.accumulate(row)
    return row


def _table(x: list[Node], y: list[Node], ka: dict, kb: dict) -> tuple[int, Pairs]:
    shapes = [(*_shape(q, kb), q) for q in y]
    got: dict[tuple[int, int], tuple[int, Pairs | None]] = {}
    best = [[0] * (len(y) + 1)]
    for i, p in enumerate(x, 1):
        above, row, left = best[-1], [0], 0
        shape, size, texts = _shape(p, ka)
        whole, label = size * NODE, p.label
        for j, (other, _, tq, q) in enumerate(shapes, 1):
            if above[j] > left:
                left = above[j]
            if shape == other:
                s = whole + _equal(texts, tq)
                pairs = None
            elif label == q.label:
                s, pairs = _align(p, q, ka, kb)
            else:
                row.append(left)
                continue
            if above[j - 1] + s > left:
                left = above[j - 1] + s
                got[i, j] = s, pairs
            row.append(left)
        best.append(row)
    out: Pairs = []
    i, j = len(x), len(y)
    while i and j:
        if (i, j) in got and best[i][j] == best[i - 1][j - 1] + got[i, j][0]:
            pairs = got[i, j][1]
            out += [(x[i - 1], y[j - 1], True)] if pairs is None else pairs
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[len(x)][len(y)], out


def match(a: Node, b: Node, known: dict | None = None) -> tuple[int, list[tuple[Node, Node]]]:
    """Size of the best ordered matching of two trees of equal labels, and the nodes it pairs, equal texts where it can;
    known: shapes of a's nodes."""
    total, pairs = _align(a, b, {} if known is None else known, {})
    out = []
    for p, q, whole in pairs:
        if whole and p.children:
            out += zip(preorder(p), preorder(q), strict=True)
        else:
            out.append((p, q))
    return total // NODE, out


_PATHS: dict[tuple[int, str], int] = {}


def paths(root: Node) -> frozenset[int]:
    """Hashes of the label paths of a tree."""
    out, todo = set(), [(root, 0)]
    while todo:
        x, above = todo.pop()
        h = _PATHS.get((above, x.label))
        if h is None:
            if len(_PATHS) > 1 << 16:
                _PATHS.clear()
            h = _PATHS[above, x.label] = xxhash.xxh3_64_intdigest(f"{above} {x.label}")
        out.add(h)
        if x.children:
            todo += [(c, h) for c in x.children]
    return frozenset(out)


class Exemplars:
    """Parsed exemplars that a worker has met lately, with the places of their nodes, paths and shapes."""

    def __init__(self):
        self.known: dict[str, tuple] = {}
        self.size = 0

    def of(self, page: str) -> tuple[Node, dict[int, int], frozenset[int], dict]:
        if page not in self.known:
            if self.size + len(page) > PARSED:
                self.known.clear()
                self.size = 0
            self.size += len(page)
            root = parse(page)
            self.known[page] = root, {id(x): i for i, x in enumerate(preorder(root))}, paths(root), {}
        return self.known[page]

    def to_align(self, page: Node, exemplars: list[str]) -> list[int]:
        """The exemplar of the nearest path set, and the first."""
        if len(exemplars) == 1:
            return [0]
        own = paths(page)
        near = [len(own & x) / len(own | x) for x in (self.of(e)[2] for e in exemplars)]
        return list(dict.fromkeys([near.index(max(near)), 0]))

    def align(self, page: Node, exemplar: str) -> list[tuple[int, Node, Node]]:
        """(place in the exemplar, its node, the page's node) of what the two have in common."""
        root, place, _, shapes = self.of(exemplar)
        return [(place[id(a)], a, b) for a, b in match(root, page, shapes)[1]]


def slot_of(aligned: list[tuple[int, Node, Node]], core: set[int]) -> Node | None:
    """The page's node at the deepest of the exemplar's containers that hold its host's varying text, with the headline if one
    of them has it. They lie within one another, so the deepest comes last in order."""
    found = [(a, b) for i, a, b in aligned if i in core and a.tag in CONTAINERS]
    titled = [b for a, b in found if any(x.tag == "h1" for x in preorder(a))]
    return titled[-1] if titled else found[-1][1] if found else None


def _sizes(root: Node, template: set[int]) -> dict[int, int]:
    """Characters below every element, without template texts."""
    out: dict[int, int] = {}
    for x in reversed(preorder(root)):
        out[id(x)] = sum(out[id(c)] for c in x.children) if x.tag else 0 if id(x) in template else len(x.text)
    return out


def _shapes(batches):
    """By host and path set: pages that have it, its paths, and the page of least hash."""
    found: dict[str, dict[int, list]] = {}
    weight = lambda x: (-x[0] * x[1], x[2], x[3])
    for batch in batches:
        for part in steps(batch, "html"):
            for host, url, page, html in zip(*(part.column(c).to_pylist() for c in ("host", "url", "page_id", "html")), strict=True):
                root = parse(html)
                if not text_size(root):
                    continue
                h, own = xxhash.xxh3_64_intdigest(f"{page} {url}") >> 1, paths(root)
                of = found.setdefault(host, {})
                sign = xxhash.xxh3_64_intdigest(np.sort(np.fromiter(own, np.uint64, len(own))).tobytes()) >> 1
                if sign not in of:
                    if len(of) >= 2 * REMEMBERED:
                        found[host] = of = dict(sorted(of.items(), key=lambda kv: weight(kv[1]))[:REMEMBERED])
                    of[sign] = [1, len(own), h, html]
                else:
                    x = of[sign]
                    x[0] += 1
                    x[2], x[3] = min((x[2], x[3]), (h, html))
    for host, of in found.items():
        rows = sorted(((*x, k) for k, x in of.items()), key=weight)[:REMEMBERED]
        n, size, h, html, sign = zip(*rows, strict=True)
        cols = [pa.array([host] * len(rows), pa.string()), pa.array(sign, pa.int64()), pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(h, pa.int64()), pa.array(html, pa.string())]
        yield pa.record_batch(cols, ["host", "sign", "n", "size", "h", "exemplar"])


def _told(batches, sent):
    """Steps of page rows, and of each row the facts of its host, if it has some: from what was sent, else from the rows of
    facts that come before the pages of their host."""
    host, told = None, None
    for batch in batches:
        for part in steps(batch, "html"):
            hosts = part.column("host").to_pylist()
            if sent is not None:
                yield part, [sent.value.get(h) for h in hosts]
                continue
            rows, facts = [], []
            for i, (h, fact) in enumerate(zip(hosts, part.column("fact").to_pylist(), strict=True)):
                if fact is not None:
                    host, told = h, fact
                else:
                    rows.append(i)
                    facts.append(told if h == host else None)
            yield part.take(pa.array(rows, pa.int64())), facts


def _agreements(sent):
    """By host, exemplar and its node: pages that have it aligned, pages that agree on its text, and characters that vary
    below it on the pages nearest to the exemplar (null for texts)."""

    def run(batches):
        seen: dict[tuple[str, int, int], list] = {}
        known = Exemplars()
        for part, facts in _told(batches, sent):
            for host, html, fact in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), facts, strict=True):
                if fact is None:
                    continue
                page = parse(html)
                for nearest, e in enumerate(known.to_align(page, fact["exemplars"])):
                    aligned = known.align(page, fact["exemplars"][e])
                    sizes = _sizes(page, {id(b) for _, a, b in aligned if not b.tag and a.text == b.text}) if not nearest else {}
                    for i, a, b in aligned:
                        n = seen.setdefault((host, e, i), [0, 0, 0 if b.tag else None])
                        n[0] += 1
                        if b.tag:
                            n[2] += sizes.get(id(b), 0)
                        else:
                            n[1] += a.text == b.text
        cols = [*([k[x] for k in seen] for x in range(3)), *([n[x] for n in seen.values()] for x in range(3))]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["host", "e", "node", "pages", "same", "chars"])

    return run


def _extract(sent, named: bool):
    def run(batches):
        known = Exemplars()
        for part, facts in _told(batches, sent):
            texts = []
            for html, fact in zip(part.column("html").to_pylist(), facts, strict=True):
                page, slot = parse(html), None
                if fact is not None:
                    template: set[int] = set()
                    for e in known.to_align(page, fact["exemplars"]):
                        gone, core = ({x["node"] for x in fact[k] or () if x["e"] == e} for k in ("constant", "core"))
                        if gone or core:
                            aligned = known.align(page, fact["exemplars"][e])
                            template |= {id(b) for i, a, b in aligned if i in gone and a.text == b.text}
                            slot = slot or slot_of(aligned, core)
                    without(page, template)
                texts.append("\n\n".join(blocks(page, slot, named)))
            yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


FACT = "struct<exemplars array<string>, constant array<struct<e int, node int>>, core array<struct<e int, node int>>>"


def _with_facts(pages: DataFrame, facts: DataFrame, run, schema: str) -> DataFrame:
    """run(sent) over the pages, with the facts (host, exemplars, constant, core) of their hosts."""
    spark = pages.sparkSession
    size = facts.agg(F.coalesce(F.sum(F.length(F.array_join("exemplars", "")) * 4 + 16 * F.coalesce(F.size("constant"), F.lit(0))), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        told = {r["host"]: r.asDict(recursive=True) for r in facts.collect()}
        return pages.mapInArrow(run(spark.sparkContext.broadcast(told)), schema)
    counts = pages.groupBy("host").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0]
    most = max(HOT, -(-total // DEALT))  # so few hosts have more that they can be sent
    hot = F.broadcast(counts.where(F.col("n") > most).select("host", F.ceil(F.col("n") / most).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    rows = pages.join(hot, "host", "left").select("page_id", "url", "html", "host", F.pmod(F.xxhash64("page_id", "url"), salts).cast("int").alias("salt"), F.lit(None).cast(FACT).alias("fact"))
    first = facts.join(hot, "host", "left").select(
        F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit("").alias("html"), "host", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.struct("exemplars", "constant", "core").cast(FACT).alias("fact")
    )
    dealt = first.unionByName(rows).repartition("host", "salt").sortWithinPartitions("host", "salt", F.col("fact").isNull())
    return dealt.mapInArrow(run(None), schema)


def main_texts(pages: DataFrame, named: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) of pages (page_id, url, html); named: whether names count where wrappers can't tell."""
    scratch = Scratch(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    shapes = pages.mapInArrow(_shapes, "host string, sign long, n long, size long, h long, exemplar string")
    shapes = shapes.groupBy("host", "sign").agg(F.sum(F.col("n") * F.col("size")).alias("weight"), F.sum("n").alias("n"), F.min(F.struct("h", "exemplar")).alias("x"))
    by_host = Window.partitionBy("host")
    best = shapes.withColumns({"e": F.row_number().over(by_host.orderBy(F.desc("weight"), "x.h", "sign")) - 1, "all": F.sum("n").over(by_host)})
    best = best.where((F.col("e") < EXEMPLARS) & (F.col("all") >= LEAST))
    exemplars = F.transform(F.array_sort(F.collect_list(F.struct("e", "x.exemplar"))), lambda x: x["exemplar"])
    nodes = F.array().cast("array<struct<e int, node int>>")
    exemplars = scratch.keep(best.groupBy("host").agg(exemplars.alias("exemplars")).select("host", "exemplars", nodes.alias("constant"), nodes.alias("core")), "exemplars")
    counts = _with_facts(pages, exemplars, _agreements, "host string, e int, node int, pages long, same long, chars long")
    sums = counts.groupBy("host", "e", "node").agg(*(F.sum(x).alias(x) for x in ("pages", "same", "chars")))
    often = F.col("pages") >= LEAST
    fixed = F.when(F.col("chars").isNull(), often & (F.col("same") >= AGREE * F.col("pages")))
    node = F.struct("e", "node")
    told = sums.withColumn("fixed", fixed).groupBy("host", "e").agg(
        F.collect_list(F.when(F.col("fixed"), node)).alias("constant"),
        F.coalesce(F.min("fixed"), F.lit(False)).alias("copies"),
        F.max("chars").alias("most"),
        F.collect_list(F.when(often & (F.col("chars") > 0), F.struct("chars", node.alias("node")))).alias("core"),
    )
    core = F.transform(F.filter("core", lambda x: x["chars"] >= CORE * F.col("most")), lambda x: x["node"])
    told = told.select("host", F.when(F.col("copies"), nodes).otherwise(F.col("constant")).alias("constant"), core.alias("core"))
    told = told.groupBy("host").agg(F.flatten(F.collect_list("constant")).alias("constant"), F.flatten(F.collect_list("core")).alias("core"))
    wrappers = scratch.keep(exemplars.select("host", "exemplars").join(told, "host"), "wrappers")
    return _with_facts(pages, wrappers, lambda sent: _extract(sent, named), "page_id long, url string, text string, n_chars long")


def op2_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))
