"""HTML extraction by a site style tree.

The pages of a host are merged by element path (block elements with their
classes, from the root). For every node of that tree four figures are taken
over the pages that have it, on exact counts:

* presentation: the entropy of its branch's shape (the elements below, in order,
  and the size of its text), 0 if all pages agree and 1 if none do;
* content: the same entropy over the branch's whole text;
* that of the enclosing branch on the same pages, so that a menu inside a
  changing article is told from a paragraph of a repeated one;
* the share of its text that lies in links.

A node's importance is a weighted sum of these, of what its tag, class, id or
role says of its purpose (one more feature of presentation), and of where it
stands: inside an article or main element, or outside of one that holds so much
of the host's text. Figures from few pages count for less and those from one for
nothing, without any threshold on their number. A branch whose importance isn't
above 0 is removed from each page, whether inside an article or not; of a branch
that has an article below only its own text goes. Inline elements belong to
their block.

Counts are pre-aggregated, so a hot host costs no large group. Node figures are
broadcast if there are at most `broadcast_nodes`; else each distinct page is
joined with those of its own paths, and Spark splits a hot page's copies.

Pages are read in one pass: no place is scanned again, however tags, quotes and
elements are left open. A quote that is never closed makes this and all later
tags of the page end at their first `>`.

Nulls: null html is empty and gives an empty text; a null URL has the empty
host. Pages of any length are read whole; unclosed and stray tags are borne.
Repeated rows are extracted one by one. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory, small_batches, written
from .url_filter import canonical

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_UNTIL = re.compile(r"[\"'>]")
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

#: Elements by their use, and the words of a class, id or role
#: that name a purpose other than the article's text: surely, or perhaps.
RAW = frozenset("script style noscript template textarea title iframe object svg math select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OTHER_TAGS = frozenset("head nav aside form footer menu dialog button fieldset".split())
OTHER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars comment comments commentlist disqus newsletter subscribe signup login "
    "popup modal overlay pagination pager masthead contentinfo skip".split()
)
PERHAPS_WORDS = frozenset("aside complementary header footer discussion replies share sharing social related recommended search widget widgets toolbar copyright".split())
#: An opening tag of the first kind ends an open one of the second.
ENDS = {t: frozenset({"p"}) for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()} | {
    "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "tr": frozenset({"tr", "td", "th", "p"}),
    "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}), "option": frozenset({"option"}), "body": frozenset({"head"}),
}
_KEEPS = frozenset("article aside blockquote body button div dd footer form header html li main nav section table td th ul ol".split())


@dataclass(frozen=True)
class ExtractParams:
    """Weights of a node's importance. names: of a purpose surely (and perhaps,
    and for an article or main element) named; differs: of content less novel
    than the enclosing branch's; content and shape: of either entropy (shape
    inside an article, and outside); links: of the squared share in links, once, and
    again where it repeats; inside, outside: of the place; beside: taken off
    outside, by the share of the text in articles. doubt: pages that stand for
    what isn't known of a node."""

    names: tuple[float, float, float] = (-3.0, -1.0, 4.0)
    differs: float = 2.0
    content: float = 0.5
    shape: tuple[float, float] = (0.5, 1.0)
    links: float = 1.0
    inside: float = 1.25
    outside: float = 0.75
    beside: float = 2.25
    doubt: float = 2.0
    broadcast_nodes: int = 200_000


@dataclass(eq=False)
class Node:
    """A block element. purpose: 1 article or main, -1 surely another, -2
    perhaps another, 0 none named."""

    tag: str
    path: int
    up: Node | None
    purpose: int
    article: bool = False  # in an article or main element that is in no other purpose's
    other: bool = False  # in an element of surely another purpose
    holds: bool = False  # an article is below
    parts: list[bytes] = field(default_factory=list)  # digests of texts and blocks, in order
    shape: list[str] = field(default_factory=list)
    digest: bytes = b""
    chars: int = 0
    links: int = 0
    low: bool = False


@dataclass(frozen=True)
class Figures:
    """Of a node of the tree, over m pages: entropies of shape, content and the
    enclosing branch's content, and the share of text in links."""

    m: int
    shape: float
    content: float
    above: float
    links: float


def _named(attributes: str) -> tuple[str, frozenset[str]]:
    """The class attribute and the words of class, id and role."""
    label, words = "", set()
    for m in _NAMES.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "class":
            label = value
        words.update(x.lower() for x in _PART.findall(value))
    return label, frozenset(words)


def _purpose(tag: str, words: frozenset[str], in_article: bool) -> int:
    if tag in OTHER_TAGS:
        return -1
    if tag in ("html", "body") or tag in HEADINGS:
        return 0
    if tag not in ("main", "p") and words & OTHER_WORDS:
        return -1
    if tag in ("article", "main") or "main" in words and tag == "div":
        return 1
    if (tag == "header" or words & PERHAPS_WORDS) and not (in_article and (tag == "header" or "header" in words)):
        return -2
    return 0


def tokens(html: str) -> Iterator[tuple[int, int, str | None, str]]:
    """Texts (start, end, None, "") and tags (start, end, name, attributes), in
    one pass; comments and declarations are tags of the name "!"."""
    at, size, quotes, more = 0, len(html), True, True
    gone: set[str] = set()
    text = 0

    def find(what: str, start: int) -> int:
        if what in gone:
            return -1
        k = html.find(what, start)
        if k < 0:
            gone.add(what)
        return k

    while more and (at := html.find("<", at)) >= 0:
        name = None
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            name, end = "!", size if end < 0 else end + 3
        elif html.startswith("<![CDATA[", at) and (end := find("]]>", at)) >= 0:
            name, end = "!", end + 3
        elif html.startswith(("<!", "<?"), at):
            end = find(">", at)
            name, end = "!", size if end < 0 else end + 1
        elif m := _NAME.match(html, at + 1):
            name, end = m[0], m.end()
            while quotes:
                q = _UNTIL.search(html, end)
                if q is None or q[0] == ">":
                    end = q.end() if q else -1
                    break
                before = q.start() - 1
                while html[before].isspace():
                    before -= 1
                if html[before] != "=":  # not the beginning of a value
                    end = q.end()
                    continue
                end = html.find(q[0], q.end()) + 1
                if not end:  # no tag from here on minds quotes
                    quotes = False
            if not quotes:
                end = find(">", m.end()) + 1
            if end <= 0:  # no tag can end any more
                name, more = None, False
        if name is None:
            at += 1
            continue
        if at > text:
            yield text, at, None, ""
        attributes = html[at + 1 + len(name) : end - 1] if name != "!" else ""
        raw = name.lower()
        yield at, end, raw, attributes
        at = end
        if raw in RAW:
            close = None
            if raw not in gone:
                close = re.compile(rf"</{re.escape(raw)}[\s/>]", re.I).search(html, at)
                if not close:
                    gone.add(raw)
            if close:
                at = html.find(">", close.start()) + 1 or size
            elif raw not in ("svg", "math", "select", "object"):
                at = size
        text = at
    if size > text:
        yield text, size, None, ""


class Page:
    """A page's pieces of text in order, None where a block ends, each with its
    block, and all blocks (a parent before its children). hashed: with the
    digests that features need. judged: characters in no element of another
    purpose, and those of them in articles."""

    def __init__(self, html: str, hashed: bool = True):
        self.hashed, self.judged = hashed, [0, 0]
        root = Node("", 0, None, 0)
        self.pieces: list[tuple[str | None, Node]] = []
        self.nodes = [root]
        # open elements: (tag, block); scopes: the open tags of either kind of element that keeps others in
        stack: list[tuple[str, Node]] = [("", root)]
        scopes: list[tuple[int, Counter]] = [(0, Counter())]
        open_: Counter = Counter()
        anchors = 0

        def pop_to(k: int) -> None:
            nonlocal anchors
            while len(stack) > k:
                tag, node = stack.pop()
                open_[tag] -= 1
                if scopes[-1][0] == len(stack) and len(scopes) > 1:
                    scopes.pop()
                scopes[-1][1][tag] -= 1
                anchors -= tag == "a"
                if tag not in INLINE:
                    self._close(node)

        def last(tags: frozenset[str] | set[str]) -> int:
            """The place of the innermost open element of these in this scope."""
            k = len(stack) - 1
            while stack[k][0] not in tags:
                k -= 1
            return k

        for start, end, tag, attributes in tokens(html):
            block = stack[-1][1]
            if tag is None:
                piece = html[start:end]
                self.pieces.append((piece, block))
                if bare := piece.strip():
                    if hashed:
                        block.parts.append(xxhash.xxh3_64_digest(bare.encode("utf-8", "surrogatepass")))
                    n = len(bare)
                    block.chars += n
                    block.links += n * (anchors > 0)
                    if not block.other:
                        self.judged[0] += n
                        self.judged[1] += n * block.article
                continue
            if tag == "!":
                continue
            closing, tag = tag[0] == "/", tag.lstrip("/")
            if tag not in INLINE:
                self.pieces.append((None, block))
            if closing:
                within = scopes[-1][1] if tag in INLINE or tag == "p" else open_
                if within[tag] > 0:
                    pop_to(last({tag}))
                continue
            if tag in RAW:
                continue
            if tag in ENDS:
                inner = scopes[-1][1]
                if any(inner[t] > 0 for t in ENDS[tag]):
                    pop_to(last(ENDS[tag]))
                elif stack[scopes[-1][0]][0] in ENDS[tag]:
                    pop_to(scopes[-1][0])
            block = stack[-1][1]
            block.shape.append(tag)
            if tag in VOID:
                continue
            if tag in INLINE:
                anchors += tag == "a"
                stack.append((tag, block))
            else:
                label, words = _named(attributes) if attributes else ("", frozenset())
                purpose = _purpose(tag, words, block.article)
                node = Node(tag, xxhash.xxh3_64_intdigest(f"{tag}.{label}", block.path & (2**63 - 1)), block, purpose)
                node.other = block.other or purpose == -1
                node.article = (block.article or purpose == 1) and not node.other
                if node.article and not block.article:
                    up = block
                    while up is not None and not up.holds:
                        up.holds, up = True, up.up
                self.nodes.append(node)
                stack.append((tag, node))
            open_[tag] += 1
            scopes[-1][1][tag] += 1
            if tag in _KEEPS:
                scopes.append((len(stack) - 1, Counter()))
        pop_to(1)
        self._close(root)

    def _close(self, node: Node) -> None:
        """Bring a branch's figures into the enclosing one."""
        if node.up is not None:
            node.up.chars += node.chars
            node.up.links += node.links
        if not self.hashed:
            return
        node.digest = xxhash.xxh3_64_digest(b"".join(node.parts)) if node.parts else b""
        own = xxhash.xxh3_64_hexdigest("|".join(node.shape))
        node.shape, node.parts = [own], []
        if node.up is not None:
            if node.digest:
                node.up.parts.append(node.digest)
            node.up.shape.append(own)

    def features(self) -> list[tuple[int, int, int, int, int, int]]:
        """(path, shape, content, content of the enclosing branch, characters,
        of these in links) of each path that has text; path 0 has the page's
        characters that are in no element of another purpose, and those of them
        in articles."""
        by: dict[int, list[Node]] = {}
        for n in self.nodes[1:]:
            if n.digest:
                by.setdefault(n.path, []).append(n)
        out = []
        for path, nodes in by.items():
            chars = sum(n.chars for n in nodes)
            shape = "|".join(n.shape[0] for n in nodes) + f" {chars.bit_length()}"
            over = list(dict.fromkeys(n.up for n in nodes))
            mine, above = (xxhash.xxh3_64_intdigest(b"".join(x.digest for x in g)) for g in (nodes, over))
            out.append((_signed(path), _signed(xxhash.xxh3_64_intdigest(shape)), _signed(mine), _signed(above), chars, sum(n.links for n in nodes)))
        out.append((0, 0, 0, 0, *self.judged))
        return out

    def text(self, figures: Callable[[int], Figures | None] = lambda path: None, p: ExtractParams = ExtractParams()) -> str:
        """The kept pieces: each block's white space as one space, blocks joined.
        figures(0).links is the share of the host's text that is in articles."""
        host = figures(0)
        if host is None:
            host = Figures(1, 0, 0, 0, self.judged[1] / self.judged[0] if self.judged[0] else 0.0)
        outside = p.outside - p.beside * host.links
        keeps_text = {id(self.nodes[0]): outside > 0}
        for n in self.nodes[1:]:
            up = n.up
            if up.low or n.tag in ("html", "body"):
                n.low = up.low
                keeps_text[id(n)] = not n.low and outside > 0
                continue
            good = importance(n, figures(_signed(n.path)), outside, p) > 0
            n.low = not good and not n.holds
            keeps_text[id(n)] = good and (n.article or not n.holds or outside > 0)
        raw = "".join(" " if t is None else unescape(t) for t, n in self.pieces if keeps_text[id(n)])
        return " ".join(raw.split())


def importance(n: Node, f: Figures | None, outside: float, p: ExtractParams) -> float:
    """Of a node, from its figures over the host's pages; what is not known of
    it counts as halfway between all pages alike and all different."""
    f = f or Figures(1, 0.5, 0.5, 0.5, n.links / n.chars if n.chars else 0.0)
    sure = (f.m - 1) / (f.m - 1 + p.doubt)
    content, shape = (sure * x + (1 - sure) * 0.5 for x in (f.content, f.shape))
    out = {-1: p.names[0], -2: p.names[1], 1: p.names[2], 0: 0.0}[n.purpose]
    out += p.differs * sure * min(0.0, f.content - f.above) + p.content * (2 * content - 1)
    out += p.shape[0 if n.article else 1] * (2 * shape - 1) - p.links * sure * f.links**2 * (2 - content)
    return out + (p.inside if n.article else outside)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


_FEATURES = ("path", "shape", "content", "above", "chars", "links")


def _features(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in it:
        rows = [(canonical(u if isinstance(u, str) else None)[0], *r) for u, h in zip(f["url"], f["html"]) for r in (Page(h).features() if isinstance(h, str) else ())]
        yield pd.DataFrame(rows, columns=["host", *_FEATURES]).astype({c: np.int64 for c in _FEATURES})
    release_memory()


def style_tree(pages: DataFrame) -> DataFrame:
    """host, path, m, shape, content, above, links: the figures of every node of
    every host's tree. With c the pages that share one form of a node and m all
    that have it, an entropy is -sum(c / m log_m(c / m)) = 1 - sum(c ln c) / (m ln m)."""
    each = pages.mapInPandas(_features, "host string, " + ", ".join(f"{c} long" for c in _FEATURES))
    forms = each.select("host", "path", F.expr("stack(3, 'shape', shape, chars, links, 'content', content, 0L, 0L, 'above', above, 0L, 0L) as (kind, hash, chars, links)"))
    counts = forms.groupBy("host", "path", "kind", "hash").agg(F.count("*").cast("double").alias("c"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    node = counts.groupBy("host", "path").agg(
        *(F.sum(F.when(F.col("kind") == k, F.col("c") * F.log("c"))).alias(k) for k in ("shape", "content", "above")),
        F.sum(F.when(F.col("kind") == "shape", F.col("c"))).alias("m"), F.sum("chars").alias("chars"), F.sum("links").alias("links"),
    )
    value = lambda k: F.when(F.col("m") > 1, 1 - F.col(k) / (F.col("m") * F.log("m"))).otherwise(0.5).alias(k)
    share = F.when(F.col("chars") > 0, F.col("links") / F.col("chars")).otherwise(0.0).alias("links")
    return node.select("host", "path", F.col("m").cast("long").alias("m"), value("shape"), value("content"), value("above"), share)


def extract(pages: DataFrame, params: ExtractParams = ExtractParams(), key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text and n_chars of each page."""
    p, spark = params, pages.sparkSession
    small_batches(spark)
    few = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").cast("string").alias("html"))
    tree = written(style_tree(few.select("url", "html")), "style-tree")
    kind = few.schema["key"].dataType.simpleString()
    schema = f"key {kind}, url string, text string, n_chars long"

    def rows(f: pd.DataFrame, of: Callable[[int, str], Callable[[int], Figures | None]]) -> pd.DataFrame:
        hosts = [canonical(u if isinstance(u, str) else None)[0] for u in f["url"]]
        texts = [Page(h, hashed=False).text(of(k, host), p) if isinstance(h, str) else "" for k, (host, h) in enumerate(zip(hosts, f["html"]))]
        return pd.DataFrame({"key": f["key"], "url": f["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    if tree.count() <= p.broadcast_nodes:
        known: dict[str, dict[int, tuple]] = {}
        for r in tree.collect():
            known.setdefault(r["host"], {})[r["path"]] = tuple(r)[2:]
        shared = spark.sparkContext.broadcast(known)

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            trees = shared.value

            def of(k: int, host: str) -> Callable[[int], Figures | None]:
                own = trees.get(host, {})
                return lambda path: Figures(*own[path]) if path in own else None

            for f in it:
                yield rows(f, of)
            release_memory()

        out = few.mapInPandas(run, schema)
    else:
        # each distinct page meets the figures of its own paths, and no others of its host
        few = few.withColumn("same", F.md5(F.concat_ws(" ", F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")))))

        def paths(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in it:
                found = [(s, canonical(u if isinstance(u, str) else None)[0], r[0]) for s, u, h in zip(f["same"], f["url"], f["html"]) for r in (Page(h).features() if isinstance(h, str) else ())]
                yield pd.DataFrame(found, columns=["same", "host", "path"]).astype({"path": np.int64})

        own = few.select("same", "url", "html").mapInPandas(paths, "same string, host string, path long").distinct()
        nodes = own.join(tree, ["host", "path"]).groupBy("same").agg(F.collect_list(F.struct("path", "m", "shape", "content", "above", "links")).alias("tree"))
        both = few.join(nodes, "same", "left").drop("same")

        def joined(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in it:
                trees = [{x["path"]: x for x in t} if t is not None else {} for t in f["tree"]]

                def of(k: int, host: str, trees=trees) -> Callable[[int], Figures | None]:
                    return lambda path: Figures(*(trees[k][path][c] for c in ("m", "shape", "content", "above", "links"))) if path in trees[k] else None

                yield rows(f, of)
            release_memory()

        out = both.mapInPandas(joined, schema)
    return out.withColumnRenamed("key", key).withColumnRenamed("url", url)
