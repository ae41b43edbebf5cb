"""Main text of pages through a site style tree.

The pages of a host are merged into one tree: an element node is a path of tags with their class and id words. A node
counts the presentation styles (sequences of child nodes) it takes over the pages, a text node its different
texts. Node importance is the entropy of the styles, or one minus the mean entropy of the texts, to the base of the number of
pages; a node on one page has importance one. The composite importance mixes a node's own with that of its children,
weighted by how often they stand below it. Branches below THRESHOLD go from each page. Markup is a prior on that: a
node in an `article` or `main` counts as if it had been important on PRIOR_PAGES pages, and a page that has such text is nothing else; a node with a
word of frames in its class, id or role counts for the share of the page's text that stands in it, so a wrapper of the whole page is
kept and a small box is not. Elements that are frames by their tag, hidden ones and those with a firm word have importance zero.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.blocks import cut, packed, unpacked
from palimpsest.llm.store import written

GAMMA = 0.9  # weight of the children, to the power of the number of styles
THRESHOLD = 0.3
PRIOR_PAGES = 3  # pages that markup as an article weighs: a block that all pages repeat goes from 9 pages on
DEPTH = 64  # nodes further down hang on their ancestor at this depth; their text stays
BLOCK_CHARS = 8 << 20

#: Elements that stand on lines of their own.
BLOCK_TAGS = frozenset("""html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr
ul""".split())
#: Elements whose content is not text of the page.
HIDDEN_TAGS = frozenset("script style noscript template svg math iframe object canvas audio video textarea title select button".split())
#: Elements that are never part of an article.
FRAME_TAGS = frozenset("nav header footer aside form menu dialog".split())
#: Words in class, id and role of what is never part of an article.
FRAME_WORDS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent
notice notices notification alert popup modal overlay newsletter subscribe subscription signup login search sidebar side widget widgets
related recommended recommendations share sharing social comment comments commentlist disqus reply replies respond discussion breadcrumb
breadcrumbs menu nav navbar navigation pagination pager footer header masthead topbar toolbar copyright legal disclaimer skip
contentinfo complementary form""".split())
#: Those of the words that also hold for an article element and what it stands in.
FIRM_WORDS = frozenset("""ad ads advert advertisement sponsored comment comments commentlist disqus reply replies related recommended""".split())
VOID_TAGS = frozenset("hr br img input meta link area base col embed source track wbr".split())
CLOSES_P = BLOCK_TAGS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
#: tag: (what it closes, what bounds the search)
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?/](?![a-zA-Z])[^>]*(?:>|\Z)|<![a-zA-Z][^>]*(?:>|\Z)
|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S | re.X)
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
UNSEEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?(?:until))|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
LETTERS = re.compile(r"[a-z]+")
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")

OPEN, FRAME, ARTICLE = 0, 1, 2


class Page:
    """The block elements of a page (tag, key, parent, depth, state) and its blocks of text (element, text), in order."""

    def __init__(self, html: str) -> None:
        self.tags, self.keys, self.parents, self.depths, self.states = ["#page"], ["#page"], [-1], [0], [OPEN]
        self.blocks: list[tuple[int, str]] = []
        self._stack: list[int] = [0]
        self._held: list[str] = []
        self._soft: set[int] = set()  # elements with a word of frames
        at, n = 0, len(html)
        while at < n:
            m = TAG.search(html, at)
            if m is None:
                self._text(html[at:])
                break
            if m.start() > at:
                self._text(html[at:m.start()])
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                continue
            tag, ends, rest = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
            if tag in HIDDEN_TAGS and not ends:
                shut = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at) if not rest.endswith("/") else None
                at = shut.end() if shut else n if tag in ("script", "style") and not rest.endswith("/") else at
            elif tag == "br":
                self._held.append(" ")
            elif tag in BLOCK_TAGS:
                self._end(tag) if ends else self._start(tag, rest)
        self._flush()

    def _text(self, piece: str) -> None:
        self._held.append(unescape(piece) if "&" in piece else piece)

    def _flush(self) -> None:
        if self._held:
            text = " ".join("".join(self._held).split())
            self._held = []
            if text:
                self.blocks.append((self._stack[-1], text))

    def _pop(self, wanted: set[str], bound: frozenset[str] | set[str]) -> None:
        for i in range(len(self._stack) - 1, 0, -1):
            tag = self.tags[self._stack[i]]
            if tag in wanted:
                del self._stack[i:]
                return
            if tag in bound:
                return

    def _start(self, tag: str, rest: str) -> None:
        self._flush()
        if tag in CLOSES_P:
            self._pop({"p"}, {"td", "th", "table"})
        if tag in CLOSES:
            self._pop(*CLOSES[tag])
        up = self._stack[-1]
        names = [(m[1].lower(), (m[2] or m[3] or m[4] or "").lower()) for m in NAMES.finditer(rest)] if rest.strip("/ \t\n\r") else []
        words = {w for _, v in names for w in LETTERS.findall(v)}
        label = tag + "".join(f".{w}" for w in sorted(words))
        if len(self._stack) <= DEPTH:
            key, depth = f"{self.keys[up]}>{label}", self.depths[up] + 1
        else:
            key, depth = self.keys[up], self.depths[up]
        state = self.states[up]
        firm = tag in FRAME_TAGS or bool(words & FIRM_WORDS) or bool(rest and UNSEEN.search(rest))
        if tag in ("article", "main"):
            state = FRAME if firm or state == FRAME else ARTICLE
        elif tag not in ("html", "body") and firm:
            state = FRAME
        elif tag not in ("html", "body") and words & FRAME_WORDS:
            self._soft.add(len(self.tags))
        self.tags.append(tag)
        self.keys.append(key)
        self.parents.append(up)
        self.depths.append(depth)
        self.states.append(state)
        if tag not in VOID_TAGS:
            self._stack.append(len(self.tags) - 1)

    def _end(self, tag: str) -> None:
        self._flush()
        self._pop({tag}, frozenset())

    def main(self, known: dict[int, tuple[float, float]], host: str, threshold: float) -> str:
        """The blocks whose branch is important enough: those of articles, or without any those of no frame.

        known: (importance, pages) of nodes; others have importance one. Above an article nothing is asked.
        """
        wanted = ARTICLE if any(self.states[at] == ARTICLE for at, _ in self.blocks) else OPEN
        size = [0] * len(self.keys)
        for at, text in self.blocks:
            if self.states[at] == wanted:
                size[at] += len(text)
        for at in range(len(self.keys) - 1, 0, -1):  # children follow their parents
            size[self.parents[at]] += size[at]

        def weight(key: str) -> float:
            value, pages = known.get(node(host, key), (1.0, 1.0))
            return value if wanted == OPEN else ((pages - 1) * value + PRIOR_PAGES) / (pages - 1 + PRIOR_PAGES)

        low = set()
        for at in range(len(self.keys)):
            if self.states[at] == wanted and weight(self.keys[at]) * (size[at] / max(size[0], 1) if at in self._soft else 1) < threshold:
                low.add(at)
        kept = []
        for at, text in self.blocks:
            up = at
            while up > 0 and up not in low and self.states[up] == wanted:
                up = self.parents[up]
            if self.states[at] == wanted and (up <= 0 or up not in low) and weight(self.keys[at] + ">#text") >= threshold:
                kept.append(text)
        return "\n".join(kept)


def node(host: str, key: str) -> int:
    return xxhash.xxh64_intdigest(f"{host}\0{key}") - (1 << 63)


def host_of(url: str | None) -> str:
    found = HOST.match(url or "")
    return found[1].lower() if found else ""


def _parts(packed_text: str | None) -> tuple[str | None, str]:
    """(url, html) of what _together has joined."""
    size, _, rest = (packed_text or "-1:").partition(":")
    n = int(size)
    return (None if n < 0 else rest[:n]), rest[max(n, 0):]


def _together(url: str, html: str) -> F.Column:
    return F.concat(F.coalesce(F.length(url), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(F.col(url), F.lit("")), F.coalesce(F.col(html), F.lit("")))


PAGES, STYLE, TEXT, CHILD = range(4)


def _counts(texts: list[str | None]) -> dict[tuple[int, int, int], list]:
    """(kind, node, other): [depth, sum] over the different pages of a block."""
    out: dict[tuple[int, int, int], list] = {}

    def add(kind: int, at: int, other: int, depth: int, value: float) -> None:
        out.setdefault((kind, at, other), [depth, 0.0])[1] += value

    for host, html in {(host_of(url), html) for url, html in map(_parts, texts)}:
        page = Page(html)
        ids = [node(host, k) for k in page.keys]
        children: dict[int, list[tuple[int, int]]] = {}
        for at in range(1, len(ids)):
            if ids[at] != ids[page.parents[at]]:
                children.setdefault(page.parents[at], []).append((ids[at], page.depths[at]))
        seen, styles, texts_of = {}, set(), set()
        for at, text in page.blocks:
            leaf, depth = node(host, page.keys[at] + ">#text"), page.depths[at] + 1
            children.setdefault(at, []).append((leaf, depth))
            seen[leaf] = depth
            texts_of.add((leaf, xxhash.xxh64_intdigest(text) - (1 << 63), depth))
        for at in range(len(ids)):
            seen[ids[at]] = page.depths[at]
        shares: dict[int, list[Counter]] = {}
        for at, below in children.items():
            order = [k for k, _ in groupby(c for c, _ in below)]
            styles.add((ids[at], xxhash.xxh64_intdigest(np.array(order, np.int64).tobytes()) - (1 << 63), page.depths[at]))
            share = Counter()
            for c, _ in below:
                share[c] += 1 / len(below)
            shares.setdefault(ids[at], []).append(share)
        for at, depth in seen.items():
            add(PAGES, at, 0, depth, 1)
        for at, style, depth in styles:
            add(STYLE, at, style, depth, 1)
        for at, text, depth in texts_of:
            add(TEXT, at, text, depth, 1)
        for at, lists in shares.items():
            for share in lists:
                for c, s in share.items():
                    add(CHILD, at, c, 0, s / len(lists))
    return out


def importance(counts: DataFrame, gamma: float = GAMMA) -> DataFrame:
    """(node, importance, m): composite importances of the merged trees, from the leaves up, level by level."""
    whole = written(counts.groupBy("kind", "node", "other").agg(F.max("depth").alias("depth"), F.sum("value").alias("v")), "tree")

    def part(kind: int, value: F.Column) -> F.Column:
        return F.sum(F.when(F.col("kind") == kind, value))

    v, m = F.col("v"), F.col("m")
    own = whole.where(F.col("kind") != CHILD).groupBy("node").agg(
        F.max("depth").alias("depth"), part(PAGES, v).alias("m"), part(STYLE, F.lit(1)).alias("styles"), part(STYLE, v).alias("s"),
        part(STYLE, v * F.log(v)).alias("sl"), part(TEXT, F.lit(1)).alias("texts"), part(TEXT, F.log(v)).alias("tl"))
    entropy = (F.log("s") - F.col("sl") / F.col("s")) / F.log(m)
    single = F.when(m <= 1, 1.0).when(F.col("styles").isNotNull(), entropy).when(
        F.col("texts").isNotNull(), 1 - F.col("tl") / F.col("texts") / F.log(m)).otherwise(0.0)
    own = written(own.select("node", "depth", "m", F.coalesce("styles", F.lit(0)).alias("styles"), F.greatest(F.lit(0.0), single).alias("single")), "nodes")
    edges = written(whole.where(F.col("kind") == CHILD).join(own.select("node", "m"), "node").select(
        F.col("node").alias("parent"), F.col("other").alias("node"), (v / m).alias("w")), "edges")
    deepest = own.agg(F.max("depth")).first()[0]
    done = None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        level = own.where(F.col("depth") == depth)
        if done is None:
            now = level.select("node", F.col("single").alias("importance"), "m")
        else:
            below = edges.join(done, "node").groupBy("parent").agg(F.sum(F.col("w") * F.col("importance")).alias("below"))
            mixed = (1 - F.pow(F.lit(gamma), F.col("styles"))) * F.col("single") + F.pow(F.lit(gamma), F.col("styles")) * F.col("below")
            now = level.join(below, level["node"] == below["parent"], "left").select(
                "node", F.when(F.col("below").isNull(), F.col("single")).otherwise(mixed).alias("importance"), "m")
        done = now if done is None else done.unionByName(now)
        done = written(done, "importance")
    return done if done is not None else own.select("node", F.col("single").alias("importance"), "m")


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, url, text): the main text of every page, blocks joined by line ends; empty if there is none.

    Every row gives a row. Null html is empty; pages of a null or odd url form the site without a name; equal pages in a
    block of pages count once in the tree. `pages` must read the same rows in the same order each time, as files do.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("doc_id"), _together(url, html).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, _, texts in cut(batches, BLOCK_CHARS):
            found = _counts(texts)
            if found:
                kind, at, other = (list(x) for x in zip(*found, strict=True))
                depth, value = (list(x) for x in zip(*found.values(), strict=True))
                yield pd.DataFrame({"block": np.int64(number), "kind": kind, "node": at, "other": other, "depth": depth, "value": value})

    counts = written(rows.mapInPandas(count, "block long, kind int, node long, other long, depth int, value double"), "page_counts")
    less = importance(counts).where(F.col("importance") < 1)
    here = counts.where(F.col("kind") == PAGES).select("block", "node").join(less, "node").select("block", "node", "importance", "m")

    def extract(block: pd.DataFrame, less: pd.DataFrame) -> pd.DataFrame:
        if len(block) != 1:
            raise ValueError("nodes without their block: the input changed between two reads")
        b = block.iloc[0]
        known = dict(zip(less["node"].tolist(), zip(less["importance"].tolist(), less["m"].tolist(), strict=True), strict=True))
        urls, texts = [], []
        for raw in unpacked(b["sizes"], b["texts"]):
            address, markup = _parts(None if raw is None else raw.decode("utf-8", "surrogatepass"))
            urls.append(address)
            texts.append(Page(markup).main(known, host_of(address), threshold))
        return pd.DataFrame({"page_id": pd.array([None if pd.isna(x) else int(x) for x in b["ids"]], "Int64"), "url": urls, "text": texts})

    return packed(rows, BLOCK_CHARS).groupBy("block").cogroup(here.groupBy("block")).applyInPandas(
        extract, "page_id long, url string, text string")
