"""Main text of web pages: site templates are removed by subtree counts.

Pass 1 parses each page into elements and text blocks; every element subtree
outside the kept skeleton is hashed (tags and text), and Spark counts the
different pages per (host, hash), combined before shuffling; copies count once.
A subtree that recurs on at least ``least_pages`` pages of a host is its template.
Subtrees inside an article, and single paragraphs, list items, cells and words
anywhere, may recur as quoted or licence text does; they are the template only if
they also recur on ``least_share`` of the host's pages.
Pass 2 joins the blocks' subtree hashes with the templates and keeps the blocks
without any template ancestor. The whole html is read once; only hashes and text
blocks are exchanged, and a hot host's rows are dealt by page.

What does not recur but is never article text (navigation, headers and footers of
the page, sidebars, notices, adverts, forms, scripts, styles, reader comments)
goes by tag, role, and whole class and id names. Where a page has an ``article`` or ``main``, only text
inside it is taken.

Edge cases: null or empty html gives an empty text; a page without a host is its
own host group; broken markup is closed as browsers do for paragraphs, list
items and table cells; repeated rows get a row each; equal page ids are told
apart by their row; an empty input gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroframe.llm.common import bound_batches, materialize

# HTML elements by role.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html",
    "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
NEVER = {
    "script", "style", "noscript", "template", "head", "title", "nav", "footer", "aside", "form", "button", "select", "option",
    "textarea", "input", "label", "iframe", "object", "svg", "canvas", "dialog", "menu", "search", "audio", "video", "map",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "note", "status"}
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar",
    "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "sidebar", "aside", "cookie", "cookies", "consent",
    "gdpr", "notice", "popup", "modal", "newsletter", "subscribe", "signup", "login", "share", "sharing", "social", "related", "recommended",
    "comment", "comments", "commentlist", "disqus", "respond", "replies", "widget", "toolbar", "pagination", "pager", "skip", "legal", "copyright",
}
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"},
          "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "p": {"table", "td", "th", "li", "div", "article", "section", "main", "blockquote", "body", "figure"}}
# words that say nothing about a block's kind beside a name of NAMES: "site-footer", "ad_slot_2"
FILLERS = {
    "site", "page", "global", "main", "top", "bottom", "left", "right", "box", "block", "bar", "container", "wrapper", "wrap", "inner", "outer",
    "area", "section", "slot", "unit", "list", "item", "items", "links", "link", "buttons", "button", "icons", "text", "policy", "form", "primary",
    "secondary", "fixed", "sticky", "mobile", "desktop", "large", "small", "content",
}
TITLES = {"header", "masthead"}
CONTENT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "b", "i", "em", "strong", "a", "span", "code", "pre", "q", "u", "sub", "sup", "small", "mark",
           "blockquote", "li", "td", "th", "tr"}
# subtrees around a block that are looked up, from the innermost: broken pages nest without end, and what
# lies inside a recurring subtree recurs as often itself
DEPTH = 48
SKELETON = {"html", "body", "article", "main"}
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@lru_cache(4096)
def names_of(given: str) -> frozenset[str]:
    """Names of a class or id value that tell of a block that is no article text: a whole
    token, or one whose every part is such a name or a filler."""
    out = set()
    for token in given.split():
        parts = {p.lower() for p in _NAME.findall(token)}
        told = parts & NAMES or {token.lower()} & NAMES
        if told and parts <= NAMES | FILLERS:
            out |= told
    return frozenset(out)


class _Parser(HTMLParser):
    """Blocks of text with the elements above them, in page order."""

    def __init__(self, wrappers: bool = False):
        super().__init__(convert_charrefs=True)
        self.wrappers = wrappers  # a wrapper's own name does not condemn the article inside it
        self.lost_article = False
        self.nodes: list[list] = []  # [tag, parent, never, in_article, hash parts]
        self.stack: list[int] = []
        self.blocks: list[tuple[int, str]] = []
        self.text: list[str] = []
        self.holder = -1
        self.has_article = False

    def _flush(self):
        if self.text:
            said = _SPACE.sub(" ", "".join(self.text)).strip()
            if said:
                self.blocks.append((self.holder, said))
            self.text = []

    def _open(self, tag, attrs):
        parent = self.stack[-1] if self.stack else -1
        given = {k: (v or "") for k, v in attrs}
        words = names_of(f"{given.get('class', '')} {given.get('id', '')}")
        up = self.nodes[parent] if parent >= 0 else None
        in_article = bool(up and up[3]) or tag in ("article", "main")
        never = bool(up and up[2]) or tag in NEVER or given.get("role", "").lower() in ROLES or "hidden" in given
        never = never or "display:none" in given.get("style", "").replace(" ", "").lower()
        if tag not in SKELETON and (in_article or not self.wrappers):
            never = never or bool(words - TITLES if in_article else words)
        if tag == "header":  # an article's own header holds its title
            never = never or not (up and up[3])
        if tag in ("article", "main"):
            if words & {"comment", "comments"}:
                never = True
            self.has_article |= not never
            self.lost_article |= never
        # text of ruled out blocks is kept apart as blocks of their own, that of words inside a block is not
        kind = (up[2] if up and up[2] else 2 if tag in BLOCKS else 1) if never else 0
        self.nodes.append([tag, parent, kind, in_article, [tag]])
        return len(self.nodes) - 1

    def _leave(self, upto: int):
        while len(self.stack) > upto:
            self.stack.pop()

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._flush()
            if tag not in VOID:
                self._close_open("p", SCOPES["p"])
        if tag in CLOSES:
            for old in CLOSES[tag]:
                self._close_open(old, SCOPES.get(tag, set()))
        if tag in VOID:
            if tag in ("br", "hr"):
                self.text.append(" ")
            return
        self.stack.append(self._open(tag, attrs))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def _close_open(self, tag, stops):
        for at in range(len(self.stack) - 1, -1, -1):
            name = self.nodes[self.stack[at]][0]
            if name == tag:
                self._leave(at)
                return
            if name in stops:
                return

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._flush()
        for at in range(len(self.stack) - 1, -1, -1):
            name = self.nodes[self.stack[at]][0]
            if name == tag:
                self._leave(at)
                return
            if name in BLOCKS and tag not in BLOCKS:
                return

    def handle_data(self, data):
        at = self.stack[-1] if self.stack else -1
        if at >= 0 and self.nodes[at][0] in ("script", "style", "title"):
            return
        if at >= 0 and self.nodes[at][2] == 1:
            self.nodes[at][4].append(data)
            return
        if not self.text or self.holder < 0:
            self.holder = at
        self.text.append(data)

    def read(self, html):
        self.feed(html or "")
        self.close()
        self._flush()
        return self


def parse(html: str | None) -> tuple[list[tuple[str, list[int]]], list[int], int]:
    """Text blocks (text, or none where tags or names rule it out; hashes of the subtrees
    around it), and the hashes of all subtrees of the page outside its skeleton, and a
    hash of the whole."""
    page = _Parser().read(html)
    if page.lost_article and not page.has_article:
        page = _Parser(wrappers=True).read(html)
    nodes = page.nodes
    for at, said in page.blocks:
        if at >= 0:
            nodes[at][4].append(said)
    digests: list[int | None] = [None] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):
        tag, parent, _, _, parts = nodes[k]
        h = xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"))
        if parent >= 0:
            nodes[parent][4].append(h)
        if tag not in SKELETON and any(not isinstance(p, str) for p in parts) or len(parts) > 1 and tag not in SKELETON:
            # the lowest bit tells content from chrome, which Spark judges by different counts
            digests[k] = (h - (1 << 63)) & ~1 | int(page.has_article and nodes[k][3] or tag in CONTENT)
    kept = []
    for at, said in page.blocks:
        # what tags and names rule out keeps its place, so that it is told whether the counts struck it
        out = at >= 0 and nodes[at][2] > 0 or page.has_article and not (at >= 0 and nodes[at][3])
        above, k = [], at
        while k >= 0 and len(above) < DEPTH:
            if digests[k] is not None:
                above.append(digests[k])
            k = nodes[k][1]
        kept.append(("" if out else said, above))
    whole = xxhash.xxh3_64_intdigest((html or "").encode("utf-8", "surrogatepass")) - (1 << 63)
    return kept, sorted({d for d in digests if d is not None}), whole


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract_text(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least_pages: int = 5, least_share: float = 0.3, most_broadcast: int = 250_000,
) -> DataFrame:
    """One row per page: id, url, text, n_chars, n_struck (blocks inside recurring subtrees).

    Up to ``most_broadcast`` struck hashes are sent to all tasks, more are joined."""
    bound_batches(df.sparkSession, 500)
    # ids cross to Python as text, since pandas would turn a batch with a null into floats
    rows = df.select(F.col(id_col).cast("long").cast("string").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"),
                     F.monotonically_increasing_id().alias("row"))

    def run(batches):
        for b in batches:
            found = [parse(h) for h in b["html"]]
            out = b[["page_id", "url", "row"]].copy()
            out["blocks"] = [[{"text": t, "above": a} for t, a in kept] for kept, _, _ in found]
            out["hashes"] = [h for _, h, _ in found]
            out["whole"] = [w for _, _, w in found]
            yield out

    parsed = materialize(
        rows.mapInPandas(run, "page_id string, url string, row long, blocks array<struct<text:string, above:array<long>>>, hashes array<long>, whole long")
        .withColumn("host", host_of(F.col("url"))).withColumn("page_id", F.col("page_id").cast("long"))
    )
    once = parsed.groupBy("host", "whole").agg(F.any_value("hashes").alias("hashes"))
    pages = once.groupBy("host").agg(F.count("*").alias("n"))
    template = (
        once.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("k"))
        .where(F.col("k") >= least_pages).join(pages, "host").where((F.pmod("hash", F.lit(2)) == 0) | (F.col("k") >= least_share * F.col("n"))).select("host", "hash")
    )
    template = materialize(template)
    # of a page, only hashes over candidate blocks matter
    used = parsed.select("host", "row", F.explode(F.array_distinct(F.flatten("blocks.above"))).alias("hash"))
    struck = materialize(used.join(template, ["host", "hash"]).groupBy("row").agg(F.collect_set("hash").alias("struck")))
    # the text blocks stay where they are if what is struck is small: its size is checked
    if (struck.agg(F.sum(F.size("struck"))).first()[0] or 0) <= most_broadcast:
        struck = F.broadcast(struck)
    left = F.filter("blocks", lambda b: ~F.arrays_overlap(b["above"], F.coalesce("struck", F.array().cast("array<long>"))))
    text = F.array_join(F.transform(F.filter("left", lambda b: b["text"] != ""), lambda b: b["text"]), "\n")
    out = parsed.select("page_id", "url", "row", "blocks").join(struck, "row", "left").withColumn("left", left)
    out = out.select("page_id", "url", text.alias("text"), (F.size("blocks") - F.size("left")).cast("long").alias("n_struck"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_struck")
