"""HTML extraction by site style trees.

The DOMs of all pages of a host are merged into one tree: a node is the path of
block elements (tag and classes) from the root, and siblings alike are one.  A
node knows, over the host's pages, which lists of children it has and which
texts stand below it.  Its importance combines the entropies of these two, the
presentation and the content, each scaled to 0..1; a branch that has the same
text on nearly every page has importance near 0, whatever its name, and is
removed from each page with all that is below.  The whole page is in the tree.

What changes from page to page can't be told from an article that way.  So
the meaning of elements complements the tree: what stands in menus, footers,
asides, forms, scripts, or under a class, id or role that is as a whole one of
NOISE_WORDS goes too, except where it holds the page's main or all articles.
"""

from __future__ import annotations

import hashlib
import html
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import bound_batches, materialize

#: Importance below which a branch goes, and how fast presentation gains on content with the number of different child lists.
IMPORTANCE, GAIN = 0.15, 0.9
#: Weak nodes of all hosts that are broadcast, at most; more are joined by a shuffle in which every host is dealt over SALT tasks.
BROADCAST_NODES, SALT = 200_000, 64
#: Elements whose content is never the article.
NOISE_TAGS = {"head", "title", "script", "style", "noscript", "template", "nav", "footer", "aside", "form", "button", "select", "option", "textarea", "iframe", "svg", "object", "dialog", "menu", "input", "label"}
#: Words of a class, id or role that mark what is not the article.
NOISE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "contentinfo", "cookie", "cookies", "consent", "footer", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "promoted", "recommended", "related", "replies", "reply", "search", "share", "sharing", "sidebar", "signup", "site-footer", "site-header", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
#: Elements that no word marks; nor does it one that holds the page's main, or all its articles.
KEPT_TAGS = {"html", "body", "main", "article"}
#: Elements that begin and end a block of text.
BLOCK_TAGS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: Elements without an end, and what an opening element closes before it.
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
RAW_TAGS = ("script", "style", "textarea", "title", "noscript", "template", "iframe")


#: A value without quotes may hold any quotes but at its beginning; what is open at the end of the page ends there.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)*+)(?:>|\Z)|[^<]+|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")
#: The node above all others.
ROOT = 0


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


@lru_cache(1 << 14)
def _child(parent: int, name: str) -> int:
    """The node of an element below another; paths are never written out, so a deep page costs no more per element."""
    return _digest(parent.to_bytes(8, "little", signed=True) + name.encode("utf-8", "surrogatepass"))


def _noise(tag: str, attributes: dict[str, str], inside_article: bool) -> str:
    """"sure" if the element says that it is noise, "word" if a word of its attributes does, "" if none.

    A token counts as a whole, or if all its parts at - and _ are NOISE_WORDS;
    so do all words of an aria-label.  Of other compounds (no-sidebar,
    related-work) the style tree decides.
    """
    if tag in NOISE_TAGS or tag == "header" and not inside_article or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return "sure"
    if tag in KEPT_TAGS:
        return ""
    for name in ("class", "id", "role"):
        tokens = attributes.get(name, "").split()
        if any(NOISE_WORDS.issuperset([t] if t in NOISE_WORDS else re.split(r"[_-]", t)) for t in tokens) or name == "role" and "complementary" in tokens:
            return "word"
    label = re.split(r"[\s_-]+", attributes["aria-label"]) if attributes.get("aria-label") else []
    return "word" if label and NOISE_WORDS.issuperset(label) else ""


class _Element:
    """An open element: its tag, its node (that of the next block element above for others), the innermost mark around it, and whether it is in a weak branch."""

    __slots__ = ("tag", "node", "mark", "weak", "article")

    def __init__(self, tag: str, node: int, mark: int, weak: bool, article: bool):
        self.tag, self.node, self.mark, self.weak, self.article = tag, node, mark, weak, article


class Page:
    """A parsed page: ``blocks`` of text in order and ``parents`` of its nodes, as they first occur.

    Markup may be incomplete: an end without a beginning is ignored, what is
    open at the end is closed there, and ``p`` ends where a block begins.  The
    time is in proportion to the page, however deep its elements are.
    """

    def __init__(self, page: str, weak: frozenset[int] | set[int] = frozenset()):
        self.blocks: list[tuple[int, str, int, bool]] = []  # node, text, innermost mark, in a weak branch
        self.parents: dict[int, int] = {}
        self.children: dict[int, list[int]] = {ROOT: []}
        self.marks: list[tuple[str, int]] = []  # kind, the mark around it
        self._lifted: set[int] = set()
        self._parse(page, weak)

    def kept(self) -> list[str]:
        """The texts that neither the style tree nor a mark of noise takes out."""
        return [text for _, text, mark, weak in self.blocks if not weak and self._free(mark)]

    def _free(self, mark: int) -> bool:
        while mark >= 0 and mark in self._lifted:
            mark = self.marks[mark][1]
        return mark < 0

    def _lift(self, mark: int, lifted: set[int]) -> None:
        while mark >= 0 and mark not in lifted:
            lifted.add(mark)
            mark = self.marks[mark][1]

    def _parse(self, page: str, weak) -> None:
        stack: list[_Element] = []
        open_: dict[str, int] = {}
        marks, run = self.marks, []
        around: set[int] = set()  # marks by a word that hold an article
        outside = False  # an article lies below no mark
        at, lower = 0, None

        def flush():
            text = _SPACE.sub(" ", html.unescape("".join(run))).strip()
            run.clear()
            if text:
                top = stack[-1] if stack else None
                self.blocks.append((top.node, text, top.mark, top.weak) if top else (ROOT, text, -1, False))

        def close(depth: int):
            for x in stack[depth:]:
                open_[x.tag] -= 1
            del stack[depth:]

        def last(tag: str) -> int:
            """Where the innermost open element of that tag is; those above it are about to be closed."""
            depth = len(stack) - 1
            while stack[depth].tag != tag:
                depth -= 1
            return depth

        while at < len(page):
            m = _TOKEN.match(page, at)
            at = m.end()
            tag = m.group(2)
            if tag is None:
                piece = m.group(0)
                if piece.startswith("<![CDATA["):
                    run.append(html.escape(piece[9:].removesuffix("]]>")))
                elif not piece.startswith(("<!", "<?")):
                    run.append(piece)
                continue
            tag = tag.lower()
            if m.group(1):
                if open_.get(tag):
                    depth = last(tag)
                    before = stack[depth - 1].mark if depth else -1
                    if stack[-1].mark != before or any(x.tag in BLOCK_TAGS for x in stack[depth:]):
                        flush()
                    close(depth)
                continue
            if tag == "br":
                run.append(" ")
            if tag in BLOCK_TAGS:
                flush()
                if open_.get("p"):
                    close(last("p"))
                shut = CLOSED_BY.get(tag, ())
                while stack and stack[-1].tag in shut:
                    close(len(stack) - 1)
            if tag in VOID_TAGS or m.group(3).rstrip().endswith("/") and tag not in BLOCK_TAGS:
                continue
            attributes: dict[str, str] = {}
            for name, x, y, z in _ATTRIBUTE.findall(m.group(3)) if m.group(3) else ():
                attributes.setdefault(name.lower(), (x or y or z).lower())
            top = stack[-1] if stack else _Element("", ROOT, -1, False, False)
            node, mark = top.node, top.mark
            noise = "" if mark >= 0 and marks[mark][0] == "sure" else _noise(tag, attributes, top.article)
            if noise:
                flush()
                marks.append((noise, mark))
                mark = len(marks) - 1
            elif tag in ("main", "article") and (mark < 0 or marks[mark][0] == "word"):
                self._lift(mark, self._lifted if tag == "main" else around)
                outside = outside or mark < 0
            if tag in BLOCK_TAGS:
                node = _child(node, " ".join([tag, *sorted(attributes.get("class", "").split())]))
                self.parents.setdefault(node, top.node)
                own = self.children.setdefault(top.node, [])
                if not own or own[-1] != node:  # alike siblings in a row are one
                    own.append(node)
                self.children.setdefault(node, [])
            stack.append(_Element(tag, node, mark, top.weak or node in weak, top.article or tag in ("article", "main")))
            open_[tag] = open_.get(tag, 0) + 1
            if tag in RAW_TAGS:  # no markup inside: on to its own end
                lower = lower if lower is not None else page.lower()
                end = lower.find(f"</{tag}", at)
                at = end if end >= 0 else len(page)
        flush()
        if not outside:
            self._lifted |= around

    def nodes(self) -> list[tuple[int, int, int]]:
        """(node, digest of its lists of children, digest of all text below it), of every node with text below."""
        text: dict[int, int] = {}
        mask = (1 << 64) - 1
        for node, t, _, _ in self.blocks:
            text[node] = (text.get(node, 0) * 0x9E3779B97F4A7C15 + _digest(t.encode("utf-8", "surrogatepass"))) & mask
        for node in reversed(self.parents):  # a node first occurs after its parent
            if node in text:
                up = self.parents[node]
                text[up] = (text.get(up, 0) * 0x9E3779B97F4A7C15 + text[node]) & mask
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        return [(n, _digest(b"".join(c.to_bytes(8, "little", signed=True) for c in self.children[n])), signed(text[n])) for n in self.parents if n in text]


def blocks(page: str) -> list[str]:
    """The text blocks of a page in order, without those below an element that marks noise; the style tree is not asked."""
    return Page(page).kept()


_NODE = pa.struct([("path", pa.int64()), ("shape", pa.int64()), ("content", pa.int64())])


def _nodes(batches):
    """A page's digest and the nodes of its tree."""
    for batch in batches:
        digests, nodes = [], []
        for page in batch.column(1).to_pylist():
            own = Page(page or "")
            digests.append(_digest("\n".join(f"{b[0]}\t{b[1]}" for b in own.blocks).encode("utf-8", "surrogatepass")))
            nodes.append([{"path": n, "shape": s, "content": c} for n, s, c in own.nodes()])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.int64()), pa.array(nodes, pa.list_(_NODE))], names=["url", "digest", "nodes"])


def _texts(batches):
    """The remaining blocks of pages, each with the weak nodes of its host."""
    for batch in batches:
        made = ["\n\n".join(Page(page or "", set(weak or ())).kept()) for page, weak in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string())], names=["page_id", "url", "text"])


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def importance(cut: DataFrame) -> DataFrame:
    """``(host, path, pages, shape_entropy, content_entropy, importance)`` of the style tree's nodes.

    ``cut`` has ``(host, digest, nodes)``, one row per page; pages of a host
    that are copies of each other count once.  The entropies of a node's lists
    of children and of the texts below it are divided by the logarithm of the
    number of pages; one more page, unlike all others, is counted in, so that few
    pages can't prove that a branch is always the same.  With ``l`` lists of
    children the importance is ``1 - GAIN ** l`` parts of the first and ``GAIN
    ** l`` of the second, which is the smaller share of the first while the layout
    is one.  All counts are grouped aggregates that combine before the shuffle.
    """
    once = cut.groupBy("host", "digest").agg(F.first("nodes").alias("nodes")).select("host", F.explode("nodes").alias("node"))
    kinds = once.groupBy("host", F.col("node.path").alias("path"), F.col("node.shape").alias("shape"), F.col("node.content").alias("content")).agg(F.count("*").alias("c"))
    kinds = materialize(kinds, "site-nodes")

    def entropy(kind: str) -> DataFrame:
        counts = kinds.groupBy("host", "path", kind).agg(F.sum("c").alias("c"))
        sums = counts.groupBy("host", "path").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("s"), F.count("*").alias("kinds"))
        n = F.col("n") + 1  # sum of -c/n log(c/n) over the kinds and the one page more
        return sums.select("host", "path", F.col("n").alias("pages"), ((F.log(n) - F.col("s") / n) / F.log(n)).alias(f"{kind}_entropy"), F.col("kinds").alias(f"{kind}_kinds"))

    both = entropy("content").join(entropy("shape").drop("pages"), ["host", "path"])
    share = F.pow(F.lit(GAIN), F.col("shape_kinds"))
    return both.select("host", "path", "pages", "shape_entropy", "content_entropy", ((1 - share) * F.col("shape_entropy") + share * F.col("content_entropy")).alias("importance"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)``: the main text of every row.

    Blocks are joined by two line feeds in page order; white space inside a
    block is one space.  A null page is empty and has the empty text, as has a
    page of which nothing remains.  Repeated rows are extracted each; pages
    without a host are judged by their own elements only.  Other columns are
    not read; an empty table gives an empty result.  Pages are parsed twice,
    for the tree and for the text, so that no page's text is shuffled or stored
    in between, unless there are more weak nodes than a broadcast may hold.
    """
    given = bound_batches(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    trees = given.select("url", "html").mapInArrow(_nodes, "url string, digest long, nodes array<struct<path:long,shape:long,content:long>>").withColumn("host", host_of(F.col("url")))
    low = importance(trees.where(F.col("host") != "")).where(F.col("importance") < IMPORTANCE)
    weak = materialize(low.groupBy("host").agg(F.collect_set("path").alias("weak")), "weak-nodes")
    size = weak.agg(F.coalesce(F.sum(F.size("weak")), F.lit(0))).first()[0]
    hosted = given.withColumn("host", host_of(F.col("url")))
    if size <= BROADCAST_NODES:
        joined = hosted.join(F.broadcast(weak), "host", "left")
    else:  # a host with many pages meets its nodes in many tasks
        salted = weak.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = hosted.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int")).join(salted, ["host", "salt"], "left")
    made = joined.select("page_id", "url", "html", "weak").mapInArrow(_texts, "page_id long, url string, text string")
    return made.withColumn("n_chars", F.length("text").cast("long"))
