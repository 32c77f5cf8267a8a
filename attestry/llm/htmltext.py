"""Operator 6: main text of web pages by removal of site templates.

Every block element's subtree is hashed; Spark counts, for each host, the different pages that hold a subtree, and
subtrees that recur across many pages of their host are deleted, inside an article too if they are menus or boxes.
Elements that say what they are (navigation, forms, adverts and so on, by tag, role, class or id) are deleted on any
page, unless they are wrappers around the page's main text.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.store import settle, small_batches
from attestry.llm.urltrust import host_of

#: A subtree is template if so many different pages of the host hold it.
PAGES = 4
#: A wrapper with this share of an article's text, or of a page's that has none, is no template, whatever it is called.
WRAPS = 0.75

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video title textarea".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())
#: Elements that are never part of the main text.
DROPPED = frozenset("nav footer aside form menu dialog button select option input label fieldset search head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: Words of a class or id that name something other than the main text.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox sponsor sponsored promo promotion promoted banner nav navbar navigation menu "
    "menubar breadcrumb breadcrumbs sidebar side aside footer foot masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert "
    "popup modal overlay newsletter subscribe subscription signup login form search share sharing social related recommended comment comments commentlist "
    "discussion disqus replies reply respond widget widgets pager pagination copyright disclaimer".split())
HEADERS = frozenset("header head".split())
#: Tags and words of a class or id that name something other than the main text even around an article or most of the text.
NEVER = frozenset("nav footer aside menu dialog button select option input label search head".split())
APART = frozenset("comment comments commentlist discussion disqus replies reply respond related recommended teaser teasers".split())
#: Words after which a compound name speaks of something else ("no-sidebar") or of a state ("comments-open").
TURNS = frozenset("has no non not with without is hide hides show shows".split())
STATES = frozenset("open closed enabled disabled count on off".split())
#: Blocks of running text, kept in an article even if other pages of the host have the same ones.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dt dd td th tr tbody thead tfoot caption figcaption figure summary header hgroup address article main".split())
LISTS = frozenset("ul ol dl table".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?<![\S])(hidden)(?![\S=])""")
_CLOSED_BY = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr",)), "th": ("td th", ("tr",)), "option": ("option", ("select",))}


class Node:
    __slots__ = ("tag", "attributes", "children", "mark")

    def __init__(self, tag: str, attributes: dict[str, str]) -> None:
        self.tag, self.attributes = tag, attributes
        self.children: list[Node | str] = []
        self.mark = 0


def parse(page: str) -> Node:
    """A tree of a page, however broken: open elements are closed where the next block or the page's end demands it."""
    root = Node("#root", {})
    stack = [root]
    at = 0

    def close(tags: tuple[str, ...], within: tuple[str, ...]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in within:
                return

    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            stack[-1].children.append(text)
        if m is None:
            return root
        at = m.end()
        tag = m[3].lower() if m[3] else None
        if tag is None:
            if m[1]:
                stack[-1].children.append(m[1])
        elif m[2]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag not in BLOCKS and stack[i].tag in BLOCKS:
                    break  # an inline end tag does not reach past a block
        else:
            attributes = {(a or e).lower(): html.unescape(b or c or d or "") for a, b, c, d, e in _ATTRIBUTE.findall(m[4])} if m[4] else {}
            if tag in BLOCKS:
                close(("p",), ("article", "section", "div", "main", "td", "th", "li", "blockquote", "aside", "nav", "footer", "header", "form", "figure", "table", "body", "button"))
            if tag in _CLOSED_BY:
                close(tuple(_CLOSED_BY[tag][0].split()), _CLOSED_BY[tag][1])
            node = Node(tag, attributes)
            stack[-1].children.append(node)
            if tag in RAW and not m[4].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif tag not in VOID and tag not in RAW:
                stack.append(node)


def _is_main(node: Node) -> bool:
    return node.tag in ("article", "main") or node.attributes.get("role", "").lower() in ("main", "article")


def _names(node: Node) -> list[list[str]]:
    """The words of each name in class and id, up to a word that turns the meaning; names of a state have none."""
    names = []
    for name in f"{node.attributes.get('class', '')} {node.attributes.get('id', '')}".split():
        words = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower()) if w]
        stop = next((i for i, w in enumerate(words) if w in TURNS), len(words))
        if stop and words[-1] not in STATES:
            names.append(words[:stop])
    return names


def template_kind(node: Node, inside: bool) -> int:
    """2: template whatever it holds; 1: template unless it wraps the main text; 0: not named as template.

    ``inside``: the node stands in an article or main element."""
    if node.tag in NEVER or node.tag in RAW or "hidden" in node.attributes:
        return 2
    named = 1 if node.tag in DROPPED or node.tag in HEADERS and not inside else 0
    if not node.attributes or node.tag in ("html", "body", "main"):
        return named
    if node.attributes.get("aria-hidden", "") == "true" or "display:none" in node.attributes.get("style", "").replace(" ", ""):
        return 2
    names = _names(node)
    if _is_main(node):  # an article is named by the last word of a name only
        return 2 if any(n[-1] in APART for n in names) else named
    if any(w in APART for n in names for w in n):
        return 2
    if node.attributes.get("role", "").lower() in ROLES or any(w in NAMES or not inside and w in HEADERS for n in names for w in n):
        return 1
    return named


def subtree_marks(root: Node) -> dict[int, Node]:
    """The hash of every block element's subtree (tags, class, text), which is also left in ``mark``."""
    found: dict[int, Node] = {}
    order: list[Node] = [root]
    for node in order:
        order.extend(c for c in node.children if isinstance(c, Node))
    for node in reversed(order):
        h = hashlib.blake2b(f"{node.tag}\0{node.attributes.get('class', '')}\0".encode(), digest_size=8)
        for c in node.children:
            h.update(c.mark.to_bytes(8, "little", signed=True) if isinstance(c, Node) else b"\1" + " ".join(c.split()).encode("utf-8", "surrogatepass"))
        node.mark = int.from_bytes(h.digest(), "little", signed=True)
        if node.tag in BLOCKS and node.tag not in ("html", "body", "head", "li"):
            found[node.mark] = node
    return found


def _sizes(order: list[tuple[Node, bool]]) -> tuple[dict[int, int], dict[int, int], dict[int, int]]:
    """By node, bottom up: letters of text, of text in articles, and of text in links, all without what is always template."""
    text: dict[int, int] = {}
    article: dict[int, int] = {}
    links: dict[int, int] = {}
    for node, inside in reversed(order):
        kids = [c for c in node.children if isinstance(c, Node)]
        own = sum(len("".join(c.split())) for c in node.children if isinstance(c, str)) + sum(text[id(c)] for c in kids)
        kind = template_kind(node, inside)
        text[id(node)] = 0 if kind == 2 else own
        links[id(node)] = text[id(node)] if node.tag == "a" else 0 if kind == 2 else sum(links[id(c)] for c in kids)
        article[id(node)] = 0 if kind == 2 else own if _is_main(node) else sum(article[id(c)] for c in kids)
    return text, article, links


def main_text(root: Node, template: set[int]) -> str:
    """Blocks of the main text; ``template`` holds the marks of subtrees that recur on the host."""
    order: list[tuple[Node, bool]] = [(root, False)]
    for node, inside in order:
        within = inside or _is_main(node)
        order.extend((c, within) for c in node.children if isinstance(c, Node))
    text_of, article_of, links_of = _sizes(order)
    whole, article = text_of[id(root)], article_of[id(root)]
    blocks: list[str] = []
    open_: list[str] = []

    def end() -> None:
        text = " ".join(html.unescape("".join(open_)).split())
        if text:
            blocks.append(text)
        open_.clear()

    def wraps(node: Node, inside: bool) -> bool:
        if article:
            return text_of[id(node)] >= WRAPS * article if inside else 2 * article_of[id(node)] > article
        return node.tag != "header" and text_of[id(node)] >= WRAPS * whole and any(isinstance(c, Node) and c.tag in BLOCKS for c in node.children)

    def recurs(node: Node, inside: bool) -> bool:
        if node.mark not in template or node.tag not in BLOCKS:
            return False
        if not article:
            return True
        if not inside:
            return not article_of[id(node)]
        if node.tag in LEAVES or 2 * text_of[id(node)] > article:
            return False
        return node.tag not in LISTS or 2 * links_of[id(node)] > text_of[id(node)]

    work: list[tuple[object, bool]] = [(root, False)]
    while work:
        item, inside = work.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            if inside or not article:
                open_.append(item)
        else:
            node = item
            kind = template_kind(node, inside)
            if kind == 2 or kind == 1 and not wraps(node, inside) or recurs(node, inside):
                open_.append(" ")
                continue
            block = node.tag in BLOCKS
            if block:
                end()
                work.append((None, inside))
            elif node.tag in ("br", "td", "th", "img", "option"):
                open_.append(" ")
            within = inside or _is_main(node)
            work.extend((c, within) for c in reversed(node.children))
    end()
    return "\n\n".join(blocks)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, host hash, html) -> (key, host hash, mark, page) of each different subtree of a page; page is the whole page's mark."""
    for batch in batches:
        keys, hosts, marks, wholes = [], [], [], []
        for key, host, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            root = parse(page or "")
            own = list(subtree_marks(root))
            marks += own
            keys += [key] * len(own)
            hosts += [host] * len(own)
            wholes += [root.mark] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, hosts, marks, wholes)], ["key", "host", "mark", "page"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            root = parse(page or "")
            if marks:
                subtree_marks(root)
            texts.append(main_text(root, set(marks or ())))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["row", "text", "n_chars"])


def extract(pages: DataFrame, least: int = PAGES) -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of ``pages`` (page_id, url, html; others are not read).

    A subtree is template if at least ``least`` different pages of its host hold it; copies of a page are one page
    there, so that a page is no template of its copies.  A page with an article or main element gives the text inside;
    in there recurring menus (lists mostly of links) and boxes go, paragraphs and headings stay, and so does whatever
    holds over half of the article.  Null or empty html gives an empty text; pages without a host form a host of
    their own; repeated rows come back as often as they came; an empty table gives an empty result.
    """
    small_batches(pages.sparkSession)
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    host = F.xxhash64(host_of(F.coalesce("url", F.lit("")))).alias("host")
    keyed = pages.select("*", F.xxhash64("page_id", "url", "html").alias("key"), host)
    marks = settle(keyed.select("key", "host", "html").mapInArrow(_marks, "key long, host long, mark long, page long"))
    # a mark whose pages set so many of 64 bits is on so many pages; only where fewer bits are set are the pages themselves counted
    bits = F.bit_count(F.bit_or(F.expr("shiftleft(1L, int(pmod(page, 64)))")))
    count = settle(marks.groupBy("host", "mark").agg(F.count(F.lit(1)).alias("n"), bits.alias("bits")).where(F.col("n") >= least))
    unsure = settle(count.where(F.col("bits") < least).select("host", "mark"))
    counted = marks.join(unsure, ["host", "mark"]).select("host", "mark", "page").distinct().groupBy("host", "mark").count().where(F.col("count") >= least)
    often = count.where(F.col("bits") >= least).select("host", "mark").unionByName(counted.select("host", "mark"))
    found = marks.hint("merge").join(often.select("host", "mark"), ["host", "mark"]).groupBy("key").agg(F.collect_set("mark").alias("marks"))
    row = F.struct("page_id", "url").alias("row")
    joined = keyed.hint("merge").join(settle(found), "key", "left").select(row, "html", "marks")
    out = joined.mapInArrow(_extract, f"row {joined.schema['row'].dataType.simpleString()}, text string, n_chars long")
    return out.select("row.page_id", "row.url", "text", "n_chars")
