"""Main text of web pages, with site templates deduced from tokens that share occurrence vectors."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempolog.llm.common import durable, map_batches

# A host's template needs so many different pages; its tokens are in this share of them, in classes of at least so many.
LEAST_PAGES, SUPPORT, CLASS_SIZE = 4, 0.8, 3
# Element names, fixed by HTML: without content, with raw text, and those that start a block.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe textarea title svg math".split())
BLOCKS = set("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
             "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
# Elements that are never part of an article, and roles and class words of such elements.
OUTSIDE = RAW | set("head nav footer aside form button select option menu dialog input label fieldset".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CLASS_WORDS = re.compile(
    r"(ads?|adverts?|advertisements?|adsense|adbox|sponsor\w*|promo\w*|banners?|cookies?|consent|gdpr|notices?|alerts?|newsletter|subscribe\w*|"
    r"sidebars?|widgets?|menus?|nav|navbar|navigation|breadcrumbs?|footers?|headers?|masthead|comments?|disqus|repl(y|ies)|respond|"
    r"shar(e|ing)|social|related|recommend\w*|popups?|modal|login|signup|search|toolbar|skip|copyright|legal|disclaimer|pagination|pager|hidden)")
LAST_PARTS = re.compile(r"ads?|banners?|notices?|sidebars?|widgets?|menus?|nav|footers?|headers?|comments?")
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s"'=<>/]+)""")


@dataclass
class Node:
    """An open element: its name, its place in the page's tree as a hash, and whether it or one above is outside."""

    name: str
    path: int
    outside: bool
    article: int
    main: bool


@dataclass
class Page:
    """Blocks of text in page order, and the page's tokens: elements by path, and block texts by path."""

    blocks: list[tuple[str, Node]] = field(default_factory=list)
    tokens: list[int] = field(default_factory=list)
    block_tokens: list[int] = field(default_factory=list)


def _names_outside(word: str, in_article: bool) -> bool:
    """Whether a class word names a part outside the article by itself, by its first or by its last part."""
    parts = re.split(r"[-_]+", word)
    if len(parts) > 1 and parts[0] in ("has", "with", "no"):
        return False
    if in_article and parts[-1] in ("header", "headers"):
        return False
    return any(CLASS_WORDS.fullmatch(w) for w in (word, parts[0])) or LAST_PARTS.fullmatch(parts[-1]) is not None


def _is_outside(name: str, attributes: str, in_article: bool) -> bool:
    if name in OUTSIDE or name == "header" and not in_article:
        return True
    if name in ("html", "body", "main", "article") or not attributes.strip():
        return name == "article" and "comment" in attributes.lower()
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = (m[1] or m[5]).lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id") and any(_names_outside(v, in_article) for v in value.split()):
            return True
        if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def parse(html: str) -> Page:
    """The blocks and tokens of a page. Elements that are not closed end with their parent, or where the next of their kind starts."""
    page = Page()
    digest = lambda *x: xxhash.xxh64_intdigest(repr(x)) >> 1
    stack = [Node("", 0, False, 0, False)]
    text: list[str] = []
    articles = 0

    def flush() -> None:
        block = " ".join(unescape("".join(text)).split())
        text.clear()
        if block:
            token = digest(stack[-1].path, block)
            page.blocks.append((block, stack[-1]))
            page.tokens.append(token)
            page.block_tokens.append(token)

    def close(upto: int) -> None:
        del stack[upto:]

    at, length = 0, len(html)
    while at < length:
        m = _TAG.search(html, at)
        text.append(html[at:m.start() if m else length])
        if m is None:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in BLOCKS or name in RAW:
            flush()
        elif name == "br":
            text.append(" ")
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    close(i)
                    break
            continue
        if name in VOID:
            continue
        if name in BLOCKS:
            # A paragraph ends where a block starts, a list item where the next one does.
            for i in range(len(stack) - 1, 0, -1):
                open_name = stack[i].name
                if open_name == "p" or open_name == name and name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                    close(i)
                    break
                if open_name in BLOCKS:
                    break
        above = stack[-1]
        if name == "article" and not above.article:
            articles += 1
        node = Node(name, digest(above.path, name, m[3].strip()) if name in BLOCKS else above.path,
                    above.outside or _is_outside(name, m[3], bool(above.article)),
                    above.article or (articles if name == "article" else 0), above.main or name == "main")
        if name in BLOCKS:
            page.tokens.append(node.path)
        if name in RAW:
            if m[3].endswith("/"):
                continue
            end = re.compile(f"</{re.escape(name)}\\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else length
            continue
        stack.append(node)
    flush()
    return page


def main_blocks(page: Page, template: frozenset[int] = frozenset()) -> list[str]:
    """Blocks of the main text: those of the longest article that are neither outside it nor template text.

    Without an article element, those of the main element; without that, those of the whole page.
    """
    rows = [(b, n, t) for (b, n), t in zip(page.blocks, page.block_tokens) if not n.outside and t not in template]
    sizes: dict[int, int] = {}
    for b, n, _ in rows:
        if n.article:
            sizes[n.article] = sizes.get(n.article, 0) + len(b)
    if sizes:
        best = max(sizes, key=lambda a: (sizes[a], -a))
        return [b for b, n, _ in rows if n.article == best]
    main = [b for b, n, _ in rows if n.main]
    return main or [b for b, _, _ in rows]


def applicable(page: Page, classes: list[list[int]]) -> frozenset[int]:
    """Tokens of the template's classes that hold on this page.

    A class holds if its tokens that occur here are in the template's order; then its span must lie within or beside the spans of the
    classes before it, so that the classes nest.
    """
    first: dict[int, int] = {}
    for i, t in enumerate(page.tokens):
        first.setdefault(t, i)
    spans: list[tuple[int, int]] = []
    out: set[int] = set()
    for tokens in classes:
        places = [first[t] for t in tokens if t in first]
        if len(places) < CLASS_SIZE or places != sorted(places):
            continue
        a, b = places[0], places[-1]
        if any(x < a <= y < b or a < x <= b < y for x, y in spans):
            continue
        spans.append((a, b))
        out.update(t for t in tokens if t in first)
    return frozenset(out)


def templates(pages: DataFrame) -> DataFrame:
    """``(host, classes)``: the token classes of each host's template.

    A token's occurrence vector says how often it occurs in each page of the host. Tokens with equal vectors form a class. The vector is
    represented by the sum, over pages, of the count times a random number of the page, so that classes come from two
    aggregations and no host's pages are gathered. Pages of a host with the same main text count once. A class is kept if its
    tokens are in ``SUPPORT`` of at least ``LEAST_PAGES`` pages and there are ``CLASS_SIZE`` of them: so many tokens, each in
    most pages, are no more than some page has, which bounds a host's template.
    """

    def start():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                page = parse(html)
                main = xxhash.xxh64_intdigest("\n".join(main_blocks(page))) >> 1
                counts: dict[int, list[int]] = {}
                for i, t in enumerate(page.tokens):
                    counts.setdefault(t, [0, i])[0] += 1
                out += [(host, main, t, n, i) for t, (n, i) in counts.items()]
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=["host", "main", "token", "n", "place"])

        return work

    rows = map_batches(pages.where("host <> ''").select("host", "html"), start, "host string, main long, token long, n long, place long")
    once = durable(rows.groupBy("host", "main", "token").agg(F.max("n").alias("n"), F.min("place").alias("place")))
    sizes = once.groupBy("host", "main").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("pages"))
    grain = F.lit(1 << 30)
    mixed = [F.sum(F.col("n") * F.pmod(F.xxhash64("main", F.lit(i)), grain)).alias(f"vector_{i}") for i in (0, 1)]
    vectors = once.groupBy("host", "token").agg(*mixed, F.count("*").alias("support"), F.avg("place").alias("place"))
    common = vectors.join(sizes.where(F.col("pages") >= LEAST_PAGES), "host").where(F.col("support") >= SUPPORT * F.col("pages"))
    classes = common.groupBy("host", "vector_0", "vector_1").agg(
        F.max("support").alias("support"), F.sort_array(F.collect_list(F.struct("place", "token"))).alias("tokens"))
    classes = classes.where(F.size("tokens") >= CLASS_SIZE)
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("support")).alias("s"), F.col("tokens.token").alias("tokens"))))
    return classes.groupBy("host").agg(F.transform(ordered, lambda c: c["tokens"]).alias("classes"))


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages``: the main text, its blocks joined by an empty line.

    A block is the text between starts and ends of block elements, with character references decoded and white space
    as single spaces. Left out are scripts, styles, menus, headers, footers, sidebars, forms, adverts, notices and reader
    comments, known by their elements, roles and class words, and blocks of the host's template (see ``templates``). Of
    several articles in a page the longest counts; an article's own header belongs to it. A null html is
    empty, a page without text has the empty text; pages without a host have no template. Repeated rows stay
    repeated; further columns are ignored.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    joined = rows.join(durable(templates(rows)), "host", "left").select("page_id", "url", "html", "classes")

    def start():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = []
            for html, classes in zip(batch.column("html").to_pylist(), batch.column("classes").to_pylist()):
                page = parse(html)
                texts.append("\n\n".join(main_blocks(page, applicable(page, classes) if classes else frozenset())))
            return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                               pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

        return work

    return map_batches(joined, start, "page_id long, url string, text string, n_chars long")
