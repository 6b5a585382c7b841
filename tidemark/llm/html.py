"""Main text of web pages by template deduction over the pages of a host.

Tokens of a page are its element paths (tags with their class words, marked where these name page furniture) and its text
blocks under their path. Over all pages of a host every token has an occurrence vector: how often each page has it.
Tokens with equal vectors form an equivalence class; Spark folds a hash of (page, count) over each token's pages, so
equal vectors have equal folds and no host is ever held in one task. A class is valid if it has support and size: so
many pages, whatever share of the host they are, and so many tokens. Each layout of a host so has its own classes.
Valid classes nest by path: a text is of the template if an element at or above it is of its class, so a text that
merely recurs (a by-line, an article that stands on several pages) is none. What the template leaves open are its slots.
Extraction goes down from the root through the template's elements as long as one of them holds most of the slots'
text, and takes the slots below. Items of a list or table are one slot as soon as one of them is open.
Elements and class words (article, sidebar) decide only what the classes leave open: among nested elements that all
hold most of the text, among the slots of the chosen element, and on hosts with too few pages for a template.

Pages with equal html count once in the vectors, so copies of an article do not turn it into a template.
"""
import hashlib
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.scratch import Scratch

# A valid class has so many pages and tokens at least; an element is gone into if it holds this share of the open text.
LEAST_PAGES, LEAST_TOKENS, MOST = 4, 2, 0.6
# Template rows up to this many bytes are sent to every executor; beyond, Spark joins them with the tokens of the pages.
BROADCAST_BYTES = 8 << 20
# HTML element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li".split())
ITEMS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}}
# What is not the article, by element, by class or id word, by role.
FURNITURE = frozenset("head nav footer aside form script style noscript template iframe button select textarea input svg dialog menu object canvas audio video".split())
OUTSIDE_ONLY = frozenset("header hgroup".split())
MARKS = frozenset("ad ads adv advert adverts advertisement advertisements adsense sponsor sponsored sponsors promo promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer cookie cookies consent gdpr notice notices notification alert popup popover modal overlay newsletter subscribe subscription signup social share sharing related recommended recommendations comment comments commentlist disqus reply replies respond discussion login search widget widgets toolbar pagination pager copyright disclaimer skip paywall teaser".split())
OUTSIDE_MARKS = frozenset("header masthead topbar hero site-header".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Element:
    __slots__ = ("tag", "path", "out", "main", "top", "parent", "furniture_word")

    def __init__(self, tag: str, attributes: str, parent: "Element | None"):
        given = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
        inside = parent is not None and parent.main > 0
        words = {w.lower() for name in ("class", "id") for w in _WORD.findall(given.get(name, ""))}
        role = given.get("role", "").lower()
        top = tag in ("html", "body", "main") or (tag == "article" and not words & {"comment", "reply", "comments"})
        marked = not top and (bool(words & MARKS) or role in ROLES or (not inside and bool(words & OUTSIDE_MARKS)))
        hidden = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "").lower()
        self.tag = tag
        # 2: in an article, 1: in the page's main part. A comment's article is furniture, and so is never chosen.
        here = 2 if tag == "article" or role == "article" or given.get("itemprop") == "articleBody" else 1 if tag == "main" or role == "main" else 0
        self.main = max(here, parent.main if parent else 0)
        # 2: furniture by element, role or invisibility, 1: by its class or id words only.
        level = 2 if tag in FURNITURE or (tag in OUTSIDE_ONLY and not inside) or hidden or role in ROLES else 1 if marked else 0
        self.out = max(level, parent.out if parent else 0)
        self.furniture_word = "!" if marked or hidden else ""
        # Siblings of one tag are told apart by their class words; a top element's often name the page, not its layout.
        named = "" if top else "".join("." + w.lower() for w in _WORD.findall(given.get("class", "")) if not w.isdigit())
        self.path = (parent.path + ">" if parent else "") + tag + named + self.furniture_word
        self.parent = parent
        # Path of the article or main element that this one lies in.
        self.top = (parent.top if parent else "") if self.main == (parent.main if parent else 0) else self.path


def text_blocks(html: str) -> Iterator[tuple[Element, str]]:
    """(innermost element, text) of every text block in page order."""
    stack = [Element("", "", None)]
    words: list[str] = []
    owner = stack[-1]

    def flush():
        text = " ".join("".join(words).split())
        words.clear()
        return text

    at, n = 0, len(html)
    while at < n:
        found = _TOKEN.search(html, at)
        begin = found.start() if found else n
        if begin > at:
            if not words:
                owner = _block_owner(stack)
            words.append(unescape(html[at:begin]))
        if not found:
            break
        at = found.end()
        if found[1] is not None:                       # a CDATA section is text
            words.append(found[1])
            continue
        if not found[3]:                               # a comment or a declaration
            continue
        tag = found[3].lower()
        if tag not in INLINE:
            text = flush()
            if text:
                yield owner, text
        if found[2]:
            if any(e.tag == tag for e in stack[1:]):
                while stack[-1].tag != tag:
                    stack.pop()
                stack.pop()
            continue
        if tag == "br":
            words.append(" ")
        if tag in VOID:
            continue
        if tag in CLOSES_P and any(e.tag == "p" for e in stack[1:]):
            while stack[-1].tag != "p":
                stack.pop()
            stack.pop()
        if tag in ITEMS:                               # a new item ends the one before in the same list
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in ITEMS[tag]:
                    break
                if stack[depth].tag == tag or (tag in ("dt", "dd") and stack[depth].tag in ("dt", "dd")) or (tag in ("td", "th") and stack[depth].tag in ("td", "th")):
                    del stack[depth:]
                    break
        element = Element(tag, found[4] or "", stack[-1])
        if found[4] and found[4].rstrip().endswith("/") and tag in ("svg", "path", "rect", "circle"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>?", re.I).search(html, at)
            at = end.end() if end else n
            continue
        stack.append(element)
    text = flush()
    if text:
        yield owner, text


def _block_owner(stack: list[Element]) -> Element:
    """The innermost element; inline ones are not part of a block's path, but furniture among them counts."""
    inner = stack[-1]
    if inner.tag not in INLINE:
        return inner
    depth = next(d for d in range(len(stack) - 1, -1, -1) if stack[d].tag not in INLINE)
    if inner.out == stack[depth].out:
        return stack[depth] if inner.main == stack[depth].main else inner
    return inner


def _short(text: str) -> str:
    return f"{hash_text(text) & (2**64 - 1):016x}"


def hash_text(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def text_token(owner: Element, text: str) -> str:
    return f"T{owner.path}|{_short(text)}"


def page_tokens(html: str) -> dict[str, list[int]]:
    """Token -> [occurrences, characters of text at or below it that is not furniture] of a page."""
    found: dict[str, list[int]] = {}
    seen: set[Element] = set()

    def add(token: str, size: int, times: int) -> None:
        line = found.setdefault(token, [0, 0])
        line[0] += times
        line[1] += size

    for owner, text in text_blocks(html):
        size = 0 if owner.out else len(text)
        add(text_token(owner, text), size, 1)
        element = owner
        while element is not None:
            add("E" + element.path, size, element not in seen)
            seen.add(element)
            element = element.parent
    return found


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 200):
            part = batch.slice(start, 200)
            seen: dict[tuple, None] = {}
            for host, page, html in zip(*(part.column(c).to_pylist() for c in ("host", "page", "html"))):
                if html:
                    for token, (count, size) in page_tokens(html).items():
                        seen[(host, page, token, count, size)] = None
            cols = list(zip(*seen)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()),
                                              pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int32())], names=["host", "page", "token", "times", "size"])


def page_rows(pages: DataFrame) -> DataFrame:
    """(host, page, token, times, size) of (host, page, html); page is a hash of the html, so equal pages are one."""
    return pages.select("host", "page", "html").mapInArrow(_tokens, "host string, page bigint, token string, times int, size int")


def _steps(path: str) -> Column:
    """The path and all paths above it."""
    return F.expr(f"transform(sequence(1, size(split({path}, '>'))), k -> array_join(slice(split({path}, '>'), 1, k), '>'))")


def templates(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, token, weight): the template's texts, and its elements that a page has once with their mean open text."""
    once = page_rows(pages).groupBy("host", "token", "page").agg(F.max("times").alias("times"), F.max("size").alias("size"))
    vectors = scratch.keep("vectors", once.groupBy("host", "token").agg(
        F.count("*").alias("n"), F.sum("size").alias("size"), F.max("times").alias("most"),
        F.bit_xor(F.xxhash64("page", "times")).alias("vector")).where(f"n >= {LEAST_PAGES}"))
    valid = vectors.join(classes_of(vectors), ["host", "vector", "n"], "left_semi")
    elements = valid.where("token like 'E%'").withColumn("path", F.expr("substring(token, 2)"))
    texts = valid.where("token like 'T%'").withColumn("path", F.expr("substring(token, 2, length(token) - 18)"))
    # A class nests by path: its texts lie in its elements.
    above = texts.select("host", "token", "vector", "n", "size", F.explode(_steps("path")).alias("path"))
    nested = above.join(elements.select("host", "vector", "n", "path"), ["host", "vector", "n", "path"], "left_semi").select("host", "token").distinct()
    fixed = above.join(nested, ["host", "token"], "left_semi").groupBy("host", "path").agg(F.sum("size").alias("fixed"))
    open_ = (F.col("size") - F.coalesce("fixed", F.lit(0))) / F.col("n")
    containers = elements.where("most = 1").join(fixed, ["host", "path"], "left").select("host", "token", open_.cast("double").alias("weight"))
    return scratch.keep("templates", containers.unionByName(nested.withColumn("weight", F.lit(0.0))))


def classes_of(vectors: DataFrame) -> DataFrame:
    """(host, vector, n): valid equivalence classes."""
    return vectors.groupBy("host", "vector", "n").agg(F.count("*").alias("size")).where(f"size >= {LEAST_TOKENS}").drop("size")


def _below(path: str, region: str) -> bool:
    return path == region or path.startswith(region + ">")


def region_of(values: list[tuple[Element, str]], template: dict[str, float]) -> str:
    """Path of the deepest element of the template, reached from the root, that holds most of the open text."""
    region = ""
    while True:
        sizes: dict[str, float] = {}
        deeper = set()
        for owner, text in values:
            if _below(owner.path, region):
                rest = owner.path[len(region) + 1:].split(">") if owner.path != region else []
                kid = f"{region}>{rest[0]}" if rest else ""
                sizes[kid] = sizes.get(kid, 0) + len(text)
                if len(rest) > 1:
                    deeper.add(kid)
        for kid in sizes:
            if kid:
                sizes[kid] = template.get("E" + kid, sizes[kid])
        best = max(sizes, key=lambda k: (sizes[k], k), default="")
        # An element whose open text stands in it directly is a slot itself.
        if best not in deeper or "E" + best not in template or sizes[best] < MOST * sum(sizes.values()) or not sizes[best]:
            return region
        region = best


def main_text(html: str, template: dict[str, float]) -> str:
    """Blocks of the article's slots, joined by blank lines."""
    blocks = list(text_blocks(html))
    is_open = [text_token(owner, text) not in template for owner, text in blocks]
    open_items = {(owner.parent.path, owner.tag) for (owner, _), o in zip(blocks, is_open) if o and owner.tag in ITEMS}
    chosen: list[tuple[Element, str]] = []
    # Class words also name layouts ("with-sidebar"), so they are set aside where they would leave nothing.
    for allowed in (0, 1):
        values = [(e, t) for (e, t), o in zip(blocks, is_open) if e.out <= allowed and (o or e.tag in ITEMS and (e.parent.path, e.tag) in open_items)]
        region = region_of(values, template)
        chosen = [(e, t) for e, t in values if _below(e.path, region)]
        best = max((e.main for e, _ in chosen), default=0)
        if best:
            tops = {e.top for e, _ in chosen if e.main == best}
            chosen = [(e, t) for e, t in values if e.main == best and e.top in tops]
        if chosen:
            break
    return "\n\n".join(t for _, t in chosen)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> (page_id, url, text): the article of every page, empty if it has none.

    A null html is an empty page; pages without a host in their url form one group. Character references are decoded,
    white space inside a block is one space, blocks are joined by two line feeds. Other columns are ignored and rows
    that repeat are extracted each.
    """
    scratch = Scratch(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    pages = pages.select("page_id", "url", "html", host.alias("host"), F.xxhash64("html").alias("page"))
    found = templates(pages, scratch)
    size = found.agg(F.sum(F.length("host") + F.length("token") + 64)).first()[0] or 0
    small = size <= BROADCAST_BYTES
    hosts: dict[str, dict[str, float]] = {}
    if small:
        for line in found.toArrow().to_pylist():
            hosts.setdefault(line["host"], {})[line["token"]] = line["weight"]
        given = pages
    else:
        # Of its host's template every page gets the tokens that it has.
        own = page_rows(pages).select("host", "page", "token").distinct().join(found, ["host", "token"])
        given = pages.join(own.groupBy("host", "page").agg(F.collect_list(F.struct("token", "weight")).alias("template")), ["host", "page"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                if small:
                    own = [hosts.get(h, {}) for h in part.column("host").to_pylist()]
                else:
                    own = [{line["token"]: line["weight"] for line in lines or ()} for lines in part.column("template").to_pylist()]
                out = [main_text(html or "", template) for html, template in zip(part.column("html").to_pylist(), own)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return given.mapInArrow(run, f"page_id {kind}, url string, text string")
