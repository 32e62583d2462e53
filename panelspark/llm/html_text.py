"""Main text of web pages: site templates are found by counting hashed subtrees per host.

Every page is read into events (open, close, text) with the usual repairs: implied ends of p, li, rows and the like,
stray end tags, raw text elements. Each element's subtree gets a 64-bit hash of its tag, class, id, texts and children. Spark counts
on how many pages of its host a subtree occurs; those on at least ``min_pages`` pages and a ``share`` of the host's pages
are the site's template and are deleted, together with elements whose tag, role, class or id names them as menus,
headers, footers, sidebars, notices, adverts, forms or comments (never for a class or id an element that holds a main or
most of the text). Paragraphs, headings and list items inside an article
are the author's text even if they recur and are not counted. What is left of the article elements (else of main, else
of the body) is the text: blocks in page order, one per line.

Cases: null or empty html gives an empty text; broken or cut markup is read as far as it goes; a null or unparsable URL
belongs to the host of the empty name; copies of a page on a host count as one page; other columns pass through.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from panelspark.llm.common import folded, key_pair, saved, small, table, unfolded

# Element names and the words of class, id and role that mark boilerplate.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg math select option button object canvas video audio".split())
HEAD = set("title style script meta link base noscript template".split())
BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
            "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
PROSE = set("p h1 h2 h3 h4 h5 h6 li ul ol blockquote pre b i em strong a span br".split())
TEXT = set("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dt dd b i em strong a span".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
FENCE = set("article aside body div section main nav header footer table ul ol dl form blockquote".split())
DROP_TAGS = set("nav footer aside form dialog menu head fieldset".split()) | RAW
DROP_WORDS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs "
                 "footer sidebar cookie cookies consent gdpr notice notices popup modal newsletter subscribe signup login share sharing social "
                 "related recommended comment comments disqus respond reply replies".split())
DROP_ROLES = set("navigation contentinfo complementary search form dialog alert alertdialog menu menubar".split())
ROOTS = ("article", "main")

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*+>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*["']?true""", re.I)


@dataclass
class Page:
    events: list[tuple] = field(default_factory=list)  # ("open"/"close", node) and ("text", str)
    tags: list[str] = field(default_factory=list)
    drop: list[bool] = field(default_factory=list)
    named: list[bool] = field(default_factory=list)  # dropped by a word of class or id only
    within: list[bool] = field(default_factory=list)  # inside an article or main
    hashes: list[int] = field(default_factory=list)


def unwanted(tag: str, attributes: str, within: bool) -> tuple[bool, bool]:
    """Whether an element is dropped, and whether only by a word of its class or id."""
    if tag in DROP_TAGS or tag == "header" and not within:
        return True, False
    if not attributes or tag in ("html", "body", "main"):
        return False, False
    named = False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        words = set(re.split(r"[^a-z]+", value))
        if name.lower() == "role":
            if words & DROP_ROLES or "banner" in words and not within:
                return True, False
        elif tag == "article":
            named |= bool(words & {"comment", "comments", "reply", "ad", "promo", "related"})
        elif not (within and tag in TEXT):  # inside an article names decide about containers, not about its text
            named |= bool(words & DROP_WORDS) or "header" in words and not within
    hidden = bool(HIDDEN.search(attributes))
    return hidden or named, named and not hidden


def spare(page: Page) -> None:
    """Elements that hold a main or most of the text are not dropped for their name.

    Most of the text: of the articles and main if they have any, else of the page. Dropped elements, and articles named
    as comments or adverts where there are others, do not count.
    """
    def measured(soft: bool):
        hard = inside = every = core = mains = 0
        at, spans = {}, {}
        for kind, value in page.events:
            if kind == "text":
                n = 0 if hard else len("".join(value.split()))
                every, core = every + n, core + (n if inside else 0)
                continue
            step, tag = 1 if kind == "open" else -1, page.tags[value]
            if page.drop[value] and not (page.named[value] and (soft or tag != "article")):
                hard += step
            if tag in ROOTS:
                inside += step
                mains += tag == "main" and kind == "open" and not hard
            if page.named[value]:
                if kind == "open":
                    at[value] = every, core, mains
                else:
                    spans[value] = [x - y for x, y in zip((every, core, mains), at[value])]
        return every, core, spans

    every, core, spans = measured(False)
    if not core:
        every, core, spans = measured(True)
    for node, (of_every, of_core, mains) in spans.items():
        if mains or (2 * of_core > core if core else 2 * of_every > every):
            page.drop[node] = False


def read(source: str) -> Page:
    page = Page()
    stack: list[int] = []
    pieces: list[list] = []  # what the hash of each open element covers
    inside = 0

    def close(upto: int) -> None:
        nonlocal inside
        while len(stack) > upto:
            node = stack.pop()
            page.hashes[node] = xxhash.xxh64_intdigest("\x00".join(pieces.pop()))
            if pieces:
                pieces[-1].append(f"{page.hashes[node]:x}")
            if page.tags[node] in ROOTS:
                inside -= 1
            page.events.append(("close", node))

    def find(names, fence=frozenset()) -> int:
        for i in range(len(stack) - 1, -1, -1):
            tag = page.tags[stack[i]]
            if tag in names:
                return i
            if tag in fence:
                return -1
        return -1

    def text(part: str) -> None:
        if part:
            words = " ".join(part.split())
            page.events.append(("text", part))
            if words and pieces:
                pieces[-1].append(words)

    at = 0
    while at < len(source):
        m = TAG.search(source, at)
        if not m:
            text(source[at:])
            break
        text(source[at:m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, attributes = name.lower(), (m[3] or m[6] or "")
        if m[1] or m[4]:
            i = find({tag}, {"article", "main", "body"} - {tag} if tag not in BLOCK else frozenset())
            if i >= 0 and tag not in ("html", "body"):
                close(i)
            continue
        if stack and page.tags[stack[-1]] == "head" and tag not in HEAD:
            close(len(stack) - 1)
        if tag in BLOCK and (i := find({"p"}, FENCE)) >= 0:
            close(i)
        if tag in ENDS and (i := find(ENDS[tag], FENCE)) >= 0:
            close(i)
        node = len(page.tags)
        page.tags.append(tag)
        page.within.append(inside > 0)
        drop, named = unwanted(tag, attributes, inside > 0)
        page.drop.append(drop)
        page.named.append(named)
        page.hashes.append(0)
        page.events.append(("open", node))
        marks = " ".join(a or b or c for name, a, b, c in ATTRIBUTE.findall(attributes)) if attributes else ""
        stack.append(node)
        pieces.append([tag, marks])
        if tag in ROOTS:
            inside += 1
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            close(len(stack) - 1)
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
            text(source[at:end.start() if end else len(source)])
            at = end.end() if end else len(source)
            close(len(stack) - 1)
    close(0)
    if any(page.named):
        spare(page)
    return page


def candidates(page: Page) -> set[int]:
    """Hashes of the subtrees that may belong to a template, as signed numbers."""
    own = {h for h, tag, within in zip(page.hashes, page.tags, page.within)
           if tag not in ("html", "body", *ROOTS, *VOID) and not (within and tag in PROSE)}
    return {h - (1 << 64) if h >> 63 else h for h in own}


def main_text(page: Page, template: set[int]) -> str:
    def gone(node: int) -> bool:
        h = page.hashes[node]
        if page.drop[node]:
            return True
        if page.tags[node] in ("html", "body", *ROOTS) or page.within[node] and page.tags[node] in PROSE:
            return False
        return (h - (1 << 64) if h >> 63 else h) in template

    def blocks(root: str | None) -> tuple[list[str], bool]:
        out, now, skip, depth, seen = [], [], 0, 0, False
        for kind, value in page.events:
            if kind == "text":
                if not skip and (depth or root is None):
                    now.append(value)
                continue
            tag = page.tags[value]
            if skip:
                skip += 1 if kind == "open" else -1
                continue
            if kind == "open" and gone(value):
                skip = 1
            elif tag == root:
                depth += 1 if kind == "open" else -1
                seen = True
            if tag in BLOCK:
                out.append("".join(now))
                now = []
            elif tag == "br" and kind == "open":
                now.append(" ")
        out.append("".join(now))
        lines = (" ".join(entities.unescape(b).split()) for b in out)
        return [line for line in lines if line], seen
    for root in ROOTS:
        if root in page.tags:
            lines, seen = blocks(root)
            if seen:
                return "\n".join(lines)
    return "\n".join(blocks(None)[0])


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


@F.pandas_udf(T.ArrayType(T.LongType()))
def subtrees(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: np.array(sorted(candidates(read(p or ""))), np.int64))


@F.pandas_udf(T.StringType())
def extracted(pages: pd.Series, templates: pd.Series) -> pd.Series:
    return pd.Series([main_text(read(p or ""), set() if t is None else set(t.tolist())) for p, t in zip(pages, templates)], dtype=object)


def templates(pages: DataFrame, min_pages: int = 10, share: float = 0.6) -> DataFrame:
    """(host, template): the hashes of the subtrees that recur on the pages of a host; at most elements per page / share."""
    keyed = pages.select(host(F.col("url")).alias("host"), "html", *key_pair(F.coalesce("html", F.lit(""))))
    copies = saved(keyed.groupBy("host", "h1", "h2").agg(F.count("*").alias("n")), "page-keys")
    hosts = copies.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    # a page that stands once counts as a row; only of copies is the key carried along, to count it once
    repeated = copies.where("n > 1").select("host", "h1", "h2", F.struct("h1", "h2").alias("page"))
    each = keyed.join(small(repeated, 64), ["host", "h1", "h2"], "left").select("host", "page", F.explode(subtrees("html")).alias("subtree"))
    counts = each.groupBy("host", "subtree", "page").agg(F.count("*").alias("n"))
    counts = counts.groupBy("host", "subtree").agg(F.sum(F.when(F.col("page").isNull(), F.col("n")).otherwise(1)).alias("n"))
    counts = counts.where(F.col("n") >= min_pages)
    found = counts.join(hosts, "host").where(F.col("n") >= F.col("pages") * share)
    return found.groupBy("host").agg(F.collect_list("subtree").alias("template"))


def extract(pages: DataFrame, **options) -> DataFrame:
    """``pages`` (url, html, ...) with text. Further columns pass through whatever their names; one named text is replaced."""
    found = saved(templates(pages, **options), "templates").withColumnRenamed("host", "_host")
    size = 8 * (found.agg(F.sum(F.size("template"))).first()[0] or 0)
    rows = folded(pages, "url", "html").withColumn("_own", host(F.col("url")))
    rows = rows.join(small(found, 64 + size // max(found.count(), 1)), F.col("_own") == F.col("_host"), "left")
    return rows.select(*unfolded(pages, "url", "html", results=("text",)), extracted("html", "template").alias("text"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
