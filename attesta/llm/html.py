"""Main text of web pages by tag-path ratios.

A page becomes a sequence of blocks, each with its root-to-leaf tag path. Text length and punctuation are summed per
tag path and divided by the path's blocks; both ratios are smoothed along the page and fused by multiplication with a
prior, which is larger inside an article and small where a tag, role, class or id says that something else stands
there. Paths that reach the standard deviation of the fused ratio are content. The blocks of these paths, and the
blocks that stand in the same container or article and aren't marked as something else, are the text, in page order.
Only what is never text of an article (head, forms, scripts, hidden elements) is left out before that.

Pages are read one at a time inside a map, so nothing is shuffled. Time and memory are linear in the page: elements
and paths are numbers, tags are closed by stacks of open depths, and nothing walks up to the root.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template noframes noembed".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("head form button select option dialog svg canvas object audio video math datalist map".split())
ASIDE = frozenset("nav footer aside menu header".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
CONTENT = frozenset(("article", "main"))
LISTS = frozenset("ul ol dl blockquote table tbody tr figure".split())
#: Words of class and id that speak of something other than the article; words that say it is only spoken of; and what a layout of content may have at its side.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs header footer masthead "
    "sidebar side aside cookie cookies consent gdpr notice notices notification alert popup modal overlay comment comments commentlist disqus respond reply replies share sharing "
    "social related recommended newsletter subscribe subscription signup login search widget pager pagination toolbar skip".split()
)
SPOKEN, SIDES = frozenset("has no with without".split()), frozenset("sidebar side".split())
#: What a block's fused ratio is multiplied with inside an article, and where something else is marked.
INSIDE, MARKED = 8.0, 1 / 64

NEXT = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)", re.S)
UPTO = re.compile(r"[^>=]*")
VALUE = re.compile(r"=\s*([\"']?)")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？،؛؟।]")


def tag_end(page: str, at: int) -> int:
    """The position of a tag's closing bracket from inside the tag; -1 if the page ends before. Quotes count after an equals sign."""
    while True:
        at = UPTO.match(page, at).end()
        if at >= len(page):
            return -1
        if page[at] == ">":
            return at
        m = VALUE.match(page, at)
        at = m.end()
        if m[1]:
            at = page.find(m[1], at) + 1
            if not at:
                return -1


@dataclass
class Page:
    """Elements by number, parents first, and the blocks of text in order."""

    parent: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: ["#"])
    path: list[int] = field(default_factory=lambda: [0])
    marked: list[bool] = field(default_factory=lambda: [False])
    home: list[int] = field(default_factory=lambda: [0])  # the nearest article or main element, 0 if none
    blocks: list[tuple[int, str]] = field(default_factory=list)


def kind(tag: str, more: str) -> tuple[bool, bool, bool, bool]:
    """Of a start tag: whether it is never text, marked by its tag or role, marked by its class or id, and a content element."""
    never, aside, marked, content = tag in NEVER, tag in ASIDE, False, tag in CONTENT
    if more and tag not in ("html", "body"):
        given = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(more)}
        role = given.get("role", "").lower()
        content |= role in CONTENT
        aside |= role in ROLES
        for name in f"{given.get('class', '')} {given.get('id', '')}".split():
            words = {w.lower() for w in WORD.findall(name)}
            said = words & MARKS
            marked |= bool(said) and words.isdisjoint(SPOKEN) and not ("content" in words and said <= SIDES)
        bare = {w.lower() for w in ATTRIBUTE.sub(" ", more).split()}
        never |= "hidden" in bare or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "")
    return never, aside, marked, content


def parsed(page: str) -> Page:
    """Elements and blocks of a page. A tag that the page's end cuts off is dropped with what follows, as browsers do."""
    out = Page()
    paths: dict[tuple, int] = {}
    stack = [0]  # open elements
    never = [False]  # of each open element
    firm = [False]  # of each open element: marked by a tag or role, which an article inside doesn't take back
    depths: dict[str, list[int]] = {}  # of each tag, the depths at which it is open
    text: list[str] = []
    hidden: list[str] = []  # inline elements that are left out, with the inline elements in them
    block = 0

    def flush() -> None:
        if text:
            said = " ".join("".join(text).split())
            if said:
                out.blocks.append((block, said))
            text.clear()

    def close(depth: int) -> None:
        """Closes the elements from this depth on."""
        while len(stack) > depth:
            depths[out.tag[stack.pop()]].pop()
            never.pop()
            firm.pop()

    def last(tags: tuple[str, ...]) -> int:
        return max((depths[t][-1] for t in tags if depths.get(t)), default=0)

    def start(tag: str, more: str) -> None:
        up = stack[-1]
        gone, aside, marked, content = kind(tag, more)
        aside &= not (tag == "header" and out.home[up])  # the head of an article belongs to it
        own = aside or marked
        n = len(out.parent)
        firm.append(firm[-1] or aside)
        never.append(never[-1] or gone)
        out.parent.append(up)
        out.tag.append(tag)
        out.marked.append(own or (out.marked[up] and (firm[-1] or not content)))
        out.home.append(n if content and not own else out.home[up])
        out.path.append(paths.setdefault((out.path[up], tag, out.marked[n], bool(out.home[n])), len(paths) + 1))
        depths.setdefault(tag, []).append(len(stack))
        stack.append(n)

    at, end = 0, len(page)
    while at < end:
        m = NEXT.search(page, at)
        stop = m.start() if m else end
        if stop > at and not hidden and not never[-1]:
            text.append(entities.unescape(page[at:stop]))
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        close_at = tag_end(page, at)
        if close_at < 0:
            break
        more, at = page[at:close_at], close_at + 1
        if not m[1]:
            if tag in RAW:
                raw = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = raw.end() if raw else end
            elif tag == "br":
                text.append(" ")
            elif tag in VOID:
                if tag == "hr":
                    flush()
            elif tag in INLINE:
                if hidden or (more and any(kind(tag, more)[:3])):
                    hidden.append(tag)
            else:
                flush()
                hidden.clear()
                if out.tag[stack[-1]] == "p":
                    close(len(stack) - 1)
                if tag in CLOSES and (depth := last(CLOSES[tag])) > last(ENDS[tag]):
                    close(depth)
                if not more.rstrip().endswith("/") or tag in ("p", "div"):
                    start(tag, more)
                block = stack[-1]
        elif tag in INLINE:
            if tag in hidden:
                while hidden.pop() != tag:
                    pass
        elif tag == "br":
            text.append(" ")
        elif depths.get(tag):
            flush()
            hidden.clear()
            close(depths[tag][-1])
            block = stack[-1]
    flush()
    return out


def smoothed(values: np.ndarray) -> np.ndarray:
    """Values averaged with their neighbours by a Gaussian of radius 1."""
    if len(values) < 3:
        return values
    side = float(np.exp(-0.5))
    padded = np.pad(values, 1, mode="edge")
    return (padded[:-2] * side + padded[1:-1] + padded[2:] * side) / (1 + 2 * side)


def fused(path: np.ndarray, texts: list[str], prior: np.ndarray) -> np.ndarray:
    """The fused ratio of each block: its path's text length and punctuation a block, both smoothed along the page, and the prior."""
    _, of = np.unique(path, return_inverse=True)
    count = np.bincount(of)
    length = np.bincount(of, weights=[len(t) for t in texts]) / count
    marks = np.bincount(of, weights=[len(PUNCTUATION.findall(t)) for t in texts]) / count
    return smoothed(length[of]) * smoothed(1 + marks[of]) * prior


def chosen(path: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Whether each block's path is content: one of its blocks reaches the ratios' standard deviation, or the largest ratio if that is less."""
    return np.isin(path, path[ratio >= min(float(ratio.std()), float(ratio.max()))])


def main_text(html: str) -> str:
    """The text of a page's content blocks; empty if the page has none, as where all of it is marked as something else."""
    page = parsed(html)
    if not page.blocks:
        return ""
    of, texts = np.array([e for e, _ in page.blocks]), [t for _, t in page.blocks]
    parent, marked, home = np.array(page.parent), np.array(page.marked), np.array(page.home)
    path = np.array(page.path)[of]
    prior = np.where(marked[of], MARKED, np.where(home[of] > 0, INSIDE, 1.0))
    content = chosen(path, fused(path, texts, prior)) & ~marked[of]
    open_ = np.isin(np.array(page.tag), ("#", "html", "body"))
    holds, level = np.zeros(len(parent), bool), np.zeros(len(parent), bool)
    holds[home[of[content]]] = True
    holds[parent[of[content]]] = True
    level[parent[of[content]]] = True
    level &= open_  # of the whole page only blocks beside content count, and lists there
    holds &= ~open_
    inside = holds.tolist()
    for e, up in enumerate(page.parent):
        inside[e] = inside[e] or inside[up]
    near = np.array(inside)
    listed = np.isin(np.array(page.tag)[parent], tuple(LISTS)) & level[parent[parent]]
    kept = content | (~marked[of] & (near | level[parent] | listed)[of])
    return " ".join(t for t, k in zip(texts, kept.tolist(), strict=True) if k)


def extracted(html: Column) -> Column:
    """The main text of each page; null and empty pages have an empty text."""

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text).astype(object)

    return of(F.coalesce(html.cast("string"), F.lit("")))


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row; repeated rows each get their own result.

    Null and empty pages have an empty text. Pages are read whole, however long, deep or broken. Other columns of
    `pages` play no part, whatever their names.
    """
    return pages.select("page_id", "url", extracted(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
