"""Main text of web pages, by container paths that the pages of a host agree on.

Each page is read into containers and blocks of text.  A container's path is the chain of
tags, names and classes above it, numbers made general.  A page scores the containers that hold
most of its text outside links and outside parts that are not main text (menus, adverts,
comments and so on, known by tag, role, class or id), and votes for the deepest that holds nearly all of it, widened to its
article or to the containers above that have further text.  Spark adds up the votes of a host, and
every page is then extracted from the containers on the best path of its host that it has, unless
an article or main elsewhere on the page holds far more.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable
from dataclasses import dataclass, field as slot
from math import log1p

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweave.llm.base import field, slices
from netweave.session import materialize

# The HTML elements of each role.
CONTAINERS = frozenset("html body main article section div td center blockquote details figure".split())
NEVER = frozenset("head nav footer aside form button select menu dialog noscript iframe svg object canvas".split())
RAW = frozenset("script style template textarea title xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr th thead tbody tfoot caption pre address header fieldset "
    "figcaption summary hr br option".split())
#: Elements that a tag closes when it opens, and those that it does not reach across.
_SECTIONS = ("article", "section", "main", "aside", "nav", "blockquote", "form", "table", "td", "th", "caption")
_LIST = (("li",), ("ul", "ol", "menu", "dir", *_SECTIONS))
_TERM = (("dt", "dd"), ("dl", *_SECTIONS))
_CELL = (("td", "th"), ("tr", "table"))
_ROW = (("tr",), ("table", "thead", "tbody", "tfoot"))
_GROUP = (("thead", "tbody", "tfoot"), ("table",))
CLOSED_BY = {"li": _LIST, "dt": _TERM, "dd": _TERM, "td": _CELL, "th": _CELL, "tr": _ROW, "thead": _GROUP,
             "tbody": _GROUP, "tfoot": _GROUP, "option": (("option",), ("select", "datalist"))}
#: Tags that close an open paragraph, and elements that keep an outer one open.
ENDS_P = (BLOCKS | {"aside", "footer", "form", "menu", "nav", "dialog"}) - {
    "html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "br", "option"}
FENCE_P = ("td", "th", "caption", "button", "object")
#: Words of classes, ids and roles that mark parts outside the main text.
ASIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner promo promoted sponsor sponsored sidebar "
    "nav navbar navigation menu breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices "
    "alert popup modal newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations comment comments reply replies disqus pagination pager toolbar widget skip "
    "complementary contentinfo search".split())
#: First words of compound names that say what a part has or is, and last words that say in what state.
MODIFIERS = frozenset("has no with without is not show hide non".split())
STATES = frozenset("open opened closed enabled disabled allowed on off count".split())
#: Containers that pages are laid out in; the others are parts of a text.
LAYOUT = frozenset("html body main article section div".split())
#: A container votes if it holds at least this share of its page's text.
SHARE = 0.9
#: A host's path gives way to a page's own article or main that holds more text than this many times as much.
ARTICLE_TIMES = 2.0
#: Paths kept per host.
PATHS = 8
#: Containers nested deeper share the path of their ancestor at this depth.
DEPTH = 64

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+|[^>]*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_NUMBER = re.compile(r"\d+")
_ENDING = re.compile(r"[\d_-]+\Z")
_HUMP = re.compile(r"(?<=[a-z\d])(?=[A-Z])")
_JOINT = re.compile(r"[-_:]+")


@dataclass
class Page:
    """Containers as (parent, path) and text blocks as (container, text, characters in links)."""

    parents: list[int] = slot(default_factory=list)
    paths: list[str] = slot(default_factory=list)
    blocks: list[tuple[int, str, int]] = slot(default_factory=list)
    tags: list[str] = slot(default_factory=lambda: [""])


def _attributes(raw: str) -> dict[str, str]:
    if "=" not in raw:
        return {}
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)}


def _aside(values: Iterable[str]) -> bool:
    """Whether a class, id or role marks an aside: the whole name, or the first or last word of a compound.

    A number at a name's end does not matter.  A compound that begins with one of MODIFIERS or ends in
    one of STATES speaks of something else's aside.
    """
    for v in values:
        for name in v.split():
            words = [w for w in _JOINT.split(_HUMP.sub("-", _ENDING.sub("", name)).lower()) if w]
            if not words or len(words) > 1 and (words[0] in MODIFIERS or words[-1] in STATES):
                continue
            if words[0] in ASIDE or words[-1] in ASIDE or "".join(words) in ASIDE:
                return True
    return False


def read_page(source: str) -> Page:
    """Containers and blocks of a page, tolerant of unclosed, crossed and cut-off tags.

    Parts that only a class or id marks as aside are read as well.  They count as main text if they
    hold a main, or an article where none stands outside such parts, and all of them do if a page
    that was not cut off has no other text outside links.
    """
    page = Page([-1], [""])
    stack: list[tuple[str, int, int]] = [("", 0, 0)]  # tag, container, zone
    zones = [-1]  # zones marked by class or id, as the zone around each; 0 is the main text, -1 what is never read
    holding: dict[str, set[int]] = {"main": set(), "article": set()}  # zones with such an element
    read: list[tuple[int, tuple[int, str, int]]] = []  # zone and block
    places: dict[str, list[int]] = {}  # of every tag, where on the stack it is open
    special = [0]  # where elements are open that inline tags do not reach across
    depths = [0]
    pieces: list[str] = []
    linked, in_link, at, size = 0, False, 0, len(source)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = "".join(pieces)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                read.append((stack[-1][2], (stack[-1][1], text, min(linked, len(text)))))
            pieces.clear()
        linked = 0

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(depth: int) -> None:
        if stack[-1][1:] != stack[depth - 1][1:]:
            flush()
        while len(stack) > depth:
            places[stack.pop()[0]].pop()
        while special[-1] >= depth:
            special.pop()

    while at < size:
        m = _TAG.search(source, at)
        stop = m.start() if m else size
        if stop > at and stack[-1][2] >= 0:
            pieces.append(source[at:stop])
            linked += (stop - at) * in_link
        if not m:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if not m[1]:
            if tag in BLOCKS:
                flush()
            if tag in CLOSED_BY:
                tags, fence = CLOSED_BY[tag]
                depth = last(tags)
                if depth > last(fence):
                    close(depth)
            if tag in ENDS_P and places.get("p") and places["p"][-1] > last(FENCE_P):
                close(places["p"][-1])
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(source, at)
                at = end.end() if end else size
            elif tag == "a":
                in_link = True
            elif tag in VOID or m[3].endswith("/") and tag not in CONTAINERS:
                continue
            else:
                attributes = _attributes(m[3])
                here, zone = stack[-1][1:]
                if zone >= 0 and tag in holding:
                    holding[tag].add(zone)
                elif zone >= 0 and tag not in ("html", "body"):
                    # A header that stands in an article belongs to it; any other is the page's.
                    if (tag in NEVER or tag == "header" and not last(("article", "main"))
                            or _aside([attributes.get("role", "")])):
                        flush()
                        zone = -1
                    elif _aside(attributes.values()):
                        flush()
                        zones.append(zone)
                        zone = len(zones) - 1
                if tag in CONTAINERS and zone >= 0 and depths[here] < DEPTH:
                    classes = sorted(_NUMBER.sub("0", attributes.get("class", "").lower()).split())
                    name = "".join(f"#{x}" for x in _NUMBER.sub("0", attributes.get("id", "").lower()).split()[:1])
                    page.paths.append("/".join([page.paths[here], ".".join([tag + name, *classes])]))
                    page.parents.append(here)
                    page.tags.append(tag)
                    depths.append(depths[here] + 1)
                    here = len(page.parents) - 1
                places.setdefault(tag, []).append(len(stack))
                if tag in BLOCKS or tag in NEVER:
                    special.append(len(stack))
                stack.append((tag, here, zone))
        elif tag == "a":
            in_link = False
        else:
            if tag in BLOCKS:
                flush()
            depth = last((tag,))
            # An inline tag that ends across an open block leaves the block open, unless it is what hides the text.
            if depth and (depth >= special[-1] or stack[depth][2] != stack[depth - 1][2]):
                close(depth)
    flush()
    lifted = {0}
    for kept in holding.values():
        if lifted.isdisjoint(holding["main"] | holding["article"]) or kept is holding["main"]:
            for zone in kept:
                around = []
                while zone > 0:
                    around.append(zone)
                    zone = zones[zone]
                # An article in an aside part of another article is a comment or the like.
                if kept.isdisjoint(around[1:]):
                    lifted.update(around)
    page.blocks = [block for zone, block in read if zone in lifted]
    cut_off = any(tag in CONTAINERS or tag in NEVER for tag, _, _ in stack)
    if not cut_off and all(len(text) <= 2 * n for _, text, n in page.blocks) and any(len(text) > 2 * n for _, (_, text, n) in read):
        page.blocks = [block for _, block in read]
    return page


def held_text(page: Page, links: float = 2.0) -> list[float]:
    """Characters of text in every container and what it holds, those in links taken off ``links`` times."""
    held = [0.0] * len(page.parents)
    for container, text, linked in page.blocks:
        held[container] += max(0, len(text) - links * linked)
    for n in range(len(held) - 1, 0, -1):
        held[page.parents[n]] += held[n]
    return held


def widened(page: Page, containers: list[int]) -> set[int]:
    """The containers, each widened to the whole text that it is a part of.

    That is its outermost article or main.  Where it has none, it is the nearest container that a
    layout is made of; above that the highest that has text outside links of its own, or else the
    lowest inside the body with further text, as a title or lead in elements beside the body's.
    """
    direct = {n for n, text, linked in page.blocks if len(text) > 2 * linked}
    held = held_text(page)
    found = set()
    for n in containers:
        above = [n]
        while above[-1] > 0:
            above.append(page.parents[above[-1]])
        whole = [a for a in above if page.tags[a] in ("article", "main")]
        if not whole:
            at = next(i for i, a in enumerate(above) if a == 0 or page.tags[a] in LAYOUT)
            whole = [above[at], *(a for a in above[at:] if a in direct)]
            if whole[-1] == above[at]:
                inside = (a for a in above[at + 1:] if page.tags[a] in LAYOUT - {"html", "body"})
                whole += [a for a in inside if held[a] > held[above[at]]][:1]
        found.add(whole[-1])
    return found


def own_top(page: Page) -> tuple[int, float] | None:
    """The page's own choice, widened, and the text it was made by: the deepest path that holds nearly all of it."""
    held = held_text(page)
    if not held[0]:
        # An article may consist of links; other parts that do are menus.
        inside = [False] * len(held)
        for n in range(1, len(held)):
            inside[n] = page.tags[n] in ("article", "main") or inside[page.parents[n]]
        articles = Page(page.parents, page.paths, [b for b in page.blocks if inside[b[0]]], page.tags)
        held = held_text(articles, 0.0)
        if not held[0]:
            return None
    by_path: dict[str, float] = {}
    depth = {"": 0}
    for n in range(1, len(held)):
        depth[page.paths[n]] = depth[page.paths[page.parents[n]]] + 1
    for n, h in enumerate(held):
        by_path[page.paths[n]] = by_path.get(page.paths[n], 0.0) + h
    best = max((p for p, h in by_path.items() if h >= SHARE * held[0]), key=lambda p: (depth[p], p))
    return widened(page, [page.paths.index(best)]).pop(), held[0]


def votes(page: Page) -> list[tuple[str, float]]:
    """The page's vote: its own choice, weighted by how much text it has."""
    own = own_top(page)
    return [(page.paths[own[0]], log1p(own[1]))] if own else []


def main_text(page: Page, paths: list[str]) -> str:
    """The blocks in the containers, widened, on the first of ``paths`` that the page has text on, joined by spaces.

    Where those hold no article or main, but one stands elsewhere with more than ``ARTICLE_TIMES`` their
    text, it is the page's own choice that counts.
    """
    present = set(page.paths)
    held = held_text(page)
    own = own_top(page)
    articles = [n for n in range(len(page.paths)) if page.tags[n] in ("article", "main")]
    for path in [*paths, *([page.paths[own[0]]] if own else [])]:
        if path not in present:
            continue
        top = widened(page, [n for n, p in enumerate(page.paths) if p == path])
        inside = [False] * len(page.paths)
        for n in range(len(page.paths)):
            inside[n] = n in top or n > 0 and inside[page.parents[n]]
        text = " ".join(t for c, t, _ in page.blocks if inside[c])
        most = max((held[n] for n in articles if not inside[n]), default=0)
        if text and not (most > ARTICLE_TIMES * sum(held[n] for n in top) and not any(inside[n] for n in articles)):
            return text
    if own is None:
        return ""
    inside = [False] * len(page.paths)
    for n in range(len(page.paths)):
        inside[n] = n == own[0] or n > 0 and inside[page.parents[n]]
    return " ".join(t for c, t, _ in page.blocks if inside[c])


def host_of(url: Column) -> Column:
    """The host of an address, without user, port and a leading ``www.``; empty if there is none."""
    place = F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#\\]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(place, r"^.*@|:\d*$", ""), r"(?i)^www\.", ""))


def host_paths(pages: DataFrame, url: str = "url", html: str = "html", kept: int = PATHS) -> DataFrame:
    """(``host``, ``paths``): the ``kept`` paths of every host with most votes, best first."""
    rows = pages.select(host_of(field(pages, url)).alias("host"), F.coalesce(field(pages, html), F.lit("")).alias("_html"))

    def vote(batches):
        for batch in batches:
            for part in slices(batch):
                sums: dict[tuple[str, str], float] = {}
                for host, source in zip(part.column(0).to_pylist(), part.column(1)):
                    for path, weight in votes(read_page(source.as_py())):
                        sums[host, path] = sums.get((host, path), 0.0) + weight
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h for h, _ in sums], pa.string()), pa.array([p for _, p in sums], pa.string()),
                     pa.array(list(sums.values()), pa.float64())], names=["host", "path", "votes"])

    # Rounded sums do not depend on the order of additions.
    total = rows.mapInArrow(vote, "host string, path string, votes double").groupBy("host", "path").agg(
        F.sum(F.round("votes", 3).cast("decimal(20,3)")).alias("votes"))
    order = Window.partitionBy("host").orderBy(F.desc("votes"), F.desc("path"))
    ranked = total.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= kept)
    paths = F.transform(F.array_sort(F.collect_list(F.struct("_rank", "path"))), lambda s: s["path"])
    return ranked.groupBy("host").agg(paths.alias("paths"))


def extract_pages(pages: DataFrame, keep=("page_id", "url"), url: str = "url", html: str = "html",
                  kept: int = PATHS, broadcast_hosts: int = 100_000) -> DataFrame:
    """The kept columns, ``text`` (empty if a page has no main text) and ``n_chars`` (code points).

    A null page is empty; a null or odd address is a host of its own kind.  The paths of up to
    ``broadcast_hosts`` hosts travel to the pages, those of more hosts are joined.
    """
    keep = list(keep)
    best = materialize(host_paths(pages, url, html, kept), "host-paths")
    if best.count() <= broadcast_hosts:
        best = F.broadcast(best)
    columns = [field(pages, k).alias(f"_k{i}") for i, k in enumerate(keep)]
    rows = pages.select(*columns, host_of(field(pages, url)).alias("host"),
                        F.coalesce(field(pages, html), F.lit("")).alias("_html"))
    ready = rows.join(best, "host", "left").select(*[f"_k{i}" for i in range(len(keep))], "paths", "_html")

    def extract(batches):
        for batch in batches:
            for part in slices(batch):
                texts = [main_text(read_page(source.as_py()), paths or [])
                         for paths, source in zip(part.column(len(keep)).to_pylist(), part.column(len(keep) + 1))]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=[*[f"_k{i}" for i in range(len(keep))], "text", "n_chars"])

    fields = ", ".join(f"_k{i} {t}" for i, t in enumerate(dict(ready.dtypes)[f"_k{i}"] for i in range(len(keep))))
    done = ready.mapInArrow(extract, f"{fields}, text string, n_chars long")
    return done.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keep)], "text", "n_chars")
