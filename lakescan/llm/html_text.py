"""Operator 4, HTML extraction by consensus host paths.

1. *Score.* Each page's containers (elements that hold blocks of text) are scored: characters in their own paragraphs,
   headings and other blocks, less what stands in links, and nothing for what lies in parts that are never content
   (navigation, headers, footers, asides, forms, scripts, pictures, and containers and lists of which a whole class, id or
   role names adverts, comments, notices, menus and the like).
2. *Vote.* A container's path, the tags and classes from the root down with digits generalised, gets its page's vote,
   the fourth power of its score as a share of the page's best one, so that winning counts most. Spark averages the votes for each host and path over the host's pages
   that have the path, slightly less for few pages, so that a template of some pages is not outvoted by the outer
   containers that all pages have.
3. *Re-extract.* Each page's paths meet their averages, the best one goes back to the page (a page's own best path stands
   in where none has votes), and the text of the containers on that path is taken, again without what is never content.
   All paths of a host take part; page and path rows are narrow, and a page's HTML meets one row.

Inside a block, character references are decoded and white space becomes single blanks; blocks are joined by line ends
in page order. Nothing else is dropped or cut, and the whole page is read.

Defined results: null and empty pages, and pages without text blocks, give the empty text; pages without a host vote for
the host ""; unclosed elements end where their parents do, paragraphs where a block begins, and pictures and formulas where HTML goes on;
formulas give their text without its annotations; repeated rows get equal
texts; an empty table gives an empty table; further columns do not matter.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, text_keys

#: A quote opens a value only after an equals sign; one that is never closed is a character.
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Elements without content, elements whose content is no text, and elements that are never an article's.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe textarea title".split())
SPACED = frozenset("iframe object canvas audio video textarea".split())
NEVER = frozenset("nav header footer aside form head button select menu dialog noscript template object svg canvas audio video annotation annotation-xml".split())
#: Foreign elements, the elements in them that hold HTML, and elements besides blocks that end them.
FOREIGN = frozenset(("svg", "math"))
HOLDS_HTML = frozenset("foreignobject desc title mtext mi mo mn ms annotation-xml".split())
ENDS_FOREIGN = frozenset("b big br code em embed i img s small span strike strong sub sup tt u var".split())
#: Whole classes, ids and roles, without a number at the end, that name what is not an article.
NOT_CONTENT = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices overlay pagination popup promo related replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget contentinfo complementary search alert dialog".split()
    + "ad-banner ad-box ad-container ad-slot ad-unit ad-wrapper advert-box comment-list comments-list comments-area comment-area comments-section comment-section comment-form comment-respond cookie-banner cookie-bar cookie-consent cookie-notice gdpr-banner main-menu main-nav main-navigation nav-bar nav-links nav-menu navigation-menu newsletter-signup page-footer page-header post-navigation related-articles related-links related-posts related-stories search-box search-form share-bar share-buttons share-links side-bar sidebar-left sidebar-right site-footer site-header site-nav site-navigation skip-links social-links social-media social-share sponsored-content sponsored-links sub-nav tool-bar top-bar top-nav widget-area".split()
)
#: Elements that begin a block of text, and those that a paragraph cannot hold.
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article body div main section td blockquote html center".split())
NAMED = frozenset("div section td blockquote center ul ol dl table details figure".split())
SPACE = re.compile(r"\s+")
NUMBER = re.compile(r"[-_]*\d+$")
DIGITS = re.compile(r"\d+")
#: Elements that end an open element of the same kind, as their end tags may be left out.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "thead", "tbody", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


class Open(NamedTuple):
    """An open element: its path's hash, the nearest container's, whether its text is content, whether it is in a link, the place of what makes it foreign."""

    tag: str
    path: int
    box: int | None
    content: bool
    link: bool
    foreign: int | None


FORM = re.compile(r"<(/?)form\b", re.I)


def wide_form(page: str) -> int | None:
    """The number of the form that stands around more than half of a page, if there is one."""
    begun, n = None, -1
    for m in FORM.finditer(page):
        if not m[1]:
            n += 1
            begun = m.start() if begun is None else begun
        elif begun is not None:
            if 2 * (m.start() - begun) > len(page):
                return n
            begun = None
    return n if begun is not None and 2 * (len(page) - begun) > len(page) else None


def blocks(page: str | None, above: dict[int, tuple[int | None, bool]] | None = None) -> Iterator[tuple[int, str, int]]:
    """(container, text, characters in links) of each block of content, in page order.

    A form is no content, unless most of a page's text stands in it, as where servers wrap whole pages in one.
    """
    around = wide_form(page or "")
    if around is None:
        yield from _walk(page, above)
        return
    inside, outside = {}, {}
    with_form, without = list(_walk(page, inside, around)), list(_walk(page, outside))
    size = lambda found: sum(len(text) for _, text, _ in found)
    wide = size(with_form) > 2 * size(without)
    if above is not None:
        above.update(inside if wide else outside)
    yield from with_form if wide else without


def _walk(page: str | None, above: dict[int, tuple[int | None, bool]] | None = None, form: int = -1) -> Iterator[tuple[int, str, int]]:
    """The blocks by one pass, linear in the page; the form of number ``form`` is content like others.

    A container is named by the hash of its path; ``above`` gets the container around it, and whether it is an article.
    Containers come into ``above`` after those around them.
    """
    forms = 0
    stack: list[Open] = []
    count: Counter = Counter()  # of open elements by tag
    text: list[str] = []
    linked = 0
    at, page = 0, page or ""
    above = {} if above is None else above

    def flush() -> tuple[int, str, int] | None:
        nonlocal linked
        if not text:
            return None
        whole = SPACE.sub(" ", "".join(text)).strip(" ")
        text.clear()
        links, linked = linked, 0
        if not whole:
            return None
        box = stack[-1].box if stack else None
        if box is None:
            box = above.setdefault(0, (None, False)) and 0
        return box, whole, min(links, len(whole))

    def close(k: int) -> None:
        count.subtract([x.tag for x in stack[k:]])
        del stack[k:]

    def put(raw: str) -> None:
        nonlocal linked
        if raw and (not stack or stack[-1].content):
            piece = entities.unescape(raw)
            text.append(piece)
            if stack and stack[-1].link:
                linked += len(piece.strip())

    while m := TOKEN.search(page, at):  # from where the last one ended: what raw elements hold is no markup
        put(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if page.startswith("<![CDATA[", m.start()):
                put(page[m.start() + 9 : m.end()].removesuffix("]]>"))
            continue
        if m[1]:
            if not count[tag]:
                if tag == "p" and (b := flush()) is not None:
                    yield b
                continue
            k = len(stack) - 1
            block = False
            while stack[k].tag != tag:
                block = block or stack[k].tag in BLOCK
                k -= 1
            if block and tag not in BLOCK:
                continue
            if (block or tag in BLOCK) and (b := flush()) is not None:
                yield b
            close(k)
            continue
        foreign = stack[-1].foreign if stack else None
        if foreign is not None and (tag in BLOCK or tag in ENDS_FOREIGN):
            close(foreign)
            foreign = None
        if tag == "br":
            if not stack or stack[-1].content:
                text.append(" ")
            continue
        if tag in BLOCK:
            if (b := flush()) is not None:
                yield b
            # A block ends an open paragraph, and an item the item before it.
            ends = {"p"} | SIBLINGS.get(tag, set())
            if any(count[x] for x in ends):
                stop = STOPS.get(tag, set())
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag in stop or (stack[i].tag in CONTAINER and stack[i].tag not in ends):
                        break
                    if stack[i].tag in ends:
                        close(i)
                        break
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        outer = stack[-1] if stack else None
        good = outer is None or outer.content
        if tag in SPACED and good:
            text.append(" ")
        if tag in RAW and foreign is None:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        names: list[str] = []
        hidden = False
        step = tag
        if m[3] and not m[3].isspace():
            for a in ATTRIBUTE.finditer(m[3]):
                key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if key in ("class", "id", "role"):
                    names += [NUMBER.sub("", x).replace("_", "-") for x in value.lower().split()]
                    if key == "class":
                        step = tag + "." + ".".join(sorted(DIGITS.sub("#", value.lower()).split()))
                elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value.lower()):
                    hidden = True
        never = tag in NEVER and not (tag == "form" and forms == form)
        forms += tag == "form"
        good = good and not never and not hidden and (tag not in NAMED or not NOT_CONTENT.intersection(names))
        path = xxhash.xxh3_64_intdigest(step.encode(), outer.path if outer else 1)
        box = outer.box if outer else None
        if tag in CONTAINER:
            above.setdefault(path, (box, tag in ("article", "main")))
            box = path
        # what HTML stands in is foreign until an element in it holds HTML again
        foreign = None if tag in HOLDS_HTML else len(stack) if foreign is None and tag in FOREIGN else foreign
        stack.append(Open(tag, path, box, good, tag == "a" or bool(outer and outer.link), foreign))
        count[tag] += 1
    put(page[at:])
    if (b := flush()) is not None:
        yield b


def scores(page: str | None, found: list | None = None, above: dict | None = None) -> dict[int, float]:
    """Each container path's score as a share of the page's best: characters outside links, an outer container getting less."""
    above = {} if above is None else above
    gain: dict[int, float] = {}
    for box, text, links in found if found is not None else blocks(page, above):
        gain[box] = gain.get(box, 0.0) + len(text) - 2 * links
    for box in reversed(list(above)):  # inner ones first; each level further out counts for less
        outer = above[box][0]
        if box in gain and outer is not None:
            gain[outer] = gain.get(outer, 0.0) + 0.9 * gain[box]
    # a named article is preferred to what surrounds it
    gain = {box: x * (1.5 if above[box][1] else 1.0) for box, x in gain.items()}
    best = max(gain.values(), default=0.0)
    return {box: max(x, 0.0) / best if best > 0 else 0.0 for box, x in gain.items()}


def extract(page: str | None, best: int | None) -> str:
    """The blocks under the path ``best``, or under the page's own best path."""
    above: dict = {}
    found = list(blocks(page, above))
    if best is None:
        own = {p: x for p, x in scores(page, found, above).items() if x > 0}
        if not own:
            return "\n".join(text for _, text, _ in found)
        best = min(own, key=lambda p: (-own[p], p))
    inside: dict[int | None, bool] = {None: False}
    for box, (outer, _) in above.items():
        inside[box] = box == best or inside[outer]
    return "\n".join(text for box, text, _ in found if inside[box])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, path, vote) for each container path of each page."""
    names = ["host", "text_a", "text_b"]
    for batch in batches:
        row, paths, votes = [], [], []
        for i, page in enumerate(batch.column("html").to_pylist()):
            for path, vote in scores(page).items():
                row.append(i)
                paths.append(path)
                votes.append(vote**4)
        own = batch.select(names).take(pa.array(row, pa.int64()))
        yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.array(paths, np.uint64).view(np.int64)), pa.array(votes, pa.float64())], names=[*names, "path", "vote"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = [None if p is None else p % (1 << 64) for p in batch.column("path").to_pylist()]
        texts = [extract(page, path) for page, path in zip(batch.column("html").to_pylist(), paths, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def url_host(url: Column) -> Column:
    """The host of a URL without a leading ``www.``; "" where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), r"^www\.", "")


def page_paths(pages: DataFrame) -> DataFrame:
    """(host, text_a, text_b, path): the path on which a host takes the text of a page; one row for each host and text of a page."""
    d = pages.where("html IS NOT NULL").select(url_host(F.col("url")).alias("host"), *text_keys(F.col("html")), "html")
    own = checkpoint(d.mapInArrow(_votes, "host string, text_a long, text_b long, path long, vote double"))
    votes = own.groupBy("host", "path").agg(F.sum(F.round("vote", 9).cast("decimal(28,9)")).cast("double").alias("votes"), F.count("*").alias("n"))
    # A path met on one page only must beat its page's other paths clearly. Votes and winners are written before they are
    # joined, so that both sides are shuffled for the join and adaptive execution can split a hot host's paths.
    votes = checkpoint(votes.where("votes > 0").select(F.col("host").alias("_host"), F.col("path").alias("_path"), (F.col("votes") / (F.col("n") + 0.2)).alias("worth")))
    met = own.join(votes, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")))
    return checkpoint(met.groupBy("host", "text_a", "text_b").agg(F.min(F.struct((-F.col("worth")).alias("worth"), "path"))["path"].alias("path")))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    best = page_paths(pages).select(F.col("host").alias("_host"), F.col("text_a").alias("_a"), F.col("text_b").alias("_b"), "path")
    d = pages.withColumn("host", url_host(F.col("url"))).select("*", *text_keys(F.col("html")))
    d = d.join(best, (F.col("host") == F.col("_host")) & (F.col("text_a") == F.col("_a")) & (F.col("text_b") == F.col("_b")), "left").select("page_id", "url", "html", "path")
    d = d.mapInArrow(_texts, "page_id long, url string, text string")
    return d.withColumn("n_chars", F.length("text").cast("long"))


def query(pages: DataFrame) -> DataFrame:
    return extract_pages(pages)
