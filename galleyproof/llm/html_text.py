"""Main text of web pages by tag-path ratios.

A page is read once as a list of blocks (headings, paragraphs, list items, cells ...), each
with its tag path from the root and its text. For every path, the text length and the
punctuation of all its blocks give a ratio per block, lowered by the share of link text.
The length counts up to a bound, so that no long block raises the bar for the others.
Ratios are smoothed over neighbouring blocks and fused with those of the path; paths whose
mean reaches a share of the page's best are content, and so is all else within the article
or main element of such a path, or within its innermost container but for blocks that are
links only. A heading belongs to the content block after it. What pages mark as menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles or comments, by element or by class, id or role, never counts. An
element that only its class, id or role marks still counts if it holds an article or main
element or most of the text and no such element with text lies outside what is marked, or
if it holds both.

Null and empty pages, and pages without content, give empty text. Broken markup is read
as browsers do where that matters here: open elements are closed by their parents,
paragraphs and list items by the next one, and what is open at the end of the page is
complete, and a tag in which a quote is left open ends at the next bracket. Repeated rows give repeated results; extra columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from galleyproof.llm.common import text_chunks
from galleyproof.session import map_arrow

#: Blocks whose score is below this share of the page's best path are no content.
LEAST_SHARE = 0.08
#: Weights of a block's neighbours in smoothing, nearest first.
SMOOTH = (0.4, 0.2, 0.1)
#: Characters of a block beyond which its length says no more.
LONG_BLOCK = 300

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|math|object)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(?P<close_>/?)(?P<name_>[a-z][^\s/>]*)(?P<attrs_>[^>]*)(?:>|\Z)",  # a quote is left open
    re.I | re.S,
)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_ASKED = frozenset(["class", "id", "role", "hidden", "aria-hidden", "style"])
#: Words of a class or id that say what the element has or lacks beside it, not what it is.
BESIDE = frozenset("has with no without".split())

#: Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav footer aside form button select option dialog menu head canvas audio video datalist fieldset".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var img wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY_BLOCKS = frozenset(["p"])
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that hold the blocks of one part of a page.
CONTAINERS = frozenset("article main section div".split())
#: Never judged by class or id.
TRUSTED = frozenset("html body main article".split()) | HEADINGS
#: Words of classes, ids and roles that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead topbar comment comments commentlist reply replies respond disqus discussion cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe signup login share sharing social related recommended widget widgets toolbar pagination pager search searchbox form disclaimer copyright legal skip tags meta byline contentinfo complementary".split()
)


@dataclass
class Block:
    path: str
    text: str
    linked: int  #: characters within links
    heading: bool
    inside: tuple[int, ...]  #: the open elements that group blocks, outermost first, by number
    article: int  #: the number of the outermost article or main element that is open; 0: none


@dataclass
class _Open:
    name: str
    label: str
    dropped: bool
    number: int = 0
    marked: int = 0  #: the number of the marked element that alone drops this one


def _attributes(attrs: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTR.finditer(attrs) if attrs.strip() else ():
        if m[1].lower() in _ASKED:
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _dropped(name: str, found: dict[str, str], within_article: bool) -> bool:
    """By its element or because it is hidden."""
    if name in DROPPED or name == "header" and not within_article:
        return True
    return "hidden" in found or found.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I))


def _marked(found: dict[str, str]) -> bool:
    """By its class, id or role."""
    for token in " ".join(found.get(k, "") for k in ("class", "id", "role")).split():
        words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower())
        if not MARKS.isdisjoint(words) and BESIDE.isdisjoint(words):
            return True
    return False


@dataclass
class _Marked:
    """What lies in an element that its class, id or role marks."""

    chars: int = 0
    article: bool = False


def blocks(page: str) -> list[Block]:
    """The page's blocks outside what never counts, in order."""
    spared: set[int] = set()
    while True:
        out, marked = _read(page, spared)
        rest = sum(len(b.text) for b in out)
        total = rest + sum(m.chars for m in marked.values())
        outside = any(b.article for b in out)
        more = {k for k, m in marked.items() if m.chars and (m.article + (2 * m.chars > total) > outside)}
        if not more:
            return out
        spared |= more


def _read(page: str, spared: set[int]) -> tuple[list[Block], dict[int, _Marked]]:
    """The blocks, and what is marked by class, id or role, by the element's number, but for the elements ``spared``."""
    marked: dict[int, _Marked] = {}
    out: list[Block] = []
    stack = [_Open("", "", False)]
    pieces: list[str] = []
    linked = anchors = opened = 0

    def end_block() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                path = "/".join(e.label for e in stack if e.name not in INLINE)
                inside = tuple(e.number for e in stack if e.name in CONTAINERS)
                article = next((e.number for e in stack if e.name in ("article", "main")), 0)
                out.append(Block(path, text, min(linked, len(text)), any(e.name in HEADINGS for e in stack), inside, article))
            pieces.clear()
        linked = 0

    def close_to(k: int) -> None:
        nonlocal anchors
        if any(e.name not in INLINE for e in stack[k:]):
            end_block()
        anchors -= sum(e.name == "a" for e in stack[k:])
        del stack[k:]

    def text(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1].dropped:
            plain = unescape(raw)
            pieces.append(plain)
            linked += len(plain) if anchors else 0
        elif raw and stack[-1].marked:
            marked[stack[-1].marked].chars += len(" ".join(raw.split()))

    at = 0
    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name_"] or "").lower()
        if not name:
            continue
        if m["close"] or m["close_"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    close_to(k)
                    break
                if name in INLINE and stack[k].name not in INLINE:
                    break
            continue
        if name == "br" or name == "hr":
            if name == "hr":
                end_block()
            elif not stack[-1].dropped:
                pieces.append(" ")
            continue
        if name in VOID:
            continue
        if name not in INLINE:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in CLOSED_BY_BLOCKS or stack[k].name in SIBLINGS.get(name, ()):
                    close_to(k)
                    break
                if stack[k].name not in INLINE:
                    break
            end_block()
        parent = stack[-1]
        opened += 1
        if parent.dropped and not parent.marked:
            stack.append(_Open(name, name, True))
        else:
            found = _attributes(m["attrs"] or m["attrs_"] or "")
            hard = _dropped(name, found, any(e.name in ("article", "main") for e in stack))
            own = name not in TRUSTED and bool(found) and opened not in spared and _marked(found)
            group = found.get("class", "").split()
            label = name + ("." + group[0] if group else "")
            if parent.marked and name in ("article", "main") and not hard and not _marked(found):
                marked[parent.marked].article = True
            inside = 0 if hard else parent.marked or opened * own
            if inside == opened:
                marked[opened] = _Marked()
            stack.append(_Open(name, label, hard or bool(inside), opened, inside))
        anchors += name == "a"
    text(page[at:])
    close_to(1)
    end_block()
    return out, marked


def path_scores(found: list[Block]) -> list[float]:
    """The smoothed and fused tag-path ratio of each block."""
    totals: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0, 0.0, 0.0])
    for b in found:
        t = totals[b.path]
        t[0] += len(b.text)
        t[4] += min(len(b.text), LONG_BLOCK)
        t[1] += sum(b.text.count(c) for c in ".,;:!?")
        t[2] += b.linked
        t[3] += 1
    ratio = {p: (counted / n) * (0.5 + min(1.0, 20 * marks / max(chars, 1.0))) * (1 - links / max(chars, 1.0)) for p, (chars, marks, links, n, counted) in totals.items()}
    raw = [ratio[b.path] for b in found]
    smooth = []
    for i in range(len(raw)):
        total = weight = 0.0
        for d, w in enumerate(SMOOTH):
            for j in {i - d, i + d}:
                if 0 <= j < len(raw):
                    total, weight = total + w * raw[j], weight + w
        smooth.append(total / weight)
    return [0.7 * r + 0.3 * s for r, s in zip(raw, smooth, strict=True)]


def main_text(page: str) -> str:
    """The text of the content blocks, joined by two line feeds."""
    found = blocks(page)
    if not found:
        return ""
    by_path: dict[str, list[float]] = defaultdict(list)
    for b, s in zip(found, path_scores(found), strict=True):
        by_path[b.path].append(s)
    means = {p: sum(s) / len(s) for p, s in by_path.items()}
    least = LEAST_SHARE * max(means.values())
    content = [means[b.path] >= least and means[b.path] > 0 for b in found]
    articles = {b.article for b, c in zip(found, content, strict=True) if c and b.article}
    holders = {b.inside[-1] for b, c in zip(found, content, strict=True) if c and b.inside}
    for i, b in enumerate(found):  # what lies with content is content
        content[i] = content[i] or b.article in articles or not b.heading and b.linked < len(b.text) and not holders.isdisjoint(b.inside)
    for i in range(len(found) - 2, -1, -1):  # a heading goes with what it heads
        if found[i].heading and content[i + 1]:
            content[i] = True
    return "\n\n".join(b.text for b, c in zip(found, content, strict=True) if c)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, pages in text_chunks([batch], "row", "html"):
            texts = [main_text(p.decode("utf-8", "replace")) for p in pages]
            rows = batch.slice(chunk[0].as_py(), len(pages))
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), rows.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages`` (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered = (b.append_column("row", pa.array(range(b.num_rows))) for b in batches)
        yield from _extract(numbered)

    return map_arrow(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")
