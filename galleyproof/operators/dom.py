"""HTML trees as rows, and the rules that read them."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleyproof.operators.tags import VOID
from galleyproof.session import map_arrow

#: Elements whose text is not shown, and blocks that may hold text.
UNSEEN = ("script", "style", "head", "title", "meta", "link", "noscript", "template")
BLOCKS = ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "figcaption", "caption", "blockquote", "dt", "dd")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
MOJIBAKE = r"Ã.|â€™|â€œ|â€\x{9d}|\x{fffd}"
PLACEHOLDER = r"(?i)(lorem ipsum|\btbd\b|\btodo\b|insert (?:text|image|video) here|\[placeholder\]|\bxxx\b|<<[^>]*>>)"

_NODES = "page_id long, node_id int, parent_id int, kind string, tag string, attrs map<string,string>, text string, line int, markup string, path array<struct<tag:string,style:string,hidden:boolean,node_id:int>>"

#: Characters of an element's markup that issues quote.
SNIPPET = 350


class _Tree(HTMLParser):
    """Collects nodes; an end tag closes up to the nearest open element of its name."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.html = html
        self.starts = [0]
        while at := html.find("\n", self.starts[-1]) + 1:
            self.starts.append(at)
        self.nodes: list[dict] = []
        self.open: list[tuple[int, str, dict]] = []
        self.feed(html)
        self.close()
        self._close_from(0, len(html), len(html))

    def _here(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def _close_from(self, k: int, inner: int, outer: int) -> None:
        """Close the elements from the k-th open one; ``outer`` is the end of that one, ``inner`` of those within."""
        for depth, (node, *_) in enumerate(self.open[k:]):
            begin = self.nodes[node].pop("begin")
            self.nodes[node]["markup"] = self.html[begin : min(outer if depth == 0 else inner, begin + SNIPPET)]
        del self.open[k:]

    def _add(self, kind: str, tag: str | None, attrs: dict, text: str | None) -> int:
        parent = self.open[-1][0] if self.open else None
        self.nodes.append({"node_id": len(self.nodes), "parent_id": parent, "kind": kind, "tag": tag, "attrs": list(attrs.items()), "text": text, "line": self.getpos()[0], "path": [p for *_, p in self.open]})
        return len(self.nodes) - 1

    def handle_starttag(self, tag, attrs):
        found = {k: v or "" for k, v in attrs}
        node = self._add("element", tag, found, None)
        if tag in VOID:
            self.nodes[node]["markup"] = self.get_starttag_text()[:SNIPPET]
            return
        self.nodes[node]["begin"] = self._here()
        self.open.append((node, tag, {"tag": tag, "style": found.get("style", ""), "hidden": found.get("aria-hidden") == "true", "node_id": node}))

    def handle_startendtag(self, tag, attrs):
        node = self._add("element", tag, {k: v or "" for k, v in attrs}, None)
        self.nodes[node]["markup"] = self.get_starttag_text()[:SNIPPET]

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][1] == tag:
                here = self._here()
                self._close_from(k, here, (self.html.find(">", here) + 1) or len(self.html))
                return

    def handle_data(self, data):
        self._add("text", None, {}, data)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    step = pa.struct([("tag", pa.string()), ("style", pa.string()), ("hidden", pa.bool_()), ("node_id", pa.int32())])
    schema = pa.schema([("page_id", pa.int64()), ("node_id", pa.int32()), ("parent_id", pa.int32()), ("kind", pa.string()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("line", pa.int32()), ("markup", pa.string()), ("path", pa.list_(step))])
    for batch in batches:
        for key, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_pylist([{"page_id": key, **n} for n in _Tree(html or "").nodes], schema)


def nodes(pages: DataFrame) -> DataFrame:
    """Elements and texts of ``pages`` (page_id, html) in document order, each with its open ancestors."""
    return map_arrow(pages.select("page_id", "html"), _parse, _NODES)


def visible(path: str = "path") -> Column:
    """Text that is shown: no ancestor is unseen, hidden, or styled away."""
    return F.expr(f"text rlike r'(?U)\\S' and not exists({path}, p -> p.tag in ({', '.join(repr(t) for t in UNSEEN)}) or p.hidden or lower(replace(p.style, ' ', '')) rlike 'display:none|visibility:hidden')")


def bold() -> Column:
    return F.expr("exists(path, p -> p.tag in ('strong', 'b', 'h1', 'h2', 'h3', 'h4', 'h5', 'h6') or lower(replace(p.style, ' ', '')) rlike 'font-weight:(bold|700|800|900)')")


def italic() -> Column:
    return F.expr("exists(path, p -> p.tag in ('em', 'i') or lower(replace(p.style, ' ', '')) rlike 'font-style:italic')")


def heading_level() -> Column:
    return F.expr("coalesce(int(substring(try_element_at(filter(path, p -> p.tag rlike '^h[1-6]$'), -1).tag, 2, 1)), 0)")


def in_allowed_block() -> Column:
    return F.expr(f"exists(path, p -> p.tag in ({', '.join(repr(t) for t in BLOCKS)}))")


def visible_text(tree: DataFrame) -> DataFrame:
    """Shown texts with the flags that alignment compares."""
    return tree.where("kind = 'text'").where(visible()).select("page_id", "node_id", "line", "text", bold().alias("bold"), italic().alias("italic"), heading_level().alias("heading_level"), in_allowed_block().alias("in_allowed_block"), F.try_element_at("path", F.lit(-1))["tag"].alias("parent_tag"))


def _issue(rows: DataFrame, category: str, actual: Column) -> DataFrame:
    return rows.select("page_id", "line", F.lit(category).alias("category"), F.lit("error").alias("engine_severity"), actual.alias("actual"))


def garbled(shown: DataFrame) -> DataFrame:
    return _issue(shown.where(F.col("text").rlike(MOJIBAKE)), "Garbled / Encoding Error", F.substring(F.trim("text"), 1, 80))


def placeholders(shown: DataFrame) -> DataFrame:
    return _issue(shown.where(F.col("text").rlike(PLACEHOLDER)), "Leftover Placeholder", F.regexp_extract("text", PLACEHOLDER, 1))


def _local_links(tree: DataFrame) -> DataFrame:
    links = tree.where("tag = 'a'").select("page_id", "line", F.col("attrs")["href"].alias("href"))
    return links.where(F.col("href").isNotNull() & (F.col("href") != "") & ~F.col("href").rlike("^(https?://|http:|https:|mailto:|#|javascript:)"))


def broken_links(tree: DataFrame, existing: DataFrame) -> DataFrame:
    """Local link targets that are not among ``existing`` (path)."""
    local = _local_links(tree)
    return _issue(local.join(existing.select(F.col("path").alias("href")), "href", "left_anti"), "Broken Link", F.col("href"))


def broken_links_of(tree: DataFrame, existing: DataFrame) -> DataFrame:
    """The same with a listing (page_id, path) of each page's own, from the page's folder."""
    local = _local_links(tree).withColumn("path", F.regexp_replace("href", r"(^|/)(?:\./)+", "$1"))
    return _issue(local.join(existing, ["page_id", "path"], "left_anti"), "Broken Link", F.col("href"))


def first_text(tree: DataFrame, tag: str) -> DataFrame:
    """(page_id, text) within the first element ``tag`` of each page."""
    within = tree.where("kind = 'text'").where(F.expr(f"exists(path, p -> p.tag = '{tag}')"))
    return within.groupBy("page_id").agg(F.min_by("text", "node_id").alias("text"))


def elements(tree: DataFrame, *tags: str) -> DataFrame:
    """Elements of these names with their whole ``text``: stripped texts within, joined by spaces; empty if there is none.

    Texts go to the elements around them by the path they carry, so the only shuffle is by page and element.
    """
    names = ", ".join(repr(t) for t in tags)
    around = F.expr(f"filter(path, p -> p.tag in ({names}))")
    own = tree.where("kind = 'element'").where(F.col("tag").isin(*tags))
    bare = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    within = tree.where("kind = 'text'").where(bare != "").select("page_id", F.explode(around).alias("p"), F.struct("node_id", bare.alias("t")).alias("piece"))
    texts = within.groupBy("page_id", F.col("p.node_id").alias("node_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("piece")), lambda x: x["t"]), " ").alias("text"))
    return own.drop("text").join(texts, ["page_id", "node_id"], "left").withColumn("text", F.coalesce("text", F.lit("")))
