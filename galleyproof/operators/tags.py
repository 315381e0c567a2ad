"""Checks of the raw tag structure of HTML."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galleyproof.session import map_arrow

#: Elements without an end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
# possessive: the regex engine recurses for each turn of a group that it may have to undo
_TAG = r"<(/?[A-Za-z][^\s/>]*)(?>[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"


def without_raw_text(html: Column) -> Column:
    """HTML without comments and the bodies of scripts and styles, whose brackets are no tags."""
    plain = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", "")
    return F.regexp_replace(plain, r"(?is)(<(script|style)\b[^>]*>).*?(</\2\s*>)", "$1$3")


def tag_events(html: Column) -> Column:
    """Tags in order: lower-case names, end tags with a slash before; void and self-closing ones left out."""
    whole = F.regexp_extract_all(without_raw_text(html), F.lit(_TAG), F.lit(0))
    kept = F.filter(whole, lambda t: ~t.rlike(r"/\s*>$") | t.startswith("</"))
    names = F.transform(kept, lambda t: F.lower(F.regexp_extract(t, r"^<(/?[A-Za-z][^\s/>]*)", 1)))
    return F.filter(names, lambda n: ~F.regexp_replace(n, "^/", "").isin(*VOID))


class _Stack:
    """Open elements, newest last. Each tag is pushed and taken off once, so a page costs time in proportion to its tags."""

    def __init__(self) -> None:
        self.open: list[tuple[str, int | None]] = []
        self.count: Counter[str] = Counter()
        self.found: list[tuple[int | None, str, str, str, str]] = []  #: line, category, tag, expected, actual

    def start(self, tag: str, line: int | None = None) -> None:
        self.open.append((tag, line))
        self.count[tag] += 1

    def end(self, tag: str, line: int | None = None) -> None:
        if not self.count[tag]:
            wanted = f"</{self.open[-1][0]}>" if self.open else f"<{tag}> before </{tag}>"
            self.found.append((line, "Unexpected Closing Tag", tag, wanted, f"</{tag}>"))
            return
        while True:
            last, _ = self.open.pop()
            self.count[last] -= 1
            if last == tag:
                return
            self.found.append((line, "Tag Nesting Mismatch", last, f"</{last}> before </{tag}>", f"</{tag}>"))

    def finish(self) -> list[tuple[int | None, str, str, str, str]]:
        return self.found + [(line, "Unclosed Tag", tag, f"</{tag}>", "missing closing tag") for tag, line in reversed(self.open)]


class _Tags(HTMLParser):
    """Feeds a stack with the tags of a page and their lines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.stack = _Stack()

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            self.stack.start(tag, self.getpos()[0])

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        if tag not in VOID:
            self.stack.end(tag, self.getpos()[0])


def page_tag_issues(html: str) -> list[tuple[int | None, str, str, str, str]]:
    """(line, category, tag, expected, actual) of each issue; a page that cannot be read has one more, without line."""
    parser = _Tags()
    try:
        parser.feed(html)
        parser.close()
    except Exception as e:  # noqa: BLE001  whatever stops the parser is what the issue says
        parser.stack.found.append((None, "HTML Parse Error", "", "Valid HTML", f"Parse failure: {e}"))
    return parser.stack.finish()


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("category", T.StringType()), T.StructField("tag", T.StringType())])))
def stack_issues(events: pd.Series) -> pd.Series:
    """Array of (category, tag) found by keeping the stack of open elements.

    An end tag that is not open is unexpected; one that is open below others makes a
    nesting mismatch of each element above it; what is open at the end is unclosed.
    """

    def of(tags) -> list[dict]:
        stack = _Stack()
        for tag in tags if tags is not None else ():
            if tag.startswith("/"):
                stack.end(tag[1:])
            else:
                stack.start(tag)
        return [{"category": category, "tag": tag} for _, category, tag, _, _ in stack.finish()]

    return events.map(of)


def raw_tag_issues(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, position, line, category, tag, expected, actual, engine_severity) of each issue; null HTML is empty."""
    kind = pages.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, page in enumerate(batch.column(1)):
                found = page_tag_issues(page.as_py() or "")
                if found:
                    columns = list(zip(*found, strict=True))
                    keys = pa.array([batch.column(0)[i].as_py()] * len(found), batch.column(0).type)
                    yield pa.RecordBatch.from_arrays(
                        [keys, pa.array(range(len(found)), pa.int32()), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.string()) for c in columns[1:])],
                        [key, "position", "line", "category", "tag", "expected", "actual"],
                    )

    found = map_arrow(pages.select(key, html), run, f"`{key}` {kind.simpleString()}, position int, line int, category string, tag string, expected string, actual string")
    return found.withColumn("engine_severity", F.lit("error"))
