"""Word-processor packages as HTML, so that the rules for pages hold for them too.

A package that cannot be read gives an empty body. Paragraphs and tables come in document
order, pictures after them, as data addresses.
"""

from __future__ import annotations

import base64
import html
import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame

from galleyproof.session import map_arrow

#: Names of the format.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_BREAKS = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n", f"{_W}noBreakHyphen": "-"}
_SIGNATURES = {b"\x89PNG": "png", b"\xff\xd8": "jpeg", b"GIF8": "gif", b"BM": "bmp", b"RIFF": "webp"}
_OFF = ("0", "false", "off", "none")


def _text(run: ET.Element) -> str:
    return "".join((e.text or "") if e.tag == f"{_W}t" else _BREAKS.get(e.tag, "") for e in run)


def _is_on(run: ET.Element, name: str) -> bool:
    mark = run.find(f"{_W}rPr/{_W}{name}")
    return mark is not None and mark.get(f"{_W}val", "single" if name != "u" else "none") not in _OFF


def _level(paragraph: ET.Element, styles: dict[str, str]) -> str:
    style = paragraph.find(f"{_W}pPr/{_W}pStyle")
    name = styles.get(style.get(f"{_W}val", ""), "") if style is not None else ""
    compact = name.lower().replace("heading ", "heading")
    if compact[:7] == "heading" and compact[7:] in tuple("123456"):
        return f"h{compact[7:]}"
    return "h1" if compact == "title" else "p"


def _paragraph(paragraph: ET.Element, styles: dict[str, str]) -> str:
    parts = []
    for run in paragraph.findall(f"{_W}r"):
        shown = html.escape(_text(run))
        for name, tag in (("b", "b"), ("i", "i"), ("u", "u")):
            if shown and _is_on(run, name):
                shown = f"<{tag}>{shown}</{tag}>"
        parts.append(shown)
    inner, tag = "".join(parts), _level(paragraph, styles)
    return f"<{tag}>{inner}</{tag}>" if inner.strip() else ""


def _table(table: ET.Element) -> str:
    """Cells that span columns repeat; cells that continue one above have its text."""
    rows, above = [], []
    for row in table.findall(f"{_W}tr"):
        cells: list[str] = []
        for cell in row.findall(f"{_W}tc"):
            own = "\n".join("".join(_text(r) for r in p.findall(f"{_W}r")) for p in cell.findall(f"{_W}p"))
            merge, span = cell.find(f"{_W}tcPr/{_W}vMerge"), cell.find(f"{_W}tcPr/{_W}gridSpan")
            if merge is not None and merge.get(f"{_W}val", "continue") == "continue" and len(cells) < len(above):
                own = above[len(cells)]
            cells += [own] * int(span.get(f"{_W}val", "1") if span is not None else 1)
        above = cells
        rows.append("<tr>" + "".join(f"<td>{html.escape(c)}</td>" for c in cells) + "</tr>")
    return "<table>" + "".join(rows) + "</table>"


def _images(package: zipfile.ZipFile) -> Iterator[str]:
    name = "word/_rels/document.xml.rels"
    if name not in package.namelist():
        return
    for link in ET.fromstring(package.read(name)):
        target = posixpath.normpath(posixpath.join("/word", link.get("Target", ""))).lstrip("/")
        if "image" not in link.get("Type", "") or link.get("TargetMode") == "External" or target not in package.namelist():
            continue
        data = package.read(target)
        suffix = target.rsplit(".", 1)[-1].lower()
        kind = next((k for s, k in _SIGNATURES.items() if data.startswith(s)), "jpeg" if suffix == "jpg" else suffix)
        yield f'<img src="data:image/{kind};base64,{base64.b64encode(data).decode()}" alt="{html.escape(posixpath.basename(target))}">'


def to_html(content: bytes | None) -> str:
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as package:
            body = ET.fromstring(package.read("word/document.xml")).find(f"{_W}body")
            styles = {}
            if "word/styles.xml" in package.namelist():
                for style in ET.fromstring(package.read("word/styles.xml")).findall(f"{_W}style"):
                    name = style.find(f"{_W}name")
                    styles[style.get(f"{_W}styleId", "")] = name.get(f"{_W}val", "") if name is not None else ""
            parts = []
            for block in body if body is not None else ():
                if block.tag == f"{_W}p":
                    parts.append(_paragraph(block, styles))
                elif block.tag == f"{_W}tbl":
                    parts.append(_table(block))
            parts += _images(package)
    except (zipfile.BadZipFile, KeyError, ValueError, ET.ParseError):
        parts = []
    return "<html><body>" + "\n".join(p for p in parts if p) + "</body></html>"


def pages(files: DataFrame) -> DataFrame:
    """(page_id, html) of ``files`` (page_id, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(map(to_html, batch.column(1).to_pylist()), pa.string())], ["page_id", "html"])

    return map_arrow(files.select("page_id", "content"), run, "page_id long, html string")
