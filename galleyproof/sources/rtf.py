"""Rich text: code pages, text, image references and embedded pictures.

Raw files come as ``binaryFile`` rows; ``decode(content, 'ISO-8859-1')`` gives the ``raw``
text used here, in which each byte is a character. Null raw text is empty. Broken files
never raise an error: a group without an end lasts to the end of the file, and bytes that
the code page lacks become U+FFFD.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleyproof.functions import text as tx
from galleyproof.session import map_arrow

#: Language ids whose text is in the Arabic code page (Arabic by country, then Urdu and Persian).
RTL_LANGUAGE_IDS = ("1025", "2049", "3073", "4097", "5121", "6145", "7169", "8193", "9217", "10241", "11265", "12289", "13313", "14337", "15361", "16385", "1056", "1065")
_RTL_LANGUAGE = rf"(?i)\\lang(?:fe)?(?:{'|'.join(RTL_LANGUAGE_IDS)})\b"
_RTL_NAME = r"(?i)[_ ](?:AR|FA|UR)\.rtf$"

#: Code pages that can be decoded.
CODE_PAGES = ("037", "273", "424", "437", "500", "720", "737", "775", "850", "852", "855", "856", "857", "858", "860", "861", "862", "863", "864", "865", "866", "869", "874", "875", "932", "949", "950", "1006", "1026", "1125", "1140", "1250", "1251", "1252", "1253", "1254", "1255", "1256", "1257", "1258", "65001")

#: Groups that are no text, and what control words and symbols stand for.
SILENT = ("fonttbl", "stylesheet", "info", "colortbl", "filetbl", "listtable", "listoverridetable", "themedata", "xmlnstbl")
WORDS = {"par": "\n", "line": "\n", "row": "\n", "tab": "\t", "cell": "\t", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”"}
SYMBOLS = {"~": "\u00a0", "-": "\u00ad", "_": "\u2011", "{": "{", "}": "}", "\\": "\\"}
#: Characters at the start of a group that tell what it is.
_HEAD = 160

_ATOM = re.compile(r"\\'(?P<hex>[^\n]{0,2})|\\(?P<word>[^\W\d_]+)(?P<sign>[+-]?)(?P<number>\d*) ?|\\(?P<symbol>.)|(?P<plain>[^\\{}\r\n]+)", re.S)
_FALLBACK = re.compile(r"[\r\n]*(?:\\'..|\\[^\W\d_]*\d* ?|[^\r\n])", re.S)
_ROOT, _FIELD, _PICT = re.compile(r"\{\s*\\rtf\d*\b", re.I), re.compile(r"\\field\b", re.I), re.compile(r"\\pict\b", re.I)
_TARGET = re.compile(r"\{\s*(?:\\\*)?\\([A-Za-z]+)")
_INCLUDED = re.compile("INCLUDEPICTURE", re.I)


def codepage(raw: Column, path: Column) -> Column:
    """The code page of the bytes: Arabic by language or name, else the declared one, else Western."""
    declared = F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?i)\\ansicpg(\d+)", 1)
    rtl = F.coalesce(raw.rlike(_RTL_LANGUAGE), F.lit(False)) | F.coalesce(path.rlike(_RTL_NAME), F.lit(False))
    return F.when(rtl, "cp1256").when(declared.isin(*CODE_PAGES), F.concat(F.lit("cp"), declared)).otherwise("cp1252")


def image_references(raw: Column) -> Column:
    """File names of included pictures, in order; names in quotation marks may hold spaces."""
    found = F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(r'(?i)INCLUDEPICTURE\s+(?:"[^"]+"|[^\s\\}]+)'), F.lit(0))
    return F.transform(found, lambda x: F.translate(F.regexp_replace(F.regexp_replace(x, r"(?i)^INCLUDEPICTURE\s+", ""), '^"|"$', ""), "\\", "/"))


def picture_goals(raw: Column) -> Column:
    """Display sizes (width, height in inches; 1440 units each) of pictures, in order."""
    pattern = r"(?i)\\pict\b[^{}]*?\\picwgoal(\d+)[^{}]*?\\pichgoal(\d+)"
    side = lambda k: F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(pattern), F.lit(k))
    return F.transform(F.arrays_zip(side(1).alias("w"), side(2).alias("h")), lambda z: F.named_struct(F.lit("width"), z["w"].cast("double") / 1440, F.lit("height"), z["h"].cast("double") / 1440))


def linked_images(files: DataFrame, assets: DataFrame) -> DataFrame:
    """(doc_id, position, ref, path, width, height): pictures that ``files`` (doc_id, package, folder, raw) include.

    ``assets``: package, path. A reference is looked up beside the file, then in its
    folder Images, then below its folder (the first by path); without a match it is left
    out. The join is by package and base name.
    """
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    refs = files.select("doc_id", "package", "folder", picture_goals(F.col("raw")).alias("goals"), F.posexplode(image_references(F.col("raw"))).alias("position", "ref"))
    refs = refs.select("doc_id", "package", "folder", "position", "ref", base(F.col("ref")).alias("base"), F.get("goals", F.col("position")).alias("goal"))
    both = refs.join(assets.select("package", "path", base(F.col("path")).alias("base")), ["package", "base"])
    under = F.when(F.coalesce("folder", F.lit("")) == "", "").otherwise(F.concat("folder", F.lit("/")))
    rank = F.when(F.col("path") == F.concat(under, "ref"), 0).when(F.col("path") == F.concat(under, F.lit("Images/"), "base"), 1).when(F.startswith("path", under), 2)
    best = both.withColumn("rank", rank).where("rank is not null").groupBy("doc_id", "position").agg(F.min(F.struct("rank", "path")).alias("m"), F.first("ref").alias("ref"), F.first("goal").alias("goal"))
    return best.select("doc_id", "position", "ref", "m.path", "goal.width", "goal.height")


def _ends(raw: str) -> dict[int, int]:
    """Where the group of each opening brace ends. Braces count even after a backslash, as destinations are cut before text is read."""
    ends, open_ = {}, []
    for m in re.finditer("[{}]", raw):
        if m.group() == "{":
            open_.append(m.start())
        elif open_:
            ends[open_.pop()] = m.end()
    return ends | dict.fromkeys(open_, len(raw))


def _is_silent(raw: str, start: int, end: int) -> bool:
    head = raw[start : min(end, start + _HEAD)]
    if _ROOT.match(head):
        return False
    target = _TARGET.match(head)
    return bool(_PICT.search(head) or (target and target[1].lower() in SILENT) or (_FIELD.search(head) and _INCLUDED.search(raw, start, end)))


def spoken(raw: str) -> str:
    """``raw`` without groups that are no text: tables of fonts and styles, pictures, fields that include pictures."""
    kept, at, ends = [], 0, _ends(raw)
    for start in sorted(ends):
        if start >= at and _is_silent(raw, start, ends[start]):
            kept.append(raw[at:start])
            at = ends[start]
    return "".join(kept) + raw[at:]


def _byte(digits: str, page: str) -> str:
    try:
        return bytes.fromhex(digits).decode(page, "replace") if len(digits) == 2 else ""
    except ValueError:
        return ""


def plain_text(raw: str, page: str) -> str:
    """The text of ``raw``; line ends of the file are none of the text."""
    raw, out, at, width = spoken(raw), [], 0, 1
    while at < len(raw):
        atom = _ATOM.match(raw, at)
        if not atom:  # braces, line ends, a last backslash
            at += 1
            continue
        at = atom.end()
        word, number = (atom["word"] or "").lower(), atom["number"]
        if atom["plain"]:
            out.append(atom["plain"])
        elif atom["hex"] is not None:
            out.append(_byte(atom["hex"], page))
        elif atom["symbol"]:
            out.append(SYMBOLS.get(atom["symbol"], ""))
        elif word == "uc" and number:
            width = 0 if atom["sign"] == "-" else int(number)
        elif word == "u" and number:
            code = 65536 - int(number) if atom["sign"] == "-" else int(number)
            out.append(chr(code) if 0 <= code <= 0x10FFFF else "\ufffd")
            for _ in range(width):
                stand_in = _FALLBACK.match(raw, at)
                at = stand_in.end() if stand_in else at
        else:
            out.append(WORDS.get(word, ""))
    # Halves of pairs beyond U+FFFF come as two escapes.
    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raws, pages = (batch.column(k).to_pylist() for k in (1, 2))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([plain_text(r or "", p) for r, p in zip(raws, pages, strict=True)], pa.string())], ["doc_id", "text"])


def lines(files: DataFrame) -> DataFrame:
    """(doc_id, line, text) of ``files`` (doc_id, path, raw): lines that say something, without stock phrases, from 1."""
    read = map_arrow(files.select(F.col("doc_id").cast("long"), "raw", codepage(F.col("raw"), F.col("path")).alias("codepage")), _read, "doc_id long, text string")
    cleaned = F.transform(F.split("text", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: tx.strip_boilerplate(x))
    return read.select("doc_id", F.posexplode(F.filter(cleaned, lambda x: x != "")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def tokens(files: DataFrame) -> DataFrame:
    """(doc_id, line, position, text, norm) of ``files``; rich text carries no flags for alignment."""
    each = lines(files).select("doc_id", "line", F.posexplode(tx.tokens(F.col("text"))).alias("position", "text"))
    return each.withColumn("norm", tx.norm_compare(F.col("text")))


def _pictures(raw: str) -> Iterator[tuple[str, bytes]]:
    ends, starts = _ends(raw), [0]
    for m in _PICT.finditer(raw):
        start = raw.rfind("{", 0, m.start())
        if start < 0 or start in starts:
            continue
        starts.append(start)
        group = raw[m.end() : ends[start]]
        kind = re.search(r"\\(png|jpe?g)blip\b", group, re.I)
        bare = re.sub(r"\s+", "", re.sub(r"\\[A-Za-z]+-?\d* ?", "|", group))
        digits = max(re.findall("[0-9A-Fa-f]{16,}", bare), key=len, default="")
        data = bytes.fromhex(digits[: len(digits) // 2 * 2])
        if kind and data.startswith((b"\x89PNG", b"\xff\xd8")):
            yield "png" if kind[1].lower() == "png" else "jpeg", data


def embedded_images(files: DataFrame) -> DataFrame:
    """(doc_id, position, kind, content): PNG and JPEG pictures written as hex digits; for files without linked ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("position", pa.int32()), ("kind", pa.string()), ("content", pa.binary())])
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [{"doc_id": key, "position": i, "kind": k, "content": c} for i, (k, c) in enumerate(_pictures(raw or ""))]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return map_arrow(files.select(F.col("doc_id").cast("long"), "raw"), run, "doc_id long, position int, kind string, content binary")
