"""Uploaded files and ZIP packages as rows."""

from __future__ import annotations

import io
import lzma
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleyproof.session import map_arrow

EXTENSIONS = (".pdf", ".rtf", ".html", ".htm", ".docx", ".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp", ".svg", ".zip")
MAX_DEPTH, MAX_FILES, MAX_BYTES = 4, 3000, 500 * 1024 * 1024
_ITEMS = "package string, relpath string, depth int, content binary, error string"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def safe_relpath(path: Column) -> Column:
    """A relative path without parents, dot files and archive leftovers."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    return F.array_join(F.filter(parts, lambda p: (p != "") & ~p.startswith(".") & (p != "__MACOSX")), "/")


def _safe(name: str) -> str:
    """``safe_relpath`` of one name."""
    return "/".join(p for p in name.replace("\\", "/").split("/") if p and not p.startswith(".") and p != "__MACOSX")


def _walk(data: bytes, depth: int) -> Iterator[dict]:
    if depth > MAX_DEPTH:
        raise ValueError("packages are nested too deeply")
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        infos = [i for i in archive.infolist() if not i.is_dir()]
        if len(infos) > MAX_FILES or sum(i.file_size for i in infos) > MAX_BYTES:
            raise ValueError("a package is too large")
        for info in infos:
            parts = info.filename.replace("\\", "/").split("/")
            if "__MACOSX" in parts or parts[-1].startswith("."):
                continue
            wanted = parts[-1].lower()
            if not wanted.endswith(EXTENSIONS):
                continue
            content = archive.read(info)
            if wanted.endswith(".zip"):
                yield from _walk(content, depth + 1)
            else:
                yield {"relpath": _safe(info.filename), "depth": depth, "content": content}


#: What a broken, encrypted or unknown archive raises.
_BROKEN = (ValueError, RuntimeError, NotImplementedError, EOFError, OSError, zlib.error, lzma.LZMAError, struct.error, zipfile.BadZipFile)


def expand(files: DataFrame) -> DataFrame:
    """(package, relpath, depth, content, error) of the files in ``files`` (path, content).

    Member names are made safe. A package that cannot be read to its end has one row with
    its error beside the files read before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("package", pa.string()), ("relpath", pa.string()), ("depth", pa.int32()), ("content", pa.binary()), ("error", pa.string())])
        for batch in batches:
            for path, data in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    for row in _walk(data.as_py() or b"", 0):
                        yield pa.RecordBatch.from_pylist([{"package": path.as_py(), **row}], schema)
                except _BROKEN as e:
                    yield pa.RecordBatch.from_pylist([{"package": path.as_py(), "error": str(e) or type(e).__name__}], schema)

    return map_arrow(files.select("path", "content"), run, _ITEMS)
