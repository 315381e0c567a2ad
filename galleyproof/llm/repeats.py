"""Removing repeated passages by hashing lines and the sentences within them.

Each document is cut into units: lines, and within a line its sentences, so that a
passage is found inside other text as well as on lines of its own. Units are normalised
(lower case, single spaces), hashed to 128 bits and grouped over the corpus; the unit of
the smallest doc_id, and there the first, stays. Neighbouring units that are later
occurrences form one span, and every span is removed, however short; ``min_words`` leaves
out shorter ones on request. Spans keep their offsets (code points) in the original text.
A repeated stretch whose edges run into unlike text within a sentence is found but for
those sentences.

Null and empty texts have no units. A document that repeats itself keeps the first
occurrence. Ties of equal doc_ids cannot be ranked and keep both copies. Rows without
doc_id are left out; extra columns are not read.

Units leave a Python worker in blocks of ``BLOCK``, also within a document. It holds one
document's text at a time beside the batch, and about 100 bytes for each distinct unit of it.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galleyproof.llm.common import join_groups, materialise, text_chunks
from galleyproof.session import map_arrow

_UNIT = re.compile(r"[^\s.!?。！？][^.!?。！？\n]*[.!?。！？]*")
#: Units handed over at once, so that a worker's memory does not grow with their number.
BLOCK = 20_000
_UNITS = "h1 long, h2 long, doc_id long, unit int, start int, end int, words int, again boolean"


def units(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, normalised text) of each unit, in order."""
    for found in _UNIT.finditer(text):
        piece = found[0].rstrip()
        yield found.start(), found.start() + len(piece), " ".join(piece.lower().split())


def _hash_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_digest
    digests, rows, again = bytearray(), array("q"), bytearray()
    for ids, texts in text_chunks(batches):
        for doc_id, data in zip(ids.to_pylist(), texts, strict=True):
            seen = set()
            for i, (start, end, norm) in enumerate(units(data.decode("utf-8", "replace"))):
                key = digest(norm)
                digests += key
                rows.extend((doc_id, i, start, end, norm.count(" ") + 1))
                again.append(key in seen)
                seen.add(key)
                if len(again) == BLOCK:
                    yield _block(digests, rows, again)
                    digests, rows, again = bytearray(), array("q"), bytearray()
    if again:
        yield _block(digests, rows, again)


def _block(digests: bytearray, rows: array, again: bytearray) -> pa.RecordBatch:
    hashes = np.frombuffer(digests, "<i8").reshape(-1, 2)
    table = np.frombuffer(rows, np.int64).reshape(-1, 5)
    columns = [hashes[:, 0], hashes[:, 1], table[:, 0], *(table[:, k].astype(np.int32) for k in (1, 2, 3, 4)), np.frombuffer(again, bool)]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["h1", "h2", "doc_id", "unit", "start", "end", "words", "again"])


def repeated_spans(docs: DataFrame, min_words: int = 1) -> DataFrame:
    """(doc_id, start, end, n_words, first_doc_id): spans of ``docs`` (doc_id, text) to remove.

    first_doc_id: the smallest document that holds the first unit of the span.
    """
    found = materialise(map_arrow(docs.where("doc_id is not null").select("doc_id", "text"), _hash_units, _UNITS), "units")
    groups = materialise(found.where("not again").groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "repeated")
    place = ["doc_id", "unit", "start", "end", "words"]
    elsewhere = join_groups(found, groups, ["h1", "h2"], "n").where("doc_id <> first").select(*place, "first")
    within = found.where("again").select(*place, F.col("doc_id").alias("first"))
    later = elsewhere.unionAll(within).groupBy("doc_id", "unit").agg(F.min("start").alias("start"), F.min("end").alias("end"), F.min("words").alias("words"), F.min("first").alias("first"))
    island = F.col("unit") - F.row_number().over(Window.partitionBy("doc_id").orderBy("unit"))
    return (
        later.withColumn("island", island)
        .groupBy("doc_id", "island")
        .agg(F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"), F.sum("words").alias("n_words"), F.min_by("first", "unit").alias("first_doc_id"))
        .where(F.col("n_words") >= min_words)
        .drop("island")
    )


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the text of ``spans`` (doc_id, start, end; apart from each other) cut out."""
    cuts = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_cuts"))
    kept = F.expr(
        """coalesce(concat(
             array_join(transform(_cuts, (c, i) -> substring(text, int(if(i = 0, 0, _cuts[greatest(i - 1, 0)].end)) + 1,
               int(c.start - if(i = 0, 0, _cuts[greatest(i - 1, 0)].end)))), ''),
             substring(text, int(element_at(_cuts, -1).end) + 1)), text)"""
    )
    return docs.join(cuts, "doc_id", "left").withColumn("text", kept).drop("_cuts").select(*docs.columns)
