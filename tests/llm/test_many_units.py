"""Texts of very many short units: blocks of bounded size, and the same rows as a plain loop gives."""

import tracemalloc

import pyarrow as pa
import xxhash

from galleyproof.llm import repeats

LIMIT = 25_000


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(texts.keys(), pa.int64()), pa.array(texts.values(), pa.string())], ["doc_id", "text"])


def test_blocks_of_units_are_bounded():
    texts = {1: "".join(f"{i % 30_000}. " for i in range(70_000)), 2: None, 3: "Ä b!\n" * 9, 4: "", 5: "a. " * 41_000, 6: "a. b", 7: "last"}
    found = list(repeats._hash_units(iter([batch(texts), batch({8: "a. last"})])))
    assert max(b.num_rows for b in found) <= LIMIT
    want = []
    for doc_id, text in [*texts.items(), (8, "a. last")]:
        seen = set()
        for i, (start, end, norm) in enumerate(repeats.units(text or "")):
            want.append((xxhash.xxh3_128_digest(norm), doc_id, i, start, end, len(norm.split()), norm in seen))
            seen.add(norm)
    rows = pa.Table.from_batches(found).to_pylist()
    assert [(r["h1"].to_bytes(8, "little", signed=True) + r["h2"].to_bytes(8, "little", signed=True), *list(r.values())[2:]) for r in rows] == want


def test_memory_does_not_grow_with_units():
    rows = batch({1: "a. " * 400_000})
    tracemalloc.start()
    assert sum(b.num_rows for b in repeats._hash_units(iter([rows]))) == 400_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6


def test_spans_across_blocks(spark):
    n = 45_000
    docs = spark.createDataFrame([(1, "So it is. " * n), (2, "Own. " + "so it IS. " * n + "Own end."), (3, "Other")], "doc_id long, text string")
    found = sorted((s["doc_id"], s["start"], s["end"], s["n_words"], s["first_doc_id"]) for s in repeats.repeated_spans(docs).collect())
    assert found == [(1, 10, 10 * n - 1, 3 * (n - 1), 1), (2, 5, 5 + 10 * n - 1, 3 * n, 1)]
