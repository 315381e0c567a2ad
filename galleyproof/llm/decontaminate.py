"""Benchmark decontamination by CGK embeddings.

An item leaks into a document if some passage of the document is within ``share`` word
edits per word of the item (case and punctuation aside). Windows of the items' sizes are
embedded by CGK random walks, which turn edit distance into Hamming distance: at each
step the walk emits the word it stands on and moves on, or not, by a coin that depends on
step and word. Bit sampling (a few emitted words make a key) then finds items that agree
with a window; ``REPEATS`` independent walks and samples bring the recall to its target.
Agreement is confirmed by the exact edit distance of the item to the best passage around
the window, with Myers' bit-parallel algorithm.

Only windows that could match are embedded: e edits destroy at most 3 e of an item's word
triples, so a window with fewer of the items' triples than that leaves is passed over.
This loses nothing, and around a window that agrees, passages up to half an item away are
confirmed with it. Documents are read whole.

A benchmark of up to ``SMALL_ITEMS`` items and ``SMALL_CHARS`` characters is sent to the
tasks, and one pass without a shuffle finds all. A larger one stays distributed: tasks get
two bit tables of bounded size (the items' triples, and their keys), windows that pass both
are joined with the items by key, and the documents that agree with an item are read a
second time to confirm it, however many items there are. Bit tables only pass over what
cannot match, so their size bears on speed alone.

Words are runs of letters and digits of any script, in lower case. Items of one or two words
allow no edit and are looked up as they are. Items without words, or null, match nothing,
and so do null and empty texts.
Rows without doc_id are left out. Items with equal words are found each for itself.
Repeated rows of a document give one result. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galleyproof.llm.common import drop_scratch, join_salted, materialise, mix64, numbers, text_chunks
from galleyproof.llm.words import LETTERS, split_words
from galleyproof.session import map_arrow

REPEATS, SAMPLED = 24, 2
SMALL_ITEMS, SMALL_CHARS = 20_000, 20_000_000
#: A bit table has 16 bits for each entry, but no more than this: 16 MB.
MOST_BITS = 1 << 27
_PAD = np.uint64(0x9E3779B97F4A7C15)
#: Characters beyond ASCII that part words; combining marks do not.
_APART = re.compile("[^\\w\x00-\x7f\u0300-\u036f]")
_MATCHES = "doc_id long, item_id long, distance int, item_words int, start long, end long"


def plain(data: bytes) -> bytes:
    """UTF-8 with as many characters, in which ASCII alone parts words and A-Z are the only capitals."""
    if data.isascii():
        return data
    text = _APART.sub(" ", data.decode("utf-8", "replace"))
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low.encode()


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of ``n`` consecutive words."""
    factors = numbers(43, n) | np.uint64(1)
    count = max(0, len(words) - n + 1)
    total = np.full(count, np.uint64(n))
    for k in range(n):
        total += words[k : k + count] * factors[k]
    return mix64(total)


def triples(words: np.ndarray) -> np.ndarray:
    """Hashes of three consecutive words."""
    return grams(words, 3)


def edits_allowed(words: int, share: float) -> int:
    """Word edits up to which an item leaks; few enough that a match keeps a triple of its words."""
    return max(0, min(int(share * words), (words - 3) // 3))


def cgk_keys(words: np.ndarray, starts: np.ndarray, size: int, repeat: int) -> np.ndarray:
    """One bit-sampling key for each window words[s:s + size]; words must go on for ``size`` more."""
    steps = 2 * size
    seeds = numbers(1000 + repeat, steps + SAMPLED + 1)
    sampled = set(int(x % np.uint64(steps)) for x in seeds[steps : steps + SAMPLED])
    at = np.zeros(len(starts), np.int64)
    key = np.full(len(starts), seeds[-1])
    for step in range(max(sampled) + 1):
        word = np.where(at < size, words[starts + np.minimum(at, size - 1)], _PAD)
        if step in sampled:
            key = mix64(key + word)
        at += (mix64(word ^ seeds[step]) >> np.uint64(63)).astype(np.int64)
    return key


def best_match(item: list[int], text: list[int]) -> tuple[int, int]:
    """(least edit distance of ``item`` to any stretch of ``text``, end of the first such stretch)."""
    m = len(item)
    where: dict[int, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    up, down, score = full, 0, m
    best = (m, 0)
    for j, w in enumerate(text):
        eq = where.get(w, 0)
        keep = eq | down
        diagonal = ((eq & up) + up ^ up) | eq
        plus, minus = down | ~(diagonal | up) & full, up & diagonal
        if plus & top:
            score += 1
        if minus & top:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full  # a match may start anywhere: no carry
        up, down = minus | ~(keep | plus) & full, plus & keep
        if score < best[0]:
            best = (score, j + 1)
    return best


def closest(item: list[int], text: list[int]) -> tuple[int, int, int]:
    """(least edit distance, start, end) of the first stretch of ``text`` that is closest to ``item``."""
    distance, end = best_match(item, text)
    _, length = best_match(item[::-1], text[:end][::-1])
    return distance, end - length, end


def code_points(text: bytes, *at: int) -> list[int]:
    """Code points before each of the byte offsets."""
    return [len(text[:x].decode("utf-8", "replace")) for x in at]


@dataclass
class Items:
    """What tasks need of a small benchmark."""

    ids: list[int]
    words: list[list[int]]
    edits: list[int]
    seen: np.ndarray  #: by the lower bits of a triple's hash: whether an item may have it
    triples: np.ndarray  #: sorted hashes of the items' triples, one for each size of items that have it
    triple_size: np.ndarray  #: that size
    sizes: list[tuple[int, int]]  #: (words of an item, triples of the items that its match keeps)
    keys: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]  #: (size, repeat): sorted keys, items
    short: dict[int, tuple[np.ndarray, np.ndarray]]  #: items of one or two words: sorted keys, item_ids

    @classmethod
    def of(cls, rows: list[tuple[int, str | None]], share: float, repeats: int) -> Items:
        ids, words, edits, brief = [], [], [], []
        for item_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1])):
            found = split_words([plain((text or "").encode())], LETTERS).hash
            if item_id is not None and len(found) >= 3:
                ids.append(item_id)
                words.append(found)
                edits.append(edits_allowed(len(found), share))
            elif item_id is not None and len(found):
                brief.append((item_id, found))
        hashes = np.concatenate([triples(w) for w in words]) if words else np.zeros(0, np.uint64)
        bits = max(16, int(np.ceil(np.log2(len(hashes) + 1))) + 6)
        seen = np.zeros(1 << bits, bool)
        seen[(hashes & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
        sizes = sorted({(len(w), len(w) - 2 - 3 * e) for w, e in zip(words, edits, strict=True)})
        of_size = np.repeat([len(w) for w in words], [len(w) - 2 for w in words]) if words else np.zeros(0, np.int64)
        pairs = np.unique(np.rec.fromarrays([hashes, of_size], names="hash,size"))
        keys = {}
        for size, _ in sizes:
            own = [i for i, w in enumerate(words) if len(w) == size]
            flat = np.concatenate([words[i] for i in own])
            for r in range(repeats):
                key = cgk_keys(flat, np.arange(len(own)) * size, size, r)
                order = np.argsort(key, kind="stable")
                keys[size, r] = key[order], np.array(own)[order]
        short = {}
        for n in (1, 2):
            own = sorted((int(grams(w, n)[0]), i) for i, w in brief if len(w) == n)
            if own:
                short[n] = np.array([k for k, _ in own], np.uint64), np.array([i for _, i in own], np.int64)
        return cls(ids, [w.tolist() for w in words], edits, seen, pairs["hash"], pairs["size"], sizes, keys, short)

    def short_hits(self, words: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(doc, item_id, first word, words) of the items of one or two words that documents hold."""
        for n, (keys, items) in self.short.items():
            found = grams(words, n)
            low, high = (np.searchsorted(keys, found, side) for side in ("left", "right"))
            place = np.flatnonzero((high > low) & (doc[: len(found)] == doc[n - 1 : n - 1 + len(found)]))
            _, first = np.unique(np.stack([doc[place], low[place]]), axis=1, return_index=True)
            for k in place[first]:
                yield from ((int(doc[k]), int(i), int(k), n) for i in items[low[k] : high[k]])

    def hits(self, words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, size): places where a triple of an item of that size starts, by place."""
        found = triples(words)
        n = len(found)
        likely = np.flatnonzero(self.seen[(found & np.uint64(len(self.seen) - 1)).astype(np.int64)] & (doc[:n] == doc[2 : n + 2]))
        low, high = (np.searchsorted(self.triples, found[likely], side) for side in ("left", "right"))
        count = high - low
        place = np.repeat(likely, count)
        index = np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        return place, self.triple_size[index]

    def windows(self, place: np.ndarray, place_size: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each size, the starts of windows that hold enough triples of items of that size."""
        for size, least in self.sizes:
            own = place[place_size == size]
            if len(own) < least:
                continue
            own = np.sort(own)
            low = np.maximum(np.maximum(own - size + 3, 0), np.concatenate([[0], own[:-1] + 1]))
            length = np.maximum(own - low + 1, 0)
            starts = np.repeat(own + 1 - np.cumsum(length), length) + np.arange(length.sum())
            held = np.searchsorted(own, starts + size - 2) - np.searchsorted(own, starts)
            yield size, starts[held >= least]

    def candidates(self, words: np.ndarray, size: int, starts: np.ndarray, repeats: int) -> Iterator[tuple[int, int]]:
        """(window start, item) that agree in some repeat."""
        padded = np.concatenate([words, np.full(size, _PAD)])
        for r in range(repeats):
            keys, items = self.keys[size, r]
            got = cgk_keys(padded, starts, size, r)
            low, high = np.searchsorted(keys, got, "left"), np.searchsorted(keys, got, "right")
            for k in np.flatnonzero(high > low):
                for i in items[low[k] : high[k]]:
                    yield int(starts[k]), int(i)


def _finder(items: Items, repeats: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_chunks(batches):
            texts = [plain(t) for t in texts]
            words = split_words(texts, LETTERS)
            hits = items.hits(words.hash, words.doc)
            found: dict[tuple[int, int], tuple[int, int, int]] = {}
            covered: dict[tuple[int, int], list[int]] = {}
            for size, starts in items.windows(*hits):
                for start, item in items.candidates(words.hash, size, starts, repeats) if len(starts) else ():
                    doc = int(words.doc[start])
                    near = covered.setdefault((doc, item), [])
                    if any(abs(start - s) <= size // 2 for s in near) or found.get((doc, item), (1,))[0] == 0:
                        continue
                    near.append(start)
                    edits = items.edits[item]
                    a = max(int(words.bounds[doc]), start - size)
                    b = min(int(words.bounds[doc + 1]), start + 2 * size)
                    distance, first, last = closest(items.words[item], words.hash[a:b].tolist())
                    if distance <= edits:
                        row = (distance, a + first, a + last)
                        found[doc, item] = min(row, found.get((doc, item), row))
            rows = []
            for doc, item_id, a, n in items.short_hits(words.hash, words.doc):
                start, end = code_points(texts[doc], int(words.start[a]), int(words.end[a + n - 1]))
                rows.append((ids[doc].as_py(), item_id, 0, n, start, end))
            if found or rows:
                for (doc, item), (distance, a, b) in sorted(found.items()):
                    start, end = code_points(texts[doc], int(words.start[a]), int(words.end[b - 1]))
                    rows.append((ids[doc].as_py(), items.ids[item], distance, len(items.words[item]), start, end))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)],
                    ["doc_id", "item_id", "distance", "item_words", "start", "end"],
                )

    return find


# ---- large benchmarks


@dataclass
class Bits:
    """A set of 64-bit hashes by their lower bits: what it lacks is not in the set."""

    table: np.ndarray
    mask: np.uint64

    @classmethod
    def of(cls, hashes: DataFrame, entries: int) -> Bits:
        """The set of the column ``hash``, put together by the executors; at most ``MOST_BITS`` reach the driver."""
        size = min(MOST_BITS, 1 << max(10, int(entries * 16 - 1).bit_length()))
        bit = F.col("hash").bitwiseAND(F.lit(size - 1))
        words = hashes.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast(hash & {min(63, size - 1)} as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        table = np.zeros(size // 64, np.uint64)
        table[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
        return cls(table, np.uint64(size - 1))

    def held(self, hashes: np.ndarray) -> np.ndarray:
        word = self.table[((hashes & self.mask) >> np.uint64(6)).astype(np.int64)]
        return (word >> (hashes & np.uint64(63)) & np.uint64(1)).astype(bool)


def code(keys: np.ndarray, size: int, repeat: int) -> np.ndarray:
    """One number for a key, the size of its items and the repeat."""
    return mix64(keys ^ numbers(size + 2000, repeat + 1)[-1])


def codes(words: np.ndarray, starts: np.ndarray, size: int, repeats: int) -> Iterator[tuple[int, np.ndarray]]:
    """(repeat, code of each window); items of one or two words have one code."""
    if size < 3:
        yield 0, code(grams(words, size)[starts], size, 0)
        return
    padded = np.concatenate([words, np.full(size, _PAD)])
    for r in range(repeats):
        yield r, code(cgk_keys(padded, starts, size, r), size, r)


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in text_chunks(batches, "item_id"):
        words = split_words([plain(t) for t in texts], LETTERS)
        lists = pa.ListArray.from_arrays(pa.array(words.bounds, pa.int32()), pa.array(words.hash.view(np.int64)))
        yield pa.RecordBatch.from_arrays([ids, lists], ["item_id", "words"])


def _per_form(function):
    """Rows of (form, hash) with the hashes that ``function`` has for a form's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for form, words in zip(batch["form"], batch["words"], strict=True):
                found = function(words.values.to_numpy(zero_copy_only=False).view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array([form.as_py()] * len(found), pa.string()), pa.array(found.view(np.int64))], ["form", "hash"])

    return run


def _windows(sizes: list[tuple[int, int]], known: Bits, keys: Bits, repeats: int):
    """Rows of (doc, place, repeat, code): windows whose triples and key items may have, by their first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_chunks(batches, "doc"):
            words = split_words([plain(t) for t in texts], LETTERS)
            n = len(words.hash)
            if not n:
                continue
            found = triples(words.hash)
            likely = known.held(found) & (words.doc[: len(found)] == words.doc[2 : len(found) + 2])
            before = np.concatenate([[0], np.cumsum(likely)])
            for size, least in sizes:
                if size < 3:
                    starts = np.flatnonzero(words.doc[: n - size + 1] == words.doc[size - 1 :])
                else:
                    ends = np.minimum(np.arange(n) + size - 2, len(found))
                    starts = np.flatnonzero(before[ends] - before[np.minimum(np.arange(n), len(found))] >= least)
                for repeat, got in codes(words.hash, starts, size, repeats) if len(starts) else ():
                    own = np.flatnonzero(keys.held(got))
                    place, doc, got = starts[own], words.doc[starts[own]], got[own]
                    if size < 3 and len(own):  # the first of each document is all that counts
                        _, first = np.unique(np.stack([doc.astype(np.uint64), got]), axis=1, return_index=True)
                        place, doc, got = place[first], doc[first], got[first]
                    for a in range(0, len(place), 100_000):
                        cut = slice(a, a + 100_000)
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array(doc[cut])), pa.array(place[cut] - words.bounds[doc[cut]]), pa.array(np.full(len(place[cut]), repeat, np.int32)), pa.array(got[cut].view(np.int64))],
                            ["doc", "place", "repeat", "code"],
                        )

    return run


def _confirm(share: float):
    """Rows of (doc_id, form, distance, item_words, start, end) for the candidates of a document that are close enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, candidates in zip(batch["doc"], batch["text"], batch["candidates"], strict=True):
                data = plain((text.as_py() or "").encode())
                split = split_words([data], LETTERS)
                words = split.hash.view(np.int64).tolist()
                rows = []
                for candidate in candidates:
                    item = candidate["words"].as_py()
                    size, near, best = len(item), [], None
                    for place in (p["place"].as_py() for p in candidate["places"]):
                        if any(abs(place - p) <= size // 2 for p in near) or best and not best[0]:
                            continue
                        near.append(place)
                        a = max(0, place - size)
                        distance, first, last = closest(item, words[a : place + 2 * size])
                        if distance <= edits_allowed(size, share):
                            row = (distance, a + first, a + last)
                            best = min(row, best or row)
                    if best:
                        start, end = code_points(data, int(split.start[best[1]]), int(split.end[best[2] - 1]))
                        rows.append((doc["doc_id"].as_py(), candidate["form"].as_py(), best[0], size, start, end))
                if rows:
                    columns = zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["doc_id", "form", "distance", "item_words", "start", "end"])

    return run


def _large(read: DataFrame, benchmark: DataFrame, share: float, repeats: int) -> DataFrame:
    """Matches of a benchmark of any size, joined by key."""
    words = map_arrow(benchmark.where("item_id is not null").select("item_id", "text"), _item_words, "item_id long, words array<long>").where("size(words) > 0")
    # items with equal words are one form, named by a digest
    items = materialise(words.withColumn("form", F.sha2(F.concat_ws(",", F.col("words").cast("array<string>")), 256)), "leak-items")
    forms = items.groupBy("form").agg(F.min("words").alias("words"))
    sizes = [(r["n"], r["forms"]) for r in forms.groupBy(F.size("words").alias("n")).agg(F.count("*").alias("forms")).collect()]
    known = Bits.of(map_arrow(forms, _per_form(triples), "form string, hash long"), sum(n * count for n, count in sizes))

    def own_codes(words: np.ndarray) -> np.ndarray:
        return np.concatenate([got for _, got in codes(words, np.zeros(1, np.int64), len(words), repeats)])

    item_keys = materialise(map_arrow(forms, _per_form(own_codes), "form string, hash long").withColumnRenamed("hash", "code"), "leak-keys")
    keys = Bits.of(item_keys.withColumnRenamed("code", "hash"), repeats * sum(count for _, count in sizes))
    wanted = sorted((n, n - 2 - 3 * edits_allowed(n, share)) for n, _ in sizes)
    docs = read.select(F.struct("doc_id", F.xxhash64("text").alias("digest")).alias("doc"), "text")
    places = materialise(map_arrow(docs, _windows(wanted, known, keys, repeats), "doc struct<doc_id:long,digest:long>, place long, repeat int, code long"), "leak-windows")
    agree = join_salted(places, item_keys, "code", "doc").groupBy("doc", "form").agg(F.sort_array(F.collect_set(F.struct("repeat", "place"))).alias("places"))
    agree = materialise(agree, "leak-candidates")
    own = join_salted(agree, forms, "form", "doc").groupBy("doc").agg(F.collect_list(F.struct("form", "words", "places")).alias("candidates"))
    hits = materialise(map_arrow(docs.join(own, "doc"), _confirm(share), f"doc_id long, form string, {_MATCHES.split('item_id long, ')[1]}"), "leak-hits")
    drop_scratch(item_keys, places, agree)
    return join_salted(hits, items.select("form", "item_id").distinct(), "form", "doc_id").select("doc_id", "item_id", "distance", "item_words", "start", "end")


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.25, repeats: int = REPEATS) -> DataFrame:
    """(doc_id, item_id, distance, item_words, start, end): items of ``benchmark`` (item_id, text) in ``docs`` (doc_id, text).

    One row for each document and item, with the closest passage (the first of those) as
    code point offsets. share: word edits allowed for each word of an item.
    """
    read = docs.where("doc_id is not null").select("doc_id", "text")
    size = benchmark.agg(F.count("*").alias("items"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    if size["items"] <= SMALL_ITEMS and size["chars"] <= SMALL_CHARS:
        items = Items.of([(r["item_id"], r["text"]) for r in benchmark.select("item_id", "text").collect()], share, repeats)
        out = map_arrow(read, _finder(items, repeats), _MATCHES)
    else:
        out = _large(read, benchmark, share, repeats)
    best = F.min(F.struct("distance", "start", "end", "item_words"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.distance", "b.item_words", "b.start", "b.end")


def clean_documents(docs: DataFrame, benchmark: DataFrame, share: float = 0.25) -> DataFrame:
    """``docs`` without the documents that hold an item."""
    placed = docs.where("doc_id is not null").join(leaks(docs, benchmark, share).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    # rows without doc_id are found again by a number of their own
    rest = materialise(docs.where("doc_id is null").withColumn("_row", F.monotonically_increasing_id()), "without-id")
    found = leaks(rest.select(F.col("_row").alias("doc_id"), "text"), benchmark, share).select(F.col("doc_id").alias("_row")).distinct()
    return placed.unionAll(rest.join(found, "_row", "left_anti").select(*docs.columns))
