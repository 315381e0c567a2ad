"""MinHash near-duplicate detection with odd sketches.

Documents are sets of distinct 5-word shingles. Each distinct text gets 288 MinHash
samples, which are used twice: 48 bands of 6 samples propose candidates, and a 1024-bit
odd sketch (each sample flips one bit) lets the population count of an XOR estimate how
many samples differ, so that most false candidates fall before any text is moved. A parity
bitmap of the set itself, whose differing bits are at most the differing elements, then
rejects most of the rest without loss. What remains is confirmed on the full shingle sets.

Candidates are not all pairs of a band. First every member of a band is held against the
smallest member; after the links found so are closed to components, only members of
different components still have to be compared. Where a band still has more than
``LARGE_BAND`` members, its members are not paired by it: the members of all such bands are
joined exactly, by the rarest shingles of each set (a prefix long enough that linked sets
must share one) with bounds on sizes and positions, so that what they all have in common
proposes nothing. A pair at the threshold misses all 48 bands with a probability of 1e-4,
which falls fast above it; the size of a band costs nothing more.

Nulls and texts without words have no shingles, link with nothing and are kept. Exact
copies of a word sequence are one node of the graph, whatever their number; a tie goes
to the smallest doc_id. Rows that share a doc_id but not the text are one node, linked by
whichever of its texts is similar. Rows without doc_id link with nothing, have no
component_id and are kept. Extra columns are not read. The written tables that the result
still reads stay in the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galleyproof.llm.common import drop_scratch, join_groups, join_salted, materialise, mix64, numbers, text_chunks
from galleyproof.llm.graph import components
from galleyproof.llm.words import shingles, split_words
from galleyproof.session import map_arrow

BANDS, ROWS, SKETCH_BITS, PARITY_BITS = 48, 6, 1024, 2048
#: Estimates below the threshold by more than this are not confirmed: 3.5 standard deviations.
SKETCH_SLACK = 0.12
#: Members of bands with more members than this are joined by their rarest shingles instead of being paired.
LARGE_BAND = 1000

_SIGNATURE = "doc_id long, digest binary, n_shingles long, bands array<long>, sketch array<long>, parity array<long>"


def minhash(values: np.ndarray, bounds: np.ndarray, samples: int) -> np.ndarray:
    """MinHash samples of each non-empty set values[bounds[i]:bounds[i + 1]], one row a set."""
    seeds = (numbers(5, 2 * samples) >> np.uint64(32)).astype(np.uint32)
    flips, factors = seeds[:samples], seeds[samples:] | np.uint32(1)
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(starts), samples), np.uint32)
    if not len(starts):
        return out
    low = (values >> np.uint64(32)).astype(np.uint32)
    held = np.empty_like(low)
    for i in range(samples):
        np.bitwise_xor(low, flips[i], out=held)
        np.multiply(held, factors[i], out=held)
        out[:, i] = np.minimum.reduceat(held, starts)
    return out


def odd_sketch(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmaps of (position, sample) pairs, as rows of signed 64-bit words."""
    n, k = samples.shape
    place = mix64(samples.astype(np.uint64) + numbers(9, k)[None, :]) % np.uint64(bits)
    flat = (np.arange(n)[:, None] * bits + place.astype(np.int64)).ravel()
    odd = np.bincount(flat, minlength=n * bits).astype(np.uint8) & 1
    return np.packbits(odd.reshape(n, bits), axis=1, bitorder="little").view(np.int64)


def set_parity(values: np.ndarray, bounds: np.ndarray, bits: int = PARITY_BITS) -> np.ndarray:
    """Parity bitmaps of the non-empty sets themselves; the bits in which two differ are never
    more than the elements in which the sets differ."""
    sizes = np.diff(bounds)
    rank = np.cumsum(sizes > 0) - 1
    n = int((sizes > 0).sum())
    flat = np.repeat(rank, sizes) * bits + (values % np.uint64(bits)).astype(np.int64)
    odd = np.bincount(flat, minlength=n * bits).astype(np.uint8) & 1
    return np.packbits(odd.reshape(n, bits), axis=1, bitorder="little").view(np.int64)


def band_keys(samples: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of each row of samples."""
    parts = samples.reshape(len(samples), bands, rows).astype(np.uint64)
    total = numbers(21, bands)[None, :] + np.zeros((len(samples), 1), np.uint64)
    for r in range(rows):
        total = mix64(total + parts[:, :, r])
    return total.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in text_chunks(batches):
        words = split_words(texts)
        values, bounds = shingles(words)
        sizes = np.diff(bounds)
        full = sizes > 0
        samples = minhash(values, bounds, BANDS * ROWS)
        digests = [hashlib.blake2b(words.hash[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [ids.cast(pa.int64()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), _lists(band_keys(samples), full), _lists(odd_sketch(samples), full), _lists(set_parity(values, bounds), full)],
            ["doc_id", "digest", "n_shingles", "bands", "sketch", "parity"],
        )


def _lists(rows: np.ndarray, full: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(full) + 1, np.int32)
    np.cumsum(full * rows.shape[1], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel(), pa.int64()))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, digest of the word sequence, n_shingles, bands, sketch, parity) of each document."""
    return map_arrow(docs.select("doc_id", "text"), _sign, _SIGNATURE)


def _differing_bits(a: str, b: str, bits: int) -> F.Column:
    return reduce(lambda x, y: x + y, (F.bit_count(F.expr(f"{a}[{i}] ^ {b}[{i}]")) for i in range(bits // 64)))


def sketch_similarity(a: str, b: str) -> F.Column:
    """The Jaccard similarity estimated from two odd sketches (columns of 64-bit words)."""
    filled = F.least(2.0 * _differing_bits(a, b, SKETCH_BITS) / SKETCH_BITS, F.lit(0.999))
    return 1 + F.lit(SKETCH_BITS / (4.0 * BANDS * ROWS)) * F.log(1 - filled)


def _plausible(threshold: float) -> F.Column:
    """What linked pairs satisfy: by their sizes and set parities always, by the odd sketch but for its slack."""
    percent = round(100 * threshold)
    least, most = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    apart = _differing_bits("parity_a", "parity_b", PARITY_BITS)
    return (100 * least >= percent * most) & ((100 + percent) * apart <= (100 - percent) * (F.col("n_a") + F.col("n_b"))) & (sketch_similarity("sketch_a", "sketch_b") >= threshold - SKETCH_SLACK)


_OWN = ("n_shingles", "sketch", "parity")


def _side(nodes: DataFrame, node: str, side: str) -> DataFrame:
    """``nodes`` with their columns named for one side of a pair."""
    return nodes.select(F.col("node").alias(node), F.col("n_shingles").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}"), F.col("parity").alias(f"parity_{side}"), *(F.col(c).alias(f"{c}_{side}") for c in ("component", "live") if c in nodes.columns), *(["key"] if "key" in nodes.columns else []))


def _confirmer(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = (np.asarray(batch.column(i)) for i in (0, 1))
            left, right = (batch.column(i).cast(pa.binary()) for i in (2, 3))
            good = np.zeros(len(u), bool)
            known: dict[int, np.ndarray] = {}
            for i in range(len(u)):
                sets = []
                for node, texts in ((u[i], left), (v[i], right)):
                    if node not in known:
                        if len(known) > 64:
                            known.clear()
                        known[node] = shingles(split_words([texts[i].as_py() or b""]))[0]
                    sets.append(known[node])
                both = len(np.intersect1d(*sets, assume_unique=True))
                good[i] = 100 * both >= percent * (len(sets[0]) + len(sets[1]) - both)
            keep = np.flatnonzero(good)
            yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], ["u", "v"])

    return confirm


def _confirmed(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose full shingle sets are similar enough, as a written table."""
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    texts = materialise(docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi"), "texts")
    left, right = (texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}")) for k in "uv")
    both = join_salted(join_salted(pairs.select("u", "v"), left, "u", "v"), right, "v", "u").select("u", "v", "text_u", "text_v")
    links = materialise(map_arrow(both, _confirmer(round(100 * threshold)), "u long, v long"), "links")
    drop_scratch(texts)
    return links


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in text_chunks(batches):
        values, bounds = shingles(split_words(texts))
        nodes = np.repeat(ids.cast(pa.int64()).to_numpy(), np.diff(bounds))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(values.view(np.int64))], ["node", "shingle"])


def _pairs_by_rare_shingles(places: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(u, v): pairs of ``places`` (node, component) of different components, all linked ones among them.

    The shingles of a set are ordered by their number of sets. Of two sets with an overlap
    of a or more, the first common one is among the first n - a + 1 of both; a is at least
    t n for the longer set, and 2 t / (1 + t) n for the shorter.
    """
    percent = round(100 * threshold)
    texts = docs.select("doc_id", "text").join(places.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    rows = materialise(map_arrow(texts, _shingle_rows, "node long, shingle long").distinct(), "shingles")
    counted = materialise(join_salted(rows, rows.groupBy("shingle").agg(F.count("*").alias("df")), "shingle", "node"), "counted")
    sized = places.join(counted.groupBy("node").agg(F.count("*").alias("n"), F.count_if(F.col("df") == 1).alias("alone")), "node")
    ranked = counted.where("df > 1").select("node", "shingle", F.row_number().over(Window.partitionBy("node").orderBy("df", "shingle")).alias("rank"))
    least = lambda x: F.floor((x + 99 + percent) / (100 + percent)).cast("long")
    placed = ranked.join(sized, "node").withColumn("place", F.col("rank") + F.col("alone"))
    prefix = materialise(placed.where(F.col("place") <= F.col("n") - F.ceil(percent * F.col("n") / 100) + 1), "prefixes")
    shorter = prefix.where(F.col("place") <= F.col("n") - F.ceil(2 * percent * F.col("n") / (100 + percent)) + 1)
    x, y = (t.select("shingle", *(F.col(c).alias(f"{c}_{k}") for c in ("node", "component", "n", "place"))) for k, t in (("x", shorter), ("y", prefix)))
    both = join_salted(y, x, "shingle", "node_y")
    order = F.struct("n_x", "node_x") < F.struct("n_y", "node_y")
    room = 1 + F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y"))
    kept = both.where(order & (F.col("component_x") != F.col("component_y")) & (100 * F.col("n_x") >= percent * F.col("n_y")) & (room >= least(percent * (F.col("n_x") + F.col("n_y")))))
    pairs = materialise(kept.select(F.least("node_x", "node_y").alias("u"), F.greatest("node_x", "node_y").alias("v")).distinct(), "rare-pairs")
    drop_scratch(rows, counted, prefix)
    return pairs


def _pairs_in_bands(members: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: float, large_band: int) -> DataFrame:
    """Plausible pairs (u, v) of different components within a band, as a written table.

    members: (key, node, component), of which a node's bands are those it shares.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key", "n")
    members = materialise(join_salted(members, sizes, "key", "node"), "members")
    sides = nodes.select(F.col("doc_id").alias("node"), *_OWN)
    small = members.where(F.col("n") <= large_band)
    live = small.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("live"))
    full = small.join(live.join(sides, "node"), "node")
    once = F.col("key") == F.element_at(F.array_intersect("live_a", "live_b"), 1)  # a pair counts in its first common band only
    found = _side(full, "u", "a").join(_side(full, "v", "b"), "key").where((F.col("u") < F.col("v")) & (F.col("component_a") != F.col("component_b")) & _plausible(threshold) & once).select("u", "v")
    places = members.where(F.col("n") > large_band).select("node", "component").distinct()
    many = not places.isEmpty()
    if many:
        rare = _pairs_by_rare_shingles(places, docs, threshold)
        sketched = join_salted(join_salted(rare, _side(sides, "u", "a"), "u", "v"), _side(sides, "v", "b"), "v", "u")
        found = found.unionAll(sketched.where(_plausible(threshold)).select("u", "v"))
    pairs = materialise(found.distinct(), "pairs")
    drop_scratch(members, *([rare] if many else []))
    return pairs


def near_duplicates(docs: DataFrame, threshold: float = 0.75, large_band: int = LARGE_BAND) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each document of ``docs`` (doc_id, text).

    Documents are linked if 100 * intersection >= 100 * threshold * union of their shingle
    sets; component_id is the smallest doc_id that links lead to, the document itself
    included, and ``kept`` marks the documents that have their own.
    """
    signed = materialise(signatures(docs), "signatures")
    named = F.col("digest").isNotNull() & F.col("doc_id").isNotNull()
    groups = signed.where(named).groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))
    nodes = materialise(signed.join(groups.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "bands", *_OWN), "nodes")
    keys = nodes.select(F.col("doc_id").alias("node"), F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1")
    shared = materialise(shared, "bands")
    members = materialise(join_groups(keys, shared, ["key"], "n").select("key", "node", "first"), "members")
    sides = nodes.select(F.col("doc_id").alias("node"), *_OWN)
    near = materialise(members.where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v")).distinct(), "near")
    stars = materialise(join_salted(near.join(_side(sides, "v", "b"), "v"), _side(sides, "u", "a"), "u", "v").where(_plausible(threshold)).select("u", "v"), "stars")
    drop_scratch(shared, near)
    links = _confirmed(stars, docs, threshold)
    found = materialise(components(links), "components")
    placed = members.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    pairs = _pairs_in_bands(placed, nodes, docs, threshold, large_band)
    rest = materialise(pairs.join(stars, ["u", "v"], "left_anti"), "rest")
    drop_scratch(members, stars, pairs, nodes)
    if not rest.isEmpty():
        more = _confirmed(rest, docs, threshold)
        if not more.isEmpty():
            before, found = found, materialise(components(links.unionAll(more)), "components")
            drop_scratch(before)
        drop_scratch(more)
    drop_scratch(links, rest)
    classes = materialise(groups.join(found, "node", "left").select("digest", "copies", F.coalesce("component", "node").alias("component_id")), "classes")
    drop_scratch(found)
    columns = ("doc_id", "n_shingles", "component_id")
    placed = join_groups(signed.where(named).select("doc_id", "digest", "n_shingles"), classes, ["digest"], "copies").select(*columns)
    alone = signed.where(~named).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.unionAll(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
