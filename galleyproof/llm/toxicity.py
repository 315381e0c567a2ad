"""Toxicity scores from the nearest labelled examples.

Texts are TF-IDF vectors over all words and word beginnings of the examples. A term's
weight also grows with how surely it tells the classes apart (by the G statistic on the
examples) and is never zero, so that no term is left out and the many words that say
nothing do not drown the few that do. Examples with equal vectors are one entry with the
weight of its members in each class. Entries lie in blocks. Postings of the terms that few
entries have are lists; those of the others are tables, apart for terms of large and small
weights. A query sums its lists and its heavy terms; what its light terms can add is bounded
by their largest weights in each block and by the norms over groups of them. Entries that
could reach the k best so far are then scored. Sums of less than double precision only
choose: whatever comes near the k best is computed anew in double precision, so the k
nearest entries by cosine are exact. The votes of the nearest are weighted by distance and
by how many labelled rows a sampled example stands for, which keeps scores calibrated.

The examples are a bounded sample: of each class, the ``per_class`` training rows with the
smallest hash of doc_id, each with its own weight whatever it shares with others. The
vocabulary and the index follow from that bound, so both can be sent to every task; every
document is scored, whole. A text without any term of the vocabulary (null and empty ones
too) gets the share of label 1 among such examples. Without examples of both classes,
every score is the smoothed share of label 1. Ties of cosine go to the smaller example.
Extra columns are not read.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleyproof.llm.common import materialise, text_chunks
from galleyproof.session import map_arrow

_WORD = re.compile(r"[^\W\d_]+")
#: The lower-case letter of each Latin-1 character, or a space.
_LETTERS = "".join(chr(i).lower() if _WORD.match(chr(i)) else " " for i in range(256)).encode("latin-1")
#: Beginnings of a word of these many letters are terms beside the word itself.
BEGINNINGS = (4, 5, 6)
BLOCK, NEIGHBOURS = 32, 15
#: A term of this G statistic has a quarter of the weight of one that tells the classes apart beyond doubt.
HALF_G = 16.0
#: Terms whose postings are columns of tables, the heavy ones of them, groups of the light ones, and texts searched for together.
COMMON, HEAVY, GROUPS, TOGETHER = 4096, 1024, 64, 128
#: How far sums of less than double precision may be off.
ROUNDING = 1e-5
_NEAREST = "doc_id long, score double, evidence array<long>"


def terms_of(word: str) -> list[str]:
    """The terms of a lower-case word: itself, and its beginnings with a mark."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def words_of(text: str) -> Counter:
    try:
        return Counter(text.encode("latin-1").translate(_LETTERS).decode("latin-1").split())
    except UnicodeEncodeError:
        return Counter(_WORD.findall(text.lower()))


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            terms = sorted({t for w in words_of(text or "") for t in terms_of(w)})
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([y] * len(terms), pa.int32())], ["term", "y"])


def term_counts(examples: DataFrame) -> tuple[list[str], np.ndarray]:
    """All terms of the examples, sorted, and how many examples of class 0 and 1 have each, one row a class."""
    pairs = map_arrow(examples.select("y", "text"), _example_terms, "term string, y int")
    counts = pairs.groupBy("term").agg(F.sum(F.lit(1) - F.col("y")).alias("d0"), F.sum("y").alias("d1")).toArrow().sort_by("term")
    return counts["term"].to_pylist(), np.stack([counts["d0"].to_numpy(), counts["d1"].to_numpy()]).astype(float)


def evidence(seen: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A factor above 0 and below 1 for each term: how surely it tells the classes apart. seen: examples with it, one row a class."""
    total = seen.sum(axis=0)
    g = np.zeros(len(total))
    for own, n in zip(seen, sizes, strict=True):
        for part, expected in ((own, total * n / sizes.sum()), (n - own, (sizes.sum() - total) * n / sizes.sum())):
            g += 2 * np.where(part > 0, part * np.log(np.maximum(part, 1) / np.maximum(expected, 1e-300)), 0)
    g = np.maximum(g, 0) + 0.1
    return (g / (g + HALF_G)) ** 2


@dataclass
class Vectors:
    """Sparse unit vectors over the terms."""

    index: dict[str, int]
    idf: np.ndarray  #: with the evidence of each term
    slots: dict[str, int] = field(default_factory=dict)  #: words met so far; those in slot 0 have no terms
    bounds: array = field(default_factory=lambda: array("q", [0, 0]))  #: bounds of the terms of each slot
    of_slot: array = field(default_factory=lambda: array("q"))

    def forget(self) -> None:
        self.slots, self.bounds, self.of_slot = {}, array("q", [0, 0]), array("q")

    def _meet(self, word: str) -> int:
        """The slot of a word not met before. The vocabulary has all beginnings of its words, so where one is missing there is nothing longer."""
        of, known, before = self.index.get, self.of_slot, len(self.of_slot)
        for n in BEGINNINGS:
            if len(word) <= n:
                term = of(word)
                break
            if (term := of(word[:n] + "*")) is None:
                break
            known.append(term)
        else:
            term = of(word)
        if term is not None:
            known.append(term)
        slot = 0
        if len(known) > before:
            slot = len(self.bounds) - 1
            self.bounds.append(len(known))
        self.slots[word] = slot
        return slot

    def counts_of_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, occurrences), by text and term."""
        if len(self.slots) > 300_000:
            self.forget()
        words: list[int] = []
        times: list[int] = []
        sizes = []
        for text in texts:
            found = words_of(text)
            own = list(map(self.slots.get, found))
            if None in own:
                own = [self._meet(word) if slot is None else slot for word, slot in zip(found, own, strict=True)]
            sizes.append(len(own))
            words += own
            times += found.values()
        slot, bounds = np.array(words, np.int64), np.asarray(self.bounds)
        each = bounds[slot + 1] - bounds[slot]
        term = np.asarray(self.of_slot)[_ranges(bounds[slot], each)]
        text = np.repeat(np.repeat(np.arange(len(texts)), sizes), each)
        # text, term and occurrences are sorted as one number, for which 63 bits suffice (7, 25 and 31 at most)
        low = max(times, default=1).bit_length()
        key = np.sort((text * len(self.idf) + term << low) + np.repeat(np.array(times, np.int64), each))
        owner = key >> low
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        total = np.add.reduceat(key & (1 << low) - 1, first) if len(first) else first
        return owner[first] // max(1, len(self.idf)), owner[first] % max(1, len(self.idf)), total

    def counts(self, text: str) -> dict[int, int]:
        """Occurrences of each term."""
        _, term, times = self.counts_of_all([text])
        return dict(zip(term.tolist(), times.tolist(), strict=True))

    def units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, weight) of the texts' unit vectors."""
        text, term, times = self.counts_of_all(texts)
        weight = (1 + np.log(times)) * self.idf[term]
        norm = np.sqrt(np.bincount(text, weights=weight * weight, minlength=len(texts)))
        return text, term, weight / norm[text]

    def unit(self, counts: dict[int, int] | tuple[tuple[int, int], ...]) -> tuple[np.ndarray, np.ndarray]:
        counts = dict(counts)
        ids = np.fromiter(counts, np.int64, len(counts))
        order = np.argsort(ids)
        ids = ids[order]
        weight = (1 + np.log(np.fromiter(counts.values(), float, len(counts))[order])) * self.idf[ids]
        return ids, weight / np.sqrt((weight * weight).sum())


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... (sizes[i] numbers), one after another."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _group_norms(table: np.ndarray) -> np.ndarray:
    """The norms of each row over each of ``GROUPS`` groups, into which the columns are dealt in turn."""
    parted = table.reshape(len(table), -1, GROUPS)
    return np.sqrt(np.einsum("ijk,ijk->ik", parted, parted))


@dataclass
class BlockMaxIndex:
    """Entries by descending main term in blocks, and their postings.

    The ``COMMON`` terms that most entries have are columns of tables: the ``HEAVY`` ones of
    the largest sums of squared weights apart, and the light ones with their largest weight in
    each block and the norms of each entry over ``GROUPS`` groups of them. The postings of all
    other terms are lists.
    """

    factors: np.ndarray  #: of the terms
    bounds: np.ndarray  #: bounds of the postings of each entry
    term: np.ndarray
    weight: np.ndarray
    votes: np.ndarray  #: (entries, 2)
    example: np.ndarray  #: smallest doc_id of each entry
    size: int

    @classmethod
    def of(cls, vectors: Vectors, entries: dict[tuple, tuple[float, float, int]]) -> BlockMaxIndex:
        return cls.of_units(vectors.idf, [(vectors.unit(c), v) for c, v in entries.items()])

    @classmethod
    def of_units(cls, factors: np.ndarray, units: list[tuple[tuple[np.ndarray, np.ndarray], tuple[float, float, int]]]) -> BlockMaxIndex:
        # like entries in the same blocks, so that few blocks have high bounds
        units = sorted(units, key=lambda u: (int(u[0][0][np.argmax(u[0][1])]), -float(u[0][1].max()), u[1][2]))
        n = len(units)
        sizes = np.array([len(u[0][0]) for u in units], np.int64)
        term = np.concatenate([u[0][0] for u in units]).astype(np.int32) if units else np.zeros(0, np.int32)
        weight = np.concatenate([u[0][1] for u in units]).astype(np.float32) if units else np.zeros(0, np.float32)
        votes = np.array([u[1][:2] for u in units]).reshape(n, 2)
        return cls(factors, np.concatenate([[0], np.cumsum(sizes)]), term, weight, votes, np.array([u[1][2] for u in units], np.int64), n)

    @property
    def terms(self) -> int:
        return len(self.factors)

    @property
    def blocks(self) -> int:
        return -(-self.size // BLOCK)

    def __post_init__(self) -> None:
        self.ready = False

    def prepare(self) -> None:
        """Move the postings into tables and lists."""
        owner = np.repeat(np.arange(self.size, dtype=np.int32), np.diff(self.bounds))
        often = np.argsort(-np.bincount(self.term, minlength=self.terms), kind="stable")[:COMMON]
        squares = np.bincount(self.term, weights=self.weight.astype(float) ** 2, minlength=self.terms)
        often = often[np.argsort(-squares[often], kind="stable")]
        #: the column of each term, those of the heavy ones first, or -1
        self.place = np.full(self.terms, -1)
        self.place[often] = np.arange(len(often))
        column = self.place[self.term]
        rare = np.flatnonzero(column < 0)
        rare = rare[np.argsort(self.term[rare], kind="stable")]
        #: postings of the terms without a column: their bounds by term, and entry and weight in one number, as they are read at random
        self.lists = np.searchsorted(self.term[rare], np.arange(self.terms + 1)), np.stack([owner[rare], self.weight[rare].view(np.int32)], axis=1).view(np.int64)[:, 0]
        #: entries x terms
        self.heavy, self.light = (np.zeros((self.blocks * BLOCK, n), np.float32) for n in (HEAVY, COMMON - HEAVY))
        for table, first in ((self.heavy, 0), (self.light, HEAVY)):
            own = np.flatnonzero((column >= first) & (column < first + table.shape[1]))
            table[owner[own], column[own] - first] = self.weight[own]
        #: entries x groups, into which the light terms are dealt in turn
        self.light_norms = _group_norms(self.light)
        #: blocks x light terms
        self.maxima = self.light.reshape(self.blocks, BLOCK, -1).max(axis=1)
        self.term, self.weight = self.term[:0].copy(), self.weight[:0].copy()
        self.ready = True

    def nearest(self, ids: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The ``k`` entries of the highest positive cosine: (cosine, entry), best first."""
        return self.nearest_of_all(np.zeros(len(ids), np.int64), ids, weights, 1, k)[0]

    def nearest_of_all(self, query: np.ndarray, ids: np.ndarray, weights: np.ndarray, n: int, k: int) -> list[list[tuple[float, int]]]:
        """``nearest`` for ``n`` queries, whose terms are (query, ids, weights) sorted by query."""
        if not self.size:
            return [[] for _ in range(n)]
        if not self.ready:
            self.prepare()
        wide, column = self.blocks * BLOCK, self.place[ids]
        asked = np.zeros((n, COMMON), np.float32)
        often = column >= 0
        asked[query[often], column[often]] = weights[often]
        heavy, light = asked[:, :HEAVY], asked[:, HEAVY:]
        sums = heavy @ self.heavy.T
        # what light terms can add to a block and to an entry
        to_block, to_entry = light @ self.maxima.T, _group_norms(light) @ self.light_norms.T
        starts, postings = self.lists
        rare = np.flatnonzero(~often)
        begins = starts[ids[rare]]
        sizes = starts[ids[rare] + 1] - begins
        parts = np.searchsorted(query[rare], np.arange(n + 1))
        kth = min(k, wide)
        out = []
        for q in range(n):
            own = slice(parts[q], parts[q + 1])
            found = postings[_ranges(begins[own], sizes[own])].view(np.int32)
            listed = np.bincount(found[::2], weights=np.repeat(weights[rare[own]], sizes[own]) * found[1::2].view(np.float32), minlength=wide)
            known = sums[q]
            known += listed
            least = max(np.partition(known, -kth)[-kth], ROUNDING) - ROUNDING
            most = np.minimum(np.repeat(to_block[q], BLOCK), to_entry[q])
            most += known
            some, terms = np.flatnonzero(most[: self.size] >= least), np.flatnonzero(light[q])
            added = self.light.take(some[:, None] * self.light.shape[1] + terms)
            if len(some) > k:
                total = known[some] + added @ light[q, terms]
                best = total + ROUNDING >= np.partition(total, -k)[-k]
                some, added = some[best], added[best]
            # in double precision
            exact = np.round(listed[some] + self.heavy[some].astype(float) @ heavy[q].astype(float) + added.astype(float) @ light[q, terms].astype(float), 9)
            best = np.lexsort((self.example[some], -exact))[:k]
            out.append([(float(exact[e]), int(some[e])) for e in best if exact[e] > 0])
        return out


@dataclass
class Classifier:
    vectors: Vectors
    index: BlockMaxIndex
    without_terms: float  #: the share of label 1 among examples without terms
    prior: float
    memo: dict = field(default_factory=dict)

    def classify(self, text: str) -> tuple[float, list[int]]:
        return self.classify_all([text])[0]

    def classify_all(self, texts: list[str]) -> list[tuple[float, list[int]]]:
        """(score, doc_ids of the nearest examples) of each text; equal texts are searched for once."""
        keys = [xxhash.xxh3_128_digest(t.encode("utf-8", "replace")) for t in texts]
        fresh = {key: t for key, t in zip(keys, texts, strict=True) if key not in self.memo}
        known = {key: self.memo[key] for key in keys if key in self.memo}
        waiting = list(fresh)
        for at in range(0, len(waiting), TOGETHER):
            some = waiting[at : at + TOGETHER]
            query, ids, weights = self.vectors.units([fresh[key] for key in some])
            found = self.index.nearest_of_all(query, ids, weights, len(some), NEIGHBOURS)
            filled = np.bincount(query, minlength=len(some)) > 0
            known.update((key, self._voted(near) if any_term else (self.without_terms, [])) for key, near, any_term in zip(some, found, filled, strict=True))
        if len(self.memo) > 100_000:
            self.memo.clear()
        self.memo.update((key, known[key]) for key in waiting)
        return [known[key] for key in keys]

    def _voted(self, near: list[tuple[float, int]]) -> tuple[float, list[int]]:
        clean, marked = 0.5 * (1 - self.prior), 0.5 * self.prior
        for cosine, entry in near:
            v0, v1 = self.index.votes[entry].tolist()
            clean += v0 * cosine**3 / (0.05 + 1 - min(1.0, cosine))
            marked += v1 * cosine**3 / (0.05 + 1 - min(1.0, cosine))
        return marked / (clean + marked), [int(self.index.example[e]) for _, e in near[:3]]


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", train: Column | None = None, per_class: int = 3000) -> Classifier:
    """Fit on a sample of at most 2 x ``per_class`` rows of ``labels`` (doc_id, ``label``) that satisfy ``train``."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).where(F.lit(True) if train is None else train).select("doc_id", F.col(label).cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = (F.xxhash64("doc_id"), "doc_id")
    sample = rows.where("y = 0").orderBy(*order).limit(per_class).unionAll(rows.where("y = 1").orderBy(*order).limit(per_class))
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    examples = materialise(found, "examples")
    taken = {r["y"]: r["n"] for r in examples.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    prior = (n1 + 1) / (n0 + n1 + 2)
    stands = {y: sizes[y] / n for y, n in taken.items()}
    terms, seen = term_counts(examples) if len(taken) == 2 else ([], np.zeros((2, 0)))
    total = n0 + n1
    idf = np.zeros(0)
    if terms:
        idf = np.log((1 + total) / (1 + sum(seen[y] * stands[y] for y in taken))) + 1
        idf *= evidence(seen, np.array([taken[0], taken[1]], float))
    vectors = Vectors({t: i for i, t in enumerate(terms)}, idf)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(vectors.counts(t or "").items()) for t in batch.column(2).to_pylist()]
            lists = [pa.array([[p[k] for p in c] for c in found], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["doc_id", "y", "terms", "times"])

    entries: dict[bytes, tuple[tuple[np.ndarray, np.ndarray], tuple[float, float, int]]] = {}
    plain = [prior, 1.0]  # label 1 and all, among examples without terms
    counted = map_arrow(examples.select("doc_id", "y", "text"), count, "doc_id long, y int, terms array<int>, times array<int>")
    for batch in counted.toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")]).to_batches() if terms else []:  # 2 x per_class rows at most
        for doc_id, y, ids, times in zip(*(batch.column(i) for i in range(4)), strict=True):
            doc_id, y, ids, times = doc_id.as_py(), y.as_py(), ids.values.to_numpy(), times.values.to_numpy()
            weight = stands[y]
            if not len(ids):
                plain = [plain[0] + weight * y, plain[1] + weight]
                continue
            key = xxhash.xxh3_128_digest(ids.tobytes() + times.tobytes())
            unit, (v0, v1, first) = entries.get(key) or (vectors.unit(dict(zip(ids.tolist(), times.tolist(), strict=True))), (0.0, 0.0, doc_id))
            entries[key] = unit, (v0 + weight * (1 - y), v1 + weight * y, min(first, doc_id))
    vectors.forget()
    return Classifier(vectors, BlockMaxIndex.of_units(idf, list(entries.values())), plain[0] / plain[1], prior)


def scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", train: Column | None = None, per_class: int = 3000) -> DataFrame:
    """(doc_id, score, evidence) of each row of ``docs`` (doc_id, text); evidence: doc_ids of the nearest examples."""
    model = learn(docs, labels, label, train, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_chunks(batches):
            found = model.classify_all([t.decode("utf-8", "replace") for t in texts])
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], pa.list_(pa.int64()))], ["doc_id", "score", "evidence"])

    return map_arrow(docs.select("doc_id", "text"), run, _NEAREST)
