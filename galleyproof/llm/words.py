"""Vectorised word and shingle hashing over batches of UTF-8 texts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from galleyproof.llm.common import mix64, numbers

_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    """The first ``n`` powers of the base, or of its inverse, modulo 2**64."""
    if len(_powers[kind]) < n:
        steps = np.full(n + n // 4 + 1024, _BASE if kind == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return _powers[kind]


@dataclass(frozen=True)
class Alphabet:
    """Which bytes part words, and what each other byte counts as."""

    separators: bytes
    seed: int = 1

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        parts = np.zeros(256, bool)
        parts[np.frombuffer(self.separators, np.uint8)] = True
        values = numbers(self.seed, 256) | np.uint64(1)
        values[65:91] = values[97:123]  # A-Z count as a-z
        values[parts] = 0
        return parts, values


#: White space only: a word is a maximal run of other bytes, with A-Z lowered.
SPACES = Alphabet(b"\x20\x09\x0a\x0b\x0c\x0d")
#: All ASCII but letters and digits parts words.
LETTERS = Alphabet(bytes(i for i in range(128) if not chr(i).isalnum()))
_tables: dict[Alphabet, tuple[np.ndarray, np.ndarray]] = {}


@dataclass
class Words:
    """Words of a batch: document index, byte span within the document, hash."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray  #: word i of document d: bounds[d] <= i < bounds[d + 1]


def split_words(texts: list[bytes], alphabet: Alphabet = SPACES) -> Words:
    """All words of ``texts`` with 64-bit hashes; equal words have equal hashes anywhere."""
    if alphabet not in _tables:
        _tables[alphabet] = alphabet.tables()
    parts, values = _tables[alphabet]
    gap = alphabet.separators[:1]
    data = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=begins[1:])
    begins += 1
    apart = parts[data]
    edge = np.flatnonzero(apart[1:] != apart[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        empty = np.zeros(0, np.int64)
        return Words(empty, empty, empty, np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64))
    sums = np.add.reduceat(values[data] * _power("up", len(data))[: len(data)], start)
    hashes = mix64(sums * _power("down", len(data))[start])
    bounds = np.searchsorted(start, begins)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    return Words(doc, start - begins[doc], end - begins[doc], hashes, bounds)


def shingles(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of ``n`` consecutive words by document, and their bounds.

    A document with fewer words, but at least one, has its whole sequence as its only shingle.
    """
    factors = numbers(77, n + 1) | np.uint64(1)
    count = max(0, len(words.hash) - n + 1)
    total = np.zeros(count, np.uint64)
    for k in range(n):
        total += words.hash[k : k + count] * factors[k]
    full = words.doc[:count] == words.doc[n - 1 : n - 1 + count] if count else np.zeros(0, bool)
    value, doc = mix64(total[full]), words.doc[:count][full]
    size = np.diff(words.bounds)
    few = np.flatnonzero((size > 0) & (size < n))
    if len(few):
        short = np.array([_fold(words.hash[words.bounds[d] : words.bounds[d + 1]], factors) for d in few], np.uint64)
        value, doc = np.concatenate([value, short]), np.concatenate([doc, few])
    order = np.lexsort((value, doc)) if len(few) else None
    if order is not None:
        value, doc = value[order], doc[order]
        bounds = np.searchsorted(doc, np.arange(len(size) + 1))
    else:
        bounds = np.searchsorted(doc, np.arange(len(size) + 1))
        value = value.copy()
        for d in range(len(size)):
            value[bounds[d] : bounds[d + 1]].sort()
    if not len(value):
        return value, np.zeros(len(size) + 1, np.int64)
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(size) + 1))


def _fold(hashes: np.ndarray, factors: np.ndarray) -> np.uint64:
    total = np.zeros(1, np.uint64)
    for k, h in enumerate(hashes):
        total += h * factors[k : k + 1]
    return mix64(total + factors[-1] * np.uint64(len(hashes)))[0]
