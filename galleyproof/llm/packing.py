"""Packing documents into fixed-length training sequences.

Each task reads its documents in order as one stream of token ids and chooses where to
cut it into windows of at most ``length`` tokens. A dynamic programme over possible cuts
(ends of documents, ends of sentences and, inside very long sentences, every few tokens)
minimises padding plus a penalty for each cut that is not at the end of a document:

    cost(j) = penalty(j) + length - position(j) + min(cost(i) + position(i))

over all i with position(j) - position(i) <= length. The minimum slides forward, so a
monotone queue keeps it in constant time a cut. A window of half or a quarter of the
length is a power of two and needs no padding; it is one more choice for j, at the price
of a short sequence. Nothing is shuffled, memory is bounded by ``HORIZON`` tokens and
the longest document, and a task that is run again gives the same sequences.

Null text is an empty document of the end id alone. Documents of a task keep their order.
Repeated doc_ids are packed as separate documents; extra columns are not read.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from galleyproof.llm.common import text_chunks
from galleyproof.llm.tokens import tokenizer_path
from galleyproof.session import map_arrow

LENGTH = 2048
END_ID = 1
#: What a cut costs, in tokens of padding: at the end of a sentence, inside a sentence, and for a short sequence.
SENTENCE_PENALTY, INSIDE_PENALTY, SHORT_PENALTY = 24, 96, 48
#: A gap of more tokens than this between possible cuts gets cuts inside, this many tokens apart.
LONG_GAP, INSIDE_STEP = 256, 64
#: Tokens that a task holds before it settles the cuts so far.
HORIZON = 400_000

_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


@cache
def load_encoder(path: str, ranks_path: str | None):
    """A function from UTF-8 texts to arrays of the tokenizer's ids.

    With ``ranks_path`` (the same vocabulary as ranks), texts of characters below U+0240
    without special strings go through a faster library that gives the same ids; all
    others, for which the two could differ, are left to the tokenizer itself.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def exact(text: str) -> np.ndarray:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    if not ranks_path:
        return lambda data: exact(data.decode("utf-8", "replace"))
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(data: bytes) -> np.ndarray:
        if not data:
            return np.zeros(0, np.uint32)
        text = data.decode("utf-8", "replace")
        if b"<|" in data or np.frombuffer(data, np.uint8).max() > 0xC8:
            return exact(text)
        return np.asarray(fast.encode_to_numpy(text), np.uint32)

    return encode


@cache
def sentence_ends(path: str) -> np.ndarray:
    """Whether each token id ends a sentence or a line."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    texts = (tokenizer.decode([i], skip_special_tokens=False) for i in range(tokenizer.get_vocab_size()))
    return np.array([x.rstrip(" \"')").endswith((".", "!", "?", "\n")) for x in texts])


def possible_cuts(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the stream may be cut, and their penalties; the first position is 0."""
    sentence = np.flatnonzero(ends[np.minimum(ids, len(ends) - 1)]) + 1
    position = np.unique(np.concatenate([[0, len(ids)], sentence, doc_ends]))
    gaps, step = np.flatnonzero(np.diff(position) > min(LONG_GAP, length)), min(INSIDE_STEP, length)
    inside = [np.arange(position[g] + step, position[g + 1], step) for g in gaps]
    penalty = np.full(len(position), SENTENCE_PENALTY)
    penalty[np.searchsorted(position, doc_ends)] = 0
    penalty[0] = penalty[-1] = 0
    if inside:
        extra = np.concatenate(inside)
        position, penalty = np.concatenate([position, extra]), np.concatenate([penalty, np.full(len(extra), INSIDE_PENALTY)])
        order = np.argsort(position, kind="stable")
        position, penalty = position[order], penalty[order]
    return position, penalty


def best_cuts(position: np.ndarray, penalty: np.ndarray, length: int = LENGTH) -> list[int]:
    """The cheapest cuts from the first to the last position, both included."""
    where, prices = position.tolist(), penalty.tolist()
    n = len(where)
    cost, back = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque()  # (cost + position, index), both rising
    halves = []
    for short in (length // 2, length // 4):
        at = np.searchsorted(position, position - short)
        halves.append(np.where(position[at] == position - short, at, -1).tolist())
    first, second = halves
    for j in range(1, n):
        value = cost[j - 1] + where[j - 1]
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j - 1))
        least = where[j] - length
        while where[queue[0][1]] < least:
            queue.popleft()
        best, i = queue[0][0] + length - where[j], queue[0][1]
        for k in (first[j], second[j]):
            if k >= 0 and cost[k] + SHORT_PENALTY < best:
                best, i = cost[k] + SHORT_PENALTY, k
        cost[j], back[j] = best + prices[j], i
    cuts, j = [where[-1]], n - 1
    while j:
        j = back[j]
        cuts.append(where[j])
    return cuts[::-1]


class _Stream:
    """Token ids of consecutive documents of one task, and what has been cut from them."""

    def __init__(self, ends: np.ndarray, length: int):
        self.ends, self.length, self.sequence = ends, length, TaskContext.get().partitionId() << 40
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple[int | None, int, int]] = []  # doc_id, ids before the held part, ids in all
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.docs.append((doc_id, 0, len(ids)))
        self.size += len(ids)

    def settle(self, last: bool) -> pa.RecordBatch:
        """Pieces of all windows but the last, which later documents may still fill; at the end, of all."""
        ids = np.concatenate(self.ids)
        starts = np.cumsum([0] + [len(x) for x in self.ids])
        cuts = np.array(best_cuts(*possible_cuts(ids, starts[1:], self.ends, self.length), self.length))
        if not last:
            cuts = cuts[:-1]
        done = int(cuts[-1])
        edges = np.union1d(cuts, starts[starts < done])
        begin, size = edges[:-1], np.diff(edges)
        doc = np.searchsorted(starts, begin, side="right") - 1
        window = np.searchsorted(cuts, begin, side="right") - 1
        before = np.array([d[1] for d in self.docs], np.int64)
        data = pa.py_buffer(ids[:done].astype("<u4").tobytes())
        pieces = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer((edges * 4).astype(np.int32).tobytes()), data])
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([self.docs[d][0] for d in doc], pa.int64()),
                pa.array(begin - starts[doc] + before[doc], pa.int64()),
                pa.array(size, pa.int64()),
                pieces,
                pa.array([self.docs[d][2] for d in doc], pa.int64()),
                pa.array(window + self.sequence, pa.int64()),
                pa.array(begin - cuts[window], pa.int64()),
            ],
            ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )
        self.sequence += len(cuts) - 1
        keep = int(np.searchsorted(starts, done, side="right")) - 1
        cut_off = done - int(starts[keep])
        rest = self.ids[keep:] if keep < len(self.ids) else []
        docs = self.docs[keep:]
        if rest:
            rest[0] = rest[0][cut_off:]
            docs[0] = (docs[0][0], docs[0][1] + cut_off, docs[0][2])
        self.ids, self.docs, self.size = rest, docs, len(ids) - done
        return out


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, ranks: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of ``docs`` (doc_id, text).

    ids: the piece's token ids as little-endian unsigned 32-bit numbers. doc_tokens: the
    document's ids in all, its end id included. Sequences are numbered uniquely but with
    gaps; offset is the piece's place in its sequence. length: a power of two.
    tokenizer: path of a tokenizers .json file; ranks: the same vocabulary as a tiktoken file.
    """
    if tokenizer is None:
        tokenizer, ranks = tokenizer_path(), tokenizer_path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(tokenizer, ranks)
        stream = _Stream(sentence_ends(tokenizer), length)
        for ids, texts in text_chunks(batches):
            for doc_id, text in zip(ids.to_pylist(), texts, strict=True):
                stream.add(doc_id, np.append(encode(text), np.uint32(end_id)))
                if stream.size >= HORIZON:
                    yield stream.settle(last=False)
        if stream.size:
            yield stream.settle(last=True)

    return map_arrow(docs.select("doc_id", "text"), run, _PIECES)
