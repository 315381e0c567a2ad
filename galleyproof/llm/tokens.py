"""Token counts from a digest cache.

Each text is reduced to a digest of its normalised content; the cache stores counts by
(content digest, tokenizer digest). Only distinct digests that the cache lacks are
encoded, and their counts are appended to it, so copies and repeated runs cost a join.

Null text is empty and has no tokens. Rows with equal texts share one cache row. An empty
table appends nothing. Extra columns are not read; a null doc_id keeps its row.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleyproof.llm.common import join_groups, materialise, scratch_path, text_chunks
from galleyproof.session import map_arrow

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
_CACHE = "digest binary, tokenizer string, n_tokens long"


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_digest(path: str) -> str:
    """Names a tokenizer version: any change of its file makes old counts invalid."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


@cache
def load_counter(path: str):
    """A function from texts to token counts, by the library that the file belongs to."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _counter(path: str, version: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = load_counter(path)
        for digests, texts in text_chunks(batches, "digest", "text"):
            n = counts([x.decode("utf-8", "replace") for x in texts])
            yield pa.RecordBatch.from_arrays([digests.cast(pa.binary()), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], ["digest", "tokenizer", "n_tokens"])

    return count


def content_digest(text: str | Column, normalise=lambda c: c) -> Column:
    """SHA-256 of the normalised text. The default normaliser only makes null empty:
    a byte-level tokenizer tells every other difference apart."""
    return F.unhex(F.sha2(normalise(F.coalesce(text, F.lit(""))), 256))


def cached_counts(spark, cache_path: str, version: str) -> DataFrame:
    """Cached (digest, n_tokens) of one tokenizer version, one row a digest; empty without a cache."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache_path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    rows = spark.read.schema(_CACHE).parquet(cache_path) if there else spark.createDataFrame([], _CACHE)
    return rows.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, cache_path: str | None = None, tokenizer: str | None = None, limit: int = 512, normalise=lambda c: c) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of ``docs`` (doc_id, text).

    cache_path: a Parquet folder that outlives this call; by default a new one in the
    shared folder. tokenizer: path of a tokenizers .json or sentencepiece .model file.
    """
    spark = docs.sparkSession
    path = tokenizer or tokenizer_path()
    version = tokenizer_digest(path)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", content_digest("text", normalise))
    known = None
    if cache_path is None:
        cache_path = scratch_path(spark, "token-cache")
    else:
        known = cached_counts(spark, cache_path, version)
    wanted = keyed if known is None or known.isEmpty() else keyed.join(known, "digest", "left_anti")
    misses = wanted.groupBy("digest").agg(F.first("text").alias("text"))
    map_arrow(misses, _counter(path, version), _CACHE).write.mode("append").parquet(cache_path)
    rows = materialise(keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "digests")
    copies = rows.groupBy("digest").agg(F.count("*").alias("copies"))
    counts = materialise(copies.join(cached_counts(spark, cache_path, version), "digest"), "counts")
    return join_groups(rows, counts, ["digest"], "copies").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
