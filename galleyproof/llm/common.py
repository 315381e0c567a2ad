"""Shared helpers: scratch tables in the shared folder, and Arrow batches of texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a Python task, so that memory stays bounded.
CHUNK_BYTES = 2_000_000


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        shared = tempfile.mkdtemp(prefix="galleyproof-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/galleyproof/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage in a way that outlives any executor, and the reader prunes columns.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def drop_scratch(*tables: DataFrame) -> None:
    """Delete what ``materialise`` wrote, once nothing reads it any more."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(table.scratch)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, parts: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, which has one row for each key and the group's ``size``.

    Groups that hold a ``parts``-th of all rows or more, of which there are ``parts`` at
    most, are broadcast, so that the rows of a hot key stay where they are.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) * parts >= total
    few = F.broadcast(groups.where(hot))
    return rows.join(few, keys).unionByName(rows.join(few.select(*keys), keys, "left_anti").join(groups.where(~hot), keys))


def join_salted(rows: DataFrame, others: DataFrame, key: str, spread: str, least: int = 10_000, most: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with ``others`` on ``key``, with the rows of hot keys split.

    The ``most`` largest of the keys that have ``least`` rows or more get a share for each
    ``least`` rows: their rows are dealt out by a hash of ``spread``, and their ``others``
    are repeated for each share, which is one repetition for ``least`` rows. Any other key
    has less than a ``most``-th of all rows.
    """
    hot = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).orderBy(F.desc("_n"), key).limit(most).collect()
    if not hot:
        return rows.join(others, key)
    shares = F.broadcast(rows.sparkSession.createDataFrame([(r[key], -(-r["_n"] // least)) for r in hot], f"`{key}` {rows.schema[key].dataType.simpleString()}, _shares int"))
    dealt = rows.join(shares, key, "left").withColumn("_share", F.pmod(F.xxhash64(spread), F.coalesce("_shares", F.lit(1))).cast("int")).drop("_shares")
    repeated = others.join(shares, key, "left").withColumn("_share", F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1))).drop("_shares")
    return dealt.join(repeated, [key, "_share"]).drop("_share")


def text_chunks(
    batches: Iterator[pa.RecordBatch], ids: str = "doc_id", text: str = "text", limit: int = CHUNK_BYTES
) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Yield (ids, UTF-8 texts) in chunks of about ``limit`` bytes; a null text is empty."""
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index(ids))
        texts = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
        start, size, held = 0, 0, []
        for value in texts:
            data = value.as_py() or b""
            held.append(data)
            size += len(data)
            if size >= limit:
                yield keys.slice(start, len(held)), held
                start, size, held = start + len(held), 0, []
        if held:
            yield keys.slice(start, len(held)), held


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random unsigned 64-bit numbers; the same on every machine."""
    return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003)) * np.uint64(0x9E3779B97F4A7C15))
