"""Pairing of sources with targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(side: DataFrame, key: str = "key", order: str = "file_id") -> DataFrame:
    """Files with their position among those of the same key."""
    return side.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("long"))


def pair_files(sources: DataFrame, targets: DataFrame, key: str = "key") -> DataFrame:
    """(key, position, source_id, target_id): the n-th source of a key with its n-th target."""
    a = numbered(sources).select(key, "position", F.col("file_id").alias("source_id"))
    b = numbered(targets).select(key, "position", F.col("file_id").alias("target_id"))
    return a.join(b, [key, "position"])


def unmatched_files(sources: DataFrame, targets: DataFrame, key: str = "key") -> DataFrame:
    """(side, key, file_id) of the files that ``pair_files`` leaves over."""
    a, b = numbered(sources), numbered(targets)
    left = a.join(b, [key, "position"], "left_anti").select(F.lit("Source").alias("side"), key, "file_id")
    right = b.join(a, [key, "position"], "left_anti").select(F.lit("Target").alias("side"), key, "file_id")
    return left.unionByName(right)


def key_sets(sources: DataFrame, targets: DataFrame, key: str = "key") -> DataFrame:
    """(key, where): each key with the sides that have it."""
    a, b = sources.select(key).distinct(), targets.select(key).distinct()
    parts = (("both", a.intersect(b)), ("source only", a.exceptAll(b)), ("target only", b.exceptAll(a)))
    frames = [f.withColumn("where", F.lit(name)) for name, f in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])
