"""Uploaded files, in batches or as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galleyproof.sources import packages

#: The schema of Spark's reader of binary files, which streams need stated.
SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def accepted(files: DataFrame) -> DataFrame:
    """Files of the known kinds, with their extension."""
    return files.withColumn("ext", packages.extension(F.col("path"))).where(F.col("ext").isin(*packages.EXTENSIONS))


def rejected(files: DataFrame) -> DataFrame:
    return files.where(~packages.extension(F.col("path")).isin(*packages.EXTENSIONS)).select("path")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(path, relpath, ext, content) of all accepted files below ``folder``; contents are read only where they are used."""
    files = accepted(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder))
    below = F.regexp_replace("path", F.lit(f"^.*?{folder.rstrip('/').rsplit('/', 1)[-1]}/"), F.lit(""))
    return files.select("path", packages.safe_relpath(below).alias("relpath"), "ext", "content")


def ingest_new(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Give each batch of files that have come since the last call to ``handle`` (files, batch number).

    A batch that fails comes again; ``handle`` writes by batch number, so that it counts once.
    """
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", True).load(folder)
    query = accepted(files).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
