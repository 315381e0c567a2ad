"""What is written besides reports: issues of file pairs, lists of pairs, manifests, results, logs and names of batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleyproof.functions import text as tx

NO_SOURCE, NO_TARGET = "No corresponding source file found", "No corresponding target file found"


def replace_issues(stored: DataFrame, fresh: DataFrame, checked: DataFrame) -> DataFrame:
    """Stored issues with those of the ``checked`` pairs (run_id, file_no) replaced by ``fresh`` ones; checked pairs without fresh issues have none."""
    keys = ["run_id", "file_no"]
    return stored.join(checked.select(*keys).distinct(), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def overwrite_runs(issues: DataFrame, path: str) -> None:
    """Write issues by run; only the runs at hand are overwritten. They must not be read from ``path`` itself."""
    issues.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def pairs_list(pairs: DataFrame) -> DataFrame:
    """file_no, pair_id, source_file, html_file, status of matched pairs (file_no, pair_id, source_name, target_name)."""
    return pairs.select("file_no", "pair_id", F.col("source_name").alias("source_file"), F.col("target_name").alias("html_file"), F.lit("matched").alias("status"))


def unmatched_list(unmatched: DataFrame) -> DataFrame:
    """type, side, filename, reason of files without a partner (side, filename)."""
    reason = F.when(F.col("side") == "Source", NO_TARGET).otherwise(NO_SOURCE)
    return unmatched.select(F.lit("unmatched").alias("type"), "side", "filename", reason.alias("reason"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def manifests(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(run_id, manifest): each run with its file pairs by file_no, as JSON. A run's pairs are one value, as its file is."""
    own = pairs.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("file_no", *(c for c in pairs.columns if c not in ("run_id", "file_no"))))).alias("file_pairs"))
    both = runs.join(own, "run_id", "left")
    none = F.coalesce("file_pairs", F.array().cast(own.schema["file_pairs"].dataType))
    return both.select("run_id", F.to_json(F.struct(F.struct(*runs.columns).alias("run"), none.alias("file_pairs"))).alias("manifest"))


def write_results(results: DataFrame, path: str, version: str) -> None:
    """Results as JSON lines by run, with the version of the rules."""
    results.withColumn("validator_version", F.lit(version)).write.mode("append").partitionBy("run_id").json(path)


def append_log(messages: DataFrame, path: str) -> None:
    """Append ``messages`` (ts, message) as lines of text."""
    messages.select(log_line(F.col("ts"), F.col("message")).alias("value")).write.mode("append").text(path)


def log_line(ts: Column, message: Column) -> Column:
    return F.concat(F.lit("["), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("] "), message)


def next_batch(folders: DataFrame) -> DataFrame:
    """(number): one more than the highest of ``folders`` (name) like BATCH_007_...; 1 without any."""
    found = F.regexp_extract("name", r"^BATCH_(\d{3})_", 1)
    return folders.agg((F.coalesce(F.max(F.nullif(found, F.lit("")).cast("long")), F.lit(0)) + 1).alias("number"))


def batch_name(number: Column, ts: Column, source: Column) -> Column:
    """A folder name: number, time and the source's name made safe."""
    return F.concat(F.lit("BATCH_"), F.lpad(number.cast("string"), 3, "0"), F.lit("_"), F.date_format(ts, "yyyy-MM-dd_HH-mm-ss"), F.lit("_"), tx.sanitise_name(source))


def source_package(files: DataFrame, mode: str) -> DataFrame:
    """(upload_id, name): of ``files`` (upload_id, position, name) the package that holds the sources.

    A ZIP with the mode in its stem, else any ZIP, else a file of the mode's extension,
    else the first; within these, the first by position.
    """
    stem, ext = F.lower(F.regexp_replace("name", r"(?<=.)\.[^.]*$", "")), F.lower(F.regexp_extract("name", r"(?<=.)\.[^./]*$", 0))
    is_zip = ext == ".zip"
    rank = F.when(is_zip & F.contains(stem, F.lit(mode.lower())), 0).when(is_zip, 1).when(ext == f".{mode.lower()}", 2).otherwise(3)
    return files.groupBy("upload_id").agg(F.min_by("name", F.struct(rank, "position")).alias("name"))


def target_package(files: DataFrame) -> DataFrame:
    """(upload_id, name): the first ZIP with html in its stem; empty without one."""
    low = F.lower("name")
    fits = low.rlike(r".\.zip$") & F.contains(F.regexp_replace(low, r"\.zip$", ""), F.lit("html"))
    return files.groupBy("upload_id").agg(F.coalesce(F.min_by(F.when(fits, F.col("name")), F.when(fits, F.col("position"))), F.lit("")).alias("name"))
