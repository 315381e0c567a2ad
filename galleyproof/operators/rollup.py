"""Counts and views over runs, file pairs, issues and users."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def run_counts(pairs: DataFrame) -> DataFrame:
    """Ten counts for each run, and the status that follows from them."""
    done = F.col("status") == "done"
    total = lambda c: F.sum(F.when(done, F.col(c)).otherwise(0)).cast("long").alias(c)
    counted = pairs.groupBy("run_id").agg(
        F.count("*").alias("total_files"),
        F.count_if(F.col("status").isin("done", "error", "interrupted")).alias("completed_files"),
        F.count_if(F.col("status") == "running").alias("running_files"),
        F.count_if(done & (F.col("issue_count") == 0)).alias("passed_files"),
        F.count_if(done & (F.col("issue_count") > 0)).alias("failed"),
        total("critical_count"),
        total("major_count"),
        total("minor_count"),
        F.count_if(F.col("status") == "error").alias("error_files"),
        F.count_if(F.col("status") == "interrupted").alias("interrupted_files"),
    )
    complete = F.col("completed_files") >= F.col("total_files")
    status = F.when(complete & (F.col("interrupted_files") > 0), "interrupted").when(complete & (F.col("error_files") > 0), "failed").when(complete, "done").when(F.col("running_files") > 0, "running").otherwise("prepared")
    return counted.withColumn("status", status).withColumn("failed_files", F.col("failed") + F.col("error_files")).drop("failed")


def interrupt(runs: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs and pairs as a restart finds them: what was running or queued is interrupted, and so are prepared runs with such pairs."""
    open_ = F.col("status").isin("running", "queued")
    after = pairs.withColumn("status", F.when(open_, "interrupted").otherwise(F.col("status")))
    broken = after.where("status = 'interrupted'").select("run_id").distinct().withColumn("_hit", F.lit(True))
    waiting = F.col("status").isin("prepared", "uploaded") & F.coalesce("_hit", F.lit(False))
    return runs.join(broken, "run_id", "left").withColumn("status", F.when(open_ | waiting, "interrupted").otherwise(F.col("status"))).drop("_hit"), after


def user_runs(users: DataFrame, runs: DataFrame) -> DataFrame:
    """Users with counts of their runs: all, completed, and those with problems."""
    counted = runs.groupBy("user_id").agg(F.count("*").alias("total_runs"), F.count_if(F.col("status") == "done").alias("completed_runs"), F.count_if(F.col("status").isin("failed", "error", "interrupted")).alias("problem_runs"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total_runs", "completed_runs", "problem_runs")]
    return users.join(counted, users["id"] == counted["user_id"], "left").select("id", "username", "role", *zero)


def newest(rows: DataFrame, at: str, key: str, limit: int) -> DataFrame:
    """The latest rows; ties by key, so that the cut is the same each time."""
    return rows.orderBy(F.desc(at), F.desc(key)).limit(limit)


def runs_with_users(runs: DataFrame, users: DataFrame) -> DataFrame:
    return runs.join(users.select(F.col("id").alias("user_id"), "username"), "user_id")


def visible_to(rows: DataFrame, users: DataFrame, user_id: int) -> DataFrame:
    """The user's own rows; for an admin, all."""
    viewer = users.where((F.col("id") == user_id) & (F.col("status") == "active")).select(F.col("id").alias("_viewer"), F.col("role").alias("_role"))
    return rows.join(F.broadcast(viewer), (F.col("user_id") == F.col("_viewer")) | (F.col("_role") == "admin"), "left_semi")


def admin_summary(users: DataFrame, invites: DataFrame, resets: DataFrame, runs: DataFrame) -> DataFrame:
    """One row of totals."""
    status = F.col("status")
    parts = (
        users.agg(F.count("*").alias("users"), F.count_if(status == "active").alias("active_users")),
        invites.agg(F.count_if(status == "pending").alias("pending_invites")),
        resets.agg(F.count_if(status.isin("requested", "link_generated")).alias("pending_resets")),
        runs.agg(F.count("*").alias("runs"), F.count_if(status == "done").alias("completed_runs"), F.count_if(status.isin("failed", "error")).alias("failed_runs"), F.count_if(status == "interrupted").alias("interrupted_runs"), F.coalesce(F.sum("critical_count").cast("long"), F.lit(0)).alias("critical_issues")),
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, F.lit(True))  # one row on each side
    return out


def stored_results(pairs: DataFrame, issues: DataFrame) -> DataFrame:
    """File pairs with the ``result`` that reports show and their ``issues`` as an array in order of issue_id."""
    own = issues.groupBy("run_id", "file_no").agg(F.sort_array(F.collect_list(F.struct("issue_id", "category", "engine_severity", "line"))).alias("issues"))
    done = F.col("status") == "done"
    result = F.when(done & (F.coalesce("issue_count", F.lit(0)) == 0), "Passed").when(done, "Failed").otherwise(F.col("status"))
    return pairs.join(own, ["run_id", "file_no"], "left").withColumn("result", result)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (with run_id) with QA ids: QA-0001 and on, in each run."""
    n = F.row_number().over(Window.partitionBy("run_id").orderBy(*order))
    return rows.withColumn("qa_id", F.format_string("QA-%04d", n))


def idle_sessions(events: DataFrame, idle_seconds: int = 1800) -> DataFrame:
    """(user_id, session, first_ts, last_ts, events): a gap of more than ``idle_seconds`` whole seconds starts a session."""
    w = Window.partitionBy("user_id").orderBy("second", "event_id")
    seconds = events.withColumn("second", F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp"))))
    fresh = F.coalesce((F.col("second") - F.lag("second").over(w) > idle_seconds).cast("long"), F.lit(1))
    return seconds.withColumn("new", fresh).withColumn("session", F.sum("new").over(w)).groupBy("user_id", "session").agg(F.min("second").alias("first_second"), F.max("second").alias("last_second"), F.count("*").alias("n_events"))
