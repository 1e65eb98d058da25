"""Incremental sync against a manifest, its history and its undo."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from heronry.operators.catalog import latest_by


def latest_uploads(manifest: DataFrame, runs: DataFrame, account_id) -> DataFrame:
    """The newest uploaded manifest row of each path of an account."""
    own = runs.where(F.col("account_id") == account_id).select(F.col("id").alias("sync_run_id"))
    up = manifest.where("status = 'uploaded'").join(own, "sync_run_id", "left_semi")
    return latest_by(up, ["local_path"], [F.col("uploaded_at").desc_nulls_last(), F.col("id").desc()])


def sync_plan(local: DataFrame, latest: DataFrame, full: bool = False) -> DataFrame:
    """(local_path, content_hash, action, reason) of local files (local_path, content_hash): upload what is new or changed."""
    old = latest.select("local_path", F.col("content_hash").alias("old_hash"), F.lit(True).alias("there"))
    reason = F.when(F.col("there").isNull(), "new").when(F.col("old_hash").eqNullSafe(F.col("content_hash")), "unchanged").otherwise("changed")
    p = local.join(old, "local_path", "left").withColumn("reason", reason)
    return p.select("local_path", "content_hash", F.when((F.col("reason") != "unchanged") | F.lit(full), "upload").otherwise("skip").alias("action"), "reason")


def plan_counts(plan: DataFrame, sizes: DataFrame) -> DataFrame:
    """(action, files, bytes)"""
    return plan.join(sizes, "local_path", "left").groupBy("action").agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


def run_statistics(runs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per run: total, uploaded, failed, skipped; a run without rows has total 0 and null sums."""
    one = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0)).alias(s)
    m = manifest.groupBy(F.col("sync_run_id").alias("id")).agg(F.count("*").alias("total"), one("uploaded"), one("failed"), one("skipped"))
    return runs.join(m, "id", "left").withColumn("total", F.coalesce("total", F.lit(0)))


def history(runs: DataFrame, accounts: DataFrame, manifest: DataFrame, n: int = 20) -> DataFrame:
    """The n newest runs with account label, statistics and whether they can be undone: an account's last run, if it was
    completed at least in part."""
    last = F.row_number().over(W.partitionBy("account_id").orderBy(F.col("id").desc())) == 1
    named = runs.withColumn("is_last", last).join(accounts.select(F.col("id").alias("account_id"), "label"), "account_id")
    top = named.orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(n)
    few = manifest.join(top.select(F.col("id").alias("sync_run_id")), "sync_run_id", "left_semi")
    return run_statistics(top, few).withColumn("can_undo", F.col("is_last") & F.col("status").isin("completed", "partial")).drop("is_last")


def undo_plan(runs: DataFrame, manifest: DataFrame, run_id=None) -> DataFrame:
    """(id, remote_path, action) for the uploaded rows of a run, or of every account's, if it is its account's last and was
    completed at least in part."""
    last = F.row_number().over(W.partitionBy("account_id").orderBy(F.col("id").desc())) == 1
    wanted = F.lit(True) if run_id is None else F.col("id") == run_id
    ok = runs.withColumn("is_last", last).where(wanted & F.col("is_last") & F.col("status").isin("completed", "partial"))
    return manifest.where("status = 'uploaded'").join(ok.select(F.col("id").alias("sync_run_id")), "sync_run_id", "left_semi").select(
        "id", "remote_path", F.lit("delete").alias("action"))


def after_undo(manifest: DataFrame, plan: DataFrame, failed: DataFrame) -> DataFrame:
    """The manifest with the rows of the plan marked, except those whose delete failed (id)."""
    done = plan.select("id").join(failed.select("id"), "id", "left_anti").withColumn("done", F.lit(True))
    return manifest.join(done, "id", "left").select(*[F.when(F.col("done"), "deleted_by_undo").otherwise(F.col("status")).alias("status") if c == "status" else F.col(c) for c in manifest.columns])
