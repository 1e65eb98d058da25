"""Batch forms of the folder watch: debounce of polls, batches by gaps, suppression of what was processed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from heronry.functions.constants import BATCH_GAP_SECONDS, EVENT_STATUSES, PENDING_SECONDS, SUPPRESSING_STATUSES
from heronry.functions.naming import ignored
from heronry.functions.paths import basename, path_key
from heronry.functions.times import micros


def unchanged_runs(polls: DataFrame, key: list[str], order: list[str], state: Column) -> DataFrame:
    """polls with ``unchanged``: how many polls in a row before this one had the same state; a change starts at 0."""
    w = W.partitionBy(*key).orderBy(*order)
    s = polls.withColumn("_s", state)
    s = s.withColumn("_new", F.coalesce((~F.col("_s").eqNullSafe(F.lag("_s").over(w))) | (F.row_number().over(w) == 1), F.lit(True)).cast("int"))
    s = s.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return s.withColumn("unchanged", (F.row_number().over(W.partitionBy(*key, "_run").orderBy(*order)) - 1).cast("long")).drop("_s", "_new", "_run")


def stable_files(polls: DataFrame, window: int, pending_seconds: int = PENDING_SECONDS) -> DataFrame:
    """(config_id, file_path, stable_at): the first poll (config_id, file_path, poll_ts, size, mtime) at which size and date
    stood still for ``window`` polls after the first; window 0 is stable at once. Files pending longer than
    ``pending_seconds`` before that are dropped."""
    key = ["config_id", "file_path"]
    runs = unchanged_runs(polls, key, ["poll_ts"], F.struct("size", "mtime"))
    first = runs.groupBy(*key).agg(F.min("poll_ts").alias("first_at"), F.min(F.when(F.col("unchanged") >= window, F.col("poll_ts"))).alias("stable_at"))
    return first.where(micros(F.col("stable_at")) - micros(F.col("first_at")) <= pending_seconds * 1_000_000).select(*key, "stable_at")


def gap_batches(events: DataFrame, key: list[str], ts: str, gap_seconds: int = BATCH_GAP_SECONDS, tiebreak: str = "id") -> DataFrame:
    """events with ``batch``, 1, 2, ... per key: a new batch starts after a gap of more than ``gap_seconds``."""
    w = W.partitionBy(*key).orderBy(ts, tiebreak)
    gap = micros(F.col(ts)) - micros(F.lag(ts).over(w))
    return events.withColumn("_new", F.coalesce((gap > gap_seconds * 1_000_000).cast("int"), F.lit(0))).withColumn(
        "batch", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)) + 1).drop("_new")


def batch_summary(batched: DataFrame, key: list[str], ts: str) -> DataFrame:
    return batched.groupBy(*key, "batch").agg(F.min(ts).alias("start_at"), F.max(ts).alias("end_at"), F.count("*").alias("files"))


def unprocessed(found: DataFrame, events: DataFrame) -> DataFrame:
    """Files (file_path) of no event that ended, under whatever spelling; in-flight ones come again."""
    done = events.where(F.lower(F.trim("status")).isin(SUPPRESSING_STATUSES)).select(path_key("file_path").alias("_key")).distinct()
    return found.withColumn("_key", path_key("file_path")).join(done, "_key", "left_anti").drop("_key")


def backfill(listed: DataFrame, events: DataFrame, config_id: int, ignore: list[str] = ()) -> DataFrame:
    """(config_id, file_path) of listed files (path) that a watch finds when it starts and no event has ended."""
    found = listed.where(~ignored(basename(F.col("path")), ignore)).select(F.lit(config_id).cast("long").alias("config_id"), F.col("path").alias("file_path"))
    return unprocessed(found, events)


def advanced(events: DataFrame, told: DataFrame) -> DataFrame:
    """Events (id, status, error_message, ...) after told (id, status, error): a status only goes on, from stabilized to enqueued
    to running to completed or failed; what ended stays. Of several for one event the farthest counts, and failed over
    completed."""
    rank = lambda c: F.coalesce(F.array_position(F.array(*[F.lit(s) for s in EVENT_STATUSES]), F.lower(F.trim(c))), F.lit(0))
    last = told.groupBy("id").agg(F.max(F.struct(rank(F.col("status")).alias("r"), "status", "error")).alias("t"))
    j = events.join(last, "id", "left")
    ended = F.lower(F.trim("status")).isin(SUPPRESSING_STATUSES)
    go = F.coalesce(~F.coalesce(ended, F.lit(False)) & (F.col("t.r") > rank(F.col("status"))), F.lit(False))
    put = {"status": F.when(go, F.lower(F.trim("t.status"))).otherwise(F.col("status")), "error_message": F.when(go, F.col("t.error")).otherwise(F.col("error_message"))}
    return j.select(*[put[c].alias(c) if c in put else F.col(c) for c in events.columns])
