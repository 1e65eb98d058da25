"""The folder watch as Structured Streaming: debounce by state per file, batches by session windows, steps per micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from heronry.functions.constants import PENDING_SECONDS, SUPPRESSING_STATUSES, THRESHOLDS
from heronry.functions.naming import ignored
from heronry.functions.paths import basename, path_key
from heronry.operators.dedupe import duplicate_groups
from heronry.operators.organise import organise_plan
from heronry.operators.sync import sync_plan

POLLS = "config_id long, file_path string, poll_ts timestamp, size long, mtime long"
_STATE = "first_at double, size long, mtime long, unchanged long, done boolean"


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of polls from files of rows POLLS."""
    return spark.readStream.schema(POLLS).parquet(folder)


def debounce(polls: DataFrame, window: int, pending_seconds: int = PENDING_SECONDS, ignore: list[str] = (), timeout: bool = True) -> DataFrame:
    """(config_id, file_path, stable_at) of a stream of polls: each file once, at the first poll at which size and date stood
    still for ``window`` polls after the first. A file that is not stable ``pending_seconds`` after its first poll is dropped
    when the next poll shows it; one that is not polled any more is dropped by timeout. Ignored names are never pending.
    A query that is to end by itself (availableNow) needs ``timeout`` off: pending timeouts keep asking for another batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, size, mtime, unchanged, done = state.get if state.exists else (None, None, None, 0, False)
        rows = pd.concat(list(batches)).sort_values("poll_ts")
        out = []
        for ts, s, m in zip(rows["poll_ts"], rows["size"], rows["mtime"]):
            now = ts.timestamp()
            if first is None:
                first, size, mtime, unchanged = now, s, m, 0
            elif (s, m) == (size, mtime):
                unchanged += 1
            else:
                size, mtime, unchanged = s, m, 0
            if not done and now - first > pending_seconds:
                done = True  # given up; told by silence
            elif not done and unchanged >= window:
                out.append(ts)
                done = True
        state.update((float(first), int(size), int(mtime), int(unchanged), done))
        if timeout:
            state.setTimeoutDuration(pending_seconds * 1000)
        if out:
            yield pd.DataFrame({"config_id": [key[0]], "file_path": [key[1]], "stable_at": out[:1]})

    seen = polls.where(~ignored(basename(F.col("file_path")), ignore) & F.col("poll_ts").isNotNull())
    return seen.groupBy("config_id", "file_path").applyInPandasWithState(
        step, "config_id long, file_path string, stable_at timestamp", _STATE, "append",
        GroupStateTimeout.ProcessingTimeTimeout if timeout else GroupStateTimeout.NoTimeout)


def gap_windows(stable: DataFrame, gap_seconds: int = 3, lateness: str = "10 seconds") -> DataFrame:
    """(config_id, start_at, end_at, files) of a stream of stable files: a batch ends after a gap of more than gap_seconds.
    Session windows end at the gap itself, so the window is a millisecond longer."""
    late = stable.withWatermark("stable_at", lateness)
    w = F.session_window("stable_at", f"{gap_seconds * 1000 + 1} milliseconds")
    return late.groupBy("config_id", w).agg(F.collect_set("file_path").alias("files"), F.max("stable_at").alias("end_at")).select(
        "config_id", F.col("session_window.start").alias("start_at"), "end_at", F.array_sort("files").alias("files"))


def not_processed(found: DataFrame, events: DataFrame) -> DataFrame:
    """Stream of found files without those a static event table says are done, under whatever spelling."""
    done = events.where(F.lower(F.trim("status")).isin(SUPPRESSING_STATUSES)).select(path_key("file_path").alias("_key")).distinct()
    return found.withColumn("_key", path_key("file_path")).join(done, "_key", "left_anti").drop("_key")


def run_pipeline(stable: DataFrame, steps: list[tuple[str, Callable[[DataFrame], DataFrame]]], sink: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Run the steps in order on every micro-batch, write what each gives to ``sink``-results/step=NAME/batch=N and append
    (file_path, step, status, error) to the sink. A step that fails is told for its files and the next goes on. A repeated
    micro-batch overwrites its own folders: at least once, told once."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        told = None
        for name, f in steps:
            try:
                f(batch).write.mode("overwrite").parquet(f"{sink.rstrip('/')}-results/step={name}/batch={number}")
                status, error = "completed", None
            except Exception as e:  # noqa: BLE001
                status, error = "failed", str(e)[:500]
            rows = batch.select("file_path", F.lit(name).alias("step"), F.lit(status).alias("status"), F.lit(error).cast("string").alias("error"))
            told = rows if told is None else told.unionByName(rows)
        if told is not None:
            told.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        batch.unpersist()

    return stable.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def catalogue_steps(files: DataFrame, tags: DataFrame, fingerprints: DataFrame, latest: DataFrame, target: str = "/organised", threshold: int = THRESHOLDS["similar"]) -> list[tuple[str, Callable[[DataFrame], DataFrame]]]:
    """The steps of run_pipeline() over static tables: files (id, path, created_at), resolved tags (file_id, key, verdict),
    fingerprints (path, h, resolution) and the newest uploads of an account (local_path, content_hash).

    classify gives the batch's tags, organise its plan, dedupe the members of every group that has a file of the batch, and
    cloud_sync what to upload, by a hash of path and date, as contents are not at hand here."""
    keyed = lambda b: b.select(path_key("file_path").alias("path")).distinct()
    known = files.select("id", path_key("path").alias("path"), "created_at")

    def dedupe_step(b: DataFrame) -> DataFrame:
        groups = duplicate_groups(fingerprints, threshold)
        return groups.join(groups.join(keyed(b), "path", "left_semi").select("group_id").distinct(), "group_id", "left_semi")

    def sync_step(b: DataFrame) -> DataFrame:
        local = known.join(keyed(b), "path", "left_semi").select(F.col("path").alias("local_path"), F.sha2(F.concat_ws(":", "path", "created_at"), 256).alias("content_hash"))
        return sync_plan(local, latest)

    return [("classify", lambda b: known.join(keyed(b), "path", "left_semi").join(tags.withColumnRenamed("file_id", "id"), "id").select("path", "key", "verdict")),
            ("organize", lambda b: organise_plan(known.join(keyed(b), "path", "left_semi"), known.limit(0).select("path"), target)),
            ("dedupe", dedupe_step), ("cloud_sync", sync_step)]


class WatchManager:
    """Keeps one query per enabled configuration; ``reconcile`` starts, restarts and stops what changed."""

    def __init__(self, start: Callable[[dict], StreamingQuery]):
        self.start, self.running = start, {}

    def reconcile(self, configs: list[dict]) -> dict[int, str]:
        wanted, told = {c["id"]: c for c in configs if c.get("enabled")}, {}
        for i in list(self.running):
            if wanted.get(i) != self.running[i][0]:
                self.running.pop(i)[1].stop()
                told[i] = "stopped"
        for i, c in wanted.items():
            if i not in self.running:
                self.running[i] = (c, self.start(c))
                told[i] = "restarted" if i in told else "started"
        return told
