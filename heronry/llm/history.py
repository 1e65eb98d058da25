"""Deduplicating new batches against all history (problem 4).

The history of accepted records lies in bucket folders by key: ``exact`` has the normalised path and the content hash of each
accepted record with the time of its batch, ``pieces`` has the keys of the pieces of each accepted hash (for pictures a piece
is a choice of the hash's blocks, what a paragraph is for a text), ``hot`` the keys of overfull pieces. A batch is screened
by joins within the buckets of its own keys: an equal key in ``exact`` is a full copy and settles the record; only what is left
looks for shared pieces, whose candidates a bit count verifies. Then the batch's own new keys are appended to their buckets.
Neither the history's records nor the other buckets are read.

A piece that more than ``cap`` accepted hashes share becomes hot when it is appended to: its hashes get further keys, of
another deal of the bits, and whoever has a hot key later goes by those. No candidate is dropped.

Defined cases: records without batch, batches without any time, null paths and null hashes match nothing; batches of equal
time are not before one another; a file reported twice in one batch is no duplicate by that; a key accepted again adds no row
unless its batch is earlier; no history gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.functions.hashes import hamming
from heronry.functions.paths import path_key
from heronry.operators.hamming import agreeing, block_keys
from heronry.session import BucketTable, Scratch
from heronry.sources.tables import scans_in_force, table

THRESHOLD = 5
CAP = 2000
_LEVELS = 5


class BatchHistory:
    """Accepted records by key. ``buckets`` and ``agree``, the blocks of a piece, are fixed when the history is made; agreeing()
    tells how many blocks suit the number of different hashes that are expected. ``at`` is the type of batch times."""

    def __init__(self, scratch: Scratch, buckets: int | None = None, threshold: int = THRESHOLD, cap: int = CAP, agree: int = 2, at: str = "timestamp_ntz"):
        self.scratch, self.spark, self.threshold, self.cap, self.agree = scratch, scratch.spark, threshold, cap, agree
        self.exact = BucketTable(scratch, "exact", ["key"], f"key long, pkey string, h long, batch_at {at}", buckets)
        self.pieces = BucketTable(scratch, "pieces", ["key"], f"key long, h long, batch_at {at}", buckets)
        self.hot = BucketTable(scratch, "hot", ["key"], "key long", buckets)

    def _keys(self, rows: DataFrame, h: str, level: int) -> DataFrame:
        """rows (key, h, ...) with the keys of a level in place of key: from level 1 on they stand below the hot key they had."""
        keys = block_keys(F.col(h), self.threshold, self.agree, level)
        below = keys if level == 0 else F.transform(keys, lambda k: F.xxhash64("key", k))
        return rows.withColumn("key", F.explode(below))

    @staticmethod
    def _named(records: DataFrame) -> DataFrame:
        """(key, pkey, h, batch_at): the exact keys of paths and hashes."""
        none = lambda c, t: F.lit(None).cast(t).alias(c)
        paths = records.where("pkey IS NOT NULL").select(F.xxhash64(F.lit("path"), "pkey").alias("key"), "pkey", none("h", "long"), "batch_at")
        return paths.union(records.where("h IS NOT NULL").select(F.xxhash64(F.lit("hash"), "h").alias("key"), none("pkey", "string"), "h", "batch_at"))

    def append(self, records: DataFrame) -> None:
        """Add accepted records (batch_at, pkey, h). Only the earliest batch of a key matters."""
        own = self._named(records.where("batch_at IS NOT NULL")).groupBy("key", "pkey", "h").agg(F.min("batch_at").alias("batch_at"))
        own = self.scratch.save(own, "own")
        known = self.exact.read(self.exact.touched(own)).groupBy("key", "pkey", "h").agg(F.min("batch_at").alias("since")).withColumnsRenamed({"pkey": "p", "h": "g", "key": "k"})
        same = (F.col("key") == F.col("k")) & F.col("pkey").eqNullSafe(F.col("p")) & F.col("h").eqNullSafe(F.col("g"))
        fresh = self.scratch.save(own.join(known, same, "left").where("since IS NULL OR batch_at < since").select("key", "pkey", "h", "batch_at"), "fresh")
        self.exact.append(fresh)
        rows = fresh.where("h IS NOT NULL").select("key", "h", "batch_at")
        for level in range(_LEVELS):
            rows = self.scratch.save(self._keys(rows, "h", level), "keys")
            buckets = self.pieces.touched(rows)
            if level == _LEVELS - 1:
                self.pieces.append(rows)
                break
            hot = self.hot.read(buckets).distinct()
            deep = rows.join(hot, "key", "left_semi") if self.hot.folders else rows.limit(0)
            cold = rows.join(hot, "key", "left_anti") if self.hot.folders else rows
            self.pieces.append(cold)
            sizes = self.pieces.read(buckets).select("key").join(cold.select("key").distinct(), "key", "left_semi").groupBy("key").count()
            full = self.scratch.save(sizes.where(F.col("count") > self.cap).select("key"), "full")
            if not full.isEmpty():
                self.hot.append(full)
                deep = deep.union(self.pieces.read(self.pieces.touched(full)).join(full, "key", "left_semi").select("key", "h", "batch_at"))
            if deep.isEmpty():
                break
            rows = deep

    def first_near(self, hashes: DataFrame) -> DataFrame:
        """(h, first_at): the earliest batch of an accepted hash within the threshold of h, by shared pieces."""
        probe, found = hashes.select(F.lit(0).cast("long").alias("key"), F.col("h").alias("p")).where("p IS NOT NULL").distinct(), []
        for level in range(_LEVELS):
            probe = self.scratch.save(self._keys(probe, "p", level), "probe")
            buckets = self.pieces.touched(probe)
            hot = self.hot.read(buckets).distinct()
            last = not self.hot.folders or level == _LEVELS - 1
            cold = probe if last else probe.join(hot, "key", "left_anti")
            near = cold.join(self.pieces.read(buckets), "key").where(hamming(F.col("p"), F.col("h")) <= self.threshold)
            found.append(near.select(F.col("p").alias("h"), "batch_at"))
            if last:
                break
            probe = probe.join(hot, "key", "left_semi")
        return reduce(DataFrame.union, found).groupBy("h").agg(F.min("batch_at").alias("first_at"))

    def screen(self, records: DataFrame) -> DataFrame:
        """(record_id): the records (record_id, batch_at, pkey, h) whose path, or a hash near theirs, was accepted in an
        earlier batch. Lookups go by distinct keys, so a hot file or hash is looked up once and only the small answer meets
        its rows."""
        r = records.where("batch_at IS NOT NULL").select("record_id", "batch_at", "pkey", "h")
        wanted = self.scratch.save(self._named(r).groupBy("key", "pkey", "h").agg(F.max("batch_at").alias("latest")), "wanted")
        there = self.exact.read(self.exact.touched(wanted)).withColumnsRenamed({"pkey": "p", "h": "g", "key": "k"})
        same = (F.col("key") == F.col("k")) & F.col("pkey").eqNullSafe(F.col("p")) & F.col("h").eqNullSafe(F.col("g")) & (F.col("batch_at") < F.col("latest"))
        copies = self.scratch.save(wanted.join(there, same).groupBy("pkey", "h").agg(F.min("batch_at").alias("first_at")), "copies")
        by_path = copies.where("pkey IS NOT NULL").select("pkey", F.col("first_at").alias("path_at"))
        by_hash = copies.where("h IS NOT NULL").select("h", F.col("first_at").alias("hash_at"))
        told = r.join(by_path, "pkey", "left").join(by_hash, "h", "left").withColumn("copy", F.coalesce(F.least("path_at", "hash_at") < F.col("batch_at"), F.lit(False)))
        told = self.scratch.save(told.select("record_id", "batch_at", "h", "copy"), "told")
        rest = told.where("NOT copy AND h IS NOT NULL")
        near = rest.join(self.first_near(rest), "h").where("first_at < batch_at")
        return told.where("copy").select("record_id").union(near.select("record_id"))


def batched_events(watcher_events: DataFrame, image_info: DataFrame) -> DataFrame:
    """(record_id, batch_at, accepted, pkey, h) of the events of a batch; batch_at is the batch's earliest detected_at."""
    e = watcher_events.where("triggered_job_id IS NOT NULL").select(
        F.col("id").alias("record_id"), F.col("triggered_job_id").alias("batch"), "detected_at",
        (F.lower(F.trim(F.regexp_replace("status", r"\s+", " "))) == "completed").alias("accepted"), path_key("file_path").alias("pkey"))
    start = e.groupBy("batch").agg(F.min("detected_at").alias("batch_at"))
    scans = scans_in_force(image_info).select("pkey", "h").where("h IS NOT NULL")
    return e.join(start, "batch").join(scans, "pkey", "left").select("record_id", "batch_at", "accepted", "pkey", "h")


def p4_found(spark, folder: str, ranges: int = 3) -> DataFrame:
    """(event_id) of every batched event whose file or picture was accepted in an earlier batch.

    The batches come in ``ranges`` of time, as a large backlog would: each range is appended to the stored history and then
    screened against it, so a range is never read again. A match counts only if its batch is earlier, so batches of one
    range may be appended together; the result is that of batch after batch."""
    scratch = Scratch(spark, "p4")
    events = scratch.save(batched_events(table(spark, folder, "watcher_events"), table(spark, folder, "image_info")), "events")
    cuts = events.agg(F.percentile_approx("batch_at", [i / ranges for i in range(1, ranges)])).first()[0] or []
    expected = events.agg(F.approx_count_distinct("h")).first()[0]
    history, found = BatchHistory(scratch, agree=agreeing(THRESHOLD, expected)), spark.createDataFrame([], "record_id long")
    for i, low in enumerate([None, *sorted(set(cuts))]):
        high = sorted(set(cuts))[i] if i < len(set(cuts)) else None
        own = events if low is None else events.where(F.col("batch_at") > F.lit(low))
        own = own if high is None else own.where(F.col("batch_at") <= F.lit(high))
        history.append(own.where("accepted"))
        found = found.union(scratch.save(history.screen(own), "found"))
    return found.withColumnRenamed("record_id", "event_id")
