"""References to records that do not exist.

Signed counts per target key are kept from change deltas: +1 / -1 for every reference that appears or goes, and for every
record that appears or goes. A key with positive references and zero existence is an orphan; a late record simply adds its
existence and the key leaves the report. History is never read again: a delta is merged into the counts, which lie in bucket
folders by key, and only the buckets that the delta touches are read and rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.session import BucketTable, Scratch

_COUNTS = "target string, key long, ref_table string, period string, refs long, present long"


def month_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def reference_rows(table: DataFrame, ref_table: str, target: str, column: str, period: Column | None = None) -> DataFrame:
    """(ref_table, row_id, target, key, period) of the rows of a table whose reference is not null."""
    return table.where(F.col(column).isNotNull()).select(
        F.lit(ref_table).alias("ref_table"), F.col("id").cast("long").alias("row_id"), F.lit(target).alias("target"),
        F.col(column).cast("long").alias("key"), (month_of(F.col("created_at")) if period is None else period).alias("period"))


def reference_deltas(rows: DataFrame, sign: int = 1) -> DataFrame:
    """Deltas of references that appear (sign 1) or go (-1), summed before any shuffle of rows."""
    return rows.groupBy("target", "key", "ref_table", "period").agg(
        (F.count("*") * sign).alias("refs"), F.lit(0).cast("long").alias("present"))


def existence_deltas(table: DataFrame, target: str, sign: int = 1, column: str = "id") -> DataFrame:
    """Deltas of records that appear or go."""
    return table.where(F.col(column).isNotNull()).select(
        F.lit(target).alias("target"), F.col(column).cast("long").alias("key"), F.lit(None).cast("string").alias("ref_table"),
        F.lit(None).cast("string").alias("period"), F.lit(0).cast("long").alias("refs"), F.lit(sign).cast("long").alias("present"))


class ReferenceCounts:
    """The persistent counts: (target, key, ref_table, period, refs, present), no row where both are zero."""

    def __init__(self, scratch: Scratch, buckets: int | None = None):
        self.scratch, self.table = scratch, BucketTable(scratch, "counts", ["target", "key"], _COUNTS, buckets)

    def apply(self, *deltas: DataFrame) -> ReferenceCounts:
        """Merge deltas: they are summed, then added to the counts of the buckets they fall into."""
        total = lambda df: df.groupBy("target", "key", "ref_table", "period").agg(F.sum("refs").alias("refs"), F.sum("present").alias("present"))
        union = deltas[0]
        for d in deltas[1:]:
            union = union.unionByName(d)
        delta = self.scratch.save(total(union), "delta")
        buckets = self.table.touched(delta)
        self.table.replace(total(self.table.read(buckets).unionByName(delta)).where("refs <> 0 OR present <> 0"), buckets)
        self.scratch.drop(delta)
        return self

    @property
    def state(self) -> DataFrame:
        return self.table.read()

    def orphan_keys(self) -> DataFrame:
        """(target, key): positive references, zero existence."""
        return (self.state.groupBy("target", "key").agg(F.sum("refs").alias("refs"), F.sum("present").alias("present"))
                .where("refs > 0 AND present <= 0").select("target", "key"))

    def report(self) -> DataFrame:
        """(ref_table, period, orphan_rows, orphan_keys) per table and period."""
        held = self.state.where("refs > 0").join(self.orphan_keys(), ["target", "key"], "left_semi")
        return held.groupBy("ref_table", "period").agg(F.sum("refs").alias("orphan_rows"), F.count_distinct("target", "key").alias("orphan_keys"))


def orphan_rows(rows: DataFrame, orphans: DataFrame) -> DataFrame:
    """(ref_table, row_id) of the reference rows whose key is an orphan.

    One missing key may hold a third of all rows, so both sides are salted, by as many salts as the job has shuffle
    partitions: the rows by their id, the (distinct, few) orphan keys by copying each to every salt."""
    salts = max(16, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(salts)).cast("int"))
    keys = orphans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(keys, ["target", "key", "salt"], "left_semi").select("ref_table", "row_id")


def media_references(media_tags: DataFrame, face_embeddings: DataFrame, people: DataFrame) -> DataFrame:
    """All references of the media library, of every row whose reference is not null."""
    return (reference_rows(media_tags, "media_tags", "media_files", "file_id")
            .union(reference_rows(face_embeddings, "face_embeddings", "people", "person_id"))
            .union(reference_rows(people, "people", "face_embeddings", "cover_face_id")))


def media_reference_counts(scratch: Scratch, media_tags: DataFrame, face_embeddings: DataFrame, people: DataFrame, media_files: DataFrame, before=None) -> ReferenceCounts:
    """Counts of the whole library from nothing. With ``before``, a timestamp, as two changes: the rows created earlier, then
    all others, so that references come before and after the records they name."""
    counts, tables = ReferenceCounts(scratch), (media_tags, face_embeddings, people, media_files)
    early = lambda t: F.coalesce(F.col("created_at") < F.lit(before), F.lit(False))
    for part in ([tables] if before is None else [[t.where(early(t)) for t in tables], [t.where(~early(t)) for t in tables]]):
        tags, faces, persons, files = part
        counts.apply(reference_deltas(media_references(tags, faces, persons)),
                     existence_deltas(files, "media_files"), existence_deltas(persons, "people"), existence_deltas(faces, "face_embeddings"))
    return counts
