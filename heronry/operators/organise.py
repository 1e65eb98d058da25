"""Organising files by date or category: skip reasons, targets, free names. The result is a plan; nothing is touched."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from heronry.functions.naming import base_of_copy, category_folder, copy_suffix, file_type, folder_key
from heronry.functions.paths import basename, extension, stem
from heronry.session import Scratch


def ranked(rows: DataFrame, keys: list[str], order: list[str], name: str = "rank", scratch: Scratch | None = None) -> DataFrame:
    """rows with their place, 1, 2, ..., among those of equal keys in an order without ties. A key with a third of all rows is
    spread: rows are parted by ranges of (keys, order), ranked within their part, and shifted by what former parts hold."""
    spark = rows.sparkSession
    scratch = scratch or Scratch(spark, "ranked")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = scratch.save(rows.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    held = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = held.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*order))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*keys, "_part"]]
    joined = placed.withColumn("_own", own).alias("l").join(before.alias("r"), reduce(lambda a, b: a & b, same))
    return joined.select(*[f"l.{c}" for c in rows.columns], (F.col("l._own") + F.col("r._before")).cast("int").alias(name))


def _names(files: DataFrame, path: str) -> DataFrame:
    s = files.select(F.col(path).alias("path"), basename(F.col(path)).alias("name")).withColumn("stem", stem(F.col("name")))
    ext = F.regexp_extract("name", r".(\.[^.]*)$", 1)
    return s.select("path", "stem", (copy_suffix(F.col("stem")) > 0).alias("copied"), F.lower(F.concat(base_of_copy(F.col("stem")), ext)).alias("base"))


def name_duplicates(files: DataFrame, path: str = "path") -> DataFrame:
    """(path, base, rank, is_duplicate): files grouped by their name without a copy's suffix, in lower case, over all folders.
    The first by (has a suffix, stem, path) is the original."""
    return ranked(_names(files, path), ["base"], ["copied", "stem", "path"]).select("path", "base", "rank", (F.col("rank") > 1).alias("is_duplicate"))


def name_copies(files: DataFrame, path: str = "path") -> DataFrame:
    """(path, is_duplicate) alone: the original of a name is a minimum, so no name is sorted."""
    n = _names(files, path)
    first = n.groupBy("base").agg(F.min(F.struct("copied", "stem", "path"))["path"].alias("original"))
    return n.join(first, "base").select("path", (F.col("path") != F.col("original")).alias("is_duplicate"))


def with_free_names(rows: DataFrame, folder: str, name: str, order: str, taken: DataFrame | None = None) -> DataFrame:
    """free_name: the first row by ``order`` of a folder and name keeps the name if it is free; the others get name_1, name_2,
    ..., without the numbers that are in use. In use are the names in ``taken`` (folder, name) and those that rows keep, so no
    two rows and no file that is there get one name. Extra columns are kept."""
    kept = rows.groupBy(folder, name).agg(F.min(order).alias("_first"))
    there = None
    if taken is not None:
        there = taken.select(F.col("folder").alias(folder), F.col("name").alias(name)).distinct()
        kept = kept.join(there.withColumn("_taken", F.lit(True)), [folder, name], "left")
    else:
        kept = kept.withColumn("_taken", F.lit(None).cast("boolean"))
    keeps = (F.col(order) == F.col("_first")) & F.col("_taken").isNull()
    r = rows.join(kept, [folder, name]).withColumn("_keeps", keeps).drop("_first", "_taken")
    names = kept.where("_taken IS NULL").select(folder, name)
    names = names if there is None else names.union(there)
    number = F.regexp_extract(F.col(name), r"_([1-9]\d{0,8})(\.[^.]*)?$", 1)
    used = names.where(number != "").select(folder, F.regexp_replace(name, r"_[1-9]\d{0,8}(\.[^.]*)?$", "$1").alias(name), number.cast("long").alias("_u")).distinct()
    loser = r.where(~F.col("_keeps"))
    used = used.join(loser.select(folder, name).distinct(), [folder, name], "left_semi")
    # the r-th loser gets the r-th number not in use: r plus the numbers in use that have fewer than r free ones before them
    at = F.row_number().over(W.partitionBy(folder, name).orderBy("_u"))
    blocks = used.withColumn("_free", F.col("_u") - at).groupBy(folder, name).agg(F.array_sort(F.collect_list("_free")).alias("_blocks"))
    lost = ranked(loser, [folder, name], [order], "_r").join(blocks, [folder, name], "left")
    n = F.col("_r") + F.coalesce(F.size(F.filter("_blocks", lambda b: b < F.col("_r"))), F.lit(0))
    ext = F.regexp_extract(name, r".(\.[^.]*)$", 1)
    named = lost.withColumn("free_name", F.concat(stem(F.col(name)), F.lit("_"), n.cast("string"), ext)).drop("_r", "_blocks", "_keeps")
    return r.where("_keeps").withColumn("free_name", F.col(name)).drop("_keeps").unionByName(named)


def organise_plan(files: DataFrame, skips: DataFrame, target: str = "/organised") -> DataFrame:
    """(path, status, reason, file_type, folder_key, dst) for files (path, created_at).

    The first reason that holds: name_duplicate, perceptual_duplicate (path in ``skips``), not_media, no_date,
    duplicate_filename (a former path, by order, has the name in that folder), success."""
    f = (files.select("path", "created_at").join(name_copies(files), "path", "left")
         .join(skips.select("path").distinct().withColumn("perceptual", F.lit(True)), "path", "left"))
    kind = file_type(extension(basename(F.col("path"))))
    f = f.withColumn("kind", kind).withColumn("folder", folder_key(F.col("created_at"))).withColumn("name", basename(F.col("path")))
    early = (F.when(F.col("is_duplicate"), "name_duplicate").when(F.col("perceptual"), "perceptual_duplicate")
             .when(F.col("kind") == "other", "not_media").when(F.col("folder").isNull(), "no_date"))
    f = f.withColumn("early", early)
    first = f.where("early IS NULL").groupBy("folder", "name").agg(F.min("path").alias("first"))
    f = f.join(first, ["folder", "name"], "left")
    f = f.withColumn("reason", F.coalesce("early", F.when(F.col("path") != F.col("first"), "duplicate_filename").otherwise("success")))
    placed = F.col("reason").isin("success", "duplicate_filename")
    return f.select("path", F.when(F.col("reason") == "success", "success").otherwise("skipped").alias("status"), "reason",
                    F.when(~F.col("reason").isin("name_duplicate", "perceptual_duplicate"), F.col("kind")).alias("file_type"),
                    F.when(placed, F.col("folder")).alias("folder_key"),
                    F.when(F.col("reason") == "success", F.concat_ws("/", F.lit(target), "folder", "name")).alias("dst"))


def organise_statistics(plan: DataFrame) -> DataFrame:
    """(folder_key, images, videos) of the files that are placed."""
    return (plan.where("reason = 'success'").groupBy("folder_key")
            .agg(F.count_if(F.col("file_type") == "image").alias("images"), F.count_if(F.col("file_type") == "video").alias("videos")))


def category_plan(tags: DataFrame, scheme: str, operation: str = "copy", target: str = "/sorted", links: bool = True, taken: DataFrame | None = None) -> DataFrame:
    """(step, action, src, dst): each file of tags (path, created_at, key, label, priority) to the folder of its first tag by
    (priority, key) under a free name (step 1); in the folders of its further tags a symlink of that name to where the file now
    lies (step 2, to be carried out after step 1). A link whose place is in use is left out; of two the first by path stays."""
    at = F.row_number().over(W.partitionBy("path").orderBy("priority", "key"))
    t = tags.select("path", "created_at", "key", "label", "priority").distinct().withColumn("at", at)
    t = t.withColumn("folder", F.concat_ws("/", F.lit(target), category_folder(scheme, F.col("created_at"), F.col("label"))))
    first = with_free_names(t.where("at = 1").select("path", "folder", basename(F.col("path")).alias("name")), "folder", "name", "path", taken)
    placed = first.select("path", F.col("free_name").alias("name"), F.concat_ws("/", "folder", "free_name").alias("dst"))
    plan = placed.select(F.lit(1).alias("step"), F.lit(operation).alias("action"), F.col("path").alias("src"), "dst")
    if not links:
        return plan
    used = placed.select("dst")
    if taken is not None:
        used = used.union(taken.select(F.concat_ws("/", "folder", "name")))
    more = t.where("at > 1").select("path", "folder").join(placed, "path").select(F.concat_ws("/", "folder", "name").alias("place"), "path", "dst")
    link = more.groupBy("place").agg(F.min(F.struct("path", "dst"))["dst"].alias("src")).join(used.select(F.col("dst").alias("place")), "place", "left_anti")
    return plan.union(link.select(F.lit(2).alias("step"), F.lit("symlink").alias("action"), "src", F.col("place").alias("dst")))


def capture_time(exif: Column, video: Column, modified: Column) -> Column:
    """When a picture or video was taken: its EXIF text (2024:03:01 10:20:30), else its video tag, else its file's date.
    Unreadable texts count as missing."""
    read = F.try_to_timestamp(F.regexp_extract(F.trim(exif), r"^(\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2})$", 1), F.lit("yyyy:MM:dd HH:mm:ss"))
    return F.coalesce(read.cast("timestamp_ntz"), video.cast("timestamp_ntz"), modified.cast("timestamp_ntz"))
