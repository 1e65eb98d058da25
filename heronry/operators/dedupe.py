"""Near-duplicate groups of fingerprints: Hamming pairs, components, the copy to keep, reports and keep plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from heronry.functions.hashes import hash_hex
from heronry.functions.paths import path_key
from heronry.operators.components import connected_components
from heronry.operators.hamming import hamming_pairs
from heronry.session import Scratch
from heronry.sources.tables import scans_in_force


def duplicate_groups(fingerprints: DataFrame, threshold: int = 10, scratch: Scratch | None = None) -> DataFrame:
    """Fingerprints (path, h, resolution) to (group_id, path, h, resolution, is_best, group_size), groups of two or more.

    Links run on from file to file, so a group may hold files farther apart than the threshold. Equal hashes are one vertex:
    components are found among different hashes, however many files share one. group_id is the group's smallest path; the best
    is the file of highest resolution, then smallest path; unknown resolution is lowest. Files without hash are left out."""
    scratch = scratch or Scratch(fingerprints.sparkSession, "dedupe")
    hashed = scratch.save(fingerprints.where("h IS NOT NULL AND path IS NOT NULL").select("path", "h", "resolution"), "hashed")
    pairs = scratch.save(hamming_pairs(hashed, threshold, scratch=scratch), "pairs")
    component = connected_components(pairs, scratch)
    grouped = hashed.join(component, hashed["h"] == component["vertex"], "left").withColumn("c", F.coalesce("component", "h")).drop("vertex", "component")
    # per group two partial aggregates, so a group with a third of all files is never gathered
    head = grouped.groupBy("c").agg(F.min("path").alias("group_id"), F.count("*").alias("group_size"),
                                    F.max(F.coalesce("resolution", F.lit(-1))).alias("top")).where("group_size > 1")
    best = (grouped.join(head.select("c", "top"), "c").where(F.coalesce("resolution", F.lit(-1)) == F.col("top"))
            .groupBy("c").agg(F.min("path").alias("best")))
    return (grouped.join(head, "c").join(best, "c")
            .select("group_id", "path", "h", "resolution", (F.col("path") == F.col("best")).alias("is_best"), "group_size"))


def representatives(groups: DataFrame) -> DataFrame:
    """(group_id, h): of each group the hash of its first member by path, which stands for the group in a report."""
    return groups.groupBy("group_id").agg(F.min(F.struct("path", "h"))["h"].alias("h"))


def tagged_union(source: DataFrame, destination: DataFrame) -> DataFrame:
    """(path, h, resolution, is_dest) of fingerprints at the source and at the destination, scanned together; a file that lies
    in both is at the destination."""
    both = source.withColumn("is_dest", F.lit(False)).unionByName(destination.withColumn("is_dest", F.lit(True)))
    return both.groupBy("path").agg(F.max(F.struct("is_dest", "h", "resolution")).alias("m")).select("path", "m.h", "m.resolution", "m.is_dest")


def report(groups: DataFrame, sizes: DataFrame, scanned: DataFrame) -> DataFrame:
    """One row: scanned, hashed, groups, duplicates, bytes to win, and the rates; a rate of nothing is 0.

    ``sizes`` (path, size_bytes), ``scanned`` (path, h)."""
    g = groups.join(sizes, "path", "left").agg(
        F.count_distinct("group_id").alias("groups"), F.count_if(~F.col("is_best")).alias("duplicates"),
        F.coalesce(F.sum(F.when(~F.col("is_best"), F.col("size_bytes"))), F.lit(0)).alias("reclaimable_bytes"), F.count("*").alias("grouped"))
    s = scanned.agg(F.count("*").alias("scanned"), F.count("h").alias("hashed"))
    rate = lambda a, b, f=1.0: F.coalesce(F.try_divide(F.col(a) * f, F.col(b)), F.lit(0.0))
    return s.crossJoin(g).select(  # one row each
        "scanned", "hashed", (F.col("scanned") - F.col("hashed")).alias("without_hash"), "groups", "duplicates", "reclaimable_bytes",
        F.round(rate("hashed", "scanned", 100.0), 1).alias("success_rate"), F.round(rate("grouped", "groups"), 2).alias("images_per_group"),
        F.round(rate("duplicates", "scanned", 100.0), 1).alias("duplicate_ratio"))


def top_groups(groups: DataFrame, n_groups: int = 10, n_members: int = 3) -> DataFrame:
    """The first groups by id with their first duplicates and how many more there are."""
    first = groups.select("group_id", "group_size").distinct().orderBy("group_id").limit(n_groups)
    at = F.row_number().over(W.partitionBy("group_id").orderBy("path"))
    dup = groups.where(~F.col("is_best")).select("group_id", "path").withColumn("at", at).where(F.col("at") <= n_members)
    return first.join(dup, "group_id").select(
        "group_id", "at", "path", F.greatest(F.col("group_size") - 1 - n_members, F.lit(0)).alias("more"))


def keep_plan(groups: DataFrame, action: str = "move", target: str = "/duplicates", taken: DataFrame | None = None) -> DataFrame:
    """(action, src, dst, group_id) for every file but the best of its group. Names that are not free at the target get _1, _2,
    ...; ``taken`` (folder, name) are those that are there already."""
    from heronry.operators.organise import with_free_names

    losers = groups.where(~F.col("is_best")).select("group_id", F.col("path").alias("src"), F.element_at(F.split("path", "/"), -1).alias("name"))
    if action == "delete":
        return losers.select(F.lit(action).alias("action"), "src", F.lit(None).cast("string").alias("dst"), "group_id")
    named = with_free_names(losers.withColumn("folder", F.lit(target)), "folder", "name", "src", taken)
    return named.select(F.lit(action).alias("action"), "src", F.concat_ws("/", "folder", "free_name").alias("dst"), "group_id")


def delete_selected(groups: DataFrame, selected: DataFrame, permanent: bool = False, stamp: Column | None = None) -> DataFrame:
    """(path, verdict, dst): the files of a selection; best files are locked, files of no group are refused."""
    from heronry.functions.naming import trash_name

    # merged: stored paths are many times the size of their files, by which Spark would choose to broadcast them
    found = selected.select("path").distinct().join(groups.select("path", "is_best").hint("merge"), "path", "left")
    verdict = F.when(F.col("is_best").isNull(), "unknown").when(F.col("is_best"), "locked").otherwise("permanent" if permanent else "trash")
    dst = F.when(verdict == "trash", F.concat(F.lit(".trash/"), trash_name(F.col("path"), stamp if stamp is not None else F.lit("0"))))
    return found.select("path", verdict.alias("verdict"), dst.alias("dst"))


def without(groups: DataFrame, gone: DataFrame) -> DataFrame:
    """The groups after files are gone; groups of one are no groups."""
    left = groups.drop("group_size").join(gone.select("path").hint("merge"), "path", "left_anti")  # merged as in delete_selected
    size = left.groupBy("group_id").agg(F.count("*").alias("group_size")).where("group_size > 1")
    return left.join(size, "group_id")


def destination_skips(groups: DataFrame, at_destination: Column) -> DataFrame:
    """(path, group_id): files that organising passes over: if a group has a file at the destination all others, else all
    but the best."""
    g = groups.withColumn("there", at_destination)
    has = g.groupBy("group_id").agg(F.bool_or("there").alias("has"))
    return g.join(has, "group_id").where(~F.col("there") & (F.col("has") | ~F.col("is_best"))).select("path", "group_id")


def fingerprints(image_info: DataFrame) -> DataFrame:
    """(path, h, resolution) of each scanned file, under the plain spelling of its path: a file that was scanned under several
    spellings is one file, with the hash and the resolution of its latest scans that have them."""
    return scans_in_force(image_info).withColumnRenamed("pkey", "path")


def same_files(paths: DataFrame, column: str = "path") -> DataFrame:
    """(path): the different files that a column of paths names, under their plain spelling."""
    return paths.select(path_key(column).alias("path")).where("path IS NOT NULL").distinct()


def hex_of(groups: DataFrame) -> DataFrame:
    return groups.withColumn("hash", hash_hex(F.col("h"))).drop("h")
