"""Consolidating pairwise matches into groups (problem 2): union-find on a two-dimensional grid.

Vertices are hashed into B blocks, an edge lies in the cell (block of one end, block of the other). Every cell runs a local
union-find over its edges and tells each of its vertices the smallest vertex it reaches there. Rows and columns of the grid
exchange these representatives: a vertex takes the smallest of all its cells, and what the other cells named becomes an edge
between representatives. The rounds go on over these contracted edges until there are none, so parents are stable.

Which end of an edge names the row and which the column is told by a hash of the ends, so a vertex with a third of all edges
has them in the 2 B - 1 cells of its row and column; and a cell with more than ``edges_per_cell`` edges is cut in pieces by a
hash of the edge, each a union-find of its own. So no task gets a whole group.

Defined cases: null ends are no match; a loop puts its vertex into a group of its own; repeated edges count once; no edges
give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.functions.paths import path_key
from heronry.llm.vectors import hook
from heronry.operators.hamming import hamming_pairs
from heronry.session import Scratch
from heronry.sources.tables import files_by_path, scans_in_force


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, smallest vertex reached from each) of the edges a-b."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)  # sorted: the smaller index is the smaller vertex
    parent = np.arange(len(names))
    hook(parent, at[:len(a)], at[len(a):])
    return names, names[parent]


def _cell(edges: pa.Table) -> pa.Table:
    v, r = local_roots(edges.column("a").to_numpy(), edges.column("b").to_numpy())
    return pa.table({"v": v[v != r], "r": r[v != r]})


def grid_components(edges: DataFrame, edges_per_cell: int = 250_000, scratch: Scratch | None = None, max_rounds: int = 40) -> DataFrame:
    """(vertex long, component long): each vertex of ``edges`` (a, b) with the smallest vertex linked to it."""
    scratch = scratch or Scratch(edges.sparkSession, "grid")
    given = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    first = scratch.save(given.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    now, parents = first.where("a <> b"), None
    for _ in range(max_rounds):
        n = now.count()
        if n == 0:
            break
        blocks = max(1, math.ceil(math.sqrt(n / edges_per_cell)))
        block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
        row = F.pmod(F.xxhash64("a", "b"), F.lit(2)) == 0
        placed = now.withColumn("x", F.when(row, block("a")).otherwise(block("b"))).withColumn("y", F.when(row, block("b")).otherwise(block("a")))
        full = [(r["x"], r["y"], -(-r["count"] // edges_per_cell)) for r in placed.groupBy("x", "y").count().where(F.col("count") > edges_per_cell).collect()]  # blocks * blocks at most
        piece = F.lit(0)
        if full:
            cut = F.create_map(*[F.lit(v) for x, y, k in full for v in (f"{x}.{y}", k)])
            piece = F.pmod(F.xxhash64("a", "b", F.lit(1)), F.coalesce(F.try_element_at(cut, F.concat_ws(".", "x", "y")), F.lit(1)))
        cells = placed.withColumn("piece", piece).groupBy("x", "y", "piece").applyInArrow(_cell, "v long, r long")
        told = scratch.save(cells, "told")
        if parents is not None:  # a vertex that got a parent before and is named again brings that parent along
            told = told.union(parents.join(told, parents["vertex"] == told["v"], "left_semi").select("vertex", "p"))
        best = scratch.save(told.groupBy("v").agg(F.min("r").alias("r")), "best")
        # what else a vertex was told is linked to the smallest of it, so each round drops vertices
        other = told.join(best.withColumnRenamed("r", "m"), "v").where("r <> m").select(F.least("m", "r").alias("a"), F.greatest("m", "r").alias("b"))
        fresh = best.select(F.col("v").alias("vertex"), F.col("r").alias("p"))
        parents = fresh if parents is None else scratch.save(parents.join(fresh, "vertex", "left_anti").union(fresh), "parents")
        now = scratch.save(other.distinct(), "edges")
    else:
        raise RuntimeError("the grid did not settle")
    vertices = first.select("a").union(first.select("b")).distinct().toDF("vertex")
    if parents is None:
        return vertices.select("vertex", F.col("vertex").alias("component"))
    # a parent may itself have been given a parent in the same round
    while True:
        up = parents.select(F.col("vertex").alias("w"), F.col("p").alias("g"))
        higher = scratch.save(parents.join(up, parents["p"] == up["w"], "left").select("vertex", F.coalesce("g", "p").alias("p"), F.col("g").isNotNull().alias("moved")), "parents")
        parents = higher.drop("moved")
        if higher.where("moved").isEmpty():
            break
    return vertices.join(parents, "vertex", "left").select("vertex", F.coalesce("p", "vertex").alias("component"))


def picture_links(media_files: DataFrame, image_info: DataFrame, duplicate_groups: DataFrame, threshold: int, scratch: Scratch) -> DataFrame:
    """(a, b) file ids: enough links to connect all files that one duplicate_groups row lists or whose hashes are near.

    A listed group and the files of one hash are stars around their smallest file, never all pairs."""
    files = scratch.save(files_by_path(media_files), "files")
    listed = duplicate_groups.select("group_id", F.explode("paths").alias("path")).select("group_id", path_key("path").alias("pkey")).distinct()
    # merged, never broadcast: Spark takes the exploded paths to be as small as the lists
    member = scratch.save(listed.hint("merge").join(files, "pkey").select("group_id", "file_id"), "members")
    star = member.groupBy("group_id").agg(F.min("file_id").alias("a"))
    by_list = member.join(star, "group_id").where("a <> file_id").select("a", F.col("file_id").alias("b"))
    hashed = scratch.save(scans_in_force(image_info).where("h IS NOT NULL").join(files, "pkey").select("h", "file_id"), "hashed")
    heads = scratch.save(hashed.groupBy("h").agg(F.min("file_id").alias("a")), "heads")
    by_hash = hashed.join(heads, "h").where("a <> file_id").select("a", F.col("file_id").alias("b"))
    near = hamming_pairs(heads, threshold, scratch=scratch).toDF("h", "k")
    by_distance = near.join(heads, "h").select("k", "a").join(heads.select(F.col("h").alias("k"), F.col("a").alias("b")), "k").select("a", "b")
    return by_list.union(by_hash).union(by_distance)


def p2_found(spark, folder: str) -> DataFrame:
    """(file_id, group_file_id) of every file linked to another, by list or by hash at distance 5 or less."""
    from heronry.sources.tables import table
    scratch = Scratch(spark, "p2")
    links = picture_links(table(spark, folder, "media_files"), table(spark, folder, "image_info"), table(spark, folder, "duplicate_groups"), 5, scratch)
    return grid_components(links, scratch=scratch).select(F.col("vertex").alias("file_id"), F.col("component").alias("group_file_id"))
