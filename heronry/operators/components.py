"""Connected components of an edge table, for the grouping operators of the core.

Min-label star contraction: each round links every vertex of an edge to the smallest neighbour it knows, until no label
changes. Rounds are cut by tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.session import Scratch


def connected_components(edges: DataFrame, scratch: Scratch | None = None, max_rounds: int = 60) -> DataFrame:
    """(vertex, component): every vertex of ``edges`` (a, b) with the smallest vertex it is linked to, directly or not.
    Edges with a null end are ignored; a loop (a = a) makes its vertex a component."""
    scratch = scratch or Scratch(edges.sparkSession, "components")
    pairs = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    kind = pairs.schema["a"].dataType
    vertices = scratch.save(pairs.select("a").union(pairs.select("b")).distinct().toDF("vertex"), "vertices")
    now = scratch.save(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        # large star: every larger neighbour of a vertex points to the smallest of the neighbourhood
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: every smaller neighbour, and the vertex, point to the smallest
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        after = scratch.save(small, "edges")
        same = after.count() == now.count() and after.exceptAll(now).isEmpty()
        scratch.drop(now)
        now = after
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    found = now.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    return (vertices.join(found, "vertex", "left")
            .select("vertex", F.coalesce("component", "vertex").cast(kind).alias("component")))
