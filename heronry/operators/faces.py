"""Matching face embeddings against known ones, leader clustering, and changes to people."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronry.operators.components import connected_components
from heronry.session import Scratch

_PROBES = 256  # probes that a task compares with a block at once
_PAIRS = 65_536  # pairs that it computes in double precision at once


def _unit(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """Rows whose vector has ``dim`` finite numbers, not all zero."""
    v = F.col(vector)
    top, low = F.array_max(v), F.array_min(v)
    return df.where((F.size(v) == dim) & (F.size(F.array_compact(v)) == dim) & (top < float("inf")) & (low > float("-inf")) & ((top != 0) | (low != 0)))


def _best(x: np.ndarray, y: np.ndarray, y32: np.ndarray, low: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, cosine to nine digits) of the vector of ``y`` most similar to each row of ``x``, of equal ones the first,
    without rows whose best is below ``low``. Single precision (``y32``) only tells which pairs are computed in double: those
    within its largest error of a row's best."""
    slack = np.float32((x.shape[1] + 8) * 2.0**-23)
    s = x.astype(np.float32) @ y32.T
    row, at = np.divmod(np.flatnonzero(s >= (np.maximum(s.max(1), np.float32(low)) - slack)[:, None]), len(y))
    exact = np.empty(len(row))
    for i in range(0, len(row), _PAIRS):
        exact[i:i + _PAIRS] = np.einsum("ij,ij->i", x[row[i:i + _PAIRS]], y[at[i:i + _PAIRS]])
    exact = np.round(exact, 9)
    order = np.lexsort((at, -exact, row))
    first = order[np.unique(row[order], return_index=True)[1]]
    return row[first], at[first], exact[first]


def _matches(batches, ids: np.ndarray, y: np.ndarray, low: float):
    """Batches (id, known_id, similarity) of batches (id, v) and a block of known vectors."""
    order = np.argsort(ids, kind="stable")
    ids, y = ids[order], y[order]
    y32 = y.astype(np.float32)
    for whole in batches:
        for start in range(0, whole.num_rows, _PROBES):
            batch = whole.slice(start, _PROBES)
            row, at, s = _best(_unit(batch.column(1)), y, y32, low)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(ids[at]), pa.array(s)], names=["id", "known_id", "similarity"])


def top_match(probes: DataFrame, known: DataFrame, threshold: float, block: int = 20_000, scratch: Scratch | None = None) -> DataFrame:
    """(id, known_id, similarity): the known vector (id, v) most similar to each probe (id, v), if its cosine is above 0 and
    at the threshold or above; of equal ones (to nine digits) the smallest known id.

    Known vectors are sent in blocks of about ``block`` rows, one at a time: beyond one block each is a pass over the probes
    whose answers, at most one row a probe, are written before the next is sent, so neither driver nor tasks hold more. A task
    compares _PROBES probes at a time with the block, whatever the size of its batches."""
    spark = probes.sparkSession
    scratch = scratch or Scratch(spark, "match")
    n = known.count()
    blocks = 1 if n <= block else -(-n // block) + 1
    found = None
    for b in range(blocks):
        part = known.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select("id", "v").toArrow()
        if not part.num_rows:
            continue
        sent = spark.sparkContext.broadcast((part.column(0).to_numpy(), _unit(part.column(1))))

        def run(batches, sent=sent):
            yield from _matches(batches, *sent.value, max(threshold, 0.0))

        rows = probes.select("id", "v").mapInArrow(run, "id long, known_id long, similarity double")
        if blocks > 1:
            rows = scratch.save(rows, "match")
            sent.destroy()
        found = rows if found is None else found.union(rows)
    if found is None:
        return spark.createDataFrame([], "id long, known_id long, similarity double")
    best = F.max(F.struct("similarity", (-F.col("known_id")).alias("k")))
    return (found.where((F.col("similarity") > 0) & (F.col("similarity") >= threshold)).groupBy("id").agg(best.alias("b"))
            .select("id", (-F.col("b.k")).alias("known_id"), F.col("b.similarity").alias("similarity")))


def leader_clusters(vectors: DataFrame, threshold: float = 0.5, step: int = 2000, scratch: Scratch | None = None) -> DataFrame:
    """(id, leader_id): greedy leader clustering of (id, v) in the order of id. A row joins the earliest leader whose cosine
    is at the threshold or above, else it becomes a leader; a null or unusable vector is its own leader.

    Each round takes the next ``step`` undecided rows, which settles them in order, and compares all other undecided rows
    with the new leaders, ``step`` at most. The result is that of the sequential pass; no pairs are kept."""
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "leaders")
    dim = vectors.where(F.col("v").isNotNull()).select(F.mode(F.size("v"))).first()[0] or 0
    good = usable(vectors.select("id", F.col("v").cast(T.ArrayType(T.DoubleType())).alias("v")), "v", dim)
    left = scratch.save(good, "left")
    out = vectors.join(left.select("id"), "id", "left_anti").select("id", F.col("id").alias("leader_id"))
    while True:
        head = left.orderBy("id").limit(step).toArrow()
        if not head.num_rows:
            return out
        ids, x = head.column(0).to_numpy(), _unit(head.column(1))
        s = np.round(x @ x.T, 9) >= threshold
        leader = np.full(len(ids), -1)
        for i in range(len(ids)):
            if leader[i] < 0:
                leader[(leader < 0) & s[i] & (np.arange(len(ids)) >= i)] = i
                leader[i] = i
        new = np.unique(leader)
        out = out.union(spark.createDataFrame(list(zip(ids.tolist(), ids[leader].tolist())), "id long, leader_id long"))
        if head.num_rows < step:
            return out
        sent = spark.sparkContext.broadcast((ids[new], x[new], int(ids[-1])))

        def run(batches, sent=sent):
            names, y, _ = sent.value
            for batch in batches:
                if batch.num_rows:
                    near = np.round(_unit(batch.column(1)) @ y.T, 9) >= threshold
                    at = near.argmax(1)
                    joined = near[np.arange(len(at)), at]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names[at], mask=~joined)], names=["id", "v", "leader_id"])

        placed = scratch.save(left.where(F.col("id") > int(ids[-1])).mapInArrow(run, "id long, v array<double>, leader_id long"), "placed")
        out = out.union(placed.where("leader_id IS NOT NULL").select("id", "leader_id"))
        left = placed.where("leader_id IS NULL").select("id", "v")


def merge_people(people: DataFrame, faces: DataFrame, merges: DataFrame, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(people, faces) after merges (keep_id, merge_id): faces of merge_id go to keep_id, then merge_id is deleted. Chains run
    on: persons merged with one another, directly or not, become the smallest of them that is merged into none, or the
    smallest of all if they are merged in a circle. Merges of a person with itself or with an unknown person are refused."""
    known = people.select("id").where("id IS NOT NULL").distinct()
    m = merges.where("keep_id <> merge_id").join(known.withColumnRenamed("id", "keep_id"), "keep_id", "left_semi").join(known.withColumnRenamed("id", "merge_id"), "merge_id", "left_semi")
    group = connected_components(m.select(F.col("keep_id").alias("a"), F.col("merge_id").alias("b")), scratch)
    gone = m.select(F.col("merge_id").alias("vertex"), F.lit(True).alias("gone")).distinct()
    best = F.min(F.struct(F.coalesce("gone", F.lit(False)).alias("gone"), "vertex"))["vertex"]
    keep = group.join(gone, "vertex", "left").groupBy("component").agg(best.alias("keep_id"))
    to = group.join(keep, "component").where("vertex <> keep_id").select(F.col("vertex").alias("merge_id"), "keep_id")
    moved = faces.join(to, faces["person_id"] == to["merge_id"], "left").select(
        *[F.coalesce("keep_id", "person_id").alias("person_id") if c == "person_id" else faces[c] for c in faces.columns])
    return people.join(to, people["id"] == to["merge_id"], "left_anti"), moved


def delete_people(people: DataFrame, faces: DataFrame, gone: DataFrame, purge: bool = False) -> tuple[DataFrame, DataFrame]:
    """(people, faces) after deleting people (id): their faces are deleted too, or lose their person."""
    g = gone.select(F.col("id").alias("gone")).distinct()
    left = people.join(g, people["id"] == g["gone"], "left_anti")
    if purge:
        return left, faces.join(g, faces["person_id"] == g["gone"], "left_anti")
    loose = faces.join(g, faces["person_id"] == g["gone"], "left").select(
        *[F.when(F.col("gone").isNull(), F.col("person_id")).alias("person_id") if c == "person_id" else faces[c] for c in faces.columns])
    return left, loose
