"""Grouping records into similarity clusters (problem 6): average linkage by reciprocal nearest neighbours.

The similarity of two clusters is the mean cosine of their pairs, which is the inner product of their mean vectors; so a
cluster is its mean vector, its size and its smallest id, however large it is. Each round gives every cluster its best partner
at the threshold or above (the sparse graph), merges all pairs that are each other's best, wherever they lie, and renews means
and similarities. As average linkage never raises the similarity of a merged cluster above that of its better part, merging
mutual best pairs in any order gives the tree of merging the best pair of all first; and a cluster's best partner stays until
it is itself merged. So only clusters that merged, or lost their partner by a merge, look for a new one.

Only clusters joined by a chain of pairs at the threshold can ever merge, so each connected part of that graph is a problem of
its own. The parts are found first: every cell (below) joins what it holds and tells one representative a vector, never its
pairs, and the grid of problem 2 joins the representatives. Parts of up to ``ONE_TASK`` vectors are linked to the end in one
task each; larger ones go on in rounds over the whole table.

Cells. Some vectors, drawn afresh each round by a hash of their id, are the centres of cells of about ``ROWS_PER_CELL``; a
vector is a row of its nearest centre's cell and also asks in the cells whose centre scores within a margin (``Z`` standard
deviations of what a neighbour at ``PROBE`` can differ). Pairs count for both ends. Centres follow the density, so a cluster
with a third of all rows is many cells; what is still overfull is cut in blocks that a query visits one by one. With one cell
the search is exact; with more, a pair can be missed.

So in the end an exact pass compares all clusters left with all, block by block against a broadcast, and rounds go on until no
pair at the threshold is left, however many it takes. It costs the square of the clusters left. Files, batches and partitions
do not change the result.

Copies of one vector are one cluster from the start, by partial aggregates, and never meet in a task.

Defined cases: vectors that are null, of another length, all zero or hold NaN, null or an infinity are in no cluster; equal
similarities (to nine digits) are ordered by a hash of the pair; no usable vectors give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from heronry.llm.consolidate import grid_components
from heronry.llm.neighbours import DIM, faces
from heronry.llm.vectors import Cells, hook, lists, lists_where, matrix, unit
from heronry.session import Scratch

THRESHOLD = 0.7
ROWS_PER_CELL = 4000
ONE_TASK = 4000
ROWS_PER_GROUP = 16_384
ROWS_PER_BROADCAST = 16_384
Z, PROBE = 0.5, 0.8
LITTLE = 0.01  # of the clusters: rounds that merge fewer leave the rest to the exact pass


def linkage(means: np.ndarray, sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge mutual best pairs until no similarity reaches the threshold: (cluster of each row, means, sizes).

    Similarities to a merged cluster are the weighted means of those to its parts. A cluster without a similarity at the
    threshold stays out for good. Rows of which all pairs reach it become one cluster in any order, at once."""
    n = len(means)
    means, sizes, owner = means.astype(np.float64), sizes.astype(np.float64).copy(), np.arange(n)
    s = (means @ means.T).astype(np.float32)
    if n > 1 and s.min() >= threshold + 1e-5:
        means[0] = np.average(means, axis=0, weights=sizes)
        sizes[0] = sizes.sum()
        return np.zeros(n, np.int64), means.astype(np.float32), sizes
    # near ties: every row prefers by one symmetric order, else copies would merge one pair a round
    h = (np.arange(n) * 2654435761 % 4294967296).astype(np.uint32)
    for i in range(0, n, 256):
        s[i:i + 256] += (((h[i:i + 256, None] ^ h[None, :]) * np.uint32(0x9E3779B1)) >> np.uint32(12)).astype(np.float32) * np.float32(2e-6 / (1 << 20))
    np.fill_diagonal(s, -2)
    live = np.arange(n)
    while len(live) > 1:
        best = s.argmax(1)
        a = np.arange(len(live))
        on = s[a, best] >= threshold
        mutual = on & (best[best] == a) & (a < best)
        i, j = a[mutual], best[mutual]
        if not len(i):
            break
        p, q = live[i], live[j]
        total = sizes[p] + sizes[q]
        u, v = (sizes[p] / total), (sizes[q] / total)
        s[i] = s[i] * u[:, None].astype(np.float32) + s[j] * v[:, None].astype(np.float32)
        s[:, i] = s[:, i] * u.astype(np.float32) + s[:, j] * v.astype(np.float32)
        s[i, i] = -2
        means[p] = means[p] * u[:, None] + means[q] * v[:, None]
        sizes[p], owner[q] = total, p
        on[i] = True
        on[j] = False
        keep = np.nonzero(on)[0]
        live, s = live[keep], s[np.ix_(keep, keep)]
    while True:
        up = owner[owner]
        if (up == owner).all():
            return owner, means.astype(np.float32), sizes
        owner = up


_NODE = "id long, n long, v array<float>"
_LINK = "id long, other long, s double"


def _best(x_id: np.ndarray, x: np.ndarray, q_id: np.ndarray, q: np.ndarray, threshold: float, step: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, other, s): for each query its best row, and for each row its best query, at the threshold or above."""
    links, row_s, row_q = [], np.full(len(x), -np.inf, np.float32), np.zeros(len(x), np.int64)
    for i in range(0, len(q), step):
        s = q[i:i + step] @ x.T
        s[q_id[i:i + step, None] == x_id[None, :]] = -np.inf
        at = s.argmax(1)
        links.append((np.arange(i, i + len(at)), at, s[np.arange(len(at)), at]))
        top = s.max(0)
        up = np.nonzero((top >= threshold - 1e-5) & (top > row_s))[0]
        row_s[up], row_q[up] = top[up], s[:, up].argmax(0) + i
    links.append((row_q, np.arange(len(x)), row_s))
    a, b, rough = (np.concatenate(y) for y in zip(*links))
    on = rough >= threshold - 1e-5  # single precision first
    a, b = np.divmod(np.unique(a[on] * len(x) + b[on]), len(x))
    s = np.concatenate([np.einsum("nd,nd->n", q[a[j:j + 20_000]].astype(np.float64), x[b[j:j + 20_000]].astype(np.float64)) for j in range(0, len(a), 20_000)] or [np.empty(0)]).round(9)
    on = s >= threshold
    return q_id[a[on]], x_id[b[on]], s[on]


def _joined(x_id: np.ndarray, x: np.ndarray, q_id: np.ndarray, q: np.ndarray, threshold: float, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(id, rep): the smallest id that queries and rows reach over pairs of a query and a row at the threshold, where it is another."""
    names, at = np.unique(np.concatenate([x_id, q_id]), return_inverse=True)
    x_at, q_at = at[:len(x_id)], at[len(x_id):]
    parent = np.arange(len(names))
    for i in range(0, len(q), step):
        a, b = np.divmod(np.flatnonzero((q[i:i + step] @ x.T).ravel() >= threshold - 1e-6), len(x))
        hook(parent, q_at[a + i], x_at[b])
    other = parent != np.arange(len(names))
    return names[other], names[parent[other]]


def _links(found) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(y) for y in found], names=["id", "other", "s"])


def probed(nodes: DataFrame, left: int, r: int, threshold: float, dim: int, joined: bool = False) -> tuple[DataFrame, bool]:
    """(links (id, other, s), whether none can be missed) of nodes (id, n, v, asks): for each the best partner that a search by
    cells finds; ``joined``: links (a, b) that connect what is at the threshold."""
    k = max(1, left // ROWS_PER_CELL)
    drawn = min(left, 2 * k + 4096)  # centres, and some more to tell how full their cells will be
    order = F.pmod(F.xxhash64("id", F.lit(r)), F.lit(1 << 30))
    some = nodes.where(order < int((1 << 30) * min(1.0, 1.2 * drawn / left + 0.001))).orderBy(order, "id").limit(drawn).select("v").toArrow()
    x = unit(matrix(some.column(0), dim))
    cells = Cells(x[:k])
    k = len(cells.centres)
    share = np.bincount(cells.near(x)[0], minlength=k) / len(x)
    blocks = np.maximum(1, np.ceil(share * left / (2 * ROWS_PER_CELL))).astype(np.int64)
    spread = Z * np.sqrt(2 - 2 * PROBE) / np.sqrt(dim)
    sent = nodes.sparkSession.sparkContext.broadcast((cells, blocks))

    def place(batches):
        c, parts = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            ids, v, asks = b.column(0).to_numpy(), matrix(b.column(1), dim), b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            home, rows, near = c.near(unit(v), spread)
            with np.errstate(over="ignore"):
                h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
            block = (h % parts[home].astype(np.uint64)).astype(np.int64)
            # a row stays in its cell and block; a query goes to all blocks of its cells
            q = np.concatenate([np.nonzero(asks)[0], rows[asks[rows]]])
            to = np.concatenate([home[asks], near[asks[rows]]])
            n = parts[to]
            q, to = np.repeat(q, n), np.repeat(to, n)
            at = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
            own = (to == home[q]) & (at == block[q])
            row = np.concatenate([np.arange(len(ids)), q[~own]])
            cell, part = np.concatenate([home, to[~own]]), np.concatenate([block, at[~own]])
            role = np.concatenate([np.where(asks, 3, 1), np.full((~own).sum(), 2)]).astype(np.int8)
            for i in range(0, len(row), 10_000):
                p = slice(i, i + 10_000)
                yield pa.RecordBatch.from_arrays([pa.array(cell[p].astype(np.int32)), pa.array(part[p].astype(np.int32)), pa.array(ids[row[p]]), pa.array(role[p]), lists(v[row[p]])],
                                                 names=["cell", "part", "id", "role", "v"])

    def in_cell(t: pa.Table) -> pa.Table:
        ids, role, v = t.column("id").to_numpy(), t.column("role").to_numpy(), matrix(t.column("v"), dim)
        order = np.argsort(ids, kind="stable")
        ids, role, v = ids[order], role[order], v[order]
        x, q = role & 1 > 0, role & 2 > 0
        if joined:
            return pa.table(dict(zip("ab", _joined(ids[x], v[x], ids[q], v[q], threshold))))
        return pa.Table.from_batches([_links(_best(ids[x], v[x], ids[q], v[q], threshold) if x.any() and q.any() else (ids[:0], ids[:0], np.empty(0)))])

    placed = nodes.select("id", "v", "asks").mapInArrow(place, "cell int, part int, id long, role tinyint, v array<float>")
    return placed.groupBy("cell", "part").applyInArrow(in_cell, "a long, b long" if joined else _LINK), k == 1 and blocks[0] == 1


def compared(nodes: DataFrame, threshold: float, dim: int, scratch: Scratch) -> DataFrame:
    """links (id, other, s): of each node of nodes (id, n, v, asks) that asks the best of all, and for each node its best that asks."""
    spark = nodes.sparkSession
    parts = -(-nodes.where("asks").count() // ROWS_PER_BROADCAST)
    out = spark.createDataFrame([], _LINK)
    for part in range(parts):
        some = nodes.where("asks").where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).select("id", "v").toArrow()
        sent = spark.sparkContext.broadcast((some.column(0).to_numpy(), matrix(some.column(1), dim)))

        def compare(batches, sent=sent):
            q_id, q = sent.value
            for b in batches:
                if b.num_rows and len(q_id):
                    yield _links(_best(b.column(0).to_numpy(), matrix(b.column(1), dim), q_id, q, threshold))

        # of a task's batches only the best link of each end goes on
        links = nodes.select("id", "v").mapInArrow(compare, _LINK)
        out = out.union(scratch.save(best_links(links), "compared").select("id", "other", "b.s"))
        sent.destroy()
    return out


def best_links(links: DataFrame) -> DataFrame:
    """(id, other, b (s, h, other)): of links (id, other, s), taken both ways, the best of each end."""
    both = links.select("id", "other", "s").union(links.select("other", "id", "s"))
    b = F.struct("s", F.xxhash64(F.least("id", "other"), F.greatest("id", "other")).alias("h"), "other")
    return both.groupBy("id").agg(F.max(b).alias("b")).select("id", "b.other", "b")


def _linked(ids: np.ndarray, n: np.ndarray, v: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """(id, rep, n, v, whether it is a head) after linkage() of rows in the order of their ids."""
    owner, mean, size = linkage(v, n, threshold)
    first = np.full(len(ids), len(ids))
    np.minimum.at(first, owner, np.arange(len(ids)))
    rep = first[owner]
    return ids, ids[rep], size[owner], mean[owner], rep == np.arange(len(ids))


def in_parts(nodes: DataFrame, groups: int, threshold: float, dim: int) -> DataFrame:
    """(id, rep, n, v) of nodes (part, id, n, v), each part linked to its end in one task; n and v only in the row of a head."""

    def run(t: pa.Table) -> pa.Table:
        part, ids, n, v = t.column("part").to_numpy(), t.column("id").to_numpy(), t.column("n").to_numpy(), matrix(t.column("v"), dim)
        order = np.lexsort((ids, part))
        part, ids, n, v = part[order], ids[order], n[order], v[order]
        cut = np.nonzero(np.diff(part))[0] + 1
        out = [_linked(ids[a:b], n[a:b], v[a:b], threshold) for a, b in zip([0, *cut], [*cut, len(ids)])]
        i, rep, size, mean, head = (np.concatenate(y) for y in zip(*out))
        return pa.table({"id": i, "rep": rep, "n": np.where(head, size, 0).astype(np.int64), "v": lists_where(mean, head)})

    return nodes.groupBy(F.pmod(F.xxhash64("part"), F.lit(groups)).alias("group")).applyInArrow(run, "id long, rep long, n long, v array<float>")


def _merge(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """nodes (id, n, v) after moves (id, to), where no node that is moved to moves itself: sizes added up, means weighted."""
    ends = moves.select("id", F.col("to").alias("rep")).union(moves.select(F.col("to").alias("id"), F.col("to").alias("rep")).distinct())
    j = nodes.select("id", "n", "v").join(ends, "id", "left")
    total = F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    zero = F.array_repeat(F.lit(0.0), F.size(F.element_at("m", 1)["v"]))
    mean = F.transform(F.aggregate("m", zero, lambda a, x: F.zip_with(a, x["v"], lambda p, q: p + q.cast("double") * x["n"])), lambda s: (s / F.col("total")).cast("float"))
    touched = j.where("rep IS NOT NULL").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("id", "n", "v"))).alias("m")).withColumn("total", total)
    return (j.where("rep IS NULL").select("id", "n", "v", F.lit(False).alias("fresh"))
            .union(touched.select(F.col("rep").alias("id"), F.col("total").alias("n"), mean.alias("v"), F.lit(True).alias("fresh"))))


def rounds(nodes: DataFrame, left: int | None, threshold: float, dim: int, scratch: Scratch, sure: bool, exact: bool = True) -> tuple[list[DataFrame], DataFrame]:
    """(moves (id, to), heads (id, n, v)) of nodes (id, n, v): mutual best pairs merged until none is left. ``sure``: all are
    compared with all from the start, else once a round by cells merges little."""
    moves, done, known, r = [], None, None, 0
    now = scratch.save(nodes.select("id", "n", "v", F.lit(True).alias("asks")), "nodes")
    left = now.count() if left is None else left
    while left > 1:
        if sure:
            links, whole = compared(now, threshold, dim, scratch), True
        else:
            links, whole = probed(now, left, r, threshold, dim)
        found = best_links(links)
        if known is not None:  # a partner stays the best until one of the two is merged
            found = found.union(known).groupBy("id").agg(F.max("b").alias("b")).select("id", "b.other", "b")
        found = scratch.save(found, "best")
        pair = found.groupBy(F.least("id", "other").alias("to"), F.greatest("id", "other").alias("id")).count()
        step = scratch.save(pair.where("count = 2").select("id", "to"), "step")
        merged = step.count()
        if not merged and (whole or not exact):
            break
        moves.append(step)
        touched = step.select("id").union(step.select(F.col("to").alias("id")))
        known = scratch.save(found.join(touched, "id", "left_anti").join(touched.select(F.col("id").alias("other")), "other", "left_anti").select("id", "other", "b"), "known")
        after = _merge(now, step)
        held = found.select("id").join(known.select("id", F.lit(True).alias("knows")), "id", "left").select("id", F.coalesce("knows", F.lit(False)).alias("knows"))
        after = after.join(held, "id", "left")
        if whole:  # all have asked all: who has no partner now never gets one
            finished = scratch.save(after.where("knows IS NULL AND NOT fresh").select("id", "n", "v"), "done")
            done = finished if done is None else done.union(finished)
            after = after.where("knows IS NOT NULL OR fresh")
        sure = sure or whole or (exact and merged < LITTLE * left)
        if sure and not whole:  # the exact pass begins, so all ask
            known, asks = None, F.lit(True)
        else:
            asks = F.col("fresh") | ~F.coalesce("knows", F.lit(True))
        before, now = now, scratch.save(after.select("id", "n", "v", asks.alias("asks")), "nodes")
        scratch.drop(before)
        left, r = now.count(), r + 1
        if whole and 1 < left <= ONE_TASK:
            last = scratch.save(in_parts(now.withColumn("part", F.lit(0).cast("long")), 1, threshold, dim), "linked")
            moves.append(last.where("id <> rep").select("id", F.col("rep").alias("to")))
            now = last.where("v IS NOT NULL")
            break
    heads = now.select("id", "n", "v")
    return moves, heads if done is None else heads.union(done)


def cluster(vectors: DataFrame, threshold: float = THRESHOLD, dim: int = DIM, scratch: Scratch | None = None, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """Vectors (id long, v array<float>, all usable) to members (id, rep) and clusters (rep, n, v): rep is the smallest id of
    the cluster, n its size, v the mean of its unit vectors. Without ``exact`` the exact pass is left out: nothing then costs a
    square, and clusters that no search brought together stay apart."""
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "clusters")

    def units(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists(unit(matrix(b.column(2), dim)))], names=["id", "n", "v"])

    # copies by two hashes of the vector: only ids and hashes are shuffled
    keyed = scratch.save(vectors.select("id", F.xxhash64("v").alias("a"), F.hash("v").alias("b")), "keys")
    same = scratch.save(keyed.groupBy("a", "b").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1"), "copies")
    copied = F.xxhash64("v") == F.col("a"), F.hash("v") == F.col("b")
    alone = vectors.select("id", "v").join(same, copied[0] & copied[1], "left").where("rep IS NULL OR rep = id")
    nodes = scratch.save(alone.select("id", F.coalesce("n", F.lit(1)).cast("long").alias("n"), "v").mapInArrow(units, _NODE), "nodes")
    moves = [keyed.join(same, ["a", "b"]).where("rep <> id").select("id", F.col("rep").alias("to"))]
    left = nodes.count()
    if left:
        links, _ = probed(nodes.withColumn("asks", F.lit(True)), left, 0, threshold, dim, joined=True)
        parts = scratch.save(grid_components(links, scratch=scratch).select(F.col("vertex").alias("id"), F.col("component").alias("part")), "parts")
        sizes = scratch.save(parts.groupBy("part").agg(F.count("*").alias("size")), "sizes")
        large, inside = sizes.agg(F.sum(F.when(F.col("size") > ONE_TASK, F.col("size"))), F.sum(F.when(F.col("size") <= ONE_TASK, F.col("size")))).first()
        placed = nodes.join(parts.join(sizes, "part"), "id", "left")
        heads = placed.where("part IS NULL").select("id", "n", "v")
        if inside:
            small = scratch.save(in_parts(placed.where(F.col("size") <= ONE_TASK).select("part", "id", "n", "v"), -(-inside // ROWS_PER_GROUP), threshold, dim), "linked")
            moves.append(small.where("id <> rep").select("id", F.col("rep").alias("to")))
            heads = heads.union(small.where("v IS NOT NULL").select("id", "n", "v"))
        if large:
            far, rest = rounds(placed.where(F.col("size") > ONE_TASK), large, threshold, dim, scratch, False, exact)
            moves += far
            heads = heads.union(rest)
        if exact:
            far, heads = rounds(heads, None, threshold, dim, scratch, True)
            moves += far
    else:
        heads = nodes
    parent = moves[0]
    for m in moves[1:]:
        parent = parent.union(m)
    parent = scratch.save(parent, "parents")  # every id moves once at most
    while True:
        up = parent.select(F.col("id").alias("to"), F.col("to").alias("next"))
        parent = scratch.save(parent.select("id", "to").join(up, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "parents")
        if parent.where("moved").isEmpty():
            break
    members = keyed.select("id").join(parent.select("id", "to"), "id", "left").select("id", F.coalesce("to", "id").alias("rep"))
    return members, heads.select(F.col("id").alias("rep"), "n", "v")


def p6_found(spark, folder: str) -> DataFrame:
    """(face_id, cluster_face_id): each face of a cluster of three or more, with the cluster's smallest face id."""
    members, clusters = cluster(faces(spark, folder), scratch=Scratch(spark, "p6"))
    return members.join(clusters.where("n >= 3").select("rep"), "rep", "left_semi").select(F.col("id").alias("face_id"), F.col("rep").alias("cluster_face_id"))


def p6_clusters(spark, folder: str, typical: int = 3) -> DataFrame:
    """(cluster_face_id, faces, cohesion, typical): each cluster of three or more with its size, the mean cosine of its pairs
    (a face with itself included) and its faces nearest to the mean, nearest first."""
    f = faces(spark, folder)
    members, clusters = cluster(f, scratch=Scratch(spark, "p6"))
    large = clusters.where("n >= 3").withColumnRenamed("v", "m")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, p: s + p)
    with_mean = f.join(members, "id").join(large, "rep")
    near = F.round(dot(F.col("v"), F.col("m")) / F.sqrt(dot(F.col("v"), F.col("v")) * dot(F.col("m"), F.col("m"))), 9)
    best = F.row_number().over(W.partitionBy("rep").orderBy(F.col("near").desc(), "id"))
    top = with_mean.select("rep", "id", near.alias("near")).withColumn("at", best).where(F.col("at") <= typical)
    named = top.groupBy("rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda s: s["id"]).alias("typical"))
    return large.select(F.col("rep"), F.col("n").alias("faces"), F.round(dot(F.col("m"), F.col("m")), 6).alias("cohesion")).join(named, "rep").withColumnRenamed("rep", "cluster_face_id")
