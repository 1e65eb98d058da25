"""Most similar vectors for every vector (problem 3): anisotropic quantisation, four-bit table scans, exact reranking.

Index. Coarse centres (in two levels) and, per two dimensions of the residual, a codebook of sixteen words are fitted on a bounded sample
(``SAMPLE`` rows); every row is indexed. Words are fitted and chosen by the score-aware loss: an error parallel to the vector
counts eta times one at right angles, as it is the parallel part that shifts high inner products. A row keeps 64 four-bit
codes and a bound on its quantised score's error.

Search. A query goes to the cells whose centre scores within a margin of its best one, the margin being ``Z`` standard
deviations of the score difference that a neighbour at the wanted cosine can have. In a cell, the inner products of all its
rows with a block of queries are read from tables of sixteen entries per codebook. With a least cosine t, a row x is reranked
if its table score reaches t less |x . err| + sqrt(2 - 2t) |err|; a neighbour at t or more cannot lie below that, so within
the probed cells nothing is lost. Without a least cosine, the ``rerank`` best table scores of each cell are reranked; that
and the probing are the accepted loss of accuracy. Reranking computes cosines in double precision.

Copies of one vector are one row in the scan, in each batch before the shuffle and in each cell after it. Of a group of more
than k + 1 copies, the copies beyond that need no search: their k most similar are its k smallest ids, with cosine 1. They are
found by a hash of the vector, of which every task keeps k + 1 ids, and never gathered. A cell whose share of the sample makes it too large is cut into blocks of
rows by a hash of the vector, which its queries visit in turn.

Defined cases: vectors that are null, of another length, all zero or hold NaN, null or an infinity are not searched nor
found; equal cosines (to nine digits) are ordered by id; a vector is not its own neighbour; no usable vectors give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from heronry.llm.vectors import Cells, lists, matrix, nearest, unit, usable
from heronry.session import Scratch
from heronry.sources.tables import table

DIM = 128
SAMPLE = 65_536
FITTED = 8192
ROWS_PER_CELL = 400
ROWS_PER_BLOCK = 20_000
QUERIES_PER_BROADCAST = 8192
Z = 1.25
SCORE = 0.5  # inner products above this are those the quantisation cares for


def centres(sample: np.ndarray, k: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """Spherical k-means of unit rows."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), k, replace=False)].copy()
    for _ in range(rounds):
        own = Cells(c).near(sample)[0]
        order = np.argsort(own, kind="stable")
        cells, first = np.unique(own[order], return_index=True)
        total = np.add.reduceat(sample[order].astype(np.float64), first, axis=0)
        length = np.linalg.norm(total, axis=1)
        c[cells[length > 0]] = (total[length > 0] / length[length > 0, None]).astype(np.float32)
    return c


class Quantiser:
    """Codebooks of 16 words per ``sub`` dimensions, with the anisotropic loss |err|^2 + (eta - 1) (x . err)^2."""

    def __init__(self, x: np.ndarray, residual: np.ndarray, score: float = SCORE, sub: int = 2, rounds: int = 4, seed: int = 7):
        n, dim = x.shape
        self.sub, self.parts = sub, dim // sub
        self.eta = (dim - 1) * score ** 2 / (1 - score ** 2)
        rng = np.random.default_rng(seed)
        r = residual.reshape(n, self.parts, sub)
        self.words = np.ascontiguousarray(r[rng.choice(n, 16, replace=n < 16)].transpose(1, 0, 2)).astype(np.float32)
        for _ in range(rounds):
            codes, par = self.encode(x, residual)
            xs = x.reshape(n, self.parts, sub)
            for s in range(self.parts):
                word = self.words[s][codes[:, s]]
                base = par - np.einsum("nd,nd->n", xs[:, s], r[:, s] - word)
                for w in range(16):
                    m = codes[:, s] == w
                    if m.any():
                        xm, rm = xs[m, s].astype(np.float64), r[m, s].astype(np.float64)
                        left = m.sum() * np.eye(sub) + (self.eta - 1) * xm.T @ xm
                        right = rm.sum(0) + (self.eta - 1) * xm.T @ (base[m] + np.einsum("nd,nd->n", xm, rm))
                        self.words[s, w] = np.linalg.solve(left, right)
                par = base + np.einsum("nd,nd->n", xs[:, s], r[:, s] - self.words[s][codes[:, s]])

    def encode(self, x: np.ndarray, residual: np.ndarray, sweeps: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(codes, x . err): nearest words first, then each part in turn takes the word of least loss given the others."""
        n = len(x)
        r, xs = residual.reshape(n, self.parts, self.sub), x.reshape(n, self.parts, self.sub)
        codes, par = np.empty((n, self.parts), np.uint8), np.zeros(n, np.float32)
        row = np.arange(n)
        for s in range(self.parts):
            e = r[:, s, None, :] - self.words[s]
            codes[:, s] = np.einsum("nwd,nwd->nw", e, e).argmin(1)
            par += np.einsum("nd,nd->n", xs[:, s], e[row, codes[:, s]])
        for _ in range(sweeps):
            for s in range(self.parts):
                e = r[:, s, None, :] - self.words[s]
                p = np.einsum("nd,nwd->nw", xs[:, s], e)
                base = par - p[row, codes[:, s]]
                codes[:, s] = (np.einsum("nwd,nwd->nw", e, e) + np.float32(self.eta - 1) * (base[:, None] + p) ** 2).argmin(1)
                par = base + p[row, codes[:, s]]
        return codes, par

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.words[s][codes[:, s]] for s in range(self.parts)], axis=1)

    def scan(self, codes: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """(rows, queries): scores of the residuals, added up from tables of sixteen entries."""
        q = queries.reshape(len(queries), self.parts, self.sub)
        tables = np.ascontiguousarray(np.einsum("qsd,swd->swq", q, self.words))
        total, part = np.zeros((len(codes), len(queries)), np.float32), np.empty((len(codes), len(queries)), np.float32)
        columns = np.ascontiguousarray(codes.T).astype(np.intp)
        for s in range(self.parts):
            np.take(tables[s], columns[s], axis=0, out=part, mode="clip")
            total += part
        return total


class Index:
    """What every task needs: centres in two levels, codebooks, blocks per cell. There are rows / ``rows_per_cell`` centres, at
    most one per row of the sample, and a row looks at about the square root of them."""

    def __init__(self, sample: np.ndarray, rows: int, rows_per_cell: int = ROWS_PER_CELL, rows_per_block: int = ROWS_PER_BLOCK):
        k = max(1, min(rows // rows_per_cell, len(sample)))
        self.centres = centres(sample, k)
        self.cells = Cells(self.centres)
        own = self.cells.near(sample)[0]
        some = sample[:FITTED]
        self.quantiser = Quantiser(some, some - self.centres[own[:FITTED]])
        share = np.bincount(own, minlength=k) / max(1, len(sample))
        self.blocks = np.maximum(1, np.ceil(share * rows / rows_per_block)).astype(np.int64)

    def probes(self, x: np.ndarray, cosine: float, z: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home cell of each row, rows, cells): the other cells where a neighbour at the cosine may be."""
        return self.cells.near(x, z * np.sqrt(2 - 2 * cosine) / np.sqrt(x.shape[1]))


def _same(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each different vector, number of it for each row)."""
    view = np.ascontiguousarray(raw).view(np.dtype((np.void, raw.shape[1] * raw.itemsize))).ravel()
    _, first, inverse = np.unique(view, return_index=True, return_inverse=True)
    return first, inverse.ravel()


def _smallest(ids: np.ndarray, group: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest ids of each group, as (group, id) sorted."""
    order = np.lexsort((ids, group))
    g, i = group[order], ids[order]
    start = np.searchsorted(g, g)
    keep = np.arange(len(g)) - start < k
    return g[keep], i[keep]


def _least(ids: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The smallest id of each group 0, 1, ..."""
    out = np.full(group.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(out, group, ids)
    return out


def _first(group: np.ndarray, order: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the first k of their group."""
    at = np.lexsort((tie, order, group))
    g = group[at]
    keep = np.empty(len(g), bool)
    keep[at] = np.arange(len(g)) - np.searchsorted(g, g) < k
    return keep


def _cosines(x: np.ndarray, q: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.einsum("nd,nd->n", x[r[i:i + 20_000]], q[c[i:i + 20_000]]) for i in range(0, len(r), 20_000)] or [np.empty(0)])


def search_cell(index: Index, cell: int, x_id: np.ndarray, x_raw: np.ndarray, q_id: np.ndarray, q_raw: np.ndarray, k: int, least: float | None, rerank: int) -> pd.DataFrame:
    """q, x, cosine: what the rows of one cell have for its queries; without those that cannot be among k most similar."""
    none = pd.DataFrame({"q": np.empty(0, np.int64), "x": np.empty(0, np.int64), "cosine": np.empty(0)})
    if not len(x_id) or not len(q_id):
        return none
    xf, xg = _same(x_raw)
    qf, qg = _same(q_raw)
    x, q = unit(x_raw[xf]), unit(q_raw[qf])
    centre, qz = index.centres[cell], index.quantiser
    codes, par = qz.encode(x, x - centre)
    err = np.linalg.norm(x - centre - qz.decode(codes), axis=1)
    slack = np.abs(par) + (np.sqrt(2 - 2 * least) * err if least is not None else 0) + 1e-4
    x8, q8 = unit(x_raw[xf], np.float64), unit(q_raw[qf], np.float64)
    x_least, q_least = _least(x_id, xg), _least(q_id, qg)
    rows, cols = [], []
    best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)  # of each row so far: (row, query, cosine)
    for i in range(0, len(q), 256):
        block = q[i:i + 256]
        s = qz.scan(codes, block) + block @ centre
        if least is not None:
            r, c = np.nonzero(s >= (least - slack)[:, None])
            if len(r):  # single precision first: few of these pairs are near the limit, and a crowded cell has many
                if len(r) > 8 * len(x):
                    near = (x @ block.T)[r, c]
                else:
                    near = np.concatenate([np.einsum("nd,nd->n", x[r[j:j + 20_000]], block[c[j:j + 20_000]]) for j in range(0, len(r), 20_000)])
                r, c = r[near >= least - 1e-4], c[near >= least - 1e-4]
            if not len(r):
                continue
            c = c + i
            cosine = _cosines(x8, q8, r, c)
            r, c, cosine = (y[cosine >= least] for y in (r, c, cosine))
            # a query has met all rows of the block, a row goes on; one more than k, as either may meet itself
            m = _first(c, -cosine.round(9), x_least[r], k + 1)
            rows.append(r[m])
            cols.append(c[m])
            best = tuple(np.concatenate(y) for y in zip(best, (r, c, cosine)))
            m = _first(best[0], -best[2].round(9), q_least[best[1]], k + 1)
            best = tuple(y[m] for y in best)
            continue
        else:
            deep = min(len(x), rerank)
            r = np.argpartition(-s, deep - 1, axis=0)[:deep].ravel()
            c = np.tile(np.arange(len(block)), deep)
        rows.append(r)
        cols.append(c + i)
    if least is not None:
        r, c = np.divmod(np.unique(np.concatenate([*rows, best[0]]) * len(q) + np.concatenate([*cols, best[1]])), len(q))
    else:
        r, c = np.concatenate(rows), np.concatenate(cols)
    cosine = _cosines(x8, q8, r, c)
    # vectors back to ids: of each group of copies the k + 1 smallest ids are enough, on either side
    gx, ix = _smallest(x_id, xg, k + 1)
    gq, iq = _smallest(q_id, qg, k + 1)
    xl, xh, ql, qh = (np.searchsorted(g, v, side) for g, v in ((gx, r), (gq, c)) for side in ("left", "right"))
    nx, nq = xh - xl, qh - ql
    n = nx * nq
    pair = np.repeat(np.arange(len(r)), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out = pd.DataFrame({"q": iq[ql[pair] + within // nx[pair]], "x": ix[xl[pair] + within % nx[pair]], "cosine": cosine[pair]})
    out = out[out["q"] != out["x"]].drop_duplicates(["q", "x"])
    out["o"] = -out["cosine"].round(9)
    by_q = out.sort_values(["q", "o", "x"]).groupby("q").cumcount()
    keep = by_q < k
    if least is not None:  # the pair may be wanted from the other end
        keep |= out.sort_values(["x", "o", "q"]).groupby("x").cumcount() < k
    return out[keep.reindex(out.index)][["q", "x", "cosine"]]


def build(vectors: DataFrame, dim: int = DIM, sample: int = SAMPLE) -> Index | None:
    """Fit an index on a bounded sample of (id, v): those with the smallest hashes, about ``sample`` of them at most."""
    rows = vectors.count()
    if not rows:
        return None
    wanted = min(max(sample, rows // ROWS_PER_CELL), max(FITTED, 24 * rows // ROWS_PER_CELL))
    share = min(1.0, wanted / rows)
    some = vectors.where((F.xxhash64("id", F.lit(1)) % 1_000_000 + 1_000_000) % 1_000_000 < int(share * 1_000_000) + 1).orderBy("id").select("v").toArrow()
    return Index(unit(matrix(some.column(0), dim)), rows) if some.num_rows else Index(unit(matrix(vectors.limit(1).select("v").toArrow().column(0), dim)), rows)


def similar(vectors: DataFrame, k: int, least: float | None = None, queries: DataFrame | None = None, z: float = Z, probe_cosine: float | None = None,
            rerank: int = 64, dim: int = DIM, scratch: Scratch | None = None) -> DataFrame:
    """(q, x, cosine): the k most similar rows x of ``vectors`` (id long, v array<float>, all usable) for each q of ``queries``,
    by default of all rows; only those with cosine of at least ``least``, if given."""
    spark = vectors.sparkSession
    index = build(vectors, dim)
    if index is None:
        return spark.createDataFrame([], "q long, x long, cosine double")
    sent = spark.sparkContext.broadcast(index)
    at = least if least is not None else probe_cosine or 0.8
    everyone = queries is None

    def spread(batches):
        idx = sent.value
        for b in batches:
            ids, raw, asks, kept = b.column(0).to_numpy(), matrix(b.column(1), dim), b.column(2).to_numpy(zero_copy_only=False).astype(bool), b.column(3).to_numpy(zero_copy_only=False).astype(bool)
            if not len(ids):
                continue
            _, group = _same(raw)
            order = np.lexsort((ids, group))
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.arange(len(ids)) - np.searchsorted(group[order], group[order])
            m = rank <= k if everyone else np.ones(len(ids), bool)  # further copies are told by overflow()
            ids, raw, asks, kept = ids[m], raw[m], asks[m], kept[m]
            x = unit(raw)
            home, rows, cells = idx.probes(x, at, z)
            mix = (raw.view(np.uint32).astype(np.uint64) * (np.arange(dim, dtype=np.uint64) * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15))).sum(1) >> np.uint64(7)
            block = (mix % idx.blocks[home].astype(np.uint64)).astype(np.int32)
            # a row is kept in its cell and block; a query visits all blocks of its cells
            q_rows = np.concatenate([np.nonzero(asks)[0], rows[asks[rows]]])
            q_cells = np.concatenate([home[asks], cells[asks[rows]]])
            n = idx.blocks[q_cells]
            q_rows, q_cells = np.repeat(q_rows, n), np.repeat(q_cells, n)
            q_block = np.arange(len(q_rows)) - np.repeat(np.cumsum(n) - n, n)
            own = kept[q_rows] & (q_cells == home[q_rows]) & (q_block == block[q_rows])  # one row for both
            stay = np.nonzero(kept)[0]
            both = np.zeros(len(ids), bool)
            both[q_rows[own]] = True
            r = np.concatenate([stay, q_rows[~own]])
            for i in range(0, len(r), 10_000):
                p = r[i:i + 10_000]
                first = np.arange(i, i + len(p)) < len(stay)
                other = np.maximum(0, np.arange(i, i + len(p)) - len(stay))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.where(first, home[p], q_cells[~own][other] if (~own).any() else 0).astype(np.int32)),
                    pa.array(np.where(first, block[p], q_block[~own][other] if (~own).any() else 0).astype(np.int32)),
                    pa.array(ids[p]), pa.array(np.where(first, np.where(both[p], 3, 1), 2).astype(np.int8)), lists(raw[p])], names=["cell", "block", "id", "role", "v"])

    def in_cell(t: pa.Table) -> pa.Table:
        ids, role, raw = t.column("id").to_numpy(), t.column("role").to_numpy(), matrix(t.column("v"), dim)
        x, q = role & 1 > 0, role & 2 > 0
        found = search_cell(sent.value, int(t.column("cell")[0].as_py()), ids[x], raw[x], ids[q], raw[q], k, least, rerank)
        return pa.Table.from_pandas(found, schema=pa.schema([("q", pa.int64()), ("x", pa.int64()), ("cosine", pa.float64())]), preserve_index=False)

    rows = vectors.select("id", "v", F.lit(everyone).alias("asks"), F.lit(True).alias("kept"))
    if not everyone:
        rows = rows.union(queries.select("id", "v", F.lit(True), F.lit(False)))
    found = rows.mapInArrow(spread, "cell int, block int, id long, role tinyint, v array<float>").groupBy("cell", "block").applyInArrow(in_cell, "q long, x long, cosine double")
    if everyone:
        if least is not None:
            found = (scratch or Scratch(spark, "similar")).save(found, "found")
            found = found.union(found.select("x", "q", "cosine"))
        found = found.union(overflow(vectors, k))
    found = found.groupBy("q", "x").agg(F.max("cosine").alias("cosine"))
    best = F.row_number().over(W.partitionBy("q").orderBy(F.round("cosine", 9).desc(), "x"))
    return found.withColumn("_rank", best).where(F.col("_rank") <= k).drop("_rank")


def best_of(q_id: np.ndarray, q: np.ndarray, batches, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, x, cosine) of the k best rows x of batches (ids, unit rows) for each query, by cosine to 9 digits, then id."""
    top, at = np.full((len(q_id), k), -np.inf), np.full((len(q_id), k), -1, np.int64)
    for ids, x in batches:
        for i in range(0, len(q_id), 512):
            s = (q[i:i + 512] @ x.T).round(9)
            s[q_id[i:i + 512, None] == ids[None, :]] = -np.inf
            bar = top[i:i + 512, -1].copy()
            if len(ids) > k and np.isinf(bar).any():
                bar = np.maximum(bar, np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k])
            r, c = np.nonzero((s >= bar[:, None]) & (s > -np.inf))
            some = np.unique(r)  # queries for which anything changes
            old = np.isfinite(top[i + some])
            o_r, o_c = np.nonzero(old)
            rows = np.concatenate([r, some[o_r]])
            score = np.concatenate([s[r, c], top[i + some[o_r], o_c]])
            which = np.concatenate([ids[c], at[i + some[o_r], o_c]])
            order = np.lexsort((which, -score, rows))
            rows, score, which = rows[order], score[order], which[order]
            rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
            m = rank < k
            top[i + rows[m], rank[m]], at[i + rows[m], rank[m]] = score[m], which[m]
    r, c = np.nonzero(np.isfinite(top))
    return q_id[r], at[r, c], top[r, c]


def most_similar(vectors: DataFrame, k: int, queries: DataFrame, dim: int = DIM, scratch: Scratch | None = None) -> DataFrame:
    """(q, x, cosine): exactly the k most similar rows x of ``vectors`` for each q of ``queries``, both (id, v) and usable.

    Every row is compared with every query, the queries broadcast in blocks; a task keeps k rows a query."""
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "most_similar")
    blocks = -(-queries.count() // QUERIES_PER_BROADCAST)
    found = spark.createDataFrame([], "q long, x long, cosine double")
    for block in range(blocks):
        some = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).select("id", "v").toArrow()
        sent = spark.sparkContext.broadcast((some.column(0).to_numpy(), unit(matrix(some.column(1), dim), np.float64)))

        def scan(batches, sent=sent):
            q_id, q = sent.value
            q, x, cosine = best_of(q_id, q, ((b.column(0).to_numpy(), unit(matrix(b.column(1), dim), np.float64)) for b in batches if b.num_rows), k)
            for i in range(0, len(q), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(y[i:i + 10_000]) for y in (q, x, cosine)], names=["q", "x", "cosine"])

        found = found.union(scratch.save(vectors.select("id", "v").mapInArrow(scan, "q long, x long, cosine double"), "found"))
        sent.destroy()
    best = F.row_number().over(W.partitionBy("q").orderBy(F.col("cosine").desc(), "x"))
    return found.withColumn("_rank", best).where(F.col("_rank") <= k).drop("_rank")


def overflow(vectors: DataFrame, k: int) -> DataFrame:
    """(q, x, cosine): for each copy beyond the k + 1 smallest ids of one vector, the group's k smallest ids.

    Every task keeps the k + 1 smallest ids of a group before they are shuffled (a rank with a bound is a group limit), so no
    group is gathered; the rows of a hot vector then stay on the side of the join that is split."""
    keyed = vectors.select("id", F.xxhash64("v").alias("a"), F.hash("v").alias("b"))
    least = keyed.withColumn("r", F.row_number().over(W.partitionBy("a", "b").orderBy("id"))).where(F.col("r") <= k + 1)
    heads = least.groupBy("a", "b").agg(F.array_sort(F.collect_list("id")).alias("ids")).where(F.size("ids") > k)
    heads = heads.select("a", "b", F.element_at("ids", k + 1).alias("last"), F.slice("ids", 1, k).alias("first"))
    return keyed.join(heads, ["a", "b"]).where(F.col("id") > F.col("last")).select(F.col("id").alias("q"), F.explode("first").alias("x"), F.lit(1.0).alias("cosine"))


def faces(spark, folder: str) -> DataFrame:
    """(id, v) of the usable embeddings of the whole table."""
    f = table(spark, folder, "face_embeddings").select("id", F.col("embedding").cast("array<float>").alias("v"))
    return f.where(F.col("id").isNotNull() & usable(F.col("v"), DIM))


def p3_found(spark, folder: str) -> DataFrame:
    """(face_a, face_b): pairs with cosine of at least 0.96, one among the other's five most similar."""
    s = similar(faces(spark, folder), k=5, least=0.96, scratch=Scratch(spark, "p3"))
    return s.select(F.least("q", "x").alias("face_a"), F.greatest("q", "x").alias("face_b")).distinct()


def p3_similar(spark, folder: str) -> DataFrame:
    """(face_id, similar_id, cosine): the ten most similar faces of every face whose id is divisible by 100, among all."""
    f = faces(spark, folder)
    s = most_similar(f, k=10, queries=f.where(F.col("id") % 100 == 0), scratch=Scratch(spark, "p3"))
    return s.select(F.col("q").alias("face_id"), F.col("x").alias("similar_id"), "cosine")
