"""Vector columns as Arrow batches and numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(v: Column, dim: int) -> Column:
    """Not null, ``dim`` numbers, none null, NaN or infinite, not all zero."""
    top, low = F.array_max(v), F.array_min(v)
    return (F.size(v) == dim) & (F.size(F.array_compact(v)) == dim) & (top < float("inf")) & (low > float("-inf")) & ((top != 0) | (low != 0))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """float32 rows of a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.list_(pa.float32()))
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, dim)


def lists(rows: np.ndarray) -> pa.ListArray:
    n, dim = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(np.ascontiguousarray(rows, np.float32).ravel()))


def lists_where(rows: np.ndarray, keep: np.ndarray) -> pa.ListArray:
    """Lists of the kept rows, null for the others."""
    full = lists(rows[keep])
    at = np.full(len(keep), -1, np.int64)
    at[keep] = np.arange(keep.sum())
    return full.take(pa.array(at, mask=~keep))


def unit(rows: np.ndarray, kind=np.float32) -> np.ndarray:
    x = rows.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(kind)


def nearest(x: np.ndarray, c: np.ndarray, step: int = 4096) -> np.ndarray:
    return np.concatenate([np.argmax(x[i:i + step] @ c.T, axis=1) for i in range(0, len(x), step)] or [np.empty(0, np.int64)])


def hook(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union-find over arrays: join the sets of a[i] and b[i] in ``parent``, whose roots are the smallest of their sets and
    which points straight at the roots before and after."""
    while True:
        p, q = parent[a], parent[b]
        apart = p != q
        if not apart.any():
            return
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        np.minimum.at(parent, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


class Cells:
    """Unit centres that part unit rows into cells. Beyond ``flat`` centres they are found by a second level: a row looks at
    the centres of its ``heads`` nearest head centres only, so its cost follows the square root of their number."""

    def __init__(self, centres: np.ndarray, flat: int = 1024, heads: int = 6):
        self.centres, self.heads, self.groups = centres, None, [np.arange(len(centres))]
        if len(centres) > flat:
            g = int(np.ceil(np.sqrt(len(centres))))
            self.heads = centres[np.random.default_rng(len(centres)).choice(len(centres), g, replace=False)]
            own = nearest(centres, self.heads)
            self.groups = [np.nonzero(own == j)[0] for j in range(g)]
            self.wide = min(heads, g)

    def near(self, x: np.ndarray, spread: float | None = None, step: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home cell of each row, rows, cells): the home, and the other cells whose centre scores within ``spread`` times its
        distance from the home centre."""
        homes, rows, cells = [], [], []
        for i in range(0, len(x), step):
            home, r, c = self._near(x[i:i + step], spread)
            homes.append(home)
            rows.append(r + i)
            cells.append(c)
        return tuple(np.concatenate(y) if y else np.empty(0, np.int64) for y in (homes, rows, cells))

    def _near(self, x: np.ndarray, spread: float | None):
        n = len(x)
        if self.heads is None:
            looked = [(np.arange(n), self.groups[0])]
        else:
            top = np.argpartition(-(x @ self.heads.T), self.wide - 1, axis=1)[:, :self.wide]
            order = np.argsort(top.ravel(), kind="stable")
            at = np.searchsorted(top.ravel()[order], np.arange(len(self.groups) + 1))
            looked = [(order[at[j]:at[j + 1]] // self.wide, g) for j, g in enumerate(self.groups) if at[j + 1] > at[j] and len(g)]
        scores, most, home = [], np.full(n, -np.inf, np.float32), np.zeros(n, np.int64)
        for r, g in looked:
            s = x[r] @ self.centres[g].T
            best = s.argmax(1)
            top = s[np.arange(len(r)), best]
            up = top > most[r]
            most[r[up]], home[r[up]] = top[up], g[best[up]]
            scores.append(s)
        rows, cells = [], []
        if spread is not None and len(self.centres) > 1:
            for (r, g), s in zip(looked, scores):
                apart = np.sqrt(np.maximum(0, 2 - 2 * (self.centres[home[r]] @ self.centres[g].T)))
                a, b = np.nonzero(most[r][:, None] - s <= spread * apart)
                other = g[b] != home[r[a]]
                rows.append(r[a[other]])
                cells.append(g[b[other]])
        return home, np.concatenate(rows or [np.empty(0, np.int64)]), np.concatenate(cells or [np.empty(0, np.int64)])
