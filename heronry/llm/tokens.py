"""Encoding of the whole corpus with a public byte-level BPE vocabulary (problem 8).

Two tiers. A minimal perfect hash over the vocabulary's byte strings (buckets with displacements, one slot per entry, no
gaps) resolves every pre-token that is an entry as a whole; a lookup is verified against the entry's own bytes. The misses
are merged from single bytes: neighbours form a linked list, a heap gives the pair of lowest rank next.

Defined cases: null and empty texts give an empty list; white space is encoded as it stands; strings that look like special
tokens are plain text; no text is cut, however long; no documents give no rows.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from heronry.sources.tables import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's publisher splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_U = np.uint64
_STEP, _MIX = _U(0x9E3779B97F4A7C15), _U(0xFF51AFD7ED558CCD)


class PerfectHash:
    """Minimal perfect hash of n different byte strings to 0..n-1."""

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        self.n = n = len(keys)
        self.nb = max(1, n // per_bucket)
        h = self.hashes(keys)
        bucket = (h % _U(self.nb)).astype(np.int64)
        self.shift = np.zeros(self.nb, np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.nb)
        ends = np.cumsum(sizes)
        free = np.ones(n, bool)
        slot_of = np.empty(n, np.int64)
        tries = np.arange(1, 65)
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] <= 1:
                break
            own = order[ends[b] - sizes[b]:ends[b]]
            start = 0
            while True:
                slots = self._slots(h[own][None, :], (tries + start)[:, None])
                good = free[slots].all(1)
                for i in np.nonzero(good)[0]:
                    if len(np.unique(slots[i])) == len(own):
                        break
                else:
                    start += len(tries)
                    continue
                self.shift[b], slot_of[own] = tries[i] + start, slots[i]
                free[slots[i]] = False
                break
        left = np.nonzero(free)[0]
        single = np.nonzero(sizes == 1)[0]
        self.shift[single] = -1 - left[:len(single)]  # a bucket of one names its slot
        slot_of[order[ends[single] - 1]] = left[:len(single)]
        self.at = np.empty(n, np.int64)
        self.at[slot_of] = np.arange(n)
        self.check = h[self.at]
        self.keys = keys

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), _U, len(keys))

    def _slots(self, h: np.ndarray, shift: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (h ^ (shift.astype(_U) * _STEP)) * _MIX
        return ((x >> _U(33)) % _U(self.n)).astype(np.int64)

    def index(self, keys: list[bytes]) -> np.ndarray:
        """Index of each string in the list the hash was made of, -1 for strings that are not in it."""
        if not keys or not self.n:
            return np.full(len(keys), -1, np.int64)
        h = self.hashes(keys)
        shift = self.shift[(h % _U(self.nb)).astype(np.int64)]
        slot = np.where(shift < 0, -1 - shift, self._slots(h, np.abs(shift)))
        found = np.where(self.check[slot] == h, self.at[slot], -1)
        return np.fromiter((i if i >= 0 and self.keys[i] == k else -1 for i, k in zip(found.tolist(), keys)), np.int64, len(keys))


class Encoder:
    def __init__(self, vocabulary: str):
        import regex

        with open(vocabulary, "rb") as f:
            entries = [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in f if line.strip())]
        self.rank = dict(entries)
        self.whole = PerfectHash([a for a, _ in entries])
        self.id = np.array([b for _, b in entries], np.int64)
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that is no entry: always the leftmost pair of lowest rank is merged next."""
        rank, n = self.rank, len(piece)
        start, after, before = list(range(n)), list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(piece[i:i + 2])) is not None]
        heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heappop(heap)
            if not alive[i]:
                continue
            j = after[i]
            if j >= n or end[j] != stop:  # one of the pair has grown since
                continue
            end[i], after[i], alive[j] = stop, after[j], False
            if after[i] < n:
                before[after[i]] = i
                if (r := rank.get(piece[i:end[after[i]]])) is not None:
                    heappush(heap, (r, i, end[after[i]]))
            if (k := before[i]) >= 0 and (r := rank.get(piece[start[k]:stop])) is not None:
                heappush(heap, (r, k, stop))
        return [rank[piece[i:end[i]]] for i in range(n) if alive[i]]

    def encode(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """Offsets and ids of a batch of texts. Each different pre-token of the batch is resolved once."""
        pieces = [self.split(t) if t else [] for t in texts]
        if len(self.known) > 300_000:  # what was resolved is kept between batches, within a bound
            self.known.clear()
        known = self.known
        new = list({p for ps in pieces for p in ps if p not in known})
        raw = [p.encode("utf-8", "surrogatepass") for p in new]
        for p, b, i in zip(new, raw, self.whole.index(raw).tolist()):
            known[p] = [int(self.id[i])] if i >= 0 else self.merge(b)
        offsets, ids = [0], []
        for ps in pieces:
            for p in ps:
                ids += known[p]
            offsets.append(len(ids))
        return offsets, ids


@lru_cache(2)
def encoder(vocabulary: str) -> Encoder:
    """One per Python worker."""
    return Encoder(vocabulary)


def encode_column(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): the token ids of every row, narrow: one pass, no shuffle. ``vocabulary`` is a .tiktoken file that every
    executor can read."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        e = encoder(vocabulary)
        for b in batches:
            offsets, ids = e.encode(b.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def p8_ids(spark, folder: str) -> DataFrame:
    """(doc_id, ids) of every document by byte_bpe_50k, without special tokens."""
    return encode_column(table(spark, folder, "documents"))
