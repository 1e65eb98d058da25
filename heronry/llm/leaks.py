"""Evaluation texts leaking into training text (problem 9): suffix arrays over shards of the corpus.

Texts become words: runs of letters and digits, without case, accents and invisible characters. Each task turns its documents
into shards of bounded size, sorts the shard's word suffixes by prefix doubling and looks every suffix of the evaluation
texts up by binary search. What is found is extended to the longest verbatim match and reported with its places; documents
with a match can then be removed.

Before a shard is sorted, stretches that cannot take part are cut out: a match of twelve words lies within a run of at least
twelve words that all occur in the evaluation texts. This loses nothing, and leaves little to sort.

The evaluation texts are sent to the tasks in blocks of bounded size (``block_chars``). Beyond one block each is a pass of its
own over the corpus, whose matches are written before the next block is sent, so driver and tasks hold one block at a time.
Equal evaluation texts are searched once. Documents are never gathered or shuffled.

Defined cases: null, blank and short texts have no match; an evaluation text of fewer than ``least`` words has none either;
repeated documents and repeated evaluation texts are all reported; no rows on either side give none.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.session import Scratch
from heronry.sources.tables import table

LEAST = 12
_ASCII, _WORD = re.compile(r"[a-z0-9]+"), re.compile(r"[^\W_]+")
_APOSTROPHE_LETTERS = {0x2B9: "'", 0x2BB: "'", 0x2BC: "'", 0x2BD: "'", 0x2C8: "'", 0xA78C: "'"}
_KEPT_CONTROLS = set("\t\n\v\f\r\x1c\x1d\x1e\x1f\x85")
_DROPPED: dict[int, str | None] = dict(_APOSTROPHE_LETTERS)


def _dropped(text: str) -> str:
    """Without marks and invisible characters."""
    for ch in set(text):
        o = ord(ch)
        if o > 126 or o < 32:
            if o not in _DROPPED:
                kind = unicodedata.category(ch)
                gone = kind in ("Mn", "Me", "Cf") or kind == "Cc" and ch not in _KEPT_CONTROLS or o in (0x115F, 0x1160, 0x3164, 0xFFA0)
                _DROPPED[o] = None if gone else ch
    return text.translate(_DROPPED)


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if text.isascii() and text.isprintable():
        return _ASCII.findall(text.lower())
    return _WORD.findall(_dropped(unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", _dropped(text)).casefold())))


class Items:
    """The evaluation texts as one array of word numbers; 0 stands between texts."""

    def __init__(self, ids: list[int], texts: list[str], least: int):
        self.least = least
        self.number: dict[str, int] = {}
        self.ids = np.array(ids, np.int64)
        seq, item, place = [], [], []
        for k, t in enumerate(texts):
            ws = words(t)
            if len(ws) < least:
                continue
            seq += [self.number.setdefault(w, len(self.number) + 1) for w in ws] + [0] * least
            item += [k] * (len(ws) + least)
            place += range(len(ws) + least)
        self.seq, self.item, self.place = np.array(seq, np.int32), np.array(item, np.int64), np.array(place, np.int64)
        full = len(self.seq) - least + 1
        ends = np.cumsum(self.seq == 0)
        self.starts = np.nonzero(ends[least - 1:least - 1 + full] == ends[:full] - (self.seq[:full] == 0))[0] if full > 0 else np.empty(0, np.int64)
        self.starts = self.starts[self.seq[self.starts] != 0]


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the ``depth`` numbers from each on, by prefix doubling."""
    n, rank, done = len(seq), np.unique(seq, return_inverse=True)[1].astype(np.int64), 1
    while done < depth:
        step = min(done, depth - done)  # ranks of done words, and those step words on, order done + step words
        on = np.full(n, -1, np.int64)
        on[:max(0, n - step)] = rank[step:]
        rank = np.unique(rank * (n + 2) + on + 1, return_inverse=True)[1].astype(np.int64)
        done += step
    return np.argsort(rank, kind="stable")


def _bound(seq: np.ndarray, sa: np.ndarray, wanted: np.ndarray, upper: bool) -> np.ndarray:
    """For each row of wanted the first place in the suffix array whose words are not less (upper: greater)."""
    depth = wanted.shape[1]
    padded = np.concatenate([seq, np.full(depth, -1, seq.dtype)])
    lo, hi = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(sa), np.int64)
    at = np.arange(depth)
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        here = padded[sa[np.minimum(mid, len(sa) - 1)][:, None] + at]
        differs = here != wanted
        first = differs.argmax(1)
        row = np.arange(len(wanted))
        any_ = differs[row, first]
        less = any_ & (here[row, first] < wanted[row, first])
        right = open_ & (less | (upper & ~any_))
        lo = np.where(right, mid + 1, lo)
        hi = np.where(open_ & ~right, mid, hi)
    return lo


class Shard:
    def __init__(self, items: Items):
        self.items = items
        self.seq: list[int] = []
        self.doc: list[int] = []
        self.place: list[int] = []

    def add(self, doc: int, text: str | None) -> None:
        least, number = self.items.least, self.items.number.get
        ws = words(text)
        if len(ws) < least:
            return
        start, n = None, len(ws)
        nums = [number(w, 0) for w in ws]
        nums.append(0)
        for i, x in enumerate(nums):
            if x:
                if start is None:
                    start = i
            elif start is not None:
                if i - start >= least:
                    self.seq += nums[start:i + 1]
                    self.doc += [doc] * (i + 1 - start)
                    self.place += range(start, i + 1)
                start = None

    def matches(self) -> pd.DataFrame:
        """doc_id, item_id, words, doc_word, item_word: the longest match of each document and item."""
        it, least = self.items, self.items.least
        cols = ["doc_id", "item_id", "words", "doc_word", "item_word"]
        if not self.seq or not len(it.starts):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in cols})
        seq = np.array(self.seq, np.int32)
        sa = suffix_array(seq, least)
        wanted = it.seq[it.starts[:, None] + np.arange(least)]
        lo, hi = _bound(seq, sa, wanted, False), _bound(seq, sa, wanted, True)
        n = hi - lo
        q = np.repeat(it.starts, n)
        p = sa[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        hits = pd.DataFrame({"doc_id": np.array(self.doc, np.int64)[p], "item_id": it.ids[it.item[q]], "p": p, "q": q})
        # matches that follow each other on one diagonal are one longer match
        hits["d"] = hits["p"] - hits["q"]
        hits = hits.sort_values(["item_id", "d", "p"], kind="stable")
        new = (hits["item_id"].diff() != 0) | (hits["d"].diff() != 0) | (hits["p"].diff() != 1)
        runs = hits.groupby(new.cumsum().to_numpy(), sort=False).agg(doc_id=("doc_id", "first"), item_id=("item_id", "first"), n=("p", "size"), p=("p", "first"), q=("q", "first"))
        runs["words"] = runs["n"] + least - 1
        runs["doc_word"], runs["item_word"] = np.array(self.place, np.int64)[runs["p"]], it.place[runs["q"]]
        best = runs.sort_values(["words", "doc_word", "item_word"], ascending=[False, True, True], kind="stable").drop_duplicates(["doc_id", "item_id"])
        return best[cols]


def leaks(documents: DataFrame, eval_items: DataFrame, least: int = LEAST, shard_words: int = 2_000_000, block_chars: int = 32_000_000, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, item_id, words, doc_word, item_word): each document and evaluation text that share at least ``least``
    consecutive words, with the length and the places of their longest match."""
    spark = documents.sparkSession
    scratch = scratch or Scratch(spark, "leaks")
    given = eval_items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text", F.sha2("text", 256).alias("same"))
    items = scratch.save(given.groupBy("same").agg(F.min(F.struct("item_id", "text")).alias("i"), F.count("*").alias("n")).select("same", "i.item_id", "i.text", "n"), "items")
    chars, most = items.agg(F.sum(F.length("text")), F.max("n")).first()
    blocks = max(1, -(-(chars or 0) // block_chars))
    docs = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, words long, doc_word long, item_word long"
    found = None
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toPandas()  # at most about block_chars
        sent = spark.sparkContext.broadcast(Items(own["item_id"].tolist(), own["text"].tolist(), least))

        def run(batches, sent=sent):
            shard = Shard(sent.value)
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    shard.add(doc, text)
                    if len(shard.seq) >= shard_words:  # between documents: no match is cut
                        yield pa.RecordBatch.from_pandas(shard.matches().astype("int64"), preserve_index=False)
                        shard = Shard(sent.value)
            yield pa.RecordBatch.from_pandas(shard.matches().astype("int64"), preserve_index=False)

        part = docs.mapInArrow(run, schema)
        if blocks > 1:
            part = scratch.save(part, "leaks")
            sent.destroy()
        found = part if found is None else found.unionByName(part)
    if (most or 1) == 1:
        return found
    copies = given.join(items.select("same", F.col("item_id").alias("searched")), "same").select("searched", F.col("item_id").alias("copy"))
    return found.join(copies, found["item_id"] == copies["searched"]).select("doc_id", F.col("copy").alias("item_id"), "words", "doc_word", "item_word")


def without_leaks(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents that no evaluation text leaks into."""
    return documents.join(found.select("doc_id").distinct(), "doc_id", "left_anti")


def p9_found(spark, folder: str) -> DataFrame:
    """(doc_id, item_id): documents in which at least twelve consecutive words of the item stand."""
    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id").distinct()
