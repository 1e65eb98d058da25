"""Per-document text quality statistics (problem 10): quantile sketches per language, distribution tails.

The words common in a language's sentences are learned from the corpus. Each document gets the statistics of ``STATS`` from its
whole text, in one narrow pass. Per language (and for all together)
mergeable quantile sketches of every statistic are built by one aggregation. A document's values become robust z-scores and
places among the quantiles; the outer places are tail flags. How much each flag tells is fitted by a ridge logistic regression
on labelled documents (``MOST_LABELLED`` at most, those of smallest hashed id), so a document is flagged if the sum of its
flags' weights is positive. Corpus quantiles are taken over all documents, the labelled ones only weigh them.

Defined cases: null, empty and blank texts have null statistics, are in no sketch and are never flagged; a language that is
null or in another notation is normalised to its two letters or goes by the words and the sketch of all; null statistics are unflagged;
null and unreadable labels are left out; without labels of both kinds a document is flagged if less than half of its visible
characters lie in natural lines; repeated documents count each time; no documents give no rows.
"""

from __future__ import annotations

import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from heronry.session import Scratch
from heronry.sources.tables import table

STATS = ["words", "word_length", "token_length", "symbols", "digits", "letters", "line_ends", "bullets", "common", "natural", "short_lines",
         "sentences", "line_length", "line_tokens", "distinct", "capitals", "vowels", "packed", "technical", "separators", "hashtags", "single_letters", "lines"]
PLACES = [0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995]
MOST_LABELLED = 20_000
WORDS_OF_LANGUAGE, WORDS_OF_ALL, FEWEST_WORDS = 60, 150, 6
PRIOR = 200  # documents that the quantiles of all count for beside those of a language

_LINES = re.compile("[\n\r\x0b\x0c\x85\u2028\u2029]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_ENDED = re.compile(r"[.!?…。！？؟][\"'”’»)\]]*\s*$")
_SENTENCE = re.compile(r"[.!?…。！？؟][\"'”’»)\]]*(?=\s|$)")
_ITEM = re.compile(r"\s*(?:[-*•·–+]\s|\[[ x]\]|\d+[.)]\s|#\w|/\w|\{)")
_TECHNICAL = re.compile(r"[,;|=<>{}\[\]\\/#~^$%&*_+@]")
_VOWEL = re.compile(r"[aeiouyàâäáéèêëíîïóôöúùûüœæаеиоуыэюя]")
_HIDDEN = re.compile("[\u00ad\u200b\u200c\u200d\u2060\ufeff\u202a-\u202e\ufe0f]+")


def _most_common(found: list[int]) -> int:
    """Occurrences of common words of the language or of all languages, whichever are more."""
    return max(sum(b & 1 for b in found), sum(b >> 1 for b in found)) if found else 0


@cache
def _kinds() -> np.ndarray:
    """1 for letters, 2 for decimal digits, 3 for other characters of words, by code point."""
    every = [chr(i) for i in range(0x110000)]
    return np.fromiter((1 if c.isalpha() else 2 if c.isdigit() else 3 if c.isalnum() else 0 for c in every), np.uint8, len(every))


def measure(text: str | None, common: dict[str, int]) -> list[float] | None:
    """The values of STATS, or None if no character is visible. ``common``: words, with bit 1 for common ones of the text's
    language and bit 2 for common ones of all languages."""
    t = text or ""
    if not t.isascii():
        t = _HIDDEN.sub("", t)
    lines = [x for x in _LINES.split(t) if x.strip()]
    if not lines:
        return None
    words, n_tokens, visible, natural, short, ended, items, capitals, hashtags, separators = [], 0, 0, 0, 0, 0, 0, 0, 0, 0
    found: list[int] = []
    for x in lines:
        tokens = x.split()
        own = _WORD.findall(x.lower())
        bits = [common[w] for w in own if w in common]
        size, n = sum(map(len, tokens)), len(tokens)
        item, end = bool(_ITEM.match(x)), bool(_ENDED.search(x))
        apart = x.count(";") + x.count("|") + x.count("\t") + x.count('":')
        letters = sum(map(len, own))
        fluent = not item and letters >= 0.6 * size and size >= 2.6 * n and apart < 0.2 * n and len(set(own)) >= 0.3 * min(len(own), 40)
        # a line of a text, or a short sentence
        if fluent and (n >= 4 and _most_common(bits) >= 0.18 * n or end and n <= 6 and x.lstrip()[:1].isupper()):
            natural += size
        short += size if n <= 4 else 0
        ended += end
        items += item
        firsts = [k[0] for k in tokens]
        capitals += sum(map(str.isupper, firsts))
        hashtags += firsts.count("#")
        separators += apart
        words += own
        found += bits
        n_tokens += n
        visible += size
    packed = t.encode("utf-8", "replace")
    _, letters, digits, rest = np.bincount(_kinds()[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=4).tolist()
    n, lengths = len(words), list(map(len, words))
    return [n, sum(lengths) / n if n else 0.0, visible / n_tokens, 1 - (letters + digits + rest) / visible, digits / visible, letters / visible,
            ended / len(lines), items / len(lines), _most_common(found) / n_tokens, natural / visible, short / visible,
            len(_SENTENCE.findall(t)) / n_tokens, visible / len(lines), n_tokens / len(lines), len(set(words)) / n if n else 0.0, capitals / n_tokens,
            sum(map(bool, map(_VOWEL.search, words))) / n if n else 0.0, len(zlib.compress(packed, 1)) / len(packed), len(_TECHNICAL.findall(t)) / visible,
            separators / n_tokens, hashtags / n_tokens, lengths.count(1) / n if n else 0.0, len(lines)]


def language(lang: Column) -> Column:
    """Two lower-case letters of a language in any notation, '' if there are none."""
    return F.coalesce(F.regexp_extract(F.lower(F.trim(lang)), r"^([a-z]{2})(?:[-_].*)?$", 1), F.lit(""))


def common_words(documents: DataFrame, scratch: Scratch) -> dict[str, dict[str, int]]:
    """Learned from the corpus: for each language, and '' for all together, the words that stand in most sentences. Sentences
    are lines of six words or more that end as sentences do, so tags, tables and names do not count. Words are counted once
    a sentence, with partial sums over all documents; at most 60 words a language come back, and 150 of all."""
    line = F.explode(F.split(F.lower("text"), "[\n\r\u000b\u000c\u0085\u2028\u2029]+"))
    lines = documents.where("text IS NOT NULL").select(language(F.col("lang")).alias("language"), line.alias("line")).where(F.col("line").rlike("[.!?…][\"'”’»)\\]]*\\s*$"))
    words = lines.select("language", F.regexp_extract_all("line", F.lit("\\p{L}+(?:['’]\\p{L}+)*"), F.lit(0)).alias("ws")).where(F.size("ws") >= FEWEST_WORDS)
    counts = scratch.save(words.select("language", F.explode(F.array_distinct("ws")).alias("word")).groupBy("language", "word").count(), "words")
    both = counts.where("language <> ''").union(counts.groupBy(F.lit("").alias("language"), "word").agg(F.sum("count").alias("count")))
    at = F.row_number().over(W.partitionBy("language").orderBy(F.col("count").desc(), "word"))
    top = both.withColumn("at", at).where(F.col("at") <= WORDS_OF_ALL).where((F.col("at") <= WORDS_OF_LANGUAGE) | (F.col("language") == "")).select("language", "word").collect()
    shared = {w: 2 for g, w in top if g == ""}
    out: dict[str, dict[str, int]] = {"": shared}
    for g, w in top:
        if g:
            own = out.setdefault(g, dict(shared))
            own[w] = own.get(w, 0) | 1
    return out


def statistics(documents: DataFrame, common: dict[str, dict[str, int]]) -> DataFrame:
    """doc_id, language and the statistics of every document, with common_words()."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    sent = documents.sparkSession.sparkContext.broadcast(common)  # 60 words a language

    def run(batches):
        known = sent.value
        for b in batches:
            rows = [measure(t, known.get(g, known[""])) for g, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            cols = [pa.array([None if r is None else float(r[i]) for r in rows], pa.float64()) for i in range(len(STATS))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["doc_id", "language", *STATS])

    given = documents.select("doc_id", language(F.col("lang")).alias("language"), "text")
    return given.mapInArrow(run, f"doc_id {kind}, language string, " + ", ".join(f"{s} double" for s in STATS))


def sketches(stats: DataFrame, accuracy: int = 2000) -> dict[str, np.ndarray]:
    """Quantiles at PLACES of every statistic, (statistics, places), for each language and '' for all documents.

    percentile_approx keeps mergeable sketches: partial ones in every task, merged after; a row per language comes back. A
    language's quantiles are the mean of its own, weighted by its documents, and of those of all, weighted by PRIOR."""
    at = F.array(*[F.lit(p) for p in PLACES])
    known = stats.where(F.col("words").isNotNull()).select("language", *STATS)
    both = known.withColumn("language", F.explode(F.when(F.col("language") == "", F.array(F.lit("*"))).otherwise(F.array(F.col("language"), F.lit("*")))))
    rows = both.groupBy("language").agg(F.count("*").alias("n"), *[F.percentile_approx(s, at, F.lit(accuracy)).alias(s) for s in STATS]).collect()  # at most 26 * 26 languages
    own = {r["language"]: (r["n"], np.array([r[s] for s in STATS], np.float64)) for r in rows}
    if not own:
        return {}
    whole = own.pop("*")[1]
    return {"": whole} | {g: (n * x + PRIOR * whole) / (n + PRIOR) for g, (n, x) in own.items()}


def places(x: np.ndarray, quantiles: np.ndarray) -> np.ndarray:
    """(rows, statistics): how many of the statistic's quantiles lie below the value, counting half those equal to it."""
    return ((x[:, :, None] > quantiles[None]).sum(2) + (x[:, :, None] >= quantiles[None]).sum(2)).astype(np.int64)


def robust_z(x: np.ndarray, quantiles: np.ndarray) -> np.ndarray:
    """(value - median) / spread, the spread being that of a normal distribution with the same 20 % and 80 % quantiles."""
    low, mid, high = (quantiles[:, PLACES.index(p)] for p in (0.2, 0.5, 0.8))
    return (x - mid) / np.maximum((high - low) / 1.683, 1e-9 + 0.01 * np.abs(mid))


class Scorecard:
    """Weights of the tail flags, one per statistic and place, by ridge logistic regression (Newton's method)."""

    def __init__(self, place: np.ndarray, bad: np.ndarray, ridge: float = 1.0, rounds: int = 25):
        self.width = 2 * len(PLACES) + 1
        a = self._flags(place)
        w = np.zeros(a.shape[1])
        penalty = np.full(a.shape[1], ridge)
        penalty[-1] = 1e-6
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
            step = np.linalg.solve(h, a.T @ (bad - p) - penalty * w)
            w += step
            if np.abs(step).max() < 1e-5:
                break
        self.weights = w

    def _flags(self, place: np.ndarray) -> np.ndarray:
        n, k = place.shape
        a = np.zeros((n, k * self.width + 1))
        a[np.arange(n)[:, None], place + np.arange(k) * self.width] = 1
        a[:, -1] = 1
        return a

    def score(self, place: np.ndarray) -> np.ndarray:
        return self.weights[place + np.arange(place.shape[1]) * self.width].sum(1) + self.weights[-1]


def _at(languages: list[str], x: np.ndarray, found: dict[str, np.ndarray], of) -> np.ndarray:
    out, names = np.zeros(x.shape), np.array([g if g in found else "" for g in languages], dtype=object)
    for g in set(names):
        m = names == g
        out[m] = of(x[m], found[g])
    return out


def graded(documents: DataFrame, doc_labels: DataFrame, scratch: Scratch, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """doc_id, language, the statistics, score (positive: not natural prose) and odd, the number of statistics with a robust
    z-score beyond 3.5; score and odd are null where no character is visible."""
    stats = scratch.save(statistics(documents, common_words(documents, scratch)), "statistics")
    found = sketches(stats)
    label = F.lower(F.trim("label"))
    chosen = (doc_labels.where(F.col("doc_id").isNotNull() & label.isin("prose", "list", "table", "junk"))
              .groupBy("doc_id").agg(F.max((label != "prose").cast("int")).alias("bad")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled))
    some = stats.where(F.col("words").isNotNull()).join(chosen, "doc_id").toPandas()
    card = None
    if some["bad"].nunique() == 2:
        p = _at(some["language"].tolist(), some[STATS].to_numpy(np.float64), found, places).astype(np.int64)
        card = Scorecard(p, some["bad"].to_numpy(np.float64))
    sent = stats.sparkSession.sparkContext.broadcast((found, card))

    def run(batches):
        quantiles, weights = sent.value
        for b in batches:
            x = np.column_stack([b.column(2 + i).to_numpy(zero_copy_only=False) for i in range(len(STATS))]).astype(np.float64)
            known = ~np.isnan(x[:, 0])
            langs, v = np.array(b.column(1).to_pylist(), dtype=object)[known].tolist(), x[known]
            score, odd = np.zeros(len(x)), np.zeros(len(x), np.int32)
            if len(v):
                score[known] = 0.5 - v[:, STATS.index("natural")] if weights is None else weights.score(_at(langs, v, quantiles, places).astype(np.int64))
                odd[known] = (np.abs(_at(langs, v, quantiles, robust_z)) > 3.5).sum(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, mask=~known), pa.array(odd, mask=~known)], names=[*b.schema.names, "score", "odd"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    return stats.mapInArrow(run, f"doc_id {kind}, language string, " + ", ".join(f"{s} double" for s in STATS) + ", score double, odd int")


def _run(spark, folder: str) -> DataFrame:
    return graded(table(spark, folder, "documents"), table(spark, folder, "doc_labels"), Scratch(spark, "p10"))


def p10_found(spark, folder: str) -> DataFrame:
    """(doc_id): documents whose visible characters mostly do not belong to natural sentences."""
    return _run(spark, folder).where("score > 0").select("doc_id")


def p10_statistics(spark, folder: str) -> DataFrame:
    """The statistics, score and number of odd statistics of every document."""
    return _run(spark, folder)
