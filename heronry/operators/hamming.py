"""Exact joins of 64-bit hashes within a Hamming distance.

Pigeonhole: split the 64 bits into t + m blocks; two hashes at distance t or less agree in at least m of them. Every
choice of m blocks is a mask; equal masked values are candidates, bit_count verifies them. With two of seven blocks
(t = 5) a hash has 21 keys of 18 bits, so buckets stay small until there are millions of distinct hashes.

Buckets over ``cap`` are not paired: their rows get further keys from another split of the bits (which the same argument
covers), level by level. No candidate is dropped.

How many blocks must agree follows the number of different hashes: one while buckets of one block are small (6 keys at
t = 5 up to 520,000 hashes), then two (21 keys), three (56), so that a bucket keeps about the same size at any scale.
"""

from __future__ import annotations

import random
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.functions.hashes import hamming
from heronry.session import Scratch

_LEVELS = 5
_IN_BUCKET = 512
_MOST_KEYS = 300


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def masks(threshold: int, agree: int = 2, level: int = 0) -> list[int]:
    """The masks of all choices of agreeing blocks; level > 0 deals the bits to the blocks in another order."""
    k = threshold + agree
    bits = list(range(64))
    if level:
        random.Random(level).shuffle(bits)
    blocks = [sum(1 << b for b in bits[i * 64 // k:(i + 1) * 64 // k]) for i in range(k)]
    return [_signed(sum(x)) for x in combinations(blocks, agree)]


def agreeing(threshold: int, n: int) -> int:
    """How many blocks must agree for about _IN_BUCKET of n hashes in a bucket, with at most _MOST_KEYS keys a hash."""
    m = 1
    while n > _IN_BUCKET << (64 * m // (threshold + m)) and comb(threshold + m + 1, m + 1) <= _MOST_KEYS:
        m += 1
    return m


def block_keys(h: Column, threshold: int, agree: int = 2, level: int = 0) -> Column:
    """Array of the keys of a hash: each tells the choice of blocks and the bits there."""
    choice = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("m")) for i, m in enumerate(masks(threshold, agree, level))])
    return F.transform(choice, lambda c: F.xxhash64(c["i"], h.bitwiseAND(c["m"])))


def _verified(keyed: DataFrame, threshold: int) -> DataFrame:
    # merged, never broadcast: Spark takes the exploded keys to be as small as the hashes, and the driver would gather all of them
    keyed = keyed.hint("merge")
    a, b = keyed.select("key", F.col("h").alias("a")), keyed.select("key", F.col("h").alias("b"))
    return a.join(b, "key").where((F.col("a") < F.col("b")) & (hamming(F.col("a"), F.col("b")) <= threshold)).select("a", "b")


def hamming_pairs(hashes: DataFrame, threshold: int, cap: int = 2000, scratch: Scratch | None = None) -> DataFrame:
    """(a, b), a < b: all pairs of different non-null values of ``hashes.h`` at distance ``threshold`` or less.

    Equal hashes are one value here: callers link their rows through it, so copies cost nothing. A negative threshold
    gives no rows. ``cap`` only decides where a bucket is split further, never what is found."""
    spark = hashes.sparkSession
    if threshold < 0:
        return spark.createDataFrame([], "a long, b long")
    scratch = scratch or Scratch(spark, "hamming")
    values = scratch.save(hashes.select("h").where("h IS NOT NULL").distinct(), "hashes")
    if threshold > 10:  # blocks too narrow to select anything: compare in blocks
        return blocked_pairs(values, threshold)
    agree = agreeing(threshold, values.count())
    keyed = values.select("h", F.explode(block_keys(F.col("h"), threshold, agree)).alias("key"))
    found = None
    for level in range(1, _LEVELS + 1):
        # sizes by partial counts; only the keys of full buckets are kept, at most rows / cap of them
        hot = scratch.save(keyed.groupBy("key").count().where(F.col("count") > cap).select("key"), f"hot{level}") if level < _LEVELS else None
        last = hot is None or hot.isEmpty()
        pairs = _verified(keyed if last else keyed.join(hot, "key", "left_anti"), threshold)
        found = pairs if found is None else found.union(pairs)
        if last:
            break
        deeper = F.explode(F.transform(block_keys(F.col("h"), threshold, agree, level), lambda k: F.xxhash64("key", k))).alias("key")
        keyed = scratch.save(keyed.join(hot, "key", "left_semi").select("h", deeper), f"keys{level}")
    return found.distinct()


def blocked_pairs(values: DataFrame, threshold: int, rows_per_block: int = 20_000) -> DataFrame:
    """All pairs by comparison in a triangle of blocks, for thresholds too wide for any key. Each value goes to as many
    block pairs as there are blocks: for thousands of distinct values, not for millions."""
    n = values.count()
    blocks = max(1, -(-n // rows_per_block))
    of = F.pmod(F.xxhash64("h"), F.lit(blocks)).cast("int")
    v = values.select("h", of.alias("x"))
    pair = F.when(F.col("x") <= F.col("y"), F.col("x") * blocks + F.col("y")).otherwise(F.col("y") * blocks + F.col("x"))
    spread = v.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("cell", pair)
    left, right = spread.where("x <= y").select("cell", F.col("h").alias("l")), spread.where("y <= x").select("cell", F.col("h").alias("r"))
    near = left.join(right, "cell").where((F.col("l") != F.col("r")) & (hamming(F.col("l"), F.col("r")) <= threshold))
    return near.select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b")).distinct()
