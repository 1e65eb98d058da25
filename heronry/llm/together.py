"""Items that appear together (problem 7): an incremental pair table.

A change to some baskets is turned into signed deltas: the pairs and items of the baskets' new contents minus those of their
old contents. The deltas are merged into persistent counts, hash-bucketed by pair, and association scores are computed from
them. Baskets and counts lie in bucket folders; a change reads and rewrites the buckets of its baskets and of its pairs only.

Baskets with the same old and new contents are counted together before any pair is made, so the pairs follow the number of
different baskets, not of baskets. Rows of a basket are made distinct with partial aggregates; a basket with a third of all
rows becomes at most one row per item.

Defined cases: a null basket is ignored; a null item adds its basket, but no item, and counts in n; repeated rows count once;
an item does not pair with itself; no rows give no pairs and n = 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.functions.times import micros
from heronry.session import BucketTable, Scratch
from heronry.sources.tables import table

WIDE = 2000


def _pairs(changes: DataFrame, items: str, sign: int) -> DataFrame:
    """(a, b, n) of each pair of the array ``items``, a < b, with sign times the row's count."""
    left = changes.where(F.size(items) > 1).select(F.posexplode(items).alias("at", "a"), F.col(items).alias("all"), "n")
    return left.select("a", F.explode(F.expr("slice(all, at + 2, size(all))")).alias("b"), (F.col("n") * sign).alias("n"))


def _wide_pairs(changes: DataFrame, items: str, sign: int) -> DataFrame:
    """_pairs of baskets wider than WIDE: the items are cut in pieces, and each two pieces are one row of their own, which
    carries those pieces only and goes to a task of its own."""
    wide = changes.where(F.size(items) > WIDE)
    cut = wide.select(F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / WIDE).cast("int")), lambda i: F.slice(items, i * WIDE + 1, WIDE)).alias("pieces"), "n")
    left = cut.select(F.posexplode("pieces").alias("i", "left"), "pieces", "n")
    parts = max(1, int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a given number is not merged for being small
    both = left.select("i", "left", "n", F.posexplode("pieces").alias("j", "right")).where("j >= i").repartition(parts, "i", "j", F.xxhash64("left"))
    pair = both.select("i", "j", F.explode("left").alias("a"), "right", "n").select("a", F.explode("right").alias("b"), "n")
    return pair.where("a < b").select("a", "b", (F.col("n") * sign).alias("n"))


def _singles(changes: DataFrame, items: str, sign: int) -> DataFrame:
    return changes.select(F.explode(items).alias("a"), F.lit(None).cast("int").alias("b"), (F.col("n") * sign).alias("n"))


class PairCounts:
    """Baskets (basket, items) and counts (a, b, n), where b is null in the count of a single item, in bucket folders by key,
    and the number of baskets. A change reads and rewrites the buckets of its baskets and of its pairs."""

    def __init__(self, scratch: Scratch, buckets: int | None = None):
        self.scratch = scratch
        self.baskets = BucketTable(scratch, "baskets", ["basket"], "basket long, items array<int>", buckets)
        self.counts = BucketTable(scratch, "pair_counts", ["a", "b"], "a int, b int, n long", buckets)
        self.n = 0

    def apply(self, added: DataFrame, removed: DataFrame | None = None) -> list[int]:
        """Merge rows (basket, item) that were added, and rows that were removed, into the counts. Returns the buckets of
        pairs that were rewritten."""
        gather = lambda df, c: df.where("basket IS NOT NULL").select(F.col("basket").cast("long").alias("basket"), F.col("item").cast("int").alias("item")).distinct().groupBy("basket").agg(F.array_sort(F.collect_set("item")).alias(c))
        none = F.array().cast("array<int>")
        changed = gather(added, "plus")
        if removed is not None:
            changed = changed.join(gather(removed, "minus"), "basket", "full")
        else:
            changed = changed.withColumn("minus", none)
        changed = self.scratch.save(changed, "change")
        buckets = self.baskets.touched(changed)
        held = self.baskets.read(buckets)
        both = held.join(changed.withColumn("changed", F.lit(True)), "basket", "full")
        old, plus, minus = (F.coalesce(c, none) for c in ("items", "plus", "minus"))
        # a basket of nulls alone exists without items; one that loses its last item still exists
        now = self.scratch.save(both.select("basket", F.col("items").alias("old"), "changed", F.array_sort(F.array_except(F.array_union(old, plus), minus)).alias("new")), "baskets")
        fresh = now.where("changed")
        self.n += fresh.where("old IS NULL").count()
        sets = fresh.groupBy(F.coalesce("old", none).alias("old"), "new").agg(F.count("*").alias("n")).where("old <> new")
        sets = self.scratch.save(sets, "sets")
        if (sets.agg(F.max(F.greatest(F.size("old"), F.size("new")))).first()[0] or 0) > WIDE:
            narrow = sets.where((F.size("old") <= WIDE) & (F.size("new") <= WIDE))
            rest = sets.where((F.size("old") > WIDE) | (F.size("new") > WIDE))
            short = lambda c: rest.where(F.size(c) <= WIDE)
            pairs = (_pairs(narrow, "new", 1).union(_pairs(narrow, "old", -1)).union(_wide_pairs(rest, "new", 1)).union(_wide_pairs(rest, "old", -1))
                     .union(_pairs(short("new"), "new", 1)).union(_pairs(short("old"), "old", -1)))
        else:
            pairs = _pairs(sets, "new", 1).union(_pairs(sets, "old", -1))
        total = lambda df: df.groupBy("a", "b").agg(F.sum("n").alias("n")).where("n <> 0")
        deltas = self.scratch.save(total(pairs.union(_singles(sets, "new", 1)).union(_singles(sets, "old", -1))), "deltas")
        touched = self.counts.touched(deltas)
        self.counts.replace(total(self.counts.read(touched).union(deltas)), touched)
        self.baskets.replace(now.select("basket", F.col("new").alias("items")), buckets)
        self.scratch.drop(changed, now, sets, deltas)
        return touched

    def scores(self, buckets: list[int] | None = None) -> DataFrame:
        """(a, b, n_ab, n_a, n_b, n, lift, pmi, npmi) of every pair that occurs; of the pairs in some buckets, if they are named:
        those that apply() told are the pairs whose own count changed."""
        single = self.counts.read().where("b IS NULL")
        one = lambda c: single.select(F.col("a").alias(c), F.col("n").alias(f"n_{c}"))
        pairs = self.counts.read(buckets).where("b IS NOT NULL").withColumnRenamed("n", "n_ab").join(one("a"), "a").join(one("b"), "b").withColumn("n", F.lit(self.n).cast("long"))
        lift = F.col("n_ab") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))
        return pairs.withColumn("lift", lift).withColumn("pmi", F.log("lift")).withColumn(
            "npmi", F.when(F.col("n_ab") < F.col("n"), F.col("pmi") / -F.log(F.col("n_ab") / F.col("n"))).otherwise(1.0)).select(
            "a", "b", "n_ab", "n_a", "n_b", "n", "lift", "pmi", "npmi")


def tag_pairs(spark, folder: str) -> PairCounts:
    """Counts of the categories of media_tags: the older half of the time span first, then the rest as changes to it."""
    tags = table(spark, folder, "media_tags").select(F.col("file_id").alias("basket"), F.col("category_id").alias("item"), "created_at")
    us = micros(F.col("created_at"))
    half = tags.agg(((F.min(us) + F.max(us)) / 2).cast("long")).first()[0]
    counts = PairCounts(Scratch(spark, "p7"))
    if half is None:
        counts.apply(tags)
    else:
        early = F.coalesce(us < half, F.lit(False))
        counts.apply(tags.where(early))
        counts.apply(tags.where(~early))
    return counts


def p7_found(spark, folder: str) -> DataFrame:
    """(category_a, category_b): pairs on at least five files and at least twice as often as by chance."""
    s = tag_pairs(spark, folder).scores()
    often = (F.col("n_ab") >= 5) & (F.col("n_ab") * F.col("n") >= 2 * F.col("n_a") * F.col("n_b"))
    return s.where(often).select(F.col("a").alias("category_a"), F.col("b").alias("category_b"))


def p7_scores(spark, folder: str) -> DataFrame:
    """Counts and lift of every pair of categories that occurs."""
    return tag_pairs(spark, folder).scores().select(F.col("a").alias("category_a"), F.col("b").alias("category_b"), "n_ab", "n_a", "n_b", "n", F.round("lift", 6).alias("lift"))
