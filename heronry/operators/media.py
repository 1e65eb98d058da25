"""Compression figures, size texts and charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from heronry.functions.constants import COMPRESSION_LEVELS


def settings(level: Column) -> Column:
    """struct(quality, crf) of a level; unknown levels are level 2."""
    out = F.struct(*[F.lit(v).alias(k) for k, v in zip(("quality", "crf"), COMPRESSION_LEVELS[2])])
    for n in (1, 3):
        out = F.when(level == n, F.struct(*[F.lit(v).alias(k) for k, v in zip(("quality", "crf"), COMPRESSION_LEVELS[n])])).otherwise(out)
    return out


def compression_statistics(files: DataFrame, by: list[str]) -> DataFrame:
    """files (size_before, size_after; null after a failure, which counts as not smaller): totals, saved bytes, percent."""
    after = F.coalesce("size_after", "size_before")
    g = files.groupBy(*by).agg(F.count("*").alias("files"), F.count_if(F.col("size_after").isNull()).alias("failed"),
                               F.sum("size_before").alias("before"), F.sum(after).alias("after"))
    return g.withColumn("saved", F.col("before") - F.col("after")).withColumn(
        "percent", F.round(F.coalesce(F.try_divide(F.col("saved") * 100.0, F.col("before")), F.lit(0.0)), 2))


def chart(counts: DataFrame, value: str = "n") -> DataFrame:
    """counts with ``height``, percent of the largest."""
    return counts.withColumn("height", F.round(F.col(value) * 100.0 / F.max(value).over(W.partitionBy()), 4))
