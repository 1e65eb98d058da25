"""Tag candidates of several stages to final tags, review items and fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from heronry.functions.rules import review_type


def merged(candidates: DataFrame) -> DataFrame:
    """Of candidates (file_id, key, confidence, source, stage) the one of highest confidence per file and key; of equal
    ones that of the earliest stage, then source."""
    best = F.max(F.struct("confidence", (-F.col("stage")).alias("stage")))
    top = candidates.groupBy("file_id", "key").agg(best.alias("b"))
    return (candidates.withColumn("b", F.struct("confidence", (-F.col("stage")).alias("stage"))).join(top, ["file_id", "key", "b"])
            .groupBy("file_id", "key", F.col("b.confidence").alias("confidence")).agg(F.min("source").alias("source")))


def resolved(files: DataFrame, candidates: DataFrame, enabled: DataFrame, auto_threshold: float) -> DataFrame:
    """(file_id, key, confidence, source, verdict): verdict is auto at the threshold or above, review below. Keys that are
    not enabled (key) are dropped. A file without an auto tag also gets 'other' with confidence 1, even if it has reviews."""
    m = merged(candidates).join(enabled.select("key"), "key", "left_semi")
    split = m.select("file_id", "key", "confidence", "source", F.when(F.col("confidence") >= auto_threshold, "auto").otherwise("review").alias("verdict"))
    none = files.select("file_id").join(split.where("verdict = 'auto'").select("file_id"), "file_id", "left_anti")
    return split.unionByName(none.select("file_id", F.lit("other").alias("key"), F.lit(1.0).alias("confidence"), F.lit("fallback").alias("source"), F.lit("auto").alias("verdict")))


def reviews(tags: DataFrame) -> DataFrame:
    return tags.where("verdict = 'review'").select("file_id", F.col("key").alias("suggested"), "confidence", review_type(F.col("source")).alias("review_type"))


def candidates(scored: DataFrame, scores: dict[str, tuple[Column, str, int]]) -> DataFrame:
    """Long candidates (file_id, key, confidence, source, stage) of wide rule scores: key to (score, source, stage); scores
    of zero or null are none. One pass: the scores are an array that is unnested."""
    each = F.array(*[F.struct(F.lit(k).alias("key"), c.cast("double").alias("confidence"), F.lit(s).alias("source"), F.lit(n).alias("stage")) for k, (c, s, n) in scores.items()])
    return scored.select("file_id", F.explode(F.filter(each, lambda e: e["confidence"] > 0)).alias("e")).select("file_id", "e.*")


def pipeline(files: DataFrame, scored: DataFrame, scores: dict[str, tuple[Column, str, int]], more: DataFrame, enabled: DataFrame, auto_threshold: float) -> DataFrame:
    """(file_id, key, confidence, source, verdict) of files (file_id, is_video): the classification as one flow.

    A video is tagged 'videos' with confidence 1 and takes part in no further stage. The stages of all other files give wide
    rule scores (``scored`` by ``scores``, see candidates()) and long ones of models (``more``: file_id, key, confidence,
    source, stage), null or zero scores being none. The highest per file and key is kept and resolved against the threshold."""
    videos = files.where("is_video").select("file_id", F.lit("videos").alias("key"), F.lit(1.0).alias("confidence"), F.lit("filesystem").alias("source"), F.lit(0).alias("stage"))
    still = files.where("NOT is_video").select("file_id")
    rules = candidates(scored.join(still, "file_id", "left_semi"), scores)
    models = more.where("confidence > 0").join(still, "file_id", "left_semi").select("file_id", "key", "confidence", "source", "stage")
    return resolved(files, videos.union(rules).union(models), enabled, auto_threshold)


def gated(scores: dict[str, tuple[Column, str, int]], enabled: set[str], unavailable: set[int] = frozenset()) -> dict[str, tuple[Column, str, int]]:
    """The rule scores whose key is enabled and whose stage can run; what is left out is never computed."""
    return {k: v for k, v in scores.items() if k in enabled and v[2] not in unavailable}


def summary(tags: DataFrame) -> DataFrame:
    return tags.groupBy("key").agg(F.count_if(F.col("verdict") == "auto").alias("tagged"), F.count_if(F.col("verdict") == "review").alias("to_review"))


def resolve_review(tags: DataFrame, queue: DataFrame, decisions: DataFrame, categories: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(tags, queue) after decisions (id, category_id): a manual tag of confidence 1 is inserted unless the file has one of that
    category in the run, also by another decision; the review is marked resolved. A null run equals no other. Decisions on
    unknown or resolved reviews, and for categories that ``categories`` (id) has not, change nothing; of several decisions on
    one review that of the smallest category counts."""
    d = decisions.select("id", F.col("category_id").alias("chosen")).where("chosen IS NOT NULL")
    if categories is not None:
        d = d.join(categories.select(F.col("id").alias("chosen")), "chosen", "left_semi")
    d = d.groupBy("id").agg(F.min("chosen").alias("chosen"))
    done = queue.where(~F.col("resolved")).join(d, "id")
    fresh = done.select("file_id", F.col("chosen").alias("category_id"), "run_id", F.lit(1.0).alias("confidence"), F.lit("manual").alias("source"))
    key = ["file_id", "category_id", "run_id"]
    whole = F.col("file_id").isNotNull() & F.col("run_id").isNotNull()
    added = fresh.where(whole).dropDuplicates(key).join(tags.select(*key), key, "left_anti").unionByName(fresh.where(~whole))
    kept = queue.join(d, "id", "left").withColumn("now", ~F.col("resolved") & F.col("chosen").isNotNull()).select(
        *[c for c in queue.columns if c not in ("resolved", "resolved_category_id")], (F.col("resolved") | F.col("now")).alias("resolved"),
        F.when(F.col("now"), F.col("chosen")).otherwise(F.col("resolved_category_id")).alias("resolved_category_id"))
    return tags.unionByName(added, allowMissingColumns=True), kept


def primary_and_links(tags: DataFrame) -> DataFrame:
    """(file_id, key, rank): tags of a file by (priority, key); rank 1 is the primary."""
    return tags.withColumn("rank", F.row_number().over(W.partitionBy("file_id").orderBy("priority", "key")))
