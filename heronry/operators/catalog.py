"""Reads and changes of the catalogue tables. A change is (table, change) -> table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from heronry.functions.constants import TAXONOMY
from heronry.operators.organise import ranked


def tags_with_categories(tags: DataFrame, categories: DataFrame) -> DataFrame:
    """Tags with key, label and priority of their category."""
    c = categories.select(F.col("id").alias("category_id"), "key", "label", "priority")
    return tags.join(c, "category_id")


def tags_of_run(tags: DataFrame, files: DataFrame, categories: DataFrame, run_id: str) -> DataFrame:
    """Tags of one run with their file and category; by priority and filename where an order is wanted."""
    f = files.select(F.col("id").alias("file_id"), "path", "filename")
    return tags_with_categories(tags.where(F.col("run_id") == run_id), categories).join(f, "file_id")


def review_list(queue: DataFrame, files: DataFrame, categories: DataFrame, review_type: str | None = None, resolved: bool = False) -> DataFrame:
    """Reviews with their file and, if it still exists, their suggested category; None and 'all' mean every type."""
    q = queue.where(F.col("resolved") == resolved)
    if review_type not in (None, "all"):
        q = q.where(F.col("review_type") == review_type)
    f = files.select(F.col("id").alias("file_id"), "path", "filename")
    c = categories.select(F.col("id").alias("suggested_category_id"), F.col("key").alias("suggested_key"))
    return q.join(f, "file_id").join(c, "suggested_category_id", "left")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def run_summary(tags: DataFrame, categories: DataFrame, run_id: str) -> DataFrame:
    """(key, label, tags, files) of a run."""
    return (tags_with_categories(tags.where(F.col("run_id") == run_id), categories).groupBy("key", "label")
            .agg(F.count("*").alias("tags"), F.count_distinct("file_id").alias("files")))


def insert_or_ignore(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The table with those rows whose key it has not; of new rows with one key the one of smallest values is kept. A key
    with a null equals none: such rows are all inserted."""
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    rest = [c for c in table.columns if c not in key]
    one = rows.where(whole).groupBy(*key).agg(F.min(F.struct(*rest)).alias("r")).select(*key, *[F.col("r")[c].alias(c) for c in rest])
    fresh = one.join(table.select(*key), key, "left_anti").select(*table.columns)
    return table.unionByName(fresh).unionByName(rows.where(~whole).select(*table.columns))


def insert_or_replace(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The table with its rows of the same key replaced."""
    return table.join(rows.select(*key), key, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def updated(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with the non-null columns of changes (key, ...) put in; keys it has not are ignored."""
    c = changes.dropDuplicates([key]).select(F.col(key), *[F.col(x).alias(f"_{x}") for x in changes.columns if x != key])
    return table.join(c, key, "left").select(*[F.coalesce(F.col(f"_{x}"), F.col(x)).alias(x) if f"_{x}" in c.columns else F.col(x) for x in table.columns])


def latest_by(table: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given."""
    return table.withColumn("_at", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col("_at") == 1).drop("_at")


def purge_counts(**tables: DataFrame) -> DataFrame:
    """(table, rows) of the tables that a purge would empty."""
    parts = [t.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def seeded(categories: DataFrame) -> DataFrame:
    """The category table with those of the built-in taxonomy that it has not, by key; new ids follow its largest."""
    spark = categories.sparkSession
    have = categories.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    rows = spark.createDataFrame([(i + 1, *t) for i, t in enumerate(TAXONOMY)], "at int, key string, label string, priority int, default_enabled boolean, detection string")
    new = rows.join(categories.select("key"), "key", "left_anti").crossJoin(have)  # one row; the taxonomy is 15
    return categories.unionByName(new.select((F.col("at") + F.col("top")).cast(categories.schema["id"].dataType).alias("id"), "key", "label", "priority", "default_enabled", "detection"))


def appended(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The table with new rows under the ids that follow its largest, in the order of their ``at``; columns they lack are null."""
    top = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    numbered = ranked(rows.withColumn("_all", F.lit(0)), ["_all"], ["at"], "_n").withColumn("id", (F.lit(top) + F.col("_n")).cast(table.schema["id"].dataType))
    return table.unionByName(numbered.drop("_all", "_n", "at"), allowMissingColumns=True)


def removed(table: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return table.join(gone.select(key).distinct(), key, "left_anti").select(*table.columns)


def assigned(faces: DataFrame, assignments: DataFrame, people: DataFrame) -> DataFrame:
    """Faces with the person of assignments (id, person_id) to persons that exist; of several for one face the smallest."""
    known = assignments.join(people.select(F.col("id").alias("person_id")), "person_id", "left_semi").groupBy("id").agg(F.min("person_id").alias("_to"))
    return faces.join(known, "id", "left").select(*[F.coalesce("_to", "person_id").alias(c) if c == "person_id" else F.col(c) for c in faces.columns])


def selection_bytes(files: DataFrame, selected: DataFrame) -> DataFrame:
    """One row: files and bytes of a selection (path); unknown sizes count as nothing."""
    return files.join(selected.select("path").distinct(), "path", "left_semi").agg(F.count("*").alias("files"), F.coalesce(F.sum(F.greatest("size_bytes", F.lit(0))), F.lit(0)).alias("bytes"))
