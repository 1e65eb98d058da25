"""Parquet tables of a data folder, and views on them that several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.functions.hashes import parse_hash
from heronry.functions.paths import path_key


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def files_by_path(media_files: DataFrame, *columns: str) -> DataFrame:
    """(pkey, file_id, columns) of each catalogued file."""
    return media_files.select(path_key("path").alias("pkey"), F.col("id").alias("file_id"), *columns).where("pkey IS NOT NULL")


def scans_in_force(image_info: DataFrame) -> DataFrame:
    """(pkey, h, resolution): of each scanned file the hash of its latest scan that has one and the resolution of its
    latest scan with a positive one. Scans of equal time are ordered by info_id; a scan without time is the oldest.

    One aggregation with partial aggregates, so a file with a third of all scans costs no skew."""
    at = lambda value: F.struct("scanned_at", "info_id", value.alias("v"))
    h, r = F.col("h"), F.col("resolution")
    return (
        image_info.select(path_key("path").alias("pkey"), parse_hash(F.col("hash")).alias("h"), "resolution", "scanned_at", "info_id")
        .where("pkey IS NOT NULL")
        .groupBy("pkey")
        .agg(F.max(F.when(h.isNotNull(), at(h)))["v"].alias("h"), F.max(F.when(r > 0, at(r)))["v"].alias("resolution"))
    )
