"""File listings, pictures, journals and settings as DataFrames."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.functions.constants import IMAGE_EXTENSIONS, SYNC_EXTENSIONS, VIDEO_EXTENSIONS
from heronry.functions.paths import basename, extension
from heronry.functions.phash import phash_column

KINDS = {"images": IMAGE_EXTENSIONS, "videos": VIDEO_EXTENSIONS, "media": IMAGE_EXTENSIONS + VIDEO_EXTENSIONS, "both": IMAGE_EXTENSIONS + VIDEO_EXTENSIONS, "sync": SYNC_EXTENSIONS, "all": None}


def listing(spark: SparkSession, folder: str, kind: str = "all", recursive: bool = True) -> DataFrame:
    """(path, filename, extension, size_bytes, modified_at) of a folder's files of a kind. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder)
    f = files.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))
    f = f.withColumn("filename", basename(F.col("path"))).withColumn("extension", extension(F.col("filename")))
    if KINDS[kind] is not None:
        f = f.where(F.col("extension").isin(KINDS[kind]))
    return f.select("path", "filename", "extension", "size_bytes", "modified_at")


def only(listed: DataFrame, paths: DataFrame) -> DataFrame:
    """Those of a listing that a list of files (path) names."""
    return listed.join(paths.select("path").distinct(), "path", "left_semi")


def content_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """(local_path, content_hash, size_bytes) with SHA-256 of the contents."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return f.select(F.col("path").alias("local_path"), F.sha2("content", 256).alias("content_hash"), F.col("length").alias("size_bytes"))


def scan_counters(listed: DataFrame) -> DataFrame:
    """files_seen and images_found of a listing."""
    return listed.agg(F.count("*").alias("files_seen"), F.count_if(F.col("extension").isin(IMAGE_EXTENSIONS)).alias("images_found"))


def pictures(spark: SparkSession, folder: str) -> DataFrame:
    """(path, width, height, resolution, h) of readable pictures below a folder; others have a null hash and sizes."""
    img = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(folder).select("image.*")
    ok = (F.col("width") > 0) & (F.col("height") > 0)
    return img.select(F.col("origin").alias("path"), F.when(ok, F.col("width")).alias("width"), F.when(ok, F.col("height")).alias("height"),
                      F.when(ok, F.col("width").cast("long") * F.col("height")).alias("resolution"),
                      phash_column("height", "width", "nChannels", "data").alias("h"))


def edge_density(spark: SparkSession, folder: str, size: int = 400, least: int = 80) -> DataFrame:
    """(path, density): share of strong edge pixels of each picture in grey at size x size."""
    from heronry.functions.phash import grey, resized

    @F.pandas_udf("double")
    def density(h: pd.Series, w: pd.Series, c: pd.Series, data: pd.Series) -> pd.Series:
        out = []
        for hh, ww, cc, d in zip(h, w, c, data):
            g = grey(hh, ww, cc, d)
            if g is None:
                out.append(None)
                continue
            p = np.pad(resized(g, size), 1, mode="edge")
            around = sum(p[1 + y:1 + y + size, 1 + x:1 + x + size] for y in (-1, 0, 1) for x in (-1, 0, 1) if x or y)
            out.append(float((np.clip(8 * p[1:-1, 1:-1] - around, 0, 255) > least).mean()))
        return pd.Series(out, dtype="float64")

    img = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(folder).select("image.*")
    return img.select(F.col("origin").alias("path"), density("height", "width", "nChannels", "data").alias("density"))


def journals(spark: SparkSession, folder: str) -> DataFrame:
    """(session_id, seq, action, src, dst, ts) of a folder's journals: files that are a JSON array each, whose name is the
    session, and the folders of write_journal(). Unreadable files give no rows."""
    schema = "action string, src string, dst string, timestamp string, ts string, seq long, error string"
    found = spark.createDataFrame([], f"session_id string, {schema}")
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [x.getPath().getName() for x in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
    if any(n.endswith(".json") for n in names):
        j = spark.read.schema(schema).option("multiLine", True).json(f"{folder}/*.json")
        name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1), r"\.json$", "")
        found = found.unionByName(j.withColumn("session_id", name).withColumn("seq", F.coalesce("seq", F.monotonically_increasing_id())))
    if any(n.startswith("session_id=") for n in names):
        found = found.unionByName(spark.read.schema(f"{schema}, session_id string").option("basePath", folder).json(f"{folder}/session_id=*"))
    when = F.coalesce(F.try_to_timestamp("timestamp"), F.try_to_timestamp("ts"))
    return found.where("action IS NOT NULL AND error IS NULL").select("session_id", "seq", "action", "src", "dst", when.alias("ts"))


def write_journal(journal: DataFrame, folder: str) -> None:
    """Append actions (session_id, seq, action, src, dst, ts, and error if they failed), one folder per session."""
    journal.write.mode("append").partitionBy("session_id").json(folder)


def config(path: str | Path, defaults: dict) -> dict:
    """Settings of a JSON file over defaults; a missing or broken file gives the defaults."""
    try:
        found = json.loads(Path(path).read_text())
        return defaults | (found if isinstance(found, dict) else {})
    except (OSError, ValueError):
        return dict(defaults)
