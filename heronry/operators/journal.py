"""Journals of actions (session_id, seq, action, src, dst) and their undo."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def sessions(journal: DataFrame) -> DataFrame:
    """(session_id, actions, last_at); newest first where an order is wanted."""
    return journal.groupBy("session_id").agg(F.count("*").alias("actions"), F.max("ts").alias("last_at"))


def search(found: DataFrame, q: str) -> DataFrame:
    """Sessions whose id or number of actions contains q, in any case; a blank q keeps all."""
    q = q.strip().lower()
    if not q:
        return found
    return found.where(F.lower(F.col("session_id").cast("string")).contains(q) | F.col("actions").cast("string").contains(q))


def undo_plan(journal: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(session_id, step, action, src, dst, status): actions undone from the last to the first. A move goes back, a copy or
    symlink is deleted, a deletion to trash comes back, a permanent one cannot. What is no longer at its place (``existing``
    (path)) fails and the rest goes on."""
    back = F.when(F.col("action").isin("move", "trash"), "move").when(F.col("action").isin("copy", "symlink"), "delete").otherwise("none")
    p = journal.select("session_id", F.row_number().over(W.partitionBy("session_id").orderBy(F.col("seq").desc())).alias("step"),
                       back.alias("action"), F.col("dst").alias("src"), F.when(back == "move", F.col("src")).alias("dst"))
    status = F.when(F.col("action") == "none", "failed")
    if existing is not None:
        p = p.join(existing.select(F.col("path").alias("src"), F.lit(True).alias("there")).distinct(), "src", "left")
        status = status.when(F.col("there").isNull(), "failed")
    return p.select("session_id", "step", "action", "src", "dst", status.otherwise("reverted").alias("status"))


def undo_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("session_id").agg(F.count_if(F.col("status") == "reverted").alias("reverted"), F.count_if(F.col("status") == "failed").alias("failed"))


def shallowest_folder(plan: DataFrame) -> DataFrame:
    """(session_id, folder): of the folders that files came back to the one of fewest steps, then by name."""
    folder = F.regexp_replace("dst", r"/[^/]*$", "")
    d = plan.where("status = 'reverted' AND dst IS NOT NULL").select("session_id", folder.alias("folder"))
    return d.groupBy("session_id").agg(F.min(F.struct(F.size(F.split("folder", "/")).alias("n"), "folder"))["folder"].alias("folder"))


def export_session(journal: DataFrame, session_id: str, folder: str) -> None:
    """Write one session's actions, in order, as JSON lines."""
    journal.where(F.col("session_id") == session_id).repartitionByRange("seq").sortWithinPartitions("seq").write.mode("overwrite").json(folder)
