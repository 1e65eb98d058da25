"""Carrying out a plan of file actions, and writing its journal. Everything else only makes plans."""

from __future__ import annotations

import os
import shutil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.session import Scratch


def _act(action: str, src: str, dst: str | None) -> str | None:
    """None, or what went wrong."""
    try:
        if action == "delete":
            os.remove(src)
            return None
        if dst is None or os.path.lexists(dst):
            return "exists" if dst else "no target"
        os.makedirs(os.path.dirname(dst) or ".", exist_ok=True)
        if action in ("move", "trash"):
            shutil.move(src, dst)
        elif action == "copy":
            shutil.copy2(src, dst)
        elif action == "symlink":
            os.symlink(src, dst)
        else:
            return "unknown action"
        return None
    except OSError as e:
        return str(e)


def carry_out_in_steps(plan: DataFrame, session_id: str, scratch: Scratch) -> DataFrame:
    """carry_out of a plan (step, action, src, dst), one step after the other: links are made when their files are in place."""
    out = None
    for (step,) in sorted(plan.select("step").distinct().collect()):
        done = scratch.save(carry_out(plan.where(F.col("step") == step), session_id).withColumn("seq", F.col("seq") + (step << 48)), f"step{step}")
        out = done if out is None else out.union(done)
    return out if out is not None else carry_out(plan, session_id)


def carry_out(plan: DataFrame, session_id: str) -> DataFrame:
    """(session_id, seq, action, src, dst, ts, error) after acting on each row of a plan (action, src, dst) on the executors,
    which must share the folders. An action that fails is told and the rest goes on. Materialise the result once: acting is
    its side effect. A repeated task finds its targets and reports them as existing."""

    def run(batches):
        for b in batches:
            b["error"] = pd.Series([_act(*x) for x in zip(b["action"], b["src"], b["dst"])], dtype=object)
            yield b

    acted = plan.select(F.monotonically_increasing_id().alias("seq"), "action", "src", "dst").mapInPandas(run, "seq long, action string, src string, dst string, error string")
    return acted.select(F.lit(session_id).alias("session_id"), "seq", "action", "src", "dst", F.current_timestamp().alias("ts"), "error")
