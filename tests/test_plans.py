"""Plans of the queries over near hashes: the keys of the hashes, many times the size that Spark takes them to have, stay in the tasks."""

import pytest

from heronry.operators import dedupe, hamming
from heronry.session import Scratch
from heronry.plans.dedupe import QUERIES

NAMES = [
    "dup_hamming_groups",
    "dup_hamming_groups_10",
    "dest_aware_skip",
    "dup_keep_plan",
    "dup_refresh",
    "dup_representatives",
    "dup_top_groups",
    "dup_best_lock",
    "dup_hamming_pairs",
    "dup_report",
]


@pytest.mark.parametrize("name", NAMES)
def test_keys_are_not_broadcast(spark, data, monkeypatch, name):
    plans, verified = [], hamming._verified

    def kept(*a):
        found = verified(*a)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(hamming, "_verified", kept)
    QUERIES[name](spark, data)
    assert plans and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)


def _stored_groups(spark):
    g = spark.createDataFrame([("/a", "/a", True, 2), ("/a", "/b", False, 2)], "group_id string, path string, is_best boolean, group_size long")
    return Scratch(spark, "plans").save(g, "groups")


def test_chosen_files_meet_groups_merged(spark):
    """The paths of stored groups, many times their files' size, are not gathered by the driver."""
    g = _stored_groups(spark)
    found = dedupe.delete_selected(g, spark.createDataFrame([("/a",), ("/b",), ("/c",)], "path string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted((r["path"], r["verdict"]) for r in found.collect()) == [("/a", "locked"), ("/b", "trash"), ("/c", "unknown")]


def test_gone_files_leave_groups_merged(spark):
    """The paths that are gone are not gathered by the driver either."""
    g = _stored_groups(spark)
    gone = Scratch(spark, "plans").save(spark.createDataFrame([("/c",)], "path string"), "gone")
    left = dedupe.without(g, gone)
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "LeftAnti" in x]
    assert sorted((r["path"], r["group_size"]) for r in left.collect()) == [("/a", 2), ("/b", 2)]
