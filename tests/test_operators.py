import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heronry.operators import catalog, classify, dedupe, faces, integrity, journal, media, organise, sync, watch
from heronry.operators.components import connected_components
from heronry.operators.hamming import blocked_pairs, hamming_pairs
from heronry.session import Scratch


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def near_hashes(n, seed=0, flips=5):
    r = random.Random(seed)
    out = [r.getrandbits(64) for _ in range(n)]
    for h in list(out):
        for _ in range(r.randrange(flips + 2)):
            h ^= 1 << r.randrange(64)
        out.append(h)
    return [h - 2**64 if h >> 63 else h for h in out]


def brute_pairs(hs, t):
    hs = sorted(set(hs))
    return sorted((a, b) for i, a in enumerate(hs) for b in hs[i + 1:] if bin((a ^ b) % 2**64).count("1") <= t)


@pytest.mark.parametrize("t", [0, 1, 5])
def test_hamming_pairs(spark, t):
    hs = near_hashes(120, t) + [5, 5, None]
    assert rows(hamming_pairs(spark.createDataFrame([(h,) for h in hs], "h long"), t)) == brute_pairs([h for h in hs if h is not None], t)


def test_hamming_pairs_hot_bucket(spark):
    """Hashes that share most bits all meet in hot buckets; splitting them further loses no pair."""
    r = random.Random(3)
    hs = [(0x5555 << 40) | r.getrandbits(14) for _ in range(300)]
    assert rows(hamming_pairs(spark.createDataFrame([(h,) for h in hs], "h long"), 5, cap=20)) == brute_pairs(hs, 5)


def test_hamming_pairs_edges(spark):
    none = spark.createDataFrame([], "h long")
    assert rows(hamming_pairs(none, 5)) == [] and rows(hamming_pairs(spark.createDataFrame([(1,), (3,)], "h long"), -1)) == []
    hs = near_hashes(60, 9, 16)
    assert rows(hamming_pairs(spark.createDataFrame([(h,) for h in hs], "h long"), 16)) == brute_pairs(hs, 16)
    assert rows(blocked_pairs(spark.createDataFrame([(h,) for h in set(hs)], "h long"), 16, rows_per_block=25)) == brute_pairs(hs, 16)


@pytest.mark.parametrize("t", [5, 10])
def test_hamming_keys_are_not_broadcast(spark, t):
    """The keys of a hash are many times its size, of which Spark's estimate knows nothing: they must not go to the driver."""
    hs = near_hashes(200, 4, 10)
    plan = hamming_pairs(spark.createDataFrame([(h,) for h in hs], "h long"), t)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def components(edges):
    p = {}

    def find(x):
        p.setdefault(x, x)
        while p[x] != x:
            x = p[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in list(p))


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(100), r.randrange(100)) for _ in range(60)] + [(i, i + 1) for i in range(200, 240)] + [(300, k) for k in range(301, 330)] + [(400, 400)]
    assert rows(connected_components(spark.createDataFrame(edges + [(None, 1)], "a long, b long"))) == components(edges)
    assert rows(connected_components(spark.createDataFrame([], "a long, b long"))) == []


def test_groups_chain_and_ties(spark):
    """A chain joins files farther apart than the threshold; of equal resolutions the smallest path is best."""
    fp = [("/a", 0b1, 10), ("/b", 0b111, 10), ("/c", 0b11111, None), ("/d", 0b111 << 40, 5), ("/e", None, 99), ("/f", 0b111 << 40, 5), ("/g", -1, 1)]
    g = dedupe.duplicate_groups(spark.createDataFrame(fp, "path string, h long, resolution long"), 2)
    assert rows(g.select("group_id", "path", "is_best", "group_size")) == [("/a", "/a", True, 3), ("/a", "/b", False, 3), ("/a", "/c", False, 3), ("/d", "/d", True, 2), ("/d", "/f", False, 2)]
    skips = dedupe.destination_skips(g, F.col("path") == "/b")
    assert rows(skips) == [("/a", "/a"), ("/c", "/a"), ("/f", "/d")]
    empty = dedupe.duplicate_groups(spark.createDataFrame([], "path string, h long, resolution long"), 5)
    r = dedupe.report(empty, spark.createDataFrame([], "path string, size_bytes long"), spark.createDataFrame([], "path string, h long")).first()
    assert (r["groups"], r["success_rate"], r["images_per_group"]) == (0, 0.0, 0.0)


def test_free_names_and_plan(spark):
    f = spark.createDataFrame([("/x/a.jpg", None), ("/y/a.jpg", None)], "path string, t string").select("path", F.lit("2024-03-01").cast("timestamp_ntz").alias("created_at"))
    assert {r["reason"] for r in organise.organise_plan(f, f.limit(0)).collect()} == {"success", "name_duplicate"}
    n = spark.createDataFrame([("/t", "a.jpg", 1), ("/t", "a.jpg", 2), ("/t", "b", 3)], "folder string, name string, i int")
    taken = spark.createDataFrame([("/t", "a.jpg"), ("/t", "a_1.jpg")], "folder string, name string")
    assert rows(organise.with_free_names(n, "folder", "name", "i").select("i", "free_name")) == [(1, "a.jpg"), (2, "a_1.jpg"), (3, "b")]
    assert rows(organise.with_free_names(n, "folder", "name", "i", taken).select("i", "free_name")) == [(1, "a_2.jpg"), (2, "a_3.jpg"), (3, "b")]


def test_resolution(spark):
    c = [(1, "pets", 0.6, "ml_scene", 3), (1, "pets", 0.6, "exif", 1), (1, "food", 0.59, "ml_scene", 3), (2, "food", 0.5, "ml_scene", 3), (3, "off", 0.9, "x", 1)]
    files, on = spark.createDataFrame([(1,), (2,), (3,)], "file_id long"), spark.createDataFrame([("pets",), ("food",)], "key string")
    got = classify.resolved(files, spark.createDataFrame(c, "file_id long, key string, confidence double, source string, stage int"), on, 0.6)
    assert rows(got) == [(1, "food", 0.59, "ml_scene", "review"), (1, "pets", 0.6, "exif", "auto"), (2, "food", 0.5, "ml_scene", "review"),
                         (2, "other", 1.0, "fallback", "auto"), (3, "other", 1.0, "fallback", "auto")]


def test_insert_rules(spark):
    t = spark.createDataFrame([(1, "r", 0.1), (1, None, 0.2)], "f long, run string, c double")
    new = spark.createDataFrame([(1, "r", 0.9), (2, "r", 0.8), (2, "r", 0.7), (1, None, 0.2)], "f long, run string, c double")
    assert sorted(map(str, catalog.insert_or_ignore(t, new, ["f", "run"]).collect())) == sorted(map(str, spark.createDataFrame(
        [(1, "r", 0.1), (1, None, 0.2), (2, "r", 0.7), (1, None, 0.2)], "f long, run string, c double").collect()))
    assert rows(catalog.insert_or_replace(t.where("run IS NOT NULL"), new.where("c = 0.9"), ["f", "run"])) == [(1, "r", 0.9)]


def test_reference_counts_increment(spark, tmp_path):
    """A late record takes its references out of the report, a deleted one puts them in; a third of all rows on one key is fine."""
    tags = spark.createDataFrame([(i, 7 if i % 3 == 0 else i % 5) for i in range(1, 61)] + [(99, None)], "id long, file_id long").withColumn("created_at", F.lit("2024-05-01").cast("timestamp_ntz"))
    files = spark.createDataFrame([(0,), (1,), (2,), (None,)], "id long")
    refs = integrity.reference_rows(tags, "media_tags", "media_files", "file_id")
    s = integrity.ReferenceCounts(Scratch(spark, "t")).apply(integrity.reference_deltas(refs), integrity.existence_deltas(files, "media_files"))
    assert rows(s.orphan_keys()) == [("media_files", 3), ("media_files", 4), ("media_files", 7)]
    s = s.apply(integrity.existence_deltas(spark.createDataFrame([(7,)], "id long"), "media_files"), integrity.existence_deltas(spark.createDataFrame([(1,)], "id long"), "media_files", -1))
    assert rows(s.orphan_keys()) == [("media_files", 1), ("media_files", 3), ("media_files", 4)]
    gone = integrity.reference_deltas(refs.where("key = 3"), -1)
    s = s.apply(gone)
    want = [(r["row_id"],) for r in refs.where("key IN (1, 4)").collect()]
    assert rows(integrity.orphan_rows(refs, s.orphan_keys()).select("row_id")) == sorted(want)
    r = s.report().first()
    assert (r["ref_table"], r["period"], r["orphan_rows"], r["orphan_keys"]) == ("media_tags", "2024-05", len(want), 2)
    none = integrity.ReferenceCounts(Scratch(spark, "t")).apply(integrity.reference_deltas(refs.limit(0)), integrity.existence_deltas(files.limit(0), "media_files"))
    few = integrity.ReferenceCounts(Scratch(spark, "t"), 64)
    few.apply(integrity.reference_deltas(refs))
    held = dict(few.table.folders)
    few.apply(integrity.existence_deltas(spark.createDataFrame([(7,)], "id long"), "media_files"))
    assert sum(held[b] != few.table.folders[b] for b in held) == 1 and len(held) > 3  # one bucket is rewritten
    assert rows(none.report()) == [] and rows(integrity.orphan_rows(refs, none.orphan_keys())) == []


def leaders(vectors, t):
    out, heads = {}, []
    for i, v in sorted(vectors):
        for h, w in heads:
            if round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 9) >= t:
                out[i] = h
                break
        else:
            heads.append((i, v))
            out[i] = i
    return sorted(out.items())


@pytest.mark.parametrize("step", [3, 10, 500])
def test_leader_clusters_are_sequential(spark, step):
    rng = np.random.default_rng(step)
    v = [(int(i), rng.normal(size=4)) for i in rng.permutation(60)]
    df = spark.createDataFrame([(i, [float(x) for x in w]) for i, w in v] + [(1000, None), (1001, [0.0] * 4)], "id long, v array<double>")
    assert rows(faces.leader_clusters(df, 0.5, step=step)) == leaders(v, 0.5) + [(1000, 1000), (1001, 1001)]


def test_top_match(spark):
    known = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "id long, v array<float>")
    probes = spark.createDataFrame([(10, [2.0, 0.0]), (11, [1.0, 1.0]), (12, [-1.0, -1.0])], "id long, v array<float>")
    assert rows(faces.top_match(probes, known, 0.8)) == [(10, 1, 1.0)]
    assert [r[:2] for r in rows(faces.top_match(probes, known, 0.5, block=1))] == [(10, 1), (11, 1)]
    assert rows(faces.top_match(probes, known.limit(0), 0.5)) == []


def test_top_match_memory():
    """A batch of many probes is compared with a block piece by piece, and equals the comparison as a whole, ties included."""
    r = np.random.default_rng(5)
    y = r.standard_normal((2000, 32))
    y = np.concatenate([y, y[:50], y[:50] + 1e-8])
    x = np.concatenate([r.standard_normal((9900, 32)), y[20:120] + 1e-3 * r.standard_normal((100, 32))])
    ids = r.permutation(len(y)) + 1
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), pa.array(list(x))], names=["id", "v"])
    tracemalloc.start()
    got = pa.Table.from_batches(faces._matches([batch], ids, unit(y), 0.4))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    order = np.argsort(ids)
    s = np.round(unit(x) @ unit(y)[order].T, 9)
    keep = s.max(1) >= 0.4
    assert keep.sum() > 100 and got.column("id").to_pylist() == np.flatnonzero(keep).tolist()
    assert got.column("known_id").to_pylist() == ids[order][s.argmax(1)][keep].tolist() and np.array_equal(got.column("similarity"), s.max(1)[keep])
    assert peak < 50e6 < s.nbytes


def test_people(spark):
    people = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    f = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id long, person_id long")
    p, moved = faces.merge_people(people, f, spark.createDataFrame([(1, 2), (9, 3), (1, 1)], "keep_id long, merge_id long"))
    assert rows(p) == [(1,), (3,)] and sorted(map(tuple, moved.collect()), key=str) == [(10, 1), (11, 1), (12, None)]
    p, loose = faces.delete_people(people, f, spark.createDataFrame([(1,)], "id long"))
    assert rows(p) == [(2,), (3,)] and sorted(map(tuple, loose.collect()), key=str) == [(10, None), (11, 2), (12, None)]
    assert loose.count() == faces.delete_people(people, f, spark.createDataFrame([(1,)], "id long"), True)[1].count() + 1


def test_sync(spark):
    local = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "local_path string, content_hash string")
    m = spark.createDataFrame([(1, 1, "a", "1", 5, "uploaded"), (2, 1, "b", "x", 5, "uploaded"), (3, 1, "c", "3", 5, "failed"), (4, 2, "d", "4", 5, "uploaded"),
                               (5, 1, "b", "2", 4, "uploaded")], "id long, sync_run_id long, local_path string, content_hash string, uploaded_at int, status string")
    runs = spark.createDataFrame([(1, 7, "completed"), (2, 8, "running"), (3, 7, "partial")], "id long, account_id long, status string")
    plan = sync.sync_plan(local, sync.latest_uploads(m, runs, 7))
    assert rows(plan.select("local_path", "reason")) == [("a", "unchanged"), ("b", "changed"), ("c", "new"), ("d", "new")]
    assert {r["action"] for r in sync.sync_plan(local, sync.latest_uploads(m, runs, 7), full=True).collect()} == {"upload"}
    s = {r["id"]: (r["total"], r["uploaded"]) for r in sync.run_statistics(runs, m).collect()}
    assert s == {1: (4, 3), 2: (1, 1), 3: (0, None)}
    assert sync.undo_plan(runs, m.withColumn("remote_path", F.lit("r")), 1).count() == 0  # not the last run


def test_undo(spark):
    j = spark.createDataFrame([("s", 1, "move", "/a/1", "/b/1"), ("s", 2, "copy", "/a/2", "/b/2"), ("s", 3, "delete", "/a/3", None), ("s", 4, "symlink", "/a/4", "/b/4")],
                              "session_id string, seq long, action string, src string, dst string")
    p = journal.undo_plan(j, spark.createDataFrame([("/b/1",), ("/b/4",)], "path string"))
    assert rows(p.select("step", "action", "status")) == [(1, "delete", "reverted"), (2, "none", "failed"), (3, "delete", "failed"), (4, "move", "reverted")]
    assert rows(journal.undo_counts(p)) == [("s", 2, 2)]


def polls(spark, data):
    return spark.createDataFrame([(1, f, t, s, 0) for f, t, s in data], "config_id long, file_path string, t long, size long, mtime long").withColumn("poll_ts", F.timestamp_seconds("t")).drop("t")


def test_debounce_batch(spark):
    data = [("a", 0, 1), ("a", 1, 1), ("a", 2, 1), ("b", 0, 1), ("b", 1, 2), ("b", 2, 2), ("c", 0, 1), ("c", 300, 1), ("d", 0, 1), ("d", 301, 1)]
    assert [r["file_path"] for r in watch.stable_files(polls(spark, data), 2).orderBy("file_path").collect()] == ["a"]
    assert [r["file_path"] for r in watch.stable_files(polls(spark, data), 1).orderBy("file_path").collect()] == ["a", "b", "c"]
    assert watch.stable_files(polls(spark, data), 0).count() == 4


def test_gap_batches(spark):
    e = spark.createDataFrame([(1, 0), (2, 3), (3, 7), (4, 10)], "id long, t long").select("id", F.lit(1).alias("k"), F.timestamp_seconds("t").alias("at"))
    assert rows(watch.gap_batches(e, ["k"], "at").select("id", "batch")) == [(1, 1), (2, 1), (3, 2), (4, 2)]


def test_compression(spark):
    f = spark.createDataFrame([("a", 100, 40), ("a", 100, None), ("b", 0, 0)], "k string, size_before long, size_after long")
    assert rows(media.compression_statistics(f, ["k"])) == [("a", 2, 1, 200, 140, 60, 30.0), ("b", 1, 0, 0, 0, 0, 0.0)]


def test_one_file_under_two_spellings(spark):
    """A file scanned under several spellings is no duplicate of itself, and the best file is never moved."""
    scans = [(1, "/a/x.jpg", "ff", 10, 1), (2, "\\a\\x.jpg", "ff", 90, 2), (3, "/a/./y.jpg", "fe", 5, 1), (4, "file:///a/z%20z.jpg", "ff00ff", 1, 1)]
    df = spark.createDataFrame(scans, "info_id long, path string, hash string, resolution long, t int").withColumn("scanned_at", F.timestamp_seconds("t"))
    g = dedupe.duplicate_groups(dedupe.fingerprints(df), 5)
    assert rows(g.select("path", "is_best", "group_size")) == [("/a/x.jpg", True, 2), ("/a/y.jpg", False, 2)]
    assert rows(dedupe.keep_plan(g).select("src", "dst")) == [("/a/y.jpg", "/duplicates/y.jpg")]
    assert rows(dedupe.representatives(g)) == [("/a/x.jpg", 255)]
    found = spark.createDataFrame([("/a/x.jpg",), ("/b",)], "file_path string")
    done = spark.createDataFrame([(" /a//x.jpg ", "completed"), ("/b", "running")], "file_path string, status string")
    assert rows(watch.unprocessed(found, done)) == [("/b",)]


def test_names_are_free(spark):
    """No two rows and no file that is there get one name, whatever the names look like."""
    names = ["a.jpg", "a.jpg", "a_1.jpg", "a.jpg", "a_1.jpg", "b", "b", "c_2.x", "c.x", "c.x", "d.jpg"]
    df = spark.createDataFrame([("/t", n, i) for i, n in enumerate(names)], "folder string, name string, i int")
    got = dict(rows(organise.with_free_names(df, "folder", "name", "i").select("i", "free_name")))
    assert [got[i] for i in range(11)] == ["a.jpg", "a_2.jpg", "a_1.jpg", "a_3.jpg", "a_1_1.jpg", "b", "b_1", "c_2.x", "c.x", "c_1.x", "d.jpg"]
    taken = spark.createDataFrame([("/t", "a_2.jpg"), ("/t", "d.jpg"), ("/t", "d_1.jpg")], "folder string, name string")
    got = [r["free_name"] for r in organise.with_free_names(df, "folder", "name", "i", taken).collect()]
    assert len(set(got)) == len(got) and not {"a_2.jpg", "d.jpg", "d_1.jpg"} & set(got) and "d_2.jpg" in got


def test_ranks_of_a_hot_key(spark):
    r = random.Random(2)
    data = [(("hot" if i % 3 == 0 else f"k{i % 7}"), r.random(), i) for i in range(300)] + [(None, 0.5, 900), (None, 0.1, 901)]
    got = rows(organise.ranked(spark.createDataFrame(data, "k string, o double, i int"), ["k"], ["o", "i"]).select("i", "rank"))
    want = sorted((i, 1 + sum(k2 == k and (o2, i2) < (o, i) for k2, o2, i2 in data)) for k, o, i in data)
    assert got == want


def test_links_to_where_the_file_lies(spark):
    t = spark.createDataFrame([("/x/a.jpg", "one", "One", 1), ("/x/a.jpg", "two", "Two", 2), ("/y/a.jpg", "one", "One", 1), ("/y/a.jpg", "two", "Two", 2)], "path string, key string, label string, priority int")
    p = organise.category_plan(t.withColumn("created_at", F.lit("2024-03-01").cast("timestamp_ntz")), "flat_tags", "move", "/s")
    assert rows(p) == [(1, "move", "/x/a.jpg", "/s/One/a.jpg"), (1, "move", "/y/a.jpg", "/s/One/a_1.jpg"),
                       (2, "symlink", "/s/One/a.jpg", "/s/Two/a.jpg"), (2, "symlink", "/s/One/a_1.jpg", "/s/Two/a_1.jpg")]


def test_reviews_insert_or_ignore(spark):
    tags = spark.createDataFrame([(1, 5, "r", 0.9, "x")], "file_id long, category_id int, run_id string, confidence double, source string")
    queue = spark.createDataFrame([(10, 1, "r", False, None), (11, 2, "r", False, None), (12, 2, "r", False, None), (13, 3, "r", False, None), (14, 4, None, False, None)],
                                  "id long, file_id long, run_id string, resolved boolean, resolved_category_id int")
    decisions = spark.createDataFrame([(10, 5), (11, 6), (12, 6), (13, 99), (14, 6)], "id long, category_id int")
    after, left = classify.resolve_review(tags, queue, decisions, spark.createDataFrame([(5,), (6,)], "id int"))
    assert sorted(map(tuple, after.select("file_id", "category_id", "source").collect())) == [(1, 5, "x"), (2, 6, "manual"), (4, 6, "manual")]
    assert rows(left.where("resolved").select("id")) == [(10,), (11,), (12,), (14,)]


def test_merges_in_chains(spark):
    people = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
    f = spark.createDataFrame([(10 + i, i) for i in range(1, 8)], "id long, person_id long")
    p, moved = faces.merge_people(people, f, spark.createDataFrame([(1, 2), (2, 3), (5, 4), (6, 7), (7, 6)], "keep_id long, merge_id long"))
    assert rows(p) == [(1,), (5,), (6,)] and rows(moved) == [(11, 1), (12, 1), (13, 1), (14, 5), (15, 5), (16, 6), (17, 6)]


def test_pipeline_lets_videos_alone(spark):
    files = spark.createDataFrame([(1, True), (2, False), (3, False)], "file_id long, is_video boolean")
    more = spark.createDataFrame([(1, "pets", 0.9, "ml_scene", 3), (2, "pets", 0.7, "ml_scene", 3), (3, "pets", 0.3, "ml_scene", 3)], "file_id long, key string, confidence double, source string, stage int")
    on = spark.createDataFrame([("videos",), ("pets",), ("night",)], "key string")
    scored = files.select("file_id", F.when(F.col("file_id") == 2, 0.5).otherwise(0.0).alias("n"))
    got = classify.pipeline(files, scored, {"night": (F.col("n"), "exif", 1)}, more, on, 0.6)
    assert rows(got.select("file_id", "key", "verdict")) == [(1, "videos", "auto"), (2, "night", "review"), (2, "pets", "auto"), (3, "other", "auto"), (3, "pets", "review")]
