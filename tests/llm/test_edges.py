"""Defined cases: empty tables, nulls, ties, repeats, clashing columns, hot groups."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronry.llm import clusters, consolidate, history, leaks, neighbours, quality, survivors, together, tokens
from heronry.llm.queries import QUERIES
from heronry.session import Scratch

T0 = dt.datetime(2024, 1, 1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, folder, name):
    assert QUERIES[name](spark, folder()).count() == 0


def test_rows_of_nulls(spark, folder):
    d = folder(**{t: [{}, {}] for t in ("media_files", "image_info", "duplicate_groups", "media_tags", "people", "watcher_events", "eval_items", "doc_labels")},
               face_embeddings=[{}, {"id": 1}], documents=[{"doc_id": 1}, {"doc_id": 2, "text": ""}])
    for name, f in QUERIES.items():
        got = f(spark, d).collect()
        assert {"p8_ids": 2, "p10_statistics": 2}.get(name, 0) == len(got), name
    assert all(r["ids"] == [] for r in tokens.p8_ids(spark, d).collect())


# p1

def test_survivor_rules(spark, folder):
    f = lambda i, **x: {"id": i, "path": f"/a/{i}", "created_at": T0, **x}
    s = lambda i, p, r, day, **x: {"info_id": i, "path": p, "resolution": r, "scanned_at": day and T0 + dt.timedelta(day), **x}
    d = folder(media_files=[f(1), f(2, size_bytes=9), f(3, size_bytes=9, created_at=None), f(4, size_bytes=-5), f(5), f(6)],
               image_info=[s(1, "/a/1", 100, 1), s(2, "/a/1", 50, 2), s(3, "/a/1", 0, 3), s(4, "/a/1", 100, 1), s(5, "/a/5", 70, 1), s(6, "\\a\\5", 90, None), s(7, "/a/6", 70, 1, hash="0x1f")],
               duplicate_groups=[{"group_id": 1, "paths": ["/a/1", "/a//2"]}, {"group_id": 2, "paths": ["/a/2", "/a/3"]}, {"group_id": 3, "paths": ["/a/4", "/a/4", "/gone"]},
                                 {"group_id": 4, "paths": ["/a/5", "/a/6", None]}, {"group_id": 5, "paths": []}, {"group_id": 6}, {"group_id": 7, "paths": ["/a/3", "/a/4"]}])
    assert rows(survivors.p1_found(spark, d)) == [(1, 1), (2, 2), (4, 5), (7, 3)]
    r = {x["group_id"]: x for x in survivors._run(spark, d)[0].collect()}
    assert (r[1]["resolution"], r[1]["size_bytes"]) == (50, 9)  # the newest scan, and the size of the next best copy
    assert r[7]["created_at"] == T0 and r[4]["hash"] == 0x1f


def test_trust_turns_a_value(spark, folder):
    """The newest scan is of a month that is contradicted everywhere: by learned trust the older value stands, by recency the
    newer; and the file that the trusted scans name is voted for, against the only scan that is contradicted."""
    day = lambda m: dt.datetime(2024, m, 1)
    info, n = [], 0
    for f in range(1, 21):
        for m, r in ((1, 100), (2, 100), (3, 100), (4, 7 + f)) if f > 2 else ((1, 100), (4, 500)):
            n += 1
            info.append({"info_id": n, "path": f"/{f}", "resolution": r, "scanned_at": day(m)})
    groups = [{"group_id": g, "scan_id": s, "paths": ["/1", "/2"] if g > 90 else [f"/{g}", "/20"], "best_path": b, "created_at": day(1)}
              for g, s, b in [(g, s, "/20" if s != "bad" else f"/{g}") for g in range(3, 15) for s in ("good", "fair", "bad")] + [(91, "good", "/2"), (92, "bad", "/1")]]
    for i, g in enumerate(groups):
        g["group_id"] = g["group_id"] if g["group_id"] > 90 else 1000 + i
    d = folder(media_files=[{"id": i, "path": f"/{i}", "created_at": T0} for i in range(1, 21)], image_info=info, duplicate_groups=groups)
    new = {r["group_id"]: r for r in survivors._run(spark, d)[0].collect()}
    voted = {r["group_id"]: r for r in survivors.p1_survivors(spark, d).collect()}
    trust = {r["source"]: r["trust"] for r in survivors.p1_trust(spark, d).collect()}
    assert trust["scans of 2024-04"] < trust["scans of 2024-01"] and trust["groups of bad"] < trust["groups of good"]
    assert new[91]["resolution"] == 500 and voted[91]["resolution"] == 100 and voted[91]["voted_id"] == 2 == voted[92]["voted_id"]


def test_truth_discovery_weighs_sources(spark):
    """Without recency, two agreeing good sources outvote a bad one, and a bad source's lone claim has less support."""
    claims = [(f"e{i}", "f", "right", s, i) for i in range(30) for s in ("good", "fair")] + [(f"e{i}", "f", f"wrong{i}", "bad", i) for i in range(30)]
    claims += [("x", "f", "a", "good", 1), ("x", "f", "b", "bad", 2)]
    df = spark.createDataFrame(claims, "entity string, field string, value string, source string, claim_id int").withColumn("at", F.lit(0))
    values, trust = survivors.discover(df, older=None)
    t = {r["source"]: r["trust"] for r in trust.collect()}
    v = {r["entity"]: r["value"] for r in values.collect()}
    assert t["good"] > 0.9 and t["bad"] < 0.6 and v["x"] == "a" and all(v[f"e{i}"] == "right" for i in range(30))


# p2

def brute_components(edges):
    import brute
    s = brute.Sets()
    for a, b in edges:
        s.join(a, b)
    return sorted((x, s.find(x)) for x in list(s.p))


@pytest.mark.parametrize("seed", [1, 2])
def test_grid(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 380)] + [(500, k) for k in range(501, 560)] + [(7, 7), (900, 900)]
    r.shuffle(edges)
    df = spark.createDataFrame(edges + edges[:5] + [(None, 3), (3, None)], "a long, b long")
    assert rows(consolidate.grid_components(df, edges_per_cell=15)) == brute_components(edges)


def test_listed_paths_are_not_broadcast(spark, folder, monkeypatch):
    """Listed paths are many times what Spark takes their lists to be: they must not go to the driver."""
    d = folder(media_files=[{"id": i, "path": f"/a/{i}"} for i in range(4)], duplicate_groups=[{"group_id": 1, "paths": ["/a/0", "/a/1"]}, {"group_id": 2, "paths": ["/a/1", "/a/3", "/b"]}])
    plans, save = {}, Scratch.save

    def kept(self, df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return save(self, df, name)

    monkeypatch.setattr(Scratch, "save", kept)
    assert rows(QUERIES["p2_found"](spark, d)) == [(0, 0), (1, 0), (3, 0)]
    assert "SortMergeJoin" in plans["members"] and "Broadcast" not in plans["members"]


def test_hot_list_and_hash(spark, folder):
    """A third of all files in one list, a third with one hash; nothing is paired up."""
    files = [{"id": i, "path": f"/{i}"} for i in range(1, 91)]
    d = folder(media_files=files, image_info=[{"info_id": i, "path": f"/{i}", "hash": "ff", "scanned_at": T0} for i in range(31, 61)] + [{"info_id": 99, "path": "/61", "hash": "00ff00ff00000000", "scanned_at": T0}],
               duplicate_groups=[{"group_id": 1, "paths": [f"/{i}" for i in range(1, 32)]}])
    assert rows(consolidate.p2_found(spark, d)) == [(i, 1) for i in range(1, 61)]


# p3

def write_faces(folder, vectors):
    return folder(face_embeddings=[{"id": i, "embedding": None if v is None else [float(x) for x in v]} for i, v in vectors])


def test_copies_and_unusable(spark, folder):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=128), rng.normal(size=128)
    bad = [None, np.zeros(128), a[:64], np.where(np.arange(128) == 3, np.nan, a), np.where(np.arange(128) == 3, np.inf, a)]
    many = [(i, a) for i in range(100, 130)] + [(200, b), (201, b * 7.5), (202, -b)] + [(300 + i, v) for i, v in enumerate(bad)]
    got = rows(neighbours.p3_found(spark, write_faces(folder, many)))
    want = {tuple(sorted((i, j))) for i in range(100, 130) for j in [k for k in range(100, 106) if k != i][:5]}
    assert got == sorted(want | {(200, 201)})


def test_near_copies_in_blocks(spark):
    """A third of all rows in one cell: cut into blocks, nothing lost. The table scan plus bound loses no pair."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=128)
    x = np.concatenate([base + rng.normal(size=(60, 128)) * 0.1, rng.normal(size=(120, 128))]).astype(np.float32)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    index = neighbours.Index(u.astype(np.float32), 180, rows_per_cell=30, rows_per_block=10)
    assert index.blocks.max() > 1
    ids = np.arange(180)
    got = neighbours.search_cell(index, 0, ids, x, ids, x, 5, 0.9, 64)
    s = np.round(u.astype(float) @ u.T.astype(float), 9)
    np.fill_diagonal(s, -2)
    want = {(i, j) for i in range(180) for j in np.argsort(-s[i], kind="stable")[:5] if s[i, j] >= 0.9}
    assert want and want <= set(zip(got["q"], got["x"]))
    df = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x)], "id long, v array<float>")
    old, neighbours.ROWS_PER_BLOCK = neighbours.ROWS_PER_BLOCK, 10
    try:
        assert {(r["q"], r["x"]) for r in neighbours.similar(df, 5, least=0.9).collect()} == want
    finally:
        neighbours.ROWS_PER_BLOCK = old


def test_anisotropic_words_lower_the_parallel_error():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    aware, plain = neighbours.Quantiser(x, x, score=0.8), neighbours.Quantiser(x, x, score=0.0)
    (ca, pa), (cp, pp) = aware.encode(x, x), plain.encode(x, x)
    assert np.abs(pa).mean() < np.abs(pp).mean()
    assert np.allclose(pa, np.einsum("nd,nd->n", x, x - aware.decode(ca)), atol=1e-4)
    assert np.allclose(aware.scan(ca, x[:7]), aware.decode(ca) @ x[:7].T, atol=1e-4) and ca.max() < 16


# p4

def ev(i, job, day, path, status="completed"):
    return {"id": i, "triggered_job_id": job, "detected_at": None if day is None else T0 + dt.timedelta(day), "file_path": path, "status": status}


def test_batches(spark, folder):
    d = folder(watcher_events=[
        ev(1, "a", 1, "/x"), ev(2, "a", 1, "/x"), ev(3, "b", 2, "\\x", "failed"), ev(4, None, 3, "/x"), ev(5, "b", 2, "/y", "running"), ev(6, "c", 3, "/y"), ev(7, "d", 4, "/y", None),
        ev(8, "e", 5, "/h2"), ev(9, "a", 1, "/h1", " COMPLETED "), ev(10, "f", None, "/x"), ev(11, "g", 1, "/x"), ev(12, "h", 9, None), ev(13, "h", 9, "/far")],
        image_info=[{"info_id": 1, "path": "/h1", "hash": "ff", "scanned_at": T0}, {"info_id": 2, "path": "/h2", "hash": "e0", "scanned_at": T0}, {"info_id": 3, "path": "/far", "hash": "ffffff", "scanned_at": T0}])
    assert rows(history.p4_found(spark, d)) == [(3,), (7,), (8,)]


@pytest.mark.parametrize("cap", [2000, 3])
def test_batch_after_batch(spark, cap):
    """Screening and appending batch by batch finds what one pass finds, also where piece buckets overflow."""
    r = random.Random(5)
    hs = [r.getrandbits(12) << 30 for _ in range(40)] + [r.getrandbits(62) for _ in range(20)]
    rec = [(i, r.randrange(4), r.random() < 0.7, f"/{r.randrange(60)}", r.choice(hs)) for i in range(150)]
    df = spark.createDataFrame(rec, "record_id long, b int, accepted boolean, pkey string, h long").withColumn("batch_at", F.timestamp_seconds("b"))
    whole = history.BatchHistory(Scratch(spark, "w"), 4, cap=cap, at="timestamp")
    whole.append(df.where("accepted"))
    once = rows(whole.screen(df))
    want = sorted((i,) for i, b, _, p, h in rec if any(a2 and b2 < b and (p2 == p or bin(h ^ h2).count("1") <= 5) for _, b2, a2, p2, h2 in rec))
    assert once == want
    step, got = history.BatchHistory(Scratch(spark, "s"), 4, cap=cap, at="timestamp"), []
    for b in range(4):
        part = df.where(F.col("b") == b)
        got += rows(step.screen(part))
        step.append(part.where("accepted"))
    assert sorted(got) == want and (cap > 3) == (not step.hot.folders)


def test_batch_reads_its_buckets(spark, monkeypatch):
    """A small batch adds files to the buckets of its own keys, and reads no others; what is known adds no row."""
    rec = [(i, True, f"/{i}", (i + 1) * 0x9E3779B97F4A7C1 % 2**63) for i in range(200)]
    make = lambda x: spark.createDataFrame(x, "record_id long, accepted boolean, pkey string, h long").withColumn("batch_at", F.timestamp_seconds("record_id"))
    h = history.BatchHistory(Scratch(spark, "b"), 64, at="timestamp")
    h.append(make(rec))
    before = {t.name: {b: list(f) for b, f in t.folders.items()} for t in (h.exact, h.pieces)}
    read = []
    monkeypatch.setattr(type(h.exact), "read", lambda self, buckets=None, f=type(h.exact).read: (read.append((self.name, buckets)), f(self, buckets))[1])
    one = make([(999, True, "/7", 5)])
    assert rows(h.screen(one)) == [(999,)]
    h.append(one)
    assert all(b is not None and len(b) <= {"exact": 2}.get(n, 21) for n, b in read)
    assert sum(before["exact"].get(b) != f for b, f in h.exact.folders.items()) == 1 and h.exact.read().where("pkey = '/7'").count() == 1
    assert 0 < sum(before["pieces"].get(b) != f for b, f in h.pieces.folders.items()) <= 21


# p6

def test_linkage_is_average_linkage():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(1, 16)) + rng.normal(size=(n, 16)) * 0.35 for n in (1, 2, 5, 9)])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    groups = [[i] for i in range(len(x))]
    s = x.astype(float) @ x.T.astype(float)
    while len(groups) > 1:
        best = max(((np.mean(s[np.ix_(a, b)]), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        if best[0] < 0.6:
            break
        groups[best[1]] += groups.pop(best[2])
    owner, _, n = clusters.linkage(x, np.ones(len(x)), 0.6)
    assert sorted(sorted(np.nonzero(owner == o)[0].tolist()) for o in set(owner)) == sorted(sorted(g) for g in groups)
    assert sorted(n[list(set(owner))].tolist()) == sorted(len(g) for g in groups)


def test_hot_cluster(spark, folder):
    """A third of all faces are one person, some of them copies; the rest are alone or pairs."""
    rng = np.random.default_rng(6)
    p = rng.normal(size=128)
    v = [(i, p + rng.normal(size=128) * 0.3 if i % 4 else p) for i in range(1, 61)] + [(i, rng.normal(size=128)) for i in range(100, 220)] + [(500, None), (501, np.zeros(128))]
    pair = rng.normal(size=128)
    v += [(300, pair), (301, pair * 2)]
    d = write_faces(folder, v)
    assert rows(clusters.p6_found(spark, d)) == [(i, 1) for i in range(1, 61)]
    c = clusters.p6_clusters(spark, d).collect()
    assert [(r["cluster_face_id"], r["faces"], len(r["typical"])) for r in c] == [(1, 60, 3)]


@pytest.mark.parametrize(("parts", "one_task"), [(1, 4000), (3, 60), (7, 60)])
def test_global_linkage(spark, monkeypatch, parts, one_task):
    """Overlapping data: equal to exact average linkage on any number of partitions, in tasks and in rounds over the table."""
    rng = np.random.default_rng(62)
    x = rng.normal(size=(20, 16))[rng.integers(0, 20, 240)] + rng.normal(size=(240, 16)) * 0.8
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    owner, _, n = clusters.linkage(x, np.ones(len(x)), 0.55)
    first = np.full(len(x), len(x))
    np.minimum.at(first, owner, np.arange(len(x)))
    assert 20 < len(set(owner)) < 120
    monkeypatch.setattr(clusters, "ONE_TASK", one_task)
    df = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "id long, v array<float>").repartition(parts)
    members, found = clusters.cluster(df, 0.55, dim=16)
    assert rows(members) == [(i, int(first[owner[i]])) for i in range(len(x))]
    assert {r["rep"]: r["n"] for r in found.collect()} == {int(first[o]): int(n[o]) for o in set(owner)}


def test_parted_clusters(spark, monkeypatch):
    """Cells, blocks and tasks part clusters; the exact pass puts all together again."""
    rng = np.random.default_rng(61)
    group = np.arange(120) % 12
    v = rng.normal(size=(12, 128))[group] + rng.normal(size=(120, 128)) * 0.3
    v = np.concatenate([v, rng.normal(size=(60, 128))])
    df = spark.createDataFrame([(i + 1, [float(y) for y in x]) for i, x in enumerate(v)], "id long, v array<float>").repartition(4)
    for name, value in (("ROWS_PER_CELL", 8), ("ROWS_PER_BROADCAST", 50), ("ROWS_PER_GROUP", 20), ("Z", -9)):
        monkeypatch.setattr(clusters, name, value)
    members, found = clusters.cluster(df)
    assert rows(members) == [(i + 1, i % 12 + 1 if i < 120 else i + 1) for i in range(180)]
    got = {r["rep"]: r for r in found.collect()}
    assert {k: r["n"] for k, r in got.items()} == {i + 1: 10 if i < 12 else 1 for i in [*range(12), *range(120, 180)]}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert all(np.allclose(got[g + 1]["v"], u[:120][group == g].mean(0), atol=1e-5) for g in range(12))


def test_second_level_of_centres():
    """Cells found over head centres: most rows get the same home as by looking at all centres."""
    rng = np.random.default_rng(63)
    x = neighbours.unit((rng.normal(size=(40, 32))[rng.integers(0, 40, 2000)] + rng.normal(size=(2000, 32)) * 0.4))
    flat, deep = neighbours.Cells(x[:300]), neighbours.Cells(x[:300], flat=100)
    assert deep.heads is not None and (flat.near(x)[0] == deep.near(x)[0]).mean() > 0.9
    home, r, c = deep.near(x, 0.2)
    assert len(r) and (home[r] != c).all()


def test_crowded_cell_keeps_few(monkeypatch):
    """Of a tight group of different vectors, a cell holds a few pairs a query and a row, not the square, and loses none."""
    rng = np.random.default_rng(34)
    x = (rng.normal(size=128) + rng.normal(size=(900, 128)) * 0.1).astype(np.float32)
    x[50:55] = x[700]  # further copies than k + 1 are told by overflow()
    x[60:65] = x[701] * np.float32(2)
    ids = rng.permutation(900).astype(np.int64)
    index = neighbours.Index(neighbours.unit(x), len(x), rows_per_cell=1000)
    widest = [0]
    monkeypatch.setattr(neighbours.np, "repeat", lambda a, n, f=np.repeat, **kw: (widest.append(len(a)), f(a, n, **kw))[1])
    got = neighbours.search_cell(index, 0, ids, x, ids, x, 5, 0.96, 64)
    monkeypatch.undo()
    assert max(widest) <= 2 * 6 * len(x)
    u = neighbours.unit(x, np.float64)
    s = (u @ u.T).round(9)
    np.fill_diagonal(s, -2)
    assert (s >= 0.96).sum() > 100 * len(x)
    want = {(int(ids[i]), int(ids[j])) for i in range(900) for j in np.lexsort((ids, -s[i]))[:5]}
    assert want <= set(zip(got["q"], got["x"])) and want <= {(b, a) for a, b in zip(got["q"], got["x"])}


def test_most_similar_is_exact(spark, folder, monkeypatch):
    """The ten nearest of faces without close ones, over several cells, batches and blocks of queries; copies tie by id."""
    monkeypatch.setattr(neighbours, "QUERIES_PER_BROADCAST", 10, raising=False)
    v = np.random.default_rng(33).normal(size=(2500, 128)).astype(np.float32)
    v[40:80] = v[100]
    d = write_faces(folder, [(i, x) for i, x in enumerate(v)])
    u = v.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = (u @ u.T).round(9)
    np.fill_diagonal(s, -2)
    want = sorted((i, int(j)) for i in range(0, 2500, 100) for j in np.lexsort((np.arange(2500), -s[i]))[:10])
    assert rows(neighbours.p3_similar(spark, d).select("face_id", "similar_id")) == want


# p7

def test_pairs_increment(spark):
    r = random.Random(7)
    a = [(r.randrange(30), r.randrange(6)) for _ in range(90)] + [(5, None), (None, 2), (77, None)]
    b = [(r.randrange(40), r.randrange(6)) for _ in range(60)]
    gone = r.sample(a[:90], 20)
    make = lambda x: spark.createDataFrame(x, "basket long, item int")
    c = together.PairCounts(Scratch(spark, "t"), 16)
    c.apply(make(a))
    c.apply(make(b))
    c.apply(make([]), make(gone))
    left = {}
    for k, i in a + b:
        if k is not None:
            left.setdefault(k, set()).update([i] if i is not None else [])
    for k, i in gone:
        left[k].discard(i)
    want = {}
    for s in left.values():
        for x in s:
            for y in s:
                if x < y:
                    want[x, y] = want.get((x, y), 0) + 1
    got = {(x["a"], x["b"]): (x["n_ab"], x["n"]) for x in c.scores().collect()}
    assert got == {k: (n, len(left)) for k, n in want.items()}
    baskets, counts = dict(c.baskets.folders), dict(c.counts.folders)
    told = c.apply(make([(3000, 0), (3000, 1)]))
    assert sum(baskets.get(b) != f for b, f in c.baskets.folders.items()) == 1  # one bucket of baskets, and those of its pair and items
    assert {b for b, f in c.counts.folders.items() if counts.get(b) != f} == set(told) and len(told) <= 3
    assert {(x["a"], x["b"]) for x in c.scores(told).collect()} >= {(0, 1)}


def test_wide_basket(spark):
    """A basket wider than WIDE has its pairs made by many tasks."""
    old, together.WIDE = together.WIDE, 5
    try:
        c = together.PairCounts(Scratch(spark, "t"))
        c.apply(spark.createDataFrame([(1, i) for i in range(12)] * 2 + [(2, 0), (2, 1)], "basket long, item int"))
        s = {(r["a"], r["b"]): r["n_ab"] for r in c.scores().collect()}
        assert len(s) == 66 and s[0, 1] == 2 and s[3, 9] == 1
        sets = spark.createDataFrame([(list(range(12)), 1)], "new array<int>, n long")
        tasks = together._wide_pairs(sets, "new", 1).groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) > 1 and sum(r[1] for r in tasks) == 66
        c.apply(spark.createDataFrame([], "basket long, item int"), spark.createDataFrame([(1, i) for i in range(3, 12)], "basket long, item int"))
        assert {(r["a"], r["b"]): r["n_ab"] for r in c.scores().collect()} == {(0, 1): 2, (0, 2): 1, (1, 2): 1}
    finally:
        together.WIDE = old


# p8

def test_encoder_round_trip():
    import public_tokenizers as public
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    r = random.Random(8)
    texts = ["", None, " ", "\n\n  x", "<|endoftext|>", "a" * 20_000, "don't I'LL we've", "​‮﻿", "é \U0001f415‍\U0001f9ba", "\r\n\t\x00x"]
    texts += ["".join(chr(r.choice([32, 10, 39, 65 + r.randrange(60), 0x3b1 + r.randrange(20), 0x4e00 + r.randrange(500), 0x1f600 + r.randrange(40)])) for _ in range(80)) for _ in range(200)]
    offsets, ids = tokens.encoder(tokens.VOCABULARY).encode(texts)
    for i, text in enumerate(texts):
        assert ids[offsets[i]:offsets[i + 1]] == t.encode(text or "", add_special_tokens=False).ids


def test_perfect_hash():
    keys = [f"k{i}".encode() for i in range(3001)]
    h = tokens.PerfectHash(keys)
    assert h.index(keys).tolist() == list(range(3001)) and sorted(h.at.tolist()) == list(range(3001))
    assert h.index([b"", b"x", b"k3001"]).tolist() == [-1, -1, -1] and tokens.PerfectHash([]).index([b"a"]).tolist() == [-1]


# p9

W = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()


def test_leak_rules(spark, folder):
    text = lambda ws, sep=" ": sep.join(ws)
    docs = [text(W), text(W[:12]), text(W[:11]), text(W[1:13], "\r\n - "), text(W[:6]) + " other " + text(W[6:]), text(W[:12]).upper().replace("E", "É"),
            text(W[:12]).replace("a", "a­​"), "x " + text(W[3:15], "! ") + " y", None, "", text(W[:12]), text([w + "x" for w in W]), (text(W[:11]) + " ") * 400]
    d = folder(documents=[{"doc_id": i, "text": t} for i, t in enumerate(docs)], eval_items=[{"item_id": 1, "text": text(W)}, {"item_id": 2, "text": text(W[:11])}, {"item_id": 3, "text": text(W)}, {"item_id": 4}])
    hit = [0, 1, 3, 5, 6, 7, 10]
    assert rows(leaks.p9_found(spark, d)) == sorted((i, k) for i in hit for k in (1, 3))
    all_ = leaks.leaks(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/eval_items.parquet"), shard_words=20, block_chars=40)
    got = {(r["doc_id"], r["item_id"]): (r["words"], r["doc_word"], r["item_word"]) for r in all_.collect()}
    assert set(got) == {(i, k) for i in hit for k in (1, 3)} and got[0, 1] == (15, 0, 0) and got[7, 1] == (12, 1, 3)
    assert rows(leaks.without_leaks(spark.read.parquet(f"{d}/documents.parquet").select("doc_id"), all_)) == [(i,) for i in range(13) if i not in hit]


def test_suffix_array():
    r = np.random.default_rng(9)
    seq = r.integers(0, 3, 300)
    sa = leaks.suffix_array(seq, 12)
    words = [tuple(seq[i:i + 12]) for i in sa]
    assert sorted(sa.tolist()) == list(range(300)) and words == sorted(words)


# p10

def test_statistics_of_texts():
    common = dict.fromkeys("the was on it is still there and we like".split(), 1)
    s = dict(zip(quality.STATS, quality.measure("The dog was on the table.\n\nIt is still there, and we like it.", common)))
    assert (s["words"], s["lines"], s["line_ends"], s["natural"]) == (14, 2, 1.0, 1.0) and s["common"] > 0.5
    for junk in ("- a\n- b\n- c", "1,2,3\n4,5,6", "\x00", "#a #b #c", "5f 10 5d\n" * 5, "la " * 50):
        assert quality.measure(junk, common)[quality.STATS.index("natural")] < 0.5
    for empty in (None, "", " \n\t", "​­"):
        assert quality.measure(empty, common) is None


def test_common_words_are_learned(spark):
    """The words of most sentences, by language; tags and tables teach nothing. Held-out sentences of an unlisted language pass."""
    r = random.Random(10)
    say = lambda: " ".join(w for _ in range(4) for w in (r.choice(["ki", "na", "ta"]), "".join(r.choice("bdfgklmnoaeiu") for _ in range(6)))).capitalize() + "."
    docs = [(i, say() + "\n" + say(), "xx") for i in range(60)] + [(100 + i, "img_01 tag tag\nred;blue;4\n", "xx") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    words = quality.common_words(df, Scratch(spark, "q"))
    assert {"ki", "na", "ta"} <= words["xx"].keys() and not {"tag", "red", "blue"} & words["xx"].keys()
    s = quality.measure(say(), words["xx"])
    assert s[quality.STATS.index("natural")] == 1.0 and s[quality.STATS.index("common")] >= 0.5


def test_without_labels(spark, folder):
    d = folder(documents=[{"doc_id": 1, "text": "The dog was on the table and it is still there."}, {"doc_id": 2, "text": "5f 10 5d 00\n" * 9}, {"doc_id": 3, "text": " "}, {"doc_id": 4, "lang": "EN_us", "text": "5f 10 5d 00\n" * 9}])
    assert rows(quality.p10_found(spark, d)) == [(2,), (4,)]
    s = {r["doc_id"]: r for r in quality.p10_statistics(spark, d).collect()}
    assert s[3]["words"] is None and s[3]["score"] is None and s[4]["language"] == "en" and s[1]["score"] < 0
