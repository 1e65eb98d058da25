from pyspark.sql import functions as F

from heronry.operators.watch import stable_files
from heronry.streaming import watch


def test_stream_equals_batch(spark, tmp_path):
    data = [(1, f"/w/{n}", t, s, 0) for n, steps in {"a.jpg": [1, 1, 1, 2], "b.jpg": [1, 2, 3, 3], "c.tmp": [1, 1, 1, 1], "d.jpg": [5, 5, 5, 5]}.items() for t, s in enumerate(steps)]
    df = spark.createDataFrame(data, "config_id long, file_path string, t long, size long, mtime long").withColumn("poll_ts", F.timestamp_seconds("t")).drop("t")
    for i in range(2):  # two micro-batches
        df.where((F.unix_timestamp("poll_ts") >= 2) == bool(i)).select("config_id", "file_path", "poll_ts", "size", "mtime").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = watch.debounce(watch.observations(spark, str(tmp_path / "in")), 2, timeout=False)
    told = []

    def fails(b):
        raise ValueError("no")

    q = watch.run_pipeline(s, [("classify", lambda b: b), ("organise", fails), ("dedupe", lambda b: b)], str(tmp_path / "out"), str(tmp_path / "log"))
    q.awaitTermination(120)
    q.stop()
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        told.append((r["file_path"], r["step"], r["status"]))
    want = {r["file_path"] for r in stable_files(df.where("file_path NOT LIKE '%.tmp'"), 2).collect()}
    assert want == {"/w/a.jpg", "/w/d.jpg"}
    assert sorted(told) == sorted((f, s, st) for f in want for s, st in (("classify", "completed"), ("organise", "failed"), ("dedupe", "completed")))


def test_results_of_steps_are_kept(spark, tmp_path):
    spark.createDataFrame([("/w/a",), ("/w/b",)], "file_path string").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("file_path string").parquet(str(tmp_path / "in"))
    steps = [("groups", lambda b: b.groupBy().agg(F.array_sort(F.collect_list("file_path")).alias("paths"))), ("plan", lambda b: b.select("file_path", F.lit("/x").alias("dst")))]
    q = watch.run_pipeline(s, steps, str(tmp_path / "out"), str(tmp_path / "log"))
    q.awaitTermination(120)
    q.stop()
    read = lambda name: spark.read.parquet(str(tmp_path / f"out-results/step={name}")).drop("batch").collect()
    assert [r["paths"] for r in read("groups")] == [["/w/a", "/w/b"]]
    assert sorted(tuple(r) for r in read("plan")) == [("/w/a", "/x"), ("/w/b", "/x")]


def test_gap_windows(spark, tmp_path):
    rows = [(1, "a", 0), (1, "b", 3), (1, "c", 10), (2, "d", 1), (1, "z", 1000)]
    spark.createDataFrame(rows, "config_id long, file_path string, t long").select("config_id", "file_path", F.timestamp_seconds("t").alias("stable_at")).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("config_id long, file_path string, stable_at timestamp").parquet(str(tmp_path / "in"))
    q = watch.gap_windows(s, 3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    got = sorted((r["config_id"], r["files"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, ["a", "b"]), (1, ["c"]), (2, ["d"])]


def test_manager():
    class Q:
        stopped = 0

        def stop(self):
            Q.stopped += 1

    m = watch.WatchManager(lambda c: Q())
    assert m.reconcile([{"id": 1, "enabled": True}, {"id": 2, "enabled": False}]) == {1: "started"}
    assert m.reconcile([{"id": 1, "enabled": True}]) == {}
    assert m.reconcile([{"id": 1, "enabled": True, "window": 3}]) == {1: "restarted"}
    assert m.reconcile([]) == {1: "stopped"} and Q.stopped == 2


def test_steps_of_the_catalogue(spark, tmp_path):
    """The four steps over static tables, their results kept; a file is found under any spelling."""
    from heronry.operators import watch as batch
    from heronry.streaming import watch

    files = spark.createDataFrame([(1, "/a/x.jpg"), (2, "/a/y.jpg"), (3, "/a/z.mov")], "id long, path string").selectExpr("*", "timestamp_ntz'2024-03-01 00:00:00' AS created_at")
    tags = spark.createDataFrame([(1, "pets", "auto"), (3, "videos", "auto")], "file_id long, key string, verdict string")
    prints = spark.createDataFrame([("/a/x.jpg", 1, 10), ("/a/y.jpg", 3, 20)], "path string, h long, resolution long")
    latest = spark.createDataFrame([], "local_path string, content_hash string")
    steps = dict(watch.catalogue_steps(files, tags, prints, latest))
    b = spark.createDataFrame([("/a//x.jpg",), ("/a/z.mov",)], "file_path string")
    assert sorted(r["key"] for r in steps["classify"](b).collect()) == ["pets", "videos"]
    assert {r["dst"] for r in steps["organize"](b).collect()} == {"/organised/2024/March/x.jpg", "/organised/2024/March/z.mov"}
    assert {(r["path"], r["is_best"]) for r in steps["dedupe"](b).collect()} == {("/a/x.jpg", False), ("/a/y.jpg", True)}
    assert {r["action"] for r in steps["cloud_sync"](b).collect()} == {"upload"}
    listed = spark.createDataFrame([("/a/x.jpg",), ("/a/.hidden",), ("/a/n.jpg",)], "path string")
    done = spark.createDataFrame([("/a/./x.jpg", "completed")], "file_path string, status string")
    assert [tuple(r) for r in batch.backfill(listed, done, 4).collect()] == [(4, "/a/n.jpg")]
