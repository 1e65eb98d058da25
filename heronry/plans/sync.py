"""Sync, journals and the folder watch, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronry.operators import journal as journal_ops
from heronry.operators import sync as ops
from heronry.operators import watch as watch_ops
from heronry.functions.paths import path_key
from heronry.plans.sql import path_key as sql_key
from heronry.sources.tables import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f
    return keep


# Local files and their manifest, made of media_files: some are new, some changed, some have two versions.
_LOCAL = "l AS (SELECT path AS local_path, sha256(path || ':' || coalesce(size_bytes, 0)) AS content_hash, coalesce(size_bytes, 0) AS size_bytes, id FROM media_files)"
_MANIFEST = """m AS (SELECT id * 2 AS id, (id % 3 + 1) AS sync_run_id, local_path, CASE WHEN id % 11 = 0 THEN 'x' || content_hash ELSE content_hash END AS content_hash, 10 AS uploaded_at, CASE WHEN id % 17 = 0 THEN 'failed' ELSE 'uploaded' END AS status FROM l WHERE id % 7 <> 0
UNION ALL SELECT id * 2 + 1, 3, local_path, 'old', 5, 'uploaded' FROM l WHERE id % 13 = 0 AND id % 7 <> 0),
y AS (SELECT * FROM m WHERE status = 'uploaded' AND sync_run_id IN (1, 3) QUALIFY row_number() OVER (PARTITION BY local_path ORDER BY uploaded_at DESC, id DESC) = 1),
p AS (SELECT l.local_path, l.content_hash, l.size_bytes, CASE WHEN y.local_path IS NULL THEN 'new' WHEN y.content_hash = l.content_hash THEN 'unchanged' ELSE 'changed' END AS reason FROM l LEFT JOIN y ON y.local_path = l.local_path)"""


def _local(spark, d):
    f = table(spark, d, "media_files")
    size = F.coalesce("size_bytes", F.lit(0))
    return f.select(F.col("path").alias("local_path"), F.sha2(F.concat("path", F.lit(":"), size.cast("string")), 256).alias("content_hash"), size.alias("size_bytes"), "id")


def _sync_plan(spark, d):
    l = _local(spark, d)  # noqa: E741
    h = F.col("content_hash")
    m = l.where("id % 7 <> 0").select((F.col("id") * 2).alias("id"), (F.col("id") % 3 + 1).alias("sync_run_id"), "local_path", F.when(F.col("id") % 11 == 0, F.concat(F.lit("x"), h)).otherwise(h).alias("content_hash"),
                                      F.lit(10).alias("uploaded_at"), F.when(F.col("id") % 17 == 0, "failed").otherwise("uploaded").alias("status"))
    m = m.union(l.where("id % 13 = 0 AND id % 7 <> 0").select(F.col("id") * 2 + 1, F.lit(3).cast("long"), "local_path", F.lit("old"), F.lit(5), F.lit("uploaded")))
    runs = spark.createDataFrame([(1, 7), (2, 8), (3, 7)], "id long, account_id long")
    return ops.sync_plan(l.select("local_path", "content_hash"), ops.latest_uploads(m, runs, 7)), l


@query("sync_diff", f"WITH {_LOCAL}, {_MANIFEST} SELECT local_path, content_hash, CASE WHEN reason = 'unchanged' THEN 'skip' ELSE 'upload' END AS action, reason FROM p")
def sync_diff(spark, d):
    return _sync_plan(spark, d)[0]


@query("sync_counts", f"WITH {_LOCAL}, {_MANIFEST} SELECT CASE WHEN reason = 'unchanged' THEN 'skip' ELSE 'upload' END AS action, count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM p GROUP BY 1")
def sync_counts(spark, d):
    plan, l = _sync_plan(spark, d)  # noqa: E741
    return ops.plan_counts(plan, l.select("local_path", "size_bytes"))


# Orders as runs (customer = account), line items as manifest rows.
_RUNS = "r AS (SELECT o_orderkey AS id, o_custkey AS account_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'partial' ELSE 'running' END AS status, o_orderdate AS started_at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1 AS is_last FROM orders)"
_ROWS = "l AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS sync_run_id, 'p' || l_partkey AS remote_path, CASE l_returnflag WHEN 'A' THEN 'uploaded' WHEN 'R' THEN 'failed' ELSE 'skipped' END AS status FROM lineitem)"


def _runs(spark, d):
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "partial").otherwise("running")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("account_id"), status.alias("status"), F.col("o_orderdate").alias("started_at"))


def _rows(spark, d):
    status = F.when(F.col("l_returnflag") == "A", "uploaded").when(F.col("l_returnflag") == "R", "failed").otherwise("skipped")
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("sync_run_id"), F.concat(F.lit("p"), "l_partkey").alias("remote_path"), status.alias("status"))


@query("sync_history", f"""WITH {_RUNS}, {_ROWS}, t AS (SELECT r.*, c_name AS label FROM r JOIN customer ON c_custkey = account_id ORDER BY started_at DESC, id DESC LIMIT 20)
SELECT t.id, t.label, t.status, coalesce(s.total, 0) AS total, s.uploaded, s.failed, s.skipped, t.is_last AND t.status IN ('completed', 'partial') AS can_undo FROM t LEFT JOIN
(SELECT sync_run_id, count(*) AS total, (sum((status = 'uploaded')::INT))::BIGINT AS uploaded, (sum((status = 'failed')::INT))::BIGINT AS failed, (sum((status = 'skipped')::INT))::BIGINT AS skipped FROM l GROUP BY 1) s ON s.sync_run_id = t.id""")
def sync_history(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"))
    return ops.history(_runs(spark, d), a, _rows(spark, d)).select("id", "label", "status", "total", "uploaded", "failed", "skipped", "can_undo")


@query("sync_run_statistics", f"""WITH {_RUNS}, {_ROWS} SELECT r.id, count(l.id) AS total, sum((l.status = 'uploaded')::INT)::BIGINT AS uploaded, sum((l.status = 'failed')::INT)::BIGINT AS failed FROM r LEFT JOIN l ON l.sync_run_id = r.id GROUP BY r.id""")
def sync_run_statistics(spark, d):
    return ops.run_statistics(_runs(spark, d), _rows(spark, d)).select("id", "total", "uploaded", "failed")


@query("sync_latest_run_per_account", f"WITH {_RUNS} SELECT account_id, id, status FROM r WHERE is_last")
def sync_latest_run_per_account(spark, d):
    from heronry.operators.catalog import latest_by

    return latest_by(_runs(spark, d), ["account_id"], [F.col("id").desc()]).select("account_id", "id", "status")


@query("sync_undo_plan", f"""WITH {_RUNS}, {_ROWS} SELECT l.id, l.remote_path, 'delete' AS action FROM l JOIN r ON r.id = l.sync_run_id WHERE l.status = 'uploaded' AND r.is_last AND r.status IN ('completed', 'partial')""")
def sync_undo_plan(spark, d):
    """What undoing every account's last run would delete."""
    return ops.undo_plan(_runs(spark, d), _rows(spark, d))


# Events as a journal: a user's events are a session.
_J = "j AS (SELECT user_id AS session_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'move' WHEN 'view' THEN 'copy' WHEN 'purchase' THEN 'delete' ELSE 'trash' END AS action, '/a/' || user_id || '/' || event_id AS src, '/b/' || event_id AS dst, ts FROM events)"


def _journal(spark, d):
    t = F.col("event_type")
    a = F.when(t == "click", "move").when(t == "view", "copy").when(t == "purchase", "delete").otherwise("trash")
    return table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), a.alias("action"),
                                            F.concat_ws("/", F.lit("/a"), "user_id", "event_id").alias("src"), F.concat_ws("/", F.lit("/b"), "event_id").alias("dst"), "ts")


_U = f"""WITH {_J}, u AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC)::INT AS step, CASE WHEN action IN ('move', 'trash') THEN 'move' WHEN action = 'copy' THEN 'delete' ELSE 'none' END AS action, dst AS src,
CASE WHEN action IN ('move', 'trash') THEN src END AS dst, CASE WHEN action = 'delete' OR seq % 9 = 0 THEN 'failed' ELSE 'reverted' END AS status FROM j) """


def _undo(spark, d):
    j = _journal(spark, d)
    return journal_ops.undo_plan(j, j.where("seq % 9 <> 0").select(F.col("dst").alias("path")))


@query("undo_plan", _U + "SELECT session_id, step, action, src, dst, status FROM u")
def undo_plan(spark, d):
    return _undo(spark, d)


@query("undo_counts", _U + "SELECT session_id, count(*) FILTER (status = 'reverted') AS reverted, count(*) FILTER (status = 'failed') AS failed FROM u GROUP BY 1")
def undo_counts(spark, d):
    return journal_ops.undo_counts(_undo(spark, d))


@query("undo_shallowest_folder", _U + ", f AS (SELECT session_id, regexp_replace(dst, '/[^/]*$', '') AS folder FROM u WHERE status = 'reverted' AND dst IS NOT NULL) SELECT session_id, arg_min(folder, (len(string_split(folder, '/')), folder)) AS folder FROM f GROUP BY 1")
def undo_shallowest_folder(spark, d):
    return journal_ops.shallowest_folder(_undo(spark, d))


@query("undo_sessions", f"WITH {_J} SELECT session_id, count(*) AS actions, max(ts) AS last_at FROM j GROUP BY 1 ORDER BY last_at DESC, session_id")
def undo_sessions(spark, d):
    return journal_ops.sessions(_journal(spark, d)).orderBy(F.col("last_at").desc(), "session_id")


@query("undo_search", f"WITH {_J}, s AS (SELECT session_id, count(*) AS actions FROM j GROUP BY 1) SELECT session_id, actions FROM s WHERE contains(session_id::VARCHAR, '7') OR contains(actions::VARCHAR, '7')")
def undo_search(spark, d):
    return journal_ops.search(journal_ops.sessions(_journal(spark, d)), " 7 ").select("session_id", "actions")


# Watch: a user's events are polls of one file, the event type is what was seen.
_RUN = """e AS (SELECT *, coalesce(event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1, true)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - 1 AS unchanged FROM i)"""


@query("watch_debounce", f"WITH {_RUN} SELECT event_id, user_id, unchanged, unchanged >= 1 AS stable FROM k")
def watch_debounce(spark, d):
    r = watch_ops.unchanged_runs(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type"))
    return r.select("event_id", "user_id", "unchanged", (F.col("unchanged") >= 1).alias("stable"))


@query("watch_stable_files", f"""WITH {_RUN}, f AS (SELECT user_id AS config_id, event_type AS file_path, 0 AS z, ts AS poll_ts, floor(value / 50)::BIGINT AS size FROM events),
c AS (SELECT *, coalesce(size IS DISTINCT FROM lag(size) OVER w OR row_number() OVER w = 1, true)::INT AS fresh FROM f WINDOW w AS (PARTITION BY config_id, file_path ORDER BY poll_ts)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY config_id, file_path ORDER BY poll_ts ROWS UNBOUNDED PRECEDING) AS run FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY config_id, file_path, run ORDER BY poll_ts) - 1 AS u FROM g),
s AS (SELECT config_id, file_path, min(poll_ts) AS first_at, min(poll_ts) FILTER (u >= 2) AS stable_at FROM n GROUP BY 1, 2)
SELECT config_id, file_path, stable_at FROM s WHERE epoch_us(stable_at) - epoch_us(first_at) <= 1209600 * 1000000::BIGINT""")
def watch_stable_files(spark, d):
    p = table(spark, d, "events").select(F.col("user_id").alias("config_id"), F.col("event_type").alias("file_path"), F.col("ts").alias("poll_ts"), F.floor(F.col("value") / 50).alias("size"), F.lit(0).alias("mtime"))
    return watch_ops.stable_files(p, 2, pending_seconds=14 * 86400)


_GAP = """w AS (SELECT *, coalesce((epoch_us(detected_at) - lag(epoch_us(detected_at)) OVER (PARTITION BY watcher_config_id ORDER BY detected_at, id) > 1800 * 1000000)::INT, 0) AS fresh FROM watcher_events WHERE detected_at IS NOT NULL),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY watcher_config_id ORDER BY detected_at, id ROWS UNBOUNDED PRECEDING)::BIGINT + 1 AS batch FROM w)"""


@query("watch_batches", f"WITH {_GAP} SELECT watcher_config_id, batch, min(detected_at) AS start_at, max(detected_at) AS end_at, count(*) AS files FROM b GROUP BY 1, 2")
def watch_batches(spark, d):
    b = watch_ops.gap_batches(table(spark, d, "watcher_events").where("detected_at IS NOT NULL"), ["watcher_config_id"], "detected_at", 1800)
    return watch_ops.batch_summary(b, ["watcher_config_id"], "detected_at")


@query("watch_unprocessed", f"""WITH e AS (SELECT {sql_key('file_path')} AS k, lower(trim(status)) AS s FROM watcher_events)
SELECT path AS file_path FROM media_files WHERE path IS NOT NULL AND path NOT IN (SELECT k FROM e WHERE k IS NOT NULL AND s IN ('completed', 'ignored', 'failed'))""")
def watch_unprocessed(spark, d):
    return watch_ops.unprocessed(table(spark, d, "media_files").select(F.col("path").alias("file_path")), table(spark, d, "watcher_events"))


@query("watch_status_counts", "SELECT lower(trim(status)) AS status, count(*) AS n, count(triggered_job_id) AS batched FROM watcher_events GROUP BY 1")
def watch_status_counts(spark, d):
    return table(spark, d, "watcher_events").groupBy(F.lower(F.trim("status")).alias("status")).agg(F.count("*").alias("n"), F.count("triggered_job_id").alias("batched"))


@query("watch_stream", f"""WITH f AS (SELECT user_id AS config_id, event_type AS file_path, ts AS poll_ts, floor(value / 50)::BIGINT AS size FROM events),
c AS (SELECT *, coalesce(size IS DISTINCT FROM lag(size) OVER w OR row_number() OVER w = 1, true)::INT AS fresh FROM f WINDOW w AS (PARTITION BY config_id, file_path ORDER BY poll_ts)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY config_id, file_path ORDER BY poll_ts ROWS UNBOUNDED PRECEDING) AS run FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY config_id, file_path, run ORDER BY poll_ts) - 1 AS u FROM g)
SELECT config_id, file_path, stable_at FROM (SELECT config_id, file_path, min(poll_ts) AS first_at, min(poll_ts) FILTER (u >= 2) AS stable_at FROM n GROUP BY 1, 2)
WHERE epoch_us(stable_at) - epoch_us(first_at) <= 1209600 * 1000000::BIGINT""")
def watch_stream(spark, d):
    """The debounce as a stream over polls, run to its end and read back from its sink."""
    from heronry.session import Scratch
    from heronry.streaming.watch import debounce, observations

    scratch = Scratch(spark, "watch")
    polls = table(spark, d, "events").select(F.col("user_id").cast("long").alias("config_id"), F.col("event_type").alias("file_path"), F.col("ts").cast("timestamp").alias("poll_ts"),
                                             F.floor(F.col("value") / 50).alias("size"), F.lit(0).cast("long").alias("mtime"))
    source = scratch.path("polls")
    polls.write.parquet(source)
    sink, log = scratch.path("stable"), scratch.path("log")
    stable = debounce(observations(spark, source), 2, pending_seconds=14 * 86400, timeout=False)
    stable.writeStream.format("parquet").option("path", sink).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("config_id long, file_path string, stable_at timestamp").parquet(sink).withColumn("stable_at", F.col("stable_at").cast("timestamp_ntz"))
