"""Catalogue reads, changes and sums over the media tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronry.functions.constants import SUPPRESSING_STATUSES, TAXONOMY
from heronry.operators import catalog as ops
from heronry.operators.faces import delete_people, merge_people
from heronry.functions.paths import path_key
from heronry.plans.sql import path_key as sql_key
from heronry.sources.tables import table

RUN = "run-full-library"
QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f
    return keep


def _queue(spark, d):
    """Reviews made of tags: those of middling confidence, some resolved."""
    t = table(spark, d, "media_tags")
    return t.where("confidence < 0.6").select(
        "id", "file_id", F.when(F.col("category_id") % 3 == 0, "scene").when(F.col("category_id") % 3 == 1, "face").otherwise("document").alias("review_type"),
        F.col("category_id").alias("suggested_category_id"), "confidence", (F.col("id") % 5 == 0).alias("resolved"), "run_id", "created_at")


_QUEUE = """(SELECT id, file_id, CASE category_id % 3 WHEN 0 THEN 'scene' WHEN 1 THEN 'face' ELSE 'document' END AS review_type,
category_id AS suggested_category_id, confidence, id % 5 = 0 AS resolved, run_id, created_at FROM media_tags WHERE confidence < 0.6)"""


@query("tags_for_file", """SELECT t.id, t.file_id, c.key, c.label, c.priority, t.confidence FROM media_tags t JOIN categories c ON c.id = t.category_id""")
def tags_for_file(spark, d):
    return ops.tags_with_categories(table(spark, d, "media_tags"), table(spark, d, "categories")).select("id", "file_id", "key", "label", "priority", "confidence")


@query("tags_for_run", f"""SELECT t.id, f.path, f.filename, c.key, c.priority FROM media_tags t JOIN media_files f ON f.id = t.file_id
JOIN categories c ON c.id = t.category_id WHERE t.run_id = '{RUN}' ORDER BY c.priority, f.filename""")
def tags_for_run(spark, d):
    return ops.tags_of_run(table(spark, d, "media_tags"), table(spark, d, "media_files"), table(spark, d, "categories"), RUN).select(
        "id", "path", "filename", "key", "priority").orderBy("priority", "filename")


@query("review_queue_left", f"""SELECT q.id, f.path, q.review_type, c.key AS suggested_key, q.confidence FROM {_QUEUE} q JOIN media_files f ON f.id = q.file_id
LEFT JOIN (SELECT * FROM categories WHERE default_enabled) c ON c.id = q.suggested_category_id WHERE NOT q.resolved""")
def review_queue_left(spark, d):
    enabled = table(spark, d, "categories").where("default_enabled")
    return ops.review_list(_queue(spark, d), table(spark, d, "media_files"), enabled).select("id", "path", "review_type", "suggested_key", "confidence")


@query("review_queue_of_type", f"SELECT q.id, f.filename, q.confidence FROM {_QUEUE} q JOIN media_files f ON f.id = q.file_id WHERE NOT q.resolved AND q.review_type = 'face'")
def review_queue_of_type(spark, d):
    return ops.review_list(_queue(spark, d), table(spark, d, "media_files"), table(spark, d, "categories"), "face").select("id", "filename", "confidence")


@query("review_resolve", f"""
WITH q AS {_QUEUE}, d AS (SELECT id, (id % 45 + 1)::INT AS chosen FROM q WHERE id % 7 = 0 AND (id % 45 + 1) IN (SELECT id FROM categories)),
done AS (SELECT q.file_id, d.chosen AS category_id, q.run_id FROM q JOIN d USING (id) WHERE NOT q.resolved)
SELECT DISTINCT file_id, category_id, 'manual' AS source, run_id FROM done WHERE run_id IS NOT NULL AND file_id IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM media_tags t WHERE t.file_id = done.file_id AND t.category_id = done.category_id AND t.run_id = done.run_id)
UNION ALL SELECT file_id, category_id, 'manual', run_id FROM done WHERE run_id IS NULL OR file_id IS NULL""")
def review_resolve(spark, d):
    from heronry.operators.classify import resolve_review

    q = _queue(spark, d).withColumn("resolved_category_id", F.lit(None).cast("int"))
    decisions = q.where("id % 7 = 0").select("id", (F.col("id") % 45 + 1).cast("int").alias("category_id"))
    tags, _ = resolve_review(table(spark, d, "media_tags").withColumn("source", F.lit("other")), q, decisions, table(spark, d, "categories"))
    return tags.where("source = 'manual'").select("file_id", "category_id", "source", "run_id")


@query("faces_unidentified", """SELECT e.id, f.path, e.bbox.w AS w, e.bbox.h AS h, e.created_at FROM face_embeddings e JOIN media_files f ON f.id = e.file_id
WHERE e.person_id IS NULL ORDER BY e.created_at DESC, e.id""")
def faces_unidentified(spark, d):
    f = table(spark, d, "media_files").select(F.col("id").alias("file_id"), "path")
    return (table(spark, d, "face_embeddings").where("person_id IS NULL").join(f, "file_id")
            .select("id", "path", F.col("bbox.w").alias("w"), F.col("bbox.h").alias("h"), "created_at").orderBy(F.col("created_at").desc(), "id"))


@query("faces_known", """SELECT e.id, e.person_id, p.name, len(e.embedding)::INT AS dims FROM face_embeddings e JOIN people p ON p.id = e.person_id WHERE e.embedding IS NOT NULL""")
def faces_known(spark, d):
    p = table(spark, d, "people").select(F.col("id").alias("person_id"), "name")
    return table(spark, d, "face_embeddings").where("embedding IS NOT NULL").join(p, "person_id").select("id", "person_id", "name", F.size("embedding").alias("dims"))


_CONFIGS = [(1, "Camera roll"), (2, "Scans"), (4, "Phone")]


@query("events_page", """SELECT e.id, e.file_path, e.status, c.label FROM watcher_events e
LEFT JOIN (VALUES (1, 'Camera roll'), (2, 'Scans'), (4, 'Phone')) c(k, label) ON c.k = e.watcher_config_id ORDER BY e.detected_at DESC NULLS LAST, e.id DESC LIMIT 50 OFFSET 100""")
def events_page(spark, d):
    c = spark.createDataFrame(_CONFIGS, "watcher_config_id long, label string")
    e = table(spark, d, "watcher_events").join(c, "watcher_config_id", "left")
    return ops.page(e, [F.col("detected_at").desc_nulls_last(), F.col("id").desc()], 50, 100).select("id", "file_path", "status", "label")


@query("events_limit_then_filter", """SELECT id, status FROM (SELECT * FROM watcher_events ORDER BY detected_at DESC NULLS LAST, id DESC LIMIT 100) WHERE watcher_config_id <= 10""")
def events_limit_then_filter(spark, d):
    e = table(spark, d, "watcher_events")
    return ops.page(e, [F.col("detected_at").desc_nulls_last(), F.col("id").desc()], 100).where("watcher_config_id <= 10").select("id", "status")


@query("events_processed_paths", f"""SELECT DISTINCT {sql_key('file_path')} AS file_path FROM watcher_events WHERE lower(trim(status)) IN ('completed', 'ignored', 'failed') AND file_path IS NOT NULL""")
def events_processed_paths(spark, d):
    e = table(spark, d, "watcher_events").where(F.lower(F.trim("status")).isin(SUPPRESSING_STATUSES) & F.col("file_path").isNotNull())
    return e.select(path_key("file_path").alias("file_path")).distinct()


@query("run_summary", f"""SELECT c.key, c.label, count(*) AS tags, count(DISTINCT t.file_id) AS files FROM media_tags t JOIN categories c ON c.id = t.category_id
WHERE t.run_id = '{RUN}' GROUP BY c.key, c.label ORDER BY tags DESC, c.key""")
def run_summary(spark, d):
    return ops.run_summary(table(spark, d, "media_tags"), table(spark, d, "categories"), RUN).orderBy(F.col("tags").desc(), "key")


@query("run_totals", f"""SELECT (SELECT count(DISTINCT file_id) FROM media_tags WHERE run_id = '{RUN}') AS files,
(SELECT count(*) FROM {_QUEUE} q WHERE NOT resolved AND run_id = '{RUN}') AS pending""")
def run_totals(spark, d):
    files = table(spark, d, "media_tags").where(F.col("run_id") == RUN).agg(F.count_distinct("file_id").alias("files"))
    return files.crossJoin(_queue(spark, d).where(F.col("run_id") == RUN).agg(F.count_if(~F.col("resolved")).alias("pending")))  # one row each


@query("tags_per_file", """SELECT t.file_id, list(c.key ORDER BY c.priority, c.key) AS keys FROM (SELECT DISTINCT file_id, category_id FROM media_tags) t
JOIN categories c ON c.id = t.category_id GROUP BY t.file_id""")
def tags_per_file(spark, d):
    t = ops.tags_with_categories(table(spark, d, "media_tags").select("file_id", "category_id").distinct(), table(spark, d, "categories"))
    return t.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("priority", "key"))), lambda s: s["key"]).alias("keys"))


@query("categories_enabled", "SELECT id, key, label, priority FROM categories WHERE default_enabled ORDER BY priority, label")
def categories_enabled(spark, d):
    return table(spark, d, "categories").where("default_enabled").select("id", "key", "label", "priority").orderBy("priority", "label")


@query("categories_update", "SELECT id, CASE WHEN id % 4 = 0 THEN priority + 1 ELSE priority END AS priority, CASE WHEN id % 4 = 0 THEN NOT default_enabled ELSE default_enabled END AS default_enabled FROM categories")
def categories_update(spark, d):
    c = table(spark, d, "categories")
    changes = c.where("id % 4 = 0").select("id", (F.col("priority") + 1).alias("priority"), (~F.col("default_enabled")).alias("default_enabled"))
    return ops.updated(c, changes, "id").select("id", "priority", "default_enabled")


@query("tags_insert_or_ignore", f"""
WITH n AS (SELECT file_id, category_id, run_id, confidence FROM media_tags), t AS (SELECT * FROM n WHERE run_id = '{RUN}'),
f AS (SELECT file_id, category_id, run_id, CASE WHEN count(*) > count(confidence) THEN NULL ELSE min(confidence) END AS confidence FROM n WHERE run_id IS NOT NULL AND file_id IS NOT NULL AND category_id IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM t WHERE t.file_id = n.file_id AND t.category_id = n.category_id AND t.run_id = n.run_id) GROUP BY 1, 2, 3)
SELECT * FROM t UNION ALL SELECT * FROM f UNION ALL SELECT * FROM n WHERE run_id IS NULL OR file_id IS NULL OR category_id IS NULL""")
def tags_insert_or_ignore(spark, d):
    """All tags put into those of one run; every row is read."""
    t = table(spark, d, "media_tags").select("file_id", "category_id", "run_id", "confidence")
    return ops.insert_or_ignore(t.where(F.col("run_id") == RUN), t, ["file_id", "category_id", "run_id"])


@query("run_config_replace", """SELECT id, CASE WHEN id % 3 = 0 THEN upper(name) ELSE name END AS name FROM people""")
def run_config_replace(spark, d):
    p = table(spark, d, "people").select("id", "name")
    return ops.insert_or_replace(p, p.where("id % 3 = 0").select("id", F.upper("name").alias("name")), ["id"])


@query("files_get_or_create", f"""WITH e AS (SELECT DISTINCT {sql_key('file_path')} AS path FROM watcher_events)
SELECT path, true AS known FROM media_files WHERE path IS NOT NULL UNION ALL SELECT path, false FROM e WHERE path IS NOT NULL AND path NOT IN (SELECT path FROM media_files WHERE path IS NOT NULL)""")
def files_get_or_create(spark, d):
    f = table(spark, d, "media_files").where("path IS NOT NULL").select(path_key("path").alias("path"), F.lit(True).alias("known"))
    new = table(spark, d, "watcher_events").select(path_key("file_path").alias("path"), F.lit(False).alias("known")).where("path IS NOT NULL")
    return ops.insert_or_ignore(f, new, ["path"])


@query("face_point_lookup", "SELECT e.id, e.file_id, len(e.embedding)::INT AS dims FROM people p JOIN face_embeddings e ON e.id = p.cover_face_id")
def face_point_lookup(spark, d):
    """The embedding of each person's cover face: one join instead of a lookup per person."""
    want = table(spark, d, "people").select(F.col("cover_face_id").alias("id")).where("id IS NOT NULL")
    return want.join(table(spark, d, "face_embeddings"), "id").select("id", "file_id", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dims"))


@query("people_by_name", "SELECT id, name FROM people ORDER BY name, id")
def people_by_name(spark, d):
    return table(spark, d, "people").select("id", "name").orderBy("name", "id")


_MERGE = "(SELECT b.id AS merge_id, min(a.id) AS keep_id FROM people a JOIN people b ON lower(trim(a.name)) = lower(trim(b.name)) AND a.id < b.id GROUP BY b.id)"


def _merges(spark, d):
    p = table(spark, d, "people").select("id", F.lower(F.trim("name")).alias("n")).where("n IS NOT NULL")
    first = p.groupBy("n").agg(F.min("id").alias("keep_id"))
    return p.join(first, "n").where("keep_id <> id").select("keep_id", F.col("id").alias("merge_id"))


@query("people_merge", f"""SELECT coalesce(m.keep_id, e.person_id) AS person_id, count(*) AS faces FROM face_embeddings e LEFT JOIN {_MERGE} m ON m.merge_id = e.person_id GROUP BY 1""")
def people_merge(spark, d):
    """Persons of one name become one."""
    _, faces = merge_people(table(spark, d, "people"), table(spark, d, "face_embeddings").select("id", "person_id"), _merges(spark, d))
    return faces.groupBy("person_id").agg(F.count("*").alias("faces"))


@query("people_delete", """SELECT 'kept' AS mode, id, CASE WHEN person_id IN (SELECT id FROM people WHERE id % 3 = 0) THEN NULL ELSE person_id END AS person_id FROM face_embeddings
UNION ALL SELECT 'purged', id, person_id FROM face_embeddings WHERE person_id IS NULL OR person_id NOT IN (SELECT id FROM people WHERE id % 3 = 0)""")
def people_delete(spark, d):
    p, f = table(spark, d, "people"), table(spark, d, "face_embeddings").select("id", "person_id")
    out = [delete_people(p, f, p.where("id % 3 = 0").select("id"), purge)[1].select(F.lit(m).alias("mode"), "id", "person_id") for m, purge in (("kept", False), ("purged", True))]
    return out[0].union(out[1])


@query("faces_purge_counts", "SELECT 'face_embeddings' AS \"table\", count(*) AS \"rows\" FROM face_embeddings UNION ALL SELECT 'people', count(*) FROM people")
def faces_purge_counts(spark, d):
    return ops.purge_counts(face_embeddings=table(spark, d, "face_embeddings"), people=table(spark, d, "people"))


@query("chart_categories", """SELECT c.key, count(*) AS n, round(count(*) * 100.0 / max(count(*)) OVER (), 4) AS height FROM media_tags t JOIN categories c ON c.id = t.category_id GROUP BY c.key""")
def chart_categories(spark, d):
    from heronry.operators.media import chart

    return chart(ops.tags_with_categories(table(spark, d, "media_tags"), table(spark, d, "categories")).groupBy("key").agg(F.count("*").alias("n")))


@query("config_json", """SELECT event_type, sum((props->>'k')::BIGINT) AS k, count(*) AS n FROM events GROUP BY 1""")
def config_json(spark, d):
    e = table(spark, d, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("k"), F.count("*").alias("n"))


@query("customer_orders_coverage", """SELECT c_mktsegment, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def customer_orders_coverage(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").groupBy("c_mktsegment").agg(
        F.count_distinct("c_custkey").alias("customers"), F.count("o_orderkey").alias("orders"))


@query("categories_seed", "WITH have AS (SELECT max(id) AS top FROM categories), t AS (SELECT * FROM (VALUES " + ", ".join(f"({i + 1}, '{k}', '{v}', {p}, {str(e).lower()}, '{d}')" for i, (k, v, p, e, d) in enumerate(TAXONOMY)) + """) t(n, key, label, priority, default_enabled, detection))
SELECT id, key, label, priority, default_enabled, detection FROM categories UNION ALL SELECT (top + n)::INT, key, label, priority, default_enabled, detection FROM t, have WHERE key NOT IN (SELECT key FROM categories)""")
def categories_seed(spark, d):
    c = table(spark, d, "categories")
    return ops.seeded(c).select("id", "key", "label", "priority", "default_enabled", "detection")


@query("faces_assign", """WITH a AS (SELECT e.id, (SELECT min(id) FROM people) + e.id % 7 AS person_id FROM face_embeddings e WHERE person_id IS NULL)
SELECT e.id, coalesce(p.id, e.person_id) AS person_id FROM face_embeddings e LEFT JOIN a ON a.id = e.id LEFT JOIN people p ON p.id = a.person_id""")
def faces_assign(spark, d):
    """Faces of no person are given to persons, some of whom do not exist."""
    f, p = table(spark, d, "face_embeddings").select("id", "person_id"), table(spark, d, "people")
    least = p.agg(F.min("id")).first()[0] or 0
    return ops.assigned(f, f.where("person_id IS NULL").select("id", (F.lit(least) + F.col("id") % 7).alias("person_id")), p)


@query("people_create", """WITH n AS (SELECT DISTINCT upper(trim(name)) AS name FROM people WHERE name IS NOT NULL), t AS (SELECT coalesce(max(id), 0) AS top FROM people)
SELECT id, name FROM people UNION ALL SELECT top + row_number() OVER (ORDER BY name), name FROM n, t""")
def people_create(spark, d):
    p = table(spark, d, "people").select("id", "name")
    new = p.where("name IS NOT NULL").select(F.upper(F.trim("name")).alias("name")).distinct()
    return ops.appended(p, new.withColumn("at", F.col("name")))


@query("watcher_configs_changes", """WITH c AS (SELECT DISTINCT watcher_config_id AS id FROM watcher_events WHERE watcher_config_id IS NOT NULL)
SELECT id, CASE WHEN id % 2 = 0 THEN 5 ELSE 2 END AS stability_window, id % 5 <> 0 AS enabled FROM c WHERE id % 7 <> 0""")
def watcher_configs_changes(spark, d):
    """Configurations created, two settings updated, some deleted."""
    c = table(spark, d, "watcher_events").select(F.col("watcher_config_id").alias("id")).where("id IS NOT NULL").distinct()
    c = c.select("id", F.lit(2).alias("stability_window"), F.lit(True).alias("enabled"))
    c = ops.updated(c, c.where("id % 2 = 0").select("id", F.lit(5).alias("stability_window")), "id")
    c = ops.updated(c, c.where("id % 5 = 0").select("id", F.lit(False).alias("enabled")), "id")
    return ops.removed(c, c.where("id % 7 = 0"))


@query("events_advance", """WITH t AS (SELECT id, CASE id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' ELSE 'failed' END AS status, CASE WHEN id % 3 = 2 THEN 'told' END AS error FROM watcher_events WHERE id % 4 <> 0),
e AS (SELECT id, status, error_message, coalesce(list_position(['stabilized', 'enqueued', 'running', 'completed', 'failed'], lower(trim(status))), 0) AS r, coalesce(lower(trim(status)) IN ('completed', 'ignored', 'failed'), false) AS ended FROM watcher_events),
j AS (SELECT e.*, t.status AS ts, t.error, NOT ended AND coalesce(list_position(['stabilized', 'enqueued', 'running', 'completed', 'failed'], t.status), 0) > r AS go FROM e LEFT JOIN t USING (id))
SELECT id, CASE WHEN go THEN ts ELSE status END AS status, CASE WHEN go THEN error ELSE error_message END AS error_message FROM j""")
def events_advance(spark, d):
    """Statuses told for three quarters of the events; what ended stays."""
    from heronry.operators.watch import advanced

    e = table(spark, d, "watcher_events").select("id", "status", "error_message")
    k = F.col("id") % 3
    told = e.where("id % 4 <> 0").select("id", F.when(k == 0, "running").when(k == 1, "completed").otherwise("failed").alias("status"), F.when(k == 2, "told").alias("error"))
    return advanced(e, told)


@query("selection_bytes", f"""WITH s AS (SELECT DISTINCT {sql_key('p')} AS path FROM (SELECT unnest(paths) AS p FROM duplicate_groups))
SELECT count(*) AS files, coalesce(sum(greatest(coalesce(size_bytes, 0), 0)), 0)::BIGINT AS bytes FROM media_files WHERE path IN (SELECT path FROM s WHERE path IS NOT NULL)""")
def selection_bytes(spark, d):
    f = table(spark, d, "media_files").select(path_key("path").alias("path"), "size_bytes")
    return ops.selection_bytes(f, table(spark, d, "duplicate_groups").select(F.explode("paths").alias("p")).select(path_key("p").alias("path")))


@query("throttle_and_steps", """SELECT event_id, round(1.0::DOUBLE / greatest(1.0::DOUBLE, value / 512.0), 9) AS seconds, list_filter(['classify', 'organize', 'dedupe'], lambda x: (x = 'classify') OR (x = 'dedupe' AND user_id % 2 = 0)) AS steps,
list_filter(['nature', 'food', 'pets'], lambda x: x = 'food' OR (x = 'pets' AND user_id % 3 = 0)) AS keys FROM events""")
def throttle_and_steps(spark, d):
    """Pauses between uploads, the steps of a watch that are on, the keys of a stage that are on."""
    from heronry.functions import rules

    u = F.col("user_id")
    steps = F.array(*[F.struct(F.lit(n).alias("name"), on.alias("enabled")) for n, on in (("classify", F.lit(True)), ("organize", F.lit(None).cast("boolean")), ("dedupe", u % 2 == 0))])
    on = F.when(u % 3 == 0, F.array(F.lit("pets"), F.lit("food"))).otherwise(F.array(F.lit("food")))
    return table(spark, d, "events").select("event_id", F.round(rules.throttle_seconds(F.col("value")), 9).alias("seconds"),
                                            F.transform(rules.enabled_steps(steps), lambda s: s["name"]).alias("steps"), rules.stage_keys(on, ["nature", "food", "pets"]).alias("keys"))
