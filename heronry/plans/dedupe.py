"""Near-duplicate groups of scanned pictures, reports and plans, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronry.functions.hashes import hamming, hash_hex
from heronry.operators import dedupe as ops
from heronry.operators.hamming import hamming_pairs
from heronry.session import Scratch
from heronry.functions.paths import path_key
from heronry.plans.sql import path_key as sql_key
from heronry.sources.tables import table

QUERIES, SQL = {}, {}
THRESHOLD = 5


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f
    return keep


_FP = f"""
WITH RECURSIVE s AS (SELECT {sql_key('path')} AS path, resolution, scanned_at, info_id, regexp_extract(lower(trim(hash)), '^(?:0x)?([0-9a-f]{{1,16}})$', 1) AS x FROM image_info),
hs AS (SELECT path, lpad(x, 16, '0') AS hash, ('0x' || x)::UBIGINT AS h FROM s WHERE x <> '' AND ltrim(x, '0') <> ''
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY scanned_at DESC NULLS LAST, info_id DESC) = 1),
rs AS (SELECT path, resolution FROM s WHERE resolution > 0 QUALIFY row_number() OVER (PARTITION BY path ORDER BY scanned_at DESC NULLS LAST, info_id DESC) = 1),
fp AS (SELECT p.path, hs.h, hs.hash, rs.resolution FROM (SELECT DISTINCT path FROM s WHERE path IS NOT NULL) p LEFT JOIN hs USING (path) LEFT JOIN rs USING (path))"""


def _groups_sql(threshold: int) -> str:
    return _FP + f""",
u AS (SELECT DISTINCT h FROM fp WHERE h IS NOT NULL),
e AS (SELECT a.h AS a, b.h AS b FROM u a JOIN u b ON bit_count(xor(a.h, b.h)) <= {threshold}),
r AS (SELECT h AS v, h AS w FROM u UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.w),
c AS (SELECT v, min(w) AS c FROM r GROUP BY v),
m AS (SELECT c.c, fp.path, fp.hash, fp.resolution FROM fp JOIN c ON c.v = fp.h),
g AS (SELECT min(path) OVER (PARTITION BY c) AS group_id, path, hash, resolution,
  row_number() OVER (PARTITION BY c ORDER BY coalesce(resolution, -1) DESC, path) = 1 AS is_best, count(*) OVER (PARTITION BY c) AS group_size FROM m)
"""


_GROUPS = _groups_sql(THRESHOLD)


def _prints(spark, d):
    return ops.fingerprints(table(spark, d, "image_info"))


def _groups(spark, d, threshold: int = THRESHOLD):
    scratch = Scratch(spark, "dup")
    return scratch.save(ops.duplicate_groups(_prints(spark, d), threshold, scratch), "groups")


def _chosen(spark, d, share: str):
    return ops.same_files(table(spark, d, "image_info").where(share))


@query("dup_fingerprints", _FP + "SELECT path, hash, resolution FROM fp")
def dup_fingerprints(spark, d):
    return _prints(spark, d).select("path", hash_hex(F.col("h")).alias("hash"), "resolution")


@query("dup_exact_groups", _FP + "SELECT hash, list(path ORDER BY path) AS paths, count(*) AS n FROM fp WHERE hash IS NOT NULL GROUP BY hash HAVING count(*) > 1")
def dup_exact_groups(spark, d):
    p = _prints(spark, d).where("h IS NOT NULL")
    return p.groupBy(hash_hex(F.col("h")).alias("hash")).agg(F.array_sort(F.collect_list("path")).alias("paths"), F.count("*").alias("n")).where("n > 1")


@query("dup_hamming_pairs", _FP + f""", u AS (SELECT DISTINCT hash, h FROM fp WHERE h IS NOT NULL)
SELECT a.hash AS hash_a, b.hash AS hash_b, bit_count(xor(a.h, b.h))::INT AS distance FROM u a JOIN u b ON a.hash < b.hash AND bit_count(xor(a.h, b.h)) <= {THRESHOLD}""")
def dup_hamming_pairs(spark, d):
    p = hamming_pairs(_prints(spark, d), THRESHOLD)
    a, b = hash_hex(F.col("a")), hash_hex(F.col("b"))
    return p.select(F.least(a, b).alias("hash_a"), F.greatest(a, b).alias("hash_b"), hamming(F.col("a"), F.col("b")).alias("distance"))


@query("dup_hamming_groups", _GROUPS + "SELECT group_id, path, hash, resolution, is_best, group_size FROM g WHERE group_size > 1")
def dup_hamming_groups(spark, d):
    return ops.hex_of(_groups(spark, d))


@query("dup_report", _GROUPS + """, k AS (SELECT * FROM g WHERE group_size > 1)
SELECT n.scanned, n.hashed, n.scanned - n.hashed AS without_hash, q.groups, q.duplicates, q.reclaimable_bytes,
round(coalesce(n.hashed * 100.0 / nullif(n.scanned, 0), 0), 1) AS success_rate, round(coalesce(q.grouped / nullif(q.groups, 0), 0), 2) AS images_per_group,
round(coalesce(q.duplicates * 100.0 / nullif(n.scanned, 0), 0), 1) AS duplicate_ratio
FROM (SELECT count(*) AS scanned, count(h) AS hashed FROM fp) n,
(SELECT count(DISTINCT group_id) AS groups, count(*) FILTER (NOT is_best) AS duplicates, coalesce(sum(f.size_bytes) FILTER (NOT is_best), 0)::BIGINT AS reclaimable_bytes, count(*) AS grouped
 FROM k LEFT JOIN media_files f USING (path)) q""")
def dup_report(spark, d):
    return ops.report(_groups(spark, d), table(spark, d, "media_files").select(path_key("path").alias("path"), "size_bytes"), _prints(spark, d))


@query("dup_top_groups", _GROUPS + """, t AS (SELECT DISTINCT group_id, group_size FROM g WHERE group_size > 1 ORDER BY group_id LIMIT 10)
SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY path)::INT AS "at", path, greatest(group_size - 4, 0) AS more FROM g JOIN t USING (group_id, group_size) WHERE NOT is_best QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY path) <= 3""")
def dup_top_groups(spark, d):
    return ops.top_groups(_groups(spark, d))


@query("dup_keep_plan", _GROUPS + """, l AS (SELECT group_id, path AS src, regexp_extract(path, '([^/]*)$', 1) AS name FROM g WHERE group_size > 1 AND NOT is_best),
n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY src) - 1 AS k, regexp_extract(name, '.(\\.[^.]*)$', 1) AS ext FROM l),
own AS (SELECT DISTINCT name FROM l), q AS (SELECT *, left(name, len(name) - len(ext)) AS stem FROM n),
y AS (SELECT q.src, q.k, i, row_number() OVER (PARTITION BY q.src ORDER BY i) AS nth FROM q, range(1, 2000) t(i) WHERE q.k > 0 AND NOT EXISTS (SELECT 1 FROM own o WHERE o.name = q.stem || '_' || i || q.ext))
SELECT 'move' AS action, q.src, '/duplicates/' || CASE WHEN q.k = 0 THEN name ELSE stem || '_' || y.i || ext END AS dst, group_id FROM q LEFT JOIN y ON y.src = q.src AND y.nth = q.k""")
def dup_keep_plan(spark, d):
    return ops.keep_plan(_groups(spark, d))


@query("dup_best_lock", _GROUPS + """, chosen AS (SELECT DISTINCT path FROM s WHERE info_id % 3 = 0 AND path IS NOT NULL), k AS (SELECT * FROM g WHERE group_size > 1),
v AS (SELECT path, CASE WHEN k.is_best IS NULL THEN 'unknown' WHEN k.is_best THEN 'locked' ELSE 'trash' END AS verdict FROM chosen LEFT JOIN k USING (path))
SELECT path, verdict, CASE WHEN verdict = 'trash' THEN '.trash/20250101_' || replace(ltrim(path, '/'), '/', '__') END AS dst FROM v""")
def dup_best_lock(spark, d):
    return ops.delete_selected(_groups(spark, d), _chosen(spark, d, "info_id % 3 = 0"), stamp=F.lit("20250101"))


@query("dup_refresh", _GROUPS + """, l AS (SELECT group_id, path, is_best, count(*) OVER (PARTITION BY group_id) AS group_size FROM g WHERE group_size > 1 AND path NOT IN (SELECT path FROM s WHERE info_id % 4 = 0 AND path IS NOT NULL))
SELECT group_id, path, is_best, group_size FROM l WHERE group_size > 1""")
def dup_refresh(spark, d):
    return ops.without(_groups(spark, d), _chosen(spark, d, "info_id % 4 = 0")).select("group_id", "path", "is_best", "group_size")


@query("dest_aware_skip", _GROUPS + """, k AS (SELECT *, path LIKE '/vault/archive/%' AS there FROM g WHERE group_size > 1), w AS (SELECT *, bool_or(there) OVER (PARTITION BY group_id) AS has FROM k)
SELECT path, group_id FROM w WHERE NOT there AND (has OR NOT is_best)""")
def dest_aware_skip(spark, d):
    return ops.destination_skips(_groups(spark, d), F.startswith("path", F.lit("/vault/archive/")))


@query("dup_listed_best_first", f"""WITH m AS (SELECT DISTINCT group_id, {sql_key('best_path')} AS b, {sql_key('p')} AS p FROM (SELECT group_id, best_path, unnest(paths) AS p FROM duplicate_groups WHERE best_path IS NOT NULL))
SELECT group_id, list(p ORDER BY p IS DISTINCT FROM b, lower(p), p) AS paths FROM m WHERE p IS NOT NULL GROUP BY group_id""")
def dup_listed_best_first(spark, d):
    """Members of stored groups, the best first, then by name."""
    m = table(spark, d, "duplicate_groups").where("best_path IS NOT NULL").select("group_id", path_key("best_path").alias("b"), F.explode("paths").alias("p"))
    m = m.select("group_id", "b", path_key("p").alias("p")).where("p IS NOT NULL").distinct()
    s = F.struct((~F.col("p").eqNullSafe(F.col("b"))).alias("rest"), F.lower("p").alias("l"), "p")
    return m.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(s)), lambda x: x["p"]).alias("paths"))


for _t in (10, 15):  # the default threshold and the loose one
    QUERIES[f"dup_hamming_groups_{_t}"] = lambda spark, d, t=_t: ops.hex_of(_groups(spark, d, t))
    SQL[f"dup_hamming_groups_{_t}"] = _groups_sql(_t) + "SELECT group_id, path, hash, resolution, is_best, group_size FROM g WHERE group_size > 1"


@query("dup_representatives", _GROUPS + "SELECT group_id, arg_min(hash, path) AS hash FROM g WHERE group_size > 1 GROUP BY 1")
def dup_representatives(spark, d):
    """The hash that stands for each group."""
    return ops.hex_of(ops.representatives(_groups(spark, d)))


@query("dup_source_and_destination", _FP + f""", b AS (SELECT path, h, resolution, path LIKE '/vault/archive/%' AS is_dest FROM fp), l AS (SELECT DISTINCT {sql_key('p')} AS path FROM (SELECT unnest(paths) AS p FROM duplicate_groups)),
t AS (SELECT path, h, resolution, false AS is_dest FROM fp UNION ALL SELECT path, h, resolution, true FROM fp WHERE path IN (SELECT path FROM l WHERE path IS NOT NULL))
SELECT path, bool_or(is_dest) AS is_dest, any_value(resolution) AS resolution FROM t GROUP BY path""")
def dup_source_and_destination(spark, d):
    """All scanned files as a source and those that stored groups list as a destination, in one table."""
    p = _prints(spark, d)
    listed = ops.same_files(table(spark, d, "duplicate_groups").select(F.explode("paths").alias("path")))
    return ops.tagged_union(p, p.join(listed, "path", "left_semi")).select("path", "is_dest", "resolution")


@query("vector_sign_groups", """
WITH RECURSIVE b AS (SELECT vec_id, label, list_sort(embedding)[33] AS cut, embedding FROM embeddings),
x AS (SELECT vec_id, label, list_aggregate([CASE WHEN embedding[i::INT] > cut THEN '1' ELSE '0' END FOR i IN range(1, 65)], 'string_agg', '') AS bits FROM b),
e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM x p JOIN x q ON p.vec_id <> q.vec_id AND hamming(p.bits, q.bits) <= 16),
r AS (SELECT vec_id AS v, vec_id AS w FROM x UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.w)
SELECT v AS vec_id, min(w) AS group_id FROM r GROUP BY v HAVING count(*) > 1""")
def vector_sign_groups(spark, d):
    """Vectors of 64 numbers by the hash of which numbers exceed the median, at distance 16 or less."""
    from heronry.operators.components import connected_components

    e = table(spark, d, "embeddings").withColumn("cut", F.element_at(F.array_sort("embedding"), 33))
    bits = F.aggregate(F.transform("embedding", lambda x, i: F.when(x > F.col("cut"), F.expr("1L")).otherwise(F.expr("0L"))), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1) + x)
    scratch = Scratch(spark, "signs")
    h = scratch.save(e.select("vec_id", bits.alias("h")), "hashes")
    pairs = hamming_pairs(h, 16, scratch=scratch)
    head = h.groupBy("h").agg(F.min("vec_id").alias("v"))
    same = h.join(head, "h").where("v <> vec_id").select(F.col("vec_id").alias("a"), F.col("v").alias("b"))
    near = pairs.join(head.toDF("a", "x"), "a").join(head.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return connected_components(same.union(near), scratch).select(F.col("vertex").alias("vec_id"), F.col("component").alias("group_id"))
