"""Organising, naming and compression plans, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronry.functions.constants import IMAGE_EXTENSIONS, VIDEO_EXTENSIONS
from heronry.functions.naming import base_of_copy, copy_suffix, file_type, folder_key, human_size, ignored, inside, mime_type, remote_path, trash_name
from heronry.functions.paths import basename, extension, stem
from heronry.functions.paths import path_key
from heronry.operators import media as media_ops
from heronry.operators import organise as ops
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


# Fixed values, as the operators have them, without case.
_PATTERNS = [r"\s*\((\d+)\)$", r"\s*\(copy\)$", r"\s*-\s*copy(\d*)$", r"\s+copy(\d*)$", r"[-_]copy(\d*)$", r"[-_](\d+)$", r"\s+(\d+)$"]
_BASE = "CASE " + " ".join(f"WHEN regexp_matches(stem, '{p}', 'i') THEN regexp_replace(stem, '{p}', '', 'i')" for p in _PATTERNS) + " ELSE stem END"
_COPIED = "(" + " OR ".join(f"regexp_matches(stem, '{p}', 'i')" for p in _PATTERNS) + ")"
_LIST = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_KIND = lambda e: f"CASE WHEN {e} IN {_LIST(IMAGE_EXTENSIONS)} THEN 'image' WHEN {e} IN {_LIST(VIDEO_EXTENSIONS)} THEN 'video' ELSE 'other' END"
_NAMES = f"""f AS (SELECT path, created_at, regexp_extract(path, '([^/]*)$', 1) AS name FROM media_files),
s AS (SELECT *, regexp_extract(name, '.(\\.[^.]*)$', 1) AS ext, left(name, len(name) - len(regexp_extract(name, '.(\\.[^.]*)$', 1))) AS stem FROM f),
b AS (SELECT *, lower({_BASE} || ext) AS base, {_COPIED} AS copied FROM s),
d AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY copied, stem, path)::INT AS rank FROM b)"""
_MONTH = "['January','February','March','April','May','June','July','August','September','October','November','December']"


@query("name_duplicates", f"WITH {_NAMES} SELECT path, base, rank, rank > 1 AS is_duplicate FROM d")
def name_duplicates(spark, d):
    return ops.name_duplicates(table(spark, d, "media_files"))


@query("name_parts", f"WITH {_NAMES} SELECT path, stem, {_BASE} AS base, lower(ext) AS ext FROM s")
def name_parts(spark, d):
    s = stem(basename(F.col("path")))
    return table(spark, d, "media_files").select("path", s.alias("stem"), base_of_copy(s).alias("base"), extension(basename(F.col("path"))).alias("ext"))


@query("name_suffix_kinds", "WITH " + _NAMES + ", k AS (SELECT CASE " + " ".join(f"WHEN regexp_matches(stem, '{p}', 'i') THEN {i + 1}" for i, p in enumerate(_PATTERNS)) + " ELSE 0 END AS kind FROM s) SELECT kind::INT AS kind, count(*) AS n FROM k GROUP BY 1")
def name_suffix_kinds(spark, d):
    return table(spark, d, "media_files").select(copy_suffix(stem(basename(F.col("path")))).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


_SKIPS = f"(SELECT DISTINCT p AS path FROM (SELECT {sql_key('p')} AS p, {sql_key('best_path')} AS b FROM (SELECT unnest(paths) AS p, best_path FROM duplicate_groups WHERE best_path IS NOT NULL)) WHERE p <> b)"
_PLAN = f"""WITH {_NAMES},
p AS (SELECT d.*, strftime(created_at, '%Y') || '/' || {_MONTH}[month(created_at)] AS folder, {_KIND('lower(ext)')} AS kind, k.path IS NOT NULL AS perceptual FROM d LEFT JOIN {_SKIPS} k ON k.path = d.path),
e AS (SELECT *, CASE WHEN rank > 1 THEN 'name_duplicate' WHEN perceptual THEN 'perceptual_duplicate' WHEN kind = 'other' THEN 'not_media' WHEN folder IS NULL THEN 'no_date' END AS early FROM p),
o AS (SELECT *, coalesce(early, CASE WHEN row_number() OVER (PARTITION BY folder, name, early IS NULL ORDER BY path) > 1 THEN 'duplicate_filename' ELSE 'success' END) AS reason FROM e)
"""


def _plan(spark, d):
    g = table(spark, d, "duplicate_groups").where("best_path IS NOT NULL").select(F.explode("paths").alias("path"), path_key("best_path").alias("best"))
    files = table(spark, d, "media_files").select(path_key("path").alias("path"), "created_at")
    return ops.organise_plan(files, g.select(path_key("path").alias("path"), "best").where("path <> best").select("path"))


@query("organise_plan_reasons", _PLAN + """SELECT path, CASE WHEN reason = 'success' THEN 'success' ELSE 'skipped' END AS status, reason,
CASE WHEN reason NOT IN ('name_duplicate', 'perceptual_duplicate') THEN kind END AS file_type, CASE WHEN reason IN ('success', 'duplicate_filename') THEN folder END AS folder_key,
CASE WHEN reason = 'success' THEN '/organised/' || folder || '/' || name END AS dst FROM o""")
def organise_plan_reasons(spark, d):
    return _plan(spark, d)


@query("organise_folders", _PLAN + "SELECT folder AS folder_key, count(*) FILTER (kind = 'image') AS images, count(*) FILTER (kind = 'video') AS videos FROM o WHERE reason = 'success' GROUP BY 1 ORDER BY 1")
def organise_folders(spark, d):
    return ops.organise_statistics(_plan(spark, d)).orderBy("folder_key")


@query("organise_reason_counts", _PLAN + "SELECT reason, count(*) AS n FROM o GROUP BY 1")
def organise_reason_counts(spark, d):
    return _plan(spark, d).groupBy("reason").agg(F.count("*").alias("n"))


@query("folder_keys", f"SELECT strftime(o_orderdate, '%Y') || '/' || {_MONTH}[month(o_orderdate)] AS folder_key, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1")
def folder_keys(spark, d):
    return table(spark, d, "orders").groupBy(folder_key(F.col("o_orderdate")).alias("folder_key")).agg(F.count("*").alias("n")).orderBy("folder_key")


_TAGGED = """t AS (SELECT DISTINCT f.path, f.created_at, c.key, c.label, c.priority, regexp_extract(f.path, '([^/]*)$', 1) AS name FROM media_tags m JOIN media_files f ON f.id = m.file_id
JOIN categories c ON c.id = m.category_id WHERE m.confidence >= 0.5 AND f.created_at IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY priority, key) AS rnk FROM t),
w AS (SELECT *, '/sorted/' || strftime(created_at, '%Y') || '/' || strftime(created_at, '%m') || '/' || label AS folder FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY path) - 1 AS k, regexp_extract(name, '.(\\.[^.]*)$', 1) AS ext FROM w)"""


def _tagged(spark, d):
    f = table(spark, d, "media_files").where("created_at IS NOT NULL").select(F.col("id").alias("file_id"), "path", "created_at")
    c = table(spark, d, "categories").select(F.col("id").alias("category_id"), "key", "label", "priority")
    return table(spark, d, "media_tags").where("confidence >= 0.5").select("file_id", "category_id").distinct().join(f, "file_id").join(c, "category_id")


@query("apply_classification", f"""WITH {_TAGGED},
own AS (SELECT DISTINCT folder, name FROM w WHERE rnk = 1), f AS (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY path) - 1 AS j FROM w WHERE rnk = 1),
x AS (SELECT f.*, regexp_extract(name, '.(\\.[^.]*)$', 1) AS ext, left(name, len(name) - len(regexp_extract(name, '.(\\.[^.]*)$', 1))) AS stem FROM f),
y AS (SELECT x.path, i, row_number() OVER (PARTITION BY x.path ORDER BY i) AS nth, x.j FROM x, range(1, 2000) t(i) WHERE x.j > 0 AND NOT EXISTS (SELECT 1 FROM own o WHERE o.folder = x.folder AND o.name = x.stem || '_' || i || x.ext)),
z AS (SELECT x.path, x.folder, CASE WHEN x.j = 0 THEN x.name ELSE x.stem || '_' || y.i || x.ext END AS fname FROM x LEFT JOIN y ON y.path = x.path AND y.nth = x.j),
b AS (SELECT w.folder || '/' || z.fname AS place, z.folder || '/' || z.fname AS spot, w.path FROM w JOIN z ON z.path = w.path WHERE w.rnk > 1)
SELECT 1 AS step, 'copy' AS action, path AS src, folder || '/' || fname AS dst FROM z
UNION ALL SELECT 2, 'symlink', arg_min(spot, path), place FROM b WHERE place NOT IN (SELECT folder || '/' || fname FROM z) GROUP BY place""")
def apply_classification(spark, d):
    return ops.category_plan(_tagged(spark, d), "yyyy_mm_category")


@query("path_schemes", f"""WITH {_TAGGED} SELECT path, strftime(created_at, '%Y/%m/') || label AS by_date, label || strftime(created_at, '/%Y/%m') AS by_category, label AS flat FROM r WHERE rnk = 1""")
def path_schemes(spark, d):
    from heronry.functions.naming import category_folder
    from heronry.operators.classify import primary_and_links

    first = primary_and_links(_tagged(spark, d)).where("rank = 1")
    return first.select("path", *[category_folder(s, F.col("created_at"), F.col("label")).alias(n) for s, n in
                                  (("yyyy_mm_category", "by_date"), ("category_yyyy_mm", "by_category"), ("flat_tags", "flat"))])


@query("collision_suffix", """WITH n AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS k FROM part)
SELECT p_partkey, CASE WHEN k = 0 THEN p_name || '_3.jpg' ELSE p_name || '_3_' || (CASE WHEN k < 2 THEN k ELSE k + 1 END) || '.jpg' END AS free_name FROM n""")
def collision_suffix(spark, d):
    """Parts as files of one name each; the second number of every name is in use already."""
    p = table(spark, d, "part").select("p_partkey", F.lit("/t").alias("folder"), F.concat("p_name", F.lit("_3.jpg")).alias("name"))
    taken = table(spark, d, "part").select(F.lit("/t").alias("folder"), F.concat("p_name", F.lit("_3_2.jpg")).alias("name")).distinct()
    return ops.with_free_names(p, "folder", "name", "p_partkey", taken).select("p_partkey", "free_name")


@query("file_types", f"SELECT {_KIND('lower(extension)')} AS file_type, count(*) AS n, sum(greatest(size_bytes, 0))::BIGINT AS bytes FROM media_files GROUP BY 1")
def file_types(spark, d):
    return table(spark, d, "media_files").groupBy(file_type(F.col("extension")).alias("file_type")).agg(
        F.count("*").alias("n"), F.sum(F.greatest("size_bytes", F.lit(0))).alias("bytes"))


@query("extension_recount", "SELECT count(*) FILTER (regexp_extract(path, '.(\\.[^./]+)$', 1) IN ('.jpg', '.jpeg', '.png', '.heic', '.bmp', '.tiff', '.gif')) AS strict, count(*) FILTER (lower(regexp_extract(path, '.(\\.[^./]+)$', 1)) IN " + _LIST(IMAGE_EXTENSIONS) + ") AS any_case FROM media_files")
def extension_recount(spark, d):
    e = F.regexp_extract("path", r".(\.[^./]+)$", 1)
    return table(spark, d, "media_files").agg(F.count_if(e.isin(IMAGE_EXTENSIONS[:-1])).alias("strict"), F.count_if(F.lower(e).isin(IMAGE_EXTENSIONS)).alias("any_case"))


_HUMAN = "CASE WHEN n < 1024 THEN printf('%.2f B', n::DOUBLE) WHEN n < 1048576 THEN printf('%.2f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.2f MB', n / 1048576.0) WHEN n < 1099511627776 THEN printf('%.2f GB', n / 1073741824.0) ELSE printf('%.2f TB', n / 1099511627776.0) END"


@query("human_sizes", f"WITH s AS (SELECT extension, sum(size_bytes)::BIGINT AS n FROM media_files WHERE size_bytes > 0 GROUP BY 1) SELECT extension, {_HUMAN} AS size FROM s")
def human_sizes(spark, d):
    s = table(spark, d, "media_files").where("size_bytes > 0").groupBy("extension").agg(F.sum("size_bytes").alias("n"))
    return s.select("extension", human_size(F.col("n")).alias("size"))


@query("mime_types", "SELECT CASE lower(extension) WHEN '.jpg' THEN 'image/jpeg' WHEN '.jpeg' THEN 'image/jpeg' WHEN '.png' THEN 'image/png' WHEN '.gif' THEN 'image/gif' WHEN '.bmp' THEN 'image/bmp' WHEN '.webp' THEN 'image/webp' WHEN '.raf' THEN 'image/x-fuji-raf' WHEN '.wmv' THEN 'video/x-ms-wmv' WHEN '.flv' THEN 'video/x-flv' WHEN '.tiff' THEN 'image/tiff' WHEN '.heic' THEN 'image/heic' WHEN '.mp4' THEN 'video/mp4' WHEN '.mov' THEN 'video/quicktime' WHEN '.avi' THEN 'video/x-msvideo' WHEN '.mkv' THEN 'video/x-matroska' WHEN '.webm' THEN 'video/webm' ELSE 'application/octet-stream' END AS mime, count(*) AS n FROM media_files GROUP BY 1")
def mime_types(spark, d):
    return table(spark, d, "media_files").groupBy(mime_type(F.col("extension")).alias("mime")).agg(F.count("*").alias("n"))


@query("remote_paths", "SELECT path, CASE WHEN starts_with(path, '/vault/photos/') THEN substr(path, 15) ELSE regexp_extract(path, '([^/]*)$', 1) END AS mirror, regexp_extract(path, '([^/]*)$', 1) AS flat, 'backup/2024/' || regexp_extract(path, '([^/]*)$', 1) AS below FROM media_files")
def remote_paths(spark, d):
    p = F.col("path")
    return table(spark, d, "media_files").select("path", remote_path(p, "/vault/photos").alias("mirror"), remote_path(p, "", flat=True).alias("flat"), remote_path(p, "", flat=True, prefix="/backup/2024/").alias("below"))


@query("trash_names", "SELECT path, '20250101_120000_' || replace(ltrim(path, '/'), '/', '__') AS trash FROM media_files WHERE path = '/vault' OR starts_with(path, '/vault/')")
def trash_names(spark, d):
    f = table(spark, d, "media_files").where(inside(F.col("path"), "/vault"))
    return f.select("path", trash_name(F.col("path"), F.lit("20250101_120000")).alias("trash"))


@query("watch_ignore", f"""SELECT id, p AS path FROM (SELECT id, p, regexp_extract(p, '([^/]*)$', 1) AS n FROM (SELECT id, {sql_key('file_path')} AS p FROM watcher_events)) WHERE p IS NOT NULL
AND NOT (starts_with(n, '.') OR n IN ('.DS_Store', 'Thumbs.db') OR regexp_matches(n, '(\\.tmp|\\.part|\\.crdownload)$') OR regexp_matches(n, '^thumb_.*$') OR regexp_matches(n, '^.*[_-]edit\\..*$') OR regexp_matches(n, '^P[0-4].*\\.jp.g$'))""")
def watch_ignore(spark, d):
    """Every event whose file a watcher does not pass over, by the plain spelling of its path."""
    e = table(spark, d, "watcher_events").select("id", path_key("file_path").alias("path")).where("path IS NOT NULL")
    return e.where(~ignored(basename(F.col("path")), ["thumb_*", "*[_-]edit.*", "P[0-4]*.jp?g"]))


@query("organise_by_capture_date", """WITH m AS (SELECT id, created_at, CASE WHEN id % 3 = 0 THEN strftime(created_at - INTERVAL 400 DAY, '%Y:%m:%d %H:%M:%S') WHEN id % 3 = 1 THEN 'broken' END AS exif,
CASE WHEN id % 5 = 0 THEN created_at - INTERVAL 40 DAY END AS video FROM media_files)
SELECT id, coalesce(CASE WHEN id % 3 = 0 THEN date_trunc('second', created_at - INTERVAL 400 DAY) END, video, created_at) AS taken_at FROM m""")
def organise_by_capture_date(spark, d):
    """Capture dates from made-up EXIF texts and video tags, else the file's own date."""
    c = F.col("created_at").cast("timestamp_ntz")
    exif = F.when(F.col("id") % 3 == 0, F.date_format(c - F.expr("INTERVAL 400 DAYS"), "yyyy:MM:dd HH:mm:ss")).when(F.col("id") % 3 == 1, "broken")
    video = F.when(F.col("id") % 5 == 0, c - F.expr("INTERVAL 40 DAYS"))
    return table(spark, d, "media_files").select("id", ops.capture_time(exif, video, c).alias("taken_at"))


_COMPRESS = "(SELECT lower(extension) AS ext, size_bytes AS size_before, CASE WHEN id % 10 = 0 THEN NULL ELSE size_bytes * (id % 5 + 3) // 8 END AS size_after FROM media_files WHERE size_bytes > 0)"


@query("compress_stats", f"""SELECT ext, count(*) AS files, count(*) FILTER (size_after IS NULL) AS failed, sum(size_before)::BIGINT AS before, sum(coalesce(size_after, size_before))::BIGINT AS after,
(sum(size_before) - sum(coalesce(size_after, size_before)))::BIGINT AS saved, round((sum(size_before) - sum(coalesce(size_after, size_before))) * 100.0::DOUBLE / sum(size_before), 2) AS percent FROM {_COMPRESS} GROUP BY ext""")
def compress_stats(spark, d):
    f = table(spark, d, "media_files").where("size_bytes > 0").select(F.lower("extension").alias("ext"), F.col("size_bytes").alias("size_before"),
        F.expr("CASE WHEN id % 10 <> 0 THEN (size_bytes * (id % 5 + 3)) DIV 8 END").alias("size_after"))
    return media_ops.compression_statistics(f, ["ext"])


@query("compress_settings", "SELECT p_size, CASE p_size WHEN 1 THEN 95 WHEN 3 THEN 75 ELSE 85 END::INT AS quality, CASE p_size WHEN 1 THEN 18 WHEN 3 THEN 28 ELSE 23 END::INT AS crf FROM (SELECT DISTINCT p_size FROM part)")
def compress_settings(spark, d):
    s = media_ops.settings(F.col("p_size"))
    return table(spark, d, "part").select("p_size").distinct().select("p_size", s["quality"].alias("quality"), s["crf"].alias("crf"))
