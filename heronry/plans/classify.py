"""Rule scores, tag resolution, scenes and faces, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from heronry.functions import rules
from heronry.functions.constants import EVENT_KEYWORDS, SCENE_CLASSES, SCREEN_SIZES, SCREENSHOT_SOFTWARE, TRAVEL_KEYWORDS
from heronry.operators import classify as ops
from heronry.operators import faces as face_ops
from heronry.session import Scratch
from heronry.sources.tables import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f
    return keep


_WORDS = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"

# Candidates: every tag with a confidence, its stage by its source's kind.
_STAGE = "CASE WHEN lower(trim(source)) LIKE '%exif%' THEN 1 WHEN lower(trim(source)) LIKE 'heur%' THEN 2 WHEN lower(trim(source)) LIKE '%scene%' THEN 3 ELSE 4 END"
_RESOLVED = f"""WITH c AS (SELECT m.file_id, k.key, m.confidence, coalesce(lower(trim(m.source)), '') AS source, {_STAGE} AS stage FROM media_tags m JOIN categories k ON k.id = m.category_id WHERE m.confidence IS NOT NULL),
m AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY file_id, key ORDER BY confidence DESC, stage, source) = 1),
s AS (SELECT file_id, key, confidence, source, CASE WHEN confidence >= 0.6 THEN 'auto' ELSE 'review' END AS verdict FROM m WHERE key IN (SELECT key FROM categories WHERE default_enabled)),
r AS (SELECT * FROM s UNION ALL SELECT id, 'other', 1.0, 'fallback', 'auto' FROM media_files WHERE id NOT IN (SELECT file_id FROM s WHERE verdict = 'auto' AND file_id IS NOT NULL))
"""


def _candidates(spark, d):
    t, c = table(spark, d, "media_tags").where("confidence IS NOT NULL"), table(spark, d, "categories").select(F.col("id").alias("category_id"), "key")
    s = F.lower(F.trim("source"))
    stage = F.when(s.like("%exif%"), 1).when(s.like("heur%"), 2).when(s.like("%scene%"), 3).otherwise(4)
    return t.join(c, "category_id").select("file_id", "key", "confidence", F.coalesce(s, F.lit("")).alias("source"), stage.alias("stage"))


def _resolved(spark, d):
    files = table(spark, d, "media_files").select(F.col("id").alias("file_id"))
    return ops.resolved(files, _candidates(spark, d), table(spark, d, "categories").where("default_enabled"), 0.6)


@query("classify_resolve", _RESOLVED + "SELECT file_id, key, confidence, source, verdict FROM r")
def classify_resolve(spark, d):
    return _resolved(spark, d)


@query("classify_summary", _RESOLVED + "SELECT key, count(*) FILTER (verdict = 'auto') AS tagged, count(*) FILTER (verdict = 'review') AS to_review FROM r GROUP BY key")
def classify_summary(spark, d):
    return ops.summary(_resolved(spark, d))


@query("classify_reviews", _RESOLVED + """SELECT file_id, key AS suggested, confidence, CASE WHEN source = 'ml_scene' THEN 'scene' WHEN source = 'ml_face' OR starts_with(source, 'face_') THEN 'face'
WHEN source = 'heuristic' THEN 'document' ELSE 'scene' END AS review_type FROM r WHERE verdict = 'review'""")
def classify_reviews(spark, d):
    return ops.reviews(_resolved(spark, d))


@query("primary_secondary_tags", _RESOLVED + "SELECT r.file_id, r.key, row_number() OVER (PARTITION BY r.file_id ORDER BY c.priority, r.key)::INT AS rank FROM r JOIN (SELECT key, priority FROM categories UNION SELECT 'other', 99 WHERE NOT EXISTS (SELECT 1 FROM categories WHERE key = 'other')) c ON c.key = r.key WHERE verdict = 'auto'")
def primary_secondary_tags(spark, d):
    c = table(spark, d, "categories").select("key", "priority")
    c = c.unionByName(spark.createDataFrame([("other", 99)], "key string, priority int").join(c.select("key"), "key", "left_anti"))
    return ops.primary_and_links(_resolved(spark, d).where("verdict = 'auto'").join(c, "key")).select("file_id", "key", "rank")


# Metadata of pictures, made of the part table: sizes, camera, exposure, place and keywords.
_META = """(SELECT p_partkey AS file_id, (ARRAY[1920, 1170, 2480, 3024, 800])[(p_partkey % 5 + 1)::INT] AS width, (ARRAY[1080, 2532, 3508, 4032, 600])[(p_partkey % 5 + 1)::INT] AS height,
p_partkey % 3 = 0 AS camera, CASE p_partkey % 7 WHEN 0 THEN 'Snipping Tool' WHEN 1 THEN 'Photos 3.0' END AS software, (p_size * 100)::INT AS iso, p_size / 40.0 AS exposure,
(p_partkey % 170 - 85)::DOUBLE AS lat, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE (p_partkey % 360 - 180)::DOUBLE END AS lon, p_name || ', Beach ;' || p_brand AS words FROM part)"""


def _meta(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    at = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % 5 + 1).cast("int"))
    return p.select(k.alias("file_id"), at([1920, 1170, 2480, 3024, 800]).alias("width"), at([1080, 2532, 3508, 4032, 600]).alias("height"), (k % 3 == 0).alias("camera"),
                    F.when(k % 7 == 0, "Snipping Tool").when(k % 7 == 1, "Photos 3.0").alias("software"), (F.col("p_size") * 100).alias("iso"), (F.col("p_size") / 40.0).alias("exposure"),
                    (k % 170 - 85).cast("double").alias("lat"), F.when(k % 11 != 0, (k % 360 - 180).cast("double")).alias("lon"), F.concat("p_name", F.lit(", Beach ;"), "p_brand").alias("words"))


_SCREENS = "[" + ", ".join(f"'{a}x{b}'" for a, b in SCREEN_SIZES) + "]"
_SHOT = f"NOT camera AND list_contains({_SCREENS}, greatest(width, height) || 'x' || least(width, height))"
_TOLD = f"coalesce(regexp_matches(lower(software), '{'|'.join(SCREENSHOT_SOFTWARE)}'), false)"


@query("rule_night", f"SELECT file_id, CASE WHEN iso >= 3200 AND exposure >= 1.0 THEN 0.75 WHEN iso >= 1600 AND exposure >= 0.5 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM {_META}")
def rule_night(spark, d):
    return _meta(spark, d).select("file_id", rules.night_score(F.col("iso"), F.col("exposure")).alias("score"))


@query("rule_screenshot", f"SELECT file_id, CASE WHEN {_SHOT} AND {_TOLD} THEN 0.9::DOUBLE + 0.05::DOUBLE WHEN {_SHOT} THEN 0.9 WHEN {_TOLD} THEN 0.85::DOUBLE + 0.05::DOUBLE ELSE 0.0 END::DOUBLE AS score FROM {_META}")
def rule_screenshot(spark, d):
    c = F.col
    return _meta(spark, d).select("file_id", rules.screenshot_score(c("width"), c("height"), c("camera"), c("software")).alias("score"))


@query("rule_document", f"WITH r AS (SELECT *, greatest(width, height) / least(width, height)::DOUBLE AS q FROM {_META}) SELECT file_id, CASE WHEN abs(q - 1.4142) / 1.4142 < 0.05 OR abs(q - 1.2941) / 1.2941 < 0.05 OR abs(q - 1.5455) / 1.5455 < 0.05 THEN CASE WHEN camera THEN 0.4 ELSE 0.7 END ELSE 0.0 END::DOUBLE AS score FROM r")
def rule_document(spark, d):
    c = F.col
    return _meta(spark, d).select("file_id", rules.document_score(c("width"), c("height"), c("camera")).alias("score"))


_KM = "6371.0 * 2 * atan2(sqrt(a), sqrt(1 - a))"
_HAV = "pow(sin(radians(lat - 48.0) / 2), 2) + cos(radians(48.0)) * cos(radians(lat)) * pow(sin(radians(lon - 11.0) / 2), 2)"
_KEYS = "list_filter(list_transform(regexp_split_to_array(words, '[,;\n]'), lambda k: lower(trim(k))), lambda k: k <> '')"


@query("rule_travel", f"""WITH h AS (SELECT *, {_HAV} AS a, list_has_any({_KEYS}, {_WORDS(TRAVEL_KEYWORDS)}) AS told FROM {_META}), f AS (SELECT *, coalesce({_KM} > 50, false) AS far, round({_KM}, 6) AS km FROM h)
SELECT file_id, km, CASE WHEN far AND told THEN 0.9 WHEN far THEN 0.8 WHEN told THEN 0.7 ELSE 0.0 END::DOUBLE AS score FROM f""")
def rule_travel(spark, d):
    c, home = F.col, (F.lit(48.0), F.lit(11.0))
    return _meta(spark, d).select("file_id", F.round(rules.haversine_km(*home, c("lat"), c("lon")), 6).alias("km"),
                                  rules.travel_score(c("lat"), c("lon"), *home, rules.keyword_list(c("words"))).alias("score"))


@query("keyword_tags", f"WITH k AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[,;\n]'), lambda k: lower(trim(k, ' '))), lambda k: k <> '') AS ks FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(ks)::INT AS n, list_has_any(ks, {_WORDS(TRAVEL_KEYWORDS)}) AS travel, list_has_any(ks, {_WORDS(EVENT_KEYWORDS)}) AS event FROM k")
def keyword_tags(spark, d):
    k = rules.keyword_list(F.col("text"))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(k).alias("n"), rules.has_any(k, TRAVEL_KEYWORDS).alias("travel"), rules.has_any(k, EVENT_KEYWORDS).alias("event"))


@query("rule_faces", """
WITH f AS (SELECT file_id, count(*) AS n, max(bbox.w * bbox.h) AS area FROM face_embeddings WHERE file_id IS NOT NULL GROUP BY 1)
SELECT file_id, 'people' AS key, 0.9::DOUBLE AS score FROM f UNION ALL SELECT file_id, 'selfies', 0.85 FROM f WHERE n = 1 AND area / 40000.0 > 0.35
UNION ALL SELECT file_id, 'family', 0.7 FROM f WHERE n >= 2 AND file_id % 4 <> 0 UNION ALL SELECT file_id, 'events', 0.75 FROM f WHERE n >= 4""")
def rule_faces(spark, d):
    f = table(spark, d, "face_embeddings").where("file_id IS NOT NULL").groupBy("file_id").agg(F.count("*").alias("n"), F.max(F.col("bbox.w") * F.col("bbox.h")).alias("area"))
    tags = rules.face_scores(F.col("n"), F.col("area"), F.lit(40_000), F.lit(False), F.col("file_id") % 4 == 0)
    return f.select("file_id", F.explode(tags).alias("key", "score"))


@query("rule_candidates", f"""SELECT file_id, 'screenshots' AS key, CASE WHEN {_SHOT} AND {_TOLD} THEN 0.9::DOUBLE + 0.05::DOUBLE WHEN {_SHOT} THEN 0.9 ELSE 0.85::DOUBLE + 0.05::DOUBLE END::DOUBLE AS confidence FROM {_META} WHERE ({_SHOT}) OR {_TOLD}
UNION ALL SELECT file_id, 'night', CASE WHEN iso >= 3200 AND exposure >= 1.0 THEN 0.75 ELSE 0.5 END FROM {_META} WHERE iso >= 1600 AND exposure >= 0.5""")
def rule_candidates(spark, d):
    c = F.col
    return ops.candidates(_meta(spark, d), {
        "screenshots": (rules.screenshot_score(c("width"), c("height"), c("camera"), c("software")), "heuristic", 2),
        "night": (rules.night_score(c("iso"), c("exposure")), "exif", 1)}).select("file_id", "key", "confidence")


_ON = ["videos", "screenshots", "documents", "travel", "events", "night", "people", "family", "nature", "food", "pets"]


@query("classify_pipeline", f"""WITH m AS (SELECT *, {_HAV} AS a, list_has_any({_KEYS}, {_WORDS(TRAVEL_KEYWORDS)}) AS told, list_has_any({_KEYS}, {_WORDS(EVENT_KEYWORDS)}) AS event,
  greatest(width, height) / least(width, height)::DOUBLE AS q, file_id % 13 = 0 AS is_video FROM {_META}),
n AS (SELECT *, coalesce({_KM} > 50, false) AS far FROM m WHERE NOT is_video),
f AS (SELECT file_id, count(*) AS k FROM face_embeddings WHERE file_id IS NOT NULL GROUP BY 1),
v AS (SELECT l_partkey AS file_id, CASE l_linenumber % 3 WHEN 0 THEN 'nature' WHEN 1 THEN 'food' ELSE 'pets' END AS key, max(l_discount * 10) AS confidence FROM lineitem GROUP BY 1, 2),
c AS (SELECT file_id, 'videos' AS key, 1.0::DOUBLE AS confidence, 'filesystem' AS source, 0 AS stage FROM m WHERE is_video
UNION ALL SELECT file_id, 'screenshots', CASE WHEN {_SHOT} AND {_TOLD} THEN 0.9::DOUBLE + 0.05::DOUBLE WHEN {_SHOT} THEN 0.9 ELSE 0.85::DOUBLE + 0.05::DOUBLE END, 'heuristic', 2 FROM n WHERE ({_SHOT}) OR {_TOLD}
UNION ALL SELECT file_id, 'documents', CASE WHEN camera THEN 0.4 ELSE 0.7 END, 'heuristic', 2 FROM n WHERE abs(q - 1.4142) / 1.4142 < 0.05 OR abs(q - 1.2941) / 1.2941 < 0.05 OR abs(q - 1.5455) / 1.5455 < 0.05
UNION ALL SELECT file_id, 'travel', CASE WHEN far AND told THEN 0.9 WHEN far THEN 0.8 ELSE 0.7 END, 'exif', 1 FROM n WHERE far OR told
UNION ALL SELECT file_id, 'events', 0.7, 'exif', 1 FROM n WHERE event
UNION ALL SELECT file_id, 'night', CASE WHEN iso >= 3200 AND exposure >= 1.0 THEN 0.75 ELSE 0.5 END, 'exif', 1 FROM n WHERE iso >= 1600 AND exposure >= 0.5
UNION ALL SELECT f.file_id, 'people', 0.9, 'ml_face', 4 FROM f JOIN n USING (file_id) UNION ALL SELECT f.file_id, 'events', 0.75, 'ml_face', 4 FROM f JOIN n USING (file_id) WHERE k >= 4
UNION ALL SELECT v.file_id, v.key, v.confidence, 'ml_scene', 3 FROM v JOIN n USING (file_id) WHERE v.confidence > 0),
w AS (SELECT file_id, key, confidence::DOUBLE AS confidence, source, CASE WHEN confidence >= 0.6 THEN 'auto' ELSE 'review' END AS verdict FROM c WHERE key IN {tuple(_ON)} QUALIFY row_number() OVER (PARTITION BY file_id, key ORDER BY confidence DESC, stage, source) = 1)
SELECT * FROM w UNION ALL SELECT file_id, 'other', 1.0, 'fallback', 'auto' FROM m WHERE file_id NOT IN (SELECT file_id FROM w WHERE verdict = 'auto')""")
def classify_pipeline(spark, d):
    """All stages as one flow: videos alone, rules of metadata and shape, scenes and faces, merge, resolution."""
    c, home = F.col, (F.lit(48.0), F.lit(11.0))
    meta, words = _meta(spark, d), rules.keyword_list(c("words"))
    scores = {"travel": (rules.travel_score(c("lat"), c("lon"), *home, words), "exif", 1), "events": (rules.event_score(words), "exif", 1),
              "night": (rules.night_score(c("iso"), c("exposure")), "exif", 1),
              "screenshots": (rules.screenshot_score(c("width"), c("height"), c("camera"), c("software")), "heuristic", 2),
              "documents": (rules.document_score(c("width"), c("height"), c("camera")), "heuristic", 2)}
    faces = table(spark, d, "face_embeddings").where("file_id IS NOT NULL").groupBy("file_id").agg(F.count("*").alias("n"))
    tags = rules.face_scores(c("n"), F.lit(0), F.lit(1), F.lit(False), F.lit(True))
    faces = faces.select("file_id", F.explode(tags).alias("key", "confidence")).where(c("key").isin("people", "events")).select("file_id", "key", "confidence", F.lit("ml_face").alias("source"), F.lit(4).alias("stage"))
    key = F.element_at(F.array(F.lit("nature"), F.lit("food"), F.lit("pets")), (c("l_linenumber") % 3 + 1).cast("int"))
    scenes = table(spark, d, "lineitem").groupBy(c("l_partkey").alias("file_id"), key.alias("key")).agg(F.max(c("l_discount") * 10).alias("confidence"))
    more = scenes.select("file_id", "key", "confidence", F.lit("ml_scene").alias("source"), F.lit(3).alias("stage")).union(faces)
    enabled = spark.createDataFrame([(k,) for k in _ON], "key string")
    return ops.pipeline(meta.select("file_id", (c("file_id") % 13 == 0).alias("is_video")), meta, scores, more, enabled, 0.6)


@query("face_boxes", """SELECT id, greatest(0, bbox.x - floor(bbox.w * 0.2)::INT) AS x1, greatest(0, bbox.y - floor(bbox.h * 0.2)::INT) AS y1,
least(4000, bbox.x + bbox.w + floor(bbox.w * 0.2)::INT) AS x2, least(3000, bbox.y + bbox.h + floor(bbox.h * 0.2)::INT) AS y2 FROM face_embeddings WHERE bbox IS NOT NULL""")
def face_boxes(spark, d):
    b = rules.padded_box(F.col("bbox.x"), F.col("bbox.y"), F.col("bbox.w"), F.col("bbox.h"), F.lit(4000), F.lit(3000), 0.2)
    return table(spark, d, "face_embeddings").where("bbox IS NOT NULL").select("id", b.alias("b")).select("id", "b.*")


_SCENE = "CASE " + " ".join("WHEN " + " OR ".join(f"k BETWEEN {a} AND {b}" for a, b in rs) + f" THEN '{c}'" for c, rs in reversed(SCENE_CLASSES)) + " END"


@query("scene_classes", f"SELECT k AS class_index, {_SCENE} AS category FROM (SELECT DISTINCT (l_partkey % 1000)::INT AS k FROM lineitem)")
def scene_classes(spark, d):
    k = table(spark, d, "lineitem").select((F.col("l_partkey") % 1000).cast("int").alias("class_index")).distinct()
    return k.select("class_index", rules.scene_category(F.col("class_index")).alias("category"))


_TOP = """WITH x AS (SELECT vec_id, unnest(embedding) * 20 AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), p AS (SELECT vec_id, i, exp(v::DOUBLE - max(v::DOUBLE) OVER (PARTITION BY vec_id)) AS e FROM x),
q AS (SELECT vec_id, i, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS probability FROM p), t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY probability DESC, i)::INT AS rank FROM q)"""


def _top(spark, d):
    p = rules.softmax(F.transform("embedding", lambda x: (x * F.lit(20).cast("float"))))
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(p).alias("i", "p")).select("vec_id", (F.col("i") + 1).cast("long").alias("i"), F.round("p", 6).alias("probability"))
    return e.withColumn("rank", F.row_number().over(W.partitionBy("vec_id").orderBy(F.col("probability").desc(), "i")))


@query("scene_topk", _TOP + "SELECT vec_id, i, probability, rank FROM t WHERE rank <= 5")
def scene_topk(spark, d):
    return _top(spark, d).where("rank <= 5")


@query("scene_best_per_category", _TOP + f", c AS (SELECT vec_id, probability, (i * 15)::INT AS k FROM t WHERE rank <= 10 AND probability > 0.05) SELECT vec_id, {_SCENE} AS category, max(probability) AS score FROM c WHERE {_SCENE} IS NOT NULL GROUP BY 1, 2")
def scene_best_per_category(spark, d):
    t = _top(spark, d).where("rank <= 10 AND probability > 0.05").select("vec_id", "probability", rules.scene_category((F.col("i") * 15).cast("int")).alias("category"))
    return t.where("category IS NOT NULL").groupBy("vec_id", "category").agg(F.max("probability").alias("score"))


@query("vector_cosines", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_cosines(spark, d):
    e = table(spark, d, "embeddings")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(n, "vec_id").select("vec_id", F.round(rules.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


_OK = "embedding IS NOT NULL AND len(embedding) = 128 AND list_min(embedding) > '-infinity'::FLOAT AND list_max(embedding) < 'infinity'::FLOAT AND (list_min(embedding) <> 0 OR list_max(embedding) <> 0)"


@query("face_top1_match", f"""
WITH u AS (SELECT id, person_id, embedding::DOUBLE[] AS v FROM face_embeddings WHERE {_OK}), k AS (SELECT u.* FROM u JOIN people p ON p.id = u.person_id), q AS (SELECT * FROM u WHERE person_id IS NULL),
s AS (SELECT q.id, k.id AS known_id, k.person_id, round(list_cosine_similarity(q.v, k.v), 9) AS s FROM q, k)
SELECT id, person_id, round(s, 6) AS similarity FROM s WHERE s > 0 AND s >= 0.6 QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, known_id) = 1""")
def face_top1_match(spark, d):
    f = face_ops.usable(table(spark, d, "face_embeddings").select("id", "person_id", F.col("embedding").alias("v")), "v", 128)
    known = f.join(table(spark, d, "people").select(F.col("id").alias("person_id")), "person_id", "left_semi")
    m = face_ops.top_match(f.where("person_id IS NULL"), known, 0.6)
    named = known.select(F.col("id").alias("known_id"), "person_id")
    return m.join(named, "known_id").select("id", "person_id", F.round("similarity", 6).alias("similarity"))


@query("face_leader_clusters", f"""WITH RECURSIVE u AS (SELECT id, embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY id) AS k FROM face_embeddings WHERE person_id IS NULL AND {_OK}),
r AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS heads, NULL::BIGINT AS id, NULL::BIGINT AS leader
UNION ALL SELECT u.k, CASE WHEN h.leader IS NULL THEN list_append(r.heads, u.id) ELSE r.heads END, u.id, coalesce(h.leader, u.id) FROM r JOIN u ON u.k = r.k + 1
LEFT JOIN LATERAL (SELECT min(w.id) AS leader FROM u w WHERE list_contains(r.heads, w.id) AND round(list_cosine_similarity(u.v, w.v), 9) >= 0.5) h ON true)
SELECT leader AS leader_id, count(*) AS faces FROM (SELECT leader FROM r WHERE k > 0 UNION ALL SELECT id FROM face_embeddings WHERE person_id IS NULL AND ({_OK}) IS NOT TRUE) GROUP BY 1""")
def face_leader_clusters(spark, d):
    """Greedy leader clusters of the faces of no person, largest first."""
    v = table(spark, d, "face_embeddings").where("person_id IS NULL").select("id", F.col("embedding").alias("v"))
    c = face_ops.leader_clusters(v, 0.5, scratch=Scratch(spark, "leaders"))
    return c.groupBy("leader_id").agg(F.count("*").alias("faces")).orderBy(F.col("faces").desc(), "leader_id")
