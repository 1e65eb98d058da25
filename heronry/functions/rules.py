"""Scores of the rule stages: metadata, document and screenshot shape, faces, scenes. All are Columns, no Python runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from heronry.functions.constants import (DOCUMENT_RATIOS, EVENT_KEYWORDS, SCENE_CLASSES, SCREEN_SIZES, SCREENSHOT_SOFTWARE, TRAVEL_KEYWORDS)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def safe_double(c: Column) -> Column:
    return blank_to_null(c).try_cast("double")


def keyword_list(c: Column) -> Column:
    """Lower-case keywords of a text separated by comma, semicolon or line break; null gives none."""
    words = F.transform(F.split(c, r"[,;\n]"), lambda k: F.lower(F.trim(k)))
    return F.coalesce(F.filter(words, lambda k: k != ""), F.array().cast("array<string>"))


def has_any(keywords: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(keywords, F.array(*[F.lit(k) for k in wanted]))


def decimal_degrees(deg: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    d = deg + minutes / 60.0 + seconds / 3600.0
    return F.when(F.upper(ref).isin("S", "W"), -d).otherwise(d)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 6371.0 * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def front_camera(model: Column) -> Column:
    return F.coalesce(F.lower(model).rlike("front|selfie|facetime"), F.lit(False))


def travel_score(lat: Column, lon: Column, home_lat: Column, home_lon: Column, keywords: Column) -> Column:
    """More than 50 km from home .8, a travel keyword .7, both .9; an unknown place tells nothing."""
    far, told = F.coalesce(haversine_km(home_lat, home_lon, lat, lon) > 50, F.lit(False)), has_any(keywords, TRAVEL_KEYWORDS)
    return F.when(far & told, 0.9).when(far, 0.8).when(told, 0.7).otherwise(0.0)


def event_score(keywords: Column) -> Column:
    return F.when(has_any(keywords, EVENT_KEYWORDS), 0.7).otherwise(0.0)


def night_score(iso: Column, exposure: Column) -> Column:
    return F.when((iso >= 3200) & (exposure >= 1.0), 0.75).when((iso >= 1600) & (exposure >= 0.5), 0.5).otherwise(0.0)


def screen_size(w: Column, h: Column) -> Column:
    """Whether the pixel size is one of a known screen, in either position."""
    area = F.greatest(w, h).cast("long") * 100_000 + F.least(w, h)
    return F.coalesce(area.isin([a * 100_000 + b for a, b in SCREEN_SIZES]), F.lit(False))


def screenshot_score(w: Column, h: Column, camera: Column, software: Column) -> Column:
    """.9 for a screen's size without camera, .95 if the software tells it too, .9 for the software alone."""
    size = ~camera & screen_size(w, h)
    told = F.coalesce(F.lower(software).rlike("|".join(SCREENSHOT_SOFTWARE)), F.lit(False))
    return F.when(size & told, F.lit(0.9) + F.lit(0.05)).when(size, 0.9).when(told, F.lit(0.85) + F.lit(0.05)).otherwise(0.0)


def document_score(w: Column, h: Column, camera: Column, edges: Column | None = None) -> Column:
    """.7 for a paper's proportions without camera, .4 with; the share of edges adds a quarter of itself, up to 1."""
    ratio = F.greatest(w, h) / F.least(w, h).cast("double")
    paper = reduce(lambda a, b: a | b, [F.abs(ratio - r) / r < 0.05 for r in DOCUMENT_RATIOS])
    score = F.when((w > 0) & (h > 0) & paper, F.when(camera, 0.4).otherwise(0.7)).otherwise(0.0)
    if edges is None:
        return score
    return F.when((score > 0) & (edges > 0), F.least(F.lit(1.0), score + edges * 0.25)).otherwise(score)


def edge_score(density: Column) -> Column:
    return F.least(F.lit(1.0), density * 2.5)


def face_scores(count: Column, face_area: Column, image_area: Column, front: Column, travel: Column) -> Column:
    """map of people, selfies, family and events to their scores, those of no score left out."""
    ratio = F.when(image_area > 0, face_area / image_area).otherwise(0.0)
    pairs = F.array(
        F.struct(F.lit("people").alias("k"), F.when(count > 0, 0.9).alias("v")),
        F.struct(F.lit("selfies").alias("k"), F.when((count == 1) & (front | (ratio > 0.35)), 0.85).alias("v")),
        F.struct(F.lit("family").alias("k"), F.when((count >= 2) & ~travel, 0.7).alias("v")),
        F.struct(F.lit("events").alias("k"), F.when(count >= 4, 0.75).alias("v")))
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))


def scene_category(index: Column) -> Column:
    """Category of a scene class, null for classes of none."""
    out = F.lit(None).cast("string")
    for key, ranges in SCENE_CLASSES:  # later categories take over
        out = F.when(reduce(lambda a, b: a | b, [index.between(a, b) for a, b in ranges]), key).otherwise(out)
    return out


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits, shifted by the largest. Exponentials and their sum are bound once per row."""
    wide = F.transform(logits, lambda x: x.cast("double"))
    shifted = F.transform(F.array(F.struct(wide.alias("v"), F.array_max(wide).alias("m"))), lambda t: F.transform(t["v"], lambda x: F.exp(x - t["m"])))
    summed = F.transform(shifted, lambda e: F.struct(e.alias("v"), F.aggregate(e, F.lit(0.0), lambda a, y: a + y).alias("s")))
    return F.element_at(F.transform(summed, lambda t: F.transform(t["v"], lambda y: y / t["s"])), 1)


def padded_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, share: float) -> Column:
    """struct(x1, y1, x2, y2) of a box grown by a share of its size on each side, within the picture."""
    px, py = F.floor(w * share).cast("int"), F.floor(h * share).cast("int")
    return F.struct(F.greatest(F.lit(0), x - px).alias("x1"), F.greatest(F.lit(0), y - py).alias("y1"),
                    F.least(width, x + w + px).alias("x2"), F.least(height, y + h + py).alias("y2"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if a vector is null, all zero, or of another length than the other."""
    ok = (F.size(a) == F.size(b)) & (dot(a, a) > 0) & (dot(b, b) > 0)
    return F.when(ok, dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)))


REVIEW_TYPES = {"ml_scene": "scene", "ml_face": "face", "heuristic": "document"}


def review_type(source: Column) -> Column:
    s = F.lower(F.trim(source))
    return F.when(s == "ml_scene", "scene").when((s == "ml_face") | F.startswith(s, F.lit("face_")), "face").when(s == "heuristic", "document").otherwise("scene")


def clamp_threshold(t: Column, default: int = 10) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(25), F.coalesce(t, F.lit(default))))


def enabled_steps(steps: Column) -> Column:
    """Those of an array of structs (..., enabled) that are on."""
    return F.filter(steps, lambda s: F.coalesce(s["enabled"], F.lit(False)))


def stage_keys(enabled: Column, of_stage: list[str]) -> Column:
    """The keys of a stage that are enabled; an empty array lets the stage out."""
    return F.array_intersect(F.array(*[F.lit(k) for k in of_stage]), enabled)


def throttle_seconds(kilobytes_per_second: Column) -> Column:
    """Pause between uploads under a limit of the bandwidth."""
    return F.lit(1.0) / F.greatest(F.lit(1.0), kilobytes_per_second / 512.0)


def normalised_planes(pixels: Column, mean: list[float], spread: list[float]) -> Column:
    """Bytes of a picture, three channels a pixel, as three planes of (value / 255 - mean) / spread, one after the other."""
    n = (F.size(pixels) / 3).cast("int")
    plane = lambda c: F.transform(F.sequence(F.lit(0), n - 1), lambda i: (F.element_at(pixels, (i * 3 + c + 1).cast("int")) / 255.0 - mean[c]) / spread[c])
    return F.when(n > 0, F.concat(plane(0), plane(1), plane(2))).otherwise(F.array().cast("array<double>"))
