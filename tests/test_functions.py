import math
import random
from fnmatch import fnmatchcase

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronry.functions import naming, rules
from heronry.functions.hashes import hamming, hash_hex, parse_hash, similar
from heronry.functions.paths import canonical_path, extension, path_key, stem
from heronry.functions.phash import dct_matrix, hashes_of, phash_of_array, resized


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


PATHS = [
    ("/a/b.jpg", "/a/b.jpg"), ("//a///b.jpg", "/a/b.jpg"), ("/a/./b.jpg", "/a/b.jpg"), ("/a/x/../b.jpg", "/a/b.jpg"), ("\\a\\b.jpg", "/a/b.jpg"),
    ("\\a/b.jpg", "/a/b.jpg"), ("file:///a/b%20c.jpg", "/a/b c.jpg"), ("file://localhost/a/b+c.jpg", "/a/b+c.jpg"), ("  /a/b.jpg\n", "/a/b.jpg"),
    ("/a/e\u0301.jpg", "/a/\u00e9.jpg"), ("file:///a/%C3%A9.jpg", "/a/\u00e9.jpg"), ("/A/b.jpg", "/A/b.jpg"), ("", None), ("   ", None), (None, None),
    ("/../a", "/a"), ("a/../../b", "../b"), ("/a/..b/c", "/a/..b/c"), ("/a/b/", "/a/b"), ("/a/100%25.jpg", "/a/100%25.jpg"),
]


@pytest.mark.parametrize("given,want", PATHS)
def test_canonical_path(given, want):
    assert canonical_path(given) == want
    assert want is None or canonical_path(want) == want


def test_path_key_column(spark):
    assert column(spark, [p for p, _ in PATHS], path_key) == [w for _, w in PATHS]


def test_parse_hash(spark):
    given = ["abcdef0123456789", "0xABCDEF0123456789", " ffffffffffffffff ", "1f", "", None, "n/a", "0000000000000000", "0x", "1" * 17, "8000000000000000"]
    want = [0xabcdef0123456789 - 2**64, 0xabcdef0123456789 - 2**64, -1, 31, None, None, None, None, None, None, -2**63]
    assert column(spark, given, parse_hash) == want
    assert column(spark, ["ff00", "8000000000000001"], lambda c: hash_hex(parse_hash(c))) == ["000000000000ff00", "8000000000000001"]


def test_hamming(spark):
    df = spark.createDataFrame([(0xff00ff00, 0xff00ff00), (0xff00ff00, 0xff00ff01), (-1, 0), (None, 1)], "a long, b long")
    assert [r[0] for r in df.select(hamming(F.col("a"), F.col("b"))).collect()] == [0, 1, 64, None]
    assert [r[0] for r in df.select(similar(F.col("a"), F.col("b"))).collect()] == [True, True, False, False]


COPIES = [("photo (1)", 1, "photo"), ("Photo_1", 6, "Photo"), ("Data (copy)", 2, "Data"), ("IMG_1234", 6, "IMG"), ("Notes - Copy2", 3, "Notes"),
          ("IMG_20240101_123456", 6, "IMG_20240101"), ("a-copy", 3, "a"), ("2024-01-02", 6, "2024-01"), ("Image copy", 4, "Image"), ("Image 2", 7, "Image"),
          ("photo (1) copy", 4, "photo (1)"), ("Image copy 2", 7, "Image copy"), ("a_COPY3", 5, "a"), ("photoCopy", 0, "photoCopy"), ("(1)", 1, ""), ("x - copy (3)", 1, "x - copy")]


def test_copy_suffixes(spark):
    stems = [s for s, _, _ in COPIES]
    assert column(spark, stems, naming.copy_suffix) == [k for _, k, _ in COPIES]
    assert column(spark, stems, naming.base_of_copy) == [b for _, _, b in COPIES]


def test_names(spark):
    assert column(spark, ["a.tar.GZ", ".hidden", "x", "a."], extension) == [".gz", "", "", ""]
    assert column(spark, ["a.tar.GZ", ".hidden", "x"], stem) == ["a.tar", ".hidden", "x"]
    assert column(spark, [".JPG", ".mov", ".txt", None], naming.file_type) == ["image", "video", "other", "other"]
    assert column(spark, [0, 1536, 3 * 1024**4 * 1000], naming.human_size, "long") == ["0.00 B", "1.50 KB", "3000.00 TB"]
    names = [".hidden", "x.tmp", "x.part", "x.crdownload", "Thumbs.db", "ok.jpg", "raw_1.dng"]
    assert column(spark, names, lambda c: naming.ignored(c, ["raw_?.d*"])) == [True, True, True, True, True, False, True]
    assert column(spark, ["/r", "/r/a", "/ra", "/"], lambda c: naming.inside(c, "/r/")) == [True, True, False, False]


@pytest.mark.parametrize("pattern", ["*.tmp", "a?c", "[ab]*", "[!ab]c", "x[", "a.b", "*", "[]]x"])
def test_glob_is_fnmatch(pattern):
    import re
    for name in ["a.tmp", "abc", "b", "cc", "x[", "a.b", "axb", "]x", ""]:
        assert bool(re.match(naming.glob_regex(pattern), name)) == fnmatchcase(name, pattern), (pattern, name)


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


def test_rule_boundaries(spark):
    lit, none = F.lit, F.lit(None).cast("double")
    night = lambda i, e: one(spark, rules.night_score(lit(i), lit(e)))
    assert [night(3200, 1.0), night(1600, 0.5), night(3200, 0.5), night(100, 9.0)] == [0.75, 0.5, 0.5, 0.0]
    assert one(spark, rules.night_score(none, lit(1.0))) == 0.0
    shot = lambda w, h, cam, sw: one(spark, rules.screenshot_score(lit(w), lit(h), lit(cam), lit(sw)))
    assert [shot(1920, 1080, False, None), shot(1080, 1920, False, "ShareX"), shot(5, 5, False, "snip"), shot(1920, 1080, True, None)] == [0.9, 0.9500000000000001, 0.9, 0.0]
    doc = lambda w, h, cam, *e: one(spark, rules.document_score(lit(w), lit(h), lit(cam), *[lit(x) for x in e]))
    assert [doc(2480, 3508, False), doc(3508, 2480, True), doc(0, 10, False), doc(1000, 1000, False), doc(2480, 3508, False, 1.0)] == [0.7, 0.4, 0.0, 0.0, 0.95]
    words = lambda *k: F.array(*[lit(x) for x in k]).cast("array<string>")
    travel = lambda lat, lon, *k: one(spark, rules.travel_score(lat, lon, lit(0.0), lit(0.0), words(*k)))
    km50 = math.degrees(50 / 6371.0)
    assert [travel(lit(km50 * 0.9999), lit(0.0)), travel(lit(km50 * 1.001), lit(0.0)), travel(lit(2.0), lit(0.0), "beach"), travel(none, none, "beach")] == [0.0, 0.8, 0.9, 0.7]
    assert one(spark, rules.event_score(words("x", "gala"))) == 0.7
    faces = lambda n, area, img, front, tr: one(spark, rules.face_scores(lit(n), lit(area), lit(img), lit(front), lit(tr)))
    assert faces(0, 1, 1, True, False) == {}
    assert faces(1, 35, 100, False, False) == {"people": 0.9}
    assert faces(1, 36, 100, False, False) == {"people": 0.9, "selfies": 0.85}
    assert faces(2, 1, 100, False, True) == {"people": 0.9}
    assert faces(4, 1, 0, False, False) == {"people": 0.9, "family": 0.7, "events": 0.75}
    assert column(spark, [575, 970, 300, 151, 331, 449], rules.scene_category, "int") == ["art", "nature", None, "pets", "nature", "travel"]
    assert column(spark, ["a, B;c\n ,", None, ""], rules.keyword_list) == [["a", "b", "c"], [], []]
    assert column(spark, ["ml_face", "face_x", "heuristic", "ml_scene", "?"], rules.review_type) == ["face", "face", "document", "scene", "scene"]
    assert column(spark, [-3, 30, None, 7], rules.clamp_threshold, "int") == [0, 25, 10, 7]


def test_scene_classes_count(spark):
    n = spark.range(1000).select(rules.scene_category(F.col("id")).alias("c")).where("c IS NOT NULL").groupBy("c").count()
    assert {r["c"]: r["count"] for r in n.collect()} == {"pets": 188, "food": 50, "vehicles": 30, "art": 30, "nature": 16, "travel": 3}


def test_phash(spark):
    rng = np.random.default_rng(1)
    p = rng.integers(0, 256, (5, 32, 32)).astype(float)
    c = dct_matrix()
    assert np.allclose(c @ c.T, np.eye(32))
    got = hashes_of(p)
    for x, h in zip(p, got):
        f = np.array([[sum(x[i, j] * c[u, i] * c[v, j] for i in range(32) for j in range(32)) for v in range(8)] for u in range(8)])
        low = f.ravel()[1:]
        bits = "0" + "".join("1" if v > sorted(low)[31] else "0" for v in low)
        assert int(bits, 2) == int(h) % 2**64 and bits.count("1") == 31
    assert (hashes_of(p, "linear64") != got).any()
    flat = hashes_of(np.full((1, 32, 32), 7.0))[0]
    df = spark.createDataFrame([(1, [float(v) for v in p[0].ravel()]), (2, None), (3, [1.0])], "i int, x array<double>")
    assert [r[0] for r in df.orderBy("i").select(phash_of_array(F.col("x"))).collect()] == [int(got[0]), None, None]
    assert isinstance(int(flat), int) and resized(np.ones((50, 70)) * 9).tolist() == (np.ones((32, 32)) * 9).tolist()


def test_near_pictures_have_near_hashes():
    rng = np.random.default_rng(2)
    x = np.kron(rng.integers(30, 226, (8, 8)), np.ones((8, 8))).astype(float)
    a, b = (hashes_of(resized(v)[None])[0] for v in (x, x + rng.normal(0, 2, x.shape)))
    assert bin(int(a ^ b) % 2**64).count("1") <= 10


def test_softmax_and_cosine(spark):
    r = random.Random(1)
    v = [r.uniform(-3, 3) for _ in range(8)]
    got = column(spark, [v], rules.softmax, "array<double>")[0]
    e = [math.exp(x) for x in v]
    assert got == pytest.approx([x / sum(e) for x in e])
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [None if r[0] is None else round(r[0], 6) for r in df.select(rules.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, None, None, None]


def test_ignored_white_space_at_end(spark):
    """Globs end where the name ends, as in fnmatch: not before a final line break."""
    globs = ["thumb_*", "*[_-]edit.*", "P[0-4]*.jp?g"]
    names = [n + w for n in ("P1.jpeg", "P9.jpeg", "a-edit.png", "thumb_1", "x.jpg") for w in ("", " ", "\n", "\r\n", "\u2028", "\t\n")]
    assert column(spark, names, lambda c: naming.ignored(c, globs)) == [any(fnmatchcase(n, g) for g in globs) for n in names]


def test_planes_and_gates(spark):
    from heronry.functions import rules
    from heronry.operators import classify

    df = spark.createDataFrame([([0, 255, 51, 255, 0, 102],), ([],)], "p array<int>")
    got = [r[0] for r in df.select(rules.normalised_planes(F.col("p"), [0.5, 0.5, 0.0], [0.5, 0.5, 0.2])).collect()]
    assert [round(x, 6) for x in got[0]] == [-1.0, 1.0, 1.0, -1.0, 1.0, 2.0] and got[1] == []
    scores = {"night": (F.lit(0.5), "exif", 1), "pets": (F.lit(0.9), "ml_scene", 3), "travel": (F.lit(0.7), "exif", 1)}
    assert set(classify.gated(scores, {"night", "pets"}, {3})) == {"night"}
