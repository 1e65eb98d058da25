import json
import struct
import zlib

import numpy as np

from heronry.sources import actions, files


def png(path, pixels):
    h, w = pixels.shape
    raw = b"".join(b"\0" + bytes(pixels[y].astype(np.uint8)) for y in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_listing_and_pictures(spark, tmp_path):
    d = tmp_path / "media"
    (d / "sub").mkdir(parents=True)
    rng = np.random.default_rng(1)
    png(d / "a.PNG", rng.integers(0, 256, (40, 50)))
    png(d / "sub" / "b.png", np.zeros((32, 32)))
    (d / "c.txt").write_text("x")
    (d / "broken.jpg").write_bytes(b"no picture")
    assert {r["filename"] for r in files.listing(spark, str(d), "images").collect()} == {"a.PNG", "b.png", "broken.jpg"}
    assert {r["filename"] for r in files.listing(spark, str(d), recursive=False).collect()} == {"a.PNG", "c.txt", "broken.jpg"}
    c = files.scan_counters(files.listing(spark, str(d))).first()
    assert (c["files_seen"], c["images_found"]) == (4, 3)
    p = {r["path"].rsplit("/", 1)[1]: r for r in files.pictures(spark, str(d)).collect()}
    assert (p["a.PNG"]["width"], p["a.PNG"]["height"], p["a.PNG"]["resolution"]) == (50, 40, 2000) and p["a.PNG"]["h"] is not None
    assert p["broken.jpg"]["h"] is None and p["broken.jpg"]["resolution"] is None
    e = {r["path"].rsplit("/", 1)[1]: r["density"] for r in files.edge_density(spark, str(d)).collect()}
    assert e["b.png"] == 0.0 and e["a.PNG"] > 0 and e["broken.jpg"] is None
    assert files.content_hashes(spark, str(d)).count() == 4


def test_journals_and_config(spark, tmp_path):
    (tmp_path / "s1.json").write_text(json.dumps([{"action": "move", "src": "/a", "dst": "/b", "timestamp": "2024-01-01T00:00:00"}]))
    (tmp_path / "bad.json").write_text("{not json")
    assert [(r["session_id"], r["action"]) for r in files.journals(spark, str(tmp_path)).collect()] == [("s1", "move")]
    (tmp_path / "c.json").write_text('{"threshold": 5}')
    assert files.config(tmp_path / "c.json", {"threshold": 10, "x": 1}) == {"threshold": 5, "x": 1}
    assert files.config(tmp_path / "none.json", {"x": 1}) == {"x": 1} == files.config(tmp_path / "bad.json", {"x": 1})


def test_carry_out(spark, tmp_path):
    for n in "abc":
        (tmp_path / n).write_text(n)
    t = str(tmp_path)
    plan = spark.createDataFrame([("move", f"{t}/a", f"{t}/o/a"), ("copy", f"{t}/b", f"{t}/o/b"), ("symlink", f"{t}/b", f"{t}/o/l"), ("delete", f"{t}/c", None), ("move", f"{t}/gone", f"{t}/o/x"), ("copy", f"{t}/b", f"{t}/b")],
                                 "action string, src string, dst string")
    got = {(r["action"], r["src"][len(t):], bool(r["error"])) for r in actions.carry_out(plan, "s").collect()}
    assert got == {("move", "/a", False), ("copy", "/b", False), ("symlink", "/b", False), ("delete", "/c", False), ("move", "/gone", True), ("copy", "/b", True)}
    assert (tmp_path / "o" / "a").read_text() == "a" and not (tmp_path / "a").exists() and not (tmp_path / "c").exists() and (tmp_path / "o" / "l").is_symlink()


def test_journal_round_trip(spark, tmp_path):
    """What was carried out and written comes back with its session, beside journals that are arrays."""
    from heronry.sources.files import journals, write_journal

    rows_ = [("s1", 1, "move", "/a", "/b", None), ("s1", 2, "copy", "/c", "/d", None), ("s1", 3, "move", "/e", "/f", "exists"), ("s2", 1, "trash", "/g", "/h", None)]
    j = spark.createDataFrame(rows_, "session_id string, seq long, action string, src string, dst string, error string").selectExpr("*", "timestamp'2024-01-01 10:00:00' AS ts")
    at = str(tmp_path / "journal")
    write_journal(j.where("session_id = 's1'"), at)
    write_journal(j.where("session_id = 's2'"), at)
    (tmp_path / "journal" / "old.json").write_text('[{"action": "move", "src": "/p", "dst": "/q", "timestamp": "2023-01-01T00:00:00"}]')
    got = journals(spark, at)
    assert sorted((r["session_id"], r["action"], r["src"], r["dst"]) for r in got.collect()) == [
        ("old", "move", "/p", "/q"), ("s1", "copy", "/c", "/d"), ("s1", "move", "/a", "/b"), ("s2", "trash", "/g", "/h")]
    assert got.where("ts IS NULL").count() == 0
