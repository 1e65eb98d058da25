"""Plain single-machine versions of the problems, to test against. They share no code with the operators."""

import re
import unicodedata
from collections import defaultdict
from urllib.parse import unquote

import numpy as np
import pandas as pd


def read(folder, name):
    return pd.read_parquet(f"{folder}/{name}.parquet")


def path(p):
    if p is None:
        return None
    p = p.strip()
    if p.startswith("file://"):
        p = unquote(p[7:])
    out = []
    for x in unicodedata.normalize("NFC", p.replace("\\", "/")).split("/"):
        if x == "..":
            out = out[:-1]
        elif x not in ("", "."):
            out.append(x)
    return "/" + "/".join(out) if out else None


def bits(h):
    m = re.fullmatch(r"(?:0x)?([0-9a-f]{1,16})", h.strip().lower()) if isinstance(h, str) else None
    return int(m[1], 16) if m else 0


def in_force(ii):
    ii = ii.assign(k=ii.path.map(path), h=ii.hash.map(bits)).sort_values(["scanned_at", "info_id"], na_position="first")
    h = ii[ii.h > 0].groupby("k").h.last().to_dict()
    r = ii[ii.resolution > 0].groupby("k").resolution.last().to_dict()
    return h, r


def near(hs, t=5):
    """{h: hashes within t}, itself included."""
    u = np.array(sorted(set(hs)), dtype=np.uint64)
    return {int(h): [int(x) for x in u[np.bitwise_count(u ^ h) <= t]] for h in u}


class Sets:
    def __init__(self):
        self.p = {}

    def find(self, x):
        self.p.setdefault(x, x)
        while self.p[x] != x:
            x = self.p[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.p[max(a, b)] = min(a, b)


def p1(folder):
    mf, (_, res) = read(folder, "media_files"), in_force(read(folder, "image_info"))
    row = {}
    for i, p, s, c in zip(mf.id, mf.path, mf.size_bytes, mf.created_at):
        s = s if s == s and s > 0 else -1
        c = -c.value if c is not pd.NaT and c == c else -float("inf")
        row[path(p)] = (res.get(path(p), -1), s, c, -i)
    out = set()
    dg = read(folder, "duplicate_groups")
    for g, ps in zip(dg.group_id, dg.paths):
        files = {path(p) for p in (ps if ps is not None else [])} & row.keys()
        if len(files) > 1:
            out.add((g, -max(row[f] for f in files)[3]))
    return out


def p2(folder):
    mf, (hs, _) = read(folder, "media_files"), in_force(read(folder, "image_info"))
    ids, s = {path(p): i for i, p in zip(mf.id, mf.path)}, Sets()
    for ps in read(folder, "duplicate_groups").paths:
        fs = [ids[path(p)] for p in (ps if ps is not None else []) if path(p) in ids]
        for f in fs:
            if f != fs[0]:
                s.join(fs[0], f)
    by = defaultdict(list)
    for k, h in hs.items():
        if k in ids:
            by[h].append(ids[k])
    for h, others in near(by).items():
        for o in others:
            for f in by[o]:
                if f != by[h][0]:
                    s.join(by[h][0], f)
    return {(f, s.find(f)) for f in list(s.p)}


def p4(folder):
    e, (hs, _) = read(folder, "watcher_events"), in_force(read(folder, "image_info"))
    e = e[e.triggered_job_id.notna()].copy()
    e["at"] = e.groupby("triggered_job_id").detected_at.transform("min")
    e["k"] = e.file_path.map(path)
    e["h"] = e.k.map(lambda k: hs.get(k, 0))
    ok = e[e.status.map(lambda s: isinstance(s, str) and s.strip().lower() == "completed")]
    fk, fh = ok.groupby("k")["at"].min().to_dict(), ok[ok.h > 0].groupby("h")["at"].min().to_dict()
    u = np.array(sorted(fh), dtype=np.uint64)
    first = {}
    for h in set(e.h) - {0}:
        n = [fh[int(x)] for x in u[np.bitwise_count(u ^ np.uint64(h)) <= 5]]
        if n:
            first[h] = min(n)
    return {i for i, at, k, h in zip(e.id, e["at"], e.k, e.h) if k in fk and fk[k] < at or h in first and first[h] < at}


def p7(folder):
    t = read(folder, "media_tags")[["file_id", "category_id"]].drop_duplicates()
    n, na = t.file_id.nunique(), t.groupby("category_id").size().to_dict()
    m = t.merge(t, on="file_id")
    m = m[m.category_id_x < m.category_id_y].groupby(["category_id_x", "category_id_y"]).size()
    return {(a, b) for (a, b), k in m.items() if k >= 5 and k * n >= 2 * na[a] * na[b]}


def usable(folder):
    f = read(folder, "face_embeddings")
    ok = f.embedding.map(lambda e: e is not None and len(e) == 128 and not np.isnan(np.asarray(e, float)).any() and np.any(np.asarray(e) != 0))
    f = f[ok].sort_values("id")
    x = np.stack(f.embedding.values).astype(float) if len(f) else np.zeros((0, 128))
    return f.id.to_numpy(), x / np.linalg.norm(x, axis=1, keepdims=True)


def p3(folder, k=5, least=0.96):
    ids, x = usable(folder)
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(ids)):
        for j in np.argsort(-s[i], kind="stable")[:k]:
            if s[i, j] >= least:
                out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def p6(folder, least=0.7):
    ids, x = usable(folder)
    s, out = x @ x.T >= least, set()
    for i in range(len(ids)):
        own = np.nonzero(s[i])[0]
        if len(own) >= 3:
            out.add((ids[i], ids[own].min()))
    return out


def words9(t):
    t = "".join(c for c in unicodedata.normalize("NFD", t or "") if unicodedata.category(c) not in ("Mn", "Cf"))
    return re.findall(r"[^\W_]+", t.casefold())


def p9(folder, n=12):
    grams = defaultdict(set)
    ev = read(folder, "eval_items")
    for i, t in zip(ev.item_id, ev.text):
        w = words9(t)
        for k in range(len(w) - n + 1):
            grams[tuple(w[k:k + n])].add(i)
    out = set()
    d = read(folder, "documents")
    for doc, t in zip(d.doc_id, d.text):
        w = words9(t)
        for k in range(len(w) - n + 1):
            out |= {(doc, i) for i in grams.get(tuple(w[k:k + n]), ())}
    return out
