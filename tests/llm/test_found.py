"""The pN_found queries against plain versions, on the smallest data."""

import brute
import pytest

from heronry.llm import clusters, consolidate, history, leaks, neighbours, survivors, together

FOUND = {"p1": survivors, "p2": consolidate, "p3": neighbours, "p4": history, "p6": clusters, "p7": together, "p9": leaks}


@pytest.mark.parametrize("name", FOUND)
def test_found(spark, data, name):
    rows = getattr(FOUND[name], f"{name}_found")(spark, data).collect()
    got = [tuple(r) if len(r) > 1 else r[0] for r in rows]
    assert len(got) == len(set(got)) and set(got) == getattr(brute, name)(data)


def test_ids(spark, data):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    from heronry.llm.tokens import p8_ids

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    d = brute.read(data, "documents")
    want = {i: e.ids for i, e in zip(d.doc_id, t.encode_batch([x or "" for x in d.text], add_special_tokens=False))}
    assert {r["doc_id"]: r["ids"] for r in p8_ids(spark, data).collect()} == want


def test_quality(spark):
    """Held out: the labels of every second document teach, the others are told apart."""
    from pyspark.sql import functions as F

    from heronry.llm.quality import graded
    from heronry.session import Scratch
    from heronry.sources.tables import table

    folder = "/root/testdata/sf0.01"
    labels = table(spark, folder, "doc_labels")
    half = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)) == 0
    found = {r[0] for r in graded(table(spark, folder, "documents"), labels.where(half), Scratch(spark, "q")).where("score > 0").select("doc_id").collect()}
    known = [(r["doc_id"], r["label"].strip().lower()) for r in labels.where(~half & F.col("label").isNotNull()).collect()]
    assert len(known) > 15 and sum((i in found) == (x != "prose") for i, x in known) >= 0.9 * len(known)


def test_nearest_recall(spark, data):
    """The ten nearest of the query faces, against brute force: recall of at least 0.9."""
    import numpy as np

    from heronry.llm.neighbours import p3_similar

    ids, x = brute.usable(data)
    got = {}
    for r in p3_similar(spark, data).collect():
        got.setdefault(r["face_id"], set()).add(r["similar_id"])
    hits = total = 0
    for i in np.nonzero(ids % 100 == 0)[0]:
        s = x @ x[i]
        s[i] = -2
        want = set(ids[np.argsort(-s)[:10]].tolist())
        hits, total = hits + len(want & got[ids[i]]), total + len(want)
    assert total and hits / total >= 0.9


def test_queries_have_names():
    from heronry.llm import queries

    assert {f"p{n}_found" for n in (1, 2, 3, 4, 6, 7, 9, 10)} | {"p8_ids"} <= set(queries.QUERIES) and set(queries.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", ["p7_found", "p7_scores"])
def test_sql(spark, data, name):
    import oracle

    from heronry.llm import queries

    assert oracle.compare(spark, oracle.connect(data), data, queries.QUERIES[name], queries.SQL[name]) is None
