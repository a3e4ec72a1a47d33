import hashlib
import re
from collections import defaultdict

import pytest

from wakeline.llm import decontaminate as D

from .cases import empty, frame, rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def brute(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(i)
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                ids = windows.get(tuple(w[k : k + size]))
                if ids:
                    hit.update(range(k, k + size))
                    found |= ids
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out[d] = (len(w), len(hit), len(found), digest, bool(hit))
    return out


ITEMS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (2, "short item"),
    (10, "short item"),
    (3, None),
    (4, "!!! ???"),
    (5, "same same same same same same same same same same same"),
    (6, "Straße ÜBER naïve 123"),
]
DOCS = [
    (1, "x alpha, BETA gamma-delta epsilon zeta eta theta iota kappa lambda y mu"),
    (2, "a short item and a SHORT, item; shorts item"),
    (3, "same " * 25),
    (4, None),
    (5, "straße ÜBER naïve 123 straße über"),
    (6, ""),
]


@pytest.mark.parametrize("part_bytes", [D.PART_BYTES, 200])
def test_against_brute_force(spark, part_bytes):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r[0]: tuple(r[1:]) for r in D.digest(D.decontaminate(docs, items, part_bytes=part_bytes)).collect()}
    assert got == brute(DOCS, ITEMS)


def test_spans_point_into_the_original(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    row = D.decontaminate(docs, items).where("doc_id = 2").first()
    assert [DOCS[1][1][s["start"] : s["end"]] for s in row["spans"]] == ["short item", "SHORT, item"]


def test_parts_keep_a_row_each_of_repeated_and_null_ids(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = [*DOCS, (2, DOCS[1][1]), (2, "another text, a short item"), (None, DOCS[0][1]), (None, "no hit here"), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    whole = D.decontaminate(df, items).collect()
    parts = D.decontaminate(df, items, part_bytes=200).collect()
    assert len(whole) == len(docs)
    assert sorted(map(repr, parts)) == sorted(map(repr, whole))
    assert D.decontaminate(frame(spark), items, part_bytes=200).count() == len(rows())
    assert D.decontaminate(empty(spark), items, part_bytes=200).count() == 0


def test_edges(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.digest(D.decontaminate(frame(spark), items)).count() == len(rows())
    assert D.digest(D.decontaminate(frame(spark), none)).where("contaminated").count() == 0
    assert D.digest(D.decontaminate(empty(spark), items)).count() == 0


@pytest.mark.parametrize("part_bytes", [D.PART_BYTES, 60])
def test_items_and_documents_without_an_id(spark, part_bytes):
    ids = [2**53 + 1, None, 2**53 + 3]
    docs = spark.createDataFrame([(i, f"{w} stands here") for i, w in zip(ids, ("red fox", "blue fox", "no"), strict=True)], "doc_id long, text string")
    items = spark.createDataFrame([(None, "red fox"), (2**53 + 5, "fox stands"), (None, "blue")], "item_id long, text string")
    found = D.decontaminate(docs.coalesce(1), items.coalesce(1), part_bytes=part_bytes)
    assert {r["doc_id"]: r["items"] for r in found.collect()} == {ids[0]: [2**53 + 5, None], None: [2**53 + 5, None], ids[2]: []}
    got = {r["doc_id"]: r for r in D.digest(found).collect()}
    assert got[ids[0]]["n_items"] == 2 and got[ids[0]]["n_hit"] == 3 and not got[ids[2]]["contaminated"]
    assert got[None]["items_sha256"] == hashlib.sha256(str(2**53 + 5).encode()).hexdigest()
