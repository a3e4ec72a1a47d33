import random

import corpus_pipeline as P
from wakeline.llm import near_copies as N
from wakeline.llm import simhash

from .cases import empty, frame, rows


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(texts):
    """Linked pairs at 0.8 and the least id reachable over them; texts: {id: text}."""
    sets, root, pairs = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}, []

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                pairs.append((i, j))
                root[max(find(i), find(j))] = min(find(i), find(j))
    return pairs, {i: find(i) for i in ids}


def planted():
    """Texts with copies of 1 to 6 edited words, and a large group of copies of one text."""
    rng, texts = random.Random(11), []
    word = lambda: f"w{rng.randrange(5000)}"
    for group in range(60):
        base = [word() for _ in range(rng.randrange(60, 260))]
        texts.append(base)
        for edits in range(1, 7) if group else [rng.randrange(1, 6) for _ in range(300)]:
            copy = list(base)
            for at in rng.sample(range(len(copy)), edits):
                copy[at] = word()
            texts.append(copy)
    rng.shuffle(texts)
    return {i: " ".join(t) for i, t in enumerate(texts)}


def test_recall_and_precision_against_brute_force(spark):
    texts = planted()
    pairs, root = brute(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in N.near_copies(df).collect()}
    assert len(pairs) > 1000
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.999 * len(pairs)
    assert all(root[i] == root[c] for i, c in got.items())
    docs = df.selectExpr("doc_id", "text", "'en' AS lang", "'a' AS source", "cast(length(text) AS long) AS n_chars")
    stayed = {r["doc_id"] for r in P.near_duplicate_stage(spark, docs, "").collect()}
    assert len(stayed - set(root.values())) <= 0.001 * len(texts)


def test_nodes_outside_the_pivots_component_are_compared(spark):
    # One band holds them all: texts of the same words, whose least hashes agree.
    rng = random.Random(2)
    common = [f"c{i}" for i in range(120)]
    texts = {}
    for i in range(80):
        own = [f"o{i // 2}x{k}" for k in range(60)]
        texts[i] = " ".join(common + own + [f"e{i}"] * rng.randrange(2))
    pairs, root = brute(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in N.near_copies(df).collect()}
    assert len(set(root.values())) == 40 and got == root


def test_prints_link_what_no_band_holds(spark):
    # Alike to exactly 0.8; one shingle makes the print of both, and they share none of the 32 bands.
    tail = "826371 202480 239021 631170 834824 567742 379393 820956 423013 777343 308957 711799 533219 217387 216065".split()
    texts = [["z"] * 40 + [f"a{n}" for n in tail] + end for end in (["a371871", "a565368"], ["b871387", "b158767"])]
    a, b = ([w.encode() for w in t] for t in texts)
    keys = [set(N.band_keys(simhash.hashes_of(N.shingles_of(t))).tolist()) for t in (a, b)]
    assert not keys[0] & keys[1] and N.alike(N.shingles_of(a), N.shingles_of(b))
    # Of one print too, but unlike: the exact check refuses it.
    other = ["z"] * 40 + [f"c{n}" for n in tail]
    assert len({simhash.fingerprint(" ".join(t), N.SHINGLE) for t in (*texts, other)}) == 1
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate((*texts, other), 1)], "doc_id long, text string")
    assert {tuple(r) for r in N.near_copies(df).collect()} == {(1, 1), (2, 1), (3, 3)}


def test_edges(spark):
    out = N.near_copies(frame(spark)).collect()
    assert len(out) == len(rows())
    got = {r["doc_id"]: r["component_id"] for r in out}
    assert got[1] == got[2] == 1 and got[5] == got[6] == 5
    assert {got[i] for i in (3, 4, 12)} == {3} and got[None] is None
    # Two texts under one doc_id are each compared by their own words.
    texts = [(1, "a b c d e f g h i j"), (1, "k l m n o p q r s t"), (2, "K l m n o p q r s t"), (3, "x y z")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {tuple(r) for r in N.near_copies(df).collect()} == {(1, 1), (2, 1), (3, 3)}
    assert N.near_copies(empty(spark)).count() == 0


def test_stage_keeps_the_least_of_each_group_of_documents(spark, sf_dir):
    docs = P.table(spark, sf_dir, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    _, root = brute(texts)
    assert sorted(r["doc_id"] for r in P.near_duplicate_stage(spark, docs, sf_dir).collect()) == sorted(set(root.values()))
