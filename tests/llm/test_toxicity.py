import random

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wakeline.llm import toxicity as T

from .cases import empty, frame, rows


@given(st.integers(1, 200))
def test_windows_cover_every_word(n):
    found = T.windows(np.arange(1, n + 1))
    assert found.shape[1] == T.WINDOW and set(found.ravel()) - {0} == set(range(1, n + 1))
    assert n <= T.WINDOW or (np.diff(found[:, 0]) <= T.STEP).all() and found[-1, -1] == n


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    net = T.Network(5, 5)
    net.p = {k: (v + 0.1 * rng.standard_normal(v.shape)).astype(np.float64) for k, v in net.p.items()}
    x, mask = rng.standard_normal((3, T.WINDOW, 3 + 2 * T.EMBEDDED)), np.ones((3, T.WINDOW), dtype=bool)
    mask[1, 5:] = False
    label, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        p = T.sigmoid(net.logits(net.gates(x), mask).astype(np.float64))
        return -(weight * (label * np.log(p) + (1 - label) * np.log(1 - p))).sum() / weight.sum()

    g, d_x = net.gradients(x, mask, label, weight)
    for name, one in [*((k, net.p[k]) for k in g), ("x", x)]:
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in one.shape)
            kept = one[at]
            one[at] = kept + 1e-3
            up = loss()
            one[at] = kept - 1e-3
            down = loss()
            one[at] = kept
            told = (d_x if name == "x" else g[name])[at]
            assert abs((up - down) / 2e-3 - told) < 2e-4 + 0.02 * abs(told), name


def planted(n, seed):
    """Documents of invented words; toxic ones hold words of three rude stems with any ending, or two rude words."""
    rng = random.Random(seed)
    part = lambda: rng.choice("ba de gi lo mu ne pa ri so ta ven zor".split())
    word = lambda: "".join(part() for _ in range(rng.randint(1, 4)))
    out = []
    for i in range(n):
        words, toxic = [word() for _ in range(rng.randint(10, 300))], i % 5 == 0
        for _ in range(2 * toxic):
            rude = rng.choice(["kwaag", "xolpf", "qirsh"]) + word() if i % 2 else rng.choice(["grumf", "plox"])
            words[rng.randrange(len(words))] = rude
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_held_out_accuracy(spark):
    docs = planted(1500, 3)
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in docs], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in T.score(df, labels).collect()}
    fresh = [(got[i]["predicted"], y) for i, _, y in docs if got[i]["held_out"]]
    assert len(fresh) > 200 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    toxic, clean = [p for p, y in fresh if y], [p for p, y in fresh if not y]
    assert sum(toxic) >= 0.95 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs = planted(300, 4)
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in docs], "doc_id long, toxic int")
    held = T.held_out()
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(T.sample(df, labels)) == sorted(T.sample(df, other))


def test_a_rude_word_is_found_wherever_it_stands():
    docs = planted(600, 5)
    scorer = T.Scorer(T.train([(t, y) for _, t, y in docs]))
    base = " ".join(planted(2, 6)[1][1].split() * 40).split()
    for at in (0, 7, 8, len(base) // 2, len(base) - 1):
        words = list(base)
        words[at : at + 1] = ["grumf", "plox"]
        clean, bad = scorer.scores([" ".join(base), " ".join(words)])
        assert clean < 0.5 <= bad


def test_edges(spark):
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (None, 1), (99, 1)], "doc_id long, toxic int")
    out = T.score(frame(spark), labels).collect()
    assert len(out) == len(rows()) and all(0 <= r["score"] <= 1 for r in out)
    assert {r["score"] for r in out if r["doc_id"] in (3, 4, 12)} == {0.0}
    assert [r["held_out"] for r in out if r["doc_id"] is None] == [False]
    assert T.score(empty(spark), labels).count() == 0
    none = T.score(frame(spark), labels.where("false")).collect()
    assert len(none) == len(rows()) and {r["score"] for r in none} == {0.0}
    ids = [2**53 + 1, None, 2**53 + 3]
    big = spark.createDataFrame([(i, "a text") for i in ids], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in T.score(big, labels).collect()} == set(ids)
