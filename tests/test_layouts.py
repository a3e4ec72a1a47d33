import numpy as np

from wakeline.operators import layouts as L

from .test_density import blobs


def frame_of(spark, seed=3):
    x = blobs(seed, [40, 40, 40], spread=0.02, noise=0)
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")


def test_neighbours_stay_near_and_reruns_agree(spark):
    x, df = frame_of(spark)
    first, again = ({r["id"]: (r["x"], r["y"]) for r in L.fit(d).collect()} for d in (df, df.repartition(3)))
    assert first == again and len(first) == len(x)
    at = np.array([first[i] for i in range(len(x))])
    d = np.linalg.norm(at[:, None] - at[None], axis=2)
    np.fill_diagonal(d, np.inf)
    same = np.arange(len(x)) // 40
    assert (same[d.argsort(axis=1)[:, :10]] == same[:, None]).mean() > 0.95
    near = np.argsort(2 - 2 * x @ x.T, axis=1)[:, 1:11]
    kept = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(near, d.argsort(axis=1)[:, :10], strict=True)])
    assert kept > 0.35  # by chance within a blob 0.25


def test_new_rows_go_among_their_kind_and_move_nothing(spark):
    x, df = frame_of(spark)
    frame = L.fit(df.where("id % 4 > 0"))
    before = sorted(tuple(r) for r in frame.select("id", "x", "y").collect())
    got = {r["id"]: (r["x"], r["y"]) for r in L.place(df.where("id % 4 = 0"), frame).collect()}
    alone = {r["id"]: (r["x"], r["y"]) for r in L.place(df.where("id = 8"), frame).collect()}
    assert alone[8] == got[8] and sorted(tuple(r) for r in frame.select("id", "x", "y").collect()) == before
    ids, at = np.array([b[0] for b in before]), np.array([b[1:] for b in before])
    right = [np.bincount(ids[np.linalg.norm(at - p, axis=1).argsort()[:5]] // 40, minlength=3).argmax() == i // 40 for i, p in got.items()]
    assert np.mean(right) > 0.95
    held = {r["id"]: (r["x"], r["y"]) for r in L.place(df.where("id = 1"), frame).collect()}
    assert (1, *held[1]) in before


def test_edges(spark):
    odd = spark.createDataFrame([(2**53 + 1, None), (None, [1.0, 0.0]), (5, [0.0, 0.0])], "id long, vector array<double>").coalesce(1)
    frame = L.fit(odd)
    assert [(r["id"], r["x"], r["y"]) for r in frame.collect()] == [(None, 0.0, 0.0)]
    got = {r["id"]: r["x"] for r in L.place(odd, frame).collect()}
    assert got == {2**53 + 1: None, None: 0.0, 5: None}
    assert L.fit(odd.limit(0)).count() == 0 and {r["x"] for r in L.place(odd, L.fit(odd.limit(0))).collect()} == {None}
