"""Density clusters against their definition: what holds together below every distance."""

import numpy as np
import pytest

from wakeline.operators import density as D


def blobs(seed, sizes, spread=0.05, noise=10, dim=6):
    rng = np.random.default_rng(seed)
    parts = [rng.standard_normal(dim) + spread * (k + 1) * rng.standard_normal((n, dim)) for k, n in enumerate(sizes)]
    x = np.concatenate([*parts, rng.standard_normal((noise, dim))])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def reach(x, samples):
    d = np.sqrt(np.maximum(2 - 2 * x @ x.T, 0))
    np.fill_diagonal(d, 0)
    core = np.sort(d, axis=1)[:, min(samples, len(x)) - 1]
    return core, np.maximum(np.maximum(d, core[:, None]), core[None]).round(12)


def parts_below(r, points, w):
    """Components of some points by reaches under w."""
    left, out = set(points), []
    while left:
        stack, seen = [left.pop()], set()
        while stack:
            i = stack.pop()
            seen.add(i)
            near = [j for j in left if r[i, j] < w]
            left -= set(near)
            stack += near
        out.append(sorted(seen))
    return out


def brute(x, samples, least):
    _, r = reach(x, samples)
    scale = lambda w: 1 / max(w, 1e-12)

    def cluster(points, birth):
        """(mass, points, children) of a cluster born at a scale."""
        mass, now = 0.0, points
        while True:
            inner = [r[i, j] for i in now for j in now if i < j]
            # The reach at which what is left last holds together.
            w = next(w for w in sorted(set(inner), reverse=True) if len(parts_below(r, now, w)) > 1)
            parts = parts_below(r, now, w)
            large = [p for p in parts if len(p) >= least]
            if len(large) > 1:
                mass += (scale(w) - birth) * len(now)
                return mass, points, [cluster(p, scale(w)) for p in large]
            mass += (scale(w) - birth) * sum(len(p) for p in parts if len(p) < least)
            if not large:
                return mass, points, []
            now = large[0]

    def best(c):
        inner = [best(k) for k in c[2]]
        total = sum(m for m, _ in inner)
        return (c[0], [c[1]]) if total <= c[0] else (total, [p for _, ps in inner for p in ps])

    return sorted(sorted(p) for k in cluster(list(range(len(x))), 0.0)[2] for p in best(k)[1])


def grouped(found):
    return sorted(sorted(np.flatnonzero(found == c).tolist()) for c in set(found.tolist()) - {-1})


@pytest.mark.parametrize("seed", range(4))
def test_clusters_equal_their_definition(spark, seed, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 16)
    x = blobs(seed, [18, 12, 9], spread=0.04 + 0.03 * seed)
    core = D.core_distances(spark, x, 4)
    want_core, r = reach(x, 4)
    assert np.allclose(core, want_core)
    tree = D.spanning_tree(spark, x, core)
    # Prim's way to the same weight.
    inside, rest, total = {0}, set(range(1, len(x))), 0.0
    while rest:
        w, j = min((r[i, j], j) for i in inside for j in rest)
        total, inside, rest = total + w, inside | {j}, rest - {j}
    assert len(tree) == len(x) - 1 and sum(w for w, _, _ in tree) == pytest.approx(total)
    assert grouped(D.chosen(len(x), tree, 5)) == brute(x, 4, 5)


def test_fit_names_clusters_and_leaves_outliers(spark):
    x = blobs(7, [30, 20], spread=0.02, noise=6)
    rows = [(2**53 + i, v.tolist()) for i, v in enumerate(x)] + [(1, None), (2, [0.0] * 6)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    topics, members = D.fit(df, least=8, samples=4)
    got = {r["id"]: r["topic"] for r in members.collect()}
    assert len(got) == len(rows) and got[1] is None and got[2] is None
    assert {got[2**53 + i] for i in range(30)} == {0} and {got[2**53 + i] for i in range(30, 50)} == {1}
    assert sum(got[2**53 + i] is None for i in range(50, 56)) >= 4
    assert sorted(r["topic"] for r in topics.collect()) == [0, 1]
    # Rows beyond the sample go to the nearest centroid.
    few = {r["id"]: r["topic"] for r in D.fit(df, least=6, samples=3, most=40)[1].collect()}
    assert len(few) == len(rows) and len({few[2**53 + i] for i in range(30)} - {None}) == 1


def test_copies_and_few_points(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(12)] + [(20 + i, [0.0, 1.0]) for i in range(12)], "id long, vector array<double>")
    got = {r["id"]: r["topic"] for r in D.fit(df, least=5, samples=3)[1].collect()}
    assert {got[i] for i in range(12)} == {0} and {got[20 + i] for i in range(12)} == {1}
    assert [r["topic"] for r in D.fit(df.limit(1))[1].collect()] == [None]
    assert D.fit(df.limit(0))[1].count() == 0
