import random

import numpy as np
import pytest
import xxhash

from wakeline.llm import simhash as S

from .cases import empty, frame, rows


def slow_print(text):
    w = (text or "").encode().lower().split()
    n = max(1, len(w) - 2) if w else 0
    bits = [0] * 64
    for i in range(n):
        h = xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > n)


def slow_groups(prints):
    """Least node reachable over links, by comparing all."""
    f = np.array([p & (1 << 64) - 1 for p in prints], dtype=np.uint64)
    root = list(range(len(f)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(f)):
        for j in np.nonzero(np.bitwise_count(f ^ f[i]) <= 2)[0]:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(f))]


def test_golay_code_is_perfect():
    low, high, leader = S._golay_tables()
    assert len(set(leader.tolist())) == 2048
    index = S.golay_indices(np.arange(1 << 23, dtype=np.int64)[:: 4099])
    assert set((index >= 0).sum(axis=1).tolist()) == {1, 6}


def test_two_errors_always_share_a_key():
    rng = random.Random(5)
    tables = S._golay_tables()
    for _ in range(400):
        a = rng.getrandbits(64)
        b = a ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        row, key = S.fuzzy_keys(np.array([a, b], dtype=np.uint64), tables)
        assert set(key[row == 0]) & set(key[row == 1])


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("pairs_up_to", [64, 2])
def test_components_against_brute_force(spark, pairs_up_to):
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(40)]
    # Chains: each next one bit or two away, so that ends of a group are far apart; and balls.
    for start in range(5):
        x = prints[start]
        for _ in range(30):
            x ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            prints.append(x)
    prints += [prints[7] ^ 1 << b for b in range(64)]
    df = spark.createDataFrame([(signed(p), i) for i, p in enumerate(prints)], "fp long, node long").dropDuplicates(["fp"])
    from wakeline.operators.components import components

    roots = {r["node"]: r["root"] for r in components(S.links(df, pairs_up_to)).collect()}
    known = {signed(p): n for n, p in reversed(list(enumerate(prints)))}
    kept = {r["fp"]: r["node"] for r in df.collect()}
    expected = slow_groups(prints)
    groups = {}
    for i, p in enumerate(prints):
        groups.setdefault(expected[i], set()).add(roots.get(kept[signed(p)], kept[signed(p)]))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)
    assert known


def test_documents_against_brute_force(spark):
    out = {r["doc_id"]: r for r in S.digest(S.near_duplicates(frame(spark))).collect()}
    texts = {r[0]: r[1] for r in rows()}
    for i, t in texts.items():
        assert out[i]["fingerprint"] == f"{slow_print(t):016x}"
    assert out[1]["component_id"] == out[2]["component_id"] == 1
    # No words: fingerprint zero, one group of its own.
    assert {out[i]["component_id"] for i in (3, 4, 12)} == {3}
    assert S.near_duplicates(empty(spark)).count() == 0
    assert S.near_duplicates(frame(spark)).count() == len(rows())
