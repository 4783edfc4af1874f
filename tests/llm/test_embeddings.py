import math

import numpy as np
import pytest

from feedloom.llm import embeddings as em


def test_bounds_hold_for_every_pair():
    rng = np.random.default_rng(0)
    for dims in (1, 3, 64, 1500):
        x = rng.normal(size=(60, dims)) * 10.0 ** rng.integers(-20, 20, (60, 1))
        a = em.Quantised(x)
        true = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
        near = a.product(slice(0, 60), a) * a.scale[:, None] * a.scale[None, :]
        assert (np.abs(true - near) <= a.error[:, None] + (1 + a.error[:, None]) * a.error[None, :]).all()
        assert (a.product(slice(0, 60), a) == a.q.astype(np.int64) @ a.q.astype(np.int64).T).all()


def rows():
    rng = np.random.default_rng(4)
    out = []
    for c in range(25):
        v = rng.normal(size=8)
        for _ in range(int(rng.integers(1, 12))):
            out.append((len(out), (v + rng.normal(size=8) * rng.choice([0, 0.03, 0.1, 0.4])).tolist(), int(c % 3)))
    n = len(out)
    out += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 8, 1), (n + 3, [1.0, None] + [0.0] * 6, 1), (n + 4, [math.nan] * 8, 1), (n + 5, [math.inf] * 8, 1)]
    out += [(n + 6, out[0][1], None), (n + 7, out[0][1], None), (n + 8, [1.0, 2.0], 1), (n + 9, [1.0, 2.0], 1), (None, out[0][1], 0)]
    return out


def good(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def test_links_equal_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(*r, 7) for r in data], "vec_id long, embedding array<double>, label int, n_links int")
    for tile in (4096, 9):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in em.near_embeddings(df, 0.98, tile=tile).collect()}
        n = len(data)
        root = list(range(n))
        links = [0] * n

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        fit = lambda r: r[0] is not None and r[2] is not None and good(r[1]) and any(r[1])
        for i in range(n):
            for j in range(i + 1, n):
                a, b = data[i], data[j]
                if fit(a) and fit(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                    x, y = np.array(a[1]), np.array(b[1])
                    if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                        links[i] += 1
                        links[j] += 1
                        p, q = find(i), find(j)
                        root[max(p, q)] = min(p, q)
        want = {data[i][0]: (links[i], data[find(i)][0], data[i][0] is not None and find(i) == i) for i in range(n)}
        assert got == want
    assert em.near_embeddings(df.limit(0)).count() == 0


def test_top_k_equals_brute_force(spark):
    data = [r for r in rows() if r[0] is not None]
    data += [(1000 + i, data[3][1], 0) for i in range(30)]  # ties
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    for shard, block in ((16384, 1024), (20, 3)):
        got = sorted(map(tuple, em.top_k(df, 5, 7, shard=shard, block=block).collect()))
        ints = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in data if good(v)]
        want = []
        for i, q in ints:
            if i % 7 == 0:
                best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in ints if j != i and len(v) == len(q))[:5]
                want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
        assert got == sorted(want)
    assert em.top_k(df.limit(0)).count() == 0


def test_max_score_prunes_and_keeps_all(monkeypatch):
    monkeypatch.setattr(em, "SCAN", 50)
    rng = np.random.default_rng(2)
    x = rng.integers(-50, 50, (24, 700))
    for _ in range(20):
        q = rng.integers(-50, 50, 24)
        s, i = em.max_score(x, np.arange(700), q, 13, 10)
        every = [(-int(q @ x[:, c]), c) for c in range(700) if c != 13]
        assert [(-a, b) for a, b in zip(s, i, strict=True)] == sorted(every)[:10]


def test_a_vec_id_with_several_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.001], 1)], "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in em.near_embeddings(df).select("vec_id", "n_links", "component_id").collect())
    assert got == [(1, 0, 1), (1, 1, 1), (2, 1, 1)]


def test_large_components_are_summed_exactly(spark):
    """Also beyond 64 bits, and in more than 2048 dimensions; a score that no long holds is the nearest one."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-(1 << 20), 1 << 20, 3)]) for i in range(40)]
    rows += [(100, [1e6, 65536.5, -3.0]), (200, [2.0**40 + 0.25, 1.0, -(2.0**33)]), (300, [1e300, -1e-300, 0.1]), (301, [-1e300, 1.0, 1.0]), (400, [1e308, 0.0, 1.0])]
    rows += [(500 + i, [70000.0 + i] * 3000) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = lambda x: int(x) * 1024 if abs(x) >= 2**53 else math.floor(1024 * x)
    ints = [(i, [whole(x) for x in v]) for i, v in rows]
    want = []
    for i, q in ints:
        if i % 100 == 0:
            scores = [(max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v, strict=True)))), j) for j, v in ints if j != i and len(v) == len(q)]
            want += [(i, r + 1, j, s) for r, (s, j) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:10])]
    for shard, block in ((16384, 1024), (7, 2)):
        assert sorted(map(tuple, em.top_k(df, shard=shard, block=block).collect())) == sorted(want)
