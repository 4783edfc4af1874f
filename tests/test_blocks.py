"""Pairs found between blocks of posts equal brute force, whatever the blocks are, and lists are not shuffled."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from feedloom.operators import blocks as K
from feedloom.operators import similar as A


def texts(seed, n):
    """Lists of terms with hot, common and rare ones, copies, near copies, empty ones, and sets of items beside them."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        base = [int(60 * rng.random() ** 3) * 7 - 100 for _ in range(rng.choice([0, 1, 3, 20, 60]))]
        items = [rng.randrange(8) for _ in range(rng.choice([0, 1, 2, 5]))]
        if out and rng.random() < 0.5:
            base, items = list(rng.choice(out)[1]), list(rng.choice(out)[2])
            if rng.random() < 0.7:
                base.append(rng.randrange(900, 999))
        out.append((i * 3 % 997, base, items))
    return out


def brute(rows, mix, least):
    df, n, vectors = {}, len(rows), {}
    for _, t, _s in rows:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    first = {}
    for i, t, s in sorted(rows):
        first.setdefault((tuple(sorted(t)), frozenset(s) if mix < 1 else None), i)
        w = {x: t.count(x) * (math.log((1 + n) / (1 + df[x])) + 1) for x in t}
        norm = math.sqrt(sum(v * v for v in w.values()))
        vectors[i] = {x: v / norm for x, v in w.items()}, set(s)
    heads, out = sorted(first.values()), {}
    for k, a in enumerate(heads):
        for b in heads[k + 1 :]:
            (v, s), (w, u) = vectors[a], vectors[b]
            value = mix * sum(x * w.get(t, 0) for t, x in v.items()) + ((1 - mix) * len(s & u) / len(s | u) if s | u and mix < 1 else 0)
            if value >= least - 1e-9:
                out[a, b] = value
    return out, set(heads)


@pytest.mark.parametrize(("mix", "least", "terms", "posts", "sums"), [(1.0, 0.8, 200, 9, 40), (1.0, 0.4, 1 << 20, 1 << 20, 1 << 20), (0.5, 0.8, 90, 11, 7), (0.5, 0.5, 1000, 30, 64), (0.9, 0.7, 300, 16, 100)])
def test_any_blocks_find_what_brute_force_does(tmp_path, monkeypatch, mix, least, terms, posts, sums):
    for name, value in {"BLOCK_TERMS": terms, "BLOCK_POSTS": posts, "SUMS": sums, "PRODUCTS": sums}.items():
        monkeypatch.setattr(K, name, value)
    rows, folder = texts(int(10 * least), 150), str(tmp_path)
    lists = lambda k: pa.array([r[k] for r in rows], pa.list_(pa.int64()))
    batch = pa.record_batch({"id": pa.array([r[0] for r in rows]), "t": lists(1), "n": pa.array([[]] * len(rows), pa.list_(pa.float64())), "items": lists(2) if mix < 1 else pa.array([[]] * len(rows), pa.list_(pa.int64()))})
    docs = [r for b in K._packed(folder, False)([batch.slice(0, 70), batch.slice(70)]) for r in b.to_pylist()]
    expected, heads = brute(rows, mix, least)
    sizes = {}
    for r in docs:
        sizes.setdefault(r["block"], []).append((r["terms"] + r["items"], r["id"] in heads))
    groups = K._grouped([(name, sum(s for s, h in v if h), sum(h for _, h in v), sum(s for s, _ in v)) for name, v in sizes.items()])
    assert sorted(name for g in groups for name in g) == sorted(sizes)
    n = len(groups)
    counted = [r for b in K._numbered(folder, groups)([pa.record_batch({"id": pa.array(range(n))})]) for r in b.to_pylist()]
    df = {}
    for r in counted:
        df[r["t"]] = df.get(r["t"], 0) + r["c"]
    for g, names in enumerate(groups):
        own = [(g, r["t"], df[r["t"]]) for r in counted if r["g"] == g]
        own += [(g, r["place"], -1 - names.index(r["block"])) for r in docs if r["block"] in names and r["id"] in heads]
        K._settled(folder, groups)(pa.table({c: pa.array([r[k] for r in own], pa.int64()) for k, c in enumerate(("g", "t", "df"))}))
    found = [r for b in K._compared(folder, n, 2, len(rows), mix, least)([pa.record_batch({"id": pa.array(range(len(K._tasks(n, 2))))})]) for r in b.to_pylist()]
    got = {(r["a"], r["b"]): r["value"] for r in found}
    # a post without terms or items has no pair, so it is none of the heads that count
    assert len(got) == len(found) and got == pytest.approx(expected)


def test_what_is_behind_is_never_less_than_it_is():
    rng = np.random.default_rng(0)
    size = rng.integers(0, 40, 3000)
    code = np.concatenate([np.sort(rng.choice(50, s, replace=False)) for s in size])
    block = {"t_known": np.arange(50), "t_df": np.full(50, 8), "t": code, "at": np.append(0, np.cumsum(size)), "n": 10.0 ** rng.integers(-6, 3, len(code))}
    s = K._weighed(block, None, 0.8)
    for i in range(len(size)):
        w = s.w[s.at[i] : s.at[i + 1]]
        left = np.sqrt(np.cumsum((w * w)[::-1])[::-1])
        assert (s.behind[s.at[i] : s.at[i + 1]] >= left).all() and (s.behind[s.at[i] : s.at[i + 1]] <= left + 1e-4).all()


def shuffled(spark):
    sc = spark.sparkContext
    none = sc._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("run", [lambda p: A.similar_by_terms_and_entities(p, 0.5, 0.3), lambda p: A.similar_by_terms(p, 0.3)], ids=["terms and entities", "terms"])
def test_lists_and_candidates_are_not_shuffled(spark, run):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=7)) for _ in range(2000)]
    rows = [(i, " ".join(rng.choices(words, k=300))) for i in range(400)]
    posts = spark.createDataFrame(rows, "id long, text string").repartition(2).cache()
    posts.count()
    before = shuffled(spark)
    run(posts).count()
    assert shuffled(spark) - before < 300_000
