"""Similarity joins above a threshold equal brute force over all posts."""

import math
import random

import pytest
from feedloom.operators import similar as A


def corpus():
    rng = random.Random(2)
    vectors, sets = {}, {}
    for i in range(0, 160, 2):
        base = rng.sample(range(60), rng.randint(1, 12))
        vectors[i] = {f"t{t}": rng.choice([0.5, 1.0, 3.0]) for t in base}
        if rng.random() < 0.8:
            near = dict(vectors[i])
            near[f"t{rng.randrange(60)}"] = rng.choice([0.1, 1.0])
            vectors[i + 1] = near
        if rng.random() < 0.7:
            sets[i] = {f"e{rng.randrange(12)}" for _ in range(rng.randint(1, 4))}
            sets[i + 1] = sets[i] | ({"e99"} if rng.random() < 0.5 else set())
    for i in range(500, 700):  # copies
        vectors[i], sets[i] = vectors[0], {"e1", "e2"}
    return vectors, sets


def cosine(a, b):
    return sum(x * b[t] for t, x in a.items() if t in b) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())) if a and b else 0.0


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def brute(ids, key, measure, least):
    first, out = {}, {}
    for i in sorted(ids):
        first.setdefault(key(i), i)
    heads = sorted(first.values())
    for i in ids:
        if (h := first[key(i)]) != i and measure(h, i) >= least - 1e-9:
            out[h, i] = measure(h, i)
    for x, a in enumerate(heads):
        for b in heads[x + 1 :]:
            if measure(a, b) >= least - 1e-9:
                out[a, b] = measure(a, b)
    return out


@pytest.mark.parametrize("least", [0.3, 0.7])
def test_joins_equal_brute_force(spark, least):
    vectors, sets = corpus()
    w = spark.createDataFrame([(i, t, x) for i, v in vectors.items() for t, x in v.items()], "id long, term string, weight double")
    e = spark.createDataFrame([(i, t) for i, s in sets.items() for t in s], "id long, entity string")
    vkey, skey = (lambda i: tuple(sorted(vectors.get(i, {}).items()))), (lambda i: tuple(sorted(sets.get(i, ()))))
    cos, jac = (lambda a, b: cosine(vectors.get(a, {}), vectors.get(b, {}))), (lambda a, b: jaccard(sets.get(a, set()), sets.get(b, set())))
    got = {(r["a"], r["b"]): r["cosine"] for r in A.similar_texts(w, least).collect()}
    assert got == pytest.approx(brute(vectors, vkey, cos, least)) and len(got) < 1200
    got = {(r["a"], r["b"]): r["jaccard"] for r in A.similar_entities(e, least).collect()}
    assert got == pytest.approx(brute(sets, skey, jac, least))
    both = A.similar_posts(w, e, 0.5, least).collect()
    got = {(r["a"], r["b"]): r["similarity"] for r in both}
    assert len(got) == len(both)
    assert got == pytest.approx(brute({*vectors, *sets}, lambda i: (vkey(i), skey(i)), lambda a, b: 0.5 * cos(a, b) + 0.5 * jac(a, b), least))


def test_nothing_is_similar_to_nothing(spark):
    w, e = spark.createDataFrame([], "id long, term string, weight double"), spark.createDataFrame([], "id long, entity string")
    assert A.similar_posts(w, e, 0.5, 0.5).count() == 0
