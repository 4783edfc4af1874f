import random
import re
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest
from feedloom.llm import simhash


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return frozenset(" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, least=0.8):
    """Smallest doc_id reachable of each, and the linked pairs of different texts."""
    sets = [shingles(t) for _, t in rows]
    root = {d: d for d, _ in rows}
    pairs = set()

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] | sets[j])
        if not both or len(sets[i] & sets[j]) >= least * both - 1e-9:
            pairs.add((rows[i][0], rows[j][0]))
            a, b = find(rows[i][0]), find(rows[j][0])
            root[max(a, b)] = min(a, b)
    return {d: find(d) for d in root}, pairs


def corpus():
    rng = random.Random(4)
    line = " ".join(f"common{i}" for i in range(12))
    rows = []
    for _ in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 160))]
        for _ in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w) + " " + line))
    # a chain in which the first document is like the second alone
    w = [f"c{i}" for i in range(104)]
    for k in range(4):
        rows.append((len(rows), " ".join([*w[k * 9 :], *(f"d{i}" for i in range(k * 9))])))
    n = len(rows)
    return [*rows, (n, None), (n + 1, ""), (n + 2, "one"), (n + 3, "ONE"), (n + 4, line)]


@pytest.mark.parametrize("at_once", [1024, 3])
def test_groups_equal_brute_force(spark, monkeypatch, at_once):
    monkeypatch.setattr(simhash, "BAND_ROWS", at_once)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, pairs = brute(rows)
    assert len(pairs) > 30
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df).collect()}
    assert got == want


def test_near_dedup_stage_has_full_recall_and_leaves_the_rest(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, _ = brute(rows)
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()} == {d for d, c in want.items() if d == c}


def test_rows_without_id_stay_and_copies_go(spark):
    text = " ".join(map(str, range(40)))
    df = spark.createDataFrame([(2, text), (2, "other words"), (1, text), (None, text), (None, text)], "doc_id long, text string")
    assert [r["doc_id"] for r in simhash.first_of_groups(df).collect() if r["doc_id"] is not None] == [1]
    assert simhash.first_of_groups(df).count() == 3
    assert simhash.similar_documents(df.limit(0)).count() == 0


def test_equal_groups_of_shingles_make_equal_bands():
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64))
    b = np.concatenate([a[:-20], rng.integers(0, 2**64, 20, dtype=np.uint64)])
    both = [np.unique(x).view(np.int64) for x in (a, b, a[:250], a[:0], a[:1])]
    keys, bounds = simhash.bands_of(np.concatenate(both), np.concatenate([[0], np.cumsum([len(x) for x in both])]), 0.8)
    bands = [set(keys[p:q].tolist()) for p, q in zip(bounds[:-1], bounds[1:], strict=True)]
    assert [len(x) for x in bands[3:]] == [0, 1]
    assert all(simhash.BANDS - 1 <= len(x) <= 2 * simhash.BANDS for x in bands[:3])
    assert bands[0] & bands[1] and bands[0] & bands[2]


@pytest.mark.parametrize("pairs", [10, 4000])
def test_shared_items_equal_brute_force(pairs):
    rng = np.random.default_rng(pairs)
    sets = [np.unique(rng.integers(0, 400, rng.integers(0, 200))) for _ in range(60)]
    values, bounds = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    i, j = rng.integers(0, 60, (2, pairs))
    assert simhash.shared_items(values, bounds, i, j).tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]
