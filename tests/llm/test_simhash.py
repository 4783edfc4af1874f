import random
import re

import numpy as np
import pytest
import xxhash
from feedloom.llm import common, simhash


def fingerprint(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def roots(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def corpus():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(200)] + ["É", "Straße", "UPPER"]
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(0, 250))]
        for _ in range(rng.randint(1, 4)):
            w = list(base)
            if w and rng.random() < 0.6:
                w[rng.randrange(len(w))] = "changed"
            rows.append((len(rows), rng.choice([" ", "\n\t "]).join(w)))
    n = len(rows)
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one"), (n + 4, "ONE"), (None, rows[0][1]), (None, "only null")]


@pytest.mark.parametrize(("shingle", "budget"), [(3, 3), (5, 7)])
def test_classes_equal_brute_force(spark, shingle, budget):
    rows = corpus()
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, fp int")
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(df, shingle, budget).collect()}
    fps = [fingerprint(t, shingle) for _, t in rows]
    known = [k for k, r in enumerate(rows) if r[0] is not None]
    pairs = [(a, b) for a in known for b in known if a < b and (fps[a] ^ fps[b]).bit_count() <= budget]
    root = roots(len(rows), pairs)
    for k in known:
        assert got[rows[k][0], f"{fps[k]:016x}"] == rows[root[k]][0]
    assert got[None, f"{fps[-2]:016x}"] == rows[root[0]][0]
    assert got[None, f"{fps[-1]:016x}"] is None
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize(("budget", "hot"), [(0, 20000), (3, 20000), (3, 30), (7, 100), (6, 20000)])
def test_trie_join_equals_brute_force(spark, monkeypatch, budget, hot):
    monkeypatch.setattr(simhash, "HOT_NODE", hot)
    rng = np.random.default_rng(budget)
    values = set()
    for b in [*rng.integers(0, 2**63, 40, dtype=np.uint64), *[np.uint64(7)] * 12]:
        for _ in range(12):
            x = int(b)
            for bit in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(bit)
            values.add(x)
    fps = np.array(sorted(values), np.uint64)
    rng.shuffle(fps)
    df = spark.createDataFrame([(i, int(x.astype(np.int64))) for i, x in enumerate(fps)], "node long, fp long")
    links = [tuple(r) for r in simhash.near_links(df, budget).collect()]
    assert all((int(fps[a]) ^ int(fps[b])) >= 0 for a, b in links)
    i, j = np.triu_indices(len(fps), 1)
    near = np.bitwise_count(fps[i] ^ fps[j]) <= budget
    assert roots(len(fps), links) == roots(len(fps), zip(i[near].tolist(), j[near].tolist(), strict=True))


def test_components_of_a_path_and_of_stars(spark):
    path = [(i, i - 1) for i in range(1, 60)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    df = spark.createDataFrame([*path, *star, (5, 5), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in common.components(df).collect()}
    assert got == {**{i: 0 for i in range(1, 60)}, **{1000 + i: 1000 for i in range(1, 50)}}


def test_components_that_do_not_settle_are_no_result(spark):
    df = spark.createDataFrame([(i, i - 1) for i in range(1, 200)], "a long, b long")
    with pytest.raises(RuntimeError, match="settled"):
        common.components(df, most_rounds=1)
