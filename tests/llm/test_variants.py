import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from feedloom.llm import variants

COLUMNS = "doc_id long, text string, word string, near int"


def words_of(rows, least_n=3):
    found = Counter()
    for doc_id, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            found[run[:at] + run[at + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= least_n}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(words):
    near = defaultdict(list)
    for a in words:
        for b in words:
            if a != b and one_apart(a, b):
                near[a].append(b)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items())


def check(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], COLUMNS)
    got = sorted(map(tuple, variants.group_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])
    assert got == brute(words_of(rows))
    return got


def corpus(seed=3):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abéÿz") for _ in range(rng.randint(5, 9))) for _ in range(12)] + ["aaaaa", "ÀÉÎÕÜ" * 3, "aaaaaa"]
    rows = []
    for d in range(60):
        words = []
        for _ in range(rng.randint(0, 40)):
            w = rng.choice(base)
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                k, c = rng.randrange(len(w) + 1), rng.choice("abz")
                w = rng.choice([w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((d, " ".join(words) + rng.choice([".", "1", "-x"])))
    rows += [(100 + k, w) for k, w in enumerate(["qqqqq"] * 3 + ["qqqqw"] * 6 + ["qqqww"] * 12 + ["qqwww"] * 24)]
    return rows + [(None, "aaaaa aaaab aaaaa"), (5, None), (5, ""), (6, "aaaaa"), (6, "aaaaa"), (7, "×÷×÷× " * 4 + "w" * 3000 + " ")]


@pytest.mark.parametrize("shard", [1 << 15, 7])
def test_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(variants, "SHARD_WORDS", shard)
    got = check(spark, corpus())
    assert sum(r[1] is not None for r in got) > 10 and any(r[1] and r[1] != r[2] for r in got)


def test_odd_tables(spark):
    long = "ab" * 1500
    assert check(spark, []) == []
    assert check(spark, [(1, None), (2, "")]) == []
    got = check(spark, [(k, f"{long}x {long}") for k in range(4)] + [(9, long)])
    assert len(got) >= 2 and max(r[4] for r in got) >= 1


def test_wavelet_tree_reports_rectangles():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 64, 200):
        values = rng.permutation(n)
        tree = variants.WaveletTree(values)
        left, low = rng.integers(0, n, 50), rng.integers(0, n, 50)
        right, high = left + rng.integers(0, n, 50).clip(max=n - left), low + rng.integers(0, n, 50)
        got = sorted(zip(*map(list, tree.report(left, right, low, high)), strict=True))
        want = [(q, v) for q in range(50) for v in values[left[q] : right[q]] if low[q] <= v < high[q]]
        assert [tuple(map(int, x)) for x in got] == sorted((q, int(v)) for q, v in want)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_query_equals_deletion_neighbourhoods(spark):
    from feedloom.llm.queries import op12_spelling_variants

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    words = words_of([tuple(r) for r in docs])
    cuts = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            cuts[w[:k] + w[k + 1 :]].add(w)
    got = op12_spelling_variants(spark, "/root/testdata/sf0.001").collect()
    assert {r["word"]: r["n"] for r in got} == words
    for r in got:
        w = r["word"]
        maybe = cuts[w] | {x for k in range(len(w)) for x in cuts[w[:k] + w[k + 1 :]]} | {w[:k] + w[k + 1 :] for k in range(len(w))}
        near = [x for x in maybe if x in words and one_apart(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        assert r["n_near"] == len(near)
        assert r["form"] == (best if best is not None and words[best] >= 2 * words[w] else None)
