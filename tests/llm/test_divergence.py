import random
import re
from collections import Counter, defaultdict

import pytest
from feedloom.llm import divergence


def brute(rows, least=10, ranks=10):
    """rows: (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        n[lang, source].update(terms)
        docs[lang].update(set(terms))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, k in docs[lang].items() if k >= least)

        def shares(count):
            total = sum(count[t] for t in kept)
            return [1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept]

        p = {s: shares(n[lang, s]) for s in sources}
        q = shares(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum((a - b) ** 2 // (a + b) for a, b in zip(p[s], p[o], strict=True)), o) for o in sources if o != s]
            terms = [((a - b) ** 2 // (a + b), t) for a, b, t in zip(p[s], q, kept, strict=True) if n[lang, s][t] > 0 and a > b]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


def check(spark, rows, **limits):
    df = spark.createDataFrame([(k, *r, "clash", 1, 2) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n int, chunk int")
    got = divergence.audit(df, **limits)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert dict(got.dtypes)["value"] == "bigint"
    got = sorted(map(tuple, got.collect()))
    assert got == brute(rows, limits.get("least_docs", 10), limits.get("ranks", 10))
    return got


def corpus():
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in "abcXYZéß日" for b in "klmnÑ"]
    rows = []
    for _ in range(160):
        lang = rng.choice(["en", "en", "de", None])
        source = rng.choice(["hot"] * 4 + [f"s{k}" for k in range(7)] + [None, "é"])
        shift = len(source or "") * 5
        rows.append((" ".join(vocabulary[(rng.randrange(20) + shift) % len(vocabulary)] for _ in range(rng.randint(0, 30))) + rng.choice(["", ".", " 12 x"]), lang, source))
    rows += [(None, "en", "empty"), ("", "en", "empty2"), ("...", "fr", "only"), ("rare words", "it", "a"), ("none kept", "it", "b"), ("same same", "es", "a")]
    return rows + [("word " * 50, "en", "hot")] * 30 + [("tie one two", "pt", s) for s in "ab" for _ in range(6)]


@pytest.mark.parametrize("sizes", [None, (2, 4, 2), (3, 1, 1)])
def test_equals_brute_force(spark, monkeypatch, sizes):
    if sizes:
        for name, value in zip(("BLOCK", "CHUNK", "SPAN"), sizes, strict=True):
            monkeypatch.setattr(divergence, name, value)
    check(spark, corpus())
    check(spark, corpus(), least_docs=3, ranks=2)


def test_odd_tables(spark):
    assert check(spark, []) == []
    assert check(spark, [(None, None, None)]) == []
    assert check(spark, [("x " * 200_000, "en", "a"), ("y", "en", "b")], least_docs=1)
