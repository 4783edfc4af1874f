import hashlib
import random
import re

import pytest
from feedloom.llm import substring


def brute(rows, size):
    words = [(d, [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - size + 1) if d is not None else ():
            key = tuple(w[i : i + size])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - size + 1):
            if d is not None and first[tuple(w[i : i + size])] < d:
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def corpus(size, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["é", "中文", "\x1c", " x"]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    passages = [some(rng.randint(size - 2, 3 * size)) for _ in range(15)]
    rows = []
    for d in range(120):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += rng.choice(passages) if rng.random() < 0.5 else some(rng.randint(0, 60))
        if rng.random() < 0.1:
            w = ["spam"] * rng.randint(0, 300)
        rows.append((d, rng.choice([" ", "\n", "  ", ""]) + rng.choice([" ", "\t "]).join(w)))
    rows += [(150, None), (151, ""), (152, rows[10][1]), (152, rows[11][1]), (11, rows[10][1]), (11, rows[10][1]), (None, rows[10][1])]
    rows += [(200 + i, " ".join(passages[0] + passages[1])) for i in range(40)]  # a large group of copies
    rows += [(300 + i, " ".join([f"own{i}", *passages[2], f"end{i}"])) for i in range(40)]  # a passage of many
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [50, 8, 2])
def test_equals_brute_force(spark, size):
    rows = corpus(size, size)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, k1 string")
    got = sorted(map(tuple, substring.remove_repeats(df, window=size, keep_text=True).collect()), key=str)
    assert got == brute(rows, size)


def test_small_batches_and_empty_table(spark):
    rows = corpus(20, 1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(map(tuple, substring.remove_repeats(df, window=20, keep_text=True).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rows, 20)
    assert substring.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("period", substring.COVERS)
def test_covers(period):
    cover = substring.COVERS[period]
    for a in range(period):
        assert any((d in cover) and ((d + a) % period in cover) for d in range(period))
