import hashlib
import math

import pytest
from feedloom.llm import mixing
from pyspark.sql import functions as F


def uniform(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16) / 2**48


def poisson(u, mean):
    k, term = 0, math.exp(-mean)
    below = term
    while u >= below and k < mean + 12 * math.sqrt(mean) + 24:
        k += 1
        term *= mean / k
        below += term
    return k


def test_draws_equal_brute_force(spark):
    rows = [(i, f"t{i}", "big" if i % 3 else f"s{i % 4}") for i in range(400)] + [(None, "n", None), (7, "again", "big"), (7, "again", "big")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, copy int")
    got = mixing.mix(df, power=0.5, seed=9).collect()
    n = {}
    for r in rows:
        n[r[2]] = n.get(r[2], 0) + 1
    total = sum(math.sqrt(x) for x in n.values())
    want = []
    for i, t, s in rows:
        mean = math.sqrt(n[s]) / total * len(rows) / n[s]
        key = "null" if i is None else str(i)
        for c in range(1, poisson(uniform(f"9:{key}:1"), mean) + 1):
            want.append((str(i), t, str(s), c, uniform(f"9-place:{key}:{c}")))
    assert sorted((str(r["doc_id"]), r["text"], str(r["source"]), r["copy"], r["shuffle_key"]) for r in got) == sorted(want)
    assert [r["shuffle_key"] for r in got] == sorted(r["shuffle_key"] for r in got)


def test_weights_and_large_means(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") < 30, "rare").when(F.col("id") < 60, "out").otherwise("common").alias("source"))
    got = {r["source"]: r["count"] for r in mixing.mix(df, {"rare": 1.0, "common": 1.0}, total=20000).groupBy("source").count().collect()}
    assert set(got) == {"rare", "common"}
    assert all(abs(v - 10000) < 600 for v in got.values())  # six deviations
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df, {}).count() == 0
    with pytest.raises(ValueError, match="weights"):
        mixing.mix(df, {"rare": -1.0})


def test_clashing_columns_stay(spark):
    rows = [(i, "t", "a" if i % 5 else "b", 7.0, "m", 3, "s", 4, 5, 6, 8) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __copies double, __mean string, __source int, mean string, mean_0 int, copies_0 int, source_0 int, weight int")
    got = mixing.mix(df, seed=3)
    assert got.columns == [*df.columns, "copy", "shuffle_key"]
    found = got.collect()
    assert found and all(tuple(r)[3:11] == rows[0][3:] for r in found)
    plain = mixing.mix(df.select("doc_id", "text", "source"), seed=3)
    assert sorted((r["doc_id"], r["copy"]) for r in found) == sorted((r["doc_id"], r["copy"]) for r in plain.collect())
