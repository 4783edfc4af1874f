"""Joins with tables of terms and domains."""

import random
import re

from feedloom.operators import terms as T
from pyspark.sql import functions as F


def test_hosts_below_domains(spark):
    rows = spark.createDataFrame([(1, "a.b.c"), (2, "b.c"), (3, "xb.c"), (4, "c"), (5, ""), (6, None), (7, "a.b.c:80"), (8, "..c")], "id long, host string")
    domains = spark.createDataFrame([("B.c",), ("c",), ("",), (None,), ("b.c",), ("other",)], "domain string")
    got = T.under_domains(rows, F.col("host"), domains)
    assert got.columns == ["id", "host", "domain"]
    assert sorted((r["id"], r["domain"]) for r in got.collect()) == [(1, "b.c"), (1, "c"), (2, "b.c"), (2, "c"), (3, "c"), (4, "c"), (8, "c")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_hundred_thousand_terms(spark):
    rng = random.Random(3)
    listed = [f"t{i:05d}" for i in range(99_990)] + ["Grüße", "new york", "c++", "_x", "ab", "abc", "b", "日本", "9", "a.b"]
    pieces = [*rng.sample(listed, 400), "GRÜSSE", "grüße", "new york", "new  york", "c++", "c+++", "x_x", "_x", "abc", "ab", "xab", "日本", "日本語", "9", "99", "a.b", "aab"]
    docs = [(i, rng.choice(["", "«", "-"]).join(x + rng.choice([" ", ", ", "/", ""]) for x in rng.choices(pieces, k=30))) for i in range(60)] + [(60, ""), (61, None), (62, "b")]
    df, terms = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame([(t,) for t in [*listed, None, ""]], "term string")
    whole = sorted(map(tuple, T.contained_terms(df, terms).collect()))
    assert whole == sorted(map(tuple, T.contained_terms(df, terms, shard_bytes=8 << 20).collect()))  # three passes
    some = sorted({t.lower() for t in [*rng.sample(listed, 40), *pieces[:40], *listed[-10:]]} & {t.lower() for t in listed})
    want = [(i, t) for i, text in docs for t in some if re.search(rf"(?<!\w){re.escape(t)}(?!\w)", (text or "").lower())]
    assert len(want) > 50 and sorted(x for x in whole if x[1] in set(some)) == sorted(want)
    assert T.contained_terms(df, terms.limit(0)).count() == 0
