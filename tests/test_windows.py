"""Counters of hot keys, dealt out by time, equal those of ordinary keys and a walk in plain Python."""

import random

import pytest
from feedloom.operators import windows as V


def events():
    rng = random.Random(7)
    rows, t = [], 0.0
    for i in range(900):
        t += rng.choice([0, 0, 0.25, 1, 3, 20, 400])
        rows.append((rng.choice(["hot"] * 9 + ["cold", None]), t, i, f"m{rng.randrange(6)}"))
    rows += [("same", 50.0, 2000 + i, "m") for i in range(60)]  # all at one time
    rng.shuffle(rows)
    return rows


def walk(rows, ttl):
    """(anchored start, anchored number, seen, rolling number) by event."""
    out, start, n, seen, last, run = {}, {}, {}, {}, {}, {}
    for key, t, i, member in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in start or t >= start[key] + ttl:
            start[key], n[key], seen[key] = t, 0, set()
        n[key] += 1
        run[key] = 1 if key not in last or t - last[key] >= ttl else run[key] + 1
        last[key] = t
        out[i] = (start[key], n[key], member in seen[key], run[key])
        seen[key].add(member)
    return out


@pytest.mark.parametrize(("hot", "ttls"), [(10**9, (10.0, 333.0)), (40, (333.0,))])
def test_windows_equal_the_walk(spark, monkeypatch, hot, ttls):
    monkeypatch.setattr(V, "HOT_EVENTS", hot)
    rows = events()
    df = spark.createDataFrame(rows, "key string, t double, id long, member string").repartition(3)
    for ttl in ttls:
        want = walk(rows, ttl)
        got = {r["id"]: r["start"] for r in V.anchored(df, ["key"], "t", ["id"], ttl, "start").collect()}
        assert got == {i: w[0] for i, w in want.items()}
        for f, place in ((V.anchored_count, 1), (V.rolling_count, 3)):
            out = f(df, ["key"], "t", ["id"], ttl, "n")
            assert out.columns == [*df.columns, "n"]
            assert {r["id"]: r["n"] for r in out.collect()} == {i: w[place] for i, w in want.items()}
        seen = V.seen_before(df, ["key"], "member", "t", ["id"], ttl, "seen")
        assert {r["id"]: r["seen"] for r in seen.collect()} == {i: w[2] for i, w in want.items()}


def test_one_key_uses_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(V, "HOT_EVENTS", 100)
    df = spark.range(4000).selectExpr("'k' AS key", "id * 1.0D AS t", "id")
    rows = V._in_stretches(df, ["key"], "t", ["id"])
    sizes = [r["count"] for r in rows.groupBy("__part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2000
    assert V.anchored_count(df.limit(0), ["key"], "t", ["id"], 5.0, "n").count() == 0
