"""The cycle as a running job."""

from feedloom.operators import cycle
from feedloom.sources.store import Store
from feedloom.streaming import service
from pyspark.sql import functions as F

NOW = 1_000_000


def test_rounds_process_rank_and_forget(spark, tmp_path):
    texts = ["what a great linux browser", "happy love for museum music", "nice win for the fun day", "sad awful trash", "great fun"]
    rows = [(i, "mastodon", f"u{i}", f"{texts[i % 5]} {'abcdefghijkl'[i]}", "en", '{"in_reply_to_id":"7"}' if i % 5 == 4 else "{}", NOW - i * 60) for i in range(12)]
    posts = spark.createDataFrame(rows, "id long, source string, author_id string, text string, lang string, raw_json string, created_s long")
    raw = Store.of(posts, f"file://{tmp_path}/raw", ["id"], 2)
    done = Store.create(spark, f"file://{tmp_path}/processed", service.PROCESSED, ["id"], 2)
    blocked = spark.createDataFrame([("mastodon", "u6")], "source string, author_id string")
    room, beats, waits, now = [True], [], [], [float(NOW)]

    def score(found, at):
        return cycle.scored(found, blocked, [], [], F.lit("en"), F.lit(0.9), F.lit(at).cast("long")).select(*(c.split()[0] for c in service.PROCESSED.split(", ")[:-2]))

    job = service.Service(raw, done, score, lambda: room[0], beats.append, {**service.EVERY, "refresh": 100.0}, batch=8)

    def sleep(s):
        waits.append(s)
        now[0] += s

    job.run(clock=lambda: now[0], sleep=sleep, rounds=2)
    assert waits == [service.BACKLOG]
    assert [(b["read"], b["processed"], b["filtered"]) for b in beats] == [(8, 6, 2), (4, 3, 1)]
    assert beats[0]["stages"] == ["guard", "score", "refresh", "retention"] and beats[1]["stages"] == ["score"]
    assert {r["id"] for r in raw.rows().collect()} == {r["id"] for r in done.rows().collect()} == {0, 1, 2, 3, 5, 7, 8, 10, 11}
    ranked = [r["id"] for r in done.rows().filter("position IS NOT NULL").collect()]
    assert ranked and set(ranked) <= {0, 1, 2, 5, 7}  # of the first batch, the sad one apart
    room[0] = False
    now[0] += 73 * 3600
    assert job.run(once=True, clock=lambda: now[0])["read"] == 0
    assert done.rows().count() == raw.rows().count() == 0
