import json
from datetime import datetime, timedelta

import pytest
from feedloom.operators import windows as V
from feedloom.sources import rounds, streams
from feedloom.streaming import jobs
from pyspark.sql import functions as F

T0 = datetime(2026, 1, 1)


@pytest.mark.parametrize("rolling", [False, True])
def test_stateful_counters_equal_the_batch_windows(spark, tmp_path, rolling):
    rows = [("a" if i % 3 else "b", i, T0 + timedelta(seconds=37 * i + (400 if i > 20 else 0))) for i in range(40)]
    df = spark.createDataFrame(rows, "key string, event_id long, ts timestamp")
    for k in range(4):
        df.filter(f"event_id div 10 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.counters(stream, 300, rolling).writeStream.format("memory").queryName(f"counted{rolling}").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {r["event_id"]: r["n"] for r in spark.table(f"counted{rolling}").collect()}
    e = df.select("key", "event_id", (F.unix_micros("ts") / 1e6).alias("s"))
    batch = (V.rolling_count if rolling else V.anchored_count)(e, ["key"], "s", ["event_id"], 300, "n")
    assert got == {r["event_id"]: r["n"] for r in batch.collect()}


def event(i, **record):
    return json.dumps({"did": f"did:{i}", "time_us": 1, "kind": "commit", "commit": {"operation": "create", "rkey": str(i), "record": {"text": f" post {i} ", "langs": ["en"], **record}}})


def test_ingest_drops_malformed_and_repeated_events(spark, tmp_path):
    lines = [event(1), event(2, langs=["fr"]), event(3, text="  "), "{broken", event(4, langs=[]), event(1)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(lines))
    for _ in range(2):
        posts = streams.posts_of(streams.json_events(spark, str(tmp_path / "in")))
        assert jobs.ingest(posts, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        (tmp_path / "in" / "b.json").write_text("\n".join([event(1), event(5)]))
    got = sorted((r["source_id"], r["text"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("did:1/1", "post 1"), ("did:4/4", "post 4"), ("did:5/5", "post 5")]


def test_back_off_doubles():
    assert [rounds.backoff(k) for k in (0, 1, 5)] == [5.0, 10.0, 60.0]


def test_registry_publishes_only_whole_versions(tmp_path):
    r = streams.ModelRegistry(str(tmp_path), "m")
    assert r.current() is None
    r.upload("v1", {"a": b"1"})
    with pytest.raises(FileNotFoundError):
        r.publish("v1", ["a", "b"])
    r.publish("v1", ["a"])
    assert r.current() == "v1" and r.fetch(["a"]) == {"a": b"1"} and r.versions() == ["v1"]
    with pytest.raises(FileExistsError):
        r.upload("v1", {"a": b"2"})
