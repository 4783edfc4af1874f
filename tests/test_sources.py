"""Label frames, lookups in batches, page fetches, and what runs beside the streams."""

import json
import struct
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from feedloom.operators import dedup, network, windows
from feedloom.sources import labels, lookup, rounds, streams
from feedloom.streaming import state
from pyspark.sql import functions as F

T0 = datetime(2026, 1, 1)


def packed(x):
    """A CBOR item, written plainly."""
    def head(major, n):
        return bytes([major << 5 | n]) if n < 24 else bytes([major << 5 | 25]) + struct.pack(">H", n) if n < 1 << 16 else bytes([major << 5 | 27]) + struct.pack(">Q", n)

    if x is None or isinstance(x, bool):
        return bytes([{None: 0xF6, True: 0xF5, False: 0xF4}[x]])
    if isinstance(x, int):
        return head(0, x) if x >= 0 else head(1, -1 - x)
    if isinstance(x, float):
        return b"\xfb" + struct.pack(">d", x)
    if isinstance(x, bytes):
        return head(2, len(x)) + x
    if isinstance(x, str):
        return head(3, len(x.encode())) + x.encode()
    if isinstance(x, list):
        return head(4, len(x)) + b"".join(map(packed, x))
    return head(5, len(x)) + b"".join(packed(k) + packed(v) for k, v in x.items())


def label_frame(seq, *found):
    rows = [{"src": "did:m", "uri": u, "val": v, "cts": "2026", **({"neg": True} if neg else {})} for u, v, neg in found]
    return packed({"op": 1, "t": "#labels"}) + packed({"seq": seq, "labels": rows})


POST = "at://did:a/app.bsky.feed.post/"
INFO = packed({"op": 1, "t": "#info"}) + packed({"name": "OutdatedCursor", "message": "x"})
ERROR = packed({"op": -1}) + packed({"error": "FutureCursor"})


def test_cbor_items_come_back():
    item = {"a": [1, -5, 70000, None, True, 1.5, "é", b"\x00\xff"], "b": {}}
    assert labels.decoded(packed(item)) == (item, len(packed(item)))
    assert labels.decoded(b"\xc1\x05") == (5, 2) and labels.decoded(b"\xf9\x3c\x00")[0] == 1.0
    for bad in (b"", b"\x19\x01", b"\x62a", b"\x5f"):
        with pytest.raises(ValueError):
            labels.decoded(bad)


def test_labels_resume_by_sequence_and_survive_bad_frames():
    frames = [label_frame(5, (POST + "1", "porn", False)), ERROR, b"\xff", label_frame(7, (POST + "2", "spam", False), (POST + "1", "porn", True))]
    rows = lambda found: [r for p in found for r in labels.labels_of(p)]
    assert [r[0] for r in rows(labels.behind(frames, None))] == [5, 7, 7]
    assert [(r[0], r[4]) for r in rows(labels.behind(frames, 5))] == [(7, False), (7, True)]
    assert [r[0] for r in rows(labels.behind([INFO, label_frame(2, (POST + "9", "porn", False))], 50))] == [2]  # an outdated number


def read(spark, tmp_path, name, source, **options):
    """All that one run of a stream takes in."""
    spark.dataSource.register(source)
    s = spark.readStream.format(source.name())
    for k, v in {"log": f"file://{tmp_path}/log", **options}.items():
        s = s.option(k, v)
    out = str(tmp_path / name)
    q = s.load().writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return sorted(map(tuple, spark.read.parquet(out).collect()))


def test_label_stream_and_exclusions(spark, tmp_path):
    frames = [label_frame(1, (POST + "1", "porn", False)), label_frame(2, (POST + "1", "porn", True), (POST + "2", "fine", False), ("did:a", "porn", False))]
    got = read(spark, tmp_path, "labelled", labels.LabelSource, frames=json.dumps([f.hex() for f in frames]))
    assert len(got) == 4
    df = spark.createDataFrame(got, labels.LabelSource({}).schema())
    assert [tuple(r) for r in labels.exclusions(df, ("porn",)).collect()] == [("did:a/1", 1)]  # the retraction changes nothing
    assert read(spark, tmp_path, "labelled", labels.LabelSource, frames=json.dumps([f.hex() for f in [*frames, label_frame(9, ("did:b", "spam", False))]]))[-1][0] == 9


def instances():
    """A source of folders, pickled by value."""

    class Instances(streams.PollSource):
        """Instances as folders: each fetch is counted, a file named `down` makes one fail."""

        def fetch(self, instance, since):
            at = Path(self.options["root"]) / instance
            with open(at / "fetched", "a") as f:
                f.write("x")
            if (at / "down").exists():
                raise OSError("down")
            return [(i, "body") for i in (at / "ids").read_text().split() if since is None or int(i) > int(since)]

    return Instances


def test_instances_are_polled_side_by_side_and_replayed_without_a_fetch(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "ids").write_text("9 10")
    (tmp_path / "b" / "down").touch()
    source = instances()
    run_ = lambda name="polled": read(spark, tmp_path, name, source, instances="a,b", root=str(tmp_path))
    fetched = lambda name: len((tmp_path / name / "fetched").read_text())
    assert run_() == [("a", "10", "body"), ("a", "9", "body")] and (fetched("a"), fetched("b")) == (1, 1)
    (tmp_path / "a" / "ids").write_text("9 10 11")
    (tmp_path / "b" / "down").unlink()
    assert run_()[-1] == ("a", "9", "body") and ("a", "11", "body") in run_()
    assert fetched("b") == 1  # it waits
    # a stream without a checkpoint, but with the log, reads what is written and fetches one round more
    before = fetched("a")
    again = run_("anew")
    assert [r for r in again if r[0] == "a"] == [("a", "10", "body"), ("a", "11", "body"), ("a", "9", "body")] and fetched("a") == before + 1


def test_rounds(tmp_path):
    now, asked = [1000.0], []

    def fetch(endpoint, cursor):
        asked.append((endpoint, cursor))
        if endpoint == "bad":
            raise ValueError("whatever")
        return [[endpoint, cursor]], (cursor or 0) + 1

    reader = rounds.RoundsReader(["ok", "bad"], f"file://{tmp_path}", fetch, lambda e, item: [tuple(item)], clock=lambda: now[0])
    take = lambda start, end: sorted(r for p in reader.partitions(start, end) for r in reader.read(p))
    at = reader.initialOffset()
    for turn, waits in enumerate((5.0, 10.0, 20.0, 40.0, 60.0, 60.0)):
        end = reader.latestOffset()
        assert end == {"ok": at["ok"] + 1, "bad": at["bad"] + 1}
        first = take(at, end)
        assert first == [("ok", turn or None)]
        n = len(asked)
        assert take(at, end) == first and len(asked) == n  # a replay
        now[0] += waits - 1
        assert reader.latestOffset()["bad"] == end["bad"]
        now[0] += 1
        at = end
    assert take(at, at) == []
    reader.commit({"ok": rounds.KEPT + 3, "bad": 1})
    assert min(rounds.Log(f"file://{tmp_path}", "ok").rounds()) == 3 and min(rounds.Log(f"file://{tmp_path}", "bad").rounds()) == 1


def test_firehose_resumes_behind_what_it_took(spark, tmp_path):
    lines = [json.dumps({"time_us": t}) for t in range(1, 8)]
    (tmp_path / "h").write_text("\n".join([*lines[:3], "{broken", *lines[3:]]) + "\n")
    for n in (3, 6, 8):
        got = read(spark, tmp_path, "hose", streams.FirehoseSource, hosts="h", most="3", replay=json.dumps({"h": str(tmp_path / "h")}))
        assert len([r for r in got if r[1] in lines]) == min(7, n - (n > 3))


def test_a_socket_that_breaks_keeps_what_came():
    class Breaks(streams.FirehoseSource):
        def connect(self, host, cursor):
            if cursor == 2:
                raise OSError("gone")
            yield from ('{"time_us": 1}', '{"time_us": 2}')
            raise OSError("reset")

    source = Breaks({"hosts": "h", "log": "x"})
    assert source._round("h", None) == (['{"time_us": 1}', '{"time_us": 2}'], 2)
    with pytest.raises(OSError):
        source._round("h", 2)


def test_lookups_in_batches_fail_on_their_own(spark):
    keys = spark.createDataFrame([(f"k{i:02d}",) for i in range(30)] + [(None,), ("k01",)], "key string").coalesce(1).sortWithinPartitions("key")

    def fetch(part):
        assert len(part) <= 25
        if "k07" in part:
            raise OSError("down")
        return {k: k.upper() for k in part if k != "k29"}

    got = {r["key"]: (r["state"], r["body"]) for r in lookup.batched(keys, fetch).collect()}
    assert len(got) == 30
    assert got["k07"] == ("failed", None)
    ok = {k: v for k, v in got.items() if v[0] != "failed"}
    assert 30 - len(ok) <= 25
    assert all(v == (("found", k.upper()) if k != "k29" else ("not_found", None)) for k, v in ok.items())


def test_pages_are_fetched_hop_by_hop():
    html = {"content-type": "text/html"}
    site = {
        "http://a.example/": (302, {"location": "/b"}, []),
        "http://a.example/b": (200, html, [b"<p>", b"hi"]),
        "http://loop.example/": (301, {"location": "http://loop.example/"}, []),
        "http://in.example/": (302, {"location": "http://local.example/"}, []),
        "http://big.example/": (200, html, [b"x" * 10] * 100),
        "http://pdf.example/": (200, {"content-type": "application/pdf"}, [b"x"]),
    }
    resolve = lambda host: ["10.0.0.1"] if host == "local.example" else [] if host == "gone.example" else ["93.184.216.34"]
    get = lambda url: site[url]
    at = lambda url, **k: lookup.page(url, get, resolve, **k)
    assert at("http://a.example/") == "<p>hi"
    assert at("http://big.example/", most_bytes=25) == "x" * 25
    assert [at(u) for u in ("http://loop.example/", "http://in.example/", "http://gone.example/", "http://pdf.example/", "ftp://a.example/", "nonsense")] == [None] * 6


def test_health_throttles_capacity_and_heartbeat(spark, tmp_path):
    assert lookup.healthy(spark, 30.0)
    t = state.Throttle({"a": 10.0, "b": 0.0})
    assert [t.due("a", 0), t.due("a", 9), t.due("b", 9), t.due("a", 10)] == [True, False, True, True]
    assert state.within_capacity({"stateOperators": [{"numRowsTotal": 3}, {"numRowsTotal": 4}]}, 7) and not state.within_capacity({"stateOperators": [{"numRowsTotal": 8}]}, 7)
    beats = []
    listener = state.Heartbeat(beats.append)
    progress = lambda n: type("E", (), {"progress": type("P", (), {"numInputRows": n, "batchId": n})})
    for n in (0, 4):
        listener.onQueryProgress(progress(n))
    assert beats == [4]


def run(spark, df, tmp_path, name, job, order="k"):
    for k in sorted({r[0] for r in df.select("part").collect()}):
        df.filter(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    stream = spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    q = job(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name).collect()


def test_pending_exclusions_as_a_stream_equal_the_batch_form(spark, tmp_path):
    rows = [("a", 0, None), ("a", 5, 1), ("a", 6, 2), ("b", 0, None), ("b", 40, 3), ("b", 41, 4), ("c", 3, 5), ("c", 4, None), ("d", 0, None), ("d", 20, None), ("d", 45, 6)]
    df = spark.createDataFrame([(k, T0 + timedelta(seconds=t), p, i // 4) for i, (k, t, p) in enumerate(rows)], "key string, ts timestamp, post long, part int")
    got = {r["post"] for r in run(spark, df, tmp_path, "pending", lambda s: state.pending_exclusions(s))}
    e = df.select("key", (F.unix_micros("ts") / 1e6).alias("t"), "post")
    batch = windows.pending_exclusions(e.filter("post IS NOT NULL"), e.filter("post IS NULL").select("key", "t"))
    assert got == {r["post"] for r in batch.collect()} == {2, 3, 4, 5}


def test_self_duplicates_as_a_stream_equal_the_batch_form(spark, tmp_path):
    rows = [("c1" if i % 2 else "c2", f"u{i % 5}", i, T0 + timedelta(seconds=50 * i), i // 10) for i in range(40)]
    df = spark.createDataFrame(rows, "key string, member string, event_id long, ts timestamp, part int")
    got = {r["event_id"]: r["seen"] for r in run(spark, df, tmp_path, "selfdup", lambda s: state.seen_before(s, 600))}
    e = df.select("key", "member", "event_id", (F.unix_micros("ts") / 1e6).alias("s"))
    assert got == {r["event_id"]: r["seen"] for r in windows.seen_before(e, ["key"], "member", "s", ["event_id"], 600, "seen").collect()}
    assert 0 < sum(got.values()) < 40


def test_near_links_of_a_stream_equal_the_batch_form(spark, tmp_path):
    """In any batching; post 1 is near neither 2 nor 3, which are near each other; copies link once each."""
    spark.conf.set(*state.ROCKS)
    base = list(range(1000, 1128))
    far, near = base[:8] + [9] * 120, base[:120] + [7] * 8  # share the first band with the others
    posts = [(1, 0, far), (2, 5, base), (3, 9, near), (4, 10, base), (5, 30, base), (6, 100, base), (7, 120, near), (8, 200, far), (9, 1000, base)]
    posts += [(100 + i, 300 + i, base) for i in range(30)]
    posts.sort(key=lambda p: p[1])
    for name, size in (("one", 100), ("few", 7), ("each", 3)):
        rows = [(i, T0 + timedelta(seconds=t), s, k // size) for k, (i, t, s) in enumerate(posts)]
        df = spark.createDataFrame(rows, "id long, ts timestamp, signature array<long>, part int")
        got = run(spark, df, tmp_path, f"near{name}", lambda s: state.near_links(s, 60, 0.7, 16, "10 seconds"))
        batch = dedup.band_links(df.select("id", (F.unix_micros("ts") / 1e6).alias("t"), "signature"), 60, 0.7, 16)
        assert {tuple(r) for r in got} == {tuple(r) for r in batch.collect()}
        links = {(r["a"], r["b"]) for r in got}
        assert (2, 3) in links and (2, 4) in links and not any(1 in x for x in links)
        assert len([x for x in links if x[1] >= 100]) == 29


def test_detector_records_and_counts(spark):
    old = spark.createDataFrame([("a.host", 1, 5)], "home_domain string, account_count int, latest long")
    new = spark.createDataFrame([("a.host", 7, 9), ("b.host", 2, 9)], "home_domain string, account_count int, latest long")
    table, n = network.recorded(old, new)
    assert n == 2 and sorted(map(tuple, table.collect())) == [("a.host", 7, 9), ("b.host", 2, 9)]
    assert network.recorded(old, new.limit(0))[1] == 0
