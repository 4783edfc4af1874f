"""Keyed state of the moderation race, of self-duplicates and of near-duplicates, as streams; and what runs beside them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DEFAULT
from ..operators.dedup import band_keys

POST = T.StructType([T.StructField("key", T.StringType()), T.StructField("post", T.LongType()), T.StructField("t", T.DoubleType())])
MARK = T.StructType([T.StructField("until", T.DoubleType())])
SEEN = T.StructType([T.StructField("start", T.DoubleType()), T.StructField("members", T.ArrayType(T.StringType()))])
JUDGED = T.StructType([T.StructField("key", T.StringType()), T.StructField("event_id", T.LongType()), T.StructField("seen", T.BooleanType())])


def _until(state: GroupState, seconds: float) -> None:
    state.setTimeoutTimestamp(max(int(seconds * 1000) + 1, state.getCurrentWatermarkMs() + 1))


def pending_exclusions(both: DataFrame, ttl: float = 30.0, watermark: str = "1 minute") -> DataFrame:
    """Posts (key, post, t) but those whose exclusion came first, at most `ttl` before; each mark takes one post.

    both: key string, ts timestamp, post long (null for a label). The newest mark stands for those before it, a post takes
    it away whether it is in time or not, and it goes when the watermark has passed it.
    """
    rows = both.withWatermark("ts", watermark).select("key", "ts", "post", F.unix_micros("ts").alias("us"))

    def step(key, batches: Iterator, state: GroupState):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        mark = state.get[0] if state.exists else None
        pdf = pd.concat(list(batches))
        pdf = pdf.assign(kind=pdf["post"].notna()).sort_values(["us", "kind", "post"])
        out = []
        for post, us in zip(pdf["post"], pdf["us"], strict=True):
            if pd.isna(post):
                mark = us / 1e6 + ttl
                continue
            if mark is None or us / 1e6 > mark:
                out.append((key[0], int(post), us / 1e6))
            mark = None
        if mark is None:
            if state.exists:
                state.remove()
        else:
            state.update((mark,))
            _until(state, mark)
        yield pd.DataFrame(out, columns=["key", "post", "t"])

    return rows.groupBy("key").applyInPandasWithState(step, POST, MARK, "append", GroupStateTimeout.EventTimeTimeout)


def seen_before(events: DataFrame, ttl: float, watermark: str = "1 hour") -> DataFrame:
    """(key, event_id, seen): whether the member came up before in the key's anchored window; a set a key, gone with it.

    events: key string, member string, event_id long, ts timestamp. The twin of `windows.seen_before`.
    """
    rows = events.withWatermark("ts", watermark).select("key", "member", "event_id", "ts", F.unix_micros("ts").alias("us"))

    def step(key, batches: Iterator, state: GroupState):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        start, members = (state.get[0], set(state.get[1])) if state.exists else (float("-inf"), set())
        pdf = pd.concat(list(batches)).sort_values(["us", "event_id"])
        out = []
        for member, event_id, us in zip(pdf["member"], pdf["event_id"], pdf["us"], strict=True):
            if us / 1e6 - start >= ttl:
                start, members = us / 1e6, set()
            out.append((key[0], int(event_id), member in members))
            members.add(member)
        state.update((start, sorted(members)))
        _until(state, start + ttl)
        yield pd.DataFrame(out, columns=["key", "event_id", "seen"])

    return rows.groupBy("key").applyInPandasWithState(step, JUDGED, SEEN, "append", GroupStateTimeout.EventTimeTimeout)


LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("estimate", T.DoubleType())])

#: The state of `near_links` needs a store with map state.
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class BandIndex(StatefulProcessor):
    """What a band remembers: its classes, posts of one signature in a row, by signature: head, start of time and last time."""

    def __init__(self, ttl: float, least: float):
        self.ttl, self.least = ttl, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.classes = handle.getMapState("classes", "signature binary", "head long, last double")

    def handleInputRows(self, key, rows, timerValues):
        import numpy as np
        import pandas as pd

        held = {bytes(k[0]): (v[0], v[1]) for k, v in self.classes.iterator()}
        names = list(held)
        values = [np.frombuffer(n, ">u4") for n in names]
        pdf = pd.concat(list(rows)).sort_values(["us", "id"])
        out, changed = [], set()
        for id_, us, raw in zip(pdf["id"], pdf["us"], pdf["signature"], strict=True):
            raw, t, id_ = bytes(raw), us / 1e6, int(id_)
            if raw in held and t - held[raw][1] < self.ttl:
                head, last = held[raw]
                if head != id_:
                    out.append((head, id_, 1.0))
                held[raw] = (head, max(last, t))
            else:
                mine = np.frombuffer(raw, ">u4")
                if names:
                    same = (np.stack(values) == mine).mean(axis=1)
                    for n in np.flatnonzero(same >= self.least):
                        head, last = held[names[n]]
                        if t - last < self.ttl and names[n] != raw:
                            out.append((head, id_, float(same[n])))
                if raw not in held:
                    names.append(raw)
                    values.append(mine)
                held[raw] = (id_, t)
            changed.add(raw)
        for raw in changed:
            self.classes.updateValue((raw,), held[raw])
        if changed:
            self.handle.registerTimer(self._ends(max(held[raw][1] for raw in changed), timerValues))
        yield pd.DataFrame(out, columns=["a", "b", "estimate"])

    def _ends(self, last: float, timerValues) -> int:
        return max(int((last + self.ttl) * 1000) + 1, timerValues.getCurrentWatermarkInMs() + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() / 1000
        for k, v in list(self.classes.iterator()):
            if v[1] + self.ttl <= now:
                self.classes.removeKey(k)
        yield from ()

    def close(self) -> None:
        pass


def near_links(signed: DataFrame, ttl: float, least: float = DEFAULT.jaccard, bands: int = DEFAULT.bands, watermark: str = "1 day") -> DataFrame:
    """(a, b, estimate) of a stream of posts (id, ts, signature): near-duplicate links, the index being keyed state.

    The twin of `dedup.band_links`. A band holds all its signatures, each once however many copies come, and forgets one
    `ttl` behind its last post, when the watermark has passed that; a post that is not late misses none. Posts of a
    micro-batch are taken in order of time. Bands repeat a link, so the sink takes each (a, b) once.
    """
    rows = signed.withWatermark("ts", watermark).select("id", "ts", F.unix_micros("ts").alias("us"), "signature", band_keys(F.col("signature"), bands).alias("keys"))
    raw = F.unhex(F.array_join(F.transform("signature", lambda v: F.lpad(F.hex(v), 8, "0")), ""))
    keyed = rows.select("id", "ts", "us", raw.alias("raw"), F.explode("keys").alias("key")).withColumnRenamed("raw", "signature")
    return keyed.groupBy("key").transformWithStateInPandas(BandIndex(ttl, least), LINK, "append", "eventTime")


#: Seconds between two runs of a stage.
EVERY = {"guard": 30.0, "moderation": 10.0, "refresh": 30.0, "network": 3600.0}


class Throttle:
    """Which stages are due; a stage that ran waits its own time."""

    def __init__(self, every: dict[str, float] | None = None):
        self.every, self.last = dict(EVERY if every is None else every), {}

    def due(self, stage: str, now: float) -> bool:
        if now - self.last.get(stage, float("-inf")) < self.every[stage]:
            return False
        self.last[stage] = now
        return True


class Heartbeat(StreamingQueryListener):
    """Calls `beat` after a micro-batch that took rows in; a failed or idle one is silent."""

    def __init__(self, beat):
        super().__init__()
        self.beat = beat

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        if event.progress.numInputRows > 0:
            self.beat(event.progress.batchId)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def within_capacity(progress: dict, most_rows: int) -> bool:
    """Whether the state of a query's last progress stays within a number of rows."""
    return sum(op.get("numRowsTotal", 0) for op in progress.get("stateOperators", [])) <= most_rows
