"""Counters that expire, as windows over event time.

Anchored windows start at the first event and end a fixed time later, when the next event starts another. Rolling ones
end where no event follows in time. Rolling ones are gap sessions, one window function each. Anchored ones need the
start of the window before, which is carried along while a key's events stream by in order. Keys with very many events
go other ways, in which no task has a key's whole time line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import dropped, written


#: Events of a key from which its time line is dealt out to many tasks.
HOT_EVENTS = 200_000
#: Hot keys up to which they are broadcast to find their events.
BROADCAST_KEYS = 10_000
#: Time slices of a window in which the next event is sought.
SLICES = 8


def _by_heat(events: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Events of ordinary keys, and those of hot ones if there are any; every event is in one of them."""
    hot = written(events.groupBy(F.struct(*keys).alias("__k")).agg(F.count("*").alias("__n")).filter(F.col("__n") > HOT_EVENTS).select("__k"), "hot-keys")
    n = hot.count()
    if not n:
        dropped(hot)
        return events, None
    listed = F.broadcast(hot) if n <= BROADCAST_KEYS else hot
    marked = events.withColumn("__k", F.struct(*keys))
    return marked.join(listed, "__k", "left_anti").drop("__k"), marked.join(listed, "__k", "left_semi").drop("__k")


def _in_stretches(events: DataFrame, keys: list[str], time: str, order: list[str]) -> DataFrame:
    """Events with __k, their key, and __part: stretches of the sorted events, about equal however they spread over keys."""
    n = max(2, int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return written(events.withColumn("__k", F.struct(*keys)).repartitionByRange(n, "__k", time, *order).withColumn("__part", F.spark_partition_id()), "stretches")


def _running_number(events: DataFrame, keys: list[str], time: str, order: list[str], name: str) -> DataFrame:
    """Number of each event of its key in order, from 1: numbers within stretches, and what stretches before have."""
    rows = _in_stretches(events, keys, time, order)
    before = F.sum("__n").over(Window.partitionBy("__k").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sums = rows.groupBy("__part", "__k").agg(F.count("*").alias("__n")).select("__part", "__k", F.coalesce(before, F.lit(0)).alias("__before"))
    local = F.row_number().over(Window.partitionBy("__part", "__k").orderBy(time, *order))
    out = rows.withColumn("__i", local).join(sums, ["__part", "__k"])
    return out.withColumn(name, (F.col("__i") + F.col("__before")).cast("long")).select(*events.columns, name)


def _rolling_hot(events: DataFrame, keys: list[str], time: str, order: list[str], ttl: float, name: str) -> DataFrame:
    """`rolling_count` as a segmented scan of two levels: within stretches, then over the stretches of a key."""
    rows = _in_stretches(events, keys, time, order)
    w, of_key = Window.partitionBy("__part", "__k").orderBy(time, *order), Window.partitionBy("__k").orderBy("__part")
    ends = rows.groupBy("__part", "__k").agg(F.max(time).alias("__end"))
    ends = ends.select("__part", "__k", F.lag("__end").over(of_key).alias("__end"))
    rows = rows.withColumns({"__i": F.row_number().over(w), "__last": F.lag(time).over(w)}).join(ends, ["__part", "__k"])
    last = F.coalesce("__last", "__end")
    fresh = F.when(last.isNull() | (F.col(time) - last >= ttl), F.col("__i"))
    rows = rows.withColumn("__fresh", fresh).withColumn("__start", F.max("__fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # how many events of the open session the stretches before hold
    sums = rows.groupBy("__part", "__k").agg(F.count("*").alias("__n"), F.max("__start").alias("__s"))
    so_far = F.sum("__n").over(of_key.rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.withColumn("__sum", so_far).withColumn("__base", F.when(F.col("__s").isNotNull(), F.col("__sum") - F.col("__n") + F.col("__s") - 1))
    base = F.last("__base", ignorenulls=True).over(of_key.rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("__part", "__k", (F.lag("__sum").over(of_key) - base).alias("__open"))
    n = F.when(F.col("__start").isNotNull(), F.col("__i") - F.col("__start") + 1).otherwise(F.col("__i") + F.col("__open"))
    return rows.join(sums, ["__part", "__k"]).withColumn(name, n.cast("long")).select(*events.columns, name)


def sessions(events: DataFrame, keys: list[str], time: str, order: list[str], gap: float, name: str = "session") -> DataFrame:
    """Number of the session of each event: a new one where the last event of the key is over `gap` or more ago."""
    w = Window.partitionBy(*keys).orderBy(time, *order)
    last = F.lag(time).over(w)
    fresh = F.when(last.isNull() | (F.col(time) - last >= gap), 1).otherwise(0)
    return events.withColumn("__fresh", fresh).withColumn(name, F.sum("__fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__fresh")


def rolling_count(events: DataFrame, keys: list[str], time: str, order: list[str], ttl: float, name: str) -> DataFrame:
    """Running count of a key that every hit keeps alive for `ttl`; the current hit counts. Hot keys are dealt out by time."""
    events, hot = _by_heat(events, keys)
    s = sessions(events, keys, time, order, ttl, "__session")
    w = Window.partitionBy(*keys, "__session").orderBy(time, *order)
    out = s.withColumn(name, F.row_number().over(w).cast("long")).drop("__session")
    return out if hot is None else out.unionByName(_rolling_hot(hot, keys, time, order, ttl, name))


def _walked(events: DataFrame, keys: list[str], order: list[str], ttl: float, name: str) -> DataFrame:
    """`anchored` of keys whose events stream by in order of __time; what is held is the key and the start of its window."""
    rows = events.withColumn("__key", F.xxhash64(*keys)).withColumn(name, F.lit(0.0))
    schema = rows.schema
    place = {c: i for i, c in enumerate(rows.columns)}

    def run(batches):
        import numpy as np
        import pyarrow as pa

        last, start = None, 0.0
        for batch in batches:
            key = batch.column(place["__key"]).to_numpy()
            at = batch.column(place["__time"]).to_numpy(zero_copy_only=False)
            out = np.empty(len(key))
            edges = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if lo == hi:
                    continue
                if last != key[lo]:
                    last, start = key[lo], at[lo]
                while lo < hi:  # one step for each window of the run
                    end = lo + int(np.searchsorted(at[lo:hi], start + ttl))
                    out[lo:end] = start
                    if end < hi:
                        start = at[end]
                    lo = end
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], names=batch.schema.names)

    dealt = rows.repartition(*keys).sortWithinPartitions("__key", "__time", *order)
    return dealt.mapInArrow(run, schema).drop("__key")


def _next_anchor(times: DataFrame, ttl: float) -> DataFrame:
    """(k, t, to): for distinct times of each key the first one `ttl` or more behind, where there is one.

    Times and what they seek meet in slices of a key's time; what finds none in its slice takes the first time of the
    slices behind, of which a key has as many as its span of time, not its events.
    """
    slice_ = F.floor(F.col("x") / (ttl / SLICES))
    asked = times.select("k", "t", (F.col("t") + ttl).alias("x"), F.lit(None).cast("double").alias("e"))
    there = times.select("k", F.lit(None).cast("double").alias("t"), F.col("t").alias("x"), F.col("t").alias("e"))
    later = Window.partitionBy("k", "slice").orderBy(F.desc("x")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    met = asked.unionByName(there).withColumn("slice", slice_).withColumn("to", F.min("e").over(later)).filter("t IS NOT NULL").select("k", "t", "slice", "to")
    firsts = there.withColumn("slice", slice_).groupBy("k", "slice").agg(F.min("e").alias("first"))
    places = firsts.unionByName(met.filter("to IS NULL").select("k", "slice", F.lit(None).cast("double").alias("first"))).groupBy("k", "slice").agg(F.min("first").alias("first"))
    behind = F.min("first").over(Window.partitionBy("k").orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1))
    out = met.join(places.select("k", "slice", behind.alias("behind")), ["k", "slice"]).select("k", "t", F.coalesce("to", "behind").alias("to"))
    return out.filter("to IS NOT NULL")


def _anchored_hot(events: DataFrame, keys: list[str], ttl: float, name: str) -> DataFrame:
    """`anchored` of hot keys: pointers from each time to its next anchor, doubled until the first time has reached all.

    No group is a key's: slices of time meet, pointers are joined by (key, time), and an event finds its start among the
    anchors of its own slice and the one before.
    """
    rows = events.withColumn("__k", F.struct(*keys))
    times = rows.select(F.col("__k").alias("k"), F.col("__time").alias("t")).distinct()
    jump = written(_next_anchor(times, ttl), "pointers")
    reached = written(times.groupBy("k").agg(F.min("t").alias("t")), "anchors")
    while True:
        more = written(reached.join(jump, ["k", "t"]).select("k", F.col("to").alias("t")), "anchors")
        if more.isEmpty():
            break
        wider = written(reached.unionByName(more).distinct(), "anchors")
        twice = written(jump.join(jump.select("k", F.col("t").alias("to"), F.col("to").alias("next")), ["k", "to"]).select("k", "t", F.col("next").alias("to")), "pointers")
        dropped(reached, more, jump)
        reached, jump = wider, twice
    dropped(more, jump)
    spread = reached.withColumn("__slice", F.explode(F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda o: F.floor(F.col("t") / ttl) + o)))
    near = spread.groupBy(F.col("k").alias("__k"), "__slice").agg(F.collect_list("t").alias("__starts"))  # a few: anchors are `ttl` apart
    met = rows.withColumn("__slice", F.floor(F.col("__time") / ttl)).join(near, ["__k", "__slice"])
    return met.withColumn(name, F.array_max(F.filter("__starts", lambda a: a <= F.col("__time")))).select(*events.columns, name)


def _anchored_parts(events: DataFrame, keys: list[str], time: str, order: list[str], ttl: float, name: str) -> tuple[DataFrame, DataFrame | None]:
    rows = events.withColumn("__time", F.col(time).cast("double")).filter(F.col("__time").isNotNull())
    rows, hot = _by_heat(rows, keys)
    return _walked(rows, keys, order, ttl, name).drop("__time"), None if hot is None else _anchored_hot(hot, keys, ttl, name).drop("__time")


def anchored(events: DataFrame, keys: list[str], time: str, order: list[str], ttl: float, name: str = "window_start") -> DataFrame:
    """Start of the anchored window of each event: the first event, or the first one `ttl` or more behind the start before.

    A key's events stream by in order of time; those of a key with more than HOT_EVENTS are dealt out by time instead.
    """
    out, hot = _anchored_parts(events, keys, time, order, ttl, name)
    return out if hot is None else out.unionByName(hot)


def anchored_count(events: DataFrame, keys: list[str], time: str, order: list[str], ttl: float, name: str) -> DataFrame:
    """Running count within the anchored window; the current event counts."""
    a, hot = _anchored_parts(events, keys, time, order, ttl, "__start")
    w = Window.partitionBy(*keys, "__start").orderBy(time, *order)
    out = a.withColumn(name, F.row_number().over(w).cast("long"))
    return (out if hot is None else out.unionByName(_running_number(hot, [*keys, "__start"], time, order, name))).drop("__start")


def seen_before(events: DataFrame, keys: list[str], member: str, time: str, order: list[str], ttl: float, name: str) -> DataFrame:
    """Whether the member came up before in the key's current anchored window."""
    a, hot = _anchored_parts(events, keys, time, order, ttl, "__start")
    w = Window.partitionBy(*keys, "__start", member).orderBy(time, *order)
    out = a.withColumn(name, F.row_number().over(w) > 1)
    if hot is not None:  # the first of each member is found by partial minima, and joined
        group, place = F.struct(*keys, "__start", member), F.struct(time, *order)
        first = hot.groupBy(group.alias("__g")).agg(F.min(place).alias("__first"))
        found = hot.withColumn("__g", group).join(first, "__g").withColumn(name, place > F.col("__first"))
        out = out.unionByName(found.select(*out.columns))
    return out.drop("__start")


def component(count: Column, full: int) -> Column:
    return F.least(F.lit(1.0), count / float(full))


def pending_exclusions(posts: DataFrame, labels: DataFrame, ttl: float = 30.0) -> DataFrame:
    """Posts without those whose exclusion came at most `ttl` before them; each exclusion takes one post.

    posts: (key, t, post), labels: (key, t). A label takes the first post of its key that comes in time; posts and labels
    of a key are paired in order, the newest label before a post standing for all earlier ones, as a mark does.
    """
    both = posts.select("key", "t", "post", F.lit(1).alias("kind")).unionByName(labels.select("key", "t", F.lit(None).cast("long").alias("post"), F.lit(0).alias("kind")))
    w = Window.partitionBy("key").orderBy("t", "kind", "post")
    last_kind, last_t = F.lag("kind").over(w), F.lag("t").over(w)
    hit = (F.col("kind") == 1) & (last_kind == 0) & (F.col("t") - last_t <= ttl)
    return both.withColumn("hit", F.coalesce(hit, F.lit(False))).filter("kind = 1 AND NOT hit").select("key", "t", "post")
