"""Shared helpers: shared-folder tables, Arrow text blocks, white-space chunks, distributed components."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: Bytes of text handled at once by the vectorised operators; one longer document forms its own block.
BLOCK_BYTES = 4 << 20

#: ASCII white space as every word contract of this subpackage defines it: space and U+0009 to U+000D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_PUNCT[39] = False  # an apostrophe may start a contraction


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write `df` as Parquet under the shared folder and read it again.

    Unlike a local checkpoint the files outlive any executor. They go when the session's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/feedloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._feedloom_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete what `stored` wrote, once nothing reads it any more."""
    path = getattr(df, "_feedloom_path", None)
    if path:
        spark = df.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def freeing(run):
    """A worker function that gives its memory back to the system.

    Large arrays get pages of their own, which go back as soon as they are freed, and what a task leaves is trimmed, so
    a worker that lives on for other tasks holds little.
    """

    def wrapped(batches):
        import ctypes
        import gc

        import pyarrow

        libc = ctypes.CDLL(None)
        try:
            libc.mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD: fixed, or it grows with what is freed
            libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
            pyarrow.set_memory_pool(pyarrow.system_memory_pool())
            yield from run(batches)
        finally:
            gc.collect()
            pyarrow.default_memory_pool().release_unused()
            libc.malloc_trim(0)

    return wrapped


def text_blocks(batches, max_bytes: int = BLOCK_BYTES):
    """(ids, data, offsets) of Arrow batches with columns id, text; null texts are empty; blocks are bounded."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if not n:
            continue
        bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            to = int(np.searchsorted(bounds, bounds[at] + max_bytes, side="right")) - 1
            to = min(n, max(at + 1, to))
            yield ids.slice(at, to - at), data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
            at = to


def latin_letters(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 belong to a letter of A-Z, a-z or U+00C0 to U+00FF."""
    out = _LETTER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # signs of multiplication and division
    out[lead] = out[lead + 1] = True
    return out


def chunk_starts(data: np.ndarray, offsets: np.ndarray, punctuation: bool = False) -> np.ndarray:
    """Starts of chunks that cover `data`: a run of white space and the word behind it.

    With `punctuation`, ASCII punctuation behind a letter of `latin_letters` starts a chunk of its own, and so does such a
    letter behind a single white space other than U+0020.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    space = SPACE[data]
    start = np.zeros(len(data), dtype=bool)
    start[1:] = space[1:] & ~space[:-1]
    if punctuation:
        letter = latin_letters(data)
        lone = space & (data != 0x20)
        lone[1:] &= ~space[:-1]
        start[1:] |= _PUNCT[data[1:]] & letter[:-1] | lone[:-1] & letter[1:]
    first = offsets[:-1]
    start[first[first < len(data)]] = True
    return np.flatnonzero(start)


def chunk_dictionary(data: np.ndarray, starts: np.ndarray):
    """Index of each chunk into the distinct chunks, and these as an Arrow array of binary."""
    ends = np.append(starts, len(data)).astype(np.int64)
    a = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    d = a.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def word_spans(data: np.ndarray, offsets: np.ndarray):
    """Starts and ends of words in `data`, and for each document the index of its first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~SPACE[data]
    edge = np.zeros(n, dtype=bool)
    first = offsets[:-1]
    edge[first[first < n]] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:]
    last = np.ones(n, dtype=bool)
    last[:-1] = ~word[1:] | edge[1:]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(word & last) + 1, np.searchsorted(starts, offsets)


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 64) -> DataFrame:
    """Connected components of undirected links: DataFrame (node, component), component the smallest node.

    Alternates large-star and small-star steps (Kiveris et al., 2014); each round's links are written to the
    shared folder. Every step is a pre-aggregated minimum and a join, so a node with many links is no single
    task's burden. Only a count and a checksum come to the driver. Null ends are no links.
    """
    e = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = stored(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above u hang on the smallest of u and its neighbours
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: the lower neighbours of u, and u itself, hang on the lowest of them
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u <> v").distinct()
        after = stored(small, "links")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        dropped(e)
        e = after
        if mark == seen or mark[0] == mark[2] and after.join(after.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        seen = mark
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out._feedloom_path = e._feedloom_path
    return out
