"""Removal of repeated passages by difference-cover anchors.

D is a difference cover modulo P: for any two positions i and j some shift d < P puts both i + d and j + d into D.
Anchors are runs of `window - P + 1` words that begin at positions whose remainder is in D, so any two equal windows
contain an anchor at the same place. Only anchors that occur in several texts are followed: the windows around them
are extended to their full length and compared as a whole by 128 bits. Of equal texts, one goes through all this.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, chunk_dictionary, chunk_starts, stored, text_blocks

#: Perfect difference sets, modulus to residues.
COVERS = {
    3: (0, 1),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
}

#: Odd multipliers of the two rolling sums.
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_WHITE = b" \t\n\x0b\x0c\r"


def cover_for(window: int) -> int:
    """The largest known modulus that leaves an anchor at least a third of the window."""
    fits = [p for p in COVERS if window - p + 1 >= max(1, window // 3)]
    return max(fits) if fits else 1


def _word_hashes(data: np.ndarray, offsets: np.ndarray):
    """Two 64-bit hashes of each word, and the index of each document's first word (one more at the end)."""
    from xxhash import xxh3_128_intdigest

    if not len(data):
        return np.zeros((2, 0), np.uint64), np.zeros(len(offsets), np.int64)
    starts = chunk_starts(data, offsets)
    index, distinct = chunk_dictionary(data, starts)
    words = [c.strip(_WHITE) for c in distinct.to_pylist()]
    digests = [xxh3_128_intdigest(w) for w in words]
    a = np.array([x & 0xFFFFFFFFFFFFFFFF for x in digests], np.uint64)[index]
    b = np.array([x >> 64 for x in digests], np.uint64)[index]
    real = np.array([bool(w) for w in words])[index]
    first = np.concatenate([[0], np.cumsum(real)])[np.searchsorted(starts, offsets)]
    return np.stack([a[real], b[real]]), first


def _powers(factor: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), factor, np.uint64)]))[:n]


def _sums(values: np.ndarray, lane: int):
    """Prefix sums by which `_run` gets the polynomial sum of any run of words, modulo 2**64."""
    factor = _FACTORS[lane]
    back = _powers(pow(factor, -1, 1 << 64), len(values))
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * back, dtype=np.uint64)]), _powers(factor, len(values) + 1)


def _run(sums, at: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` words at each position: equal runs of words have equal hashes wherever they stand."""
    prefix, powers = sums
    with np.errstate(over="ignore"):
        h = (prefix[at + length] - prefix[at]) * powers[at]
        h ^= h >> np.uint64(31)
        return (h * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _anchors(given: DataFrame, window: int, period: int) -> DataFrame:
    """(hash, k1, k2, doc_id, pos) of every anchor of every document that has a window."""
    cover = np.zeros(period, bool)
    cover[list(COVERS.get(period, (0,)))] = True
    length = window - period + 1

    def run(batches):
        for batch in batches:
            for part in _parts(batch):
                for ids, data, offsets in text_blocks([part.select([0, 1])], max_bytes=1 << 62):
                    words, first = _word_hashes(data, offsets)
                    n = np.diff(first)
                    own = np.flatnonzero(n >= window)
                    many = n[own] - length + 1
                    doc = np.repeat(own, many)
                    pos = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                    at = cover[pos % period]
                    doc, pos = doc[at], pos[at]
                    h = _run(_sums(words[0], 0), first[doc] + pos, length)
                    of = pa.array(doc)
                    yield pa.RecordBatch.from_arrays([pa.array(h), part.column(2).take(of), part.column(3).take(of), ids.take(of), pa.array(pos.astype(np.int32))], names=["hash", "k1", "k2", "doc_id", "pos"])

    return given.filter("doc_id IS NOT NULL").select("doc_id", "text", "k1", "k2").mapInArrow(run, "hash long, k1 long, k2 long, doc_id long, pos int")


def _followed(anchors: DataFrame) -> DataFrame:
    """(doc_id, k1, pos) of anchors that several texts have, for the smallest document of each text.

    Anchors are dealt out and sorted by hash and stream by; what is held is one document's rows of one hash.
    """

    def run(batches):
        last, shared, held = None, False, []
        for batch in batches:
            h, k1, k2, doc, pos = (batch.column(i).to_numpy() for i in range(5))
            if not len(h):
                continue
            new_h, new_t = np.ones(len(h), bool), np.ones(len(h), bool)
            new_h[1:] = h[1:] != h[:-1]
            new_t[1:] = new_h[1:] | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            if last is not None and last[0] == h[0]:
                new_h[0] = False
                new_t[0] = last[1] != k1[0] or last[2] != k2[0]
            begin = np.maximum.accumulate(np.where(new_t, np.arange(len(h)), -1))
            low = np.where(begin >= 0, doc[begin], last[3] if last is not None else 0)
            group = np.cumsum(new_h)  # 0: the group of the batch before goes on
            several = np.zeros(group[-1] + 1, bool)
            several[group[new_t & ~new_h]] = True
            several[0] |= shared
            keep = doc == low
            if held and several[0] and not new_h[0]:
                yield from held
            if several[0] or group[-1]:
                held = []
            out = keep & several[group]
            yield _rows(doc, k1, pos, out)
            shared = bool(several[-1])
            if not shared:
                held.append(_rows(doc, k1, pos, keep & (group == group[-1])))
            last = (h[-1], k1[-1], k2[-1], low[-1])

    dealt = anchors.repartition("hash").sortWithinPartitions("hash", "k1", "k2", "doc_id")
    return dealt.mapInArrow(run, "doc_id long, k1 long, pos int")


def _rows(doc, k1, pos, at) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(k1[at]), pa.array(pos[at])], names=["doc_id", "k1", "pos"])


def _lists(column: pa.Array):
    """Offsets and values of a list column as arrays."""
    return column.offsets.to_numpy().astype(np.int64), column.values.to_numpy()


def _windows(marked: DataFrame, window: int, period: int) -> DataFrame:
    """(h1, h2, doc_id, k1, pos, late) of the windows around the anchors in column `anchors`.

    Windows are compared within each block of texts first: where a smaller document of the block has the window too,
    it is late, whatever other blocks hold, and goes on under a key of its own. So a hash has rows of one document a
    block in the exchange, however common the window is.
    """
    length = window - period + 1

    def run(batches):
        for batch in batches:
            for part in _parts(batch):
                yield from one(part)

    def one(batch):
        at, values = _lists(pa.concat_arrays([batch.column(2)]))
        for ids, data, offsets in text_blocks([batch.select([0, 1])], max_bytes=1 << 62):
            words, first = _word_hashes(data, offsets)
            n = np.diff(first)
            spot = np.zeros(len(words[0]) + 1, np.int64)  # +1 where a range of windows begins, -1 behind its end
            doc = np.repeat(np.arange(len(n)), np.diff(at))
            pos = values.astype(np.int64)
            here = pos + length <= n[doc]
            doc, pos = doc[here], pos[here]
            np.add.at(spot, first[doc] + np.maximum(pos - period + 1, 0), 1)
            np.add.at(spot, first[doc] + np.minimum(pos, n[doc] - window) + 1, -1)
            start = np.flatnonzero(np.cumsum(spot[:-1]) > 0)
            of = np.searchsorted(first, start, side="right") - 1
            h1, h2 = (_run(_sums(words[k], k), start, window) for k in (0, 1))
            row, own, at = pa.array(of), ids.to_numpy()[of], start - first[of]
            order = np.lexsort((own, h2, h1))
            new = np.ones(len(order), bool)
            new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
            late = np.zeros(len(order), bool)
            late[order] = own[order] > own[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            with np.errstate(over="ignore"):
                apart = (own * 0x9E3779B97F4A7C1 + at) * 0x2545F4914F6CDD1D
            h1, h2 = np.where(late, h1 ^ apart, h1), np.where(late, apart, h2)
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), ids.take(row), batch.column(3).take(row), pa.array(at.astype(np.int32)), pa.array(late)], names=["h1", "h2", "doc_id", "k1", "pos", "late"])

    return marked.select("doc_id", "text", "anchors", "k1").mapInArrow(run, "h1 long, h2 long, doc_id long, k1 long, pos int, late boolean")


def _late(windows: DataFrame) -> DataFrame:
    """(doc_id, k1, pos) of windows that a smaller doc_id has too. Streams like `_followed` and holds one number."""

    def run(batches):
        last = None
        for batch in batches:
            h1, h2, doc, k1, pos, late = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            if not len(h1):
                continue
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            if last is not None:
                new[0] = last[0] != h1[0] or last[1] != h2[0]
            begin = np.maximum.accumulate(np.where(new, np.arange(len(h1)), -1))
            low = np.where(begin >= 0, doc[begin], last[2] if last is not None else 0)
            yield _rows(doc, k1, pos, late | (doc > low))
            last = (h1[-1], h2[-1], low[-1])

    dealt = windows.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "doc_id")
    return dealt.mapInArrow(run, "doc_id long, k1 long, pos int")


def _parts(batch: pa.RecordBatch, max_bytes: int = BLOCK_BYTES):
    """Slices of a batch with about so much text (its second column) each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = np.cumsum(sizes) // max_bytes
    edges = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(sizes)]])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            yield batch.slice(int(a), int(b - a))


def _cut(marked: DataFrame, window: int) -> DataFrame:
    """(doc_id, k1, removed, kept) of documents whose windows at `starts` are taken out; kept joins the rest."""

    def run(batches):
        for batch in batches:
            for part in _parts(batch):
                yield one(part)

    def one(batch):
        removed, texts = [], []
        for text, starts in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            words = (text or "").encode().split()  # bytes are split at just the ASCII white space
            s = np.array([x for x in starts.values.to_numpy() if x + window <= len(words)], np.int64)
            gone = np.zeros(len(words) + 1, np.int64)
            np.add.at(gone, s, 1)
            np.add.at(gone, s + window, -1)
            left = np.cumsum(gone[:-1]) == 0
            kept = [w for w, k in zip(words, left.tolist(), strict=True) if k]
            removed.append(len(words) - len(kept))
            texts.append(b" ".join(kept).decode())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "k1", "removed", "kept"])

    return marked.select("doc_id", "text", "starts", "k1").mapInArrow(run, "doc_id long, k1 long, removed long, kept string")


def remove_repeats(docs: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """Remove every word covered by a window of `window` words that also starts in a document with a smaller doc_id.

    A row per input row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) and, with
    `keep_text`, kept_text. Words are runs without ASCII white space, unchanged. Windows are judged on the input.

    A null text has no words. A document without a window of its own loses nothing. Rows with a null doc_id come
    neither before nor after others, so they keep all. Rows that share a doc_id are judged one by one against smaller
    doc_ids, and each as part of that document by larger ones. An empty table gives none; other columns are ignored.

    Anchors and windows stream by in order of their hash, so that no group is gathered. Windows are compared within
    blocks before they are dealt out. A document has an anchor for every five words, so the anchors of one hash are a
    small share of all even where a passage is everywhere. Of equal texts the smallest document stands for all.
    """
    period = cover_for(window)
    body = F.coalesce(F.col(text), F.lit(""))
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(1), body).alias("k2"))
    whole = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    n_words = F.when(F.length("whole") == 0, F.lit(0)).otherwise(F.length("whole") - F.length(F.replace("whole", F.lit(" "))) + 1).cast("long")
    facts = given.withColumn("whole", whole).select("doc_id", "k1", "k2", n_words.alias("n_words"), F.sha2(F.col("whole").cast("binary"), 256).alias("sha"), *(["whole"] if keep_text else []))
    facts = stored(facts, "facts")
    lowest = facts.groupBy("k1", "k2").agg(F.min("doc_id").alias("low"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")

    followed = _followed(_anchors(given, window, period)).groupBy("doc_id", "k1").agg(F.collect_set("pos").alias("anchors"))
    marked = stored(given.select("doc_id", "k1", "text").join(followed, ["doc_id", "k1"]), "marked")
    starts = _late(_windows(marked, window, period)).groupBy("doc_id", "k1").agg(F.collect_set("pos").alias("starts"))
    cut = _cut(marked.select("doc_id", "k1", "text").join(starts, ["doc_id", "k1"]), window).dropDuplicates(["doc_id", "k1"])
    cut = cut.select("doc_id", "k1", "removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha"), *(["kept"] if keep_text else []))

    copy = (F.col("doc_id") > F.col("low")) & (F.col("n_words") >= window)
    out = facts.join(lowest, ["k1", "k2"], "left").join(cut, ["doc_id", "k1"], "left")
    choose = lambda gone, some, all_: F.when(copy, gone).otherwise(F.coalesce(some, all_))
    cols = [F.col("n_words"), choose(F.col("n_words"), F.col("removed"), F.lit(0)).cast("long").alias("n_removed"), choose(F.sha2(F.lit("").cast("binary"), 256), F.col("kept_sha"), F.col("sha")).alias("kept_sha256")]
    return out.select("doc_id", *cols, *([choose(F.lit(""), F.col("kept"), F.col("whole")).alias("kept_text")] if keep_text else []))


#: The same for windows of 50 words, in DuckDB: all windows are compared, with no anchors.
ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
low AS (SELECT h, min(doc_id) AS low FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN low USING (h) WHERE doc_id > low),
pos AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
