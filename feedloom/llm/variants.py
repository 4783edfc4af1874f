"""Spelling variants: words one edit apart, grouped under their most frequent form.

Words stand in two orders, forward and reversed, each cut into shards by ranges of (length, word). In a shard, words of
one length are points (place in the order, place in the opposite order), held in a wavelet tree. An edit at a position
leaves a prefix and a suffix of the word: the prefix is an interval of one order, the suffix one of the other, and
what lies in the rectangle is near. Edits in the back half of a word are sought forward, those in the front half
reversed, so the prefix that routes a word to shards has at least half its letters.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, freeing, stored

#: Words of a shard, and shards at most (their bounds are sent to every task); more words make larger shards.
SHARD_WORDS, MOST_SHARDS = 1 << 15, 1 << 16
#: Bytes of words that a rectangle search compares at once.
SEARCH_BYTES = 32 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, least_length: int = 5, least_n: int = 3, every: int = 97, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): words of at least `least_length` letters with at least `least_n` occurrences in the whole texts.

    Runs of letters, A-Z lower-cased; one run in `every`, by the crc32 of `<doc_id>:<run>`, loses a letter.
    """
    low = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER)
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).alias("d"), F.explode(F.regexp_extract_all(low, F.lit("[a-zÀ-ÿ]+"), F.lit(0))).alias("run"))
    h, size = F.crc32(F.concat("d", F.lit(":"), "run")), F.length("run")
    at = (h % size).cast("int")
    cut = F.concat(F.substring("run", 1, at), F.substring("run", at + 2, size))
    word = F.when(h % every == 0, cut).otherwise(F.col("run"))
    return runs.select(word.alias("word")).filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_n)


class WaveletTree:
    """A permutation of 0..n-1 by the bits of its values, highest first: reports values of a range within an interval."""

    def __init__(self, values: np.ndarray):
        self.size = len(values)
        self.depth = max(1, int(self.size - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.depth - 1, -1, -1):
            bit = (values >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(self.size - int(self.ones[-1][-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def report(self, left, right, low, high):
        """(query, value) of all values in [low, high) at places in [left, right), for arrays of queries."""
        query, base = np.arange(len(left)), np.zeros(len(left), np.int64)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            width = 1 << (self.depth - 1 - level)
            a, b = ones[left], ones[right]
            parts = []
            for l, r, start in ((left - a, right - b, base), (zeros + a, zeros + b, base + width)):
                on = (l < r) & (start < high[query]) & (start + width > low[query])
                parts.append((l[on], r[on], query[on], start[on]))
            left, right, query, base = (np.concatenate(x) for x in zip(*parts, strict=True))
        return query, base


def _matrix(words: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), width)


def _keys(matrix: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(matrix).view(f"S{matrix.shape[1]}").ravel()


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Letters that the rows of two matrices have in common from their front."""
    other = a != b
    return np.where(other.any(axis=1), other.argmax(axis=1), a.shape[1])


class Points:
    """Words of one length and orientation in a shard, as points of two orders."""

    def __init__(self, words: list[bytes], counts: np.ndarray):
        self.width = len(words[0])
        matrix = _matrix(words, self.width)
        order = np.argsort(_keys(matrix), kind="stable")
        self.matrix, self.counts = matrix[order], counts[order]
        self.keys = _keys(self.matrix)
        back = self.matrix[:, ::-1]
        self.by_back = np.argsort(_keys(back), kind="stable")
        self.back = back[self.by_back]
        self.back_keys = _keys(self.back)
        place = np.empty(len(words), np.int64)
        place[self.by_back] = np.arange(len(words))
        self.tree = WaveletTree(place)

    @staticmethod
    def _most_shared(rows: np.ndarray, keys: np.ndarray, matrix: np.ndarray, queries: np.ndarray, same: bool) -> np.ndarray:
        """Letters that each query shares at most with another word's front: its neighbours in the order have most."""
        at = np.searchsorted(keys, queries)
        hit = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == queries) if same else np.zeros(len(at), dtype=bool)
        most = np.zeros(len(rows), np.int64)
        for near in (at - 1, at + hit):
            ok = (near >= 0) & (near < len(keys))
            most[ok] = np.maximum(most[ok], _shared(rows[ok], matrix[near[ok]][:, : rows.shape[1]]))
        return most

    def near(self, words: list[bytes], backwards: bool):
        """(query, place) of words here that one replaced letter, or one letter more, makes of each query.

        Only positions from where the other orientation leaves off are looked at, each found pair once.
        """
        size, width = len(words[0]), self.width
        more = width - size  # 1: a letter is inserted, 0: one is replaced
        rows = _matrix(words, size)
        half = size // 2
        first = half if not backwards else size - half + more
        front = self._most_shared(rows, self.keys, self.matrix, _keys(rows), not more)
        back = self._most_shared(rows[:, ::-1], self.back_keys, self.back, _keys(rows[:, ::-1]), not more)
        # letters behind the position must be shared from the back, those before it from the front
        lo, hi = np.maximum(first, size - (0 if more else 1) - back), np.minimum(front, size - (0 if more else 1))
        many = np.maximum(hi - lo + 1, 0)
        query = np.repeat(np.arange(len(words)), many)
        position = lo[query] + np.arange(len(query)) - np.repeat(np.cumsum(many) - many, many)
        step = max(1, SEARCH_BYTES // (4 * width))
        found = [self._rectangles(rows, query[k : k + step], position[k : k + step], more) for k in range(0, len(query), step)]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pair = np.unique(np.concatenate(found))
        query, place = np.divmod(pair, len(self.keys))
        if not more:
            on = self.keys[place] != _keys(rows)[query]
        elif backwards:  # what shares the front half is found forward
            on = (rows[query][:, size - half :] != self.matrix[place][:, width - half :]).any(axis=1)
        else:
            on = np.ones(len(query), dtype=bool)
        return query[on], place[on]

    def _rectangles(self, rows, query, position, more):
        width = self.width
        column = np.arange(width)[None, :]
        padded = np.zeros((len(query), width), np.uint8)
        padded[:, : rows.shape[1]] = rows[query]
        before = column < position[:, None]
        left = np.searchsorted(self.keys, _keys(np.where(before, padded, 0).astype(np.uint8)), "left")
        right = np.searchsorted(self.keys, _keys(np.where(before, padded, 255).astype(np.uint8)), "right")
        behind = (rows.shape[1] - position - (1 - more))[:, None]
        padded[:, : rows.shape[1]] = rows[query][:, ::-1]
        before = column < behind
        low = np.searchsorted(self.back_keys, _keys(np.where(before, padded, 0).astype(np.uint8)), "left")
        high = np.searchsorted(self.back_keys, _keys(np.where(before, padded, 255).astype(np.uint8)), "right")
        some = np.flatnonzero((left < right) & (low < high))
        of, value = self.tree.report(left[some], right[some], low[some], high[some])
        return query[some][of] * len(self.keys) + self.by_back[value]


def _entry(backwards: int, length: int, key: bytes) -> bytes:
    return bytes([backwards]) + length.to_bytes(4, "big") + key


def _routed(bounds: list[tuple[bytes, bytes, int]]):
    """Rows of queries: each word goes to the shards that its half's interval meets, for its length and one more."""
    firsts, lasts, shards = ([b[k] for b in bounds] for k in range(3))

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {"shard": [], "length": [], "backwards": [], "key": [], "n": []}
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for backwards in (0, 1):
                    key = word.encode("latin-1")[:: -1 if backwards else 1]
                    for more in (0, 1):
                        size = len(key) + more
                        known = key[: len(key) // 2 if not backwards else len(key) - len(key) // 2 + more]
                        a = bisect_left(lasts, _entry(backwards, size, known))
                        b = bisect_right(firsts, _entry(backwards, size, known.ljust(size, b"\xff")))
                        for k in range(a, b):
                            out["shard"].append(shards[k])
                            out["length"].append(size)
                            out["backwards"].append(backwards)
                            out["key"].append(key)
                            out["n"].append(n)
            yield pa.record_batch([pa.array(out["shard"], pa.int32()), pa.array(out["length"], pa.int32()), pa.array(out["backwards"], pa.int32()), pa.array(out["key"], pa.binary()), pa.array(out["n"], pa.int64())], names=list(out))

    return run


def _join(batches):
    """(word, near, near_n) of rows sorted by (shard, asks): a shard's words come first, then queries stream past."""
    shard, index, points = None, {}, {}
    for batch in batches:
        shards, asks = batch.column("shard").to_numpy(), batch.column("asks").to_numpy()
        lengths, ways, counts = (batch.column(c).to_numpy() for c in ("length", "backwards", "n"))
        keys = batch.column("key").to_pylist()
        words, nears, ns = [], [], []
        cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(asks) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(shards)], strict=True):
            if a == b:
                continue
            if shards[a] != shard:
                shard, index, points = shards[a], {}, {}
            kinds: dict[tuple, list[int]] = {}
            for k in range(a, b):
                kinds.setdefault((ways[k], lengths[k], len(keys[k])), []).append(k)
            if not asks[a]:
                for (way, length, _), at in kinds.items():
                    held = index.setdefault((way, length), ([], []))
                    held[0].extend(keys[k] for k in at)
                    held[1].extend(counts[at])
                continue
            for (way, length, size), at in kinds.items():
                if (way, length) not in index:
                    continue
                if (way, length) not in points:
                    points[way, length] = Points(index[way, length][0], np.array(index[way, length][1]))
                here = points[way, length]
                query, place = here.near([keys[k] for k in at], bool(way))
                if not len(query):
                    continue
                turn = slice(None, None, -1 if way else 1)
                of = [keys[at[q]][turn].decode("latin-1") for q in query]
                found = [here.matrix[p].tobytes()[turn].decode("latin-1") for p in place]
                words += of
                nears += found
                ns.append(here.counts[place])
                if length > size:  # the shorter word is sought by the longer one's place only
                    words += found
                    nears += of
                    ns.append(counts[np.array(at)[query]])
        if words:
            yield pa.record_batch([pa.array(words, pa.string()), pa.array(nears, pa.string()), pa.array(np.concatenate(ns), pa.int64())], names=["word", "near", "near_n"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every two words (word, n) that one inserted, deleted or replaced letter sets apart, both ways.

    Words are distinct, not empty and of code points up to U+00FF other than 0. Each pair comes once each way.
    """
    both = words.select("n", F.explode(F.array(F.struct(F.lit(0).alias("backwards"), F.col("word").alias("w")), F.struct(F.lit(1).alias("backwards"), F.reverse("word").alias("w")))).alias("x")).select("x.backwards", F.length("x.w").alias("length"), "x.w", "n")
    total = 2 * words.count()
    n = -(-total // max(SHARD_WORDS, -(-total // MOST_SHARDS))) or 1
    shards = stored(both.repartitionByRange(n, "backwards", "length", "w").withColumn("shard", F.spark_partition_id()), "shards")
    ends = shards.groupBy("shard").agg(F.min(F.struct("backwards", "length", "w")).alias("a"), F.max(F.struct("backwards", "length", "w")).alias("b")).collect()  # MOST_SHARDS at most
    latin = lambda x: _entry(x["backwards"], x["length"], x["w"].encode("latin-1"))
    bounds = sorted((latin(r["a"]), latin(r["b"]), r["shard"]) for r in ends)
    asking = words.select("word", "n").mapInArrow(freeing(_routed(bounds)), "shard int, length int, backwards int, key binary, n long").withColumn("asks", F.lit(1))
    held = shards.select("shard", "length", "backwards", F.encode("w", "ISO-8859-1").alias("key"), "n").withColumn("asks", F.lit(0))
    met = held.unionByName(asking).repartitionById(max((b[2] + 1 for b in bounds), default=1), F.col("shard")).sortWithinPartitions("shard", "asks")
    out = stored(met.mapInArrow(freeing(_join), "word string, near string, near_n long"), "near")
    dropped(shards)
    return out


def group_variants(docs: DataFrame, least_length: int = 5, least_n: int = 3, every: int = 97, ratio: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of `word_counts`.

    Two words are near if one inserted, deleted or replaced letter sets them apart. A word's form is its most frequent
    near word (ties: the smallest) if that has at least `ratio` times its occurrences, else null; its root is where forms
    lead, the word itself if it has none. Counts grow by `ratio` from form to form, so the way is short; it is halved each
    round.

    Null texts have no words, a null doc_id counts as `null`; repeated rows count as often as they come; an empty table
    gives no rows; other columns are ignored. A word has at most some hundred near words for each of its letters, by the
    alphabet alone, so no group grows with the data.
    """
    words = stored(word_counts(docs, least_length, least_n, every, doc_id, text), "words")
    near = near_words(words)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    formed = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    formed = stored(formed, "forms")
    ways = stored(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "ways")
    while True:
        onward = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stored(ways.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "ways")
        dropped(ways)
        ways = after.select("word", "root")
        ways._feedloom_path = after._feedloom_path
        if after.filter("moved").isEmpty():
            break
    out = stored(formed.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")
    for table in (words, near, formed, ways):
        dropped(table)
    return out
