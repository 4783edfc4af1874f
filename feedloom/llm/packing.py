"""Best-fit packing of token pieces into sequences, improved by swap-based local search.

Only the lengths matter, and there are at most `capacity` of them, so the search runs over a histogram of lengths:
a kind of bin is a multiset of lengths with the number of bins that are filled so. Best fit makes the kinds; local
search then exchanges pieces between underfull kinds for as many bins as both have. Both are bounded by `capacity`,
whatever the number of documents. Pieces get their places by rank among the pieces of equal length.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from codecs import charmap_decode

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, chunk_dictionary, freeing, shared_dir, stored, text_blocks
from .tokens import BLOCK, BYTE_CHARS, ChunkTable

#: Pieces of one length that are ranked together; a length of more comes in parts, so that none is one task's.
RANKED_AT_ONCE = 250_000
#: Rows of the table of slots up to which it is broadcast; beyond, it is joined.
BROADCAST_SLOTS = 500_000

#: Normalizer and pre-tokenizer whose ids are those of `word_chunks`, one after another.
WORD_RULES = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
]
#: Bytes that are ASCII letters, ASCII punctuation, bytes with A-Z lowered and white space as a space, the
#: byte-level alphabet, and words of a-z and lower-case letters of U+00DF to U+00FF.
LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
PUNCT = np.isin(np.arange(256), [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
LOWER = np.where(SPACE, 32, np.arange(256) + 32 * (LETTER & (np.arange(256) < 97))).astype(np.uint8)
BYTE_LEVEL = bytes(range(256)).decode("latin-1").translate(BYTE_CHARS)
_LATIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


class WordIds:
    """Ids of texts and chunks by a tokenizers file.

    Where the file's rules are the usual ones of lower-cased words (`chunked`), a text's ids are those of its chunks one
    after another, and a chunk of plain letters needs the model alone. Texts of any other file go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        self.model = t.model
        rules = [json.loads(x.__getstate__()) if x else None for x in (t.normalizer, t.pre_tokenizer)]
        self.chunked = rules == WORD_RULES and all(
            a.content.startswith("<|") and a.special and not (a.lstrip or a.rstrip or a.single_word or a.normalized) for a in t.get_added_tokens_decoder().values()
        )

    def text(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def chunk(self, chunk: bytes) -> list[int]:
        body = chunk.lstrip(b" ")
        if body.isalpha() and body.islower():
            return [t.id for t in self.model.tokenize(body.decode())]
        if _LATIN.fullmatch(body):
            return [t.id for t in self.model.tokenize(charmap_decode(body, "strict", BYTE_LEVEL)[0])]
        return self.text(body.decode())


def word_chunks(data: np.ndarray, offsets: np.ndarray):
    """Starts of chunks that cover `data`, and `data` with letters in lower case and white space as spaces.

    A chunk is a run of white space with the word behind it, but punctuation behind a letter starts one of its own, so
    that a word is the same chunk at the start and the end of a sentence. Letters are A-Z and those of U+00C0 to U+00FF.
    A letter before any other character beyond ASCII keeps its case, as a mark may compose with it before it is lowered.
    """
    n = len(data)
    letter, low = LETTER[data], LOWER[data]
    high = data > 127
    if high.any():
        latin = np.zeros(n, dtype=bool)  # second bytes
        latin[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        letter |= latin
        letter[:-1] |= latin[1:]
        marked = np.zeros(n, dtype=bool)
        marked[:-1] = high[1:] & ~letter[1:]
        marked[offsets[1:][offsets[1:] > 0] - 1] = False
        low[latin & (data < 0x9F)] += 32
        low[marked] = data[marked]
    space = SPACE[data]
    start = np.zeros(n, dtype=bool)
    start[1:] = space[1:] & ~space[:-1] | PUNCT[data[1:]] & letter[:-1]
    first = offsets[:-1]
    start[first[first < n]] = True
    return np.flatnonzero(start), low


def ids_of_block(ids_of: WordIds, table: ChunkTable, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The ids of each document of a block."""
    n = len(offsets) - 1
    whole = np.full(n, not ids_of.chunked)
    flat, bounds = np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    if len(data) and ids_of.chunked:
        # special strings may stand inside a chunk
        whole[np.searchsorted(offsets, np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C)), side="right") - 1] = True
        starts, low = word_chunks(data, offsets)
        index, distinct = chunk_dictionary(low, starts)
        flat, first = table.of(distinct.to_pylist(), index)
        bounds = first[np.searchsorted(starts, offsets)]
    return [
        np.array(ids_of.text(data[offsets[k] : offsets[k + 1]].tobytes().decode()), np.int32) if whole[k] else flat[bounds[k] : bounds[k + 1]]
        for k in range(n)
    ]


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, doc_id: str, text: str) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): each document's ids and `end_id`, cut only where over capacity."""

    def run(batches):
        ids_of = WordIds(tokenizer)
        table = ChunkTable(ids_of.chunk)
        for ids, data, offsets in text_blocks(batches, BLOCK):
            out: dict[str, list] = {"k": [], "piece": [], "start": [], "length": [], "crc": []}
            for k, own in enumerate(ids_of_block(ids_of, table, data, offsets)):
                raw = np.append(own, np.int32(end_id)).astype("<u4").tobytes()
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    for key, v in (("k", k), ("piece", piece), ("start", at // 4), ("length", len(part) // 4), ("crc", zlib.crc32(part))):
                        out[key].append(v)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(out["k"], pa.int64())).cast(pa.int64()), pa.array(out["piece"], pa.int32()), pa.array(out["start"], pa.int64()), pa.array(out["length"], pa.int64()), pa.array(out["crc"], pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(freeing(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(histogram: dict[int, int], capacity: int) -> list[list]:
    """Best fit, longest first, over a histogram of lengths: [[lengths of a bin], number of such bins]."""
    kinds: list[list] = []
    room: dict[int, list[int]] = {}  # kinds by room left
    rooms: list[int] = []

    def put(lengths: list[int], bins: int) -> None:
        kinds.append([lengths, bins])
        left = capacity - sum(lengths)
        if left:
            if left not in room:
                room[left] = []
                insort(rooms, left)
            room[left].append(len(kinds) - 1)

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):  # open bins, each as full as this length makes it
                per = capacity // length
                if n >= per:
                    put([length] * per, n // per)
                    n %= per
                if n:
                    put([length] * n, 1)
                    n = 0
                break
            left = rooms[at]
            k = room[left].pop()
            if not room[left]:
                del room[left]
                rooms.pop(at)
            per = max(1, min(left // length, n // kinds[k][1] if n >= kinds[k][1] else 1))
            take = min(kinds[k][1], n // per)
            lengths, bins = kinds[k]
            kinds[k][1] = 0
            put(lengths + [length] * per, take)
            if bins > take:
                put(lengths, bins - take)
            n -= take * per
    return merged(kinds)


def merged(kinds: list[list]) -> list[list]:
    """Equal kinds as one; kinds of no bin are left out."""
    out: dict[tuple, int] = {}
    for lengths, bins in kinds:
        if bins:
            key = tuple(sorted(lengths, reverse=True))
            out[key] = out.get(key, 0) + bins
    return [[list(k), n] for k, n in sorted(out.items(), reverse=True)]


def improve(kinds: list[list], capacity: int) -> list[list]:
    """Swap-based local search: moves and one-for-one or two-for-one exchanges between underfull kinds.

    From the emptiest kind on, pieces go where they raise the sum of squared fills most; a kind whose pieces have all
    moved away is a bin saved. A step handles as many bins of both kinds as there are. The search ends where all room
    left would not make up a bin, which no packing can better, or where no step helps any kind. Sums of squares are
    whole numbers and grow with each step, so it does end.
    """
    counts = {tuple(k): n for k, n in merged(kinds)}
    search = _Search({k: n for k, n in counts.items() if sum(k) < capacity}, capacity)
    full = [[list(k), n] for k, n in counts.items() if sum(k) == capacity]
    moved = True
    while moved:
        moved = False
        tried: set[tuple] = set()
        while search.room() >= capacity:
            a = min((k for k in search.counts if k not in tried), key=lambda k: (sum(k), k), default=None)
            if a is None:
                break
            step = search.step(a)
            if step is None:
                tried.add(a)
                continue
            moved = True
            b, new_a, new_b = step
            n = min(search.counts[a], search.counts[b]) if a != b else search.counts[a] // 2
            search.change(a, -n)
            search.change(b, -n)
            for k in (new_a, new_b):
                if sum(k) == capacity:
                    full.append([list(k), n])
                elif k:
                    search.change(k, n)
        if search.room() < capacity:
            break
    return merged(full + [[list(k), n] for k, n in search.counts.items()])


class _Search:
    """Underfull kinds, and all that each may give back for a piece: nothing, one of its pieces, or two."""

    def __init__(self, counts: dict[tuple, int], capacity: int):
        self.counts, self.capacity = counts, capacity
        self.back: dict[tuple, tuple] = {}
        self.table = None

    def room(self) -> int:
        return sum((self.capacity - sum(k)) * n for k, n in self.counts.items())

    def change(self, kind: tuple, n: int) -> None:
        now = self.counts.get(kind, 0) + n
        if now:
            self.counts[kind] = now
        else:
            del self.counts[kind]
        self.table = None

    def _backs(self, kind: tuple):
        if kind not in self.back:
            found = {0: ()}
            for i, x in enumerate(kind):
                found.setdefault(x, (x,))
                for y in kind[i + 1 :]:
                    found.setdefault(x + y, (x, y))
            self.back[kind] = np.array(list(found)), list(found.values())
        return self.back[kind]

    def step(self, a: tuple):
        """The best exchange that makes bins of some kind b fuller at the cost of kind a: (b, new a, new b)."""
        if self.table is None:
            self.order = sorted(self.counts)
            sums = [self._backs(k)[0] for k in self.order]
            size = np.array([len(x) for x in sums])
            fill = np.array([sum(k) for k in self.order])
            self.table = np.concatenate(sums), np.repeat(np.arange(len(size)), size), np.repeat(fill, size), np.cumsum(size) - size
        back, kind, fill, first = self.table
        fa = sum(a)
        may = fill >= fa
        if self.counts[a] < 2:
            may &= kind != self.order.index(a)
        best = None
        for give in sorted(set(a), reverse=True):
            d = give - back
            grown = np.where(may & (d > 0) & (d <= self.capacity - fill), (fill - fa + d) * d, 0)  # growth of the squares, halved
            at = int(np.argmax(grown))
            if grown[at] > 0 and (best is None or grown[at] > best[0]):
                best = int(grown[at]), give, at
        if best is None:
            return None
        _, give, at = best
        b = self.order[kind[at]]
        out = self._backs(b)[1][at - first[kind[at]]]
        new_a, new_b = list(a), list(b)
        new_a.remove(give)
        for x in out:
            new_b.remove(x)
        return b, tuple(sorted(new_a + list(out), reverse=True)), tuple(sorted(new_b + [give], reverse=True))


def layout(kinds: list[list]):
    """Per length: (first rank, first sequence, offset) of each run of slots, as rows (length, rank, sequence, offset, bins)."""
    rows, rank, sequence = [], {}, 0
    for lengths, bins in kinds:
        at = 0
        for x in lengths:
            rows.append((x, rank.get(x, 0), sequence, at, bins))
            rank[x] = rank.get(x, 0) + bins
            at += x
        sequence += bins
    return rows


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack all documents into few sequences of at most `capacity` tokens.

    A row per piece: doc_id, piece (from 0), start (its document's ids before it), length, ids_crc32 (unsigned, of the
    ids as little-endian 32-bit integers), sequence_id, offset (gapless from 0). A document is its text's ids by the
    tokenizers file and then `end_id`; only longer ones are cut, each piece but the last being full.

    A null or empty text is the end id alone. Rows with a null doc_id are packed like others; repeated rows are packed
    as often as they come; an empty table gives none; other columns are ignored. To the driver come a row for each
    length and one more for every RANKED_AT_ONCE pieces of a length. The table of slots has a row for each run of slots
    of one length and kind of bin; it is broadcast up to BROADCAST_SLOTS rows.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    pieces = stored(token_pieces(docs, tokenizer, end_id, capacity, doc_id, text), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    kinds = improve(best_fit(histogram, capacity), capacity)
    # a length that is common is ranked in parts, each from where the one before ends
    parts = {x: -(-n // RANKED_AT_ONCE) for x, n in histogram.items() if n > RANKED_AT_ONCE}
    of = F.coalesce(F.create_map(*(F.lit(v) for x in sorted(parts.items()) for v in x))[F.col("length")], F.lit(1)) if parts else F.lit(1)
    keyed = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), of.cast("long")))
    before, ranked = [], {}
    if parts:
        for r in sorted(keyed.filter(F.col("length").isin(*parts)).groupBy("length", "part").agg(F.count("*").alias("n")).collect()):
            before.append((r["length"], r["part"], ranked.get(r["length"], 0)))
            ranked[r["length"]] = ranked.get(r["length"], 0) + r["n"]
    w = Window.partitionBy("length", "part").orderBy("doc_id", "piece")
    keyed = keyed.withColumn("rank", F.row_number().over(w) - 1)
    if before:
        start_of = spark.createDataFrame(before, "length long, part long, before long")
        keyed = keyed.join(F.broadcast(start_of), ["length", "part"], "left").withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0)))
    rows = layout(kinds)
    slots = spark.createDataFrame(rows, "length long, first long, sequence long, offset long, bins long")
    slots = slots.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "sequence", "offset"))).alias("runs"))
    if len(rows) <= BROADCAST_SLOTS:
        slots = F.broadcast(slots)
    placed = keyed.join(slots, "length").withColumn("run", _last_run())
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("run.sequence") + F.col("rank") - F.col("run.first")).alias("sequence_id"), F.col("run.offset").alias("offset"))


def _last_run():
    """The last run that begins at or before the rank, by halving."""

    def half(acc, _):
        mid = F.floor((acc["lo"] + acc["hi"] + 1) / 2).cast("int")
        right = F.element_at("runs", mid)["first"] <= F.col("rank")
        return F.struct(F.when(right, mid).otherwise(acc["lo"]).alias("lo"), F.when(right, acc["hi"]).otherwise(F.greatest(mid - 1, acc["lo"])).alias("hi"))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size("runs") + 1)).cast("int") + 1)
    at = F.aggregate(steps, F.struct(F.lit(1).alias("lo"), F.size("runs").alias("hi")), half, lambda acc: acc["lo"])
    return F.element_at("runs", at)
