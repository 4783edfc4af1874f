"""SimHash fingerprints, and their near pairs by a self-join of binary tries.

Of two fingerprints that differ in at most k bits, some quarter of 16 bits differs in at most k // 4. So each
fingerprint is turned in four ways, a different quarter on top, and goes to the trie nodes of depth 16 that its top
quarter reaches within k // 4 errors. Below such a node, or pair of nodes, pairs of nodes are walked level by level,
adding up the bits in which they differ; a pair that exceeds k is left, with all that hangs below.

Documents of a Jaccard similarity of 0.8 differ in some ten bits, too many for quarters. `similar_documents` deals
fingerprints out by bands instead: the shingles of a document are split by their hash into groups, and documents with
an equal group hang in one trie, which is joined with a wide budget. Whole shingle sets decide on what it leaves.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, components, dropped, freeing, stored, text_blocks, word_spans

#: A-Z to a-z, all other bytes unchanged.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bands a document has at most, and shingles of a band (at least on average, and up to twice as many).
BANDS, BAND_SHINGLES = 16, 4
#: Bits in which fingerprints of similar documents may differ. At a Jaccard similarity of 0.8 it is 9.7 on average with
#: a standard deviation of 2.9; short texts scatter more.
SIMILAR_BITS = 24

#: Node pairs with at most so many pairs of leaves are compared leaf by leaf.
LEAVES = 1024
#: Pairs compared at once; a memory bound.
AT_ONCE = 1 << 19
#: Rows of one node, or pair of nodes, beyond which its children are dealt out in pairs.
HOT_NODE = 20_000
#: Rows of a node from which it is joined on its own.
LARGE_NODE = 64
#: Documents of a band that are compared in one task, and shingles that are counted at once; memory bounds.
BAND_ROWS, SHINGLES_AT_ONCE = 1024, 2048


def _joined(data: np.ndarray, offsets: np.ndarray):
    """Lower-cased text in which each run of white space is one space, and its offsets."""
    space = SPACE[data]
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    out = _LOWER[data]
    out[space] = 0x20
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, shingle: int):
    """XXH64 (seed 42) of all shingles in a block: documents that have any, bounds of each one's, and the hashes."""
    from xxhash import xxh64_intdigest

    none = np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint64)
    if not len(data):
        return none
    text, at = _joined(data, offsets)
    starts, ends, first = word_spans(text, at)
    words = np.diff(first)
    shingles = np.where(words > 0, np.maximum(words - shingle + 1, 1), 0)
    full = np.flatnonzero(shingles)
    if not len(full):
        return none
    begin = np.concatenate([[0], np.cumsum(shingles[full])])
    doc = np.repeat(np.arange(len(full)), shingles[full])
    word = first[full][doc] + np.arange(begin[-1]) - begin[:-1][doc]
    last = np.minimum(word + shingle, first[full + 1][doc]) - 1
    raw = text.tobytes()
    hashes = np.fromiter((xxh64_intdigest(raw[a:b], 42) for a, b in zip(starts[word].tolist(), ends[last].tolist(), strict=True)), np.uint64, begin[-1])
    return full, begin, hashes


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    """Fingerprints of a block of documents as unsigned 64-bit integers."""
    return majority(len(offsets) - 1, *shingle_hashes(data, offsets, shingle))


def majority(n: int, full: np.ndarray, begin: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The bits that over half of each document's hashes have; zero for documents without any."""
    out = np.zeros(n, np.uint64)
    shingles = np.diff(begin)
    at = 0
    while at < len(full):  # bits are unpacked for so many shingles at once
        to = max(at + 1, int(np.searchsorted(begin, begin[at] + (1 << 16), side="right")) - 1)
        sums = np.zeros((to - at, 64), np.int64)
        for lo in range(begin[at], begin[to], 1 << 17):
            hi = min(begin[to], lo + (1 << 17))
            bits = np.unpackbits(hashes[lo:hi].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            inside = np.maximum(begin[at:to], lo)
            own = np.flatnonzero((begin[at:to] < hi) & (begin[at + 1 : to + 1] > lo))
            sums[own] += np.add.reduceat(bits, inside[own] - lo, axis=0, dtype=np.int32)
        half = sums * 2 > shingles[at:to, None]
        out[full[at:to]] = np.packbits(half, axis=1).view(">u8")[:, 0]
        at = to
    return out


def sets_of(n: int, full: np.ndarray, begin: np.ndarray, hashes: np.ndarray):
    """Sorted distinct shingle hashes of n documents as signed longs, and the bounds of each document's."""
    doc = np.repeat(full, np.diff(begin))
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new].view(np.int64), np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=n))]).astype(np.int64)


def bands_of(values: np.ndarray, bounds: np.ndarray, least: float):
    """Keys of the bands of each shingle set, and the bounds of each document's.

    A set of n shingles is split by their hashes into 2**level groups of BAND_SHINGLES to twice as many on average; a
    band is one of its first BANDS groups that is not empty, and its key a sum over the group. Sets of a similarity of
    `least` differ in size by at most that factor, so a set close to the next level has the bands of both.
    """
    n = np.diff(bounds)
    level = np.where(n > BAND_SHINGLES, np.floor(np.log2(np.maximum(n, 1) / BAND_SHINGLES) + 1e-12), 0).astype(np.int64)
    more = n >= least * BAND_SHINGLES * 2.0 ** (level + 1) - 1e-9
    doc = np.concatenate([np.flatnonzero(n), np.flatnonzero(more)])
    level = np.concatenate([level[n > 0], level[more] + 1])
    order = np.argsort(doc, kind="stable")
    doc, level = doc[order], level[order]
    entry = np.repeat(np.arange(len(doc)), n[doc])
    at = bounds[:-1][doc][entry] + np.arange(len(entry)) - np.repeat(np.cumsum(n[doc]) - n[doc], n[doc])
    hashes = values[at].view(np.uint64)
    group = (hashes & ((np.uint64(1) << level[entry].astype(np.uint64)) - np.uint64(1))).astype(np.int64)
    kept = group < BANDS
    entry, group, hashes = entry[kept], group[kept], hashes[kept]
    order = np.lexsort((group, entry))
    entry, group, hashes = entry[order], group[order], hashes[order]
    if not len(entry):
        return np.zeros(0, np.int64), np.zeros(len(n) + 1, np.int64)
    new = np.ones(len(entry), bool)
    new[1:] = (entry[1:] != entry[:-1]) | (group[1:] != group[:-1])
    with np.errstate(over="ignore"):
        mixed = hashes ^ (hashes >> np.uint64(29))
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        key = np.add.reduceat(mixed, np.flatnonzero(new)) + (level[entry[new]] * BANDS + group[new]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return key.view(np.int64), np.concatenate([[0], np.cumsum(np.bincount(doc[entry[new]], minlength=len(n)))]).astype(np.int64)


def fingerprints(docs: DataFrame, shingle: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row (doc_id, fp) per document, fp the 64-bit fingerprint as a signed long. Map-only."""

    def run(batches):
        for ids, data, offsets in text_blocks(batches):
            fp = fingerprints_of(data, offsets, shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(freeing(run), "doc_id long, fp long")


def _product(a_lo, a_hi, b_lo, b_hi):
    """All index pairs of paired ranges, in parts of about AT_ONCE."""
    sizes = (a_hi - a_lo) * (b_hi - b_lo)
    at, sums = 0, np.concatenate([[0], np.cumsum(sizes)])
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(sums, sums[at] + AT_ONCE, side="right")) - 1)
        rep = np.repeat(np.arange(at, to), sizes[at:to])
        k = np.arange(len(rep)) - (sums[rep] - sums[at])
        wide = (b_hi - b_lo)[rep]
        yield a_lo[rep] + k // wide, b_lo[rep] + k % wide
        at = to


class Forest:
    """Smallest connected index of each index, under pairs that come in parts."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while True:
            a, b = root[i], root[j]
            open_ = a != b
            if not open_.any():
                break
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
            self.root = root
        self.root = root


def trie_join(values: np.ndarray, bounds: np.ndarray, side: np.ndarray, depth: int, budget: int, errors: np.ndarray):
    """Self-join of tries: pairs of indices whose values differ in at most `budget` bits, in parts of bounded size.

    `values` (unsigned) are sorted within each group [bounds[g], bounds[g + 1]); groups of one top node (one side, errors
    0) join with themselves; in groups of a pair of nodes, the rows with side 0 come first and join with side 1,
    `errors` bits being spent on top. All values of a node agree in the top `depth` bits.
    """
    lo, hi = bounds[:-1], bounds[1:]
    ones = np.concatenate([[0], np.cumsum(side)])
    pair = (errors > 0) | (ones[hi] > ones[lo])
    mid = hi - (ones[hi] - ones[lo])
    s_lo, s_hi = lo[~pair], hi[~pair]
    c = [lo[pair], mid[pair], mid[pair], hi[pair], errors[pair]]

    def leaves(a_lo, a_hi, b_lo, b_hi, same: bool):
        for i, j in _product(a_lo, a_hi, b_lo, b_hi):
            if same:
                i, j = i[i < j], j[i < j]
            near = np.bitwise_count(values[i] ^ values[j]) <= budget
            yield i[near], j[near]

    for d in range(depth, 64):
        big = (s_hi - s_lo) ** 2 > LEAVES
        if (small := ~big & (s_hi - s_lo > 1)).any():
            yield from leaves(s_lo[small], s_hi[small], s_lo[small], s_hi[small], True)
        s_lo, s_hi = s_lo[big], s_hi[big]
        some = (c[1] > c[0]) & (c[3] > c[2]) & (c[4] <= budget)
        c = [x[some] for x in c]
        small = (c[1] - c[0]) * (c[3] - c[2]) <= LEAVES
        if small.any():
            yield from leaves(*(x[small] for x in c[:4]), False)
            c = [x[~small] for x in c]
        if not len(s_lo) and not len(c[0]):
            return
        bit = np.concatenate([[0], np.cumsum((values >> np.uint64(63 - d)) & np.uint64(1))]).astype(np.int64)
        cut = lambda a, b: b - (bit[b] - bit[a])  # noqa: E731  where the ones of a node begin
        m, am, bm = cut(s_lo, s_hi), cut(c[0], c[1]), cut(c[2], c[3])
        e = c[4]
        c = [np.concatenate(x) for x in zip((s_lo, m, m, s_hi, np.ones(len(m), np.int64)), (c[0], am, c[2], bm, e), (am, c[1], bm, c[3], e), (c[0], am, bm, c[3], e + 1), (am, c[1], c[2], bm, e + 1), strict=True)]
        s_lo, s_hi = np.concatenate([s_lo, m]), np.concatenate([m, s_hi])
    some = (c[1] > c[0]) & (c[3] > c[2]) & (c[4] <= budget)
    yield from leaves(*(x[some] for x in c[:4]), False)
    yield from leaves(s_lo, s_hi, s_lo, s_hi, True)


def near_links(distinct: DataFrame, budget: int, fp: str = "fp", node: str = "node") -> DataFrame:
    """Links (a, b) of nodes whose fingerprints differ in at most `budget` bits: a spanning forest of each trie node.

    `distinct` has one row per fingerprint; each goes to the trie nodes of depth 16 of its four turns.
    """
    if not 0 <= budget <= 11:
        raise ValueError("the budget of bits is 0 to 11")
    turned = distinct.select(F.col(node).alias("node"), F.col(fp).alias("fp"), F.explode(F.array(*(F.lit(r) for r in range(4)))).alias("turn"))
    rot = F.expr("CASE turn WHEN 0 THEN fp ELSE (shiftleft(fp, 16 * turn) | shiftrightunsigned(fp, 64 - 16 * turn)) END")
    turned = turned.withColumn("v", rot).withColumn("top", F.shiftrightunsigned("v", 48))
    rows = _node_pairs(turned, "top", 16, budget // 4, "turn").select("node", "v", "key", "side", "spent")

    def found(rows: pa.Table, pairs):
        nodes, forest = rows["node"].to_numpy(), Forest(len(rows))
        for i, j in pairs:
            forest.add(np.minimum(i, j), np.maximum(i, j))
        tied = np.flatnonzero(forest.root != np.arange(len(rows)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[tied]), pa.array(nodes[forest.root[tied]])], names=["a", "b"])

    return _joined_tries(_dealt(rows, budget, 16), budget, found)


def _dealt(rows: DataFrame, budget: int, depth: int) -> DataFrame:
    """Rows (node, v, key, side, spent) with the depth of their trie node; hot nodes by pairs of their children.

    `key` names a trie node of this depth, or a pair of them on which `spent` bits differ. A key of more than HOT_NODE
    rows is dealt out by pairs of its children 8 bits deeper, and these again while they are too large, so no node is
    one task's however many fingerprints it holds.
    """
    rows = stored(rows, "trie")
    parts = []
    while depth <= 48:
        hot = stored(rows.groupBy("key").agg(F.count("*").alias("rows")).filter(F.col("rows") > HOT_NODE).select("key"), "hot")
        if hot.isEmpty():
            break
        parts.append(rows.join(hot, "key", "left_anti").withColumn("depth", F.lit(depth)))
        rows = stored(_children(rows.join(hot, "key", "left_semi"), budget, depth), "trie")
        depth += 8
    parts.append(rows.withColumn("depth", F.lit(depth)))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both


def _joined_tries(rows: DataFrame, budget: int, found) -> DataFrame:
    """(a, b) that `found` makes of the rows of trie nodes and the pairs of the join; rows are dealt out by key."""
    both = rows.repartition("key").sortWithinPartitions("depth", "key", "side", F.expr("v ^ (-9223372036854775807L - 1L)"))

    def run(batches):
        held = []
        for batch in batches:
            key = batch["key"].to_numpy()
            new = np.flatnonzero(key[1:] != key[:-1]) + 1
            if held and held[-1]["key"][-1].as_py() != int(key[0]):
                yield from linked(held)
                held = []
            if len(new):  # the last key may go on in the next batch
                held.append(batch.slice(0, int(new[-1])))
                yield from linked(held)
                held = []
                batch = batch.slice(int(new[-1]))
            held.append(batch)
        if held:
            yield from linked(held)

    def linked(held):
        t = pa.Table.from_batches(held)
        key, v = t["key"].to_numpy(), t["v"].to_numpy().view(np.uint64)
        bounds = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        side, spent, depth = (t[c].to_numpy().astype(np.int64) for c in ("side", "spent", "depth"))
        # a large node is joined on its own, small ones of a depth together
        size = np.diff(bounds)
        edges = np.unique(np.concatenate([[0, len(size)], *((g, g + 1) for g in np.flatnonzero(size >= LARGE_NODE)), np.flatnonzero(np.diff(depth[bounds[:-1]])) + 1]))
        for g, h in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            lo, hi = bounds[g], bounds[h]
            own = bounds[g : h + 1] - lo
            yield from found(t.slice(lo, hi - lo), trie_join(v[lo:hi], own, side[lo:hi], int(depth[lo]), budget, spent[lo:hi][own[:-1]]))

    return both.mapInArrow(freeing(run), "a long, b long")


def _node_pairs(rows: DataFrame, top: str, bits: int, spend: int, turn: str) -> DataFrame:
    """Rows for every pair of top nodes within `spend` errors: key, side (1: the larger node) and spent."""
    masks = [0] + [sum(1 << x for x in c) for e in range(1, spend + 1) for c in combinations(range(bits), e)]
    if len(masks) == 1:
        out = rows.withColumn("mask", F.lit(0).cast("long"))
    else:
        out = rows.withColumn("mask", F.explode(F.array(*(F.lit(m).cast("long") for m in masks))))
    a, b = F.col(top), F.col(top).bitwiseXOR(F.col("mask"))
    key = F.shiftleft(F.col(turn).cast("long"), 2 * bits).bitwiseOR(F.shiftleft(F.least(a, b), bits)).bitwiseOR(F.greatest(a, b))
    return out.withColumn("key", key).withColumn("side", (a > b).cast("int")).withColumn("spent", F.bit_count("mask").cast("int"))


def _children(hot: DataFrame, budget: int, depth: int) -> DataFrame:
    """Rows of hot nodes or node pairs by pairs of their children, 8 bits deeper, that stay within the budget."""
    child = F.shiftrightunsigned("v", 56 - depth).bitwiseAND(F.lit(255).cast("long"))
    masks = [0] + [sum(1 << x for x in c) for e in range(1, min(budget, 8) + 1) for c in combinations(range(8), e)]
    allowed = F.filter(F.array(*(F.lit(m).cast("long") for m in masks)), lambda m: F.bit_count(m) + F.col("spent") <= budget)
    hot = hot.withColumn("__child", child)
    # rows go only where the other side has some: at most 512 children of a hot key
    there = stored(hot.select(F.col("key").alias("__key"), F.when(F.col("spent") == 0, 0).otherwise(1 - F.col("side")).alias("__side"), F.col("__child").alias("__other")).distinct(), "children")
    out = hot.withColumn("__mask", F.explode(allowed)).withColumn("__other", F.col("__child").bitwiseXOR(F.col("__mask")))
    met = (F.col("key") == F.col("__key")) & (F.when(F.col("spent") == 0, 0).otherwise(F.col("side")) == F.col("__side")) & (out["__other"] == there["__other"])
    out = out.join(there, met, "left_semi")
    own, other = F.col("__child"), F.col("__other")
    self_pair = F.col("spent") == 0  # both sides are one node: the smaller child is side 0
    low = F.when(self_pair, F.least(own, other)).when(F.col("side") == 0, own).otherwise(other)
    high = F.when(self_pair, F.greatest(own, other)).when(F.col("side") == 0, other).otherwise(own)
    side = F.when(self_pair, (own > other).cast("int")).otherwise(F.col("side"))
    fresh = {"key": F.xxhash64("key", low, high), "side": side, "spent": (F.col("spent") + F.bit_count("__mask")).cast("int")}
    return out.select(*(fresh[c].alias(c) if c in fresh else c for c in hot.columns if c != "__child"))


def near_duplicates(docs: DataFrame, shingle: int = 5, budget: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Class of near duplicates of every document: doc_id, fp, fingerprint (16 hex digits), component_id.

    Texts are lower-cased (A-Z), split at ASCII white space and taken as shingles of `shingle` words, repeats
    included; a text of fewer words is one shingle. A bit of the fingerprint is set if it is in over half of the
    shingles' XXH64 (seed 42). Fingerprints within `budget` bits are linked; component_id is the smallest doc_id
    reachable by links.

    A null or empty text, or one of white space alone, has fingerprint zero, linked like any other. Rows with a null
    doc_id keep it and get the component of their fingerprint, null where no row of it has a doc_id. Repeated rows
    give repeated rows; an empty table gives none; other columns are ignored. Equal fingerprints are one node,
    so groups of copies are aggregated before any join.
    """
    fps = stored(fingerprints(docs, shingle, doc_id, text), "fingerprints")
    classes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("node")).filter("node IS NOT NULL"), "classes")
    found = components(near_links(classes, budget))
    whole = classes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(whole, "fp", "left").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _signatures(docs: DataFrame, shingle: int, least: float) -> DataFrame:
    """doc_id, cls (a digest of the shingle set), n (its size), fp and bands of every document. Map-only."""

    def run(batches):
        from xxhash import xxh3_128_digest

        for ids, data, offsets in text_blocks(batches):
            found = shingle_hashes(data, offsets, shingle)
            fp = majority(len(ids), *found).view(np.int64)
            values, bounds = sets_of(len(ids), *found)
            cls = [xxh3_128_digest(values[a:b].tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            keys, at = bands_of(values, bounds, least)
            bands = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(cls, pa.binary()), pa.array(np.diff(bounds), pa.int32()), pa.array(fp), bands], names=["doc_id", "cls", "n", "fp", "bands"])

    return docs.mapInArrow(freeing(run), "doc_id long, cls binary, n int, fp long, bands array<long>")


def _sets(nodes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(id, items): the sorted shingle hashes of the documents in column `doc_id` of `nodes`."""

    def run(batches):
        for ids, data, offsets in text_blocks(batches):
            values, bounds = sets_of(len(ids), *shingle_hashes(data, offsets, shingle))
            items = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), items], names=["id", "items"])

    return stored(docs.join(nodes.distinct(), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(freeing(run), "id long, items array<long>"), "sets")


def _similar(pairs: DataFrame, docs: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs (a, b) of doc_ids whose whole shingle sets reach the Jaccard similarity."""
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), docs, shingle)
    a, b = sets.select(F.col("id").alias("a"), F.col("items").alias("x")), sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", F.size("x").alias("na"), F.size("y").alias("nb"), F.size(F.array_intersect("x", "y")).alias("common"))
    out = stored(both.filter(F.col("common") >= (F.col("na") + F.col("nb") - F.col("common")) * least - 1e-9).select("a", "b").distinct(), "similar")
    dropped(sets)
    return out


def shared_items(values: np.ndarray, bounds: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Items that the sets i and j of each pair have in common; a set is a sorted stretch of `values`."""
    members, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    i, j = at[: len(i)], at[len(i) :]
    size = bounds[members + 1] - bounds[members]
    row = np.repeat(np.arange(len(members)), size)
    own = values[bounds[members][row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)]
    _, code, count = np.unique(own, return_inverse=True, return_counts=True)
    some = count[code] > 1  # what one set alone has is in no intersection
    row, code = row[some], code[some]
    if len(members) <= 2 * BAND_ROWS and len(i) > 8 * len(members):
        # many pairs of few sets: products of the sets as rows of zeros and ones
        order = np.argsort(code, kind="stable")
        row, code = row[order], code[order]
        first = np.flatnonzero(np.diff(code, prepend=-1))
        column = np.cumsum(np.diff(code, prepend=-1) > 0) - 1
        common = np.zeros((len(members), len(members)), np.float32)
        for lo in range(0, len(first), SHINGLES_AT_ONCE):
            a, b = first[lo], first[lo + SHINGLES_AT_ONCE] if lo + SHINGLES_AT_ONCE < len(first) else len(row)
            m = np.zeros((len(members), SHINGLES_AT_ONCE), np.float32)
            m[row[a:b], column[a:b] - lo] = 1
            common += m @ m.T
        return common[i, j].astype(np.int64)
    width = len(count)
    keys = np.sort(row * width + code)
    begin = np.searchsorted(keys, np.arange(len(members) + 1) * width)
    out = np.zeros(len(i), np.int64)
    sizes = np.diff(begin)[i]
    for lo, hi in _stretches(sizes):
        pair = np.repeat(np.arange(lo, hi), sizes[lo:hi])
        spot = begin[i[pair]] + np.arange(len(pair)) - np.repeat(np.cumsum(sizes[lo:hi]) - sizes[lo:hi], sizes[lo:hi])
        want = keys[spot] + (j[pair] - i[pair]) * width
        there = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
        out[lo:hi] = np.bincount(pair[keys[there] == want] - lo, minlength=hi - lo)
    return out


def _stretches(sizes: np.ndarray):
    """Ranges of indices whose sizes sum up to about AT_ONCE."""
    at, sums = 0, np.concatenate([[0], np.cumsum(sizes)])
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(sums, sums[at] + AT_ONCE, side="right")) - 1)
        yield at, to
        at = to


def _linked_sets(rows: DataFrame, sets: DataFrame, bits: int, least: float) -> DataFrame:
    """Links (a, b) between components among the documents of each band, by their whole sets.

    rows: node, v, key, c (its component), blocks (into which the band is split); sets: id, items. A band of more than BAND_ROWS documents is dealt out by pairs of
    blocks, so none is one task's. A task returns a spanning forest, not pairs.
    """
    own = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = met.select("node", "v", F.xxhash64("key", F.least("own", "o"), F.greatest("own", "o")).alias("key"), (F.col("own") > F.col("o")).cast("int").alias("side"), F.lit(0).alias("spent"), F.lit(0).alias("depth"), "c")
    dealt = dealt.join(sets, dealt["node"] == sets["id"]).drop("id")

    def found(rows: pa.Table, near):
        node, c = rows["node"].to_numpy(), rows["c"].to_numpy()
        items = rows["items"].combine_chunks()
        items = items if isinstance(items, pa.ListArray) else pa.concat_arrays(items.chunks)
        bounds, values = items.offsets.to_numpy().astype(np.int64), items.values.to_numpy()
        n, forest = np.diff(bounds), Forest(len(node))
        for i, j in near:
            some = (c[i] != c[j]) & (n[i] >= n[j] * least - 1e-9) & (n[j] >= n[i] * least - 1e-9) & (forest.root[i] != forest.root[j])
            i, j = i[some], j[some]
            if len(i):
                common = shared_items(values, bounds, i, j)
                like = common >= (n[i] + n[j] - common) * least - 1e-9
                forest.add(np.minimum(i, j)[like], np.maximum(i, j)[like])
        tied = np.flatnonzero(forest.root != np.arange(len(node)))
        yield pa.RecordBatch.from_arrays([pa.array(node[tied]), pa.array(node[forest.root[tied]])], names=["a", "b"])

    return stored(_joined_tries(dealt, bits, found), "similar")


def similar_documents(docs: DataFrame, shingle: int = 5, least: float = 0.8, doc_id: str = "doc_id", text: str = "text", bits: int = SIMILAR_BITS) -> DataFrame:
    """doc_id and component_id of every document: the smallest doc_id reachable by links of a Jaccard similarity of `least`.

    Shingles are those of the fingerprints, as a set. Documents that share a band hang in one trie of fingerprints; what
    its join leaves within `bits` is compared by whole shingle sets, so no other pair is linked. A pair is missed where
    it shares none of its bands, or differs in more bits; README.md has the measured recall.

    Documents with equal sets are one node. Texts without a word have the empty set, equal to itself alone. Rows that
    share a doc_id are one document, linked by any of its texts; rows with a null doc_id keep it and get the component
    of their set. An empty table gives none; other columns are ignored.

    Links are found in two rounds. In the first, documents are compared with the first one of their bands. In the
    second, the tries of bands that still hold several components are joined, and the sets of pairs in different ones
    are compared within the task, which returns a spanning forest; so no pairs are written, however many are alike.
    """
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = stored(_signatures(given, shingle, least), "signatures")
    classes = signed.filter("doc_id IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("node"), F.min("n").alias("n"), F.min("fp").alias("v"), F.first("bands").alias("bands"))
    classes = stored(classes, "classes")
    rows = classes.select("node", "n", "v", F.explode("bands").alias("key"))
    first = rows.groupBy("key").agg(F.min(F.struct("node", "n", "v")).alias("f"), F.count("*").alias("rows")).filter("rows > 1").select("key", "f")
    met = stored(rows.join(first, "key"), "met")
    alike = (F.col("n") >= F.col("f.n") * least - 1e-9) & (F.col("f.n") >= F.col("n") * least - 1e-9) & (F.bit_count(F.col("v").bitwiseXOR(F.col("f.v"))) <= bits)
    pairs = stored(met.filter((F.col("node") > F.col("f.node")) & alike).select(F.col("f.node").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    links = _similar(pairs, given, shingle, least)
    # the first one of a band has met all others; the second round is among these
    placed = met.filter(F.col("node") != F.col("f.node")).select("key", "node", "v").join(components(links), "node", "left").select("node", "v", "key", F.coalesce("component", "node").alias("c"))
    open_ = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("rows")).filter("low < high").select("key", F.ceil(F.col("rows") / BAND_ROWS).cast("int").alias("blocks"))
    rest = stored(placed.join(open_, "key"), "rest")
    sets = _sets(rest.select(F.col("node").alias("doc_id")), given, shingle)
    more = _linked_sets(rest, sets, bits, least)
    found = components(links.unionByName(more))
    whole = stored(classes.join(found, "node", "left").select("cls", F.coalesce("component", "node").alias("component_id")), "whole")
    for df in (met, pairs, links, rest, sets, more, classes, found):
        dropped(df)
    return signed.select("doc_id", "cls").join(whole, "cls", "left").select("doc_id", "component_id")


def first_of_groups(docs: DataFrame, shingle: int = 5, least: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents but those of a group of similar ones with a smaller doc_id. Columns as given.

    Rows that share a doc_id go or stay together: they go if any of their texts has a smaller doc_id in its group. Rows
    with a null doc_id stay.
    """
    gone = similar_documents(docs, shingle, least, doc_id, text).filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[doc_id] == gone["__gone"], "left_anti")
