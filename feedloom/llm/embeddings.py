"""Near duplicates among embeddings by quantised tile products, and exact top-k search by MaxScore."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, stored
from .simhash import Forest

#: Vectors of a tile; a task holds two tiles.
TILE = 4096
#: Rows of a tile multiplied at once, and pairs recomputed at once.
STRIPE, PAIRS = 512, 1 << 16
#: Dimensions whose int8 products a float32 sums exactly: 1024 * 127**2 < 2**24.
EXACT_DIMENSIONS = 1024
#: Rounding room of double precision in the error bounds.
SLACK = 1e-9


def usable(vector: str):
    """Whether a vector has components, none of them null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def _matrix(column, dims: int, dtype) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), dims).astype(dtype)


class Quantised:
    """Unit vectors as int8 with a scale each, and a bound on what that leaves out of each.

    With u = s q + r, |u.v - s t (q.p)| <= |r_u| |v| + |s q| |r_v| <= |r_u| + (1 + |r_u|) |r_v| for unit u and v.
    """

    def __init__(self, x: np.ndarray):
        self.x = x / np.abs(x).max(axis=1, keepdims=True)  # against overflow of squares
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.x, self.x))
        unit = self.x / self.norm[:, None]
        self.scale = np.abs(unit).max(axis=1) / 127
        self.q = np.rint(unit / self.scale[:, None]).astype(np.int8)
        rest = unit - self.q * self.scale[:, None]
        self.error = np.sqrt(np.einsum("ij,ij->i", rest, rest)) + SLACK

    def product(self, rows: slice, other: Quantised) -> np.ndarray:
        """Exact integer products of int8 vectors, by float32 matrix products over few enough dimensions."""
        out = None
        for d in range(0, self.q.shape[1], EXACT_DIMENSIONS):
            part = self.q[rows, d : d + EXACT_DIMENSIONS].astype(np.float32) @ other.q[:, d : d + EXACT_DIMENSIONS].astype(np.float32).T
            out = part.astype(np.float64) if out is None and self.q.shape[1] > EXACT_DIMENSIONS else part if out is None else out + part
        return out

    def cosines(self, i: np.ndarray, other: Quantised, j: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", self.x[i], other.x[j]) / (self.norm[i] * other.norm[j])


def linked(a: Quantised, b: Quantised, least: float, same: bool):
    """Index pairs with a cosine of at least `least`, in parts: int8 products pass what may be, doubles decide."""
    for lo in range(0, len(a.x), STRIPE):
        rows = slice(lo, min(len(a.x), lo + STRIPE))
        bound = a.product(rows, b) * a.scale[rows, None] * b.scale[None, :] + a.error[rows, None] + (1 + a.error[rows, None]) * b.error[None, :]
        i, j = np.nonzero(bound >= least - SLACK)
        i += lo
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), PAIRS):
            ii, jj = i[k : k + PAIRS], j[k : k + PAIRS]
            near = a.cosines(ii, b, jj) >= least
            yield ii[near], jj[near]


def near_embeddings(vectors: DataFrame, least: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", tile: int = TILE) -> DataFrame:
    """Links of every vector among those of its label: vec_id, n_links, component_id, kept.

    Vectors are linked if their labels are equal and not null and their cosine, in doubles, is at least `least`.
    n_links counts other vectors linked directly, component_id is the smallest vec_id reachable by links, itself
    included, and kept tells whether it is the vector's own.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different lengths, null labels or null vec_ids (component_id is then null and kept false). Repeated rows are linked
    copies; rows that share a vec_id are judged one by one; an empty table gives none; other columns are ignored. Equal
    vectors of a label are one class, compared once and counted by size. Classes of a label are dealt over tiles by hash, and tiles meet in pairs, so a label with
    most rows is many tasks; a task returns sums and a spanning forest, not pairs.
    """
    given = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), F.col(label).alias("label"))
    fit = usable("v") & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.exists("v", lambda x: x != 0)
    valid = given.filter(fit)
    grouped = valid.groupBy("label", "v").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
    # numbered as they are written, and read from there alone: a vec_id that comes with several vectors is in several classes
    classes = stored(grouped.select(F.monotonically_increasing_id().alias("rep"), "label", "v", "low", "n", F.size("v").alias("dims")), "vectors")
    tiles = classes.groupBy("label", "dims").agg(F.ceil(F.count("*") / tile).cast("long").alias("tiles"))
    own = classes.join(tiles, ["label", "dims"]).withColumn("t", F.pmod(F.xxhash64("rep"), F.col("tiles")))
    met = own.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    met = met.select("label", "dims", F.least("t", "o").alias("a"), F.greatest("t", "o").alias("b"), "t", "rep", "n", "v")

    def run(key, table):
        dims, a, b = key[1].as_py(), key[2].as_py(), key[3].as_py()
        t, rep, n = table["t"].to_numpy(), table["rep"].to_numpy(), table["n"].to_numpy()
        x = _matrix(table["v"], dims, np.float64)
        first = np.flatnonzero(t == a)
        left = Quantised(x[first])
        other = np.flatnonzero(t == b) if a != b else first
        right = Quantised(x[other]) if a != b else left
        links, forest = np.zeros(len(t), np.int64), Forest(len(t))
        for i, j in linked(left, right, least, a == b) if len(first) and len(other) else ():
            i, j = first[i], other[j]
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            forest.add(np.minimum(i, j), np.maximum(i, j))
        some = np.flatnonzero(links)
        return pa.table({"rep": rep[some], "links": links[some], "root": rep[forest.root[some]]})

    found = stored(met.groupBy("label", "dims", "a", "b").applyInArrow(run, "rep long, links long, root long"), "tiles")
    whole = components(found, "rep", "root")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    per_class = classes.join(links, "rep", "left").join(whole, classes["rep"] == whole["node"], "left")
    per_class = per_class.select("label", "v", "low", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    per_class = stored(per_class, "classes")
    lowest = per_class.groupBy("c").agg(F.min("low").alias("component_id"))
    per_class = per_class.join(lowest, "c").select("label", "v", "n_links", "component_id")
    inside = valid.join(per_class, ["label", "v"]).select("vec_id", "n_links", "component_id")
    outside = given.filter(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return inside.unionByName(outside).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: Candidates of a shard, candidates scanned between two looks at the threshold, and queries of a block.
SHARD, SCAN, QUERY_BLOCK = 16384, 4096, 1024
#: Terms added between two prunings.
TERMS = 8
#: Sums of products that stay below this are exact in 64 bits; beyond, Python's integers count.
EXACT = 1 << 62
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles: 64-bit integers, or Python's where some do not fit."""
    if not x.size or np.abs(x).max() < EXACT / scale:
        return np.floor(x * scale).astype(np.int64)
    whole = lambda v: int(v) * scale if abs(v) >= 1 << 53 else int(np.floor(v * scale))
    return np.array([whole(v) for v in x.ravel().tolist()], dtype=object).reshape(x.shape)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if scores.dtype != object:
        return np.lexsort((ids, -scores))[:k]
    return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], dtype=np.int64)


def max_score(postings: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int):
    """Top k of one shard for one query: (scores, ids), best first and ties to the smaller id.

    postings[d] lists the values of term d by candidate. The contribution q_d x_d of a term is counted from its least
    in the shard, so it is never negative, and its bound is its largest. Terms whose bounds together stay below what
    the k-th best needs are non-essential: essential lists are traversed in full, the others probed, by falling
    bounds, only for candidates that can still reach the k-th best.
    """
    products = query[:, None] * np.stack([postings.min(axis=1), postings.max(axis=1)], axis=1)
    low, bound = products.min(axis=1), np.ptp(products, axis=1)
    order = np.argsort(-bound, kind="stable")
    left = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])  # what the terms from here on can add
    base = int(low.sum())
    kind = products.dtype
    best_s, best_i = np.zeros(0, kind), np.zeros(0, np.int64)
    for at in range(0, postings.shape[1], SCAN):
        block = slice(at, at + SCAN)
        live = np.flatnonzero(ids[block] != own)
        need = best_s[-1] - base if len(best_s) == k and best_s[-1] > _LEAST else None
        essential = len(order) if need is None else int(np.searchsorted(-left, -need, side="right"))
        score = np.zeros(len(live), kind)
        for t in range(0, len(order), TERMS):
            for d in order[t : t + TERMS]:
                score += query[d] * postings[d, block][live] - low[d]
            done = min(t + TERMS, len(order))
            if need is not None and (done >= essential or done % (2 * TERMS) == 0):
                hope = score + left[done] >= need
                live, score = live[hope], score[hope]
                if not len(live):
                    break
        full = score + base
        s, i = np.concatenate([best_s, np.clip(full, _LEAST, _MOST) if kind == object else full]), np.concatenate([best_i, ids[block][live]])
        top = _best(s, i, k)
        best_s, best_i = s[top], i[top]
    return best_s, best_i


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding", shard: int = SHARD, block: int = QUERY_BLOCK) -> DataFrame:
    """The k best candidates of every query by inner product of integer vectors: query_id, rank (from 1), vec_id, score.

    Components become floor(scale * x). Queries are the rows whose vec_id is divisible by `every`, candidates all rows
    but those of the query's own vec_id; ties go to the smaller vec_id, and all come where there are fewer than k.

    Vectors that are null, empty or hold null or non-finite components take no part, nor do null vec_ids; vectors of
    different lengths do not meet. Repeated rows are candidates, and queries, of their own (a repeated query returns its
    ranks once). An empty table gives none; other columns are ignored. All sums are exact: where 64 bits might not hold
    them, Python's integers do; a score that no long can hold is the nearest long. Queries in blocks meet candidates in
    shards; each pair returns k rows a query, merged by rank.
    """
    rows = vectors.filter(F.col(vec_id).isNotNull() & usable(embedding)).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).withColumn("dims", F.size("v"))
    queries = rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
    shards = max(1, -(-rows.count() // shard))
    blocks = max(1, -(-queries.count() // block))
    deal = lambda df, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    keys = ["shard", "block", "dims"]
    candidates = deal(rows, "shard", shards, "block", blocks).groupBy(*keys)
    asked = deal(queries, "block", blocks, "shard", shards).groupBy(*keys)

    def run(key, left, right):
        out = [[], [], []]
        if len(left) and len(right):
            dims = key[2].as_py()
            order = np.argsort(left["vec_id"].to_numpy(), kind="stable")
            ids = left["vec_id"].to_numpy()[order]
            postings, asked_v = (scaled(_matrix(t["v"], dims, np.float64), scale) for t in (left, right))
            if dims * int(np.abs(postings).max(initial=0)) * int(np.abs(asked_v).max(initial=0)) >= EXACT:
                postings, asked_v = postings.astype(object), asked_v.astype(object)
            postings = np.ascontiguousarray(postings[order].T)
            for q, own in zip(asked_v, right["vec_id"].to_numpy(), strict=True):
                s, i = max_score(postings, ids, q, int(own), k)
                out[0].append(np.full(len(s), own))
                out[1].append(i)
                out[2].append(s.astype(np.int64))
        return pa.table({n: np.concatenate(o) if o else np.zeros(0, np.int64) for n, o in zip(("query_id", "vec_id", "score"), out, strict=True)})

    found = candidates.cogroup(asked).applyInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


NEAR_ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lowest AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN lowest c ON e.vec_id = c.a LEFT JOIN degree d ON d.a = e.vec_id
"""

TOP_K_ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
