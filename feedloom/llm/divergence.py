"""Source divergence audit: how far the word distributions of a language's sources lie apart.

Groups are (lang, source). Count vectors of kept terms are packed by vocabulary chunk and replicated to tiles of a block of
groups by a block of groups; a tile adds up its submatrix of pair sums over successive chunks of a span of the vocabulary,
and the spans' submatrices are summed. All arithmetic is in whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, freeing, stored, text_blocks

#: Groups a side of a tile, terms of a chunk (on average), and chunks that a task goes over.
BLOCK, CHUNK, SPAN = 64, 2048, 4
#: Parts of a probability: shares are whole numbers of billionths.
SCALE = 1_000_000_000
#: Languages, or groups, up to which their tables are broadcast; they are counted first.
BROADCAST_ROWS = 100_000

_TERM = np.zeros(256, dtype=bool)
_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _occurrences(data: np.ndarray, offsets: np.ndarray):
    """(document, word) of each run of letters, words numbered, and the distinct words as binary, A-Z lower-cased."""
    letter = _TERM[data]
    start = letter.copy()
    start[1:] &= ~letter[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    start[first] = letter[first]
    starts = np.flatnonzero(start)
    low = data[letter]
    low = np.where((low >= 0x41) & (low <= 0x5A), low + 32, low).astype(np.uint8)
    place = np.cumsum(letter) - 1  # of each letter among letters
    bounds = np.append(place[starts], len(low)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(low))])
    coded = words.dictionary_encode()
    return np.searchsorted(offsets, starts, side="right") - 1, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _sums(keys: np.ndarray, values: np.ndarray):
    """Distinct keys, and the sum of values and the number of rows of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[at], np.add.reduceat(values[order], at), np.diff(np.append(at, len(keys)))


def _count(batches):
    """(lang, source, term, n, docs) summed within each block of texts."""
    for groups, data, offsets in text_blocks(batches):
        doc, word, words = _occurrences(data, offsets)
        if not len(doc):
            continue
        lang, source = (groups.field(k).dictionary_encode() for k in (0, 1))
        n_source = len(source.dictionary)
        group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n_source + source.indices.to_numpy(zero_copy_only=False)
        pair, n, _ = _sums(doc * len(words) + word, np.ones(len(doc), np.int64))
        key, n, docs = _sums(group[pair // len(words)] * len(words) + pair % len(words), n)
        of, term = np.divmod(key, len(words))
        yield pa.record_batch(
            [lang.dictionary.take(pa.array(of // n_source)), source.dictionary.take(pa.array(of % n_source)), words.take(pa.array(term)).cast(pa.large_string()).cast(pa.string()), pa.array(n), pa.array(docs)],
            names=["lang", "source", "term", "n", "docs"],
        )


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and its documents with it.

    Counts are summed within blocks of text before they are shuffled, so a hot group or word is no single task's.
    """
    given = docs.select(F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang, "lang"), (source, "source")))).alias("g"), F.col(text).alias("text"))
    found = given.mapInArrow(freeing(_count), "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column | str, total: str, kept: str) -> Column:
    """1 + floor(SCALE (n + 2) / (total + 2 kept)) in exact decimals; 1 where nothing is kept."""
    n = F.col(n) if isinstance(n, str) else n
    over = F.col(total) + 2 * F.col(kept)
    return F.when(over > 0, F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n.cast("decimal(20,0)") + 2), over.cast("decimal(20,0)")) + 1).otherwise(F.lit(1)).cast("long")


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _submatrices(batches):
    """Sums of a tile over the chunks of its span; rows come sorted by (lang, i, j, span, chunk, side), the groups first.

    Holds one chunk of the two blocks' vectors and the tile's submatrix. Terms that no group of the tile has in a chunk
    add what two groups without the term add, so they are counted, not stored.
    """
    now, chunk_at, held = None, None, []

    def begin():  # once the groups are known
        if now["sum"] is None:
            now["sum"] = np.zeros((len(now["a"]), len(now["b"])), dtype=np.int64)

    def close():
        begin()
        add()
        (lang, *_), a, b = now["key"], now["a"], now["b"]
        rest = now["width"] - now["seen"]
        zero = lambda side: np.array([x[1] for x in side], dtype=np.int64)
        total = now["sum"] + rest * _distance(zero(a)[:, None], zero(b)[None, :])
        every = np.ones(total.shape, dtype=bool)
        rows, cols = np.nonzero(np.triu(every, 1) if now["key"][1] == now["key"][2] else every)  # each two groups once
        return pa.record_batch([pa.array([lang] * len(rows), pa.string()), pa.array([a[i][0] for i in rows], pa.string()), pa.array([b[i][0] for i in cols], pa.string()), pa.array(total[rows, cols], pa.int64())], names=["lang", "a", "b", "value"])

    def add():
        if not held:
            return
        terms = np.unique(np.concatenate([v >> 32 for _, _, v in held]))
        blocks = []
        for side in ("a", "b"):
            m = np.repeat(np.array([x[1] for x in now[side]], dtype=np.int64)[:, None], len(terms), axis=1)
            for s, place, v in held:
                if s == side:
                    m[place, np.searchsorted(terms, v >> 32)] = v & 0xFFFFFFFF
            blocks.append(m)
        for i, p in enumerate(blocks[0]):
            now["sum"][i] += _distance(p[None, :], blocks[1]).sum(axis=1)
        now["seen"] += len(terms)
        held.clear()

    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in ("lang", "i", "j", "span")), strict=True)
        rows = zip(keys, *(batch.column(c).to_pylist() for c in ("chunk", "side", "place", "source", "zero", "width")), range(len(batch)), strict=True)
        vectors = batch.column("vector")
        for key, chunk, side, place, source, zero, width, at in rows:
            if now is None or key != now["key"]:
                if now is not None:
                    yield close()
                now, chunk_at = {"key": key, "a": [], "b": [], "width": width, "seen": 0, "sum": None}, -1
            if chunk != chunk_at:
                begin()
                add()
                chunk_at = chunk
            if chunk < 0:
                now[side].append((source, zero))
            else:
                held.append((side, place, vectors[at].values.to_numpy(zero_copy_only=False)))
    if now is not None:
        yield close()


def pair_sums(groups: DataFrame, spans: DataFrame, vectors: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every two groups of a language, in both orders.

    groups: lang, source, g (from 0 within the language), n_groups, zero (share of a term without occurrences).
    spans: lang, span, width (its terms). vectors: lang, g, chunk, vector (term in the chunk << 32 | share).
    """
    block, blocks = F.floor(F.col("g") / BLOCK).cast("int"), F.ceil(F.col("n_groups") / BLOCK).cast("int")
    # a block meets itself and every other one once: it is on side a of tiles (block, later), on side b of (earlier, block)
    tiles = F.concat(
        F.transform(F.sequence(F.col("block"), F.col("blocks") - 1), lambda j: F.struct(F.col("block").alias("i"), j.alias("j"), F.lit("a").alias("side"))),
        F.transform(F.sequence(F.lit(0), F.col("block")), lambda i: F.struct(i.alias("i"), F.col("block").alias("j"), F.lit("b").alias("side"))),
    )
    placed = groups.withColumns({"block": block, "blocks": blocks, "place": (F.col("g") % BLOCK).cast("int")})
    listed = placed.join(spans, "lang").select("lang", "span", "place", "source", "zero", "width", F.explode(tiles).alias("t"))
    first = listed.select("lang", "t.i", "t.j", "span", F.lit(-1).alias("chunk"), "t.side", "place", "source", "zero", "width", F.lit(None).cast("array<long>").alias("vector"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("source", "string"), ("zero", "long"), ("width", "long"))]
    parts = vectors.join(placed.select("lang", "g", "block", "blocks", "place"), ["lang", "g"]).select("lang", F.floor(F.col("chunk") / SPAN).cast("int").alias("span"), "chunk", "place", "vector", F.explode(tiles).alias("t"))
    parts = parts.select("lang", "t.i", "t.j", "span", "chunk", "t.side", "place", *nothing, "vector")
    dealt = first.unionByName(parts).repartition("lang", "i", "j", "span").sortWithinPartitions("lang", "i", "j", "span", "chunk", "side", "place")
    sums = dealt.mapInArrow(freeing(_submatrices), "lang string, a string, b string, value long")
    both = sums.withColumn("two", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))))
    return both.groupBy("lang", "two.source", "two.item").agg(F.sum("value").alias("value"))


def _small(table: DataFrame) -> DataFrame:
    """The stored table, broadcast where it is small: else what is joined would be dealt out by language or group."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def audit(docs: DataFrame, least_docs: int = 10, ranks: int = 10, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """How each group (lang, source) of the documents differs from the others, and by which terms.

    Returns lang, source, part, item, value, rank. Part `pair` has every other source of the language, farthest first;
    part `term` the `ranks` terms that stand out most against the language as a whole. A language keeps the terms in at
    least `least_docs` of its documents. With p and q the shares of a term, of SCALE and smoothed by two occurrences, the
    value is the sum over kept terms of floor((p - q)^2 / (p + q)). Ties go to the smaller item in bytes.

    Null text, lang and source count as ''. A group without terms takes part with counts of zero; a language without
    kept terms has pairs of value 0 and no terms. Repeated rows count as often as they come; an empty table gives no
    rows; other columns are ignored, whatever their names.
    """
    counts = stored(term_counts(docs, lang, source, text), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    kept = stored(kept, "kept-terms")
    langs = stored(kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n_lang").alias("total_lang")), "langs")
    chunks = F.ceil(F.col("kept") / CHUNK).cast("long")
    terms = kept.join(_small(langs), "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), chunks).cast("int"))
    terms = stored(terms.withColumn("at", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1), "terms")
    of_group = stored(counts.select("lang", "source", "term", "n").join(terms, ["lang", "term"]), "of-group")

    present = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang, "lang"), (source, "source")))).distinct()
    totals = of_group.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = present.join(totals, ["lang", "source"], "left").join(langs.select("lang", "kept"), "lang", "left").fillna(0, ["total", "kept"])
    in_lang = Window.partitionBy("lang")
    groups = groups.select("lang", "source", "total", (F.row_number().over(in_lang.orderBy("source")) - 1).alias("g"), F.count("*").over(in_lang).alias("n_groups"), "kept", _share(F.lit(0), "total", "kept").alias("zero"))
    groups = stored(groups, "groups")
    small = _small(groups)
    shares = of_group.join(small.select("lang", "source", "g", "total"), ["lang", "source"]).withColumn("p", _share("n", "total", "kept"))

    vectors = shares.groupBy("lang", "g", "chunk").agg(F.collect_list(F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("p"))).alias("vector"))
    widths = terms.groupBy("lang", F.floor(F.col("chunk") / SPAN).cast("int").alias("span")).agg(F.count("*").alias("width"))
    widths = widths.unionByName(groups.filter("kept = 0").select("lang", F.lit(0).alias("span"), F.lit(0).cast("long").alias("width")).distinct())
    pairs = pair_sums(small.select("lang", "source", "g", "n_groups", "zero"), widths, vectors).withColumn("part", F.lit("pair"))

    q = _share("n_lang", "total_lang", "kept")
    above = shares.withColumn("q", q).filter("p > q").withColumn("value", F.expr("(p - q) * (p - q) div (p + q)"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    outstanding = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value").withColumn("rank", rank).filter(F.col("rank") <= ranks)
    out = stored(pairs.withColumn("rank", rank).select(columns).unionByName(outstanding.select(columns)), "divergence")
    for table in (counts, kept, langs, terms, of_group, groups):
        dropped(table)
    return out


#: The same in DuckDB.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
),
words AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
counts AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT id) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
totals AS (SELECT lang, source, sum(c.n) AS total FROM counts c JOIN kept k USING (lang, term) GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0)::HUGEINT + 2 * l.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total::HUGEINT + 2 * l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang)
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) FROM shares x JOIN shares y USING (lang, term)
                   WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
) WHERE part = 'pair' OR rank <= 10
"""
