"""Mixing sources to target weights by Poisson replication. DataFrame functions only.

A source of share p with target weight w is repeated w / p times on average. Each document draws a uniform number from
a seeded hash of its id and inverts the Poisson distribution with that mean; it comes as often as the draw says. All
copies are then dealt out by a second hash, which shuffles them over the whole output.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sources up to which their rates are broadcast; beyond, they are joined by source with AQE's skew handling.
BROADCAST_SOURCES = 100_000
#: Expected rows of a partition of the result, where the session's number of partitions would give more.
PARTITION_ROWS = 250_000
#: Largest mean that one inversion handles: beyond, exp(-mean) would lose its precision. Larger means are summed up.
LARGEST_MEAN = 64.0


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 12 hex digits of the parts' md5, exact in doubles; equal in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12), 16, 10).cast("double") / float(1 << 48)


def poisson(u: Column, mean: Column) -> Column:
    """Smallest k with u < P(X <= k) for a Poisson X: walks the terms mean^k exp(-mean) / k! up from 0."""
    most = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    start = F.struct(F.lit(0).alias("k"), F.exp(-mean).alias("term"), F.exp(-mean).alias("below"))

    def step(acc, i):
        more = u >= acc["below"]
        term = acc["term"] * mean / i
        return F.when(more, F.struct(i.alias("k"), term.alias("term"), (acc["below"] + term).alias("below"))).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda acc: acc["k"])


def rates(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, total: float | None = None, source: str = "source") -> DataFrame:
    """(source, mean): the mean number of copies of each source's documents.

    With `weights`, a source's share of the result is its weight over all weights; sources without one get none. Without,
    weights are the sources' counts to `power`, so that small sources gain (0.5: their square roots). `total` is the
    expected number of rows; by default as many as there are. Null sources form one source of their own.
    """
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    if weights is not None:
        if not all(math.isfinite(w) and w >= 0 for w in weights.values()):
            raise ValueError("weights are finite and not negative")
        listed = docs.sparkSession.createDataFrame([(k, float(w)) for k, w in weights.items()], "source string, weight double")
        counts = counts.join(listed, counts["source"].eqNullSafe(listed["source"]), "left").select(counts["source"], "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    else:
        counts = counts.withColumn("weight", F.sqrt("n") if power == 0.5 else F.pow("n", F.lit(power)))
    sums = counts.agg(F.sum("weight").alias("weight"), F.sum("n").alias("n"), F.count("*").alias("sources")).first()
    if not sums["weight"]:
        return counts.select("source", F.lit(0.0).alias("mean"))
    if sums["sources"] <= BROADCAST_SOURCES:
        counts = F.broadcast(counts)
    target = float(sums["n"] if total is None else total)
    return counts.select("source", (F.col("weight") / F.lit(float(sums["weight"])) * F.lit(target) / F.col("n")).alias("mean"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, total: float | None = None, seed: int = 42, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """All columns of the documents, each row as often as drawn, and `copy` (from 1) and `shuffle_key` (0 to 1).

    Rows are dealt out over partitions by ranges of shuffle_key and sorted by it, so partitions in order are one global
    shuffle. The draw depends on seed and doc_id alone: a rerun of a lost task draws the same. Rows that share a doc_id
    draw alike; a null doc_id draws as the text `null` does. Sources with a mean of 0 vanish, null sources are one source.
    An empty table gives none. Columns named `copy` or `shuffle_key` are replaced, all others stay. A hot source is only counted, by
    partial sums, never gathered; the rates of up to BROADCAST_SOURCES sources, which are counted first, are broadcast.
    """
    given = docs.drop("copy", "shuffle_key")
    of_source, mean, copies = (next(n for n in (f"{name}{i}" for i in range(len(given.columns) + 1)) if n not in given.columns) for name in ("source_", "mean_", "copies_"))
    means = rates(given, weights, power, total, source).withColumnsRenamed({"source": of_source, "mean": mean})
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    parts = F.ceil(F.col(mean) / LARGEST_MEAN).cast("int")  # a sum of Poisson numbers is one of the summed mean
    draws = F.transform(F.sequence(F.lit(1), F.greatest(parts, F.lit(1))), lambda j: poisson(uniform(F.lit(str(seed)), key, j.cast("string")), F.col(mean) / F.greatest(parts, F.lit(1))))
    drawn = given.join(means, given[source].eqNullSafe(means[of_source])).withColumn(copies, F.aggregate(draws, F.lit(0), lambda a, x: a + x))
    out = drawn.filter(F.col(copies) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(copies))))
    out = out.withColumn("shuffle_key", uniform(F.lit(f"{seed}-place"), key, F.col("copy").cast("string"))).select(*given.columns, "copy", "shuffle_key")
    expected = given.count() if total is None else math.ceil(total)
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-expected // PARTITION_ROWS))
    return out.repartitionById(n, F.floor(F.col("shuffle_key") * n).cast("int")).sortWithinPartitions("shuffle_key", doc_id, "copy")


#: The same draw in DuckDB: u < P(X <= k), the terms summed in the same order.
ORACLE = """
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
sums AS (SELECT sum(sqrt(n)) AS all_weight, sum(n) AS all_n FROM counts),
rates AS (SELECT source, sqrt(n) / all_weight * CAST(all_n AS DOUBLE) / n AS mean FROM counts, sums),
terms AS (
  SELECT source, mean, 0 AS k, exp(-mean) AS term, exp(-mean) AS below FROM rates
  UNION ALL
  SELECT source, mean, k + 1, term * mean / (k + 1), below + term * mean / (k + 1) FROM terms WHERE k + 1 <= ceil(mean + 12 * sqrt(mean) + 24)
),
drawn AS (
  SELECT doc_id, text, lang, source, n_chars,
         CAST(('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR) || ':1'), 1, 12)) AS BIGINT) / 281474976710656.0 AS u
  FROM documents
),
copies AS (
  SELECT d.*, (SELECT count(*) FROM terms t WHERE t.source IS NOT DISTINCT FROM d.source AND t.below <= d.u) AS copies FROM drawn d
)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy,
       CAST(('0x' || substr(md5('42-place:' || CAST(doc_id AS VARCHAR) || ':' || CAST(copy AS VARCHAR)), 1, 12)) AS BIGINT) / 281474976710656.0 AS shuffle_key
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM copies)
"""
