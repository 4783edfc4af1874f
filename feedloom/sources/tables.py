"""Tables of the driver, and the adapter that shows documents as posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The constant `now` of every query: results never depend on the clock.
NOW = "2026-01-01 00:00:00"

#: The same adapter as SQL, for twins in other engines.
POSTS_SQL = f"""posts AS (
  SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'bluesky' ELSE 'mastodon' END AS source, source AS author_id,
         text, lang, CAST(epoch(TIMESTAMP '{NOW}') AS BIGINT) - doc_id * 60 AS created_s
  FROM documents)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out over all cores where a scan has fewer parts than there are cores, as of one file with one row group.

    Tables of many files are read as they are: nothing is shuffled.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source, author_id, text, lang, created_s (seconds since 1970): documents as posts, newest first by id."""
    d = spread(table(spark, sf_dir, "documents"))
    return d.select(
        F.col("doc_id").alias("id"),
        F.when(F.col("doc_id") % 2 == 0, "bluesky").otherwise("mastodon").alias("source"),
        F.col("source").alias("author_id"),
        "text",
        "lang",
        (F.unix_timestamp(F.lit(NOW)) - F.col("doc_id") * 60).alias("created_s"),
    )


def newest_first(df: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    """The n newest rows; ties go to the smaller key."""
    return df.orderBy(F.desc(by), F.asc(tie)).limit(n)


def unprocessed(raw: DataFrame, processed: DataFrame, n: int, id_: str = "id", done: str = "raw_post_id") -> DataFrame:
    """Newest rows that have no processed row yet."""
    return newest_first(raw.join(processed, raw[id_] == processed[done], "left_anti"), "created_s", n, id_)


def rankable(raw: DataFrame, processed: DataFrame, since_s: int) -> DataFrame:
    """Processed rows of posts since a cutoff."""
    return processed.join(raw.filter(F.col("created_s") >= since_s), processed["raw_post_id"] == raw["id"])


def looked_up(keys: DataFrame, resolved: DataFrame, key: str) -> DataFrame:
    """Each distinct key with what is resolved for it; keys that are not found keep nulls."""
    return keys.select(key).distinct().join(resolved, key, "left")
