"""Mutations of tables as DataFrame rewrites: idempotent inserts, upserts, updates and deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def insert_ignore(target: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The target and those new rows whose key it lacks; of new rows with one key the first in order."""
    first = Window.partitionBy(*key).orderBy(*order)
    fresh = new.join(target.select(*key).distinct(), key, "left_anti").withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
    return target.unionByName(fresh.select(*target.columns))


def upsert(target: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """One row per key, the newest by version; at equal versions the new row replaces the old one as a whole."""
    both = target.withColumn("__new", F.lit(0)).unionByName(new.select(*target.columns).withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.desc(version), F.desc("__new"))
    return both.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__new")


def update(target: DataFrame, values: DataFrame, key: str, columns: list[str], reset_stale: bool = False) -> DataFrame:
    """The target with columns taken from values where the key is there; others stay, or become null if reset."""
    v = values.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in columns))
    joined = target.join(v, target[key] == v["__key"], "left")
    pick = lambda c: F.when(F.col("__key").isNotNull(), F.col(f"__{c}")).otherwise(F.lit(None) if reset_stale else F.col(c))
    return joined.select(*(pick(c).alias(c) if c in columns else F.col(c) for c in target.columns))


def marked(target: DataFrame, keys: DataFrame, key: str, column: str, value) -> DataFrame:
    """The target with a column set on the rows whose key is listed."""
    k = keys.select(F.col(key).alias("__key")).distinct()
    return target.join(k, target[key] == k["__key"], "left").withColumn(column, F.when(F.col("__key").isNotNull(), value).otherwise(F.col(column))).drop("__key")


def partial_upsert(target: DataFrame, new: DataFrame, key: str, replace: list[str]) -> DataFrame:
    """New rows replace some columns of old ones and are added where the key is new; other columns stay."""
    n = new.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in new.columns if c != key))
    joined = target.join(n, target[key] == n["__key"], "full")

    def pick(c):
        if c == key:
            return F.coalesce(F.col(key), F.col("__key")).alias(c)
        if c in replace:
            return F.when(F.col("__key").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c)
        return (F.when(F.col(key).isNull(), F.col(f"__{c}")).otherwise(F.col(c)) if c in new.columns else F.col(c)).alias(c)

    return joined.select(*(pick(c) for c in target.columns))


def retained(rows: DataFrame, time: str, cutoff) -> DataFrame:
    return rows.filter(F.col(time) >= cutoff)


def deleted(rows: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not listed."""
    return rows.join(keys.select(*key).distinct(), key, "left_anti")


def cascaded(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent is still there."""
    p = parents.select(F.col(parent_key).alias("__parent")).distinct()
    return children.join(p, children[child_key] == p["__parent"], "left_semi")
