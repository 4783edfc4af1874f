"""Evaluation of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sweep(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, tp, fp, fn, f1 of scores against truth (boolean), in one pass over the rows."""
    hit = lambda t: F.col("score") >= t
    parts = [F.struct(F.lit(float(t)).alias("threshold"), F.count_if(hit(t) & F.col("truth")).alias("tp"), F.count_if(hit(t) & ~F.col("truth")).alias("fp"), F.count_if(~hit(t) & F.col("truth")).alias("fn")).alias(f"t{k}") for k, t in enumerate(thresholds)]
    one = rows.agg(*parts).select(F.explode(F.array(*(f"t{k}" for k in range(len(thresholds))))).alias("x")).select("x.*")
    return one.withColumn("f1", F.round(F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)), 9))


def confusion(rows: DataFrame) -> DataFrame:
    """(truth, predicted, n)."""
    return rows.groupBy("truth", "predicted").agg(F.count("*").alias("n"))


def macro_f1(rows: DataFrame) -> DataFrame:
    """label, f1 by label, from truth and predicted; predictions may be null where the model abstains."""
    t = rows.groupBy(F.col("truth").alias("label")).agg(F.count("*").alias("truths"), F.count_if(F.col("truth") == F.col("predicted")).alias("hits"))
    p = rows.filter("predicted IS NOT NULL").groupBy(F.col("predicted").alias("label")).agg(F.count("*").alias("predictions"))
    return t.join(p, "label", "left").select("label", (2.0 * F.col("hits") / (F.col("truths") + F.coalesce("predictions", F.lit(0)))).alias("f1"))
