"""Similarity joins over all posts above a threshold: cosine of weighted terms, Jaccard of entities, and their mix.

Posts with equal vectors, or sets, are a class; classes meet, and each other member is paired with the first of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import language as L
from ..sources.shared import written
from .blocks import SLACK, similar_lists
from .dedup import exact_pairs
from .scoring import term_words


def term_lists(weights: DataFrame) -> DataFrame:
    """(id, t, n) of weights (id, term, weight): hashed terms and their weights, in one row."""
    rows = weights.groupBy("id").agg(F.collect_list(F.struct(F.xxhash64("term").alias("t"), F.col("weight").alias("w"))).alias("v"))
    return rows.select("id", F.transform("v", lambda x: x["t"]).alias("t"), F.transform("v", lambda x: x["w"]).alias("n"))


def entity_sets(entities: DataFrame) -> DataFrame:
    """(id, n, items, own) of entities (id, entity), hashed and sorted; `own` is their list as text."""
    return entities.groupBy("id").agg(F.array_sort(F.collect_set(F.xxhash64("entity"))).alias("items")).select("id", F.size("items").alias("n"), "items", F.array_join("items", ",").alias("own"))


def text_lists(posts: DataFrame, entities: bool) -> DataFrame:
    """(id, t, n, items) of posts (id, text) for `similar_lists` to count: all hashed terms, and entities if they are asked for.

    Nothing is shuffled: what a text has is in its row.
    """
    hashed = lambda c: F.transform(c, lambda x: F.xxhash64(x))
    none = F.array().cast("array<long>")
    items = hashed(L.entities(F.col("text"))) if entities else none
    return posts.select(F.col("id").cast("long").alias("id"), hashed(term_words(F.col("text"))).alias("t"), F.array().cast("array<double>").alias("n"), items.alias("items"))


def classes(rows: DataFrame, *columns: str) -> DataFrame:
    """(id, first): the first id of those with equal values in these columns."""
    keyed = rows.select("id", F.md5(F.concat_ws("|", *(F.coalesce(F.col(c), F.lit("-")) for c in columns))).alias("cls"))
    return keyed.join(keyed.groupBy("cls").agg(F.min("id").alias("first")), "cls").select("id", "first")


def _with_members(members: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    own = members.filter("id > first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias(name))
    return pairs.unionByName(own)


def _firsts(rows: DataFrame, members: DataFrame, name: str) -> DataFrame:
    return written(rows.join(members.filter("id = first").select("id"), "id", "left_semi"), name)


def _texts(lists: DataFrame, least: float, posts: int | None = None) -> DataFrame:
    pairs, members = similar_lists(lists, 1.0, least, posts)
    return _with_members(members, pairs.withColumnRenamed("value", "cosine"), "cosine")


def _posts(lists: DataFrame, mix: float, least: float, posts: int | None = None) -> DataFrame:
    pairs, members = similar_lists(lists, mix, least, posts)
    # copies without an entity have only the text's share
    alike = F.when(F.col("terms") > 0, mix).otherwise(0.0) + F.when(F.col("items") > 0, 1 - mix).otherwise(0.0)
    own = members.filter("id > first").select(F.col("first").alias("a"), F.col("id").alias("b"), alike.alias("similarity"))
    return pairs.withColumnRenamed("value", "similarity").unionByName(own.filter(F.col("similarity") >= least - SLACK))


def similar_texts(weights: DataFrame, least: float) -> DataFrame:
    """(a, b, cosine), a < b: pairs of first posts of equal vectors from `least` on, and each other post with its first."""
    return _texts(term_lists(weights).withColumn("items", F.array().cast("array<long>")), least)


def similar_by_terms(posts: DataFrame, least: float) -> DataFrame:
    """`similar_texts` of the TF-IDF of posts (id, text)."""
    return _texts(text_lists(posts, False), least, posts.count())


def similar_entities(entities: DataFrame, least: float) -> DataFrame:
    """(a, b, jaccard), a < b: as `similar_texts`, of sets of entities."""
    sets = written(entity_sets(entities), "sets")
    members = written(classes(sets, "own"), "members")
    return _with_members(members, exact_pairs(_firsts(sets, members, "firsts"), least), "jaccard")


def similar_posts(weights: DataFrame, entities: DataFrame, mix: float, least: float) -> DataFrame:
    """(a, b, similarity), a < b: mix cosine + (1 - mix) jaccard of `least` or more, as `similar_texts`."""
    return _posts(term_lists(weights).join(entity_sets(entities).select("id", "items"), "id", "full"), mix, least)


def similar_by_terms_and_entities(posts: DataFrame, mix: float, least: float) -> DataFrame:
    """`similar_posts` of the TF-IDF of posts (id, text) and of their entities."""
    return _posts(text_lists(posts, True), mix, least, posts.count())
