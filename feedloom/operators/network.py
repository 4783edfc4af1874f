"""Coordinated networks: many accounts of one home domain, made within days, that post much."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT


def accounts(raw: DataFrame) -> DataFrame:
    """home_domain, identity, post, author_id, s of statuses whose account's creation is known.

    One account seen through several instances is one identity; a post is its identity, text and time.
    """
    known = raw.filter((F.col("source") == "mastodon") & F.col("author_id").contains("@") & F.col("mastodon_account_created_at").isNotNull())
    identity = F.split_part("author_id", F.lit("/"), F.lit(2))
    return known.select(F.split_part("author_id", F.lit("@"), F.lit(2)).alias("home_domain"), identity.alias("identity"), F.struct(identity, "text", "created_at").alias("post"), "author_id", F.unix_seconds("mastodon_account_created_at").alias("s"))


def clusters(rows: DataFrame, least_accounts: int = DEFAULT.least_accounts, most_days: int = DEFAULT.most_days, least_posts: int = DEFAULT.least_posts) -> DataFrame:
    """Domains with many accounts of like age and many posts; authors are gathered for those alone."""
    g = rows.groupBy("home_domain").agg(F.count_distinct("identity").alias("account_count"), F.count_distinct("post").alias("post_count"), F.min("s").alias("earliest"), F.max("s").alias("latest"))
    g = g.filter((F.col("account_count") >= least_accounts) & (F.col("latest") - F.col("earliest") <= most_days * 86400) & (F.col("post_count") >= least_posts))
    authors = rows.join(g.select("home_domain"), "home_domain", "left_semi").select("home_domain", "author_id").distinct().groupBy("home_domain").agg(F.sort_array(F.collect_list("author_id")).alias("author_ids"))
    return g.join(authors, "home_domain").select("home_domain", "author_ids", "account_count", "post_count", "earliest", "latest")


def recorded(candidates: DataFrame, found: DataFrame, version: str = "latest") -> tuple[DataFrame, int]:
    """The table of candidates with what a run found, newest first by `version`, and how many it found, even if none."""
    from .sinks import upsert

    return upsert(candidates, found, ["home_domain"], version), found.count()
