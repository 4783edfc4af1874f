"""Pages of the feed by keyset, and opaque cursors."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.urls import permalink
from . import posts_json as J


def checked(limit: int | None, category: str | None, cfg: Config = DEFAULT) -> tuple[int, str | None]:
    """A page's limit and category within what is allowed."""
    n = cfg.feed_limit if limit is None else limit
    if not 1 <= n <= cfg.feed_limit_most:
        raise ValueError(f"limit is 1 to {cfg.feed_limit_most}")
    if category is not None and category not in cfg.categories:
        raise ValueError(f"no such category: {category}")
    return n, category


def page(feed: DataFrame, limit: int, cursor: tuple | None = None, **equal) -> DataFrame:
    """Rows behind a cursor (rank_score, id), best first; rows without a rank are not shown."""
    rows = feed.filter(F.col("rank_score").isNotNull())
    for k, v in equal.items():
        rows = rows.filter(F.col(k) == v)
    if cursor:
        s, i = cursor
        rows = rows.filter((F.col("rank_score") < s) | ((F.col("rank_score") == s) & (F.col("id") < i)))
    return rows.orderBy(F.desc("rank_score"), F.desc("id")).limit(limit)


def page_with_next(feed: DataFrame, limit: int, cursor: tuple | None = None, **equal) -> DataFrame:
    """A page with `has_next`: one row more is looked at."""
    from pyspark.sql.window import Window

    rows = page(feed, limit + 1, cursor, **equal)
    w = Window.orderBy(F.desc("rank_score"), F.desc("id"))  # over limit + 1 rows
    n = rows.withColumn("__n", F.row_number().over(w)).withColumn("has_next", F.count("*").over(Window.partitionBy()) > limit)
    return n.filter(F.col("__n") <= limit).drop("__n")


def encode_cursor(rank_score: float, id_) -> str:
    return base64.urlsafe_b64encode(json.dumps({"rank_score": rank_score, "id": id_}).encode()).decode().rstrip("=")


def decode_cursor(raw: str) -> tuple:
    try:
        x = json.loads(base64.urlsafe_b64decode(raw + "=" * (-len(raw) % 4)))
        score, id_ = x["rank_score"], x["id"]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("not a cursor") from e
    if isinstance(score, bool) or not isinstance(score, (int, float)) or not isinstance(id_, (str, int)):
        raise ValueError("not a cursor")
    return score, id_


def cursor_of(rank_score: Column, id_: Column) -> Column:
    """`encode_cursor` as a column."""
    raw = F.base64(F.to_json(F.struct(rank_score.alias("rank_score"), id_.alias("id"))).cast("binary"))
    return F.rtrim(F.translate(raw, "+/\n\r", "-_"), F.lit("="))


#: Fields of a post that a response names otherwise than its row does.
SCORES = {"sentiment": "sentiment", "topicality": "topicality", "base": "base_score", "rank": "rank_score"}


def response(feed: DataFrame, limit: int | None = None, cursor: str | None = None, category: str | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """One row, `body`: a page as JSON, with `posts` best first and `next_cursor`, null on the last page.

    feed: id, source, source_id, author_id, text, created_at, raw_json, thumbnail, entities, display_name, avatar_url,
    sentiment, topicality, base_score, rank_score, pipeline_version, category. Nulls are written; an empty page has no
    posts. Values that are not allowed, and cursors that are none, raise ValueError.
    """
    n, category = checked(limit, category, cfg)
    rows = page_with_next(feed, n, decode_cursor(cursor) if cursor else None, **({"category": category} if category else {}))
    source, raw = F.col("source"), F.col("raw_json")
    post = F.struct(
        "id", "source", "author_id", "text", "created_at", F.coalesce("entities", F.array().cast("array<string>")).alias("entities"),
        permalink(source, F.col("source_id"), J.path(raw, "$.url")).alias("permalink"), F.struct("display_name", "avatar_url").alias("author"),
        F.struct(*(F.col(c).alias(k) for k, c in SCORES.items())).alias("scores"), "pipeline_version",
        J.attachments(source, F.col("author_id"), raw, F.col("thumbnail")).alias("attachments"), J.sensitive(raw).alias("sensitive"), "category",
    )
    ranked = F.struct((-F.col("rank_score")).alias("first"), (-F.col("id")).alias("then"), post.alias("post"), "has_next", cursor_of(F.col("rank_score"), F.col("id")).alias("cursor"))
    one = rows.agg(F.array_sort(F.collect_list(ranked)).alias("page"))  # a page at most
    last = F.element_at("page", -1)
    after = F.when(F.size("page") > 0, F.when(last["has_next"], last["cursor"]))
    return one.select(F.to_json(F.struct(F.transform("page", lambda x: x["post"]).alias("posts"), after.alias("next_cursor")), {"ignoreNullFields": "false"}).alias("body"))
