"""Exclusions: blocked authors, content, language, context; and moderation rechecks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import text as X
from ..functions import urls
from . import posts_json as J

BLUESKY_LINK = r"(?i)(^|[^\p{L}\p{N}_])re:[ \t\n\x0b\x0c\r]*https://bsky\.app/profile/[^ \t\n\x0b\x0c\r]+/post/[^ \t\n\x0b\x0c\r]+"


def hashtags(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(rf"#({X.W}+)"), F.lit(1)), F.lower)


def has_hashtag(text: Column, terms: list[str]) -> Column:
    return F.arrays_overlap(hashtags(text), F.array(*map(F.lit, terms))) if terms else F.lit(False)


def has_word(text: Column, terms: list[str]) -> Column:
    """Whether a term stands in a text as a whole word, in any case; nothing stands in a null or empty one."""
    if not terms:
        return F.lit(False)
    import re

    pattern = rf"(?iu)(^|[^\p{{L}}\p{{N}}_])({'|'.join(map(re.escape, terms))})($|[^\p{{L}}\p{{N}}_])"
    return F.coalesce(text.rlike(pattern), F.lit(False))


def on_domain(url: Column, domains: list[str]) -> Column:
    """Whether a URL's authority is a listed domain or below one."""
    if not domains:
        return F.lit(False)
    host = urls.netloc(url)
    hit = F.lit(False)
    for d in domains:
        hit = hit | urls.under_domain(host, F.lit(d))
    return F.coalesce(hit, F.lit(False))


def content_reason(source: Column, text: Column, raw: Column, terms: list[str], domains: list[str], cfg: Config = DEFAULT) -> Column:
    """hashtag, self_label, spoiler or domain, whichever comes first in this order; else null."""
    return (
        F.when(has_hashtag(text, terms), "hashtag")
        .when(J.has_adult_label(J.self_labels(raw), cfg.adult_labels), "self_label")
        .when(has_word(J.path(raw, "$.spoiler_text"), terms), "spoiler")
        .when(on_domain(J.raw_url(source, raw, text), domains), "domain")
    )


def language_excluded(source: Column, lang: Column, label: Column, confidence: Column, least: float = DEFAULT.language_confidence) -> Column:
    """Only posts of no stated language, or of the platform whose tags are unreliable, are judged by the detector."""
    judged = lang.isNull() | (source == "mastodon")
    return F.coalesce(judged & ~label.isin("", "en") & (confidence >= least), F.lit(False))


def context(source: Column, author: Column, raw: Column, text: Column, cfg: Config = DEFAULT) -> Column:
    """struct(action, multiplier): none, devalue or exclude. Policies by platform; unknown platforms have none."""
    parent = urls.reply_author(J.path(raw, "$.commit.record.reply.parent.uri"))
    leans = F.coalesce(J.path(raw, "$.in_reply_to_id").isNotNull() | J.path(raw, "$.content").contains("quote-inline"), F.lit(False)) | text.rlike(BLUESKY_LINK)
    policies = {"bluesky": F.when(parent.isNotNull() & (parent != author), "devalue"), "mastodon": F.when(F.coalesce(leans, F.lit(False)), "exclude")}
    action = F.lit(None).cast("string")
    for platform, rule in policies.items():
        action = F.when(source == platform, rule).otherwise(action)
    action = F.coalesce(action, F.lit("none"))
    return F.struct(action.alias("action"), F.when(action == "devalue", F.lit(cfg.devalue)).otherwise(F.lit(1.0)).alias("multiplier"))


def excluded(posts: DataFrame, blocked: DataFrame, terms: list[str], domains: list[str], label: Column, confidence: Column, cfg: Config = DEFAULT) -> DataFrame:
    """Posts with `reason` (blocked, content, language, context, or null) by the first exclusion that holds.

    Blocked authors are a dimension of unknown size: Spark broadcasts it where its size allows.
    """
    known = blocked.select(F.col("source").alias("b_source"), F.col("author_id").alias("b_author")).distinct().withColumn("is_blocked", F.lit(True))
    p = posts.join(known, (posts["source"] == known["b_source"]) & (posts["author_id"] == known["b_author"]), "left")
    s, t, raw = F.col("source"), F.col("text"), F.col("raw_json")
    reason = (
        F.when(F.col("is_blocked"), "blocked")
        .when(content_reason(s, t, raw, terms, domains, cfg).isNotNull(), "content")
        .when(language_excluded(s, F.col("lang"), label, confidence, cfg.language_confidence), "language")
        .when(context(s, F.col("author_id"), raw, t, cfg)["action"] == "exclude", "context")
    )
    return p.withColumn("reason", reason).drop("b_source", "b_author", "is_blocked")


def recheck(posts: DataFrame, views: DataFrame, failed: DataFrame, adult: tuple[str, ...] = DEFAULT.adult_labels) -> DataFrame:
    """source_id with `state`: excluded, clean (also when absent from a successful answer), or null where the lookup failed.

    views: (source_id, labels array of strings); failed: (source_id) of batches without an answer.
    """
    seen = views.select("source_id", J.has_adult_label(F.col("labels"), adult).alias("bad")).groupBy("source_id").agg(F.max("bad").alias("bad"))
    lost = failed.select("source_id").distinct().withColumn("lost", F.lit(True))
    state = F.when(F.coalesce(F.col("bad"), F.lit(False)), "excluded").when(F.coalesce(F.col("lost"), F.lit(False)), F.lit(None)).otherwise("clean")
    return posts.select("source_id").distinct().join(seen, "source_id", "left").join(lost, "source_id", "left").select("source_id", state.alias("state"))
