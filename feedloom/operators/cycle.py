"""The scoring cycle: exclude, cluster, judge and score posts, then rank the eligible ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import language as L
from ..functions import text as X
from ..sources.shared import written
from . import dedup, moderation, scoring, windows


#: Parts into which a pool of at most `cfg.pool` posts is dealt, so that its texts are read side by side.
POOL_PARTS = 16


def entity_bursts(posts: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(id, mentions): the largest running count of a post's entities, each kept alive by mentions in time."""
    said = posts.select("id", "created_s", F.explode(L.entities(F.col("text"), cfg.entity_chars)).alias("entity"))
    return windows.rolling_count(said, ["entity"], "created_s", ["id"], cfg.burst_ttl_s, "n").groupBy("id").agg(F.max("n").alias("mentions"))


def topicalities(posts: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(id, topicality): salience of the posts' terms among these posts, raised by bursts of their entities."""
    terms = scoring.term_rows(posts)
    s = scoring.salience(scoring.weighted(terms, scoring.idf(terms, posts.agg(F.count("*").alias("n")))), cfg)
    both = posts.select("id").join(s, "id", "left").join(entity_bursts(posts, cfg), "id", "left")
    return both.select("id", scoring.topicality(F.coalesce("salience", F.lit(0.0)), F.coalesce("mentions", F.lit(0)), cfg).alias("topicality"))


def bot_scores(posts: DataFrame, clusters: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(id, bot_score, is_bot) from velocity, self-duplicates in a cluster, lexical signals and templates.

    posts: id, author_id, created_s, text; clusters: id, cluster. The text is read once; windows carry its digest. What a
    window counts is written down, as the next one reads it several times.
    """
    lexical = X.lexical_score(F.col("text"), cfg.url_cap, cfg.hashtag_cap, cfg.caps_cap)
    skeleton = F.sha1(X.template_skeleton(X.normalise(F.col("text")), cfg.prefix_words, cfg.suffix_words))
    rows = posts.select("id", "author_id", F.col("created_s").alias("s"), skeleton.alias("skeleton"), lexical.alias("lexical")).join(clusters.select("id", "cluster"), "id")
    rows = written(rows, "signals")
    rows = written(windows.rolling_count(rows, ["author_id", "skeleton"], "s", ["id"], cfg.template_ttl_s, "t"), "templates")
    rows = written(windows.anchored_count(rows, ["author_id"], "s", ["id"], cfg.velocity_window_s, "v"), "velocities")
    rows = windows.seen_before(rows, ["cluster"], "author_id", "s", ["id"], cfg.self_dup_ttl_s, "again")
    score = scoring.bot_score(windows.component(F.col("v"), cfg.velocity_full), F.col("again").cast("double"), F.col("lexical"), windows.component(F.col("t"), cfg.template_full), cfg)
    return rows.select("id", score.alias("bot_score")).withColumn("is_bot", F.col("bot_score") >= cfg.bot_threshold)


def scored(posts: DataFrame, blocked: DataFrame, terms: list[str], domains: list[str], label: Column, confidence: Column, now_s: Column, clusters=None, cfg: Config = DEFAULT) -> DataFrame:
    """One row for each post that no exclusion takes: clusters, scores, category and base score.

    posts: id, source, author_id, text, lang, raw_json, created_s. `clusters` makes (id, cluster, canonical) of the
    posts that stay, by default by MinHash. The posts that stay are written once.
    """
    context = moderation.context(F.col("source"), F.col("author_id"), F.col("raw_json"), F.col("text"), cfg)["multiplier"]
    kept = moderation.excluded(posts, blocked, terms, domains, label, confidence, cfg).filter("reason IS NULL").withColumn("penalty", context)
    kept = written(kept.select("id", "source", "author_id", "text", "created_s", "penalty"), "kept")
    group = written((clusters or (lambda p: dedup.dedup_posts(p, cfg=cfg)))(kept), "clusters")
    said = X.normalise(F.col("text"))
    category = X.let(said, lambda t: scoring.keyword_category(scoring.terms_of(t), t))
    plain = kept.select("id", "author_id", "created_s", "penalty", scoring.lexicon_sentiment(F.col("text")).alias("sentiment"), category.alias("category"))
    rows = plain.join(group, "id").join(bot_scores(kept, group, cfg), "id").join(topicalities(kept, cfg), "id")
    base = scoring.base_score(F.col("sentiment"), F.col("topicality"), (now_s - F.col("created_s")) / 3600.0, F.col("penalty"), cfg)
    return rows.select("id", "created_s", "cluster", "canonical", "sentiment", F.lit("lexicon_v1").alias("sentiment_method"), "topicality", "bot_score", "is_bot", "category", F.lit("keyword_v1").alias("category_method"), "penalty", base.alias("base_score"), F.lit(cfg.pipeline_version).alias("pipeline_version"))


def eligible(rows: DataFrame, now_s: Column, cfg: Config = DEFAULT) -> DataFrame:
    """Rows that may be ranked: no bot, canonical, positive enough, within the window."""
    return rows.filter(~F.col("is_bot") & F.col("canonical") & (F.col("sentiment") >= cfg.positivity) & (F.col("created_s") >= now_s - cfg.window_h * 3600))


def ranked(rows: DataFrame, texts: DataFrame, now_s: Column, cfg: Config = DEFAULT) -> DataFrame:
    """(id, rank_score, position): the best `cfg.pool` eligible rows in order of marginal relevance.

    rows: id, is_bot, canonical, sentiment, created_s, base_score; texts: id, text. The pool is cut first; only its
    texts are read for terms and entities, and weights are those of the pool.
    """
    pool = eligible(rows, now_s, cfg).select("id", F.col("base_score").alias("base")).orderBy(F.desc("base"), "id").limit(cfg.pool)
    pool = written(pool, "pool")
    own = written(texts.select("id", "text").join(F.broadcast(pool.select("id")), "id", "left_semi").repartition(POOL_PARTS, "id"), "texts")
    terms = scoring.term_rows(own)
    weights = scoring.weighted(terms, scoring.idf(terms, pool.agg(F.count("*").alias("n"))), sublinear=False)
    return scoring.mmr_terms(pool, weights, own.select("id", F.explode(L.entities(F.col("text"), cfg.entity_chars)).alias("entity")), cfg)


def counts(posts: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: posts read, processed and filtered by a cycle."""
    both = posts.select(F.lit(1).alias("r"), F.lit(0).alias("p")).unionByName(kept.select(F.lit(0).alias("r"), F.lit(1).alias("p")))
    return both.agg(F.sum("r").alias("read"), F.sum("p").alias("processed")).select("read", "processed", (F.col("read") - F.col("processed")).alias("filtered"))
