"""Ingest filters, exclusions and eligibility."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import moderation as M
from ..sources import tables as S
from ..sources.tables import POSTS_SQL, table
from .functions import NETLOC
from .registry import query
from .tables import BLOCKED, DOMAINS, NOW_S, TERMS, P, blocked


@query("ingest_event_filter", "SELECT event_id FROM events WHERE event_type = 'click' AND value > 1 AND props IS NOT NULL")
def ingest_event_filter(spark, d):
    return table(spark, d, "events").filter("event_type = 'click' AND value > 1 AND props IS NOT NULL").select("event_id")


@query("ingest_lang", "SELECT doc_id FROM documents WHERE lang IS NULL OR lang = 'en'")
def ingest_lang(spark, d):
    return table(spark, d, "documents").filter("lang IS NULL OR lang = 'en'").select("doc_id")


@query("ingest_sample", "SELECT event_id FROM events WHERE CAST(('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8)) AS BIGINT) % 100 < 10")
def ingest_sample(spark, d):
    return table(spark, d, "events").filter(F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 8), 16, 10).cast("bigint") % 100 < 10).select("event_id")


@query("ingest_nonempty", "SELECT doc_id FROM documents WHERE length(trim(regexp_replace(CASE WHEN doc_id % 9 = 0 THEN E' \\n\\t' ELSE text END, '[ \\t\\n\\x0b\\x0c\\r]+', ' ', 'g'))) > 0")
def ingest_nonempty(spark, d):
    t = F.when(F.col("doc_id") % 9 == 0, " \n\t").otherwise(F.col("text"))
    return table(spark, d, "documents").filter(F.size(X.words(t)) > 0).select("doc_id")


@query("ingest_discoverable", "SELECT doc_id FROM documents WHERE doc_id % 4 <> 1")
def ingest_discoverable(spark, d):
    from ..sources.streams import accepted_statuses

    flag = F.when(F.col("doc_id") % 4 == 1, False).when(F.col("doc_id") % 4 == 2, True)
    s = table(spark, d, "documents").select("doc_id", F.struct(flag.alias("discoverable"), F.lit(None).cast("boolean").alias("indexable")).alias("account"), F.lit("public").alias("visibility"), F.lit("en").alias("language"))
    return accepted_statuses(s).select("doc_id")


@query("filter_blocked", f"{P}, {BLOCKED} SELECT p.id, b.author_id IS NOT NULL AS blocked FROM posts p LEFT JOIN blocked b ON b.source = p.source AND b.author_id = p.author_id")
def filter_blocked(spark, d):
    b = blocked(spark).withColumn("blocked", F.lit(True))
    return S.posts(spark, d).join(b, ["source", "author_id"], "left").select("id", F.coalesce("blocked", F.lit(False)).alias("blocked"))


@query("filter_hashtag", r"SELECT doc_id FROM documents WHERE len(list_intersect(list_transform(regexp_extract_all(replace(text, '%%%', ' #Promo'), '#([\p{L}\p{N}_]+)', 1), lambda t: lower(t)), ['promo', 'nsfw'])) > 0")
def filter_hashtag(spark, d):
    return table(spark, d, "documents").filter(M.has_hashtag(F.replace("text", F.lit("%%%"), F.lit(" #Promo")), ["promo", "nsfw"])).select("doc_id")


ANY_TERM = "regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])(" + "|".join(TERMS) + ")($|[^\\p{L}\\p{N}_])')"


@query("filter_spoiler", f"SELECT doc_id FROM documents WHERE {ANY_TERM}")
def filter_spoiler(spark, d):
    return table(spark, d, "documents").filter(M.has_word(F.col("text"), TERMS)).select("doc_id")


ON_DOMAIN = "(" + " OR ".join(f"{NETLOC} = '{x}' OR {NETLOC} LIKE '%.{x}'" for x in DOMAINS) + ")"


@query("filter_domain", f"SELECT page_id, {ON_DOMAIN} AS hit FROM pages")
def filter_domain(spark, d):
    return table(spark, d, "pages").select("page_id", M.on_domain(F.col("url"), DOMAINS).alias("hit"))


RAW = "CASE WHEN doc_id % 10 = 0 THEN 'porn' WHEN doc_id % 10 = 1 THEN 'spoiler' END"


def raw_json():
    i = F.col("id") % 10
    return F.when(i == 0, '{"commit":{"record":{"labels":{"values":[{"val":"porn"}]}}}}').when(i == 1, '{"spoiler_text":"so idiot!"}').when(i == 3, '{"in_reply_to_id":"7"}').when(i == 4, '{"commit":{"record":{"reply":{"parent":{"uri":"at://src1/app.bsky.feed.post/1"}}}}}').otherwise("{}")


CONTENT = "CASE WHEN position('%%%' IN text) > 0 THEN 'hashtag' WHEN id % 10 = 0 THEN 'self_label' WHEN id % 10 = 1 THEN 'spoiler' END"


def tagged(spark, d):
    p = S.posts(spark, d).withColumn("raw_json", raw_json())
    return p.withColumn("text", F.replace("text", F.lit("%%%"), F.lit(" #promo ")))


@query("filter_content", f"{P} SELECT id, {CONTENT} AS reason FROM posts")
def filter_content(spark, d):
    return tagged(spark, d).select("id", M.content_reason(F.col("source"), F.col("text"), F.col("raw_json"), ["promo", "idiot"], DOMAINS).alias("reason"))


LABEL = "CASE WHEN lang = 'en' OR id % 3 = 0 THEN 'en' ELSE lang END"
LANGUAGE = f"((lang IS NULL OR source = 'mastodon') AND {LABEL} NOT IN ('', 'en'))"


def label():
    return F.when((F.col("lang") == "en") | (F.col("id") % 3 == 0), "en").otherwise(F.col("lang"))


@query("filter_language", f"{P} SELECT id, {LANGUAGE} AS dropped FROM posts")
def filter_language(spark, d):
    return S.posts(spark, d).select("id", M.language_excluded(F.col("source"), F.col("lang"), label(), F.lit(0.9)).alias("dropped"))


CONTEXT = "CASE WHEN source = 'mastodon' AND id % 10 = 3 THEN 'exclude' WHEN source = 'bluesky' AND id % 10 = 4 AND author_id <> 'src1' THEN 'devalue' ELSE 'none' END"


@query("context_classify", f"{P} SELECT id, {CONTEXT} AS action, CAST(CASE WHEN {CONTEXT} = 'devalue' THEN 0.4 ELSE 1.0 END AS DOUBLE) AS multiplier FROM posts")
def context_classify(spark, d):
    c = M.context(F.col("source"), F.col("author_id"), F.col("raw_json"), F.col("text"))
    return tagged(spark, d).select("id", c.alias("c")).select("id", "c.action", "c.multiplier")


@query("exclude_cascade", f"""{P}, {BLOCKED}, marked AS (SELECT p.*, b.author_id IS NOT NULL AS bl FROM posts p LEFT JOIN blocked b ON b.source = p.source AND b.author_id = p.author_id)
SELECT id, CASE WHEN bl THEN 'blocked' WHEN {CONTENT} IS NOT NULL THEN 'content' WHEN {LANGUAGE} THEN 'language' WHEN {CONTEXT} = 'exclude' THEN 'context' END AS reason FROM marked""")
def exclude_cascade(spark, d):
    return M.excluded(tagged(spark, d), blocked(spark), ["promo", "idiot"], DOMAINS, label(), F.lit(0.9)).select("id", "reason")


@query("rank_eligible", "SELECT event_id FROM events WHERE NOT (event_type = 'error') AND event_id % 2 = 0 AND value / 100 >= 0.3")
def rank_eligible(spark, d):
    return table(spark, d, "events").filter((F.col("event_type") != "error") & (F.col("event_id") % 2 == 0) & (F.col("value") / 100 >= 0.3)).select("event_id")


@query("rank_window", f"WITH {POSTS_SQL} SELECT id FROM posts WHERE created_s >= {NOW_S} - 7 * 3600")
def rank_window(spark, d):
    return S.posts(spark, d).filter(F.col("created_s") >= F.unix_timestamp(F.lit(S.NOW)) - 7 * 3600).select("id")


@query("label_predicates", "SELECT doc_id, toxic = 1 AND NOT (doc_id % 5 = 0) AS adult, quality = 0 AND NOT (doc_id % 5 = 0) AS bot FROM labels")
def label_predicates(spark, d):
    held = ~(F.col("doc_id") % 5 == 0)
    return table(spark, d, "labels").select("doc_id", ((F.col("toxic") == 1) & held).alias("adult"), ((F.col("quality") == 0) & held).alias("bot"))


@query("category_abstain", "SELECT event_id, CASE WHEN value / 50 >= 0.65 THEN event_type END AS category FROM events")
def category_abstain(spark, d):
    return table(spark, d, "events").select("event_id", F.when(F.col("value") / 50 >= 0.65, F.col("event_type")).alias("category"))


@query("moderation_recheck", "SELECT CAST(d.doc_id AS VARCHAR) AS source_id, CASE WHEN l.toxic = 1 THEN 'excluded' WHEN d.doc_id % 13 = 0 AND l.doc_id IS NULL THEN NULL ELSE 'clean' END AS state FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def moderation_recheck(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source_id"), "doc_id")
    labels = table(spark, d, "labels")
    views = labels.select(F.col("doc_id").cast("string").alias("source_id"), F.when(F.col("toxic") == 1, F.array(F.lit("porn"))).otherwise(F.array(F.lit("fine"))).alias("labels"))
    failed = docs.filter("doc_id % 13 = 0").join(labels.select("doc_id"), "doc_id", "left_anti")
    return M.recheck(docs, views, failed)
