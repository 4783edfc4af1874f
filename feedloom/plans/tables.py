"""Scans, joins, sinks and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import urls as U
from ..operators import terms as T
from ..operators import windows as V
from ..sources import tables as S
from ..sources.shared import new_folder
from ..sources.store import Store
from ..sources.tables import POSTS_SQL, table
from .functions import CANON, NETLOC
from .registry import query

P = f"WITH {POSTS_SQL}"
NOW_S = "CAST(epoch(TIMESTAMP '2026-01-01 00:00:00') AS BIGINT)"
#: Documents with a quality label stand for processed posts.
DONE = "done AS (SELECT DISTINCT doc_id AS raw_post_id, quality FROM labels)"


def kept(rows, key, unique=True):
    """A stored table with these rows, in the shared folder as long as the session."""
    return Store.of(rows, new_folder(rows.sparkSession, "table"), key, unique=unique)


def done(spark, d):
    return table(spark, d, "labels").select(F.col("doc_id").alias("raw_post_id"), "quality").distinct()


@query("scan_unprocessed", f"{P}, {DONE} SELECT id, created_s FROM posts WHERE NOT EXISTS (SELECT 1 FROM done WHERE raw_post_id = id) ORDER BY created_s DESC, id LIMIT 500")
def scan_unprocessed(spark, d):
    return S.unprocessed(S.posts(spark, d), done(spark, d), 500).select("id", "created_s")


@query("scan_rankable", f"{P}, {DONE} SELECT id, author_id, quality FROM posts JOIN done ON raw_post_id = id WHERE created_s >= {NOW_S} - 36000")
def scan_rankable(spark, d):
    since = F.unix_timestamp(F.lit(S.NOW)) - 36000
    return S.rankable(S.posts(spark, d), done(spark, d), since).select("id", "author_id", "quality")


@query("scan_unchecked", f"{P}, {DONE} SELECT id, author_id FROM posts JOIN done ON raw_post_id = id WHERE source = 'bluesky' AND quality = 1 ORDER BY created_s DESC, id LIMIT 100")
def scan_unchecked(spark, d):
    p = S.posts(spark, d).filter("source = 'bluesky'")
    return S.newest_first(p.join(done(spark, d).filter("quality = 1"), F.col("id") == F.col("raw_post_id")), "created_s", 100, "id").select("id", "author_id")


@query("topn_newest", f"{P} SELECT id FROM posts ORDER BY created_s DESC, id LIMIT 50")
def topn_newest(spark, d):
    return S.newest_first(S.posts(spark, d), "created_s", 50, "id").select("id")


@query("topn_pool", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 2000")
def topn_pool(spark, d):
    return table(spark, d, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(2000)


@query("join_inner", f"{P}, {DONE} SELECT id, source, quality FROM posts JOIN done ON raw_post_id = id")
def join_inner(spark, d):
    return S.posts(spark, d).join(done(spark, d), F.col("id") == F.col("raw_post_id")).select("id", "source", "quality")


@query("join_anti", f"{P}, {DONE} SELECT id FROM posts WHERE id NOT IN (SELECT raw_post_id FROM done)")
def join_anti(spark, d):
    return S.posts(spark, d).join(done(spark, d), F.col("id") == F.col("raw_post_id"), "left_anti").select("id")


@query("join_semi", "SELECT c_nationkey, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY 1")
def join_semi(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").groupBy("c_nationkey").agg(F.count("*").alias("n"))


DOMAINS = ["example.com", "the.example.org", "shop.example.net"]


@query("join_theta_suffix", f"SELECT page_id, domain FROM pages, (VALUES {', '.join(f'({chr(39)}{x}{chr(39)})' for x in DOMAINS)}) t(domain) WHERE {NETLOC} = domain OR {NETLOC} LIKE '%.' || domain")
def join_theta_suffix(spark, d):
    listed = spark.createDataFrame([(x,) for x in DOMAINS], "domain string")
    return T.under_domains(table(spark, d, "pages"), U.netloc(F.col("url")), listed).select("page_id", "domain")


#: The hosts of every page, and what is above them: a table of domains that grows with the pages.
PARENTS = f"hosts AS (SELECT DISTINCT {NETLOC} AS host FROM pages), listed AS (SELECT host AS domain FROM hosts WHERE host <> '' UNION SELECT regexp_replace(host, '^[^.]*\\.', '') FROM hosts WHERE position('.' IN host) > 0)"


@query("join_theta_suffix_all", f"WITH {PARENTS} SELECT domain, count(*) AS pages, min(page_id) AS first FROM pages, listed WHERE {NETLOC} = domain OR {NETLOC} LIKE '%.' || domain GROUP BY domain")
def join_theta_suffix_all(spark, d):
    p = table(spark, d, "pages").select("page_id", U.netloc(F.col("url")).alias("host"))
    hosts = p.select("host").distinct().filter("host <> ''")
    listed = hosts.select(F.col("host").alias("domain")).unionByName(hosts.filter(F.col("host").contains(".")).select(F.regexp_replace("host", r"^[^.]*\.", "").alias("domain")))
    return T.under_domains(p, F.col("host"), listed).groupBy("domain").agg(F.count("*").alias("pages"), F.min("page_id").alias("first"))


TERMS = ["with", "für", "para", "idiot"]


@query("join_theta_regex", "SELECT doc_id, term FROM documents, (VALUES ('with'), ('für'), ('para'), ('idiot')) t(term) WHERE regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])' || term || '($|[^\\p{L}\\p{N}_])')")
def join_theta_regex(spark, d):
    listed = spark.createDataFrame([(t,) for t in TERMS], "term string")
    return T.contained_terms(table(spark, d, "documents"), listed, "doc_id").select(F.col("id").alias("doc_id"), "term")


#: Words of all benchmark items, as a table of terms.
WORDS = "list_distinct(regexp_extract_all(lower(text), '([\\p{L}\\p{N}_]+)', 1))"


@query("join_theta_terms_all", f"WITH terms AS (SELECT DISTINCT unnest({WORDS}) AS term FROM benchmark), said AS (SELECT doc_id, unnest({WORDS}) AS term FROM documents) SELECT term, count(*) AS texts, min(doc_id) AS first FROM said JOIN terms USING (term) GROUP BY term")
def join_theta_terms_all(spark, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    listed = table(spark, d, "benchmark").select(F.explode(words).alias("term"))
    return T.contained_terms(table(spark, d, "documents"), listed, "doc_id").groupBy("term").agg(F.count("*").alias("texts"), F.min("id").alias("first"))


@query("join_url", f"WITH c AS (SELECT page_id, {CANON} AS u FROM pages) SELECT u, min(page_id) AS first, count(*) AS pages FROM c WHERE u IS NOT NULL GROUP BY u")
def join_url(spark, d):
    c = table(spark, d, "pages").select("page_id", U.canonical(F.col("url")).alias("u")).filter("u IS NOT NULL")
    return c.groupBy("u").agg(F.min("page_id").alias("first"), F.count("*").alias("pages"))


@query("join_lookup", "SELECT DISTINCT o.o_custkey AS custkey, c.c_mktsegment AS segment FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) c ON c_custkey = o_custkey")
def join_lookup(spark, d):
    keys = table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"))
    found = table(spark, d, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("segment"))
    return S.looked_up(keys, found, "custkey")


@query("lookup_page", "SELECT DISTINCT url, first_value(page_id) OVER (PARTITION BY url ORDER BY page_id) AS page_id FROM pages")
def lookup_page(spark, d):
    p = table(spark, d, "pages")
    return S.looked_up(p, p.groupBy("url").agg(F.min("page_id").alias("page_id")), "url")


PENDING = """WITH b AS (SELECT user_id AS key, epoch_us(ts) / 1000000.0 AS t, event_id AS post, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS kind FROM events),
l AS (SELECT *, lag(kind) OVER w AS lk, lag(t) OVER w AS lt FROM b WINDOW w AS (PARTITION BY key ORDER BY t, kind, post))
SELECT key, post FROM l WHERE kind = 1 AND NOT coalesce(lk = 0 AND t - lt <= 7200, false)"""


@query("join_pending_exclusion", PENDING)
def join_pending_exclusion(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("t"), F.col("event_id").alias("post"), "event_type")
    return V.pending_exclusions(e.filter("event_type <> 'error'"), e.filter("event_type = 'error'"), 7200).select("key", "post")


@query("sink_insert_ignore", """WITH old AS (SELECT o_custkey AS k, min(o_orderkey) AS v FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1),
new AS (SELECT o_custkey AS k, min(o_orderkey) AS v FROM orders WHERE o_orderkey % 3 = 1 GROUP BY 1)
SELECT k, v FROM old UNION ALL SELECT k, v FROM new WHERE k NOT IN (SELECT k FROM old)""")
def sink_insert_ignore(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    old = o.filter("v % 3 = 0").groupBy("k").agg(F.min("v").alias("v"))
    t = kept(old, ["k"])
    t.insert_ignore(o.filter("v % 3 = 1"), ["v"])
    return t.rows()


@query("sink_upsert", """SELECT k, v, p FROM (SELECT o_custkey AS k, o_orderkey AS v, o_totalprice AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders WHERE o_orderkey % 3 <> 2) WHERE n = 1""")
def sink_upsert(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), F.col("o_totalprice").alias("p"))
    t = Store.create(spark, new_folder(spark, "table"), o.schema, ["k"])
    for turn in (0, 1):
        t.upsert(o.filter(f"v % 3 = {turn}"), "v")
    return t.rows()


@query("sink_update_scores", "SELECT c_custkey, CASE WHEN s.a IS NULL THEN c_acctbal ELSE s.a END AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS a FROM orders GROUP BY 1) s ON k = c_custkey")
def sink_update_scores(spark, d):
    v = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("c_acctbal"))
    t = kept(table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_custkey"])
    t.update(v, ["c_acctbal"])
    return t.rows()


@query("sink_mark_checked", "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 1 END AS checked FROM documents")
def sink_mark_checked(spark, d):
    t = kept(table(spark, d, "documents").select("doc_id", F.lit(None).cast("int").alias("checked")), ["doc_id"])
    t.mark(table(spark, d, "labels"), "checked", F.lit(1))
    return t.rows()


@query("retention", f"{P} SELECT id FROM posts WHERE created_s >= {NOW_S} - 43200")
def retention(spark, d):
    t = kept(S.posts(spark, d).select("id", "created_s"), ["id"])
    t.retain("created_s", F.unix_timestamp(F.lit(S.NOW)) - 43200)
    return t.rows().select("id")


@query("delete_by_key", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def delete_by_key(spark, d):
    gone = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    t = kept(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])
    t.delete(gone)
    return t.rows()


BLOCKED = "blocked AS (SELECT 'bluesky' AS source, 'src4' AS author_id UNION ALL SELECT 'mastodon', 'src7')"


def blocked(spark):
    return spark.createDataFrame([("bluesky", "src4"), ("mastodon", "src7")], "source string, author_id string")


@query("purge_blocked", f"{P}, {BLOCKED} SELECT id FROM posts p WHERE NOT EXISTS (SELECT 1 FROM blocked b WHERE b.source = p.source AND b.author_id = p.author_id)")
def purge_blocked(spark, d):
    t = kept(S.posts(spark, d).select("id", "source", "author_id"), ["id"])
    t.delete(blocked(spark), ["source", "author_id"])
    return t.rows().select("id")


@query("cascade_delete", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000)")
def cascade_delete(spark, d):
    t = kept(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], unique=False)
    t.cascade(table(spark, d, "orders").filter("o_totalprice > 200000"), "l_orderkey", "o_orderkey")
    return t.rows()


@query("sink_partial_upsert", """WITH t AS (SELECT s_suppkey AS k, s_acctbal AS v, s_name AS keep FROM supplier WHERE s_suppkey % 2 = 0), n AS (SELECT s_suppkey AS k, s_acctbal + 1 AS v, 'new' AS keep FROM supplier WHERE s_suppkey % 3 = 0)
SELECT coalesce(t.k, n.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.v ELSE t.v END AS v, CASE WHEN t.k IS NULL THEN n.keep ELSE t.keep END AS keep FROM t FULL JOIN n ON t.k = n.k""")
def sink_partial_upsert(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"), F.col("s_name").alias("keep"))
    t = kept(s.filter("k % 2 = 0"), ["k"])
    t.partial_upsert(s.filter("k % 3 = 0").select("k", (F.col("v") + 1).alias("v"), F.lit("new").alias("keep")), ["v"])
    return t.rows()


@query("set_union_candidates", "SELECT DISTINCT a, b FROM (SELECT l_partkey AS a, l_suppkey AS b FROM lineitem UNION SELECT l_suppkey, l_partkey FROM lineitem) WHERE a <> b")
def set_union_candidates(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return p.union(p.select("b", "a")).filter("a <> b").distinct()


@query("set_distinct_ordered", "SELECT event_type, min(event_id) AS first FROM events GROUP BY 1")
def set_distinct_ordered(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.min("event_id").alias("first"))


@query("set_except_missing", "SELECT doc_id, 'not_found' AS status FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)")
def set_except_missing(spark, d):
    return table(spark, d, "documents").select("doc_id").exceptAll(table(spark, d, "labels").select("doc_id").distinct()).withColumn("status", F.lit("not_found"))


@query("page_merge_dedupe", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id // 20, event_id) AS n FROM events) WHERE n = 1")
def page_merge_dedupe(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.expr("event_id div 20"), "event_id")
    return table(spark, d, "events").withColumn("n", F.row_number().over(w)).filter("n = 1").select("user_id", "event_id")


@query("page_percentile", "SELECT event_id, round(cume_dist() OVER (PARTITION BY user_id ORDER BY value), 9) AS fraction FROM events")
def page_percentile(spark, d):
    return table(spark, d, "events").select("event_id", F.round(F.cume_dist().over(Window.partitionBy("user_id").orderBy("value")), 9).alias("fraction"))


FEED = "feed AS (SELECT doc_id AS id, source, lang, n_chars % 97 AS rank_score FROM documents WHERE doc_id % 11 <> 0)"


def feed(spark, d):
    return table(spark, d, "documents").filter("doc_id % 11 <> 0").select(F.col("doc_id").alias("id"), "source", "lang", (F.col("n_chars") % 97).alias("rank_score"))


@query("feed_page", f"WITH {FEED} SELECT id, rank_score FROM feed WHERE lang = 'en' AND (rank_score < 50 OR (rank_score = 50 AND id < 500)) ORDER BY rank_score DESC, id DESC LIMIT 20")
def feed_page(spark, d):
    from ..operators.feed import page

    return page(feed(spark, d), 20, (50, 500), lang="en").select("id", "rank_score")


@query("feed_has_next", f"WITH {FEED}, p AS (SELECT *, row_number() OVER (ORDER BY rank_score DESC, id DESC) AS n FROM feed) SELECT id, rank_score, (SELECT count(*) FROM feed) > 20 AS has_next FROM p WHERE n <= 20")
def feed_has_next(spark, d):
    from ..operators.feed import page_with_next

    return page_with_next(feed(spark, d), 20).select("id", "rank_score", "has_next")


@query("feed_json", f"""WITH {FEED} SELECT id, '{{"id":' || id || ',"source":"' || source || '","score":' || rank_score || '}}' AS body FROM feed""")
def feed_json(spark, d):
    return feed(spark, d).select("id", F.to_json(F.struct("id", "source", F.col("rank_score").alias("score"))).alias("body"))


@query("feed_response")
def feed_response(spark, d):
    """The first page of all posts as the feed's JSON; tests hold its fields and cursors."""
    from ..operators.feed import response

    null = {c: F.lit(None).cast(t) for c, t in (("thumbnail", "string"), ("entities", "array<string>"), ("display_name", "string"), ("avatar_url", "string"), ("category", "string"))}
    p = S.posts(spark, d).withColumns({"source_id": F.concat("author_id", F.lit("/"), F.col("id").cast("string")), "created_at": F.timestamp_seconds("created_s"), "raw_json": F.lit("{}"), "pipeline_version": F.lit("v1"), **null})
    scores = {"rank_score": (F.length("text") % 97).cast("double"), "sentiment": F.lit(0.5), "topicality": F.lit(1.0), "base_score": F.lit(0.5)}
    return response(p.withColumns(scores))


@query("lookup_quotes")
def lookup_quotes(spark, d):
    from ..operators import posts_json as J

    keys = table(spark, d, "documents").select(F.concat(F.lit("at://"), "source", F.lit("/app.bsky.feed.post/"), F.col("doc_id").cast("string")).alias("uri"), "doc_id", "text")
    views = keys.filter("doc_id % 4 <> 0").select("uri", F.to_json(F.struct(F.struct(F.lit("h").alias("handle")).alias("author"), F.struct("text").alias("record"))).alias("view"))
    found = S.looked_up(keys, views, "uri")
    return found.select("uri", J.quote_view(F.coalesce("view", F.lit("{}")), F.lit(False)).alias("q")).select("uri", "q.status", "q.reason", F.md5("q.text").alias("text_md5"))
