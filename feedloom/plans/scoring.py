"""Windows, clusters, scores and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT
from ..functions import language as L
from ..functions import text as X
from ..functions import urls as U
from ..operators import classify as B
from ..operators import cycle as C
from ..operators import dedup as D
from ..operators import moderation as M
from ..operators import scoring as R
from ..operators import similar as A
from ..operators import windows as V
from ..operators.evaluate import macro_f1
from ..sources import tables as S
from ..sources.shared import written
from ..sources.tables import POSTS_SQL, table
from .filters import CONTENT, CONTEXT, LANGUAGE, label, raw_json, tagged
from .functions import CANON, LEXICAL, NORM, SKELETON, TOKEN_LIST
from .registry import query
from .tables import BLOCKED, DOMAINS, NOW_S, blocked

P = f"WITH RECURSIVE {POSTS_SQL}"
TERM_LIST = rf"list_filter(regexp_extract_all({NORM}, '([\p{{L}}\p{{N}}_]{{2,}})', 1), lambda t: t NOT IN ({X.STOPS_SQL}))"
TF = f"tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({TERM_LIST}) AS term FROM posts) GROUP BY 1, 2)"
IDF = "idf AS (SELECT term, count(*) AS df, ln((1.0 + (SELECT count(*) FROM posts)) / (1.0 + count(*))) + 1 AS idf FROM tf GROUP BY term)"
WEIGHTS = "w AS (SELECT id, tf.term, (1 + ln(tf)) * idf AS weight FROM tf JOIN idf USING (term))"
SALIENCE = "sal AS (SELECT id, sum(weight) / count(*) / pow(CAST(max(nnz) AS DOUBLE), 0.3) AS salience FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, term) AS r, count(*) OVER (PARTITION BY id) AS nnz FROM w) WHERE r <= 3 GROUP BY id)"
SENT = "(2.0 * len(list_filter({t}, lambda x: x IN ({p}))) - 2.0 * len(list_filter({t}, lambda x: x IN ({n}))))".format(t=TOKEN_LIST, p=", ".join(f"'{w}'" for w in R.POSITIVE), n=", ".join(f"'{w}'" for w in R.NEGATIVE))


def counted(spark, d) -> DataFrame:
    p = S.posts(spark, d)
    return p, R.term_rows(p)


def weights(spark, d, sublinear=True):
    p, t = counted(spark, d)
    return R.weighted(t, R.idf(t, p.agg(F.count("*").alias("n"))), sublinear)


@query("tfidf_idf", f"{P}, {TF}, {IDF} SELECT term, df, round(idf, 9) AS idf FROM idf")
def tfidf_idf(spark, d):
    p, t = counted(spark, d)
    return R.idf(t, p.agg(F.count("*").alias("n"))).select("term", "df", F.round("idf", 9).alias("idf"))


@query("tfidf_sublinear", f"{P}, {TF} SELECT id, term, round(1 + ln(tf), 9) AS tf FROM tf")
def tfidf_sublinear(spark, d):
    return counted(spark, d)[1].select("id", "term", F.round(1 + F.log("tf"), 9).alias("tf"))


@query("topk_mean", f"{P}, {TF}, {IDF}, {WEIGHTS}, {SALIENCE} SELECT id, round(salience, 6) AS salience FROM sal")
def topk_mean(spark, d):
    return R.salience(weights(spark, d)).select("id", F.round("salience", 6).alias("salience"))


@query("topk_terms", f"{P}, {TF}, {IDF}, {WEIGHTS} SELECT id, rank, term FROM (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY round(weight, 9) DESC, term) AS rank FROM w) WHERE rank <= 3")
def topk_terms(spark, d):
    return R.top_terms(weights(spark, d))


def in_context(spark, d) -> DataFrame:
    """Posts with the JSON that says what they reply to."""
    return S.posts(spark, d).withColumn("raw_json", raw_json())


def base_scores(posts: DataFrame, cfg=DEFAULT) -> DataFrame:
    """id, created_s, topicality (without bursts), sentiment, base_score of posts with raw_json at the constant now."""
    t = R.term_rows(posts)
    s = R.salience(R.weighted(t, R.idf(t, posts.agg(F.count("*").alias("n")))), cfg)
    age = (F.unix_timestamp(F.lit(S.NOW)) - F.col("created_s")) / 3600.0
    penalty = M.context(F.col("source"), F.col("author_id"), F.col("raw_json"), F.col("text"), cfg)["multiplier"]
    plain = posts.select("id", "created_s", R.lexicon_sentiment(F.col("text")).alias("sentiment"), age.alias("age_h"), penalty.alias("penalty"))
    scored = plain.join(s, "id", "left").withColumn("topicality", F.coalesce("salience", F.lit(0.0)))
    return scored.select("id", "created_s", "topicality", "sentiment", R.base_score(F.col("sentiment"), F.col("topicality"), F.col("age_h"), F.col("penalty"), cfg).alias("base_score"))


#: Content alone: positive sentiment, topicality, decay by half every 12 hours, and 0.4 for replies to others.
BASE = f"""{TF}, {IDF}, {WEIGHTS}, {SALIENCE}, feel AS (SELECT id, created_s, {SENT} AS x, CASE WHEN {CONTEXT} = 'devalue' THEN 0.4 ELSE 1.0 END AS penalty FROM posts),
base AS (SELECT f.id, f.created_s, coalesce(salience, 0.0) AS topicality, x / sqrt(x * x + 15) AS sentiment, penalty,
 CASE WHEN x > 0 THEN x / sqrt(x * x + 15) ELSE 0.0 END * coalesce(salience, 0.0) * pow(0.5, greatest(0.0, ({NOW_S} - created_s) / 3600.0) / 12) * penalty AS base_score FROM feel f LEFT JOIN sal USING (id))"""


@query("base_score", f"{P}, {BASE} SELECT id, round(topicality, 6) AS topicality, round(sentiment, 6) AS sentiment, round(base_score, 6) AS base_score FROM base")
def base_score(spark, d):
    return base_scores(in_context(spark, d)).select("id", *(F.round(c, 6).alias(c) for c in ("topicality", "sentiment", "base_score")))


@query("positivity", f"{P} SELECT id, round(CASE WHEN x > 0 THEN x / sqrt(x * x + 15) ELSE 0.0 END, 9) AS positivity FROM (SELECT id, {SENT} AS x FROM posts)")
def positivity(spark, d):
    return S.posts(spark, d).select("id", F.round(R.positivity(R.lexicon_sentiment(F.col("text"))), 9).alias("positivity"))


@query("recency_decay", f"{P} SELECT id, round(pow(0.5, id * 60 / 3600.0 / 12), 9) AS decay FROM posts")
def recency_decay(spark, d):
    return S.posts(spark, d).select("id", F.round(R.recency_decay(F.col("id") * 60 / 3600.0), 9).alias("decay"))


@query("sentiment", f"{P} SELECT id, round(x / sqrt(x * x + 15), 9) AS sentiment, 'lexicon_v1' AS method FROM (SELECT id, {SENT} AS x FROM posts)")
def sentiment(spark, d):
    return S.posts(spark, d).select("id", F.round(R.lexicon_sentiment(F.col("text")), 9).alias("sentiment"), F.lit("lexicon_v1").alias("method"))


E_SQL = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000000 AS s FROM events)"


def events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.expr("unix_micros(cast(ts as timestamp)) div 1000000").alias("s"))


def anchored_sql(source: str, keys: str, ttl: int, o: str = "o", g: str = "g") -> str:
    """Anchored windows by a recursive walk over each key's events."""
    on = " AND ".join(f"n.{k} = g.{k}" for k in keys.split(", "))
    return f"""{o} AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY s, event_id) AS n FROM {source}),
{g} AS (SELECT *, s AS start FROM {o} WHERE n = 1 UNION ALL SELECT n.*, CASE WHEN n.s - g.start >= {ttl} THEN n.s ELSE g.start END FROM {o} n JOIN {g} g ON {on} AND n.n = g.n + 1)"""


@query("bot_velocity", f"WITH RECURSIVE {E_SQL}, {anchored_sql('e', 'user_id', 86400)} SELECT event_id, row_number() OVER (PARTITION BY user_id, start ORDER BY s, event_id) AS n, least(1.0, row_number() OVER (PARTITION BY user_id, start ORDER BY s, event_id) / 15.0) AS component FROM g")
def bot_velocity(spark, d):
    n = V.anchored_count(events(spark, d), ["user_id"], "s", ["event_id"], 86400, "n")
    return n.select("event_id", "n", V.component(F.col("n"), 15).alias("component"))


def rolling_sql(source: str, keys: str, ttl: int, f: str = "f", se: str = "se") -> str:
    return f"""{f} AS (SELECT *, CASE WHEN lag(s) OVER (PARTITION BY {keys} ORDER BY s, event_id) IS NULL OR s - lag(s) OVER (PARTITION BY {keys} ORDER BY s, event_id) >= {ttl} THEN 1 ELSE 0 END AS fresh FROM {source}),
{se} AS (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS session FROM {f})"""


@query("entity_burst", f"WITH {E_SQL}, {rolling_sql('e', 'event_type, user_id', 200000)} SELECT event_id, row_number() OVER (PARTITION BY event_type, user_id, session ORDER BY s, event_id) AS mentions FROM se")
def entity_burst(spark, d):
    return V.rolling_count(events(spark, d), ["event_type", "user_id"], "s", ["event_id"], 200000, "mentions").select("event_id", "mentions")


@query("burst_component", f"WITH {E_SQL}, {rolling_sql('e', 'event_type, user_id', 200000)}, m AS (SELECT user_id, row_number() OVER (PARTITION BY event_type, user_id, session ORDER BY s, event_id) AS n FROM se) SELECT user_id, max(n) AS most, least(1.0, max(n) / 5.0) AS component FROM m GROUP BY 1")
def burst_component(spark, d):
    m = V.rolling_count(events(spark, d), ["event_type", "user_id"], "s", ["event_id"], 200000, "n")
    return m.groupBy("user_id").agg(F.max("n").alias("most")).withColumn("component", V.component(F.col("most"), 5))


BOT_POSTS = f"b AS (SELECT id AS event_id, author_id, created_s AS s, {SKELETON} AS skeleton FROM (SELECT id, author_id, created_s, {NORM} AS text FROM posts))"


@query("bot_template", f"{P}, {BOT_POSTS}, {rolling_sql('b', 'author_id, skeleton', 86400)} SELECT event_id, row_number() OVER (PARTITION BY author_id, skeleton, session ORDER BY s, event_id) AS n FROM se")
def bot_template(spark, d):
    b = S.posts(spark, d).select(F.col("id").alias("event_id"), "author_id", F.col("created_s").alias("s"), X.template_skeleton(X.normalise(F.col("text"))).alias("skeleton"))
    return V.rolling_count(b, ["author_id", "skeleton"], "s", ["event_id"], 86400, "n").select("event_id", "n")


@query("bot_self_dup", f"WITH RECURSIVE {E_SQL}, {anchored_sql('e', 'event_type', 3600 * 8)} SELECT event_id, row_number() OVER (PARTITION BY event_type, start, user_id ORDER BY s, event_id) > 1 AS seen FROM g")
def bot_self_dup(spark, d):
    return V.seen_before(events(spark, d), ["event_type"], "user_id", "s", ["event_id"], 3600 * 8, "seen").select("event_id", "seen")


SHINGLES = f"""n AS (SELECT id, {NORM} AS t FROM posts), ws AS (SELECT id, CASE WHEN t = '' THEN [] ELSE string_split(t, ' ') END AS w FROM n),
sh AS (SELECT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3])) END) AS s FROM ws),
sz AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
pairs AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2),
near AS (SELECT a, b, c / CAST(x.n + y.n - c AS DOUBLE) AS j FROM pairs JOIN sz x ON x.id = a JOIN sz y ON y.id = b)"""


def groups(posts: DataFrame) -> DataFrame:
    """Clusters by exact similarity."""
    return D.clusters(posts, D.text_links(posts, 4, 0.7))


@query("join_lsh", f"{P}, {SHINGLES} SELECT a, b, round(j, 9) AS jaccard FROM near WHERE j >= 0.7")
def join_lsh(spark, d):
    members, firsts = D.set_classes(D.shingle_sets(S.posts(spark, d), 4))
    return D.all_pairs(members, D.exact_pairs(firsts, 0.7)).select("a", "b", F.round("jaccard", 9).alias("jaccard"))


ROOTS = """parent AS (SELECT b AS id, min(a) AS p FROM near WHERE j >= 0.7 GROUP BY b),
roots AS (SELECT id, id AS root FROM posts WHERE id NOT IN (SELECT id FROM parent) UNION ALL SELECT q.id, r.root FROM parent q JOIN roots r ON q.p = r.id)"""
CLUSTERS = f"{P}, {SHINGLES}, {ROOTS}"


@query("dedup_clusters", f"{CLUSTERS} SELECT id, root AS cluster FROM roots")
def dedup_clusters(spark, d):
    return groups(S.posts(spark, d)).select("id", "cluster")


@query("dedup_canonical", f"{CLUSTERS} SELECT id, id = root AS canonical FROM roots")
def dedup_canonical(spark, d):
    return groups(S.posts(spark, d)).select("id", "canonical")


MINHASH = "mh AS (SELECT id, CAST(('0x' || substr(md5(s), 1, 8)) AS BIGINT) % 2147483647 AS x, CAST(('0x' || substr(md5(s), 9, 8)) AS BIGINT) % 2147483647 AS y FROM sh)"


@query("minhash_signature", f"{P}, {SHINGLES}, {MINHASH} SELECT id, i, min((x + i * y) % 2147483647) AS value FROM mh, range(0, 128) r(i) GROUP BY 1, 2")
def minhash_signature(spark, d):
    s = D.signatures(S.posts(spark, d))
    return s.select("id", F.posexplode("signature").alias("i", "value")).select("id", F.col("i").cast("long").alias("i"), "value")


#: Canonical address of the first URL in a text.
FIRST_URL = CANON.replace("url", "regexp_extract(text, '(https?://[^ \\t\\n\\x0b\\x0c\\r]+)', 1)")
ESTIMATE = f"""sig AS (SELECT id, i, min((x + i * y) % 2147483647) AS v FROM mh, range(0, 128) r(i) GROUP BY 1, 2),
bands AS (SELECT id, i // 8 AS band, string_agg(v, ',' ORDER BY i) AS h FROM sig GROUP BY 1, 2),
links AS (SELECT id, {FIRST_URL} AS link FROM posts),
cand AS (SELECT DISTINCT x.id AS a, y.id AS b, 0.7 AS least FROM bands x JOIN bands y ON x.band = y.band AND x.h = y.h AND x.id < y.id
 UNION SELECT x.id, y.id, 0.2 FROM links x JOIN links y ON x.link = y.link AND x.id < y.id),
near AS (SELECT c.a, c.b, CASE WHEN count(*) FILTER (WHERE x.v = y.v) / 128.0 >= c.least THEN 1.0 ELSE 0.0 END AS j FROM cand c JOIN sig x ON x.id = c.a JOIN sig y ON y.id = c.b AND y.i = x.i GROUP BY c.a, c.b, c.least)"""


@query("dedup_minhash", f"{P}, {SHINGLES.partition(',\nsz AS')[0]}, {MINHASH}, {ESTIMATE}, {ROOTS} SELECT id, root AS cluster, id = root AS canonical FROM roots")
def dedup_minhash(spark, d):
    p = S.posts(spark, d)
    return D.dedup_posts(p, p.select("id", U.canonical(U.first_url(F.col("text"))).alias("url")))


@query("signature_codec", f"{P}, {SHINGLES.partition(',\nsz AS')[0]}, {MINHASH}, sig AS (SELECT id, i, min((x + i * y) % 2147483647) AS v FROM mh, range(0, 128) r(i) GROUP BY 1, 2) SELECT id, '00000080' || string_agg(printf('%08X', v), '' ORDER BY i) AS raw, max(v) FILTER (WHERE i = 127) AS last FROM sig GROUP BY id")
def signature_codec(spark, d):
    raw = D.signatures(S.posts(spark, d)).select("id", D.serialised(F.col("signature")).alias("raw"))
    back = raw.withColumn("signature", D.deserialised(F.col("raw")))
    return back.select("id", F.hex("raw").alias("raw"), F.get("signature", F.lit(DEFAULT.permutations - 1)).alias("last"))


SELF = f"""{rolling_sql('b', 'author_id, skeleton', 86400)},
t AS (SELECT event_id, row_number() OVER (PARTITION BY author_id, skeleton, session ORDER BY s, event_id) AS n FROM se),
{anchored_sql('b', 'author_id', 3600)},
v AS (SELECT event_id, row_number() OVER (PARTITION BY author_id, start ORDER BY s, event_id) AS n FROM g),
bc AS (SELECT b.*, root AS cluster FROM b JOIN roots ON roots.id = b.event_id), {anchored_sql('bc', 'cluster', 86400, 'oc', 'gc')},
again AS (SELECT event_id, row_number() OVER (PARTITION BY cluster, start, author_id ORDER BY s, event_id) > 1 AS seen FROM gc),
bot AS (SELECT p.id, 0.30 * least(1.0, v.n / 15.0) + 0.25 * CAST(seen AS INTEGER) + 0.20 * ({LEXICAL}) + 0.25 * least(1.0, t.n / 5.0) AS score
 FROM posts p JOIN t ON t.event_id = p.id JOIN v ON v.event_id = p.id JOIN again ON again.event_id = p.id)"""


@query("bot_score", f"{CLUSTERS}, {BOT_POSTS}, {SELF} SELECT id, round(score, 6) AS score, score >= 0.5 AS is_bot FROM bot")
def bot_score(spark, d):
    p = S.posts(spark, d)
    x = C.bot_scores(p, groups(p))
    return x.select("id", F.round("bot_score", 6).alias("score"), "is_bot")


#: The pool of the production ranking: similarities are only ever taken within it.
POOL = f"pool AS (SELECT id, text FROM posts ORDER BY created_s DESC, id LIMIT {DEFAULT.pool})"
COS = f"""{POOL}, {TF.replace('FROM posts', 'FROM pool')}, {IDF.replace('FROM posts', 'FROM pool')}, wr AS (SELECT id, tf.term, tf * idf AS weight FROM tf JOIN idf USING (term)), nr AS (SELECT id, sqrt(sum(weight * weight)) AS norm FROM wr GROUP BY id),
u AS (SELECT wr.id, term, weight / norm AS w FROM wr JOIN nr ON nr.id = wr.id),
cosines AS (SELECT a.id AS a, b.id AS b, sum(a.w * b.w) AS cosine FROM u a JOIN u b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2)"""
ENTITY_LIST = r"list_distinct(list_transform(regexp_extract_all(text, '(\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*)', 1), lambda e: left(lower(e), 100)))"
JACCARDS = f"""en AS (SELECT id, unnest({ENTITY_LIST}) AS entity FROM pool), ne AS (SELECT id, count(*) AS n FROM en GROUP BY id),
jaccards AS (SELECT a, b, c / CAST(x.n + y.n - c AS DOUBLE) AS jaccard FROM (SELECT p.id AS a, q.id AS b, count(*) AS c FROM en p JOIN en q ON p.entity = q.entity AND p.id < q.id GROUP BY 1, 2) JOIN ne x ON x.id = a JOIN ne y ON y.id = b)"""


def pool(spark, d) -> DataFrame:
    """The newest posts, as many as one ranking takes."""
    return written(S.newest_first(S.posts(spark, d), "created_s", DEFAULT.pool, "id").select("id", "text").repartition(C.POOL_PARTS, "id"), "pool")


def pool_cosines(p: DataFrame) -> DataFrame:
    t = R.term_rows(p)
    return R.similarity(R.weighted(t, R.idf(t, p.agg(F.count("*").alias("n"))), False))


def pool_jaccards(p: DataFrame) -> DataFrame:
    return R.entity_jaccard(p.select("id", F.explode(L.entities(F.col("text"))).alias("entity")))


@query("mmr_tfidf", f"{P}, {COS} SELECT a, b, round(cosine, 6) AS cosine FROM cosines")
def mmr_tfidf(spark, d):
    return pool_cosines(pool(spark, d)).select("a", "b", F.round("cosine", 6).alias("cosine"))


@query("mmr_entity_jaccard", f"{P}, {POOL}, {JACCARDS} SELECT a, b, round(jaccard, 9) AS jaccard FROM jaccards")
def mmr_entity_jaccard(spark, d):
    return pool_jaccards(pool(spark, d)).select("a", "b", F.round("jaccard", 9).alias("jaccard"))


@query("mmr_similarity", f"{P}, {COS}, {JACCARDS} SELECT a, b, round(0.5 * coalesce(cosine, 0.0) + 0.5 * coalesce(jaccard, 0.0), 6) AS similarity FROM cosines FULL JOIN jaccards USING (a, b)")
def mmr_similarity(spark, d):
    p = pool(spark, d)
    both = pool_cosines(p).join(pool_jaccards(p), ["a", "b"], "full")
    mix = DEFAULT.similarity_mix
    return both.select("a", "b", F.round(mix * F.coalesce("cosine", F.lit(0.0)) + (1 - mix) * F.coalesce("jaccard", F.lit(0.0)), 6).alias("similarity"))


#: Similarity from which pairs of all posts are reported.
SIMILAR = 0.8
ALL_WEIGHTS = f"""{TF}, {IDF}, wr AS (SELECT id, tf.term, tf * idf AS weight FROM tf JOIN idf USING (term)), nr AS (SELECT id, sqrt(sum(weight * weight)) AS norm FROM wr GROUP BY id),
u AS (SELECT wr.id, term, weight / norm AS w FROM wr JOIN nr ON nr.id = wr.id), vs AS (SELECT id, string_agg(term || ' ' || tf, ' ' ORDER BY term) AS v FROM tf GROUP BY id),
en AS (SELECT id, unnest({ENTITY_LIST}) AS entity FROM posts), es AS (SELECT id, string_agg(entity, '|' ORDER BY entity) AS e, count(*) AS n FROM en GROUP BY id)"""
#: Posts with their first of equal ones, and the first ones alone.
FIRSTS = "m AS (SELECT id, min(id) OVER (PARTITION BY {by}) AS first FROM {of}), f AS (SELECT id FROM m WHERE id = first)"
COSINES = "cs AS (SELECT a.id AS a, b.id AS b, sum(a.w * b.w) AS cosine FROM u a JOIN u b ON a.term = b.term AND a.id < b.id WHERE a.id IN (SELECT id FROM f) AND b.id IN (SELECT id FROM f) GROUP BY 1, 2)"
JS = """js AS (SELECT a, b, c / CAST(x.n + y.n - c AS DOUBLE) AS jaccard FROM (SELECT p.id AS a, q.id AS b, count(*) AS c FROM en p JOIN en q ON p.entity = q.entity AND p.id < q.id
 WHERE p.id IN (SELECT id FROM f) AND q.id IN (SELECT id FROM f) GROUP BY 1, 2) JOIN es x ON x.id = a JOIN es y ON y.id = b)"""


def all_entities(spark, d) -> DataFrame:
    return S.posts(spark, d).select("id", F.explode(L.entities(F.col("text"))).alias("entity"))


@query("sim_tfidf", f"{P}, {ALL_WEIGHTS}, {FIRSTS.format(by='v', of='vs')}, {COSINES} SELECT a, b, round(cosine, 6) AS cosine FROM cs WHERE cosine >= {SIMILAR} UNION ALL SELECT first, id, 1.0 FROM m WHERE id > first")
def sim_tfidf(spark, d):
    return A.similar_by_terms(S.posts(spark, d), SIMILAR).select("a", "b", F.round("cosine", 6).alias("cosine"))


@query("sim_entity_jaccard", f"{P}, {ALL_WEIGHTS}, {FIRSTS.format(by='e', of='es')}, {JS} SELECT a, b, round(jaccard, 9) AS jaccard FROM js WHERE jaccard >= {SIMILAR} UNION ALL SELECT first, id, 1.0 FROM m WHERE id > first")
def sim_entity_jaccard(spark, d):
    return A.similar_entities(all_entities(spark, d), SIMILAR).select("a", "b", F.round("jaccard", 9).alias("jaccard"))


@query("join_allpairs_sim", f"""{P}, {ALL_WEIGHTS}, ve AS (SELECT id, v, e FROM vs FULL JOIN es USING (id)), {FIRSTS.format(by='v, e', of='ve')}, {COSINES}, {JS}
SELECT a, b, round(0.5 * coalesce(cosine, 0.0) + 0.5 * coalesce(jaccard, 0.0), 6) AS similarity FROM cs FULL JOIN js USING (a, b) WHERE 0.5 * coalesce(cosine, 0.0) + 0.5 * coalesce(jaccard, 0.0) >= {SIMILAR} - 1e-9
UNION ALL SELECT m.first, m.id, 0.5 * CAST(vs.v IS NOT NULL AS INTEGER) + 0.5 * CAST(es.e IS NOT NULL AS INTEGER) FROM m LEFT JOIN vs ON vs.id = m.first LEFT JOIN es ON es.id = m.first WHERE m.id > m.first AND 0.5 * CAST(vs.v IS NOT NULL AS INTEGER) + 0.5 * CAST(es.e IS NOT NULL AS INTEGER) >= {SIMILAR}""")
def join_allpairs_sim(spark, d):
    return A.similar_by_terms_and_entities(S.posts(spark, d), DEFAULT.similarity_mix, SIMILAR).select("a", "b", F.round("similarity", 6).alias("similarity"))


def scored_cycle(spark, d) -> DataFrame:
    """The cycle over all posts, clustered by exact similarity."""
    now = F.unix_timestamp(F.lit(S.NOW))
    return C.scored(tagged(spark, d), blocked(spark), ["promo", "idiot"], DOMAINS, label(), F.lit(0.9), now, groups)


BURST = f"""said AS (SELECT id AS event_id, created_s AS s, unnest({ENTITY_LIST}) AS entity FROM posts), {rolling_sql('said', 'entity', 10800, 'fe', 'me')},
mention AS (SELECT event_id, row_number() OVER (PARTITION BY entity, session ORDER BY s, event_id) AS n FROM me),
burst AS (SELECT event_id AS id, max(n) AS mentions FROM mention GROUP BY 1)"""
TOPIC = "topicality * (1 + least(1.0, coalesce(mentions, 0) / 5.0))"
CYCLE = f"""WITH RECURSIVE {POSTS_SQL.replace('posts AS', 'raw AS', 1)}, {BLOCKED}, marked AS (SELECT p.*, b.author_id IS NOT NULL AS bl FROM raw p LEFT JOIN blocked b ON b.source = p.source AND b.author_id = p.author_id),
posts AS (SELECT * FROM marked WHERE NOT bl AND {CONTENT} IS NULL AND NOT coalesce({LANGUAGE}, false) AND {CONTEXT} <> 'exclude'),
{SHINGLES}, {ROOTS}, {BOT_POSTS}, {SELF}, {BASE}, {BURST}"""


@query("cycle_scores", f"""{CYCLE} SELECT base.id, root AS cluster, base.id = root AS canonical, round(sentiment, 6) AS sentiment, round({TOPIC}, 6) AS topicality, round(score, 6) AS bot_score, score >= 0.5 AS is_bot,
 CAST(penalty AS DOUBLE) AS penalty, round(base_score * (1 + least(1.0, coalesce(mentions, 0) / 5.0)), 6) AS base_score FROM base JOIN roots USING (id) JOIN bot USING (id) LEFT JOIN burst USING (id)""")
def cycle_scores(spark, d):
    return scored_cycle(spark, d).select("id", "cluster", "canonical", *(F.round(c, 6).alias(c) for c in ("sentiment", "topicality", "bot_score", "base_score")), "is_bot", "penalty")


@query("cycle_rank")
def cycle_rank(spark, d):
    """Exclusion, clusters, scores, eligibility, window, pool and marginal relevance in one; tests hold it against brute force."""
    return C.ranked(scored_cycle(spark, d), S.posts(spark, d), F.unix_timestamp(F.lit(S.NOW)))


@query("cycle_counts", f"{CYCLE} SELECT (SELECT count(*) FROM raw) AS read, (SELECT count(*) FROM posts) AS processed, (SELECT count(*) FROM raw) - (SELECT count(*) FROM posts) AS filtered")
def cycle_counts(spark, d):
    p = tagged(spark, d)
    kept = M.excluded(p, blocked(spark), ["promo", "idiot"], DOMAINS, label(), F.lit(0.9)).filter("reason IS NULL")
    return C.counts(p, kept)


@query("mmr_rank")
def mmr_rank(spark, d):
    """The best posts by base score within the window, in order of marginal relevance; weights are those of the pool."""
    now = F.unix_timestamp(F.lit(S.NOW))
    rows = base_scores(in_context(spark, d)).withColumns({"is_bot": F.lit(False), "canonical": F.lit(True)})
    return C.ranked(rows, S.posts(spark, d), now)


def category_sql(terms: str, text: str) -> str:
    def hits(c):
        own = R.CATEGORY_TERMS.get(c, [])
        parts = [f"len(list_intersect({terms}, [{', '.join(chr(39) + t + chr(39) for t in own)}]))"] if own else ["0"]
        return " + ".join(parts + [f"CAST(contains({text}, '{p}') AS INTEGER)" for p in R.CATEGORY_PHRASES.get(c, [])])

    rows = ", ".join(f"{{'hits': {hits(c)}, 'prio': {-k}, 'category': '{c}'}}" for k, c in enumerate(DEFAULT.categories))
    return f"list_max([{rows}])"


CATEGORY = f"k AS (SELECT id, {category_sql(f'list_distinct({TERM_LIST})', NORM)} AS best FROM posts)"


@query("categorize_keyword", f"{P}, {CATEGORY} SELECT id, CASE WHEN best.hits > 0 THEN best.category END AS category FROM k")
def categorize_keyword(spark, d):
    t = S.posts(spark, d).select("id", X.normalise(F.col("text")).alias("t"))
    return t.select("id", R.keyword_category(R.terms_of(F.col("t")), F.col("t")).alias("category"))


@query("category", f"{P}, {CATEGORY} SELECT id, CASE WHEN best.hits > 0 THEN best.category END AS category, 'keyword_v1' AS method FROM k")
def category(spark, d):
    return categorize_keyword(spark, d).withColumn("method", F.lit("keyword_v1"))


LABELS = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in R.CATEGORY_LABELS.items()) + "}"


@query("category_trained")
def category_trained(spark, d):
    """A model of categories judged on every post it has not seen; languages stand in for categories of posts.

    Returns for each label its posts, those in which the model abstains, and its F1; tests hold the model's parts.
    """
    p = S.posts(spark, d).select("id", "text", F.col("lang").alias("label"))
    unseen = F.crc32(F.col("id").cast("string")) % 4 == 0
    model, _ = B.fit(p.filter(~unseen), steps=10)
    said = p.filter(unseen).select("id", F.col("label").alias("truth")).join(B.classify(p.filter(unseen), model), "id").withColumn("predicted", F.col("category"))
    counts = said.groupBy(F.col("truth").alias("label")).agg(F.count("*").alias("posts"), F.count_if(F.col("predicted").isNull()).alias("abstained"))
    return counts.join(macro_f1(said.select("truth", "predicted")), "label").select("label", "posts", "abstained", F.round("f1", 4).alias("f1"))


@query("category_labels", f"{P}, {CATEGORY}, c AS (SELECT CASE WHEN best.hits > 0 THEN best.category END AS category, count(*) AS n FROM k GROUP BY 1) SELECT row_number() OVER (ORDER BY label) AS place, label, n FROM (SELECT {LABELS}[category] AS label, n FROM c WHERE category IS NOT NULL)")
def category_labels(spark, d):
    """Categories by the label that readers see, in its order; at most as many rows as there are categories."""
    c = categorize_keyword(spark, d).groupBy("category").agg(F.count("*").alias("n")).filter("category IS NOT NULL")
    c = c.select(R.category_label(F.col("category")).alias("label"), "n")
    return c.withColumn("place", F.row_number().over(Window.orderBy("label")).cast("long")).select("place", "label", "n").orderBy("label")


@query("category_argmax", "SELECT event_id, CASE WHEN greatest(value / 50, 1 - value / 50) >= 0.65 THEN CASE WHEN value / 50 >= 1 - value / 50 THEN 'high' ELSE 'low' END END AS category FROM events")
def category_argmax(spark, d):
    """The larger of two probabilities, or none where neither is sure."""
    p = F.col("value") / 50
    return table(spark, d, "events").select("event_id", R.argmax_category(F.array(F.lit("high"), F.lit("low")), F.array(p, 1 - p)).alias("category"))


FLAT_WORDS = f"(CASE WHEN {NORM} = '' THEN [] ELSE string_split({NORM}, ' ') END)"
PROFILE = "list_max([" + ", ".join("{'hits': len(list_filter(w, lambda x: x IN (" + ", ".join(f"'{t}'" for t in ws) + f"))), 'prio': {-k}, 'label': '{lang}'}}" for k, (lang, ws) in enumerate(L.FUNCTION_WORDS.items())) + "])"


@query("language_profile", f"WITH w AS (SELECT doc_id, {FLAT_WORDS} AS w FROM documents), b AS (SELECT doc_id, w, {PROFILE} AS best FROM w) SELECT doc_id, CASE WHEN best.hits > 0 THEN best.label ELSE '' END AS label, round(CASE WHEN best.hits > 0 THEN best.hits / CAST(len(w) AS DOUBLE) ELSE 0.0 END, 9) AS confidence FROM b")
def language_profile(spark, d):
    p = table(spark, d, "documents").select("doc_id", L.profile(F.col("text")).alias("p"))
    return p.select("doc_id", "p.label", F.round("p.confidence", 9).alias("confidence"))


@query("entity_filter", r"SELECT doc_id, CAST(len(list_distinct(list_transform(regexp_extract_all(text, '(\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*)', 1), lambda e: left(lower(e), 100)))) AS BIGINT) AS n, left(lower(nullif(regexp_extract(text, '(\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*)', 1), '')), 100) AS first FROM documents")
def entity_filter(spark, d):
    e = table(spark, d, "documents").select("doc_id", L.entities(F.col("text")).alias("e"))
    return e.select("doc_id", F.size("e").cast("long").alias("n"), F.get("e", F.lit(0)).alias("first"))


@query("network_clusters", """SELECT home_domain, count(DISTINCT who) AS accounts, count(DISTINCT row(who, v)) AS posts, min(s) AS earliest, max(s) AS latest
FROM (SELECT event_type AS home_domain, user_id AS who, value AS v, epoch_us(ts) // 1000000 AS s FROM events) GROUP BY 1 HAVING count(DISTINCT who) >= 5 AND max(s) - min(s) <= 86400 * 60 AND count(DISTINCT row(who, v)) >= 50""")
def network_clusters(spark, d):
    from ..operators.network import clusters

    e = events(spark, d).select(F.col("event_type").alias("home_domain"), F.col("user_id").alias("identity"), F.struct("user_id", "value").alias("post"), F.col("user_id").cast("string").alias("author_id"), "s")
    return clusters(e, 5, 60, 50).select("home_domain", F.col("account_count").alias("accounts"), F.col("post_count").alias("posts"), "earliest", "latest")


@query("vocab_build", f"SELECT token, count(*) AS n FROM (SELECT unnest({TOKEN_LIST}) AS token FROM documents) GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, token LIMIT 19998")
def vocab_build(spark, d):
    t = table(spark, d, "documents").select(F.explode(X.tokens(F.col("text"))).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n")).filter("n >= 2").orderBy(F.desc("n"), "token").limit(19998)


@query("length_percentiles", f"SELECT q AS share, round(quantile_cont(n, q), 6) AS length FROM (SELECT CAST(len({TOKEN_LIST}) AS DOUBLE) AS n FROM documents), (VALUES (0.5), (0.9), (0.95), (0.99)) t(q) GROUP BY q".replace("quantile_cont(n, q)", "CASE q WHEN 0.5 THEN quantile_cont(n, 0.5) WHEN 0.9 THEN quantile_cont(n, 0.9) WHEN 0.95 THEN quantile_cont(n, 0.95) ELSE quantile_cont(n, 0.99) END").replace("q AS share", "CAST(q AS DOUBLE) AS share"))
def length_percentiles(spark, d):
    n = table(spark, d, "documents").select(F.size(X.tokens(F.col("text"))).cast("double").alias("n"))
    qs = [0.5, 0.9, 0.95, 0.99]
    p = n.agg(F.percentile("n", F.array(*map(F.lit, qs))).alias("p"))
    return p.select(F.explode(F.arrays_zip(F.array(*map(F.lit, qs)).alias("share"), F.col("p").alias("length"))).alias("x")).select("x.share", F.round("x.length", 6).alias("length"))


@query("class_balance", "SELECT doc_id, quality, (SELECT count(*) FROM labels) / (2.0 * count(*) OVER (PARTITION BY quality)) AS weight FROM labels QUALIFY row_number() OVER (PARTITION BY quality ORDER BY doc_id) <= 100")
def class_balance(spark, d):
    t = table(spark, d, "labels")
    k = t.groupBy("quality").agg(F.count("*").alias("n"))
    total = t.count()
    ranked = t.withColumn("r", F.row_number().over(Window.partitionBy("quality").orderBy("doc_id"))).filter("r <= 100")
    return ranked.join(k, "quality").select("doc_id", "quality", (F.lit(total) / (2.0 * F.col("n"))).alias("weight"))


@query("label_remap", "SELECT doc_id, toxic = 1 OR quality = 0 AS bad, toxic = 0 AND quality = 1 AS good FROM labels")
def label_remap(spark, d):
    hot = F.array(F.col("toxic") == 1, F.col("quality") == 0)
    return table(spark, d, "labels").select("doc_id", F.exists(hot, lambda x: x).alias("bad"), (~F.exists(hot, lambda x: x)).alias("good"))


@query("train_harmonize", "SELECT d.doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS label FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE NOT (toxic = 1 AND quality = 0)")
def train_harmonize(spark, d):
    names = F.create_map(F.lit(1), F.lit("good"), F.lit(0), F.lit("poor"))
    both = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id").filter(~((F.col("toxic") == 1) & (F.col("quality") == 0)))
    return both.select("doc_id", F.element_at(names, F.col("quality")).alias("label"))


@query("eval_confusion", "SELECT event_type AS truth, CASE WHEN value > 20 THEN 'click' ELSE 'view' END AS predicted, count(*) AS n FROM events GROUP BY 1, 2")
def eval_confusion(spark, d):
    from ..operators.evaluate import confusion

    return confusion(table(spark, d, "events").select(F.col("event_type").alias("truth"), F.when(F.col("value") > 20, "click").otherwise("view").alias("predicted")))


@query("eval_macro_f1", """WITH e AS (SELECT event_type AS truth, CASE WHEN value > 20 THEN 'click' ELSE 'view' END AS predicted FROM events),
t AS (SELECT truth AS label, count(*) AS n, count(*) FILTER (WHERE truth = predicted) AS hits FROM e GROUP BY 1), p AS (SELECT predicted AS label, count(*) AS n FROM e GROUP BY 1)
SELECT round(avg(2.0 * hits / (t.n + coalesce(p.n, 0))), 9) AS macro_f1 FROM t LEFT JOIN p USING (label)""")
def eval_macro_f1(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("truth"), F.when(F.col("value") > 20, "click").otherwise("view").alias("predicted"))
    return macro_f1(rows).agg(F.round(F.avg("f1"), 9).alias("macro_f1"))


@query("eval_threshold_sweep", """WITH t AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6]) AS threshold),
c AS (SELECT threshold, count(*) FILTER (WHERE value / 100 >= threshold AND event_type = 'click') AS tp, count(*) FILTER (WHERE value / 100 >= threshold AND event_type <> 'click') AS fp, count(*) FILTER (WHERE value / 100 < threshold AND event_type = 'click') AS fn FROM events, t GROUP BY 1)
SELECT CAST(threshold AS DOUBLE) AS threshold, tp, fp, fn, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 9) AS f1 FROM c""")
def eval_threshold_sweep(spark, d):
    from ..operators.evaluate import sweep

    return sweep(table(spark, d, "events").select((F.col("event_type") == "click").alias("truth"), (F.col("value") / 100).alias("score")), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6])


@query("sampled_estimate")
def sampled_estimate(spark, d):
    t = table(spark, d, "documents")
    return t.agg(F.count("*").alias("n"), F.avg(F.when(F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0, F.length("text"))).alias("mean")).select((F.col("n") * F.col("mean")).alias("estimate"))


@query("topicality", f"{P}, {BASE}, {BURST} SELECT id, round({TOPIC}, 6) AS topicality FROM base LEFT JOIN burst USING (id)")
def topicality(spark, d):
    return C.topicalities(S.posts(spark, d)).select("id", F.round("topicality", 6).alias("topicality"))
