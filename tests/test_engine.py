"""Behaviour of single functions and operators on hand-written rows."""

import json
import math

import pytest
from feedloom.config import Config, number
from feedloom.functions import text as X
from feedloom.functions import urls as U
from feedloom.operators import cycle, dedup, feed, moderation, network, posts_json, scoring, windows
from pyspark.sql import functions as F


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(("raw", "said"), [
    ("<p>one</p><p>two &amp;amp; &lt;b&gt;</p>", "one two &amp; <b>"),
    ('see <a href="https://e.org/long/path" class="x">e.org/lo…</a>!', "see https://e.org/long/path!"),
    ("a<br/>b &#8211; &#x41; &unknown; &#xZZ;", "a b – A &unknown; &#xZZ;"),
    ('<a href="x">#<span>tag</span></a>', "#tag"),
    ("&#128512;", "😀"),
])
def test_html(spark, raw, said):
    assert one(spark, raw, X.html_to_text) == said


@pytest.mark.parametrize(("url", "canonical"), [
    ("HTTPS://E.org/A/?utm=1#x", "https://e.org/A"), ("https://e.org/", None), ("https://e.org?q=1", None), ("no url", None), (None, None),
])
def test_canonical_urls(spark, url, canonical):
    assert one(spark, url, U.canonical) == canonical


def test_lexical_signals(spark):
    assert one(spark, "www.a.b www.c.d www.e.f www.g.h and four more words", X.url_density) == 0.5
    assert one(spark, "#a #b #c word", X.hashtag_density) == 0.75
    assert one(spark, "ONE TWO THREE FOUR five AI OK", X.caps_ratio) == 0.8
    assert one(spark, "", X.caps_ratio) == 0.0
    assert one(spark, "a b c d e f", X.template_skeleton) == "a|b|c||e|f"
    assert one(spark, "a b c", X.template_skeleton) == "a|b|c||"


def test_tokens(spark):
    assert one(spark, "Hi @Bob #Blessed 30 yrs :) <3 https://x.y!! don't", X.tokens) == ["hi", "<user>", "blessed", "<num>", "yrs", ":)", "<3", "<url>", "don't"]


def test_shingles(spark):
    assert one(spark, "a b c d e", lambda c: X.shingles(c, 4)) == ["a b c d", "b c d e"]
    assert one(spark, "a b", lambda c: X.shingles(c, 4)) == ["a b"]
    assert one(spark, "  ", lambda c: X.shingles(c, 4)) == []


def test_domains_and_words(spark):
    hit = lambda u: one(spark, u, lambda c: moderation.on_domain(c, ["shop.example"]))
    assert [hit(u) for u in ("https://shop.example/x", "https://www.shop.example", "https://myshop.example/", "https://shop.example")] == [True, True, False, True]
    word = lambda t: one(spark, t, lambda c: moderation.has_word(c, ["rude"]))
    assert [word(t) for t in ("so RUDE!", "rudely", "", None)] == [True, False, False, False]


def test_meta_image(spark):
    tw, og = '<meta name="twitter:image" content="t">', "<meta content='o?a=1&amp;b=2' property='og:image'>"
    assert one(spark, tw + og, X.meta_image) == "o?a=1&b=2"
    assert one(spark, tw, X.meta_image) == "t"
    assert one(spark, "<p>", X.meta_image) is None


def test_facets():
    facets = [{"index": {"byteStart": 3, "byteEnd": 9}, "features": [{"$type": "app.bsky.richtext.facet#link", "uri": "https://e.org/x"}]}, {"index": "odd"}]
    facets[0]["index"] = {"byteStart": 3, "byteEnd": 10}
    assert X.spliced_links("é e.or… z", facets) == "é https://e.org/x z"
    assert X.spliced_links("plain", None) == "plain" and X.spliced_links(None, facets) is None


def bluesky(embed, **record):
    return json.dumps({"commit": {"record": {"embed": embed, **record}}})


def test_attachments(spark):
    link = {"$type": "app.bsky.embed.external", "external": {"uri": "https://e.org/a", "title": "", "description": "d"}}
    quote = {"$type": "app.bsky.embed.recordWithMedia", "record": {"record": {"uri": "at://did:q/app.bsky.feed.post/9"}}, "media": {"$type": "app.bsky.embed.images", "images": [{"alt": "", "image": {"ref": {"$link": "c1"}}}, {"image": {}}]}}
    media = json.dumps({"media_attachments": [{"type": "gifv", "url": "https://m/v"}, {"type": "image", "url": "ftp://m/i"}, {"type": "image", "url": "https://m/i"}], "card": {"url": "https://c/x", "image": None}, "sensitive": True})
    rows = [("bluesky", "did:a", bluesky(link)), ("bluesky", "did:a", bluesky(quote, labels={"values": [{"val": "x"}]})), ("mastodon", "i/a", media), ("bluesky", "did:a", '{"commit":null}'), ("mastodon", "i/a", None), ("bluesky", "did:a", bluesky([]))]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, source string, author string, raw string")
    a = posts_json.attachments(F.col("source"), F.col("author"), F.col("raw"), F.lit("https://g/t"))
    got = {r["k"]: r for r in df.select("k", a.alias("a"), posts_json.sensitive(F.col("raw")).alias("s")).collect()}
    assert [(x["kind"], x["title"], x["thumbnailUrl"]) for x in got[0]["a"]] == [("link", None, "https://g/t")]
    assert [(x["kind"], x["url"] or x["fullUrl"]) for x in got[1]["a"]] == [("image", "https://cdn.bsky.app/img/feed_fullsize/plain/did:a/c1@jpeg"), ("quote", "https://bsky.app/profile/did:q/post/9")]
    assert [(x["kind"], x["isGif"], x["thumbnailUrl"]) for x in got[2]["a"]] == [("video", True, None), ("image", None, "https://m/i"), ("link", None, "https://g/t")]
    assert [got[k]["a"] for k in (3, 4, 5)] == [[], [], []]
    assert [got[k]["s"] for k in range(6)] == [False, True, True, False, False, False]


def test_quotes_and_links(spark):
    view = json.dumps({"author": {"handle": "h"}, "record": {"text": "t"}, "likeCount": 9999})
    q = lambda v: one(spark, v, lambda c: posts_json.quote_view(c, F.lit(False)))
    assert (q(view)["status"], q(view)["author"]["handle"]) == ("available", "h")
    assert q("{}")["reason"] == "not_found"
    assert q(json.dumps({"author": {}, "record": {"text": "t"}, "labels": [{"val": "porn"}]}))["reason"] == "filtered"
    need = lambda s, v: one(spark, v, lambda c: posts_json.link_without_thumbnail(F.lit(s), c, F.lit("see https://t.x/1")))
    assert need("mastodon", '{"card":{"url":"https://c/x","image":"i"}}') is None
    assert need("mastodon", '{"card":null}') == "https://t.x/1"
    assert need("bluesky", bluesky({"$type": "app.bsky.embed.external", "external": {"uri": "u"}})) == "u"


def test_context(spark):
    reply = lambda did: json.dumps({"commit": {"record": {"reply": {"parent": {"uri": f"at://{did}/app.bsky.feed.post/1"}}}}})
    act = lambda s, raw, t="x": one(spark, raw, lambda c: moderation.context(F.lit(s), F.lit("did:me"), c, F.lit(t)))["action"]
    assert [act("bluesky", reply("did:me")), act("bluesky", reply("did:you")), act("other", reply("did:you"))] == ["none", "devalue", "none"]
    assert act("mastodon", '{"content":"<p class=quote-inline>"}') == act("mastodon", "{}", "RE: https://bsky.app/profile/a/post/b") == "exclude"


def test_bots(spark):
    posts = [("a", i, float(i)) for i in range(21)] + [("b", 100, 0.0), ("b", 101, 4000.0)]
    df = spark.createDataFrame(posts, "author string, id long, s double")
    n = {r["id"]: r["n"] for r in windows.anchored_count(df, ["author"], "s", ["id"], 3600, "n").collect()}
    assert n[20] == 21 and n[100] == n[101] == 1
    seen = windows.seen_before(df.withColumn("cluster", F.lit(1)), ["cluster"], "author", "s", ["id"], 86400, "seen")
    assert {r["id"] for r in seen.filter("NOT seen").collect()} == {0, 100}


def test_pending_exclusions(spark):
    labels = spark.createDataFrame([("k", 0.0), ("x", 0.0)], "key string, t double")
    posts = spark.createDataFrame([("k", 10.0, 1), ("k", 11.0, 2), ("x", 31.0, 3), ("y", 5.0, 4)], "key string, t double, post long")
    assert {r["post"] for r in windows.pending_exclusions(posts, labels, 30).collect()} == {2, 3, 4}


def test_clusters_follow_the_first_predecessor(spark):
    ids = spark.range(6)
    matches = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (4, 5)], "a long, b long")
    got = {r["id"]: (r["cluster"], r["canonical"]) for r in dedup.clusters(ids, matches).collect()}
    assert got == {0: (0, True), 1: (0, False), 2: (0, False), 3: (0, False), 4: (4, True), 5: (4, False)}


def test_minhash_and_bands(spark):
    base = " ".join(f"w{i}" for i in range(60))
    posts = spark.createDataFrame([(1, base), (2, base + "!!"), (3, " ".join(f"v{i}" for i in range(60)))], "id long, text string")
    got = {r["id"]: r["cluster"] for r in dedup.dedup_posts(posts).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def greedy(base, sim, lam):
    """Marginal relevance by looking at every pair at every step."""
    free, out = sorted(base), []
    while free:
        value = {i: lam * base[i] - (1 - lam) * max((sim(i, j) for j, _ in out), default=0.0) for i in free}
        best = max(free, key=lambda i: (value[i], -i))
        out.append((best, value[best]))
        free.remove(best)
    return out


def test_mmr_equals_brute_force(spark):
    import random

    rng = random.Random(1)
    w = [(i, f"t{t}", rng.random()) for i in range(40) for t in rng.sample(range(30), 6)]
    e = [(i, f"e{x}") for i in range(0, 40, 2) for x in rng.sample(range(6), 2)]
    base = {i: rng.random() for i in range(42)}
    terms, tags = {}, {}
    for i, t, x in w:
        terms.setdefault(i, {})[t] = x
    for i, x in e:
        tags.setdefault(i, set()).add(x)

    def sim(i, j):
        a, b = terms.get(i, {}), terms.get(j, {})
        norm = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())) or 1
        cos = sum(x * b[t] for t, x in a.items() if t in b) / norm
        p, q = tags.get(i, set()), tags.get(j, set())
        return 0.5 * cos + 0.5 * (len(p & q) / len(p | q) if p | q else 0.0)

    got = scoring.mmr_terms(spark.createDataFrame(list(base.items()), "id long, base double"), spark.createDataFrame(w, "id long, term string, weight double"), spark.createDataFrame(e, "id long, entity string")).orderBy("position").collect()
    want = greedy(base, sim, 0.7)
    assert [r["id"] for r in got] == [i for i, _ in want]
    assert [r["rank_score"] for r in got] == pytest.approx([v for _, v in want])
    assert all(a["rank_score"] >= b["rank_score"] - 1e-12 for a, b in zip(got, got[1:], strict=False))


def test_positivity_and_argmax(spark):
    assert [one(spark, str(x), lambda c: scoring.positivity(c.cast("double"))) for x in (-0.4, 0.0, 0.7)] == [0.0, 0.0, 0.7]
    names = F.array(F.lit("a"), F.lit("b"))
    pick = lambda x, y: one(spark, "", lambda c: scoring.argmax_category(names, F.array(F.lit(x), F.lit(y)), 0.6))
    assert [pick(0.7, 0.3), pick(0.2, 0.8), pick(0.7, 0.7), pick(0.5, 0.5)] == ["a", "b", "a", None]


def test_signature_codec(spark):
    posts = spark.createDataFrame([(1, "some words in a row here"), (2, " ")], "id long, text string")
    s = dedup.signatures(posts, 4, 16)
    raw = s.select("id", "signature", dedup.serialised(F.col("signature")).alias("raw"))
    back = raw.select("signature", dedup.deserialised(F.col("raw"), 16).alias("same"), dedup.deserialised(F.col("raw"), 8).alias("stale"), dedup.deserialised(F.substring("raw", 1, 20), 16).alias("cut")).collect()
    assert len(back) == 1 and back[0]["same"] == back[0]["signature"] and back[0]["stale"] is None and back[0]["cut"] is None


def test_members_of_a_bucket_link_without_its_first(spark):
    """Posts 2 and 3 are alike; post 1 shares a bucket with both and is like neither."""
    bands = spark.createDataFrame([(i, 0, "h") for i in (1, 2, 3)], "id long, band int, hash string")
    assert sorted(map(tuple, dedup.candidates(bands).collect())) == [(1, 2), (1, 3), (2, 3)]


def test_copies_make_one_link_each(spark, monkeypatch):
    """Thousands of copies, by sets and by URL: as many links as posts at most, and clusters as from all pairs."""
    words = lambda k, n=30: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(i, words(0)) for i in range(5, 3000)] + [(1, words(0) + " tail"), (3000, words(0) + " other"), (4000, words(1)), (2, words(2)), (5000, words(2) + " end"), (6000, " ")]
    posts = spark.createDataFrame(rows, "id long, text string")
    links = dedup.exact_links(dedup.shingle_sets(posts, 4), 0.7)
    assert links.count() == len({r["b"] for r in links.collect()}) <= len(rows)
    got = {r["id"]: r["cluster"] for r in dedup.clusters(posts, links).collect()}
    assert got == {i: 1 if i == 1 or 5 <= i <= 3000 else 2 if i in (2, 5000) else i for i, _ in rows}
    # one URL: copies, and texts that are half alike
    half = [(10_000 + k, words(0, 18) + " " + words(100 + k, 12)) for k in range(30)] + [(20_000 + k, words(200 + k)) for k in range(10)]
    every = spark.createDataFrame(rows[:-1] + half, "id long, text string")
    urls = every.select("id", F.when(F.col("id") < 20_005, "http://x/y").alias("url"))
    signed = {r["id"]: r["signature"] for r in dedup.signatures(every).collect()}
    want = {}
    for b in sorted(signed):
        near = [a for a in sorted(signed) if a < b and (e := sum(x == y for x, y in zip(signed[a], signed[b], strict=True)) / 128) >= (0.2 if b < 20_005 else 0.7)][:1] if not 5 < b < 3000 else [want_first]
        want[b] = near[0] if near else None
        want_first = next(a for a in sorted(signed) if sum(x == y for x, y in zip(signed[a], signed[5], strict=True)) / 128 >= 0.2)
    for hot in (200, 3):
        monkeypatch.setattr(dedup, "HOT_URL", hot)
        out = dedup.dedup_posts(every, urls)
        got = {r["id"]: r["cluster"] for r in out.collect()}
        root = {}
        for b in sorted(want):
            root[b] = b if want[b] is None else root[want[b]]
        assert got == root


def test_clusters_that_do_not_settle_are_no_result(spark):
    ids = spark.range(1, 40)
    with pytest.raises(RuntimeError, match="settled"):
        dedup.clusters(ids, spark.createDataFrame([(i, i + 1) for i in range(1, 39)], "a long, b long"), most_rounds=2)
    got = {r["cluster"] for r in dedup.clusters(ids, spark.createDataFrame([(i, i + 1) for i in range(1, 39)], "a long, b long")).collect()}
    assert got == {1}


def test_cycle_excludes_scores_and_ranks(spark):
    now = 1_000_000
    text = {1: "what a great linux browser", 2: "what a great linux browser", 3: "sad awful trash", 4: "happy love for museum music", 5: "great fun", 6: "nice win for Berlin Zoo"}
    rows = [(i, "mastodon", f"u{i}", t, "en", '{"in_reply_to_id":"7"}' if i == 5 else "{}", now - i * 60) for i, t in text.items()]
    posts = spark.createDataFrame(rows, "id long, source string, author_id string, text string, lang string, raw_json string, created_s long")
    blocked = spark.createDataFrame([("mastodon", "u6")], "source string, author_id string")
    got = cycle.scored(posts, blocked, [], [], F.lit("en"), F.lit(0.9), F.lit(now))
    by = {r["id"]: r for r in got.collect()}
    assert sorted(by) == [1, 2, 3, 4]
    assert by[2]["cluster"] == 1 and not by[2]["canonical"] and by[1]["canonical"]
    assert by[3]["base_score"] == 0 and by[4]["category"] == "arts_culture" and by[1]["category"] == "science_technology"
    assert by[1]["base_score"] == pytest.approx(max(0, by[1]["sentiment"]) * by[1]["topicality"] * 0.5 ** (60 / 3600 / 12))
    ranked = cycle.ranked(got, posts, F.lit(now)).orderBy("position").collect()
    assert {r["id"] for r in ranked} == {1, 4}  # the copy and the sad post are not eligible
    assert cycle.ranked(got, posts, F.lit(now + 80 * 3600)).count() == 0
    assert tuple(cycle.counts(posts, got).first()) == (6, 4, 2)


def test_self_duplicates_and_velocity_make_a_bot(spark):
    posts = spark.createDataFrame([(i, "a", 1000 + i, "buy this thing now please") for i in range(20)] + [(50, "b", 1000, "hello there")], "id long, author_id string, created_s long, text string")
    groups = posts.select("id", F.when(F.col("id") < 20, 0).otherwise(50).cast("long").alias("cluster"))
    by = {r["id"]: r for r in cycle.bot_scores(posts, groups).collect()}
    assert not by[0]["is_bot"] and by[19]["is_bot"] and not by[50]["is_bot"]
    assert by[19]["bot_score"] == pytest.approx(0.30 + 0.25 + 0.25)


def test_scores(spark):
    d = lambda h: one(spark, str(h), lambda c: scoring.recency_decay(c.cast("double")))
    assert (d(12), d(535 * 24), d(-5)) == (0.5, 0.0, 1.0)
    base = lambda p: one(spark, "1", lambda c: scoring.base_score(c.cast("double"), F.lit(2.0), F.lit(0.0), F.lit(p)))
    assert base(0.4) == pytest.approx(0.4 * base(1.0))


def test_networks(spark):
    rows = [("mastodon", f"i{j}/u{k}@bad.host", f"t{n}", n, 1000 * k) for j in range(2) for k in range(5) for n in range(10)] + [("mastodon", "i/u@ok.host", "t", 1, 5)]
    df = spark.createDataFrame(rows, "source string, author_id string, text string, created_at long, c long").withColumn("mastodon_account_created_at", F.timestamp_seconds("c"))
    got = network.clusters(network.accounts(df)).collect()
    assert [(r["home_domain"], r["account_count"], r["post_count"], len(r["author_ids"])) for r in got] == [("bad.host", 5, 50, 10)]


def test_feed_response_pages_through_all_posts(spark):
    link = json.dumps({"commit": {"record": {"embed": {"$type": "app.bsky.embed.external", "external": {"uri": "https://e.org/a", "title": "t"}}, "labels": {"values": [{"val": "x"}]}}}})
    rows = [(i, "bluesky", f"did:a/{i}", "did:a", f"post {i}", "2026", link if i == 3 else "{}", None, ["Berlin"] if i == 3 else None, None, "http://x/y", 0.5, 1.0, 0.25, None if i == 9 else float(i % 4), "v1", "food_dining" if i % 2 else None) for i in range(10)]
    feed_ = spark.createDataFrame(rows, "id long, source string, source_id string, author_id string, text string, created_at string, raw_json string, thumbnail string, entities array<string>, display_name string, avatar_url string, sentiment double, topicality double, base_score double, rank_score double, pipeline_version string, category string")
    at = lambda **k: json.loads(feed.response(feed_, **k).first()["body"])
    seen, cursor = [], None
    while True:
        got = at(limit=4, cursor=cursor)
        seen += [p["id"] for p in got["posts"]]
        cursor = got["next_cursor"]
        if cursor is None:
            break
        assert feed.decode_cursor(cursor) == (float(seen[-1] % 4), seen[-1])
    assert seen == [7, 3, 6, 2, 5, 1, 8, 4, 0]
    post = at(limit=2)["posts"][1]
    assert post["attachments"][0]["url"] == "https://e.org/a" and post["sensitive"] and post["entities"] == ["Berlin"] and post["permalink"] == "https://bsky.app/profile/did:a/post/3"
    assert post["author"] == {"display_name": None, "avatar_url": "http://x/y"} and post["scores"] == {"sentiment": 0.5, "topicality": 1.0, "base": 0.25, "rank": 3.0}
    assert [p["id"] for p in at(category="food_dining")["posts"]] == [7, 3, 5, 1]
    assert at(category="arts_culture") == {"posts": [], "next_cursor": None}
    for bad in ({"limit": 0}, {"category": "none"}, {"cursor": "!"}):
        with pytest.raises(ValueError):
            feed.response(feed_, **bad)


def test_cursors_and_settings():
    assert feed.decode_cursor(feed.encode_cursor(1.5, "x")) == (1.5, "x")
    for bad in ("", "!!", feed.encode_cursor("a", 1), "e30"):
        with pytest.raises(ValueError, match="cursor"):
            feed.decode_cursor(bad)
    assert feed.checked(None, None) == (20, None)
    for args in ((0, None), (101, None), (5, "sports")):
        with pytest.raises(ValueError):
            feed.checked(*args)
    assert [number(v, 3.0) for v in (None, " ", "x", "nan", "4")] == [3.0, 3.0, 3.0, 3.0, 4.0]
    with pytest.raises(ValueError, match="remembered"):
        Config(dedup_ttl_s=60)
    assert [U.is_public_address(h) for h in ("8.8.8.8", "10.0.0.1", "127.0.0.1", "[::1]", "e.org")] == [True, False, False, False, False]
