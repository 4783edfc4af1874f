"""Scores of posts: topicality, sentiment, category, automation, base score; and the order by marginal relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..config import DEFAULT, Config
from ..functions import text as X
from ..sources.shared import written
from .batches import in_pieces

#: Terms by category, and phrases; priority breaks ties.
CATEGORY_TERMS = {
    "science_technology": "opensource open-source github linux developer software startup browser kernel python javascript framework repository app ai llm openai anthropic chatgpt scientist scientists researcher researchers nasa telescope astronomy astronomer biology physics chemistry observatory discovery".split(),
    "arts_culture": "museum concert exhibit exhibition gallery theatre theater festival artist album novel painting sculpture orchestra poetry film cinema music song musician movie soundtrack".split(),
    "food_dining": "recipe restaurant chef cuisine bakery brewery culinary cookbook".split(),
    "diaries_daily_life": [],
}
CATEGORY_PHRASES = {"food_dining": ["farmers market", "food truck"], "diaries_daily_life": ["good morning", "happy friday", "my day"]}

#: What a reader sees for a category.
CATEGORY_LABELS = {"arts_culture": "Arts & Culture", "diaries_daily_life": "Diaries & Daily Life", "food_dining": "Food & Dining", "science_technology": "Science & Technology"}

#: A small lexicon of sentiment, for the fallback without a model.
POSITIVE = "good great love happy best nice excellent amazing wonderful fun beautiful thanks glad enjoy win".split()
NEGATIVE = "bad worst hate sad awful terrible horrible angry stupid idiot worthless pathetic disgusting moron trash".split()


def terms_of(normalised: Column) -> Column:
    """Distinct terms of a normalised text."""
    found = F.regexp_extract_all(normalised, F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: ~t.isin(X.STOP_WORDS)))


#: Words that a worker counts at once.
WORDS_AT_ONCE = 1 << 18


def _counted(batches):
    """(id, term, tf) of batches (id, words): words counted within the row, so that no word is shuffled."""
    import numpy as np
    import pyarrow as pa

    for batch in in_pieces(batches, 1, WORDS_AT_ONCE):
        words = batch.column(1)
        coded = words.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(batch)), np.diff(words.offsets.to_numpy()))
        n = max(1, len(coded.dictionary))
        pair, tf = np.unique(row * n + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pair // n)), coded.dictionary.take(pa.array(pair % n)), pa.array(tf.astype(np.int64))], names=["id", "term", "tf"])


def term_words(text: Column) -> Column:
    """Terms of two characters or more that are no stop words, as often as they come up in the normalised text."""
    found = F.regexp_extract_all(X.normalise(text), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(X.STOP_WORDS))


def term_rows(posts: DataFrame, id_: str = "id", text: str = "text") -> DataFrame:
    """(id, term, tf) of the `term_words` of texts, written once."""
    rows = posts.select(F.col(id_).cast("long").alias("id"), term_words(F.col(text)).alias("words")).filter(F.size("words") > 0)
    return written(rows.mapInArrow(_counted, "id long, term string, tf long"), "terms")


def idf(terms: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(term, df, idf) with idf = ln((1 + n) / (1 + df)) + 1. terms: one row for each term of a text; n_docs: one row with n."""
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    n = n_docs.first()["n"]
    return df.withColumn("idf", F.log((1.0 + n) / (1.0 + F.col("df"))) + 1)


def weighted(terms: DataFrame, idfs: DataFrame, sublinear: bool = True) -> DataFrame:
    """(id, term, weight) of TF-IDF."""
    tf = 1 + F.log("tf") if sublinear else F.col("tf")
    return terms.join(idfs, "term").select("id", "term", (tf * F.col("idf")).alias("weight"))


def salience(weights: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(id, salience): mean of the top weights of a document, over its number of terms to a power."""
    w = Window.partitionBy("id").orderBy(F.desc("weight"), "term")
    top = weights.withColumn("r", F.row_number().over(w)).withColumn("nnz", F.count("*").over(Window.partitionBy("id"))).filter(F.col("r") <= cfg.top_k)
    return top.groupBy("id").agg((F.sum("weight") / F.count("*") / F.pow(F.max("nnz").cast("double"), F.lit(cfg.length_power))).alias("salience"))


def top_terms(weights: DataFrame, k: int = DEFAULT.top_k) -> DataFrame:
    w = Window.partitionBy("id").orderBy(F.desc(F.round("weight", 9)), "term")
    return weights.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).select("id", "rank", "term")


def topicality(salience_: Column, most_mentions: Column, cfg: Config = DEFAULT) -> Column:
    return salience_ * (1 + cfg.burst_boost * F.least(F.lit(1.0), most_mentions / float(cfg.burst_full)))


def keyword_category(terms: Column, normalised: Column) -> Column:
    """Category with the most hits of terms and phrases; priority breaks ties; null without a hit."""
    scored = []
    for prio, c in enumerate(DEFAULT.categories):
        own = CATEGORY_TERMS.get(c, [])
        hits = F.size(F.array_intersect(terms, F.array(*map(F.lit, own)))) if own else F.lit(0)
        for phrase in CATEGORY_PHRASES.get(c, []):
            hits = hits + normalised.contains(phrase).cast("int")
        scored.append(F.struct(hits.alias("hits"), F.lit(-prio).alias("prio"), F.lit(c).alias("category")))
    best = F.array_max(F.array(*scored))
    return F.when(best["hits"] > 0, best["category"])


def lexicon_sentiment(text: Column) -> Column:
    """x / sqrt(x^2 + 15) of the sum of word valences of a text's tokens, within -1 and 1."""
    hits = lambda found, ws: F.size(F.filter(found, lambda t: t.isin(*ws, *(f"#{w}" for w in ws))))
    x = X.let(X.raw_tokens(text), lambda found: 2.0 * hits(found, POSITIVE) - 2.0 * hits(found, NEGATIVE))
    return X.let(x, lambda v: v / F.sqrt(v * v + 15))


def positivity(sentiment: Column) -> Column:
    """What sentiment adds to a base score: nothing below zero."""
    return F.greatest(F.lit(0.0), sentiment)


def recency_decay(age_h: Column, cfg: Config = DEFAULT) -> Column:
    d = F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age_h) / cfg.half_life_h)
    return F.when(d < cfg.least_decay, F.lit(0.0)).otherwise(d)


def base_score(sentiment: Column, topicality_: Column, age_h: Column, penalty: Column, cfg: Config = DEFAULT) -> Column:
    """Positivity times topicality, decay and the penalty of the context."""
    return positivity(sentiment) * topicality_ * recency_decay(age_h, cfg) * penalty


def bot_score(velocity: Column, self_dup: Column, lexical: Column, template: Column, cfg: Config = DEFAULT) -> Column:
    a, b, c, d = cfg.weights
    return a * velocity + b * self_dup + c * lexical + d * template


def category_label(category: Column) -> Column:
    """What a reader sees for a category; null for one that is not known."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in CATEGORY_LABELS.items() for x in kv)), category)


def argmax_category(labels: Column, probabilities: Column, least: float = DEFAULT.category_threshold) -> Column:
    """The label of the largest probability, the first one at ties; null where it stays below `least`."""
    top = F.array_max(probabilities)
    return F.when(top >= least, F.element_at(labels, F.array_position(probabilities, top).cast("int")))


#: Posts of a block of `similarity`, and terms that a task multiplies at once.
SIMILARITY_BLOCK, TERMS_AT_ONCE = 256, 4096


def similarity(weights: DataFrame, block: int = SIMILARITY_BLOCK) -> DataFrame:
    """(a, b, cosine), a < b, of posts that share a term, by weights of unit length.

    Posts are dealt over blocks by hash, and blocks meet in pairs; a task multiplies two blocks, a stretch of terms at a
    time, so a frequent term costs no more than others.
    """
    norm = weights.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    blocks = max(1, -(-norm.count() // block))
    unit = weights.join(norm, "id").select("id", F.xxhash64("term").alias("t"), (F.col("weight") / F.col("norm")).alias("w"))
    met = unit.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = met.select(F.least("own", "o").alias("x"), F.greatest("own", "o").alias("y"), "own", "id", "t", "w")

    def run(key, rows):
        import numpy as np
        import pyarrow as pa

        own, t, w = rows["own"].to_numpy(), rows["t"].to_numpy(), rows["w"].to_numpy()
        ids, doc = np.unique(rows["id"].to_numpy(), return_inverse=True)
        left = np.zeros(len(ids), bool)
        left[doc[own == key[0].as_py()]] = True
        right = ~left if key[0].as_py() != key[1].as_py() else left
        _, term = np.unique(t, return_inverse=True)
        order = np.argsort(term, kind="stable")
        doc, term, w = doc[order], term[order], w[order]
        sums = np.zeros((int(left.sum()), int(right.sum())))
        for lo in range(0, int(term[-1]) + 1, TERMS_AT_ONCE):
            a, b = np.searchsorted(term, [lo, lo + TERMS_AT_ONCE])
            m = np.zeros((len(ids), TERMS_AT_ONCE))
            m[doc[a:b], term[a:b] - lo] = w[a:b]
            sums += m[left] @ m[right].T
        i, j = np.nonzero(sums)
        a, b = ids[left][i], ids[right][j]
        keep = a < b if right is left else np.ones(len(a), bool)
        return pa.table({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "cosine": sums[i, j][keep]})

    return met.groupBy("x", "y").applyInArrow(run, "a long, b long, cosine double")


def entity_jaccard(entities: DataFrame) -> DataFrame:
    """(a, b, jaccard), a < b, of entity sets. entities: (id, entity), distinct."""
    n = entities.groupBy("id").agg(F.count("*").alias("n"))
    a, b = entities.join(n, "id").alias("a"), entities.join(n, "id").alias("b")
    pairs = a.join(b, (F.col("a.entity") == F.col("b.entity")) & (F.col("a.id") < F.col("b.id")))
    common = pairs.groupBy(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb")).agg(F.count("*").alias("c"))
    return common.select("a", "b", (F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("jaccard"))


def mmr_terms(pool: DataFrame, weights: DataFrame, entities: DataFrame | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """(id, rank_score, position): greedy order by lambda base - (1 - lambda) largest similarity to what is chosen.

    pool: (id, base), cut to `cfg.pool` rows, which bounds the one group; weights: (id, term, weight); entities: (id, entity).
    Ties go to the smaller id. Similarity is `cfg.similarity_mix` of the cosine and the rest of the Jaccard similarity of entities. Only the
    chosen post is compared with the others at each step, through postings, so no matrix of pairs is ever built.
    """
    best = pool.orderBy(F.desc("base"), "id").limit(cfg.pool)
    t = weights.join(best.select("id"), "id", "left_semi").groupBy("id").agg(F.collect_list(F.struct(F.xxhash64("term").alias("t"), "weight")).alias("terms"))
    rows = best.join(t, "id", "left")
    if entities is not None:
        e = entities.join(best.select("id"), "id", "left_semi").groupBy("id").agg(F.collect_set(F.xxhash64("entity")).alias("entities"))
        rows = rows.join(e, "id", "left")
    else:
        rows = rows.withColumn("entities", F.lit(None).cast("array<bigint>"))
    rows = rows.select(F.lit(1).alias("g"), "id", "base", F.transform("terms", lambda x: x["t"]).alias("t"), F.transform("terms", lambda x: x["weight"]).alias("w"), "entities")
    lam, mix = cfg.mmr_lambda, cfg.similarity_mix

    def order(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("id", ignore_index=True)
        n = len(pdf)

        def postings(column, values=None):
            """Terms and values by document, and documents and values by term."""
            own = [np.asarray(x if x is not None else [], np.int64) for x in column]
            val = [np.asarray(x if x is not None else [], float) for x in values] if values is not None else [np.ones(len(x)) for x in own]
            size = np.array([len(x) for x in own])
            _, term = np.unique(np.concatenate(own), return_inverse=True)
            v, doc = np.concatenate(val), np.repeat(np.arange(n), size)
            by = np.argsort(term, kind="stable")
            start = np.searchsorted(term[by], np.arange(term.max(initial=-1) + 2))
            return term, v, np.concatenate([[0], np.cumsum(size)]), doc[by], v[by], start

        def against(k, p):
            term, v, at, doc, value, start = p
            mine = term[at[k] : at[k + 1]]
            count = start[mine + 1] - start[mine]
            spot = np.arange(count.sum()) + np.repeat(start[mine] - (np.cumsum(count) - count), count)
            return np.bincount(doc[spot], weights=value[spot] * np.repeat(v[at[k] : at[k + 1]], count), minlength=n)

        words_ = postings(pdf["t"], pdf["w"])
        norm = np.sqrt(np.bincount(np.repeat(np.arange(n), np.diff(words_[2])), weights=words_[1] ** 2, minlength=n))
        norm[norm == 0] = 1
        tags = postings(pdf["entities"])
        many = np.diff(tags[2])
        gain = lam * pdf["base"].to_numpy(float)
        most, free, out = np.zeros(n), np.ones(n, bool), []
        for position in range(n):
            value = np.where(free, gain - (1 - lam) * most, -np.inf)
            k = int(np.argmax(value))
            free[k] = False
            out.append((int(pdf["id"][k]), float(value[k]), position + 1))
            sim = mix * against(k, words_) / (norm * norm[k])
            if many[k]:
                common = against(k, tags)
                sim += (1 - mix) * common / (many + many[k] - common)
            most = np.maximum(most, sim)
        return pd.DataFrame(out, columns=["id", "rank_score", "position"])

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("rank_score", T.DoubleType()), T.StructField("position", T.LongType())])
    return rows.groupBy("g").applyInPandas(order, schema)


def onnx_sentiment(posts: DataFrame, model: bytes, vocabulary: dict[str, int], length: int = 50) -> DataFrame:
    """(id, sentiment): P(positive) - P(negative) of a network over token ids, one session per Python worker."""
    shared = posts.sparkSession.sparkContext.broadcast((model, vocabulary))
    rows = posts.select("id", X.tokens(F.col("text")).alias("tokens"))

    def run(batches):
        import numpy as np
        import onnxruntime as ort
        import pandas as pd

        body, vocab = shared.value
        session = ort.InferenceSession(body)
        unknown = vocab.get("<unk>", 1)
        for pdf in batches:
            ids = np.zeros((len(pdf), length), np.int64)
            for k, t in enumerate(pdf["tokens"]):
                got = [vocab.get(x, unknown) for x in t[:length]]
                ids[k, : len(got)] = got
            probs = session.run(None, {session.get_inputs()[0].name: ids})[0]
            yield pd.DataFrame({"id": pdf["id"], "sentiment": (probs[:, 2] - probs[:, 0]).astype(float)})

    return rows.mapInPandas(run, "id long, sentiment double")
