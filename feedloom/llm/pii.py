"""Personal data: patterns, and information-theoretic sanitisation around what they find. DataFrame functions only.

Every value that a pattern finds is a protected entity c. A term t that is in several texts with c tells of it by its
pointwise mutual information, PMI(c; t) = log2(N n(c,t) / (n(c) n(t))), over texts of the corpus; what c itself holds is
IC(c) = log2(N / n(c)). A term whose PMI exceeds a share of IC would give the entity away where the value is masked, so
it is generalised, and from a higher share removed, wherever it stands in the text (the C-sanitized model of Sánchez
and Batet, 2016).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored

#: The kinds in order. Possessive loops walk long runs without recursion; a run of characters that may begin a match
#: is entered at its front or where the last match ended, which finds the same matches in linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
#: Texts in which a term must stand with the same entity.
LEAST_TEXTS = 3
#: Shares of the entity's information from which a term is generalised, and removed.
GENERALISE, REMOVE = 0.75, 0.9
#: Candidate terms up to which they are broadcast to the count of texts with them; beyond, counts are joined.
BROADCAST_TERMS = 100_000
#: One in so many texts, by hash, is counted before all are, which rules frequent terms out where they are few.
PARTS = (64, 16, 4)
#: Matches folded into one list at a time.
FOLD = 500
_WORD = r"\p{L}[\p{L}\p{M}]{2,}+"


def _located(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of leftmost matches: gaps and matches alternate, so lengths add up to places."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("value")))
    empty = F.expr("CAST(array() AS array<struct<start:int,end:int,value:string>>)")

    def one(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    def block(acc, part):
        inner = F.aggregate(part, F.struct(acc["at"].alias("at"), empty.alias("out")), one)
        return F.struct(inner["at"].alias("at"), F.concat(acc["out"], inner["out"]).alias("out"))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / FOLD).cast("int")), lambda b: F.slice(pairs, b * FOLD + 1, F.lit(FOLD)))
    folded = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), empty.alias("out")), block)["out"]
    return F.when(F.size(found) > 0, folded).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(acc, i):
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        d = _digits(value)
        return F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end, entity) that the patterns find, by kind as listed and then by start."""
    return F.concat(*(_spans_of(text, kind) for kind in KINDS))


def _spans_of(text: Column, kind: str) -> Column:
    empty = F.expr("CAST(array() AS array<struct<kind:string,start:int,end:int,entity:string>>)")
    may = text.contains("@") if kind == "email" else text.contains("+") if kind == "phone" else text.rlike(r"[0-9][.\x20-]?[0-9]")
    found = F.filter(_located(text, PATTERNS[kind]), lambda x: _valid(kind, x["value"]))
    value = F.lower if kind == "email" else _digits if kind in ("card", "phone") else (lambda v: v)
    spans = F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.concat(F.lit(kind + ":"), value(x["value"])).alias("entity")))
    return F.when(may, spans).otherwise(empty)


def _terms(text: Column) -> Column:
    """Array of the distinct words of a text between what is no letter or mark, in lower case."""
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{M}]+", -1))


def _telling(base: DataFrame, given: DataFrame, least_texts: int, generalise: float) -> DataFrame:
    """(entity, term, share): terms that tell an entity, with PMI over IC; counts are of distinct texts, over all."""
    total = float(given.select(F.md5("text")).distinct().count())
    of_text = base.filter("hash IS NOT NULL").select("hash", F.explode(F.array_distinct(F.transform("base", lambda s: s["entity"]))).alias("entity")).distinct()
    # an entity of fewer texts has no term in `least_texts` of them
    known = of_text.groupBy("entity").agg(F.count("*").alias("n_entity")).filter(F.col("n_entity") >= least_texts)
    known = stored(of_text.join(known, "entity"), "known")
    texts = base.filter("hash IS NOT NULL").select("hash", "text").join(known.select("hash").distinct(), "hash", "left_semi").dropDuplicates(["hash"])
    with_terms = stored(texts.select("hash", _terms(F.col("text")).alias("terms")), "terms")
    spread = with_terms.select("hash", F.explode("terms").alias("term")).filter(F.length("term") >= 3)
    near_term = spread.groupBy("term").agg(F.count("*").alias("n_near")).filter(F.col("n_near") >= least_texts)
    both = with_terms.join(known, "hash").select("entity", "n_entity", F.explode("terms").alias("term"))
    pairs = both.groupBy("entity", "term").agg(F.count("*").alias("n_both"), F.first("n_entity").alias("n_entity")).filter((F.col("n_both") >= least_texts) & (F.length("term") >= 3))
    # a share of `generalise` allows so many texts with the term; more than that with entities alone rule it out
    most = F.col("n_both") / F.col("n_entity") * total * F.pow(F.col("n_entity") / total, F.lit(generalise)) * (1 + 1e-9)
    pairs = stored(pairs.join(near_term, "term").filter(F.col("n_near") <= most).select("entity", "term", "n_both", "n_entity", most.alias("most")), "pairs")
    rare = _numbered(pairs.groupBy("term").agg(F.max("most").alias("most")))
    for part in PARTS:  # with more than `most` distinct texts in a part of all hashes, a term has more than that in all
        there = _texts_with(given.filter(F.pmod(F.xxhash64("text"), F.lit(part)) == 0), rare)
        fewer = _numbered(rare.join(there, "number", "left").filter(F.coalesce("n_term", F.lit(0)) <= F.col("most")).select("term", "most"))
        dropped(rare)
        rare = fewer
    with_term = rare.join(_texts_with(given, rare), "number").select("term", "n_term")
    share = F.log2(F.lit(total) * F.col("n_both") / (F.col("n_entity") * F.col("n_term"))) / F.log2(F.lit(total) / F.col("n_entity"))
    found = pairs.join(with_term, "term").withColumn("share", share).filter(F.col("share") >= generalise).select("entity", "term", "share")
    # by text: what tells any of its entities
    told = known.select("hash", "entity").join(found, "entity").groupBy("hash", "term").agg(F.max("share").alias("share"))
    told = told.groupBy("hash").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("told"))
    out = stored(told, "telling")
    for table in (known, with_terms, pairs, rare):
        dropped(table)
    return out


def _numbered(terms: DataFrame) -> DataFrame:
    """The terms with a number each, which is all that is shuffled of them."""
    return stored(terms.withColumn("number", F.monotonically_increasing_id()), "numbered")


def _texts_with(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(number, n_term): distinct texts (by 64-bit hash) with each of the numbered terms, over whole texts."""
    listed = terms.select("term", "number")
    if terms.count() <= BROADCAST_TERMS:
        listed = F.broadcast(listed)
    words = texts.filter("text <> ''").select(F.xxhash64("text").alias("h"), F.explode(_terms(F.col("text"))).alias("term"))
    return words.join(listed, "term").select("h", "number").distinct().groupBy("number").agg(F.count("*").alias("n_term"))


def _added(text: Column, base: Column, told: Column, remove: float) -> Column:
    """Array of (kind, start, end) of the telling terms of a text that are no part of a base span, by start."""
    found = F.filter(_located(text, _WORD), lambda w: F.map_contains_key(told, F.lower(w["value"])))
    free = F.filter(found, lambda w: ~F.exists(base, lambda o: (o["start"] < w["end"]) & (w["start"] < o["end"])))
    kind = lambda w: F.when(F.element_at(told, F.lower(w["value"])) >= remove, F.lit("removed")).otherwise(F.lit("general"))
    return F.transform(free, lambda w: F.struct(kind(w).alias("kind"), w["start"].alias("start"), w["end"].alias("end")))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_texts: int = LEAST_TEXTS, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """Spans of personal data in every whole text: doc_id, hash (of the text) and spans, an array of (kind, start, end).

    Base kinds are email, ip, card and phone, leftmost and not overlapping within a kind; places are code points, the
    end exclusive. `general` and `removed` spans are all places of terms that give a protected entity of the text away
    (see the module), base spans apart. Only texts with an entity can have them, so text without personal data is left
    alone. Spans of different kinds may overlap.

    A null text counts as an empty one and has no spans. Null doc_ids stay; repeated rows give repeated rows, and count
    as one text in the statistics of entities; an empty table gives none; other columns are ignored, whatever their
    names.
    """
    given = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = given.withColumn("base", base_spans(F.col("text")))
    some = F.size("base") > 0
    base = stored(base.select("doc_id", F.when(some, F.md5("text")).alias("hash"), "base", F.when(some, F.col("text")).alias("text")), "entities")
    told = _telling(base, given, least_texts, generalise)
    plain = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    none = F.expr("CAST(array() AS array<struct<kind:string,start:int,end:int>>)")
    met = base.filter("hash IS NOT NULL").join(told, "hash", "left")
    more = F.when(F.col("told").isNotNull(), _added(F.col("text"), F.col("base"), F.col("told"), remove)).otherwise(none)
    return base.filter("hash IS NULL").select("doc_id", "hash", plain.alias("spans")).unionByName(met.select("doc_id", "hash", F.concat(plain, more).alias("spans")))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of base kinds, base_sha256 and spans of `find`'s rows; spans as kind:start:end, comma-joined."""
    line = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in KINDS]
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    return found.select("doc_id", *counts, F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """The documents with their personal data replaced: [EMAIL], [IP], [CARD], [PHONE], [TERM] for generalised terms,
    nothing for removed ones. All rows and columns stay; `text` alone changes, and only where there are spans. Of
    overlapping spans the first, and of those the longest, is replaced and the rest of the others goes with it.
    """
    free = lambda name: next(n for n in (f"__{name}{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    hash_, spans_ = free("hash"), free("spans")
    found = find(docs, doc_id, text, **limits).filter("hash IS NOT NULL").select(F.col("hash").alias(hash_), F.col("spans").alias(spans_)).dropDuplicates([hash_])
    ordered = F.transform(spans_, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind")))
    body = F.coalesce(F.col(text), F.lit(""))
    tag = lambda k: F.when(k == "removed", F.lit("")).when(k == "general", F.lit("[TERM]")).otherwise(F.concat(F.lit("["), F.upper(k), F.lit("]")))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        piece = F.when(fresh, F.concat(F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), tag(s["kind"]))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], -s["back"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    clean = F.aggregate(F.array_sort(ordered), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(body, a["at"] + 1, F.length(body))))
    keyed = docs.withColumn(hash_, F.when(F.col(text).rlike(r"@|[0-9][0-9\x20().-]{2}"), F.md5(text)))
    other = keyed.filter(F.col(hash_).isNull()).select(*docs.columns)
    hit = keyed.filter(F.col(hash_).isNotNull()).join(found, hash_, "left")
    return other.unionByName(hit.withColumn(text, F.when(F.col(spans_).isNotNull(), clean).otherwise(F.col(text))).select(*docs.columns))
