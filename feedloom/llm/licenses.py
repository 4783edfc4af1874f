"""License scan: phrases that name a licence, and text blocks that contain most of a licence template.

An exact set-similarity join of text blocks with templates. Tokens are ordered by how many texts of the corpus have
them, rarest first. A block that holds a share of a template's tokens holds one of the template's first (prefix); it
has enough tokens (length), and what follows the first shared token can still make up the rest (position). Whole
token sets decide. DataFrame functions only.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored

#: Phrases whose words name a licence, and its label. Fixed values.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label and words of short notices and of openings of licence texts, at most HALF words each. Fixed values.
TEMPLATES = (
    ("mit", "released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc0", "dedicated to the public domain under CC0 1.0 Universal"),
)
#: Share of a template's tokens that a block must hold.
LEAST = 0.9
#: A block has 2 HALF words and starts at every HALF words, so HALF words that follow one another lie whole in a block.
HALF = 32
#: Entries of the index of prefix tokens up to which it is broadcast.
BROADCAST_ENTRIES = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, runs of letters, digits and what is beyond ASCII; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_WORD), F.lit(0))


def _template_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def _needed(size: int, least: float) -> int:
    return max(1, math.ceil(size * least - 1e-9))


def _phrase_starts(words: Column, phrases: dict[str, str]) -> Column:
    """Array of (label, start) of every place where a phrase's words stand one after another."""
    ends = sorted({p.split()[-1] for p in phrases})
    places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(ends), i)), lambda i: i.isNotNull())

    def of(phrase: str, label: str) -> Column:
        parts = phrase.split()
        n = len(parts)
        here = F.filter(places, lambda i: (i >= n - 1) & (F.slice(words, F.greatest(i - n + 2, F.lit(1)), n) == F.array(*map(F.lit, parts))))
        return F.transform(here, lambda i: F.struct(F.lit(label).alias("label"), (i - n + 1).cast("long").alias("start")))

    none = F.expr("CAST(array() AS array<struct<label:string,start:bigint>>)")
    return F.when(F.arrays_overlap(words, F.array(*map(F.lit, ends))), F.concat(*(of(p, k) for p, k in phrases.items()))).otherwise(none)


def _blocks(words: Column, first: list[str], ranked: list[str]) -> Column:
    """Array of blocks that hold a token of `first`; a block is the sorted array of its tokens' ranks."""
    vocabulary, starts = F.array(*map(F.lit, ranked)), F.array(*map(F.lit, first))
    halves = F.filter(F.transform(words, lambda w, i: F.when(w.isin(first), F.floor(i / HALF).cast("int"))), lambda b: b.isNotNull())
    both = F.array_distinct(F.concat(F.transform(halves, lambda b: F.greatest(b - 1, F.lit(0))), halves))
    tokens = lambda b: F.array_intersect(F.slice(words, b * HALF + 1, 2 * HALF), vocabulary)
    found = F.transform(both, lambda b: F.array_sort(F.transform(tokens(b), lambda w: F.array_position(vocabulary, w).cast("int") - 1)))
    return F.when(F.arrays_overlap(words, starts), F.array_distinct(found)).otherwise(F.expr("CAST(array() AS array<array<int>>)"))


def _contained(blocks: DataFrame, templates: list[tuple[str, list[int]]], least: float) -> DataFrame:
    """(hash, label, score): templates that blocks (hash, block) hold to a share of at least `least`."""
    spark = blocks.sparkSession
    index, rows = [], []
    for k, (label, tokens) in enumerate(templates):
        size, need = len(tokens), _needed(len(tokens), least)
        rows.append((k, label, tokens, need))
        index += [(token, place, k, size, need) for place, token in enumerate(tokens[: size - need + 1])]
    prefixes = spark.createDataFrame(index, "token int, place int, template int, size int, need int")
    whole = spark.createDataFrame(rows, "template int, label string, tokens array<int>, need int")
    if len(index) <= BROADCAST_ENTRIES:
        prefixes, whole = F.broadcast(prefixes), F.broadcast(whole)
    shared = blocks.select("hash", "block", F.posexplode("block").alias("at", "token")).join(prefixes, "token")
    length = F.size("block") >= F.col("need")
    position = F.least("at", "place") + 1 + F.least(F.size("block") - F.col("at") - 1, F.col("size") - F.col("place") - 1) >= F.col("need")
    met = shared.filter(length & position).select("hash", "block", "template").join(whole, "template")
    both = F.size(F.array_intersect("block", "tokens"))
    return met.withColumn("both", both).filter(F.col("both") >= F.col("need")).select("hash", "label", (F.col("both") / F.size("tokens")).alias("score"))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates=TEMPLATES, least: float = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Licences that every whole text names or quotes, one row a document.

    Returns doc_id, n_words, n_base (places of phrases), first_word and last_word (their smallest and largest start, null
    without any), base_labels (of phrases), labels (of phrases and templates; both distinct, sorted, comma-joined) and
    score: 1 with a phrase, else the largest share of a template that a block holds, 0 if none reaches `least`.

    `templates` are (label, text) of at most HALF words. The frequency of their tokens is counted over all texts; nothing
    is dropped for being frequent, the order only makes candidates few. Equal texts are joined once, by their hash.

    A null text is an empty one; null doc_ids stay; repeated rows give repeated rows; an empty table gives none; other
    columns are ignored, whatever their names.
    """
    sets = [(label, sorted(set(_template_words(body)))) for label, body in templates]
    if any(not s or len(_template_words(body)) > HALF for (_, s), (_, body) in zip(sets, templates, strict=True)):
        raise ValueError(f"a template has 1 to {HALF} words")
    vocabulary = sorted({w for _, s in sets for w in s})
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    none = F.expr("CAST(array() AS array<array<int>>)")
    if vocabulary:
        in_texts = given.select(F.explode(F.array_intersect(words_of(F.col("text")), F.array(*map(F.lit, vocabulary)))).alias("token")).groupBy("token").count()
        n = {r["token"]: r["count"] for r in in_texts.collect()}  # at most the templates' tokens
        ranked = sorted(vocabulary, key=lambda w: (n.get(w, 0), w))
        rank = {w: k for k, w in enumerate(ranked)}
        sets = [(label, sorted(rank[w] for w in s)) for label, s in sets]
        first = sorted({ranked[t] for _, s in sets for t in s[: len(s) - _needed(len(s), least) + 1]})
    worded = given.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("hash"), words_of(F.col("text")).alias("words"))
    facts = worded.select("doc_id", "hash", F.size("words").cast("long").alias("n_words"), _phrase_starts(F.col("words"), phrases).alias("base"), (_blocks(F.col("words"), first, ranked) if vocabulary else none).alias("blocks"))
    facts = stored(facts, "facts")
    blocks = facts.filter(F.size("blocks") > 0).select("hash", F.explode("blocks").alias("block"))
    found = _contained(blocks, sets, least).groupBy("hash").agg(F.collect_set("label").alias("more"), F.max("score").alias("found"))
    found = stored(found, "templates")
    plain = facts.filter(F.size("blocks") == 0).withColumns({"more": F.lit(None).cast("array<string>"), "found": F.lit(None).cast("double")})
    both = plain.unionByName(facts.filter(F.size("blocks") > 0).join(found, "hash", "left"))
    labels = F.transform("base", lambda x: x["label"])
    line = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    starts = F.transform("base", lambda x: x["start"])
    out = both.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        line(labels).alias("base_labels"), line(F.concat(labels, F.coalesce("more", F.expr("CAST(array() AS array<string>)")))).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("found", F.lit(0.0))).alias("score"),
    )
    out = stored(out, "licenses")
    dropped(facts)
    dropped(found)
    return out


def _oracle() -> str:
    tokens = ", ".join(f"({k}, '{label}', '{w}', {len(s)}, {_needed(len(s), LEAST)})" for k, (label, body) in enumerate(TEMPLATES) for s in [set(_template_words(body))] for w in sorted(s))
    phrases = ", ".join(f"({p.split()!r}, '{label}')" for p, label in PHRASES.items())
    return rf"""
WITH texts AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS words FROM documents),
phrases(parts, label) AS (VALUES {phrases}),
tokens(template, label, word, size, need) AS (VALUES {tokens}),
placed AS (SELECT id, unnest(words) AS word, unnest(range(len(words))) AS i FROM texts),
base AS (
  SELECT t.id, p.label, w.i AS start FROM placed w JOIN phrases p ON w.word = p.parts[1]
  JOIN texts t ON t.id = w.id WHERE t.words[w.i + 1 : w.i + len(p.parts)] = p.parts
),
hits AS (SELECT DISTINCT w.id, w.i // {HALF} - o.back AS block, k.template, k.label, k.word, k.size, k.need
         FROM placed w JOIN tokens k USING (word) CROSS JOIN (VALUES (0), (1)) AS o(back)),
held AS (SELECT id, label, count(*) / size AS score FROM hits WHERE block >= 0 GROUP BY id, block, template, label, size, need HAVING count(*) >= need),
found AS (SELECT id, max(score) AS score FROM held GROUP BY id),
bases AS (SELECT id, count(*) AS n, min(start) AS a, max(start) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY id),
alls AS (SELECT id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT id, label FROM base UNION ALL SELECT id, label FROM held) GROUP BY id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(b.a AS BIGINT) AS first_word, CAST(b.b AS BIGINT) AS last_word,
       coalesce(b.labels, '') AS base_labels, coalesce(a.labels, '') AS labels, CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(f.score, 0)::DOUBLE END AS score
FROM texts LEFT JOIN bases b USING (id) LEFT JOIN alls a USING (id) LEFT JOIN found f USING (id)
"""


#: The same in DuckDB, every block counted against every template.
ORACLE = _oracle()
