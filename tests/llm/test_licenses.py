import math
import random
import re

import pytest
from feedloom.llm import licenses


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(doc_id, text, templates=licenses.TEMPLATES, least=licenses.LEAST):
    w = words(text)
    base = [(label, i) for phrase, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    labels, score = {label for label, _ in base}, 0.0
    for at in range(0, len(w), 32):
        block = set(w[at : at + 64])
        for label, body in templates:
            tokens = set(words(body))
            both = len(tokens & block)
            if both >= math.ceil(len(tokens) * least - 1e-9):
                labels.add(label)
                score = max(score, both / len(tokens))
    places = [i for _, i in base]
    return (doc_id, len(w), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for x, _ in base})), ",".join(sorted(labels)), 1.0 if base else score)


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "doc_id long, text string, hash string, words int, blocks int")
    got = licenses.scan(df, **options)
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    key = lambda r: tuple(map(str, r))
    out = sorted(map(tuple, got.collect()), key=key)
    assert out == sorted((brute(*r, **options) for r in rows), key=key)
    return out


def corpus():
    rng = random.Random(8)
    bodies = [words(body) for _, body in licenses.TEMPLATES]
    filler = ["the", "of", "software", "in", "file", "plain", "Prose", "été", "2"]
    rows = []
    for k in range(150):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts += [rng.choice(filler) for _ in range(rng.randint(0, 90))]
            body = list(rng.choice(bodies))
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                body[rng.randrange(len(body))] = rng.choice(filler)
            parts += body if rng.random() < 0.7 else ["MIT", "License"]
        rows.append((k, " ".join(x.upper() if rng.random() < 0.1 else x for x in parts)))
    return rows + [(None, "general public license"), (1, None), (1, None), (2, ""), (3, "mit-license, mit license; the apache license"), (4, "é" * 10 + " mit\x00license")]


def test_equals_brute_force(spark):
    out = check(spark, corpus())
    assert len({label for r in out for label in r[6].split(",")} - {""}) > 10
    assert any(0 < r[7] < 1 for r in out)


def test_copies_long_texts_and_empty_tables(spark):
    long = "word " * 300_000 + "licensed under CC BY-NC 4.0 " + "the " * 100_000 + "released under the mit license"
    check(spark, [(k, "Licensed under CC BY-NC 4.0.") for k in range(200)] + [(1000, long)])
    assert check(spark, []) == []


def test_own_templates(spark):
    templates = (("own", "alpha beta gamma delta"), ("own2", "beta beta delta"))
    for least in (0.5, 0.75, 1.0):
        check(spark, [(1, "alpha beta"), (2, "delta x beta y alpha"), (3, "gamma " * 70 + "delta alpha beta"), (4, "beta delta")], templates=templates, least=least)
    with pytest.raises(ValueError, match="words"):
        licenses.scan(spark.createDataFrame([], "doc_id long, text string"), templates=(("x", "a " * 40),))
