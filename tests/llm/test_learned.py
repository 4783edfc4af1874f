"""Operators that learn: exact parses, defined results for odd rows, and held-out accuracy."""

import os
import random
import zlib

import numpy as np
import pytest
from feedloom.llm import langid, toxicity
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.1"
needs_tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")


def brute_phrases(training, symbols):
    n, i = 0, 0
    text = ",".join(map(str, training)) + ","
    while i < len(symbols):
        k = 0
        while i + k < len(symbols) and ("," + ",".join(map(str, symbols[i : i + k + 1])) + ",") in "," + text:
            k += 1
        i += max(k, 1)
        n += 1
    return n


def test_parse_equals_brute_force():
    rng = random.Random(0)
    for _ in range(20):
        training = [rng.randint(0, 3) for _ in range(rng.randint(1, 60))]
        table = langid.Automaton(training, 6).table
        docs = [[rng.randint(0, 5) for _ in range(rng.randint(0, 40))] for _ in range(8)]
        flat = np.array([s for d in docs for s in d], np.int32)
        size = np.array([len(d) for d in docs])
        begin = np.cumsum(size) - size
        for segment in (1, 3, 7, 2048):
            assert langid.phrases(table, flat, begin, size, segment).tolist() == [brute_phrases(training, d) for d in docs]


def test_scripts_of_many_letters_and_ties():
    many = langid.Model({"zz": ["".join(chr(0x4E00 + i) for i in range(600))], "aa": ["abcd" * 150]}, letters=50)
    assert many.languages == ["aa", "zz"] and many.tables[1].shape[1] == 52
    raw = "\u4e00\u4e01".encode()
    names = langid.Predictor(many).block(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
    assert names.tolist() == ["zz"]
    same = langid.Model({"b": ["kato"], "a": ["kato"]})
    assert langid.Predictor(same).block(np.frombuffer(b"kato", np.uint8), np.array([0, 4]))[0].tolist() == ["a"]


def test_prediction_equals_brute_force_cross_parsing(spark):
    """The whole operator against plain parses of the same sample, on texts longer than a stretch."""
    rng = random.Random(8)
    sounds = {"aa": ["ba", "lo", "mi", "nu"], "bb": ["kr", "est", "ob", "lo"]}
    say = lambda lang, n: " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, say(lang, n), lang) for i, (lang, n) in enumerate((lang, n) for n in (3, 20, 900) for lang in ("aa", "bb") for _ in range(4))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, sample_symbols=300, sample_documents=5)
    got = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    for doc_id, text, _ in rows:
        raw = np.frombuffer(text.encode(), np.uint8)
        letters = langid.symbols_of(raw, np.array([0, len(raw)]), model.lookup)[0]
        bits = {}
        for lang, table, own, b in zip(model.languages, model.tables, model.own, model.bits, strict=True):
            n, state = 0, 0
            for s in own[letters].tolist():
                to = table[state, s]
                if to < 0:
                    n += state > 0
                    to = table[0, s]
                    n += to < 0
                    to = max(to, 0)
                state = to
            bits[lang] = (n + (state > 0)) * b / len(letters)
        least = min(bits, key=lambda x: (bits[x], x))
        assert got[doc_id]["lang_pred"] == least and got[doc_id]["bits"] == pytest.approx(bits[least])


def test_symbols_fold_case_and_gaps():
    folded = langid._folded()
    docs = ["  Aé--B! ", "", "123", "Ω x"]
    raw = [d.encode() for d in docs]
    letters, at = langid.symbols_of(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]), folded)
    parts = [letters[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert [p and [x and chr(x) for x in p] for p in parts] == [["a", "é", 0, "b", 0], [], [], ["ω", 0, "x"]]


def test_language_of_odd_rows(spark):
    rows = [(i, "the cat and the dog sat on the mat " * 3, "en") for i in range(9)] + [(20 + i, "der hund und die katze auf dem dach " * 3, "de") for i in range(9)]
    rows += [(50, None, "en"), (51, "", "de"), (52, "123 !!", None), (53, "Der Hund und die Katze", None), (None, "the dog", "en"), (54, "x" * 50000, None), (20, "twice", None), (20, "twice", None)]
    df = spark.createDataFrame([(*r, "a") for r in rows], "doc_id long, text string, lang string, score string")
    got = langid.identify(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (0, 50, 51, 52, 53, None)] == ["en", "und", "und", "und", "de", "en"]
    assert all(0 <= r["score"] <= 1 for r in got) and by[52]["score"] == 0
    assert by[1]["held_out"] == (zlib.crc32(b"1") % 3 == 1)
    assert langid.identify(df.limit(0)).count() == 0
    bare = langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in bare} == {"und"}
    kept = langid.identified(df, langid.fit(df))
    assert kept.columns == df.columns and kept.filter("doc_id IN (50, 51, 52)").count() == 0 and kept.filter("doc_id = 20").count() == 3


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "word " * 30000, "x"), (None, "a", "x"), (2, "", "x")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in toxicity.assess(docs, none).collect()] == [0.0] * 5
    some = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")
    texts = spark.createDataFrame([(i, ("you worthless idiot " if i % 4 == 0 else "a fine day out ") * 5 + str(i)) for i in range(40)], "doc_id long, text string")
    got = toxicity.score(docs, toxicity.fit(texts, some)).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert toxicity.assess(docs.limit(0), some).count() == 0


@needs_tables
def test_held_out_languages(spark):
    d = spark.read.parquet(f"{DIR}/documents.parquet")
    got = langid.identify(d).filter("held_out").join(d.select("doc_id", "lang"), "doc_id")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97


@needs_tables
def test_held_out_toxicity(spark):
    """Over all languages; README.md has the recall of each."""
    d, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    got = toxicity.assess(d, labels).filter("held_out").join(labels, "doc_id").join(d.select("doc_id", "lang"), "doc_id")
    n = lambda e: F.count_if(F.expr(e))
    t = got.agg(n("predicted = 1 AND toxic = 1").alias("tp"), n("predicted = 1").alias("p"), n("toxic = 1").alias("toxic")).first()
    assert t["tp"] / t["p"] > 0.5
    assert t["tp"] / t["toxic"] >= 0.6


def test_both_dictionaries_are_trained():
    rng = random.Random(4)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    text = lambda bad: " ".join(rng.choice(["gruntwarbler", "vexmuddle"]) if bad and rng.random() < 0.08 else rng.choice(words) for _ in range(150))
    m = toxicity.Model([text(True) for _ in range(120)], [text(False) for _ in range(240)])
    assert b"gruntwarbler" in m.toxic and b"vexmuddle" in m.toxic and b"gruntwarbler" not in m.ordinary
    raw = [toxicity._norm(text(i % 2 == 0)) for i in range(40)]
    got = m.scores(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]), m.compressors())
    assert ((got >= 0.3) == [i % 2 == 0 for i in range(40)]).mean() > 0.9


def test_dictionaries_have_no_header_and_few_samples_train_too():
    few = [b" worthless idiot", b" idiot moron"]
    for samples, size in ((few, 1024), ([b"some ordinary text %d here" % i for i in range(300)], 512)):
        got = toxicity.Model._train(samples, size)
        assert 0 < len(got) <= size and b"\x37\xa4\x30\xec" not in got
    assert toxicity.Model._train([], 100) == b"" == toxicity.Model._train([b""], 100)
