import random

import public_tokenizers
import pytest
from feedloom.llm import tokens
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = [*"ab don't 's're'll ve\n\n\t  ,.!?'\"12é—ßñ中🙂", chr(0x1C), chr(0x85), chr(0xA0), chr(0x2003), "<|endoftext|>", "<|endo", "the ", "ing ", "    "]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return tokens.PrefixCounter(PATH)


def texts(n, most, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_every_prefix_equals_the_library(library, counter):
    for t in [*texts(300, 25, 1), "'re", "''ve", "a'll b", "  \n ", " 's"]:
        want = [len(e.ids) for e in library.encode_batch([t[: i + 1] for i in range(len(t))], add_special_tokens=False)]
        assert counter.text(t).tolist() == want, t


def test_operator_equals_the_library(spark, library):
    rows = [*enumerate(texts(300, 60, 2)), (900, None), (901, ""), (None, "a b"), (5, "twice"), (5, "twice"), (902, "x" * 3000 + " " + "the cat " * 2000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, n_tokens string")
    got = tokens.token_counts(df, PATH, limit=8, prefixes=True).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), len((t or "").encode()), len(t or ""), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 8) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_chars"], r["n_tokens"], r["over_limit"]) for r in got) == want
    for r in got:
        p = r["prefix_tokens"]
        assert len(p) == r["n_chars"] and r["limit_chars"] == max((i + 1 for i, c in enumerate(p) if c <= 8), default=0)
    assert tokens.token_counts(df.limit(0), PATH).count() == 0


def test_tables_start_anew_when_full(spark, library, counter):
    table = tokens.ChunkTable(counter.chunk, most_bytes=50)
    import numpy as np
    import pyarrow as pa
    from feedloom.llm.common import text_blocks

    some = texts(200, 40, 3)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(some))), pa.array(some)], names=["a", "b"])
    for ids, data, offsets in text_blocks([batch], max_bytes=300):
        values, bounds = tokens._counts_of_block(counter, table, data, offsets)
        for k, i in enumerate(ids.to_pylist()):
            assert np.array_equal(values[bounds[k] : bounds[k + 1]], counter.text(some[i]))


def test_truncation_needs_no_encoding(spark, library):
    df = spark.createDataFrame([(1, "the cat sat on the mat, don't it?"), (2, ""), (3, "hi")], "doc_id long, text string")
    counted = tokens.token_counts(df, PATH, prefixes=True).select("doc_id", "prefix_tokens").join(df, "doc_id")
    for r in tokens.truncated(counted, 4).collect():
        n = len(library.encode(r["kept_text"], add_special_tokens=False).ids)
        assert n == r["kept_tokens"] <= 4
        assert r["text"].startswith(r["kept_text"])


def block(some, max_bytes=1 << 20):
    import pyarrow as pa
    from feedloom.llm.common import text_blocks

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(some))), pa.array(some)], names=["a", "b"])
    return text_blocks([batch], max_bytes=max_bytes)


def test_words_are_counted_side_by_side(library, monkeypatch):
    counter = tokens.PrefixCounter(PATH)
    rng = random.Random(4)
    some = [rng.choice(["", " ", "\n"]) + "".join(rng.choice([*"tehdionsTE", "ß", "é", "Ñ", "tion"]) for _ in range(rng.randint(1, 12))) + rng.choice(["", "***", ".", "\nÉa"]) for _ in range(500)]
    one_by_one = []
    monkeypatch.setattr(counter, "piece", lambda p, piece=counter.piece: one_by_one.append(p) or piece(p))
    table = tokens.ChunkTable(counter.chunk)
    for _, data, offsets in block(some):
        values, bounds = tokens._counts_of_block(counter, table, data, offsets)
        assert [int(values[b - 1]) for b in bounds[1:]] == [len(library.encode(t).ids) for t in some]
    assert {p for p in one_by_one if any(c.isalpha() and c != "Ġ" and c != "Ċ" for c in p)} == set()


def test_words_side_by_side_equal_the_library(library, monkeypatch):
    words = ["a×b", "a÷b", " ×", "Привет", " мир.", "東京", " 中文字", "é", "ª", "ﬁ", "x" * 64, " " + "y" * 63, " " + "é" * 32, "z" * 65, "\nA", "\t é", "\n\nA", " \nA", "a\n", "é'll", "é'", "É!?", "ß\r\nß", "Ⅷ", "a1", "1a"]
    rng = random.Random(5)
    some = [*words, "", *("".join(rng.choice([*words, *BITS]) for _ in range(rng.randint(1, 9))) for _ in range(300))]
    want = [[len(e.ids) for e in library.encode_batch([t[: i + 1] for i in range(len(t))])] for t in some]
    for most, size in ((tokens.MOST_PREFIXES, tokens.PIECE_BYTES), (5, 20)):  # whole tables, and such as start anew all the time
        monkeypatch.setattr(tokens, "MOST_PREFIXES", most)
        monkeypatch.setattr(tokens, "PIECE_BYTES", size)
        counter = tokens.PrefixCounter(PATH)
        table = tokens.ChunkTable(counter.chunk)
        for _ in range(2):
            for ids, data, offsets in block(some, 3000):
                values, bounds = tokens._counts_of_block(counter, table, data, offsets)
                for k, i in enumerate(ids.to_pylist()):
                    assert values[bounds[k] : bounds[k + 1]].tolist() == want[i], some[i]


def test_key_table_with_many_keys_to_a_slot():
    import numpy as np

    table, keys = tokens.KeyTable(4), np.array([3, 0, 1 << 40, 77, 5, 9, 12, 1000, 31, 64, 2, 8, 16])
    table.put(keys[:6], np.arange(6, dtype=np.int32))
    table.put(keys[6:], np.arange(6, 13, dtype=np.int32))
    assert table.get(keys).tolist() == list(range(13)) and table.get(np.array([4, 1 << 50])).tolist() == [-1, -1]
    table.clear()
    assert table.get(keys).tolist() == [-1] * 13
