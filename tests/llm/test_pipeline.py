import os
import re

import corpus_pipeline
import pytest

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")
def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    at = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, at, DIR)
        assert sorted(out.columns) == sorted(docs.columns)
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        before, now = {r["doc_id"] for r in at.collect()}, {r["doc_id"] for r in after.collect()}
        assert now <= before
        if k == 0:
            assert now == {r["doc_id"] for r in at.collect() if re.search(r"[^\W\d_]", r["text"] or "")}
        if k == 2:
            assert now == before and not any(re.search(r"[\w.]+@[\w-]+\.\w+", r["text"]) for r in after.collect())
        at = after
    packed = corpus_pipeline.STAGES[4][1](spark, at, DIR)
    assert sorted(map(tuple, packed.select("doc_id", "piece", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, corpus_pipeline.run(spark, DIR).select("doc_id", "piece", "start", "length", "ids_crc32").collect()))


def test_stages_survive_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "the cat sat", "en", "s", 11), (3, "the cat sat", "en", "s", 11), (None, "the mat", "en", None, 7)], "doc_id long, text string, lang string, source string, n_chars long")
    for at in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, "")
        at.collect()
