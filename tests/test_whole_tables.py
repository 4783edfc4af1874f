"""Queries that read whole texts and whole pools."""

from feedloom.plans import QUERIES


def test_category_reads_the_whole_text(spark, tmp_path):
    texts = {0: "nothing here", 4: "zzz " * 60 + "linux python"}
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["id"]: r["category"] for r in QUERIES["category"](spark, str(tmp_path)).collect()}
    assert got == {0: None, 4: "science_technology"}


def test_templates_are_those_of_whole_texts(spark, tmp_path):
    texts = [(2, "now playing on air: one more song tune in"), (1, "now playing on air: another song tune in"), (0, "now playing on air: another song went out")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["event_id"]: r["n"] for r in QUERIES["bot_template"](spark, str(tmp_path)).collect()} == {2: 1, 1: 2, 0: 1}
