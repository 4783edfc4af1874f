"""A training-data pipeline over `documents`: language ID, near-dedup, personal data, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedloom.llm import langid, mixing, packing, pii, simhash
from feedloom.llm.common import dropped, stored
from feedloom.llm.queries import table, tokenizer_path

#: Jaccard similarity of sets of five-word shingles from which documents are near duplicates.
NEAR = 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn the languages of labelled rows and keep the documents that are in one; others have no letter."""
    return langid.identified(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: tries of fingerprints find them, whole shingle sets decide."""
    return simhash.first_of_groups(docs, shingle=5, least=NEAR)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data and what gives it away; no document goes."""
    return pii.sanitise(docs)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that sources come by the square root of their size; a document may come several times."""
    return mixing.mix(docs, power=0.5, seed=42).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 4096 tokens."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("PII", personal_data),
    ("mixing sources to target weights", mixing_to_weights),
    ("best-fit packing", best_fit_packing),
]

#: SQL has neither the automata, the tries of fingerprints nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to `documents`; what each returns is written to the shared folder, read by the next, then deleted."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stored(stage(spark, docs, sf_dir), f"stage{k}")
        dropped(docs)
        docs = out
    return docs
