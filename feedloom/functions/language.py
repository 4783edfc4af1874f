"""Language by function words, and entities by rule: the fallbacks where no model is at hand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, normalise, words

#: Frequent words of each language, in order of priority at ties.
FUNCTION_WORDS = {
    "en": "the and of to in is that for with on are this was at by from it be as".split(),
    "de": "der die das und ist nicht mit den von dem ein eine zu auf für im sich des".split(),
    "fr": "le la les et des est une dans pour que qui sur pas par du au ce il elle".split(),
    "es": "el los las y una por para con del se su más como pero al lo sus está".split(),
}


def profile(text: Column) -> Column:
    """struct(label, confidence): the language with most function words and their share of all words; '' and 0 without."""

    def of(w):
        rows = [F.struct(F.size(F.filter(w, _among(ws))).alias("hits"), F.lit(-k).alias("prio"), F.lit(lang).alias("label")) for k, (lang, ws) in enumerate(FUNCTION_WORDS.items())]
        best = F.array_max(F.array(*rows))
        found = best["hits"] > 0
        return F.struct(F.when(found, best["label"]).otherwise("").alias("label"), F.when(found, best["hits"] / F.size(w)).otherwise(F.lit(0.0)).alias("confidence"))

    return let(words(normalise(text)), of)


def _among(ws: list[str]):
    return lambda x: x.isin(ws)


def entities(text: Column, most_chars: int = 100) -> Column:
    """Distinct runs of capitalised words in order, in lower case and cut; what looks like a URL is none."""
    found = F.regexp_extract_all(text, F.lit(r"(\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*)"), F.lit(1))
    return relevant(F.transform(found, lambda e: F.struct(F.lit("ORG").alias("type"), e.alias("name"))), most_chars)


#: Kinds of entities that say what a text is about.
RELEVANT_TYPES = ("PERSON", "ORG", "GPE", "LOC", "EVENT", "PRODUCT", "WORK_OF_ART", "NORP")


def relevant(typed: Column, most_chars: int = 100) -> Column:
    """Names of entities (type, name) of a relevant type, first seen first; URL-shaped names are left out."""
    kept = F.filter(typed, lambda e: e["type"].isin(*RELEVANT_TYPES) & ~e["name"].rlike(r"(?i)^(https?://|www\.)|^[^ ]+\.[a-z]{2,}(/|$)"))
    return F.array_distinct(F.transform(kept, lambda e: F.substring(F.lower(e["name"]), 1, most_chars)))
