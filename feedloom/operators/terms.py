"""Joins of texts and hosts with tables of terms and domains, of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import dropped, written
from .batches import in_pieces

#: Bytes of terms, with what an automaton takes beside them, that one pass over the texts looks for.
SHARD_BYTES = 64 << 20
#: What a term costs beside its own bytes, for each of these; automata have a node a character.
NODE_BYTES = 32
#: Bytes of texts that a worker reads at once.
TEXT_BYTES = 1 << 20


def suffixes(host: Column) -> Column:
    """Array of a host and all domains above it: a.b.c, b.c, c; none for an empty one."""
    parts = F.split(host, r"\.", -1)
    found = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.when(F.coalesce(host, F.lit("")) != "", found).otherwise(F.array().cast("array<string>"))


def under_domains(rows: DataFrame, host: Column, domains: DataFrame, name: str = "domain") -> DataFrame:
    """Each row with every domain (column `domain`) that its host is or is below, as column `name`: an equi-join.

    A host has as many suffixes as labels, so rows grow by a small factor whatever the table of domains.
    """
    listed = domains.select(F.lower("domain").alias(name)).filter(F.col(name) != "").distinct()
    return rows.withColumn(name, F.explode(suffixes(host))).join(listed, name).select(*rows.columns, name)


def _automaton(terms: list[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for t in terms:
        a.add_word(t, t)
    a.make_automaton()
    return a


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def whole_words(automaton, text: str) -> set[str]:
    """Terms that stand in a lower-case text with no letter, digit or underscore on either side."""
    found = set()
    for end, term in automaton.iter(text):
        a, b = end - len(term), end + 1
        if (a < 0 or not _is_word(text[a])) and (b == len(text) or not _is_word(text[b])):
            found.add(term)
    return found


def contained_terms(rows: DataFrame, terms: DataFrame, id_: str = "id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(id, term): terms (column `term`) that stand in a text as whole words, in any case; each once a row.

    An automaton of all terms reads a text once, however many there are. Terms of more than `shard_bytes` are cut into
    shards, each sent to the tasks for a pass of its own; texts are never shuffled. Null and empty terms are none.
    """
    spark = rows.sparkSession
    listed = written(terms.select(F.lower("term").alias("term")).filter("term <> ''").distinct(), "terms")
    size = listed.agg(F.sum(F.octet_length("term") * NODE_BYTES)).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    given = rows.select(F.col(id_).alias("id"), F.col(text).alias("text")).filter("text IS NOT NULL")

    def scan(shared):
        def run(batches):
            import pyarrow as pa

            automaton = None
            for batch in in_pieces(batches, 1, TEXT_BYTES):
                automaton = automaton or (_automaton(shared.value) if shared.value else None)
                if automaton is None:
                    return
                at, found = [], []
                for k, t in enumerate(batch.column(1).to_pylist()):
                    hits = sorted(whole_words(automaton, t.lower()))
                    at += [k] * len(hits)
                    found += hits
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=["id", "term"])

        return run

    out = None
    for k in range(shards):
        part = [r[0] for r in listed.filter(F.pmod(F.xxhash64("term"), F.lit(shards)) == k).collect()]  # shard_bytes at most
        hits = given.mapInArrow(scan(spark.sparkContext.broadcast(part)), f"id {given.schema['id'].dataType.simpleString()}, term string")
        out = hits if out is None else out.unionByName(hits)
    dropped(listed)
    return out
