"""Language ID by cross-parsing entropy.

For each language a suffix automaton holds labelled text. A document is parsed into phrases, each the longest run of
symbols that stands somewhere in the labelled text of a language (Ziv and Merhav's cross-parsing). Few, long phrases
mean text of that language. Phrases times the logarithm of the labelled text's size, divided by the document's
symbols, estimates the cross entropy; the language with the least wins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing, text_blocks

#: Symbols of labelled text per language, a bound on the model. Documented parameter of `fit`.
SAMPLE_SYMBOLS = 24_000
#: Documents that give these symbols in equal parts, per language at most about so many. Documented parameter of `fit`.
SAMPLE_DOCUMENTS = 100
#: Long documents are parsed in stretches of so many symbols side by side; what a stretch takes over from the one before
#: is settled afterwards, so that the phrases are those of one parse.
SEGMENT = 2048
#: Block of text parsed at once.
BLOCK = 2 << 20
#: Letters of its sample that each language tells apart, the most frequent ones; the others share one symbol. This
#: bounds the tables where a script has thousands of letters. Documented parameter of `fit`.
LETTERS = 256

def _folded() -> np.ndarray:
    """For every code point: the lower-case letter it stands for, or 0 where it is no letter."""
    out = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low[0]) if len(low) >= 1 else c
    return out


def symbols_of(data: np.ndarray, offsets: np.ndarray, folded: np.ndarray):
    """Folded letters of all documents, each run of other characters being one 0 between words, and offsets."""
    text = data.tobytes().decode("utf-8")
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    letters = folded[points]
    first = np.cumsum((data & 0xC0) != 0x80)  # code points up to each byte
    at = np.concatenate([[0], first])[offsets]
    gap = letters == 0
    begin = np.zeros(len(letters) + 1, bool)
    begin[at] = True
    keep = np.ones(len(letters), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    keep |= begin[:-1]
    keep &= ~(gap & begin[:-1])  # none at the front
    return letters[keep], np.concatenate([[0], np.cumsum(keep)])[at]


class Automaton:
    """Suffix automaton of a sequence of small integers, as a dense table: next state, or -1."""

    def __init__(self, symbols: list[int], alphabet: int):
        link, length, step = [-1], [0], [{}]
        last = 0
        for c in symbols:
            cur = len(step)
            link.append(0)
            length.append(length[last] + 1)
            step.append({})
            p = last
            while p != -1 and c not in step[p]:
                step[p][c] = cur
                p = link[p]
            if p != -1:
                q = step[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(step)
                    link.append(link[q])
                    length.append(length[p] + 1)
                    step.append(dict(step[q]))
                    while p != -1 and step[p].get(c) == q:
                        step[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.table = np.full((len(step), alphabet), -1, np.int32)
        for s, out in enumerate(step):
            for c, t in out.items():
                self.table[s, c] = t


def _advance(table: np.ndarray, width: int, state: np.ndarray, open_: np.ndarray, sym: np.ndarray):
    """State and openness behind one more symbol of each parse, and the phrases that ended by it."""
    to = table[state * width + sym]
    ended = np.zeros(len(state), np.int32)
    bad = np.flatnonzero(to < 0)
    if len(bad):  # a phrase ends before this symbol, or is this symbol where no text has it
        ended[bad] = open_[bad]
        again = table[sym[bad]]
        ended[bad[again < 0]] += 1
        to[bad] = np.maximum(again, 0)
    return to, to > 0, ended


def _parse(table: np.ndarray, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray):
    """Phrases that end in each stretch of symbols, parsed from the start state, and the state behind it."""
    flat, width = table.ravel(), table.shape[1]
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    out, state = np.zeros(len(size), np.int32), np.zeros(len(size), np.int32)
    alive = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
    for i, n in enumerate(alive.tolist()):
        state[:n], _, ended = _advance(flat, width, state[:n], state[:n] > 0, symbols[begin[:n] + i])
        out[:n] += ended
    back = np.argsort(order, kind="stable")
    return out[back], state[back]


def _settled(table: np.ndarray, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, state: np.ndarray):
    """What each stretch has more in phrases if its parse goes on from `state`, and the state behind it, or -1.

    The parse from the start state and the one that goes on walk side by side until they are in one state, mostly
    within a phrase or two; from there on they are the same, and -1 says so.
    """
    flat, width = table.ravel(), table.shape[1]
    more, behind = np.zeros(len(size), np.int32), np.full(len(size), -1, np.int32)
    live = np.flatnonzero(state != 0)
    a, b = np.zeros(len(live), np.int32), state[live]
    for i in range(int(size.max(initial=0))):
        over = size[live] <= i
        behind[live[over]] = b[over]
        go = ~over & (a != b)
        live, a, b = live[go], a[go], b[go]
        if not len(live):
            break
        sym = symbols[begin[live] + i]
        a, _, x = _advance(flat, width, a, a > 0, sym)
        b, _, y = _advance(flat, width, b, b > 0, sym)
        more[live] += y - x
    else:
        behind[live[a != b]] = b[a != b]
    return more, behind


def phrases(table: np.ndarray, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Phrases of each document under an automaton, in one parse from its first symbol to its last."""
    pieces = -(-size // segment)
    doc = np.repeat(np.arange(len(size)), pieces)
    if not len(doc):
        return np.zeros(len(size), np.int64)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at, part = begin[doc] + k * segment, np.minimum(segment, size[doc] - k * segment)
    fresh, state = _parse(table, symbols, at, part)
    ended, alone = fresh.copy(), state.copy()
    todo = np.flatnonzero(k)
    while len(todo):  # a stretch that leaves another state than it did alone hands that on to the next one
        more, behind = _settled(table, symbols, at[todo], part[todo], state[todo - 1])
        behind = np.where(behind >= 0, behind, alone[todo])
        after = todo[behind != state[todo]] + 1
        ended[todo], state[todo] = fresh[todo] + more, behind
        after = after[after < len(doc)]
        todo = after[k[after] > 0]
    last = np.append(np.flatnonzero(k[1:] == 0), len(k) - 1)
    total = np.bincount(doc, weights=ended, minlength=len(size)).astype(np.int64)
    total[doc[last]] += state[last] > 0
    return total


class Model:
    """Automata by language, and the letters they know."""

    def __init__(self, texts: dict[str, list[str]], sample_symbols: int = SAMPLE_SYMBOLS, letters: int = LETTERS):
        folded = _folded()
        samples = {}
        for lang in sorted(texts):
            got, n = [], 0
            for t in texts[lang]:
                raw = np.frombuffer(t.encode(), np.uint8)
                s = symbols_of(raw, np.array([0, len(raw)]), folded)[0][: max(0, sample_symbols - n)]
                got += [s, np.zeros(1, np.int32)]
                n += len(s)
            if n:
                samples[lang] = np.concatenate(got)
        self.languages = list(samples)
        # one table for all leads from a code point to its letter (0: none, 1: no language knows it), and a small one
        # for each language from there to its own symbols (0: between words, 1: any other letter)
        known = np.unique(np.concatenate([*samples.values(), np.zeros(1, np.int32)]))
        known = known[known > 0]
        dense = np.ones(0x110000, np.int32)
        dense[0] = 0
        dense[known] = 2 + np.arange(len(known))
        self.lookup = dense[folded]
        self.own, self.tables = [], []
        for s in samples.values():
            values, counts = np.unique(s[s > 0], return_counts=True)
            kept = values[np.argsort(-counts, kind="stable")][:letters]
            own = np.ones(2 + len(known), np.int32)
            own[0] = 0
            own[dense[kept]] = 2 + np.arange(len(kept))
            self.own.append(own)
            self.tables.append(Automaton(own[dense[s]].tolist(), 2 + len(kept)).table)
        self.bits = np.array([np.log2(max(2, len(s))) for s in samples.values()])

    def entropies(self, data: np.ndarray, offsets: np.ndarray):
        """Bits per symbol of each document under each language, and its number of letters and gaps."""
        symbols, at = symbols_of(data, offsets, self.lookup)
        n = np.diff(at)
        counts = [phrases(t, own[symbols], at[:-1], n) for t, own in zip(self.tables, self.own, strict=True)]
        return np.stack(counts) * self.bits[:, None] / np.maximum(n, 1), n


def held_out(doc_id: str = "doc_id", folds: int = 3, fold: int = 1):
    """Whether a document is kept from learning: crc32 of its doc_id as text, modulo `folds`, is `fold`."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold


def fit(docs: DataFrame, sample_symbols: int = SAMPLE_SYMBOLS, sample_documents: int = SAMPLE_DOCUMENTS, letters: int = LETTERS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learn from a bounded sample of labelled rows: about `sample_documents` a language, each with an equal share of
    `sample_symbols` characters from a place in it that a hash decides on.

    Rows are chosen by a hash of the text, so copies of a text come once. Rows with a null text, lang or doc_id are
    left out. The sample is all that comes to the driver, and all that comes is used.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").filter(~held_out())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model({}, sample_symbols, letters)
    by_lang = lambda of: F.create_map(*(F.lit(x) for lang_, n in sorted(counts.items()) for x in (lang_, of(n))))[F.col("lang")]
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.withColumn("draw", draw).filter(F.col("draw") < by_lang(lambda n: min(1.0, sample_documents / n)))
    chars = by_lang(lambda n: -(-sample_symbols // min(n, sample_documents)))
    place = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - chars + 1, F.lit(1)).cast("long"))
    cut = chosen.select("lang", "draw", F.substring(F.col("text"), place.cast("int") + 1, chars.cast("int")).alias("text")).collect()
    texts: dict[str, list[str]] = {}
    for _, lang_, t in sorted({(r["draw"], r["lang"], r["text"]) for r in cut}):
        texts.setdefault(lang_, []).append(t)
    return Model(texts, sample_symbols, letters)


class Predictor:
    """A model as a Python worker applies it."""

    def __init__(self, model: Model):
        self.model = model
        self.names = np.array([*model.languages, "und"], dtype=object)

    def block(self, data: np.ndarray, offsets: np.ndarray):
        """Languages, scores, bits per symbol, and whether there is no language, of a block of documents."""
        n = len(offsets) - 1
        if not self.model.languages or not len(data):
            return np.full(n, "und", dtype=object), np.zeros(n), np.zeros(n), np.ones(n, bool)
        bits, symbols = self.model.entropies(data, offsets)
        best = np.argmin(bits, axis=0)
        least = bits[best, np.arange(n)]
        rest = bits.copy()
        rest[best, np.arange(n)] = np.inf
        score = 1 - least / np.maximum(rest.min(axis=0), 1e-12) if len(bits) > 1 else np.ones(n)
        none = symbols == 0
        return self.names[np.where(none, len(self.model.languages), best)], np.where(none, 0.0, np.clip(score, 0, 1)), least, none


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, lang_pred, score (0 to 1) and bits (cross entropy per symbol under lang_pred).

    The score is how much lower the best language's entropy is than the next one's, as a share of the latter; 1 with
    a single language. A null text, one without a letter, or any text where no language was learned is `und` with
    score 0 and null bits. Ties go to the language first in order. Repeated rows give repeated rows; an empty table
    gives none; other columns are ignored. Map-only; the model is broadcast, its size bounded by `fit`'s parameters
    per language.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        predictor = Predictor(shared.value)
        for ids, data, offsets in text_blocks(batches, BLOCK):
            names, score, least, none = predictor.block(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(names.tolist(), pa.string()), pa.array(score), pa.array(least, mask=none)],
                names=["doc_id", "lang_pred", "score", "bits"],
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(freeing(run), "doc_id long, lang_pred string, score double, bits double")


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **bounds) -> DataFrame:
    """Fit on the rows that are not held out and predict all: doc_id, held_out, lang_pred, score, bits."""
    model = fit(docs, doc_id=doc_id, text=text, lang=lang, **bounds)
    return predict(docs, model, doc_id, text).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "bits")


def identified(docs: DataFrame, model: Model, languages: list[str] | None = None, text: str = "text") -> DataFrame:
    """The documents whose language is found to be one of `languages`, by default any learned one; columns as given.

    Null texts and texts without a letter go. Map-only: rows are filtered where they are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    wanted = set(model.languages if languages is None else languages)
    place = docs.columns.index(text)

    def run(batches):
        predictor = Predictor(shared.value)
        for batch in batches:
            keep = [n in wanted for _, data, offsets in text_blocks([batch.select([place, place])], BLOCK) for n in predictor.block(data, offsets)[0]]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(freeing(run), docs.schema)
