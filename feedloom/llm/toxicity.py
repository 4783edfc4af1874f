"""Toxicity by compression distance.

zstandard trains one dictionary on ordinary text and one on the passages that set toxic text apart. A document is cut
into short windows of whole words; where the toxic dictionary makes a window shorter than the ordinary one does, it
holds something toxic text says. A logistic calibration turns the gains of all windows into a probability. It is
fitted on gains by dictionaries that were trained without the document in question.
"""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing, text_blocks, word_spans
from .simhash import _joined

#: Bounds on the labelled sample, documented parameters of `fit`: documents a class, characters of each.
SAMPLE_DOCUMENTS = 3000
SAMPLE_CHARS = 6000
#: Bytes after which the next word opens a window.
WINDOW = 32
#: A byte string of GRAM bytes is telling if at least LEAST_SHARE of the toxic documents have it, LEAST_RATIO times the
#: share of the ordinary ones, and these shares lie LEAST_Z standard deviations apart. Chosen by cross-validation within
#: the rows that are learned from.
GRAM, LEAST_SHARE, LEAST_RATIO, LEAST_Z = 5, 0.03, 2.0, 4.5
#: Words of toxic text that hold telling strings, so many to a training sample.
PASSAGE_WORDS = 3
#: Bytes of the dictionaries of ordinary and of toxic text, and of the segments and strings the trainer looks at.
ORDINARY_BYTES, TOXIC_BYTES, SEGMENT, STRING = 6144, 1024, 24, 6
#: Ordinary windows that train a dictionary at most, a bound on the fit.
TRAINING_WINDOWS = 60_000
#: Parts of the labelled texts; each is judged by dictionaries of the others for the calibration.
FOLDS = 3
#: Probability from which a document is predicted toxic.
THRESHOLD = 0.3


def _norm(text: str) -> bytes:
    return b" ".join(text.encode().lower().split())


def _strings(words) -> set[bytes]:
    return {w[i : i + GRAM] for w in words for i in range(len(w) - GRAM + 1)}


class Model:
    """Dictionaries and calibration, learned from labelled texts."""

    def __init__(self, toxic: list[str], ordinary: list[str]):
        self.weights = None
        self.prior = len(toxic) / max(1, len(toxic) + len(ordinary))
        if not toxic or not ordinary:
            return
        texts = [_norm(t) for t in toxic + ordinary]
        label = np.repeat([1, 0], [len(toxic), len(ordinary)])
        fold = np.array([crc32(t) % FOLDS for t in texts])
        x = np.zeros((len(texts), 9))
        for f in range(FOLDS):
            # a fold without enough texts of both classes outside it is judged by dictionaries of all texts
            rest = fold != f if len(np.unique(label[fold != f])) == 2 else np.ones(len(texts), bool)
            self._learn(texts, label, rest)
            x[fold == f] = self.features([t for t, k in zip(texts, fold, strict=True) if k == f])
        self._learn(texts, label, np.ones(len(texts), bool))
        y = label.astype(float)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        x = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        w = np.zeros(x.shape[1])
        for _ in range(50):  # Newton steps of a ridge logistic regression
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w)), x.T @ (y - p) - 0.5 * w)
        self.weights = w

    def _learn(self, texts: list[bytes], label: np.ndarray, chosen: np.ndarray) -> None:
        """Train both dictionaries on the chosen texts."""
        toxic, ordinary = ([t for t, l, c in zip(texts, label, chosen, strict=True) if c and l == side] for side in (1, 0))
        plain = self._windows(ordinary)
        step = -(-len(plain) // TRAINING_WINDOWS)
        self.ordinary = self._train(plain[::step], ORDINARY_BYTES)
        # the toxic compressor knows ordinary text as well, so that only what is toxic changes a length
        self.toxic = self.ordinary + self._train(self._passages(toxic, ordinary), TOXIC_BYTES)

    @staticmethod
    def _passages(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
        """Runs of the words of toxic texts that hold telling strings, the samples of the toxic dictionary."""
        seen = [Counter(), Counter()]
        for c, texts in enumerate((ordinary, toxic)):
            for t in texts:
                seen[c].update(_strings(set(t.split())))
        n0, n1 = len(ordinary), len(toxic)
        telling = set()
        for g, k in seen[1].items():
            m = seen[0].get(g, 0)
            p = (m + k) / (n0 + n1)
            z = (k / n1 - m / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
            if k >= LEAST_SHARE * n1 and k / n1 >= LEAST_RATIO * (m + 0.5) / n0 and z >= LEAST_Z:
                telling.add(g)
        out = []
        for t in toxic:
            hits = [w for w in t.split() if not telling.isdisjoint(_strings([w]))]
            out += [b" " + b" ".join(hits[i : i + PASSAGE_WORDS]) for i in range(0, len(hits), PASSAGE_WORDS)]
        return out

    def recalibrate(self, share: float) -> None:
        """Move the intercept from the sample's share of toxic documents to the labelled rows' own."""
        if self.weights is not None and 0 < share < 1:
            odds = lambda p: np.log(p / (1 - p))
            self.weights[-1] += odds(share) - odds(self.prior)
        self.prior = share

    @staticmethod
    def _windows(texts: list[bytes]) -> list[bytes]:
        return [w for t in texts for w in _cut(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]]

    @staticmethod
    def _train(samples: list[bytes], size: int) -> bytes:
        """The content of a dictionary that zstandard trains, the most useful at its end, without its header and tables.

        A trainer that finds the samples too few gets them several times over. Without any sample nothing is learned.
        """
        import zstandard

        if not any(samples):
            return b""
        for times in (1, 4, 16, 64, 256):
            try:
                raw = zstandard.train_dictionary(size + 1024, samples * times, k=SEGMENT, d=STRING).as_bytes()
                break
            except (zstandard.ZstdError, ValueError):
                continue
        else:
            raise ValueError(f"{len(samples)} samples of {sum(map(len, samples))} bytes train no dictionary")
        every, start = b"".join(samples), 8
        while start < len(raw) and raw[start : start + SEGMENT // 2] not in every:
            start += 1
        return raw[start:][-size:]

    def compressors(self):
        import zstandard

        out = []
        for raw in (self.ordinary, self.toxic):
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            p = zstandard.ZstdCompressionParameters.from_level(6, dict_size=len(raw), source_size=64, min_match=3, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
            d.precompute_compress(compression_params=p)
            out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress)
        return out

    def features(self, texts: list[bytes]) -> np.ndarray:
        data = np.frombuffer(b"".join(texts), np.uint8)
        return self.block_features(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]), self.compressors())

    def block_features(self, data: np.ndarray, offsets: np.ndarray, compressors) -> np.ndarray:
        """Per document: its three largest gains, the number of windows and of those with some gain, and their mean."""
        n = len(offsets) - 1
        out = np.zeros((n, 9))
        if not len(data):
            return out
        windows, of = _cut(data, offsets)
        if not windows:
            return out
        plain, toxic = compressors
        gain = np.fromiter((len(plain(w)) - len(toxic(w)) for w in windows), np.float64, len(windows))
        order = np.lexsort((-gain, of))
        rank = np.arange(len(gain)) - np.searchsorted(of, of[order])
        for r in range(3):
            top = order[rank == r]
            out[of[top], r] = gain[top]
        count = np.bincount(of, minlength=n)
        some = np.maximum(count, 1)
        out[:, 3] = np.log1p(count)
        for column, least in ((4, 2), (5, 4), (6, 6)):
            out[:, column] = np.log1p(np.bincount(of, weights=gain >= least, minlength=n))
        out[:, 7] = np.bincount(of, weights=gain, minlength=n) / some
        out[:, 8] = np.bincount(of, weights=gain >= 4, minlength=n) / some
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray, compressors) -> np.ndarray:
        x = (self.block_features(data, offsets, compressors) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ self.weights, -30, 30)))


def _cut(data: np.ndarray, offsets: np.ndarray):
    """Windows of whole words of a block of documents, lower-cased, and the document of each."""
    text, at = _joined(data, offsets)
    starts, ends, first = word_spans(text, at)
    if not len(starts):
        return [], np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    cell = (starts - at[:-1][doc]) // WINDOW
    opens = np.ones(len(starts), bool)
    opens[1:] = (cell[1:] != cell[:-1]) | (doc[1:] != doc[:-1])
    k = np.flatnonzero(opens)
    to = ends[np.append(k[1:], len(starts)) - 1]
    raw = text.tobytes()
    return [raw[a:b] for a, b in zip(starts[k].tolist(), to.tolist(), strict=True)], doc[k]


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its doc_id as text, modulo 4, is 2."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Learn from at most about `sample_documents` labelled texts a class, `sample_chars` characters of each.

    Rows are chosen by a hash of doc_id; equal texts count once. Labels other than 0 and 1, and null texts, are left
    out; a doc_id with both labels is toxic. The sample is all that comes to the driver.
    """
    known = labels.select("doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not counts:
        return Model([], [])
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, sample_documents / counts.get(1, 1)))).otherwise(F.lit(min(1.0, sample_documents / counts.get(0, 1))))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.withColumn("draw", draw).filter(F.col("draw") < share)
    rows = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").select("toxic", "draw", F.substring("text", 1, sample_chars).alias("text")).collect()
    texts: dict[int, dict[str, None]] = {0: {}, 1: {}}
    for r in sorted((r["draw"], r["toxic"], r["text"]) for r in rows):
        texts[r[1]].setdefault(r[2])
    model = Model(list(texts[1])[:sample_documents], list(texts[0])[:sample_documents])
    model.recalibrate(counts.get(1, 0) / sum(counts.values()))
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, score (0 to 1) and predicted (1 from `threshold` on), over its whole text.

    A null text scores like an empty one. Where no toxic or no ordinary label was learned, every score is the labelled
    share of toxic rows. Repeated rows give repeated rows; an empty table gives none; other columns are ignored.
    Map-only; the broadcast model has two dictionaries of bounded size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        compressors = m.compressors() if m.weights is not None else None
        for ids, data, offsets in text_blocks(batches):
            s = m.scores(data, offsets, compressors) if compressors else np.full(len(ids), float(m.prior))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(freeing(run), "doc_id long, score double, predicted int")


def assess(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """Fit on the rows that are not held out and score all: doc_id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels, **bounds))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
