"""Categories by a trained model: one-vs-rest logistic regression over sublinear TF-IDF, with class weights.

The table of texts stays where it is: each step sends the weights to the tasks, which return the sums of their rows'
gradients; these are added up by feature before the driver sees them. Features are the most frequent terms and pairs of
terms, so weights and gradients have a bound. Training stops when macro-F1 on rows kept aside no longer rises.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import text as X
from ..sources.shared import dropped, written
from .batches import in_pieces
from .evaluate import macro_f1

#: Features at most, texts a feature is in at least, steps at most, and steps without a better score after which it ends.
WIDTH, LEAST_TEXTS, STEPS, PATIENCE = 20_000, 2, 40, 4
#: Strength of the penalty on weights, a row; and one in so many rows judges when to stop.
PENALTY, ASIDE = 1e-4, 5
#: Terms and pairs, or features, that a worker takes at once.
GRAMS_AT_ONCE = 1 << 16


def grams(text: Column) -> Column:
    """Terms of a text that are no stop words, and pairs of terms that follow one another."""
    found = F.regexp_extract_all(X.normalise(text), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))
    kept = F.filter(found, lambda t: ~t.isin(X.STOP_WORDS))
    return X.let(kept, lambda w: F.concat(w, F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))))


class Model:
    """Labels, features with their inverse document frequencies, and a row of weights (the bias last) for each label."""

    def __init__(self, labels: list[str], vocabulary: dict[str, int], idf: np.ndarray, weights: np.ndarray):
        if weights.shape != (len(labels), len(vocabulary) + 1) or len(idf) != len(vocabulary):
            raise ValueError(f"weights of {weights.shape} do not fit {len(labels)} labels and {len(vocabulary)} features")
        self.labels, self.vocabulary, self.idf, self.weights = labels, vocabulary, idf, weights

    def dumps(self) -> bytes:
        return json.dumps({"labels": self.labels, "vocabulary": self.vocabulary, "idf": self.idf.tolist(), "weights": self.weights.tolist()}).encode()

    @classmethod
    def loads(cls, raw: bytes) -> Model:
        m = json.loads(raw)
        return cls(m["labels"], m["vocabulary"], np.array(m["idf"]), np.array(m["weights"]))

    def probabilities(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        z = np.stack([self.weights[:, i] @ v + self.weights[:, -1] for i, v in rows]) if rows else np.zeros((0, len(self.labels)))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return p / p.sum(axis=1, keepdims=True)


def _vector(words: list[str], vocabulary: dict[str, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and their weights (1 + ln tf) idf, of unit length."""
    found, tf = np.unique([vocabulary[w] for w in words if w in vocabulary], return_counts=True)
    v = (1 + np.log(tf)) * idf[found.astype(int)]
    return found.astype(int), v / (np.sqrt((v**2).sum()) or 1.0)


def features(texts: DataFrame, width: int = WIDTH, least_texts: int = LEAST_TEXTS, text: str = "text") -> tuple[dict[str, int], np.ndarray]:
    """The `width` terms and pairs that most texts have (ties: the smaller), and their idf."""
    n = texts.count()
    df = texts.select(F.explode(F.array_distinct(grams(F.col(text)))).alias("g")).groupBy("g").agg(F.count("*").alias("df")).filter(F.col("df") >= least_texts)
    top = df.orderBy(F.desc("df"), "g").limit(width).collect()  # width at most
    return {r["g"]: k for k, r in enumerate(top)}, np.log((1.0 + n) / (1.0 + np.array([r["df"] for r in top], float))) + 1


def _gradient(shared, labels: int):
    def run(batches):
        import pyarrow as pa

        weights, share = shared.value
        total = np.zeros_like(weights)
        for batch in in_pieces(batches, 2, GRAMS_AT_ONCE):
            for label, i, v in zip(batch.column("label").to_pylist(), batch.column("i"), batch.column("v"), strict=True):
                i, v = i.values.to_numpy(), v.values.to_numpy()
                z = weights[:, i] @ v + weights[:, -1]
                off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - (np.arange(labels) == label)) * share[np.arange(labels), (np.arange(labels) == label).astype(int)]
                total[:, i] += off[:, None] * v
                total[:, -1] += off
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total.ravel()[cell])], names=["cell", "value"])

    return run


def fit(rows: DataFrame, label: str = "label", text: str = "text", key: str = "id", width: int = WIDTH, steps: int = STEPS) -> tuple[Model, list[float]]:
    """A model of rows (key, label, text), and macro-F1 on the rows kept aside after each step.

    Rows are kept aside by a hash of their key. Of a label's rows and all others each side weighs half, so rare labels
    count. Null labels and texts are left out; there must be two labels.
    """
    spark = rows.sparkSession
    given = rows.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("string").alias("id"), F.col(label).alias("label"), F.col(text).alias("text"))
    given = written(given.withColumn("aside", F.pmod(F.xxhash64("id"), F.lit(ASIDE)) == 0), "labelled")
    counts = {r["label"]: r["count"] for r in given.filter("NOT aside").groupBy("label").count().collect()}
    labels = sorted(counts)
    if len(labels) < 2:
        raise ValueError("a model needs two labels")
    vocabulary, idf = features(given.filter("NOT aside"), width)
    shared, numbered = spark.sparkContext.broadcast((vocabulary, idf)), {k: i for i, k in enumerate(labels)}

    def vectors(batches):
        import pyarrow as pa

        for batch in in_pieces(batches, 2, GRAMS_AT_ONCE):
            pairs = [_vector(w, *shared.value) for w in batch.column("words").to_pylist()]
            lists = [pa.array([p[k] for p in pairs], pa.list_(t)) for k, t in ((0, pa.int64()), (1, pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("aside"), pa.array([numbered.get(x, -1) for x in batch.column("truth").to_pylist()], pa.int64()), *lists, batch.column("truth")], names=["aside", "label", "i", "v", "truth"])

    words = given.select("aside", F.col("label").alias("truth"), grams(F.col("text")).alias("words"))
    data = written(words.mapInArrow(vectors, "aside boolean, label long, i array<long>, v array<double>, truth string"), "vectors")
    train, aside = data.filter("NOT aside"), data.filter("aside")
    n = sum(counts.values())
    own = np.array([counts[k] for k in labels], float)
    share = np.stack([0.5 / np.maximum(n - own, 1), 0.5 / own], axis=1) * n  # of the other labels' rows, of its own
    weights, before = np.zeros((len(labels), len(vocabulary) + 1)), np.zeros((len(labels), len(vocabulary) + 1))
    best, worse, history = (-1.0, weights), 0, []
    for step in range(1, steps + 1):
        ahead = weights + (step - 1) / (step + 2) * (weights - before)  # Nesterov's step
        sums = train.mapInArrow(_gradient(spark.sparkContext.broadcast((ahead, share)), len(labels)), "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
        found = np.array([tuple(r) for r in sums.collect()]).reshape(-1, 2)  # labels x features at most
        gradient = np.zeros(weights.size)
        gradient[found[:, 0].astype(int)] = found[:, 1]
        before, weights = weights, ahead - 4.0 * (gradient.reshape(weights.shape) / n + PENALTY * ahead)
        model = Model(labels, vocabulary, idf, weights)
        score = macro_f1(_judged(aside, model)).agg(F.avg("f1")).first()[0] or 0.0
        history.append(score)
        if score >= best[0]:  # later weights are surer at the same score
            best, worse = (score, weights), 0
        elif (worse := worse + 1) >= PATIENCE:
            break
    dropped(given, data)
    return Model(labels, vocabulary, idf, best[1]), history


def _judged(data: DataFrame, model: Model) -> DataFrame:
    shared = data.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in in_pieces(batches, 2, GRAMS_AT_ONCE):
            m = shared.value
            p = m.probabilities([(i.values.to_numpy(), v.values.to_numpy()) for i, v in zip(batch.column("i"), batch.column("v"), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("truth"), pa.array([m.labels[k] for k in p.argmax(axis=1)] if len(p) else [], pa.string())], names=["truth", "predicted"])

    return data.mapInArrow(run, "truth string, predicted string")


def classify(texts: DataFrame, model: Model, least: float = DEFAULT.category_threshold, id_: str = "id", text: str = "text") -> DataFrame:
    """(id, category, probability) of every text: the likeliest label, null below `least`; map-only. Null texts are empty."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    rows = texts.select(F.col(id_).alias("id"), grams(F.coalesce(F.col(text), F.lit(""))).alias("words"))

    def run(batches):
        import pyarrow as pa

        for batch in in_pieces(batches, 1, GRAMS_AT_ONCE):
            m = shared.value
            p = m.probabilities([_vector(w, m.vocabulary, m.idf) for w in batch.column("words").to_pylist()])
            top = p.max(axis=1) if len(p) else np.zeros(0)
            names = [m.labels[k] if x >= least else None for k, x in zip(p.argmax(axis=1) if len(p) else [], top, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names, pa.string()), pa.array(top)], names=["id", "category", "probability"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, category string, probability double")
