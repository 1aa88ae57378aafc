"""Language identification: sparse multinomial logistic regression over TF-IDF character n-grams.

Trained online with follow-the-regularised-leader and an elastic net, so that most weights are exactly zero, and
calibrated with one temperature. Document frequencies come from all learnable documents; the regression itself is
fitted on a bounded sample.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeflow.llm.arrays import mix
from citeflow.llm.frames import by_batch, col, free_name

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Bound of the fitted sample: documents of each language (chosen by a hash), and passes over them.
SAMPLE_PER_LANGUAGE = 1500
PASSES = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.001
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the lower-cased letters of a whole text and their counts; everything else is one space."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[code]
    if not letter.any():
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32)
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    chars = np.where(letter, code, 32)[keep].astype(np.uint64)
    chars = np.concatenate([[np.uint64(32)], chars, [np.uint64(32)]])
    grams = []
    for order in ORDERS:
        gram = np.full(len(chars) - order + 1, order, dtype=np.uint64)
        for k in range(order):
            gram = gram * np.uint64(0x110001) + chars[k : len(chars) - order + 1 + k]
        grams.append(mix(gram) % np.uint64(BUCKETS))
    counts = np.bincount(np.concatenate(grams).astype(np.int64), minlength=BUCKETS)
    buckets = np.flatnonzero(counts)
    return buckets.astype(np.int32), counts[buckets].astype(np.float32)


@dataclass
class LanguageModel:
    languages: list[str] = field(default_factory=list)
    idf: np.ndarray = field(default_factory=lambda: np.ones(BUCKETS, dtype=np.float32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), dtype=np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.float32))
    temperature: float = 1.0

    def values(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[buckets]
        return x / max(float(np.linalg.norm(x)), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float]:
        buckets, counts = ngrams(text)
        if not len(buckets) or not self.languages:
            return UNKNOWN, 0.0
        chances = softmax((self.values(buckets, counts) @ self.weights[buckets] + self.bias) / self.temperature)
        best = int(chances.argmax())
        return self.languages[best], float(chances[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def document_frequencies(texts: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many of the texts each bucket occurs, counted over all of them and added up per task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in batches:
            for value in batch.column(0):
                seen[ngrams(value.as_py())[0]] += 1
                rows += 1
        buckets = np.flatnonzero(seen)
        yield pa.record_batch({"bucket": pa.array([-1, *buckets.tolist()]), "n": pa.array([rows, *seen[buckets].tolist()])})

    parts = texts.select(col(text)).mapInArrow(count, "bucket bigint, n bigint")
    table = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    found = np.zeros(BUCKETS, dtype=np.int64)
    rows = int(table.loc[table.bucket == -1, "n"].sum())
    table = table[table.bucket >= 0]
    found[table.bucket.to_numpy(dtype=np.int64)] = table.n
    return found, rows


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by follow-the-regularised-leader, one example at a time; L1 and L2 act on each weight."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))
    bias, bias_n = np.zeros(classes), np.zeros(classes)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    order = np.random.default_rng(0)
    for _ in range(PASSES):
        for k in order.permutation(len(rows)):
            buckets, x, target = rows[k]
            w = weights(z[buckets], n[buckets])
            error = softmax(x @ w + bias)
            error[target] -= 1
            gradient = x[:, None] * error
            grown = n[buckets] + gradient**2
            z[buckets] += gradient - (np.sqrt(grown) - np.sqrt(n[buckets])) / ALPHA * w
            n[buckets] = grown
            bias_n += error**2
            bias -= 0.1 * error / (1 + np.sqrt(bias_n))
    return weights(z, n).astype(np.float32), bias.astype(np.float32)


def fit_temperature(logits: np.ndarray, targets: np.ndarray) -> float:
    """The temperature of the least log-loss, by golden-section search over its logarithm."""
    if not len(targets):
        return 1.0

    def loss(log_t: float) -> float:
        return -float(np.log(softmax(logits / np.exp(log_t))[np.arange(len(targets)), targets] + 1e-12).mean())

    low, high, golden = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    while high - low > 1e-3:
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(
    docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE
) -> LanguageModel:
    """Fit on rows with a language; texts without letters teach nothing. No such row: a model that knows no language."""
    known = docs.select(col(key).alias("key"), col(text).alias("text"), col(lang).alias("lang"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageModel()
    found, rows = document_frequencies(known, "text")
    model = LanguageModel(sorted(counts), np.log((1 + rows) / (1 + found)).astype(np.float32) + 1)

    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            made = [ngrams(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays(
                [pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.float32()))],
                names=["buckets", "counts"],
            )

    place = F.xxhash64(F.lit("language"), "key")
    share = F.lit(1.0)
    for name, n in counts.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, per_language / n))).otherwise(share)
    chosen = known.where(F.pmod(place, F.lit(1 << 30)) < share * (1 << 30)).withColumn("place", place)
    chosen = chosen.select("lang", "place", by_batch(features, "struct<buckets:array<int>,counts:array<float>>", F.col("text")).alias("f"))
    rows_, held = [], []
    sample = chosen.select("lang", "place", "f.*").toArrow().sort_by([("place", "ascending"), ("lang", "ascending")])
    places, names = sample["place"].to_pylist(), sample["lang"].to_pylist()
    for place_, name, b, c in zip(places, names, sample["buckets"], sample["counts"], strict=True):
        buckets = b.values.to_numpy()
        if len(buckets):
            part = held if place_ // (1 << 30) % 5 == 0 else rows_
            part.append((buckets, model.values(buckets, c.values.to_numpy()), model.languages.index(name)))
    model.weights, model.bias = fit_ftrl(rows_ or held, len(model.languages))
    if held:
        logits = np.stack([x @ model.weights[b] + model.bias for b, x, _ in held])
        model.temperature = fit_temperature(logits, np.array([t for *_, t in held]))
    return model


def identify(text: Column, model: LanguageModel) -> Column:
    """``lang`` and ``score`` of each text; ``und`` with score 0 for null and for texts without a letter."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [model.predict(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays(
                [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["lang", "score"],
            )

    return by_batch(run, "struct<lang:string,score:double>", text)


def add_language(
    docs: DataFrame, model: LanguageModel, text: str = "text", lang: str = "lang_pred", score: str = "score"
) -> DataFrame:
    """Add the predicted language and its calibrated probability to every row, whole texts, no shuffle.

    Existing columns of these names are replaced; repeated rows get equal answers; ties go to the first language in
    alphabetical order.
    """
    name = free_name(docs, "_language")
    kept = [col(c) for c in docs.columns if c.lower() not in (lang.lower(), score.lower())]
    found = docs.select("*", identify(col(text), model).alias(name))
    return found.select(*kept, F.col(f"{name}.lang").alias(lang), F.col(f"{name}.score").alias(score))
