"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all learning texts. A bounded sample of them trains the weights with
follow-the-regularised-leader (proximal, one learning rate for each weight, L1 and L2 penalties: weights that the
data do not need stay exactly zero). A part of the sample that training does not see sets the temperature that
makes the winning probability mean what it says.
"""
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import blocks as tb
from tidemark.llm.folds import remainder, thinned

BUCKETS = 1 << 13
ORDERS = (1, 2, 3)
# Learning texts of each language at most (expected), chosen by a hash of doc_id; whole texts each.
TRAIN_TEXTS = 1_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
CALIBRATION_SHARE = 5                     # one text in so many sets the temperature
UNKNOWN = "und"
BLOCK_BYTES = tb.BLOCK_BYTES
_FACTORS = np.random.default_rng(61).integers(0, 2**31, 2 * max(ORDERS), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A line of n-gram counts by bucket for each text, and which texts have a letter.

    Texts are lower-cased; white space counts as one character, also before and behind a text.
    """
    low = [" " + (t or "").lower() + " " for t in texts]
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    points[(points >= 9) & (points <= 13)] = 32
    rows = np.repeat(np.arange(len(low)), sizes)
    out = np.zeros(len(low) * BUCKETS, np.int64)
    for order in ORDERS:
        n = len(points) - order + 1
        if n <= 0:
            continue
        key = np.zeros(n, np.uint32)
        for k in range(order):
            key = (key ^ points[k:k + n]) * _FACTORS[k + order - 1]
            key ^= key >> np.uint32(15)
        whole = rows[:n] == rows[order - 1:]
        out += np.bincount((rows[:n] * BUCKETS + (key >> np.uint32(32 - 13)))[whole], minlength=len(out))
    first = np.cumsum(sizes) - sizes
    found = np.logical_or.reduceat(letters()[points], first) if len(low) else np.zeros(0, bool)
    return out.reshape(len(low), BUCKETS), found


def weighed(lines: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of log term frequency times inverse document frequency."""
    x = np.log1p(lines).astype(np.float32) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


@dataclass(frozen=True)
class Model:
    """Languages, idf by bucket, weights (bucket and bias, language) and the temperature."""

    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def probabilities(self, lines: np.ndarray) -> np.ndarray:
        scores = (weighed(lines, self.idf) @ self.weights[:-1] + self.weights[-1]) / self.temperature
        scores = np.exp(scores - scores.max(1, keepdims=True))
        return scores / scores.sum(1, keepdims=True)


def ftrl(samples: list[tuple[np.ndarray, np.ndarray, int]], n_weights: int, n_classes: int) -> np.ndarray:
    """Weights after EPOCHS passes over (places, values, class); the last place is the bias and free of penalties."""
    z, n = np.zeros((n_weights, n_classes)), np.zeros((n_weights, n_classes))

    def weights(at) -> np.ndarray:
        free = (at == n_weights - 1)[:, None]
        l1, l2 = np.where(free, 0, L1), np.where(free, 0, L2)
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((BETA + np.sqrt(n[at])) / ALPHA + l2))

    for _ in range(EPOCHS):
        for at, value, label in samples:
            w = weights(at)
            scores = value @ w
            p = np.exp(scores - scores.max())
            p /= p.sum()
            p[label] -= 1
            g = value[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(n_weights))


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm; 1 without examples."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        s = scores / np.exp(log_t)
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(labels)), labels]).mean())

    a, b, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(BUCKETS, np.int64), 0
    for block in tb.blocks(batches, "text", BLOCK_BYTES):
        lines, _ = counts(block.column("text").to_pylist())
        total += (lines > 0).sum(0)
        n += len(lines)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], n), pa.int64())], names=["bucket", "n"])


def fit(docs: DataFrame) -> Model:
    """Model from (doc_id, text, lang); rows with a null text or lang are left out.

    Document frequencies cover every row; about TRAIN_TEXTS texts of each language train the weights.
    """
    rows = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    seen = {r["bucket"]: r["n"] for r in rows.select("text").mapInArrow(_frequencies, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    total = seen.pop(-1, 0)
    idf = np.full(BUCKETS, np.log(1.0 + total) + 1, np.float32)
    idf[list(seen)] = np.log((1.0 + total) / (1.0 + np.array(list(seen.values()), float))) + 1 if seen else 0

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches, "text", BLOCK_BYTES):
            x = weighed(counts(block.column("text").to_pylist())[0], idf)
            r, c = np.nonzero(x)
            yield pa.RecordBatch.from_arrays([block.column("turn"), block.column("lang").cast(pa.string()), tb.lists(c, r, len(x), pa.int32()), tb.lists(x[r, c], r, len(x), pa.float32())],
                                             names=["turn", "lang", "at", "value"])

    sample = thinned(rows, "lang", TRAIN_TEXTS).select(F.xxhash64("doc_id", "text", F.lit(9)).alias("turn"), "text", "lang")
    made = sample.mapInArrow(lines, "turn bigint, lang string, at array<int>, value array<float>").toArrow().sort_by([("turn", "ascending"), ("lang", "ascending")])
    languages = tuple(sorted(set(made["lang"].to_pylist())))
    if not languages:
        return Model((), idf, np.zeros((BUCKETS + 1, 0), np.float32), 1.0)
    number = {name: k for k, name in enumerate(languages)}
    samples = []
    for at, value, lang in zip(made["at"], made["value"], made["lang"].to_pylist()):
        samples.append((np.append(at.values.to_numpy(), BUCKETS), np.append(value.values.to_numpy(), 1).astype(float), number[lang]))
    held = samples[::CALIBRATION_SHARE] if len(samples) >= 10 * CALIBRATION_SHARE else []
    learn = [s for k, s in enumerate(samples) if not held or k % CALIBRATION_SHARE]
    weights = ftrl(learn, BUCKETS + 1, len(languages))
    scores = np.array([value @ weights[at] for at, value, _ in held]).reshape(len(held), len(languages))
    return Model(languages, idf, weights.astype(np.float32), temperature(scores, np.array([k for _, _, k in held], int)))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) -> (doc_id, lang_pred, score): the likeliest language and its calibrated probability.

    `und` with score 0 for a null text, a text without a letter, or a model that has learned no language.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches, "text", BLOCK_BYTES):
            lines, known = counts(block.column("text").to_pylist())
            if model.languages:
                p = model.probabilities(lines)
                names, best = [model.languages[k] for k in p.argmax(1)], np.where(known, p.max(1), 0.0)
            else:
                names, best, known = [UNKNOWN] * len(known), np.zeros(len(known)), known & False
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array([n if k else UNKNOWN for n, k in zip(names, known.tolist())], pa.string()),
                                              pa.array(best.astype(float), pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def held_out(df: DataFrame) -> DataFrame:
    """Adds held_out: whether a row is of the fold that training does not see."""
    return df.withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)))
