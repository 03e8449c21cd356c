"""A quality classifier learned from positives and unlabelled text.

Trusted positives are labelled rows of quality 1; the unlabelled set is a sample of all documents,
whatever their labels. The class prior is estimated from the two, and a linear model minimises the
non-negative unbiased risk: prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)).
Features of a text are counted on all of it: shares of byte classes, the shape of its words, and the
shares of its words by their hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capspark.llm.session import bound_batches, give_back

#: Rows at most that the fit sees; they are the only ones that come to the driver.
MAX_POSITIVES = 4000
MAX_UNLABELLED = 8000
THRESHOLD = 0.3
FOLDS = 5
STEPS = 400
_BYTES = 129  # ASCII, and one for all other bytes
SHAPES = _BYTES + 7
WORDS = 256  # classes of words by their hashes
DIM = SHAPES + WORDS
#: Words are scaled down by this after standardising: a class has many words, few of which tell anything.
DAMP = 3.0


class _Classes(dict):
    """word -> its class, whatever the case of A-Z; forgotten as a whole when it gets too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 50_000:
            self.clear()
        k = self[word] = (xxhash.xxh3_64_intdigest(word.lower()) >> 32) % WORDS
        return k


_classes = _Classes()


def features(text: str | None) -> np.ndarray:
    data = (text or "").encode()
    out = np.zeros(DIM, np.float32)
    words = data.split()
    if not words:
        out[SHAPES - 1] = 1
        return out
    byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    out[:128] = np.sqrt(byte[:128] / len(data))
    out[128] = np.sqrt(byte[128:].sum() / len(data))
    n = len(words)
    distinct = len(set(words))
    again = sum(map(bytes.__eq__, words, words[1:]))
    letters = int(byte[65:91].sum() + byte[97:123].sum()) or 1
    marks = int(byte[33:48].sum() + byte[58:65].sum() + byte[91:97].sum() + byte[123:127].sum())
    classes = np.fromiter(map(_classes.__getitem__, words), np.int64, n)
    out[SHAPES:] = np.sqrt(np.bincount(classes, minlength=WORDS) / n)
    out[_BYTES : SHAPES - 1] = (np.log1p(distinct) / np.log1p(n), np.sqrt(again / n), np.sqrt(byte[65:91].sum() / letters), marks / n, len(data) / n / 10, byte[10] / n)
    return out


def featurer():
    """text -> the DIM features as the bytes of 32-bit floats."""

    def make(texts: pa.Array) -> pa.Array:
        return pa.array([features(t).astype("<f4").tobytes() for t in texts.to_pylist()], pa.binary())

    return F.arrow_udf(make, "binary").asNondeterministic()


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale).clip(-8, 8) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _soft(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _adam(x_p: np.ndarray, x_u: np.ndarray, gradient, steps: int = STEPS, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Minimise over (weight, bias); gradient(z_p, z_u) has the risk's slopes in the margins."""
    w = np.zeros(x_p.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g_p, g_u = gradient(x_p @ w[:-1] + w[-1], x_u @ w[:-1] + w[-1])
        g = np.append(x_p.T @ g_p + x_u.T @ g_u + decay * w[:-1], g_p.sum() + g_u.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(x_p: np.ndarray, x_u: np.ndarray) -> float:
    """The share of positives among the unlabelled: a classifier of positive against unlabelled is
    fitted on one half; on the other, the smallest ratio of the shares of unlabelled and of
    positives above a score, with a margin for chance, bounds the share from above."""
    fit_p, fit_u, p, u = x_p[::2], x_u[::2], x_p[1::2], x_u[1::2]

    def gradient(z_p, z_u):
        return (_soft(z_p) - 1) / len(z_p), _soft(z_u) / len(z_u)

    w, b = _adam(fit_p, fit_u, gradient, steps=200)
    s_p, s_u = np.sort(p @ w + b), np.sort(u @ w + b)
    at = np.unique(s_p)
    q_p = 1 - np.searchsorted(s_p, at) / len(s_p)
    q_u = 1 - np.searchsorted(s_u, at) / len(s_u)
    margin = np.sqrt(np.log(40) / 2) * (len(s_p) ** -0.5 + len(s_u) ** -0.5)
    use = q_p > 2 * margin
    if not use.any():  # too few rows to bound it
        return 0.95
    best = np.argmin((q_u[use] + margin) / q_p[use])
    return float(np.clip(q_u[use][best] / q_p[use][best], 0.05, 0.95))


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> Model:
    """positives, unlabelled: rows of features. With under 20 positives or unlabelled rows nothing
    can be learned: the model then gives every text its prior (1 without any), so nothing is lost."""
    if len(positives) < 20 or len(unlabelled) < 20:
        return Model(np.zeros(DIM), np.ones(DIM), np.zeros(DIM), 3.0, 0.95)
    n = len(positives) + len(unlabelled)
    mean = sum(x.sum(0, dtype=np.float64) for x in (positives, unlabelled)) / n
    scale = np.sqrt(sum(((x - mean) ** 2).sum(0) for x in (positives, unlabelled)) / n) + 1e-3
    scale[SHAPES:] *= DAMP
    x_p, x_u = (((x - mean) / scale).clip(-8, 8) for x in (positives, unlabelled))
    prior = estimate_prior(x_p, x_u) if prior is None else prior

    def gradient(z_p, z_u):
        """Slopes of the non-negative risk with the logistic loss. Where the negative part falls
        below zero, only it is followed, upwards."""
        n_p, n_u = len(z_p), len(z_u)
        negative = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
        g_u, g_p = _soft(z_u) / n_u, -prior * _soft(z_p) / n_p
        if negative < 0:
            return -g_p, -g_u
        return g_p + prior * (_soft(z_p) - 1) / n_p, g_u

    w, b = _adam(x_p, x_u, gradient)
    return Model(mean, scale, w, b, prior)


def held_out(doc_id: Column) -> Column:
    """Whether a row's label is kept for the test: crc32 of the id as text is a multiple of FOLDS."""
    return F.crc32(doc_id.cast("string")) % FOLDS == 0


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Fit on at most max_positives rows labelled 1 and max_unlabelled rows of any kind, none held
    out: those of the least hashes of their ids. Only their features come to the driver. Rows with a
    null id are not learned from, null texts count as empty; of rows that share an id each counts, at
    most twice as many rows in all as the two limits together. Labels are good where any row of the
    id says 1; other columns and an empty table do no harm (see fit for too few rows)."""
    bound_batches(docs.sparkSession)
    ids = docs.select(F.col(id_col).cast("long").alias("id")).filter(F.col("id").isNotNull() & ~held_out(F.col("id")))
    good = labels.filter(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("id")).filter(~held_out(F.col("id"))).distinct()

    def least(x: DataFrame, n: int, kind: str) -> DataFrame:
        return x.select("id", F.xxhash64("id", F.lit(kind)).alias("h")).orderBy("h").limit(n).select("id", F.lit(kind).alias("kind"))

    chosen = least(ids.join(good, "id", "left_semi"), max_positives, "p").unionByName(least(ids, max_unlabelled, "u"))
    chosen = chosen.groupBy("id").agg(F.collect_set("kind").alias("kinds"))  # at most max_positives + max_unlabelled rows
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "id")
    got = rows.select("id", "kinds", featurer()("t").alias("x")).orderBy("id", "x").limit(2 * (max_positives + max_unlabelled)).collect()
    p, u = (np.frombuffer(b"".join(r["x"] for r in got if k in r["kinds"]), "<f4").reshape(-1, DIM) for k in "pu")
    del got
    return fit(p, u)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col (double, 0 to 1; a column of that name is replaced): how likely each
    whole text is good. A null text counts as an empty one, which has a score too. Repeated rows
    score alike; an empty table gives no rows; no shuffle."""
    bound_batches(docs.sparkSession)

    def rate(texts: pa.Array) -> pa.Array:
        give_back()
        rows = [features(t) for t in texts.to_pylist()]
        return pa.array(model.score(np.stack(rows).astype(np.float64)) if rows else np.empty(0), pa.float64())

    return docs.withColumn(score_col, F.arrow_udf(rate, "double").asNondeterministic()(text_col))
