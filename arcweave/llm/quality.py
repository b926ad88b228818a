"""Quality by ordinal regression on graded ratings.

One vector of weights over hashed text features gives each document a place on a line; ordered thresholds
cut the line into grades: P(grade > k) = sigmoid(w.x - theta[k]). Selection uses the expected grade and
the tail probability of reaching a grade.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm.frames import crc_mod, slices, table, written
from arcweave.llm.textkit import ALNUM, U, words

#: Buckets of hashed words, then of byte-class trigrams, then a few measures of the whole text.
WORDS, KINDS = 1 << 18, 40
SIZE = WORDS + KINDS**3 + 8
#: Rated documents that the model is fitted on at most, those with the smallest hashes of their ids.
TRAIN_ROWS = 8_000


def _kinds() -> np.ndarray:
    """Letters by case, digits, blanks, line ends, each ASCII sign by itself, other bytes."""
    out = np.zeros(256, np.int64)
    out[97:123], out[65:91], out[48:58], out[128:] = 1, 2, 3, 4
    out[32] = out[9] = 5
    out[10] = out[13] = 6
    signs = [b for b in range(33, 127) if not chr(b).isalnum()]
    out[signs] = 7 + np.arange(len(signs)) % (KINDS - 7)
    return out


KIND = _kinds()


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value), sorted by text and feature; each family is scaled to unit length within a text."""
    n = len(off) - 1
    w = words(data, off, True, ALNUM)
    doc = w.text_of()
    size = np.diff(off)
    kind = KIND[data]
    own = np.repeat(np.arange(n), size)
    tri = kind[:-2] * KINDS**2 + kind[1:-1] * KINDS + kind[2:] if len(kind) > 2 else np.zeros(0, np.int64)
    inside = own[:-2] == own[2:] if len(kind) > 2 else np.zeros(0, bool)
    parts = []
    for t, f in ((doc, (w.hash & U(WORDS - 1)).astype(np.int64)), (own[:-2][inside], WORDS + tri[inside])):
        key, count = np.unique(t * SIZE + f, return_counts=True)
        t, f, v = key // SIZE, key % SIZE, np.sqrt(count)
        norm = np.sqrt(np.bincount(t, v * v, n))
        parts.append((t, f, v / norm[t]))
    again = np.zeros(len(w.hash))
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    distinct = np.bincount(parts[0][0], minlength=n)
    count = np.maximum(w.counts, 1)
    letters = np.bincount(own, (kind == 1) | (kind == 2) | (kind == 4), n) / np.maximum(size, 1)
    upper = np.bincount(own, kind == 2, n) / np.maximum(size, 1)
    measures = [np.ones(n), np.log1p(w.counts) / 8, np.bincount(doc, again, n) / count, distinct / count, letters, upper, (size == 0) * 1.0, size / count / 16]
    parts.append((np.tile(np.arange(n), 8), np.repeat(SIZE - 8 + np.arange(8), n), np.concatenate(measures)))
    t, f, v = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((f, t))
    return t[order], f[order], v[order]


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, text: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """P(grade > k) for each text and threshold k."""
        z = np.bincount(text, self.weights[feature] * value, n)
        return 1 / (1 + np.exp(np.clip(self.thresholds[None] - z[:, None], -40, 40)))


def fit(text: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int, steps: int = 200, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Adam on the mean log likelihood of the grades. Thresholds are a first one plus positive gaps, so they stay ordered."""
    n, k = len(grade), grades - 1
    if not n:
        return Model(np.zeros(SIZE), np.arange(k, dtype=float))
    used, inv = np.unique(feature, return_inverse=True)
    share = np.clip([(grade > i).mean() for i in range(k)], 0.01, 0.99)
    cut = np.log((1 - share) / share)
    gap = np.log(np.maximum(np.diff(cut), 0.05))
    x = np.concatenate([np.zeros(len(used)), cut[:1], gap])
    mom, var = np.zeros(len(x)), np.zeros(len(x))
    for step in range(1, steps + 1):
        grad = slope(x, len(used), text, inv, value, grade, grades, decay)
        mom, var = 0.9 * mom + 0.1 * grad, 0.99 * var + 0.01 * grad * grad
        x += rate * (mom / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-5)
    weights = np.zeros(SIZE)
    weights[used] = x[: len(used)]
    return Model(weights, x[len(used)] + np.append(0, np.cumsum(np.exp(x[len(used) + 1 :]))))


def slope(x: np.ndarray, m: int, text: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int, decay: float) -> np.ndarray:
    """Gradient of the mean log likelihood of the grades less decay / 2 of the squared weights, at x: m weights, the first
    threshold, and logs of the gaps between thresholds."""
    n, rows = len(grade), np.arange(len(grade))
    w, gaps = x[:m], np.exp(x[m + 1 :])
    theta = x[m] + np.append(0, np.cumsum(gaps))
    z = np.bincount(text, w[feature] * value, n)
    s = 1 / (1 + np.exp(np.clip(theta[None] - z[:, None], -40, 40)))  # P(grade > i)
    full = np.hstack([np.ones((n, 1)), s, np.zeros((n, 1))])
    p = np.maximum(full[rows, grade] - full[rows, grade + 1], 1e-9)
    curve = np.hstack([np.zeros((n, 1)), s * (1 - s), np.zeros((n, 1))])
    dz = (curve[rows, grade] - curve[rows, grade + 1]) / p / n
    dt = np.zeros(grades + 1)
    np.add.at(dt, grade, -curve[rows, grade] / p / n)
    np.add.at(dt, grade + 1, curve[rows, grade + 1] / p / n)
    dt = dt[1:-1]
    return np.concatenate([np.bincount(feature, dz[text] * value, m) - decay * w, [dt.sum()], np.cumsum(dt[::-1])[::-1][1:] * gaps])


def train(docs: DataFrame, ratings: DataFrame, grades: int, rows: int = TRAIN_ROWS) -> Model:
    """Fits on rated documents (doc_id, grade from 0) whose crc32(doc_id) mod 4 is not 2, `rows` of them at most.

    Null ids and grades are left out; of several grades of one document, or of equal texts, the lowest counts; copies
    count once. Without any ratings all texts get the same tails. The driver gets the features of `rows` texts, as many
    for each as it has different words and trigrams, SIZE at most."""
    known = ratings.filter("doc_id is not null and grade is not null").filter(crc_mod("doc_id", 4) != 2)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("grade").cast("int")).alias("grade"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")  # at most `rows` narrow rows

    def encode(batches):
        for b in batches:
            for lo, hi, data, off in slices(b):
                t, f, v = features(data, off)
                cut = np.searchsorted(t, np.arange(hi - lo + 1))
                lists = [pa.array([x[s:e].tobytes() for s, e in zip(cut[:-1], cut[1:])], pa.binary()) for x in (f.astype(np.int32), v.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([b.column(1).slice(lo, hi - lo), *lists], ["grade", "f", "v"])

    got = written(own.groupBy("text").agg(F.min("grade").alias("grade")).mapInArrow(encode, "grade int, f binary, v binary")).toPandas()
    counts = [len(x) // 4 for x in got.f]
    flat = lambda x, t: np.concatenate([np.zeros(0, t), *(np.frombuffer(y, t) for y in x)])
    return fit(np.repeat(np.arange(len(got)), counts), flat(got.f, np.int32), flat(got.v, np.float32), got.grade.to_numpy(np.int64), grades)


def score(docs: DataFrame, model: Model, grade: int = 1, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, expected_grade, tail (P(grade >= `grade`)) and keep (tail >= threshold) of each row.

    Null and empty texts are scored by their lack of words; null ids and repeated rows like others; an empty
    table gives an empty result. Texts are read whole. The model's size is fixed."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    def run(batches):
        own = Model(*shared.value)
        for b in batches:
            for lo, hi, data, off in slices(b):
                p = own.tails(*features(data, off), hi - lo)
                tail = p[:, grade - 1]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(p.sum(1)), pa.array(tail), pa.array(tail >= threshold)], ["doc_id", "held_out", "expected_grade", "tail", "keep"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", 4) == 2).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, expected_grade double, tail double, keep boolean")


def graded(labels: DataFrame) -> DataFrame:
    """Ratings from 0 to 2: poor, fair but toxic, good."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2).alias("grade"))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """score() of all documents by train() on graded() labels: nulls, ties, repeated rows and empty tables as stated there."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, graded(table(spark, sf_dir, "labels")), 3))
