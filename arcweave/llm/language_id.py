"""Language identification with string kernels.

The kernel of two texts counts the distinct n-grams of 1 to 3 code points that both have (a blended spectrum of presences),
divided by the geometric mean of their numbers. n-grams are those of lower-cased words with a space at either end.
Landmarks Z are some of the learned texts; with K the kernel among them, Nyström's map of a text x is
k(x, Z) K**(-1/2), on which a kernel ridge regression for each language against the rest is solved. A batch of texts is
scored by two matrix products: presences with the landmarks' presences, and the kernel rows so gained with the
coefficients. Only n-grams that some landmark has are looked at, so the matrices have a bounded width.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcweave.llm.frames import crc_mod, removed, slices, stored, table
from arcweave.llm.textkit import decoded

#: Learned texts on average, as many of each language; landmarks, dealt likewise, of at most so many code points each;
#: languages at most; the ridge.
TRAIN_ROWS, LANDMARKS, LONGEST, LANGUAGES, RIDGE = 6_000, 128, 20_000, 1_000, 0.1
#: Cells of a presence matrix, and of the table that numbers n-grams (beyond it they are searched).
CELLS, DIRECT = 1 << 21, 1 << 22
_FOLD = [np.zeros(0, np.uint32)]


def folded(points: np.ndarray) -> np.ndarray:
    """Letters in lower case where that is one code point, all else as 0."""
    known = _FOLD[0]
    if not len(known):  # built once in a worker, by Python's own rules; far planes on demand
        known = np.array([ord(low) if len(low := chr(c).lower()) == 1 else c if chr(c).isalpha() else 0 for c in range(0x10000)], np.uint32)
        known[[c for c in range(0x10000) if not chr(c).isalpha()]] = 0
        _FOLD[0] = known
    out = known[np.minimum(points, 0xFFFF)]
    far = np.flatnonzero(points > 0xFFFF)
    if len(far):
        kinds, at = np.unique(points[far], return_inverse=True)
        out[far] = np.array([0 if not chr(c).isalpha() else ord(low) if len(low := chr(c).lower()) == 1 else c for c in kinds.tolist()], np.uint32)[at]
    return out


def grams(signs: np.ndarray, offsets: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, n-gram) of all n-grams of 1 to 3 signs within words, a space (0) at either end of a word; `base` exceeds all signs.

    An n-gram's number is its signs in that base, above a leading n, so that no two share one."""
    n, b = len(offsets) - 1, np.int64(base)
    # a space before each text and after the last; more than one in a row come to nothing below
    text = np.repeat(np.arange(n), np.diff(offsets))
    x = np.zeros(len(signs) + n + 1, np.int64)
    own = np.zeros(len(x), np.int64)
    at = np.arange(len(signs)) + text + 1
    x[at], own[at] = signs, text
    letter = x > 0
    one, two, three = np.flatnonzero(letter), np.flatnonzero(letter[:-1] | letter[1:]), np.flatnonzero(letter[1:-1])
    keys = [x[one], b * b + x[two] * b + x[two + 1], b * b * b + (x[three] * b + x[three + 1]) * b + x[three + 2]]
    return np.concatenate([own[one], np.where(letter[two], own[two], own[two + 1]), own[three + 1]]), np.concatenate(keys)


class Landmarks:
    """The texts that others are compared with: their letters, numbered n-grams and presences."""

    def __init__(self, texts: list[str]):
        points = [folded(np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32)) for t in texts]
        flat = np.concatenate([np.zeros(0, np.uint32), *points])
        self.letters = np.unique(flat[flat > 0])
        self.base = len(self.letters) + 2  # 0: a space, 1: a letter that no landmark has
        off = np.append(0, np.cumsum([len(p) for p in points], dtype=np.int64))
        text, key = grams(self._signs(flat), off, self.base)
        self.keys, at = np.unique(key, return_inverse=True)
        self.has = np.zeros((len(texts), len(self.keys)), bool)
        self.has[text, at] = True
        self.size = np.maximum(self.has.sum(1), 1).astype(np.float32)

    def _signs(self, letters: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.letters, letters)
        same = self.letters[np.minimum(at, len(self.letters) - 1)] == letters if len(self.letters) else np.zeros(len(letters), bool)
        return np.where(letters == 0, 0, np.where(same, at + 2, 1)).astype(np.int64)

    def opened(self) -> "Landmarks":
        """With the tables that a worker uses; they are not broadcast."""
        if not hasattr(self, "matrix"):
            self.matrix = np.ascontiguousarray(self.has.T, np.float32)
            top = 2 * self.base**3
            self.number = None
            if top <= DIRECT:
                self.number = np.full(top, len(self.keys), np.int32)
                self.number[self.keys] = np.arange(len(self.keys))
            low = self.letters[self.letters <= 0xFFFF]
            self.sign = np.ones(0x10000, np.int64)
            self.sign[0], self.sign[low] = 0, np.searchsorted(self.letters, low) + 2
        return self

    def numbered(self, key: np.ndarray) -> np.ndarray:
        """Columns of n-grams; one past the last for an unknown one."""
        if self.number is not None:
            return self.number[key]
        if not len(self.keys):
            return np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, len(self.keys))

    def rows(self, data: np.ndarray, off: np.ndarray):
        """(first text, text after the last, whether each has a letter, kernel rows) for some texts of a slice at a time."""
        points, at = decoded(data, off)
        letters = folded(points)
        signs = self.sign[letters] if not len(letters) or letters.max() <= 0xFFFF else self._signs(letters)
        total = np.append(0, np.cumsum(letters > 0))
        some = total[at[1:]] > total[at[:-1]]
        wide = len(self.keys) + 1
        step = max(1, CELLS // wide)
        for lo in range(0, len(at) - 1, step):
            hi = min(lo + step, len(at) - 1)
            text, key = grams(signs[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], self.base)
            x = np.zeros((hi - lo) * wide, bool)
            x[text * wide + self.numbered(key)] = True
            x = x.reshape(hi - lo, wide)[:, :-1]
            size = np.maximum(x.sum(1), 1).astype(np.float32)
            yield lo, hi, some[lo:hi], (x.astype(np.float32) @ self.matrix) / np.sqrt(size[:, None] * self.size)


class Model:
    """Landmarks, and for each language (sorted) a column of coefficients and an intercept."""

    def __init__(self, landmarks: Landmarks, languages: list[str], coefficients: np.ndarray, intercepts: np.ndarray):
        self.landmarks, self.languages, self.coefficients, self.intercepts = landmarks, languages, coefficients, intercepts

    def decisions(self, kernel: np.ndarray) -> np.ndarray:
        """-1 to 1 or so for each language."""
        return kernel @ self.coefficients + self.intercepts


def solved(landmarks: Landmarks, kernel: np.ndarray, label: np.ndarray, languages: list[str], ridge: float = RIDGE) -> Model:
    """One-versus-rest ridge regression on Nyström's map, from kernel rows of learned texts and their languages' numbers."""
    z = landmarks.has.astype(np.float64)
    size = landmarks.size.astype(np.float64)
    values, vectors = np.linalg.eigh(z @ z.T / np.sqrt(size[:, None] * size)) if len(z) else (np.zeros(0), np.zeros((0, 0)))
    good = values > 1e-8 * max(values.max(initial=0), 1e-300)
    root = vectors[:, good] / np.sqrt(values[good])
    phi = kernel.astype(np.float64) @ root
    y = np.where(label[:, None] == np.arange(len(languages)), 1.0, -1.0)
    middle, mean = phi.mean(0), y.mean(0)
    own = phi - middle
    w = np.linalg.solve(own.T @ own + ridge * np.eye(own.shape[1]), own.T @ (y - mean))
    return Model(landmarks, languages, (root @ w).astype(np.float32), (mean - middle @ w).astype(np.float32))


def _kernel_rows(landmarks):
    def run(batches):
        own = landmarks.value.opened()
        for b in batches:
            for lo, hi, data, off in slices(b):
                for a, z, some, k in own.rows(data, off):
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, k.size + 1, max(k.shape[1], 1), dtype=np.int32) if k.shape[1] else np.zeros(z - a + 1, np.int32)), pa.array(k.ravel()))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo + a, z - a), pa.array(some), flat], ["lang", "some", "k"])

    return run


def train(learned: DataFrame, rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """A model of the rows (text, lang) of `learned`; rows without either, and texts without letters, teach nothing.

    A hash of the row picks about rows / languages rows of each language (all, if it has fewer) and of these
    landmarks / languages that are not longer than LONGEST code points, those with the smallest hashes. What the driver
    gets is bounded by these numbers: the landmarks' texts and a kernel row for each learned text. None without rows; more
    than LANGUAGES languages raise an error. Repeated rows count once or together, as their hashes are equal."""
    spark = learned.sparkSession
    known = learned.filter("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang"))
    counts = {r.lang: r.c for r in known.groupBy("lang").agg(F.count("*").alias("c")).limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not counts:
        return None
    share = spark.createDataFrame([(name, min(1.0, rows / len(counts) / c)) for name, c in counts.items()], "lang string, share double")
    hashed = known.withColumn("u", F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / float(1 << 40))
    sample, path = stored(hashed.join(F.broadcast(share), "lang").filter("u < share").select("lang", "text", "u"))
    first = Window.partitionBy("lang").orderBy("u", "text")
    short = sample.filter((F.length("text") <= LONGEST) & F.col("text").rlike(r"\p{L}")).dropDuplicates(["lang", "text"])
    chosen = short.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= max(1, landmarks // len(counts))).orderBy("lang", "r").select("text").limit(max(landmarks, len(counts))).collect()
    marks = Landmarks([r.text for r in chosen])
    sent = spark.sparkContext.broadcast(marks)
    got = sample.select("lang", "text").mapInArrow(_kernel_rows(sent), "lang string, some boolean, k array<float>").filter("some").toPandas()
    removed(spark, path)
    if not len(got):
        return None
    got = got.assign(key=[np.asarray(k, np.float32).tobytes() for k in got.k]).sort_values(["lang", "key"])  # sums in one order, whatever the tasks
    languages = sorted(set(got.lang))
    kernel = np.stack([np.asarray(k, np.float32) for k in got.k]) if len(marks.has) else np.zeros((len(got), 0), np.float32)
    return solved(marks, kernel, np.searchsorted(languages, got.lang.to_numpy(str)) if len(languages) else np.zeros(0, int), languages, ridge)


def languages(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score of each row: the language of the largest decision value d (ties: the first by name), and
    (d + 1) / 2, cut to 0 and 1.

    Null texts and those without a letter, and all without a model, are `und` with score 0. Null ids and repeated rows
    stay; other columns are left out; an empty table gives an empty result; texts are read whole."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        own = m.landmarks.opened() if m else None
        for b in batches:
            for lo, hi, data, off in slices(b):
                if not m:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(["und"] * (hi - lo)), pa.array(np.zeros(hi - lo))], ["doc_id", "lang_pred", "score"])
                    continue
                for a, z, some, k in own.rows(data, off):
                    d = m.decisions(k)
                    best = d.argmax(1)
                    name = [m.languages[x] if s else "und" for x, s in zip(best.tolist(), some.tolist())]
                    score = np.where(some, np.clip((d[np.arange(len(d)), best].astype(np.float64) + 1) / 2, 0, 1), 0.0)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo + a, z - a), pa.array(name, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op12_language_id(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those whose crc32 of the id modulo 4 is not 2: nulls, ties, repeated rows and empty tables as in languages() and train()."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(crc_mod("doc_id", 4) != 2).select("text", "lang"))
    return languages(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
