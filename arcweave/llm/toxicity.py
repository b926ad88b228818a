"""Toxicity by multiple-instance learning.

Sentences are the instances: each has a score from its words, kept as hashes, and a document's score is their noisy-or,
1 - prod(1 - p). Weights are trained from document labels alone, by gradient steps on the document
likelihood, so the sentences at fault are found without ever being labelled. A sentence without any word that
counts adds nothing to a score, so that length alone never makes a text toxic. Only words whose presence goes with toxic documents count: what
speaks for a clean text can't take back what another sentence says, so such words have no weight.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm.frames import crc_mod, removed, slices, stored, table
from arcweave.llm.textkit import ALNUM, U, words

#: Labelled documents that the model is fitted on at most, those with the smallest hashes of their ids. All words in them
#: are looked at; one is a feature if its presence goes with toxic documents by a likelihood ratio G of at least
#: ln(distinct words), so that chance alone brings in few.
TRAIN_ROWS = 20_000
BREAK = np.zeros(256, bool)
BREAK[[10, 33, 46, 63]] = True  # newline ! . ?


def instances(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its sentence, the text of each sentence, first byte of each sentence).

    A word is a run of letters and digits; a sentence ends at . ! ? or a line's end. Empty texts have none."""
    w = words(data, off, True, ALNUM)
    ends = np.zeros(len(data) + 1, np.int64)
    np.cumsum(BREAK[data], out=ends[1:])
    mark = ends[w.start] + w.text_of()  # grows at each break and at each text
    new = np.ones(len(mark), bool)
    new[1:] = mark[1:] != mark[:-1]
    sentence = np.cumsum(new) - 1
    return w.hash, sentence, w.text_of()[new], w.start[new]


def noisy_or(z: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """1 - prod(1 - sigmoid(z)) over the sentences of each of n texts; 0 without any."""
    return -np.expm1(np.bincount(text, -np.logaddexp(0, z), n))


class Model:
    """Sorted hashes of the words that count, their weights, and the weight of any sentence."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        self.keys, self.weights, self.bias = keys, weights, bias

    def logits(self, word: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        """Of each of n sentences; -inf for one without any word that counts. Where no word counts, all follow the more frequent label."""
        if not len(self.keys):
            return np.full(n, self.bias if self.bias > 0 else -np.inf)
        at = np.minimum(np.searchsorted(self.keys, word), len(self.keys) - 1)
        own = np.flatnonzero(self.keys[at] == word)
        z = np.full(n, -np.inf)
        z[sentence[own]] = self.bias
        return z + np.bincount(sentence[own], self.weights[at[own]], n)


def fit(keys: np.ndarray, word: np.ndarray, sentence: np.ndarray, text: np.ndarray, label: np.ndarray, steps: int = 200, rate: float = 0.1, decay: float = 1e-3) -> Model:
    """Adam on the mean log likelihood of document labels; weights shrink towards 0.

    word and sentence: for each occurrence its number in `keys` and its sentence; text: of each sentence."""
    n, m = len(label), len(text)
    positive = label > 0.5
    if not positive.any() or positive.all():
        share = float(np.clip(label.mean() if n else 0.0, 1e-4, 1 - 1e-4))
        return Model(np.zeros(0, U), np.zeros(0), float(np.log(share / (1 - share))))
    x, mom, var = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)
    x[-1] = -5.0
    for step in range(1, steps + 1):
        grad = slope(x, word, sentence, text, positive, decay)
        mom, var = 0.9 * mom + 0.1 * grad, 0.99 * var + 0.01 * grad * grad
        x += rate * (mom / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-6)
    return Model(keys, x[:-1], float(x[-1]))


def slope(x: np.ndarray, word: np.ndarray, sentence: np.ndarray, text: np.ndarray, positive: np.ndarray, decay: float) -> np.ndarray:
    """Gradient, at weights and bias x, of the mean log likelihood of the labels less decay / 2n of the squared weights."""
    n, m = len(positive), len(text)
    z = x[-1] + np.bincount(sentence, x[word], m)
    p = 1 / (1 + np.exp(-z))
    doc = np.clip(noisy_or(z, text, n), 1e-9, 1 - 1e-9)
    d = p * np.where(positive, (1 - doc) / doc, -1.0)[text] / n
    return np.append(np.bincount(word, d[sentence], len(x) - 1) - decay * x[:-1] / n, d.sum())


def _present(batches):
    """(word, toxic documents, clean documents) with it, summed over each slice."""
    for b in batches:
        toxic = b.column(1).to_numpy() > 0.5
        for lo, hi, data, off in slices(b):
            word, sentence, text, _ = instances(data, off)
            order = np.lexsort((word, doc := text[sentence]))
            word, doc = word[order], doc[order]
            new = np.ones(len(word), bool)
            new[1:] = (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])
            keys, inv = np.unique(word[new], return_inverse=True)
            a = np.bincount(inv, toxic[lo:hi][doc[new]], len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(a), pa.array(np.bincount(inv, minlength=len(keys)) - a)], ["word", "a", "b"])


def evidence(rows: DataFrame) -> np.ndarray:
    """Sorted hashes of all words whose presence in a document goes with label 1."""
    p, q = (x or 0 for x in rows.agg(F.sum("y"), F.sum(1 - F.col("y"))).first())
    counts = rows.select("text", "y").mapInArrow(_present, "word long, a long, b long").groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    part = lambda x, total, both: f"if({x} > 0, 2 * {x} * ln({x} * {p + q}D / (({both}) * {total}D)), 0D)"
    g = " + ".join([part("a", p, "a + b"), part("b", q, "a + b"), part(f"({p}D - a)", p, f"{p + q}D - a - b"), part(f"({q}D - b)", q, f"{p + q}D - a - b")])
    counts = counts.withColumn("g", F.expr(f"if(a * {q}D > b * {p}D, {g}, 0D)"))
    counts, at = stored(counts.select("word", "g"))
    least = float(np.log(max(counts.count(), 2)))
    found = counts.filter(F.col("g") >= least).select("word").toPandas()
    removed(rows.sparkSession, at)
    return np.sort(found.word.to_numpy(np.int64).view(U))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fits on the labelled documents whose crc32(doc_id) mod 4 is not 2, `rows` of them at most; copies count once.

    Null labels and ids are left out; several labels of one document, or of equal texts, count as toxic if one does.
    Other columns don't matter; without any labels, or with equal ones only, all texts score alike. The driver
    gets no texts, only the occurrences of words with evidence."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(crc_mod("doc_id", 4) != 2)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("double")).alias("y"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")  # at most `rows` narrow rows
    own, at = stored(own.groupBy("text").agg(F.max("y").alias("y")))
    keys = evidence(own)

    def encode(batches):
        for b in batches:
            for lo, hi, data, off in slices(b):
                word, sentence, text, _ = instances(data, off)
                at = np.minimum(np.searchsorted(keys, word), max(len(keys) - 1, 0))
                hit = np.flatnonzero(keys[at] == word) if len(keys) else np.zeros(0, np.int64)
                count = np.bincount(text, minlength=hi - lo)
                first = np.cumsum(count) - count
                doc = text[sentence[hit]]
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                at, local = at[hit].astype(np.int32), (sentence[hit] - first[doc]).astype(np.int32)
                lists = [pa.array([x[s:e].tobytes() for s, e in zip(cut[:-1], cut[1:])], pa.binary()) for x in (at, local)]
                yield pa.RecordBatch.from_arrays([b.column(1).slice(lo, hi - lo), pa.array(count), *lists], ["y", "sentences", "word", "sentence"])

    got = own.mapInArrow(encode, "y double, sentences long, word binary, sentence binary").toPandas()
    removed(docs.sparkSession, at)
    counts = got.sentences.to_numpy(np.int64)
    first = np.cumsum(counts) - counts
    none = np.zeros(0, np.int64)
    word = np.concatenate([none, *(np.frombuffer(x, np.int32) for x in got.word)])
    sentence = np.concatenate([none, *(np.frombuffer(x, np.int32) + f for x, f in zip(got.sentence, first))])
    return fit(keys, word, sentence, np.repeat(np.arange(len(counts)), counts), got.y.to_numpy(float))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, and the worst sentence with its score and first byte, for each row.

    Null and empty texts have no sentence and score 0, as do texts without any word that counts. Null ids and repeated rows are scored like others;
    an empty table gives an empty result. Texts are read whole. The model's size is fixed."""
    shared = docs.sparkSession.sparkContext.broadcast((model.keys, model.weights, model.bias))

    def run(batches):
        own = Model(*shared.value)
        for b in batches:
            for lo, hi, data, off in slices(b):
                n = hi - lo
                word, sentence, text, start = instances(data, off)
                z = own.logits(word, sentence, len(text))
                p = noisy_or(z, text, n)
                order = np.lexsort((-np.arange(len(z)), z, text))
                last = np.searchsorted(text[order], np.arange(n), "right") - 1
                has = np.bincount(text, minlength=n) > 0
                worst = order[np.maximum(last, 0)] if len(order) else np.zeros(n, np.int64)
                raw = data.tobytes()
                found, begin = [], []
                for r in range(n):
                    if not has[r]:
                        found.append(None)
                        begin.append(None)
                        continue
                    s = int(start[worst[r]])
                    stop = int(off[r + 1])
                    if worst[r] + 1 < len(start) and text[worst[r] + 1] == r:
                        stop = int(start[worst[r] + 1])
                    found.append(raw[s:stop].decode("utf-8", "replace").strip())
                    begin.append(s - int(off[r]))
                top = np.where(has, 1 / (1 + np.exp(-z[worst])) if len(z) else 0.0, 0.0)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), b.column(1).slice(lo, n), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(found, pa.string()), pa.array(top), pa.array(begin, pa.int64())], ["doc_id", "held_out", "score", "predicted", "worst_sentence", "worst_score", "worst_byte"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", 4) == 2).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, worst_sentence string, worst_score double, worst_byte long")


def remove_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs` whose score is below the threshold, with all their columns. Null and empty texts stay, as do
    repeated rows and null ids; an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast((model.keys, model.weights, model.bias))

    def run(batches):
        own = Model(*shared.value)
        for b in batches:
            for lo, hi, data, off in slices(b):
                word, sentence, text, _ = instances(data, off)
                keep = noisy_or(own.logits(word, sentence, len(text)), text, hi - lo) < threshold
                yield b.slice(lo, hi - lo).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """score() of all documents by train() on `labels`: nulls, ties, repeated rows and empty tables as stated there."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
