"""Token counts: a broadcast table of frequent pre-tokens, worker caches for the rest, no shuffle of the texts' pre-tokens.

The table is fitted on a bounded sample of rows, whose pre-tokens alone are counted in Spark. It decides what a worker
need not encode itself and no result: every pre-token of every text is looked up or encoded, and compared sign by sign.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm.bpe import Lengths, encoder
from arcweave.llm.frames import slices, table
from arcweave.llm.textkit import decoded

#: Entries of the broadcast table, code points of each at most, and rows of the random sample that it is fitted on (mean).
FREQUENT, LONGEST, FIT_ROWS = 65_536, 64, 2_000


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pieces(path: str):
    """Counts whole texts with the sentencepiece library."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(batches):
        for b in batches:
            for lo, hi, data, off in slices(b):
                raw = data.tobytes()
                texts = [raw[off[i] : off[i + 1]].decode("utf-8", "replace") for i in range(hi - lo)]
                yield np.array([len(x) for x in model.encode(texts, num_threads=1)], np.int64), off, b.slice(lo, hi - lo)

    return count


def _offer(path: str):
    """The pre-tokens of each Arrow batch: hash, count, text, number of tokens."""

    def run(batches):
        e = encoder(path)
        for b in batches:
            counts: dict[str, int] = {}
            hashes: dict[str, int] = {}
            for _, _, data, off in slices(b):
                points, at = decoded(data, off)
                _, start, end, h = e.pretokens(points, at)
                keys, first, found = np.unique(h, return_index=True, return_counts=True)
                for k, i, c in zip(keys.tolist(), first.tolist(), found.tolist()):
                    if end[i] - start[i] <= LONGEST:
                        t = points[start[i] : end[i]].tobytes().decode("utf-32-le")
                        counts[t] = counts.get(t, 0) + c
                        hashes[t] = k
            if counts:
                tokens = [len(e.single(t.encode())) for t in counts]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(list(hashes.values()), np.uint64).view(np.int64)), pa.array(list(counts.values()), pa.int64()), pa.array(list(counts)), pa.array(tokens, pa.int32())], ["h", "c", "t", "n"])

    return run


def frequent(docs: DataFrame, path: str, rows: int = FIT_ROWS) -> Lengths | None:
    """The first tier: lengths of the pre-tokens that a random sample of about `rows` rows has most often; None where the
    file is not plain byte-level BPE.

    What is counted follows the sample and not the table. No count of tokens depends on what is in it."""
    if encoder(path).single is None:
        return None
    total = docs.count()
    own = docs.select("text") if total <= rows else docs.select("text").sample(rows / total, seed=1)
    offers = own.mapInArrow(_offer(path), "h long, c long, t string, n int")
    got = offers.groupBy("t").agg(F.sum("c").alias("c"), F.first("h").alias("h"), F.first("n").alias("n")).orderBy(F.desc("c"), "t").limit(FREQUENT).select("h", "t", "n").toPandas()
    return Lengths(got.h.to_numpy(np.int64).view(np.uint64), got.t.tolist(), got.n.to_numpy(np.int64))


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of `docs`, as the library for the file `path` counts.

    Null and empty texts have 0 bytes and 0 tokens; null ids and repeated rows stay as they are; other
    columns are left out. An empty table gives an empty result. Texts of any length are counted whole."""
    path = path or default_path()
    spark = docs.sparkSession
    if path.endswith(".model"):

        def run(batches):
            for counts, off, rows in _pieces(path)(batches):
                yield _out(rows, off, counts, limit)
    else:
        first = spark.sparkContext.broadcast(frequent(docs, path))

        def run(batches):
            e, lengths = encoder(path), first.value
            for b in batches:
                for lo, hi, data, off in slices(b):
                    points, at = decoded(data, off)
                    counts, _ = e.encode(data, off, points, at, want_ids=False, lengths=lengths)
                    yield _out(b.slice(lo, hi - lo), off, counts, limit)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def _out(rows: pa.RecordBatch, off: np.ndarray, counts: np.ndarray, limit: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(off)), pa.array(counts), pa.array(counts > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """token_counts() of all documents: nulls, ties, repeated rows and empty tables as stated there."""
    return token_counts(table(spark, sf_dir, "documents"))
