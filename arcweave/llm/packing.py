"""Best-two-fit packing of token sequences.

Documents become pieces of at most `capacity` tokens where they are read. Full pieces are sequences of
their own; the rest is dealt at random into groups of a fixed mean size, each packed by itself: a bin is
filled greedily, then its smallest piece gives way to two unpacked pieces that fit the widened gap more
tightly. Only ids and lengths move; a group's end costs at most about one half-empty bin.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm.bpe import encoder
from arcweave.llm.frames import lean, slices, table, written
from arcweave.llm.textkit import decoded
from arcweave.llm.token_counts import default_path

PIECES = "doc_id long, row long, key long, piece int, start long, length long, ids_crc32 long"
#: Mean number of pieces in a group that is packed by itself.
GROUP = 20_000


def pieces(docs: DataFrame, path: str, end: int = 2, capacity: int = 1024) -> DataFrame:
    """Pieces of each document's ids with the end id: one, or full ones with the shorter one first."""

    def run(batches):
        e = encoder(path)
        for b in batches:
            out = []
            for lo, hi, data, off in slices(b):
                points, at = decoded(data, off)
                counts, ids = e.encode(data, off, points, at)
                first = np.cumsum(counts) - counts
                ids = ids.astype("<u4")
                for r, doc, row, key in zip(range(hi - lo), *(b.column(c)[lo:hi].to_pylist() for c in range(3))):
                    own = np.append(ids[first[r] : first[r] + counts[r]], np.uint32(end)).tobytes()
                    n, cut, k = len(own) // 4, 0, 0
                    size = n % capacity or capacity
                    while cut < n:
                        out.append((doc, row, key, k, cut, size, zlib.crc32(own[4 * cut : 4 * (cut + size)])))
                        cut, k, size = cut + size, k + 1, capacity
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")]).astype({"doc_id": "Int64", "piece": "int32"}), preserve_index=False)

    rows = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), F.xxhash64("doc_id", "text").alias("key"), "text")
    return rows.mapInArrow(lean(run), PIECES)


def best_two_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices. The pieces lie in stacks by length, so a step costs no more than the number of lengths."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in np.argsort(lengths, kind="stable")[::-1].tolist():
        stacks[lengths[i]].append(i)
    have = np.zeros(capacity + 1, bool)
    have[[n for n in range(capacity + 1) if stacks[n]]] = True

    def take(n: int) -> int:
        i = stacks[n].pop()
        have[n] = bool(stacks[n])
        return i

    def largest(n: int) -> int:
        found = np.flatnonzero(have[: n + 1])
        return int(found[-1]) if len(found) else 0

    bins = []
    while n := largest(capacity):
        own, gap = [], capacity
        while gap and (n := largest(gap)):
            own.append(take(n))
            gap -= n
        if gap and own:
            small = min(own, key=lambda i: lengths[i])
            room = gap + int(lengths[small])
            a = np.flatnonzero(have[1:room]) + 1
            if len(a):
                rest = np.zeros(room + 1, np.int64)  # the largest length at hand up to each gap
                rest[a] = a
                rest = np.maximum.accumulate(rest)
                b = rest[room - a]
                alone = (b == a) & np.array([len(stacks[x]) < 2 for x in a])
                b = np.where(alone, rest[np.maximum(np.minimum(room - a, a - 1), 0)], b)
                total = np.where(b > 0, a + b, 0)
                best = int(np.argmax(total))
                if total[best] > lengths[small] and total[best] <= room:
                    own.remove(small)
                    own += [take(int(a[best])), take(int(b[best]))]
                    stacks[lengths[small]].append(small)
                    have[lengths[small]] = True
        bins.append(own)
    return bins


def pack(parts: DataFrame, capacity: int = 1024, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to rows of PIECES; no sequence holds more than `capacity` tokens.

    Which sequence a piece gets depends only on the ids and texts, not on tasks or their order. Rows that are equal in
    both, or lack both, are told apart by their number in the table: where very many of them would share a group, that
    deals them to several."""
    parts = written(parts)
    full = parts.filter(F.col("length") >= capacity)
    rest = parts.filter(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group))
    schema = PIECES + ", sequence_id long, offset long"

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "piece", "row"], ignore_index=True)
        lengths = rows["length"].to_numpy()
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for k, own in enumerate(best_two_fit(lengths, capacity)):
            own = np.array(own)
            sequence[own] = (key[0] << 40) + (key[1] << 20) + k
            offset[own] = np.cumsum(lengths[own]) - lengths[own]
        return rows.drop(columns=["grp", "part"]).assign(sequence_id=sequence, offset=offset)

    dealt = rest.withColumn("grp", F.pmod(F.xxhash64("key", "piece"), F.lit(groups)))
    crowded = dealt.groupBy("grp").agg(F.count("*").alias("m")).filter(F.col("m") > 4 * group).withColumn("parts", F.ceil(F.col("m") / group))
    dealt = dealt.join(F.broadcast(crowded.select("grp", "parts")), "grp", "left")  # no more rows than one for 4 * group pieces
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1).cast("long")))).drop("parts")
    packed = dealt.groupBy("grp", "part").applyInPandas(run, schema)
    # full pieces have the negative numbers; the written table's files fix them
    alone = full.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(alone)


def best_fit_packing(docs: DataFrame, path: str | None = None, capacity: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of each row of `docs`.

    Null and empty texts are the end id alone. Repeated rows and null ids are packed row by row. Longer
    documents are cut; an empty table gives an empty result; other columns are left out."""
    return pack(pieces(docs, path or default_path(), capacity=capacity), capacity).drop("row", "key")


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """best_fit_packing() of all documents: nulls, ties, repeated rows and empty tables as stated there."""
    return best_fit_packing(table(spark, sf_dir, "documents"))
