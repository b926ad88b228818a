"""Removes word windows that also start in an earlier document, found by difference-cover anchors.

A set D of residues modulo v is a difference cover if each residue is a difference of two of its members.
For any positions i and j there is then a shift k < v with (i + k) mod v and (j + k) mod v both in D. So
two equal windows of `width` words share an anchor, a run of width - v + 1 words that starts at a cover
position in either text. Anchors are hashed at cover positions only; those met in two documents are
extended to the windows around them, which are compared by 96 bits: a hash over the hashes of their words, and one
over other hashes of these words.

Texts are shuffled once, by document, and that exchange serves all three readings. A hash that several
documents of one task share is settled there for all but the first of them, so a passage held by very many
documents, or repeated within one, sends a row or two for each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcweave.llm.frames import NULL_ID, lean, pressed, shuffle_partitions, table, unpressed, unused, written
from arcweave.llm.textkit import FIRST, SECOND, U, Words, mix, second_hash, words

#: A perfect difference set: 30 differences of 6 residues modulo 31, each once.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
WIDTH = 50
#: Shared hashes that a task remembers from batch to batch; more are settled within their batch alone.
HELD = 1 << 20


def check_cover(period: int, cover: tuple[int, ...], width: int) -> None:
    if {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError("cover is no difference cover of its period")
    if width < period:
        raise ValueError("windows must be at least as long as the period")


def _at(w: Words, k: int, starts: np.ndarray, roller=SECOND, sums: np.ndarray | None = None) -> np.ndarray:
    sums = roller.prefix(w.hash) if sums is None else sums
    return mix(roller.span(sums, starts, starts + k) + U(k))


def _anchors(w: Words, width: int, period: int, cover: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the anchors of texts that have a window."""
    at = np.arange(len(w.hash))
    own = np.repeat(w.lo, w.counts)
    last = np.repeat(np.where(w.counts >= width, w.hi, 0), w.counts)
    size = width - period + 1
    hit = np.zeros(period, bool)
    hit[list(cover)] = True
    at = at[hit[(at - own) % period] & (at + size <= last)]
    return at, _at(w, size, at)


def _settled(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of (key, document rank): the rank that each key meets first, the last, and whether a row is the first of its key."""
    order = np.lexsort((doc, key))
    k, d = key[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    group = np.cumsum(new) - 1
    least = np.empty(len(k), doc.dtype)
    least[order] = d[new][group]
    end = np.append(np.flatnonzero(new)[1:], len(k)) - 1
    most = np.empty(len(k), doc.dtype)
    most[order] = d[end][group]
    first = np.zeros(len(k), bool)
    first[order] = new
    return least, most, first


class Met:
    """Hashes that documents of earlier batches of a task shared, and the least of these documents: HELD at most."""

    def __init__(self):
        self.keys, self.least = np.zeros(0, U), np.zeros(0, np.int64)

    def lower(self, key: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least document so far, whether the key was kept before)."""
        if not len(self.keys):
            return least, np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, np.minimum(least, self.least[at]), least), hit

    def keep(self, key: np.ndarray, least: np.ndarray) -> None:
        """Equal keys must come with equal documents."""
        key, first = np.unique(key, return_index=True)
        least = least[first]
        if len(self.keys) + len(key) <= HELD:
            both, low = np.append(key, self.keys), np.append(least, self.least)  # what is new comes first
            self.keys, first = np.unique(both, return_index=True)
            self.least = low[first]


def _lists(values: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    """values grouped by row (sorted by row) as a list column of n rows."""
    off = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(rows, minlength=n), out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values))


def _anchor_rows(width: int, period: int, cover: tuple[int, ...]) -> Callable:
    """Per batch: rows (h, id, sig, many) to be compared with other tasks, and rows with the settled anchors of a
    document, whose own h only deals them out evenly."""

    def run(batches):
        met = Met()
        for b in batches:
            ids, sigs = b.column(0).to_numpy(), b.column(1).to_numpy()
            keys, docs = [], []
            for lo, hi, data, off in unpressed(b):
                w = words(data, off)
                at, h = _anchors(w, width, period, cover)
                keys.append(h)
                docs.append(np.searchsorted(w.hi, at, "right") + lo)
            h, doc = np.concatenate([np.zeros(0, U), *keys]), np.concatenate([np.zeros(0, np.int64), *docs])
            if not len(h):
                continue
            least, most, first = _settled(h, ids[doc])
            many = least < most
            _, before = met.lower(h, least)
            send = first & ~before  # what was shared before went out then
            yield pa.RecordBatch.from_arrays([pa.array(h[send].view(np.int64)), pa.array(ids[doc[send]]), pa.array(sigs[doc[send]]), pa.array(many[send]), pa.nulls(int(send.sum()), pa.list_(pa.int64()))], ["h", "id", "sig", "many", "done"])
            met.keep(h[send & many], least[send & many])
            more = (many | before) & ~send
            if more.any():
                rows, inv = np.unique(doc[more], return_inverse=True)
                order = np.argsort(inv, kind="stable")
                yield pa.RecordBatch.from_arrays([pa.array(mix(sigs[rows].view(U) + mix(ids[rows].view(U))).view(np.int64)), pa.array(ids[rows]), pa.array(sigs[rows]), pa.array(np.ones(len(rows), bool)), _lists(h[more][order].view(np.int64), inv[order], len(rows))], ["h", "id", "sig", "many", "done"])

    return run


def _window_rows(width: int, period: int, cover: tuple[int, ...]) -> Callable:
    """Windows around shared anchors: rows (h1, h2, id, sig, s, done), one for each window and document, with its first
    start and the others; and rows with the settled window starts of a document, without h2."""
    size = width - period + 1
    names = ["h1", "h2", "id", "sig", "s", "done"]

    def run(batches):
        met = Met()
        for b in batches:
            ids, sigs = b.column(0).to_numpy(), b.column(1).to_numpy()
            shared = b.column(3)
            keys, seconds, docs, begins = [], [], [], []
            for lo, hi, data, off in unpressed(b):
                w = words(data, off)
                at, h = _anchors(w, width, period, cover)
                part = shared.slice(lo, hi - lo)
                known = part.flatten().to_numpy(zero_copy_only=False).view(U)
                of = np.repeat(np.arange(hi - lo), np.diff(part.offsets.to_numpy()))
                doc = np.searchsorted(w.hi, at, "right")
                # an anchor counts where its own document has it among the shared ones
                salted = np.sort(mix(known ^ mix(of.astype(U))))
                mine = mix(h ^ mix(doc.astype(U)))
                at = at[salted[np.minimum(np.searchsorted(salted, mine), max(len(salted) - 1, 0))] == mine] if len(salted) else at[:0]
                step = np.zeros(len(w.hash) + 1, np.int64)
                doc = np.searchsorted(w.hi, at, "right")
                np.add.at(step, np.maximum(at + size - width, w.lo[doc]), 1)
                np.add.at(step, np.minimum(at, w.hi[doc] - width) + 1, -1)
                s = np.flatnonzero(np.cumsum(step)[:-1] > 0)
                doc = np.searchsorted(w.hi, s, "right")
                keys.append(_at(w, width, s))
                seconds.append(_at(w, width, s, FIRST, FIRST.prefix(second_hash(w))))
                docs.append(doc + lo)
                begins.append((s - w.lo[doc]).astype(np.int32))
            h, g, doc, s = (np.concatenate([np.zeros(0, t), *x]) for x, t in ((keys, U), (seconds, U), (docs, np.int64), (begins, np.int32)))
            if not len(h):
                continue
            g &= U(0xFFFFFFFF)
            both = mix(h) ^ mix(g + U(1))
            least, most, _ = _settled(both, ids[doc])
            kept = least < most
            least, before = met.lower(both, least)
            met.keep(both[kept | before], least[kept | before])
            more = ids[doc] > least
            own = np.flatnonzero(~more)
            own = own[np.lexsort((own, doc[own], both[own]))]
            new = np.ones(len(own), bool)  # a document's first start of a window goes out by itself, all others as a list
            new[1:] = (both[own[1:]] != both[own[:-1]]) | (doc[own[1:]] != doc[own[:-1]])
            send, group = own[new], np.cumsum(new) - 1
            ends = np.zeros(len(send) + 1, np.int32)
            np.cumsum(np.bincount(group[~new], minlength=len(send)), out=ends[1:])
            others = pa.ListArray.from_arrays(pa.array(ends), pa.array(s[own[~new]]), mask=pa.array(np.diff(ends) == 0))
            yield pa.RecordBatch.from_arrays([pa.array(h[send].view(np.int64)), pa.array(g[send].astype(np.uint32).view(np.int32)), pa.array(ids[doc[send]]), pa.array(sigs[doc[send]]), pa.array(s[send]), others], names)
            if more.any():
                rows, inv = np.unique(doc[more], return_inverse=True)
                order = np.argsort(inv, kind="stable")
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(mix(sigs[rows].view(U) + mix(ids[rows].view(U))).view(np.int64)), pa.nulls(n, pa.int32()), pa.array(ids[rows]), pa.array(sigs[rows]), pa.nulls(n, pa.int32()), _lists(s[more][order], inv[order], n)], names)

    return run


def _finish(width: int, texts: bool) -> Callable:
    """Cuts removed words out: their number, and the kept words joined by one space, as a digest or as text."""

    def run(batches):
        for b in batches:
            copy, starts = b.column(3).to_numpy(zero_copy_only=False), b.column(4)
            for lo, hi, data, off in unpressed(b):
                w = words(data, off)
                n = hi - lo
                part = starts.slice(lo, n)
                s = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                of = np.repeat(np.arange(n), np.diff(part.offsets.to_numpy()))
                step = np.zeros(len(w.hash) + 1, np.int64)
                np.add.at(step, w.lo[of] + s, 1)
                np.add.at(step, np.minimum(w.lo[of] + s + width, len(w.hash)), -1)
                gone = np.cumsum(step)[:-1] > 0
                gone |= (np.asarray(copy[lo:hi], bool) & (w.counts >= width))[w.text_of()]
                kept = ~gone
                size = (w.end - w.start + 1)[kept]
                ahead = np.cumsum(size) - size
                out = np.append(w.data, np.uint8(32))[np.minimum(np.repeat(w.start[kept] - ahead, size) + np.arange(int(size.sum())), len(w.data))]
                out[ahead + size - 1] = 32
                edge = np.zeros(len(w.hash) + 1, np.int64)
                np.cumsum(np.where(kept, w.end - w.start + 1, 0), out=edge[1:])
                raw = out.tobytes()
                joined = [raw[edge[x] : max(edge[x], edge[y] - 1)] for x, y in zip(w.lo, w.hi)]
                removed = np.bincount(w.text_of(), gone, n).astype(np.int64)
                last = pa.array([x.decode("utf-8", "replace") for x in joined]) if texts else pa.array([hashlib.sha256(x).hexdigest() for x in joined])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), b.column(1).slice(lo, n), pa.array(w.counts.astype(np.int64)), pa.array(removed), last], ["id", "sig", "n_words", "n_removed", "kept"])

    return run


def removed_windows(docs: DataFrame, width: int = WIDTH, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """(id, sig, text, copy, starts) of each row: the first words of its removed windows.

    copy: an earlier document has the whole text, so all its windows go; such rows take no part in the search."""
    check_cover(period, cover, width)
    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("sig", F.xxhash64("text"))
    light = rows.select("id", "sig", F.md5(F.col("text").cast("binary")).alias("md5"))
    # a written table, so that the join with it is of two plain exchanges and the adaptive plan can split a hot text
    first = written(light.groupBy("md5").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("md5", "first"))
    copies = light.join(first, "md5").filter("first < id").select("id", "sig").distinct()
    by_row = ["id", "sig"]
    text = rows.select("id", "sig", "text").mapInArrow(lean(pressed), "id long, sig long, text binary").repartition(n, "id", "sig")
    # the flag is tested after the join, so that all three readings share the exchange of the texts
    flagged = text.join(copies.withColumn("copy", F.lit(True)), by_row, "left").withColumn("copy", F.coalesce("copy", F.lit(False)))
    lead = flagged.filter("not copy").select("id", "sig", "text")

    anchors = lead.mapInArrow(lean(_anchor_rows(width, period, cover)), "h long, id long, sig long, many boolean, done array<long>")
    w = Window.partitionBy("h")
    found = anchors.withColumns({"a": F.min("id").over(w), "z": F.max("id").over(w), "m": F.max("many").over(w)}).filter("m or a < z")
    shared = found.groupBy(by_row).agg(F.concat(F.collect_list(F.expr("if(done is null, h, null)")), F.flatten(F.collect_list("done"))).alias("shared"))

    windows = lead.join(shared, by_row).select("id", "sig", "text", "shared").mapInArrow(lean(_window_rows(width, period, cover)), "h1 long, h2 int, id long, sig long, s int, done array<int>")
    w = Window.partitionBy("h1", "h2")
    found = windows.withColumn("a", F.min("id").over(w)).filter("h2 is null or a < id")
    starts = found.groupBy(by_row).agg(F.concat(F.collect_list("s"), F.flatten(F.collect_list("done"))).alias("starts"))

    out = flagged.join(starts, by_row, "left")
    return out.select("id", "sig", "text", "copy", F.coalesce("starts", F.array().cast("array<int>")).alias("starts"))


def _id():
    return F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id")


def substring_report(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of `docs`.

    Null and empty texts have no words. Null ids count as one id after all others. Rows of one id never
    remove each other's words, repeated rows get equal results. An empty table gives an empty result."""
    got = removed_windows(docs, width).select("id", "sig", "text", "copy", "starts").mapInArrow(lean(_finish(width, False)), "id long, sig long, n_words long, n_removed long, kept string")
    return got.select(_id(), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def substring_dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """`docs` with repeated passages cut out of the text column: rows that lose no word keep their text as it
    is, rows that lose all leave, others have their kept words joined by one space. n_chars follows, where
    there is one. Nulls, ties and repeated rows as in substring_report."""
    got = removed_windows(docs, width).select("id", "sig", "text", "copy", "starts").mapInArrow(lean(_finish(width, True)), "id long, sig long, n_words long, n_removed long, kept string")
    # one row for each (id, sig): repeated rows lose the same words
    one, two, kept, none = unused(docs, "id", "sig", "kept", "none")
    cut = got.filter("n_removed > 0").groupBy(F.col("id").alias(one), F.col("sig").alias(two)).agg(F.first("kept").alias(kept), F.max(F.col("n_removed") == F.col("n_words")).alias(none))
    keyed = docs.withColumns({one: F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), two: F.xxhash64(F.coalesce("text", F.lit("")))})
    out = keyed.join(cut, [one, two], "left").filter(~F.coalesce(none, F.lit(False)))
    out = out.withColumn("text", F.coalesce(kept, "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(kept).isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """substring_report() of all documents: nulls, ties, repeated rows and empty tables as stated there."""
    return substring_report(table(spark, sf_dir, "documents"))
