"""Periodic runs of words by harmonic grid probing.

A run is a stretch of words with smallest period q, at least max(6, 4 q) long, that no neighbouring word extends. In it
the words at x and x + q are equal for 3 q places x or more, so three grid points jq in a row have a word equal to the
one at (j+1)q. All periods up to a quarter of a text of n words make n (1/1 + 1/2 + ...) probes, done as array
comparisons for many texts at once. What survives is probed at seven more places, then extended both ways in chunks that
double. Grid points within a found run whose period divides p are passed over: they would give that run again.

A pass over 64-bit hashes of words tells which texts can have runs (equal words have equal hashes); those are
searched over exact numbers of their words.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm.frames import slices, table
from arcweave.llm.oracle_parts import crc32_sql
from arcweave.llm.textkit import words

#: Probes that are held at once (one period of a longer text is a block of its own), first chunk of an extension, least
#: length of a run, and periods of it at least.
BLOCK, CHUNK, LEAST, TIMES = 1 << 20, 64, 6, 4
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def survivors(ids: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """(texts, periods, grid points) where three equal probes in a row begin, by text, then period; for each stretch of
    such grid points the first. `ids` has the words of all texts, text d those from lo[d] to hi[d]."""
    n = hi - lo
    top = n // TIMES
    text = np.repeat(np.arange(len(n)), top)
    period = np.arange(len(text)) - np.repeat(np.cumsum(top) - top, top) + 1
    probes = (n[text] - 1) // period
    end = np.cumsum(probes)
    a = 0
    while a < len(text):
        before = end[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(end, before + BLOCK, "right")))
        size = probes[a:b]
        own = np.repeat(np.arange(a, b), size)
        j = np.arange(len(own)) - np.repeat(end[a:b] - size - before, size)
        at = lo[text[own]] + j * period[own]
        equal = ids[at] == ids[at + period[own]]
        i = np.flatnonzero(equal[:-2] & equal[1:-1] & equal[2:] & (own[:-2] == own[2:]))
        for k in range(1, 8):
            if not len(i):
                break
            p = period[own[i]]
            x = at[i] + p * k // 8
            i = i[ids[x] == ids[x + p]]
        if len(i):
            first = np.append(True, (np.diff(i) > 1) | (np.diff(own[i]) > 0))
            i = i[first]
            yield text[own[i]], period[own[i]], at[i]
        a = b


def extended(ids: np.ndarray, lo: int, hi: int, p: int, x: int) -> tuple[int, int]:
    """Begin and end of the longest stretch around x, x + p within lo..hi that has period p."""
    right, step = x, CHUNK
    while right < hi - p:
        z = min(right + step, hi - p)
        off = ids[right:z] != ids[right + p : z + p]
        k = int(off.argmax())
        if off[k]:
            right += k
            break
        right, step = z, 2 * step
    left, step = x, CHUNK
    while left > lo:
        z = max(left - step, lo)
        off = (ids[z:left] != ids[z + p : left + p])[::-1]
        k = int(off.argmax())
        if off[k]:
            left -= k
            break
        left, step = z, 2 * step
    return left, right + p


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one text, by start, then period."""
    found: list[tuple[int, int, int]] = []  # (start, end, period), sorted
    n = len(ids)
    for _, periods, points in survivors(ids, np.zeros(1, np.int64), np.array([n])):
        for p, x in zip(periods.tolist(), points.tolist()):
            k = bisect_right(found, (x, n + 1, 0))
            # long runs whose periods divide p overlap by less than 2 p, so few of them can hold x
            if any(e > x + p and p % q == 0 for _, e, q in found[max(0, k - 4) : k]):
                continue
            s, e = extended(ids, 0, n, p, x)
            if e - s < max(LEAST, TIMES * p):
                continue
            k = bisect_right(found, (s, e, 0))
            if k < len(found) and found[k][:2] == (s, e):  # its smallest period is known
                continue
            insort(found, (s, e, p))
    return sorted((s, e - s, q) for s, e, q in found)


def exact_ids(found: list[bytes]) -> np.ndarray:
    """Numbers of a text's words: equal for equal words only."""
    number: dict[bytes, int] = {}
    return np.array([number.setdefault(w, len(number)) for w in found], np.int64)


def _found(batches):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for b in batches:
        for lo, hi, data, off in slices(b):
            w = words(data, off)
            some = np.zeros(hi - lo, bool)
            for text, _, _ in survivors(w.hash, w.lo, w.hi):
                some[text] = True
            raw, runs, kept = data.tobytes(), [], []
            for i in range(hi - lo):
                own = raw[off[i] : off[i + 1]].split()  # at the same six bytes
                got = runs_of(exact_ids(own)) if some[i] else []
                if got:
                    keep = np.ones(len(own), bool)
                    for s, size, q in got:
                        keep[s + q : s + size] = False
                    own = [own[k] for k in np.flatnonzero(keep).tolist()]
                runs.append([{"start": s, "length": size, "period": q} for s, size, q in got])
                kept.append(b" ".join(own).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(w.counts), pa.array(runs, kind), pa.array(kept, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period of each, by start, then period) and collapsed, the text without the
    words that a run has after its first period, words joined by one space.

    Words are runs of bytes other than space and \\t to \\r. Null, empty and blank texts have no words, no runs and an
    empty collapsed text; null ids and repeated rows stay; other columns are left out; an empty table gives an
    empty result. Texts of any length are searched whole, one text in one task and nothing is shuffled."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_found, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; where the crc32 h of the id ends in 0, the words from a = g % n on repeat the first
    1 + floor((n - a) / (3 + g % 8)) of them, g being floor(h / 10). Rows without an id stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    found = F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")

    def edited(w):
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        repeat = F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda i: F.get(w, (a + i % p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), repeat), " ")).otherwise("")

    # a one-element array names the words, so that they are found once
    return docs.select(F.col("doc_id").cast("long"), F.when((h % 10 == 0) & F.col("text").isNotNull(), F.get(F.transform(F.array(found), edited), F.lit(0))).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of all documents with planted repeats, as digests: nulls, ties, repeated rows and empty tables as in
    periodic_runs(); of runs of one length that with the smallest start, then period, is shown."""
    got = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    shown = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    # the least of (-length, start, period)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.concat(F.array_join(F.transform("runs", shown), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    rows = got.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
    length = -F.col("best.l")
    return rows.select("doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"), F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: Pairs of equal words of one text by distance, then stretches of such pairs.
ORACLE = rf"""
WITH split AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {crc32_sql("doc_id::VARCHAR")} AS h FROM documents
), sized AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM split),
cut AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM sized),
edited AS (
    SELECT doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) END AS w FROM cut
), each AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS i FROM edited),
pairs AS (
    SELECT x.doc_id, y.i - x.i AS q, x.i AS i FROM each x JOIN each y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pairs),
stretches AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM islands GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT doc_id, s, l, min(q) AS q FROM stretches GROUP BY doc_id, s, l),
told AS (
    SELECT doc_id, count(*) AS n_runs, min(row(-l, s, q)) AS best, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY doc_id
), gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT each.doc_id, string_agg(word, ' ' ORDER BY each.i) AS t FROM each ANTI JOIN gone ON each.doc_id = gone.doc_id AND each.i = gone.i GROUP BY each.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best[2]::BIGINT AS start, (-best[1])::BIGINT AS length, best[3]::BIGINT AS period,
    (1000 * -best[1] // best[3])::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM documents d LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
