"""Document fingerprints from modular prefix sums over code points.

P[i] = c[0] + c[1] b + ... + c[i-1] b**(i-1) modulo p. Span (s, t) of one text equals span (u, v) of
another of that length iff (P[t] - P[s]) b**u = (Q[v] - Q[u]) b**s, and the longest common extension of
two positions is found by binary search over its length.

A fingerprint keeps the length, four residues of the whole, and a sample of the prefix array: residues at
fixed cut positions (every length up to 16, then in steps of an eighth of an octave), the same for any text, from both
ends; and the residues and lengths of all interior spans between cuts placed by content, 33 code points on average.
Two fingerprints compare like the texts: a binary search over the cuts finds the longest common
beginning and end, and between them equal spans count wherever they stand, so edits hide only the spans they touch.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcweave.llm.frames import NULL_ID, pressed, shuffle_partitions, slices, table
from arcweave.llm.textkit import decoded

P = (1 << 31) - 1
BASES = (998_244_353 % P, 1_000_003, 1_812_433_253 % P, 69_069)
U = np.uint64
STEPS = np.unique(np.concatenate([np.arange(1, 17), np.floor(16 * 2.0 ** (np.arange(1, 8 * 40) / 8)).astype(np.int64)]))
#: A cut by content stands where the residue of WIDTH code points is below those of the REACH positions on either side;
#: where none does, a cut follows after LONGEST code points.
WIDTH, REACH, LONGEST = 8, 16, 64
INVERSE = pow(BASES[0], -1, P)
#: Powers that are kept of a base, and code points that are worked on at once: longer texts go block by block, and their
#: powers come from these and one more for each block, so a worker keeps 8 MB a base whatever it has met.
BLOCK = 1 << 20
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int = BASES[0]) -> np.ndarray:
    """The first n powers; at most BLOCK are asked for."""
    p = _POWERS.get(base, np.ones(1, np.uint64))
    while len(p) < n:
        p = np.concatenate([p, p * U(pow(base, len(p), P)) % U(P)])
    _POWERS[base] = p
    return p[:n]


def power_at(at: np.ndarray, base: int) -> np.ndarray:
    """Powers at any places."""
    top = int(at.max(initial=0))
    if top < BLOCK:
        return powers(top + 1, base)[at]
    far = np.array([pow(base, BLOCK * k, P) for k in range(top // BLOCK + 1)], np.uint64)
    return powers(BLOCK, base)[at % BLOCK] * far[at // BLOCK] % U(P)


def _weighted(points: np.ndarray, base: int):
    """(first place, values c b**i modulo p) for a block of code points at a time."""
    for s in range(0, len(points), BLOCK):
        x = points[s : s + BLOCK].astype(np.uint64) + U(1)
        x = x * powers(len(x), base) % U(P)
        yield s, x * U(pow(base, s, P)) % U(P) if s else x


def total(points: np.ndarray, base: int) -> int:
    """The residue of a whole text: the last of its prefix array."""
    out = 0
    for s in range(0, len(points), BLOCK):
        x = points[s : s + BLOCK].astype(np.uint64) + U(1)
        x *= powers(len(x), base)
        # 2**11 terms below 2**52 have a sum below 2**63
        out += int((np.add.reduceat(x, np.arange(0, len(x), 1 << 11)) % U(P)).sum()) * pow(base, s, P)
    return out % P


def prefix(points: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """The modular prefix array of one text: 1 longer than it, 4 bytes a value."""
    out, before = np.zeros(len(points) + 1, np.uint32), U(0)
    for s, x in _weighted(points, base):
        x = (np.cumsum(x) + before) % U(P)  # at most 2**20 terms below 2**31
        out[s + 1 : s + 1 + len(x)] = x
        before = x[-1]
    return out


def span_equal(a: np.ndarray, s: int, b: np.ndarray, u: int, n: int, base: int = BASES[0]) -> bool:
    """Whether the n code points from s in one text and from u in another have the same hash."""
    left, right = (int(a[s + n]) - int(a[s])) % P, (int(b[u + n]) - int(b[u])) % P
    return left * pow(base, u, P) % P == right * pow(base, s, P) % P


def common_extension(a: np.ndarray, s: int, b: np.ndarray, u: int, base: int = BASES[0]) -> int:
    """Length of the longest common extension of position s in one text and u in another."""
    lo, hi = 0, min(len(a) - 1 - s, len(b) - 1 - u)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if span_equal(a, s, b, u, mid, base) else (lo, mid - 1)
    return lo


def grid(n: int) -> np.ndarray:
    """Cut positions up to n."""
    return STEPS[: np.searchsorted(STEPS, n, "right")]


def residues(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of the spans of a text with these prefix sums, the same wherever a span stands."""
    return (sums[end].astype(np.uint64) + U(P) - sums[start]) % U(P) * power_at(start, INVERSE) % U(P)


def content_cuts(sums: np.ndarray) -> np.ndarray:
    """Ends of all spans of one text: cuts by content, those forced after LONGEST code points, and the text's end."""
    n = len(sums) - 1
    if not n:
        return np.zeros(0, np.int64)
    m = n - WIDTH + 1
    cuts = np.zeros(1, np.int64)
    if m > 0:
        h = np.full(m + 2 * REACH, (1 << 32) - 1, np.uint32)
        for s in range(0, m, BLOCK):
            at = np.arange(s, min(s + BLOCK, m))
            h[REACH + at[0] : REACH + at[-1] + 1] = residues(sums, at, at + WIDTH) * U(0x9E3779B1) % U(1 << 32)  # order unlike that of the code points
        low, k = h, 1
        while k < REACH:  # least of k positions, doubled
            low, k = np.minimum(low[:-k], low[k:]), 2 * k
        own = h[REACH:-REACH]
        cuts = np.append(cuts, np.flatnonzero((own < low[:m]) & (own <= low[REACH + 1 : REACH + 1 + m])))
    cuts = cuts[np.append(True, cuts[1:] > 0)]
    more = (np.diff(np.append(cuts, n)) - 1) // LONGEST + 1
    begin = np.repeat(cuts, more) + LONGEST * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more))
    return np.append(begin[1:], n)


def _hex(residues: np.ndarray) -> str:
    return residues.astype(">u4").tobytes().hex()


def fingerprint_of(points: np.ndarray, sums: np.ndarray | None = None, back: np.ndarray | None = None) -> str:
    """From the prefix arrays of the text and of its reverse, where they are at hand;
    length : whole : cuts from the start : cuts from the end : interior spans, residues as 8 hex digits each : their lengths as 2 each."""
    n = len(points)
    at = grid(n)
    sums = prefix(points) if sums is None else sums
    whole = [int(sums[-1]), *(total(points, b) for b in BASES[1:])]
    back = prefix(points[::-1]) if back is None else back
    ends = content_cuts(sums)
    begin = np.append(np.zeros(1, np.int64), ends[:-1])[: len(ends)]
    return ":".join([f"{n:x}", *map(_hex, (np.array(whole), sums[at], back[at], residues(sums, begin, ends))), (ends - begin).astype(np.uint8).tobytes().hex()])


def _shared(a: str, b: str) -> int:
    """The largest number of 8-digit residues that both lists begin with, by binary search (prefixes nest)."""
    lo, hi = 0, min(len(a), len(b)) // 8
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[8 * mid - 8 : 8 * mid] == b[8 * mid - 8 : 8 * mid] else (lo, mid - 1)
    return lo


def _between(spans: str, lengths: str, residues: list[int], shared: set[int], head: int, tail: int) -> dict[tuple[int, str], list[int]]:
    """For each shared residue (with its length) how many code points of each such span lie after the first `head` and before the last `tail`."""
    size = np.frombuffer(bytes.fromhex(lengths), np.uint8).astype(np.int64)
    end = np.cumsum(size)
    left = np.minimum(end, (end[-1] if len(end) else 0) - tail) - np.maximum(end - size, head)
    out: dict[tuple[int, str], list[int]] = {}
    for k in np.flatnonzero(left > 0).tolist():
        if residues[k] in shared:
            out.setdefault((residues[k], lengths[2 * k : 2 * k + 2]), []).append(int(left[k]))
    return out


def likeness(a: str, b: str) -> float:
    """Share of the longer text in the common beginning and end, as far as the cuts tell, and in equal spans between
    them, each paired once; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    (na, _, sa, ea, *mid_a), (nb, _, sb, eb, *mid_b) = a.split(":"), b.split(":")
    na, nb = int(na, 16), int(nb, 16)
    long, short = max(na, nb), min(na, nb)
    cut = np.append(0, grid(long))
    head = int(cut[_shared(sa, sb)])
    tail = min(int(cut[_shared(ea, eb)]), short - head)
    one, two = (np.frombuffer(x[0].encode(), np.uint64).tolist() for x in (mid_a, mid_b))  # 8 digits as one number
    same = 0
    if shared := set(one) & set(two):
        own, other = _between(*mid_a, one, shared, head, tail), _between(*mid_b, two, shared, head, tail)
        same = sum(min(x, y) for key in own.keys() & other.keys() for x, y in zip(sorted(own[key], reverse=True), sorted(other[key], reverse=True)))
    return float(min(head + tail + same, long - 1)) / long


def _followed(batches):
    """Each row of a sorted part (doc_id, text, part) beside the text of the next one: (kind 0, part, doc_id, blob, after);
    the first row's text by itself as kind 1 and the last row, which lacks the next one, as kind 2."""
    part, last = 0, None

    def rows(kind, ids, own, after):
        n = len(own)
        return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int32()), ids, own, after], ["kind", "part", "doc_id", "blob", "after"])

    for b in batches:
        if not b.num_rows:
            continue
        part = b.column(2)[0].as_py()
        ids, text = b.column(0), b.column(1)
        if last is None:
            yield rows(1, pa.nulls(1, pa.int64()), text.slice(0, 1), pa.nulls(1, pa.binary()))
        else:
            yield rows(0, *last, text.slice(0, 1))
        yield rows(0, ids.slice(0, b.num_rows - 1), text.slice(0, b.num_rows - 1), text.slice(1))
        last = ids.slice(b.num_rows - 1), text.slice(b.num_rows - 1)
    if last is not None:
        yield rows(2, *last, pa.nulls(1, pa.binary()))


def _compared(batches):
    press = zstandard.ZstdDecompressor()

    def arrays(t):
        x = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        return x, prefix(x), prefix(x[::-1])

    blob, kept = None, ()  # a row's next text is mostly the text of the row that follows
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            part, out = b.slice(lo, 256), []
            for own, nxt in zip(part.column(1), part.column(2)):
                own, nxt = own.as_py(), nxt.as_py()
                if own != blob:
                    text = press.decompress(own).decode("utf-8", "replace")
                    x = arrays(text)
                    kept = text, x, fingerprint_of(*x)
                text, x, a = kept
                after = press.decompress(nxt).decode("utf-8", "replace")
                k = len(text) // 3
                edited = text[: len(text) - k] + after[:k]
                ends = []
                for other in (edited, after):  # one at a time, as texts may be very long
                    y = arrays(other)
                    kept = other, y, fingerprint_of(*y)
                    ends += [common_extension(x[i], 0, y[i], 0) for i in (1, 2)]
                    if other is edited:
                        e = kept[2]
                blob, f = nxt, kept[2]
                out.append((len(text), hashlib.sha256(edited.encode()).hexdigest(), a, e, likeness(a, e), likeness(a, f), *ends))
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, zip(*out))], [c.split()[0] for c in EDITED.split(", ")])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of each row. Null text counts as empty; null ids and repeated rows stay;
    equal texts get equal fingerprints; an empty table gives an empty result; other columns are left out."""

    def run(batches):
        for b in batches:
            for lo, hi, data, off in slices(b):
                points, at = decoded(data, off)
                got = [fingerprint_of(points[at[i] : at[i + 1]]) for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.diff(at)), pa.array(got, pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_head long, edited_tail long, next_head long, next_tail long"


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint beside that of its edited text: its last third replaced by the beginning of the
    next document by descending doc_id (the first follows the last, a single row itself); with the likeness of the
    fingerprints, and the longest common beginnings and ends of the texts, in code points, from their prefix arrays.

    Null text counts as empty; null ids follow all others; rows of one id follow by a hash of their text,
    and equal rows in any order, which gives the same. An empty table gives an empty result."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-NULL_ID)).alias("ord"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    packed = rows.select("doc_id", "ord", "tie", "text").mapInArrow(pressed, "doc_id long, ord long, tie long, text binary")
    # ranges of (id, hash of text), so that rows of one id, or of none, spread as well; all uses share the exchange
    order = [F.col("ord").desc(), F.col("tie").desc()]
    dealt = packed.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    near = dealt.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(_followed, "kind int, part int, doc_id long, blob binary, after binary")
    # a row for each part: the last row of a part is followed by the first of the next one that has any
    heads = near.filter("kind = 1").select("part", F.col("blob").alias("after"))
    everywhere = Window.orderBy("part")
    before = heads.select(F.col("part").alias("own"), F.coalesce(F.lag("part").over(everywhere), F.max("part").over(Window.partitionBy(F.lit(0)))).alias("at"))
    tails = near.filter("kind = 2").select(F.col("part").alias("at"), "doc_id", "blob")
    ends = tails.join(before, "at").join(heads.withColumnRenamed("part", "own"), "own").select("doc_id", "blob", "after")
    return near.filter("kind = 0").select("doc_id", "blob", "after").unionByName(ends).mapInArrow(_compared, EDITED)


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    """edited_fingerprints() of all documents: nulls, ties, repeated rows and empty tables as stated there."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))
