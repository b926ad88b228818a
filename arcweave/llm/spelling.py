"""Spelling variants: words one edit apart, from a forward and a reversed dictionary.

If x and y differ by one inserted, deleted or replaced code point and the longer has m, they share their first or their
last floor(m/2) code points. So each word stands in blocks of words with that shared prefix (a range of the sorted
dictionary) and with that shared suffix (a range of the dictionary of reversed words), for m its length and one more. A
block of more than BLOCK words is subdivided: what is left between prefix and suffix differs by one edit as well, so the
same holds for it, and each word moves to the block with the longer prefix and to that with the longer suffix. With one
code point left a block has no more words than there are letters, and one. Blocks are ranges of one sort; a task scans
them, compares the words of each and verifies every pair. Of the ways in which a pair can be met just one counts: at each
division the prefix if it is shared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm.frames import removed, shuffle_partitions, stored, table
from arcweave.llm.oracle_parts import crc32_sql

#: Words of a block that are compared with each other; code points that a row of the comparison matrix has; rows of
#: pairs compared at once.
BLOCK, WIDTH, PAIRS = 128, 48, 1 << 16
LETTERS = "A-Za-zÀ-ÿ"
KEYS = ["head", "tail", "lmax", "path", "depth"]


def noised_words(docs: DataFrame, least: int = 5, often: int = 3, every: int = 97) -> DataFrame:
    """(word, n): runs of letters with A-Z lower-cased, one code point of some deleted by a crc32 of id and run, of at
    least `least` code points and `often` occurrences. A null id counts as the empty text. Occurrences are added up before the shuffle."""
    run = F.explode(F.regexp_extract_all("text", F.lit(f"([{LETTERS}]+)"), F.lit(1))).alias("run")
    own = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run)
    # lower() would lower accented capitals too
    accented = F.col("run").rlike("[À-Þ]")
    own = own.select("id", F.when(accented, F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower("run")).alias("run"))
    own = own.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    cut = F.expr(f"CASE WHEN h % {every} = 0 THEN concat(substring(run, 1, cast(h % length(run) as int)), substring(run, cast(h % length(run) as int) + 2)) ELSE run END")
    return own.select(cut.alias("word")).filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= often)


def _placed(rows: DataFrame) -> DataFrame:
    """With the shared ends that name a row's block."""
    return rows.withColumns({"head": F.expr("substring(word, 1, a)"), "tail": F.expr("CASE WHEN b > 0 THEN right(word, b) ELSE '' END")})


def _divided(rows: DataFrame) -> DataFrame:
    """Each row twice: half of what is left between its ends joins the prefix (bit 0 of the path) or the suffix (bit 1)."""
    k = F.floor((F.col("lmax") - F.col("a") - F.col("b")) / 2).cast("int")
    ways = F.array(*[F.struct((F.col("path") + bit * F.expr("shiftleft(1L, depth)")).alias("path"), (F.col("a") + (1 - bit) * k).alias("a"), (F.col("b") + bit * k).alias("b")) for bit in (0, 1)])
    each = rows.select("word", "n", "lmax", F.col("depth") + 1, F.explode(ways).alias("w"))
    return _placed(each.toDF("word", "n", "lmax", "depth", "w").select("word", "n", "lmax", "depth", "w.*"))


def _ends(points: np.ndarray, off: np.ndarray, i: np.ndarray, j: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the common prefixes and suffixes of words i and j."""
    short = np.minimum(off[i + 1] - off[i], off[j + 1] - off[j])
    out = []
    for t in tables:
        differ = t[i] != t[j]
        at = differ.argmax(1)
        out.append(np.minimum(np.where(differ[np.arange(len(i)), at], at, WIDTH), short))
    p, s = out
    for k in np.flatnonzero(np.maximum(off[i + 1] - off[i], off[j + 1] - off[j]) > WIDTH):  # long words one by one
        x, y, m = points[off[i[k]] : off[i[k] + 1]], points[off[j[k]] : off[j[k] + 1]], short[k]
        p[k], s[k] = (int(d.argmax()) if (d := u[:m] != v[:m]).any() else m for u, v in ((x, y), (x[::-1], y[::-1])))
    return p, s


def near_pairs(words: list[str], block: np.ndarray, lmax: np.ndarray, path: np.ndarray, depth: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j), i before j, of one block each that are one edit apart and meet here by the rule for paths. Rows of
    a block follow each other."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    size = np.array([len(w) for w in words], np.int64)
    off = np.append(0, np.cumsum(size))
    forward, back = np.zeros((len(words), WIDTH), np.uint32), np.zeros((len(words), WIDTH), np.uint32)
    row = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(points)) - off[row]
    for t, x in ((forward, at), (back, size[row] - 1 - at)):
        inside = x < WIDTH
        t[row[inside], x[inside]] = points[inside]
    change = np.append(np.flatnonzero(block[1:] != block[:-1]) + 1, len(block))
    last = change[np.searchsorted(change, np.arange(len(block)), "right")]
    step = 1
    while len(left := np.flatnonzero(np.arange(len(words)) + step < last)):
        for lo in range(0, len(left), PAIRS):
            i = left[lo : lo + PAIRS]
            j = i + step
            fits = (np.maximum(size[i], size[j]) == lmax[i]) & (np.minimum(size[i], size[j]) >= lmax[i] - 1)
            i, j = i[fits], j[fits]
            p, s = _ends(points, off, i, j, (forward, back))
            good = p + s >= lmax[i] - 1
            i, j, p, s = i[good], j[good], p[good], s[good]
            a, b = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
            good = np.ones(len(i), bool)
            for d in range(int(depth[i].max()) if len(i) else 0):
                live = depth[i] > d
                k = (lmax[i] - a - b) // 2
                prefix, own = p >= a + k, (path[i] >> d) & 1 == 0
                good &= ~live | np.where(own, prefix, ~prefix & (s >= b + k))
                a, b = a + k * (live & own), b + k * (live & ~own)
            yield i[good], j[good]
        step += 1


def _scan(batches):
    """Blocks of sorted rows: (word, near, n, form) of each word that has near words in a block: how many, and the first of them by n and code points."""
    held: list[pa.RecordBatch] = []

    def searched(rows: pa.Table):
        words = rows["word"].to_pylist()
        n, block, lmax, path, depth = (rows[c].to_numpy() for c in ("n", "block", "lmax", "path", "depth"))
        rank = np.empty(len(words), np.int64)
        rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        found = [np.concatenate(x) for x in zip(*near_pairs(words, block, lmax, path, depth))]
        if not found or not len(found[0]):
            return
        src, dst = np.concatenate(found), np.concatenate(found[::-1])
        order = np.lexsort((rank[dst], -n[dst], src))
        src, dst = src[order], dst[order]
        first = np.flatnonzero(np.append(True, src[1:] != src[:-1]))
        yield pa.RecordBatch.from_arrays([pa.array([words[x] for x in src[first]], pa.string()), pa.array(np.diff(np.append(first, len(src)))), pa.array(n[dst[first]]), pa.array([words[x] for x in dst[first]], pa.string())], ["word", "near", "n", "form"])

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows = pa.Table.from_batches(held)
        block = rows["block"].to_numpy()
        # the last block may go on in the next batch
        cut = int(np.flatnonzero(np.append(True, block[1:] != block[:-1]))[-1])
        if cut:
            yield from searched(rows.slice(0, cut))
        held = rows.slice(cut).combine_chunks().to_batches()
    if held:
        yield from searched(pa.Table.from_batches(held))


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n, n_near, best_n, best) of each row of `words` (word, n; words differ): the number of words one edit away,
    and the one of largest n, of equal ones the first in code-point order; none gives 0 and nulls."""
    spark = words.sparkSession
    first = F.array(*[F.struct(m.alias("lmax"), F.floor(m / 2).cast("int").alias("k")) for m in (F.length("word"), F.length("word") + 1)])
    ways = words.select("word", "n", F.explode(first).alias("m")).select("word", "n", "m.*")
    zero = F.lit(0)
    rows = _placed(ways.select("word", "n", "lmax", F.lit(1).alias("depth"), F.explode(F.array(*[F.struct(F.lit(bit).cast("long").alias("path"), (zero + (1 - bit) * F.col("k")).alias("a"), (zero + bit * F.col("k")).alias("b")) for bit in (0, 1)])).alias("w")).select("word", "n", "lmax", "depth", "w.*"))
    parts, paths = [], []
    while True:
        many, at = stored(rows.filter("lmax - a - b > 1").groupBy(*KEYS).agg(F.count("*").alias("c")).filter(F.col("c") > block).drop("c"))
        paths.append(at)
        if many.isEmpty():
            parts.append(rows)
            break
        parts.append(rows.join(many, KEYS, "left_anti"))
        rows, at = stored(_divided(rows.join(many, KEYS, "left_semi")))
        paths.append(at)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.withColumn("block", F.xxhash64(*KEYS))
    # one sort of all blocks: equal keys stay together, in one part
    dealt = every.repartitionByRange(shuffle_partitions(spark), *KEYS).sortWithinPartitions(*KEYS)
    found = dealt.select("word", "n", "block", F.col("lmax").cast("long").alias("lmax"), "path", F.col("depth").cast("long").alias("depth")).mapInArrow(_scan, "word string, near long, n long, form string")
    none = F.lit(None).cast("struct<m:bigint,w:string>")
    sums = words.select("word", "n", F.lit(0).cast("long").alias("near"), none.alias("f")).unionByName(found.select("word", F.lit(None).cast("long").alias("n"), "near", F.struct((-F.col("n")).alias("m"), F.col("form").alias("w")).alias("f")))
    got, _ = stored(sums.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("f").alias("f")).select("word", "n", "n_near", (-F.col("f.m")).alias("best_n"), F.col("f.w").alias("best")))
    removed(spark, *paths)
    return got


def followed(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(word, root) of each row of `links` (word, form; no circles): the last word that forms lead to. Each round doubles
    the steps and joins only the rows that are not at their end."""
    spark = links.sparkSession
    now, at = stored(links.select("word", F.col("form").alias("root"), F.lit(False).alias("end")))
    for _ in range(rounds):
        if now.filter("not end").isEmpty():
            return now.select("word", "root")
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"), F.col("end").alias("last"))
        moved = now.filter("not end").join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.coalesce("last", F.lit(True)).alias("end"))
        new, path = stored(now.filter("end").unionByName(moved))
        removed(spark, at)
        now, at = new, path
    raise RuntimeError("forms did not settle")


def spelling_variants(docs: DataFrame, least: int = 5, often: int = 3, times: int = 2, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of noised_words().

    form is the near word of largest n (ties: the first in code-point order) if that is at least `times` the word's own,
    else null; root is where forms lead, the word itself without any. Null and empty texts have no words; a null id counts
    as the empty text; repeated rows count again; other columns are left out; an empty table gives an empty result."""
    words, at = stored(noised_words(docs, least, often))
    near = near_words(words, block)
    removed(docs.sparkSession, at)
    known = F.col("best_n") >= times * F.col("n")
    formed = near.select("word", F.when(known, F.col("best")).alias("form"), "n", "n_near", F.when(known, F.col("best_n")).alias("form_n"))
    roots = followed(formed.filter("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """spelling_variants() of all documents: nulls, ties, repeated rows and empty tables as stated there."""
    return spelling_variants(table(spark, sf_dir, "documents"))


#: Words that agree but for one place share that pattern; a word less one code point is a shorter word.
ORACLE = f"""
WITH RECURSIVE found AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[{LETTERS}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), counted AS (SELECT doc_id, run, count(*) AS c FROM found GROUP BY ALL),
hashed AS (SELECT *, {crc32_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM counted),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM hashed),
words AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
places AS (SELECT word, n, unnest(range(length(word)))::INT AS i FROM words),
holes AS (SELECT word, n, substr(word, 1, i) || '*' || substr(word, i + 2) AS k FROM places),
less AS (SELECT DISTINCT word, n, substr(word, 1, i) || substr(word, i + 2) AS k FROM places),
pairs AS (
    SELECT a.word, a.n, b.word AS other, b.n AS m FROM holes a JOIN holes b USING (k) WHERE a.word <> b.word
    UNION ALL SELECT l.word, l.n, w.word, w.n FROM less l JOIN words w ON l.k = w.word
    UNION ALL SELECT w.word, w.n, l.word, l.n FROM less l JOIN words w ON l.k = w.word
),
best AS (SELECT word, count(*)::BIGINT AS n_near, min(row(-m, other)) AS b FROM pairs GROUP BY word),
formed AS MATERIALIZED (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 2 * n THEN b[2] END AS form, CASE WHEN -b[1] >= 2 * n THEN -b[1] END AS form_n FROM words LEFT JOIN best USING (word)
),
steps AS (
    SELECT word, word AS root, form AS next FROM formed
    UNION ALL SELECT s.word, f.word, f.form FROM steps s JOIN formed f ON s.next = f.word
)
SELECT f.word, form, s.root, n, n_near, form_n::BIGINT AS form_n FROM formed f JOIN steps s ON f.word = s.word AND s.next IS NULL
"""
