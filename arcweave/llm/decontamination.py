"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A seed is the hash of the tokens that a fixed mask picks from a run of them; what the mask skips may have been
substituted. Seeds of benchmark items join the seeds at every position of every text. Around each hit the aligned
tokens are compared: a window of WINDOW tokens (the whole item if shorter) with at least SHARE of them equal is an
overlap. The masks are chosen so that every such window meets one of them: long ones for items of WINDOW tokens and
more, shorter ones for items of SHORTEST tokens and more. Items below that are too short for substitutions: they
are one seed each, the whole item, and match nothing but themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.llm.frames import table, unused, written

#: Positions that each mask keeps, for windows of 13 tokens and for items of 9 to 12.
MASKS = ((0, 1, 3, 4, 6, 7), (0, 2, 3, 5, 6, 8), (0, 1, 2, 6, 7, 8), (0, 1, 3, 5, 7, 8))
SHORT_MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 6, 7))
WINDOW, SHORTEST, SHARE = 13, 9, 0.8
#: Positions that share one short array of tokens, and what a window around any of them reaches on either side.
CHUNK = 64
#: Benchmark seeds up to this number (under 200 MB with the tokens around them) go to all tasks; more are joined by a
#: shuffle, where each of them is there SALT times, so that the positions of a frequent seed spread over as many tasks.
BROADCAST_SEEDS, SALT = 200_000, 16
#: Overlapping rows up to this number (about 30 MB) go to all tasks when they are removed.
BROADCAST_ROWS = 1_000_000


def tokens(text: Column) -> Column:
    """Hashes of the lower-case runs of letters and digits."""
    parts = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.transform(parts, lambda x: F.xxhash64(x))


def patterns(lengths: list[int], window: int) -> list[tuple[int, int, tuple[int, ...]]]:
    """(least, most tokens of the items it is for, positions it keeps) of each pattern that items of these lengths need."""
    out = [(window, 1 << 31, m) for m in MASKS if any(n >= window for n in lengths)]
    out += [(SHORTEST, window - 1, m) for m in SHORT_MASKS if any(SHORTEST <= n < window for n in lengths)]
    return out + [(n, n, tuple(range(n))) for n in sorted(set(lengths)) if n < SHORTEST]


def chunks(rows: DataFrame, window: int) -> DataFrame:
    """Rows with the array h cut into (base, lo, hi, t): t holds the tokens from `base` on around the CHUNK positions
    lo..hi in it, with what a window around any of them can reach. So whatever is done for each position carries a
    short array, however long the text is; empty arrays have no chunk."""
    n = F.size("h")
    first = lambda c: c * CHUNK
    base = lambda c: F.greatest(F.lit(0), first(c) - window)
    cut = F.transform(
        F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")),
        lambda c: F.struct(base(c).alias("base"), (first(c) - base(c)).alias("lo"), (F.least(first(c) + CHUNK, n) - 1 - base(c)).alias("hi"), F.slice("h", base(c) + 1, first(c) + CHUNK + window - base(c)).alias("t")),
    )
    others = [x for x in rows.columns if x != "h"]
    # the outer form brings no filter along that would cut texts into tokens once more; rows without chunks go here
    return rows.select(*others, F.explode_outer(F.when(n > 0, cut)).alias("x")).filter("x is not null").select(*others, "x.*")


def seeds(parts: DataFrame, use: list[tuple[int, int, tuple[int, ...]]]) -> DataFrame:
    """Adds at (a position in t) and seed to rows of chunks(): one row for each position and pattern that fits there."""
    each = [F.when(F.col("at") + mask[-1] < F.size("t"), F.xxhash64(F.lit(f"{least}:{mask}"), *[F.get(F.col("t"), F.col("at") + o) for o in mask])) for least, _, mask in use]
    return parts.withColumn("at", F.explode(F.sequence("lo", "hi"))).withColumn("seed", F.explode(F.array(*each))).filter("seed is not null")


def _starts() -> Column:
    """The shifts of all windows over the hit (at in t, to in g) that have enough equal tokens."""
    low = F.greatest(F.col("reach") - F.col("w"), -F.col("at"), -F.col("to"))
    high = F.least(F.lit(0), F.size("t") - F.col("w") - F.col("at"), F.size("g") - F.col("w") - F.col("to"))
    same = lambda s: F.size(F.filter(F.sequence(F.lit(0), F.col("w") - 1), lambda k: F.get(F.col("t"), F.col("at") + s + k) == F.get(F.col("g"), F.col("to") + s + k)))
    return F.filter(F.sequence(low, F.greatest(low, high)), lambda s: (s <= high) & (same(s) >= F.col("need")))


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(key, doc_id, item_id, n_hits): documents that overlap a benchmark item, and the number of aligned windows (one in
    the text, one in the item) with enough equal tokens; key is a hash of the text.

    Null and empty texts and items match nothing; items under SHORTEST tokens match only whole and unchanged; null
    ids stay null; documents may repeat, and items too, also one id with several texts, which all count; an empty
    table on either side gives an empty result. Texts are read whole, other columns left out. The masks meet
    every window for the default window and share; a lower share may lose some."""
    items = benchmark.select("item_id", tokens(F.col("text")).alias("h")).withColumn("text_key", F.xxhash64("h")).distinct()
    items = written(items.withColumn("n", F.size("h")).filter("n > 0"))
    lengths = [r[0] for r in items.select(F.least("n", F.lit(window)).alias("n")).distinct().collect()]  # `window` rows at most
    use = patterns(lengths, window)
    parts = None
    for least, most, mask in use:
        own = seeds(chunks(items.filter(F.col("n").between(least, most)), window), [(least, most, mask)])
        own = own.withColumn("reach", F.lit(mask[-1] + 1)).withColumn("w", F.least(F.lit(window), F.col("n")))
        own = own.withColumn("need", F.when(F.col("n") < SHORTEST, F.col("n")).otherwise(F.ceil(F.col("w") * share)).cast("int"))
        own = own.select("seed", "item_id", "text_key", (F.col("base") + F.col("at")).alias("q"), F.col("at").alias("to"), F.col("t").alias("g"), "reach", "w", "need")
        parts = own if parts is None else parts.unionByName(own)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), tokens(F.col("text")).alias("h"))
    found = ["key", "doc_id", "item_id"]
    if parts is None:
        none = F.lit(None).cast(items.schema["item_id"].dataType)
        return rows.select("key", "doc_id", none.alias("item_id"), F.lit(0).cast("long").alias("n_hits")).filter("false")
    bench = written(parts)
    texts = chunks(rows, window)
    if bench.count() <= broadcast_seeds:
        hits = seeds(texts, use).join(F.broadcast(bench), "seed")
    else:
        # places alone are shuffled for the hits; tokens of either side join the chunks that have some
        every = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
        thin = seeds(texts, use).select("key", "doc_id", "base", "at", "seed", F.pmod(F.xxhash64("key", "base", "at"), F.lit(SALT)).cast("int").alias("salt"))
        hits = thin.join(bench.drop("g").withColumn("salt", every), ["seed", "salt"]).drop("seed").distinct()
        own = texts.select(F.col("key").alias("k"), F.col("doc_id").alias("i"), F.col("base").alias("n"), "t").dropDuplicates(["k", "i", "n"])
        hits = hits.join(own, [hits.key == own.k, hits.doc_id.eqNullSafe(own.i), hits.base == own.n])
        other = bench.select("text_key", "q", "to", "g").dropDuplicates(["text_key", "q", "to"]).withColumn("salt", every)
        hits = hits.join(other, ["text_key", "q", "to", "salt"])
    # verified where they are found: only places of windows are shuffled, no tokens
    met = hits.withColumn("s", F.explode(_starts())).select(*found, "text_key", (F.col("base") + F.col("at") + F.col("s")).alias("p"), (F.col("q") + F.col("s")).alias("q"))
    return met.distinct().groupBy(*found).agg(F.count("*").alias("n_hits"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`docs` without the rows that overlap a benchmark item; nulls and repeated rows as in overlaps()."""
    own, key, bad_id = unused(docs, "own", "key", "bad_id")
    bad = written(overlaps(docs, benchmark).select(F.col("key").alias(key), F.col("doc_id").alias(bad_id)).distinct())
    rows = docs.withColumn(own, F.xxhash64(F.coalesce("text", F.lit(""))))
    bad = F.broadcast(bad) if bad.count() <= broadcast_rows else bad
    return rows.join(bad, (F.col(own) == F.col(key)) & F.col("doc_id").cast("long").eqNullSafe(F.col(bad_id)), "left_anti").select(*docs.columns)


def op5_spaced_seeds(spark, sf_dir: str) -> DataFrame:
    """doc_id, item_id, n_hits of each document that overlaps a benchmark item; nulls, ties, repeated rows and empty
    tables as in overlaps(), rows of one id with different texts count with the text that has most."""
    got = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.groupBy("doc_id", "item_id").agg(F.max("n_hits").alias("n_hits"))


#: All alignments of all texts and items, without masks: equal tokens on a diagonal, counted in each window.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS h FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS g FROM benchmark),
i AS (SELECT item_id, len(g) AS m, least(13, len(g)) AS w, CASE WHEN len(g) < 9 THEN len(g) ELSE CAST(ceil(least(13, len(g)) * 0.8) AS BIGINT) END AS need FROM b WHERE len(g) > 0),
dt AS (SELECT doc_id, len(h) AS n, unnest(range(len(h))) AS p, unnest(h) AS t FROM d),
bt AS (SELECT item_id, unnest(range(len(g))) AS q, unnest(g) AS t FROM b),
e AS (SELECT doc_id, item_id, n, p - q AS diagonal, q FROM dt JOIN bt USING (t)),
f AS (SELECT doc_id, item_id, n, diagonal, list(q) AS qs, any_value(m) AS m, any_value(w) AS w, any_value(need) AS need FROM e JOIN i USING (item_id) GROUP BY doc_id, item_id, n, diagonal HAVING count(*) >= any_value(need)),
s AS (SELECT *, unnest(range(greatest(0, -diagonal), least(m, n - diagonal) - w + 1)) AS q FROM f)
SELECT doc_id, item_id, count(*) AS n_hits FROM s WHERE len(list_filter(qs, lambda x: x >= q AND x < q + w)) >= need GROUP BY doc_id, item_id
"""
