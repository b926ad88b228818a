"""Exact Jaccard self-join of shingle sets by T-occurrence search.

1. Equal sets become one class. Shingles are 64-bit hashes; their numeric order is a global order.
2. A set that links must share `t` of its first n - ceil(s n) + t shingles with one other set. Classes
   with fewer shared ones leave; so do, over whole sets, those with under ceil(s n) shared shingles. Shingles
   that one set alone has are counted, by sums that combine before the shuffle, so frequent ones cost nothing.
3. The rest is sorted by frequency. Two linked sets share one of their rarest n' - ceil(s n) + 1, so the
   groups of sets that are connected through those hold all links between them. Groups are cut by size where sizes
   differ too much for a link.
4. Each group gets an inverted index. DivideSkip merges a query's short lists, probes its long ones by
   binary search, and keeps what reaches the overlap; an exact test follows. The index of a large group is split into
   shards, each searched by each other one, so a task's memory has a fixed bound; shards grow with the square root
   of the group, up to that bound. Links are unioned where they are found: a task returns one row for each of its sets.
   Lists are ordered by the components found so far and a query passes over its own one, so sets that are near copies
   of each other are not compared pair by pair; only where the number of links is asked for are all of them met.

Filters 2 and 3 only ever let too much through; no link is lost, and no list or group is cut.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm.components import components
from arcweave.llm.frames import NULL_ID, lean, removed, shuffle_partitions, slices, stored, table, unused, written
from arcweave.llm.substring_dedup import _lists
from arcweave.llm.textkit import FIRST, SECOND, U, mix, windows, words

#: Share of a set's size that is asked of its first shingles.
SLACK = 0.1
#: Shingles of a shard: of small groups together and of a large one at least; at most (under 250 MB in a task); and
#: their growth with the square root of a group's shingles between these.
SHARD, MOST, GROWTH = 1 << 18, 1 << 22, 256
#: Shingles that are sorted at once to add them up.
STEP = 1 << 20
#: Entries that are merged by a heap; more by a sort that merges sorted runs.
HEAP = 64
#: Words of 64 bits in the filter that spares whole sets of documents that left: 8 MB, whatever the input.
BLOOM = 1 << 20


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of a set of n that any linked set shares at least."""
    return -(-percent * n // 100)


def _sets(k: int) -> Callable:
    """Per slice: (first row, rows, set of each row as sorted distinct hashes one after another, sizes)."""

    def of(batch, name="text"):
        for lo, hi, data, off in slices(batch, name):
            w = words(data, off, True)
            at, h = windows(w, k, whole=True)
            doc = np.searchsorted(w.hi, at, "right")
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            h, doc = h[new], doc[new]
            yield lo, hi, h, np.bincount(doc, minlength=hi - lo)

    return of


def _digests(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    end = np.cumsum(n)
    return tuple(mix(r.span(r.prefix(mix(h + U(c))), end - n, end) + n.astype(U)).view(np.int64) for r, c in ((FIRST, 11), (SECOND, 23)))


def _first_rows(k: int, percent: int, slack: float) -> Callable:
    sets = _sets(k)

    def run(batches):
        for b in batches:
            for lo, hi, h, n in sets(b):
                d, e = _digests(h, n)
                size = np.minimum(n, n - least_overlap(n, percent) + np.maximum(1, np.floor(slack * n).astype(np.int64)))
                start = np.cumsum(n) - n
                at = np.arange(len(h)) - np.repeat(start, n)
                head = at < np.repeat(size, n)
                rows = np.repeat(np.arange(hi - lo), n)[head]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(n), pa.array(size), pa.array(d), pa.array(e), _lists(h[head].view(np.int64), rows, hi - lo)], ["id", "tk", "n", "s", "d", "e", "head"])

    return run


def _shared(rows: DataFrame, list_col: str) -> DataFrame:
    """(node, alone): how many values of the list of each of `rows` (node, list) no other row has; none where it has none.

    A value goes out once for some rows of each Arrow batch, as seen once or more often, and is added up before the shuffle."""

    def run(batches):
        for b in batches:
            values, node = b.column(1), b.column(0)
            flat, ends = values.flatten().to_numpy(zero_copy_only=False), values.offsets.to_numpy()
            ends, lo = ends - ends[0], 0
            while lo < b.num_rows:  # some rows at a time, so that memory doesn't follow the longest sets of a batch
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + STEP, "right")) - 1)
                h = flat[ends[lo] : ends[hi]]
                if len(h):
                    order = np.argsort(h, kind="stable")
                    h = h[order]
                    at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                    twice = np.diff(np.append(at, len(h))) > 1  # by different rows, as a set has no value twice
                    row = np.searchsorted(ends, order[at] + ends[lo], "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(h[at]), node.take(pa.array(row)), pa.array(1 + twice.astype(np.int32))], ["h", "node", "c"])
                lo = hi

    sent = rows.select("node", list_col).mapInArrow(lean(run), "h long, node long, c int")
    one = sent.groupBy("h").agg(F.sum("c").alias("c"), F.min("node").alias("node")).filter("c = 1")
    return one.groupBy("node").agg(F.count("*").alias("alone"))


def _bloom(keys: DataFrame) -> np.ndarray:
    """A bit for each key in a table of fixed size."""
    bit = F.pmod(F.xxhash64(F.lit(7), F.col("node")), F.lit(BLOOM * 64))
    got = keys.select((bit / 64).cast("long").alias("w"), (bit % 64).cast("int").alias("b")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("x")).toPandas()
    out = np.zeros(BLOOM, np.int64)
    out[got.w] = got.x
    return out


def merged_runs(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(value, number of runs that have it) of runs: a heap merges few entries, a stable sort, which merges the
    ascending stretches it finds, many."""
    if sum(map(len, runs)) <= HEAP:
        flat = np.fromiter(heapq.merge(*(np.sort(r).tolist() for r in runs)), np.int64)
    else:
        flat = np.concatenate(runs)
        flat.sort(kind="stable")
    at = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, np.int64)
    return flat[at], np.diff(np.append(at, len(flat)))


class _Lists:
    """Posting lists of some sets, each list ordered by the component that a set was in when this was built. A query
    passes over the sets of its own component without looking at them."""

    def __init__(self, token: np.ndarray, owner: np.ndarray, label: np.ndarray, m: int):
        self.m, self.label = m, label
        key = token.astype(np.int64) * m + label[owner]
        order = np.argsort(key, kind="stable")
        self.key, self.owner = key[order], owner[order]

    def others(self, tokens: np.ndarray, q: int) -> tuple[np.ndarray, ...]:
        """For each token the bounds of its list and, within, of the sets in q's component."""
        first = tokens.astype(np.int64) * self.m
        return tuple(np.searchsorted(self.key, x) for x in (first, first + self.label[q], first + self.label[q] + 1, first + self.m))


def divide_skip(sets: list[np.ndarray], sizes: np.ndarray, percent: int, sides: np.ndarray | None = None, mu: float = 0.01, count: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(local root, number of links) of each set, by T-occurrence search over inverted lists.

    With `sides`, only links between a set of side 0 and one of side 1 count. Without `count` only the roots are asked
    for: then what is in a query's component already is passed over, so that of a group of near copies the first queries
    join most and the others find nothing left to look at. Lists are built again after 1, 2, 4, ... queries, with
    the components of that time and without the sets that were queries."""
    m = len(sets)
    side = np.zeros(m, np.int64) if sides is None else np.asarray(sides, np.int64)
    # sides take turns, so that both are drawn into components early
    turn = np.empty(m, np.int64)
    for s in (0, 1):
        own = np.flatnonzero(side == s)
        turn[own] = 2 * np.arange(len(own)) + s
    order = np.argsort(turn, kind="stable")
    size, side = np.asarray(sizes, np.int64)[order], side[order]
    start = np.cumsum(size) - size
    _, token = np.unique(np.concatenate([np.zeros(0, np.int64), *[sets[k] for k in order]]), return_inverse=True)
    token, owner = token.astype(np.int32), np.repeat(np.arange(m, dtype=np.int32), size)
    comp, links = np.arange(m), np.zeros(m, np.int64)
    need = least_overlap(size, percent)
    biggest = int(np.bincount(token).max()) if len(token) else 1
    lists: dict[int, _Lists] = {}
    for q in range(m):
        if q & (q - 1) == 0:  # 0, 1, 2, 4, ...
            left = start[q] if q < m else len(token)
            label = np.arange(m) if count else comp
            lists = {s: _Lists(token[left:][mask], owner[left:][mask], label, m) for s in ((0, 1) if sides is not None else (0,)) for mask in [side[owner[left:]] == s]}
        index = lists[1 - side[q]] if sides is not None else lists[0]
        own = token[start[q] : start[q] + size[q]]
        begin, mine, after, end = index.others(own, q)
        length = (mine - begin) + (end - after)
        t = int(need[q])
        # DivideSkip's rule for how many of the longest lists to leave out of the merge
        skip = min(t - 1, int(t / (mu * np.log2(max(biggest, 2)) + 1)))
        by_length = np.argsort(length, kind="stable")
        short, long = by_length[: len(own) - skip], by_length[len(own) - skip :]
        runs = [index.owner[x:z] for k in short[length[short] > 0] for x, z in ((begin[k], mine[k]), (after[k], end[k])) if z > x]
        if not runs:
            continue
        # within a list sets of one component ascend, of several they need not
        found, seen = merged_runs(runs)
        fits = (found > q) & (seen >= t - skip) & (100 * np.minimum(size[found], size[q]) >= percent * np.maximum(size[found], size[q])) & (comp[found] != comp[q] if not count else True)
        found, seen = found[fits], seen[fits]
        for i, k in enumerate(long[::-1]):  # probes, the longest last to leave few candidates
            if not len(found):
                break
            # a list's sets are looked up under their component
            want = np.int64(own[k]) * m + index.label[found]
            x, z = np.searchsorted(index.key, want), np.searchsorted(index.key, want, "right")
            seen = seen + _held(index.owner, x, z, found)
            rest = len(long) - 1 - i
            alive = 100 * (seen + rest) >= percent * (size[found] + size[q] - seen - rest)
            found, seen = found[alive], seen[alive]
        near = found[100 * seen >= percent * (size[found] + size[q] - seen)]
        if len(near):
            links[q] += len(near)
            links[near] += 1
            joined = np.unique(np.append(comp[near], comp[q]))
            if len(joined) > 1:
                to = np.arange(m)
                to[joined] = joined[0]
                comp = to[comp]
    root, back = np.empty(m, np.int64), np.empty(m, np.int64)
    back[order] = links
    root[order] = order[comp]
    # the first set of each component stands for it
    first = np.full(m, m)
    np.minimum.at(first, root, np.arange(m))
    return first[root], back


def _held(owner: np.ndarray, x: np.ndarray, z: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Whether each wanted set stands in its ascending stretch x..z, by binary search of all at once."""
    low, high = x.copy(), z.copy()
    while (low < high).any():
        mid = (low + high) // 2
        less = (low < high) & (owner[np.minimum(mid, len(owner) - 1)] < wanted)
        low, high = np.where(less, mid + 1, low), np.where(less, high, np.minimum(mid, high))
    return (low < z) & (owner[np.minimum(low, len(owner) - 1)] == wanted)


def _search(percent: int, count: bool) -> Callable:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "node"], ignore_index=True)
        root, links = divide_skip(list(rows["set"]), rows["n"].to_numpy(), percent, rows["side"].to_numpy() if key[1:3] != key[3:5] else None, count=count)
        node = rows["node"].to_numpy()
        return pd.DataFrame({"node": node, "near": node[root], "links": links})

    return run


def _classified(docs: DataFrame, k: int, percent: int, slack: float, shard: int, count: bool) -> tuple[DataFrame, DataFrame]:
    """(id, tk, n, d, e) of each row, tk being a hash of its text; and (d, e, root, least, n_links) of each set."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tk"))
    heads, at = stored(rows.mapInArrow(lean(_first_rows(k, percent, slack)), "id long, tk long, n long, s long, d long, e long, head array<long>"))
    light = written(heads.select("id", "tk", "n", "s", "d", "e"))
    # an id that stands for several sets can't name its class
    clash = light.groupBy("id").agg(F.min(F.struct("d", "e")).alias("a"), F.max(F.struct("d", "e")).alias("z")).filter("a <> z").select("id", F.lit(True).alias("clash"))
    first = light.filter("n > 0").groupBy("d", "e").agg(F.min(F.struct("id", "n", "s")).alias("f"))
    classes = written(first.select("d", "e", "f.*").join(clash, "id", "left").withColumn("node", F.when(F.col("clash"), F.xxhash64("id", "d", "e")).otherwise(F.col("id"))).drop("clash"))
    lists = heads.filter("n > 0").groupBy("d", "e").agg(F.first("head").alias("head")).join(classes.select("d", "e", "node"), ["d", "e"])
    # large tables go as soon as the next one is written: at most two lie side by side
    parts, old = _links(rows, lists, classes, at, k, percent, slack, shard, count)
    found, found_at = stored(parts)
    removed(spark, *old)
    roots = components(found.filter("node <> near").select(F.col("node").alias("u"), F.col("near").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    named = classes.select("d", "e", "id", "node").join(roots, "node", "left").join(links, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("id").alias("least"))
    named = written(named.join(least, "root").select("d", "e", "root", "least", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    removed(spark, found_at)
    return light.drop("s"), named


def similar_sets(docs: DataFrame, k: int = 4, percent: int = 85, slack: float = SLACK, shard: int = SHARD, links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of each row of `docs`; without `links` the last column is left out and
    pairs that a component joins already are not looked at, which makes large groups of near copies cheap.

    component_id is the smallest doc_id that links reach; n_links counts the different linked sets. A text
    of 1 to k-1 words is one shingle; null, empty and blank texts have none and link with nothing. A null
    id comes after all others; rows of one id are told apart by their sets. Repeated rows get equal
    results; an empty table gives an empty result. Texts are read whole, other columns left out."""
    light, named = _classified(docs, k, percent, slack, shard, links)
    out = light.join(named, ["d", "e"], "left")
    known = lambda c: F.when(c != NULL_ID, c)
    own = [known(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), known(F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id"))).alias("component_id")]
    return out.select(*own, *([F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")] if links else []))


def _links(rows: DataFrame, lists: DataFrame, classes: DataFrame, lists_at: str, k: int, percent: int, slack: float, shard: int, count: bool) -> tuple[DataFrame, list[str]]:
    """(node, near, links), parts of the answer to be unioned and summed; and the tables that they come from."""
    spark = rows.sparkSession
    # a linked set may be smaller: what is asked follows the least size it can have
    asked = f"greatest(1, floor({slack}D * ceil({percent} * n / 100)))"
    alone = lambda c: F.col(c) - F.coalesce("alone", F.lit(0))
    alive = classes.join(_shared(lists.select("node", "head"), "head"), "node", "left")
    alive = written(alive.filter(alone("s") >= F.expr(asked)).select("node", "id", "d", "e"))
    removed(spark, lists_at)
    bloom = spark.sparkContext.broadcast(_bloom(alive.select(F.col("id").alias("node")).distinct()))
    own = rows.withColumn("bit", F.pmod(F.xxhash64(F.lit(7), F.col("id")), F.lit(BLOOM * 64)))
    sets = _sets(k)

    def whole(batches):
        table_ = bloom.value.view(U)
        for b in batches:
            bit = b.column(2).to_numpy()
            kept = b.filter(pa.array((table_[bit // 64] >> (bit % 64).astype(U)) & U(1) == U(1)))
            if not kept.num_rows:
                continue
            for lo, hi, h, n in sets(kept):
                d, e = _digests(h, n)
                doc = np.repeat(np.arange(hi - lo), n)
                yield pa.RecordBatch.from_arrays([kept.column(0).slice(lo, hi - lo), pa.array(d), pa.array(e), pa.array(n), _lists(h.view(np.int64), doc, hi - lo)], ["id", "d", "e", "n", "set"])

    full = own.select("id", "text", "bit").mapInArrow(lean(whole), "id long, d long, e long, n long, set array<long>")
    full, at = stored(full.join(alive, ["id", "d", "e"]).select("node", "n", "set").dropDuplicates(["node"]))
    enough = f"ceil({percent} * n / 100)"
    for _ in range(2):
        full, new = stored(full.join(_shared(full, "set"), "node", "left").filter(alone("n") >= F.expr(enough)).select("node", "n", "set"))
        removed(spark, at)
        at = new
    # the rarest shared shingles of each set
    each = full.select("node", "n", F.explode("set").alias("h"))
    df = each.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    rare = each.join(df, "h").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("x"))
    rare = rare.select("node", F.explode(F.slice("x", F.lit(1), F.greatest(F.lit(0), F.size("x") - F.expr(enough).cast("int") + 1))).alias("x")).select("node", "x.h")
    lead = rare.groupBy("h").agg(F.min("node").alias("v"))
    group = components(rare.join(lead, "h").select(F.col("node").alias("u"), "v").filter("u <> v").distinct())
    sized, new = stored(full.join(group.withColumnRenamed("root", "grp"), "node"))
    removed(spark, at)
    weights = written(sized.groupBy("grp").agg(F.sum("n").alias("w")))  # a small table's join needs no shuffle of the sets
    bins = max(1, -(-int(sized.agg(F.sum("n")).first()[0] or 0) // shard))
    # sizes of linked sets differ by 100 / percent at most, so by one level; a little more keeps rounding out of it
    level = F.floor(F.log("n") / float(np.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1.0))
    placed = sized.join(weights, "grp")
    # small groups share a task; of a large one each shard meets those of its own size level and of the next ones
    small = placed.filter(F.col("w") <= shard).select(F.pmod(F.xxhash64("grp"), F.lit(bins)).alias("g"), *[F.lit(-1).cast("long").alias(c) for c in "xayb"], F.lit(0).alias("side"), "node", "n", "set")
    large = placed.filter(F.col("w") > shard).withColumn("x", level)
    size = F.least(F.lit(float(max(MOST, shard))), F.greatest(F.lit(float(shard)), GROWTH * F.sqrt(F.sum("n"))))
    cells = written(large.groupBy("grp", "x").agg(F.ceil(F.sum("n") / size).alias("parts")))
    large = large.join(cells, ["grp", "x"]).withColumn("a", F.pmod(F.xxhash64("node"), F.col("parts")))
    for step, name in ((-1, "below"), (1, "above")):
        large = large.join(cells.select("grp", (F.col("x") - step).alias("x"), F.col("parts").alias(name)), ["grp", "x"], "left")
    others = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    meet = lambda x, a, y, b, side: F.struct(x.alias("x"), a.alias("a"), y.alias("y"), b.alias("b"), side.cast("int").alias("side"))
    x, a, none = F.col("x"), F.col("a"), F.array().cast("array<struct<x:bigint,a:bigint,y:bigint,b:bigint,side:int>>")
    same = F.transform(others(F.col("parts")), lambda o: meet(x, F.least(a, o), x, F.greatest(a, o), a > o))
    up = F.when(F.col("above").isNotNull(), F.transform(others(F.col("above")), lambda o: meet(x, a, x + 1, o, F.lit(0))))
    down = F.when(F.col("below").isNotNull(), F.transform(others(F.col("below")), lambda o: meet(x - 1, o, x, a, F.lit(1))))
    large = large.withColumn("to", F.explode(F.concat(same, F.coalesce(up, none), F.coalesce(down, none)))).select(F.col("grp").alias("g"), "to.*", "node", "n", "set")
    keys = ["g", "x", "a", "y", "b"]
    return small.unionByName(large).repartition(shuffle_partitions(spark), *keys).groupBy(*keys).applyInPandas(_search(percent, count), "node long, near long, links long"), [new]


def near_duplicates_removed(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of `docs`, with all its columns: that of the smallest doc_id, a null one last, and of
    several texts with that id the one with the smallest hash. Rows without words are linked with nothing and stay.
    Of rows with one id and one text, also without any id, one stays."""
    light, named = _classified(docs, k, percent, SLACK, SHARD, False)
    rows = light.groupBy("id", "tk").agg(F.first("d").alias("d"), F.first("e").alias("e"), F.max("n").alias("n"), F.count("*").alias("m"))
    best = rows.filter("n > 0").join(named, ["d", "e"]).groupBy("root").agg(F.min(F.struct("id", "tk")).alias("f")).select("f.*")
    one, two = unused(docs, "one", "two")
    lost = rows.filter("n > 0").join(best, ["id", "tk"], "left_anti").select(F.col("id").alias(one), F.col("tk").alias(two))
    often = rows.filter("m > 1").select(F.col("id").alias(one), F.col("tk").alias(two))
    lost, often = written(lost), written(often)
    out = docs.withColumns({one: F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), two: F.xxhash64(F.coalesce("text", F.lit("")))})
    out = out.join(lost, [one, two], "left_anti")
    # only rows that repeat are looked at as a whole
    single, several = out.join(often, [one, two], "left_anti"), out.join(often, [one, two], "left_semi").dropDuplicates([one, two])
    return single.unionByName(several).select(*docs.columns)


def op6_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """similar_sets() of all documents: nulls, ties, repeated rows and empty tables as stated there."""
    return similar_sets(table(spark, sf_dir, "documents"), links=False)
