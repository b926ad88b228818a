"""Degree, shared-partner and distance distributions of many networks at once, keyed by sim_id."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from arcweave.network import Network
from arcweave.mcmc.sample import MAX_VERTICES
from arcweave.operators.structural import KINDS
from arcweave.plans.scratch import cleared, removed, stored, with_row_numbers


def degree_counts(arcs: DataFrame, vertices: DataFrame, directed: bool, side: str, sims: DataFrame) -> DataFrame:
    """(sim_id, label, c) of `arcs` (sim_id, i, j), labels being degrees; vertices without ties have degree 0."""
    ends = {"odegree": ["i"], "idegree": ["j"], "degree": ["i", "j"]}[side]
    touched = None
    for e in ends:
        part = arcs.select("sim_id", F.col(e).alias("v"))
        touched = part if touched is None else touched.unionAll(part)
    each = touched.groupBy("sim_id", "v").agg(F.count("*").alias("label"))
    some = each.groupBy("sim_id", "label").agg(F.count("*").alias("c"))
    n = vertices.count()
    zero = sims.join(some.groupBy("sim_id").agg(F.sum("c").alias("k")), "sim_id", "left").select("sim_id", F.lit(0).cast("long").alias("label"), (F.lit(n) - F.coalesce("k", F.lit(0))).alias("c"))
    return some.unionByName(zero.filter("c > 0"))


def shared_partner_counts(arcs: DataFrame, directed: bool, kind: str = "OTP") -> DataFrame:
    """(sim_id, label, c): ties by the number of partners that their ends share."""
    if kind not in KINDS:
        raise ValueError(f"type must be one of {', '.join(KINDS)}")
    own = arcs.select("sim_id", "i", "j")
    both = own.unionAll(own.select("sim_id", F.col("j").alias("i"), F.col("i").alias("j")))
    base = both if not directed else both.distinct() if kind == "union" else own
    near, far = {"OTP": ("j", "i"), "ITP": ("j", "i"), "OSP": ("j", "j"), "ISP": ("i", "i"), "union": ("j", "i")}[kind if directed else "union"]
    other = {"i": "j", "j": "i"}
    x = base.select("sim_id", F.col(other[near]).alias("a"), F.col(near).alias("k"))
    z = base.select("sim_id", F.col(far).alias("k"), F.col(other[far]).alias("b"))
    a, b = ("b", "a") if directed and kind == "ITP" else ("a", "b")
    sp = x.join(z, ["sim_id", "k"]).filter("a <> b").groupBy("sim_id", F.col(a).alias("i"), F.col(b).alias("j")).agg(F.count("*").alias("s"))
    return own.join(sp, ["sim_id", "i", "j"], "left").groupBy("sim_id", F.coalesce("s", F.lit(0)).cast("long").alias("label")).agg(F.count("*").alias("c"))


def distances(a: np.ndarray) -> np.ndarray:
    """Number of ordered pairs at each distance from 1, out-distances when directed."""
    m = a.astype(np.float32)
    seen = a | np.eye(len(a), dtype=bool)
    front, out = a & ~np.eye(len(a), dtype=bool), []
    while front.any():
        out.append(int(front.sum()))
        front = (front.astype(np.float32) @ m > 0) & ~seen
        seen |= front
    return np.array(out, np.int64)


def distance_counts(arcs: DataFrame, vertices: DataFrame, directed: bool) -> DataFrame:
    """(sim_id, label, c): ordered pairs by distance; pairs that nothing joins are left out. One network is a task,
    so it may have MAX_VERTICES vertices; geodesics() has no such limit."""
    if vertices.count() > MAX_VERTICES:
        raise ValueError(f"distances of a network in one task are for at most {MAX_VERTICES} vertices; geodesics() takes any")
    ids = np.array(sorted(r[0] for r in vertices.select("v").collect()), np.int64)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((len(ids), len(ids)), bool)
        i, j = np.searchsorted(ids, rows["i"]), np.searchsorted(ids, rows["j"])
        a[i, j] = True
        if not directed:
            a[j, i] = True
        c = distances(a)
        return pd.DataFrame({"sim_id": np.int32(key[0]), "label": np.arange(1, len(c) + 1), "c": c})

    return arcs.groupBy("sim_id").applyInPandas(run, "sim_id int, label long, c long")


#: Sources that one row of the search carries, 64 to a column; rows of the search at most at once (of vertices times rows
#: of sources).
WORDS, STATES = 8, 8_000_000


def geodesics(net: Network, depth: int | None = None) -> DataFrame:
    """(d, c): ordered pairs by distance, out-distances when directed; pairs that nothing joins are left out.

    A breadth-first search from many sources at once: a row stands for a vertex and a group of 512 sources and holds a bit
    for each source that reached it. A round sends the newly reached bits along the ties and ors them, so no pair is ever
    a row: n vertices make n * n / 512 rows at most. Groups of sources are searched in batches of bounded size. Each round
    is a table in the shared folder, which the next one replaces, so lost executors repeat no more than a round; shuffle
    files go with each round too. `depth` ends the search early."""
    spark = net.spark
    with cleared(spark):
        ties, ends = stored(net.pairs.select(F.col("i").alias("v"), F.col("j").alias("to")))
        numbered, at = stored(with_row_numbers(net.vertices.select("v").distinct(), ["v"]))
        counts = _searched(net, ties, numbered, depth)
    removed(spark, at, ends)
    return spark.createDataFrame(sorted(counts.items()), "d long, c long")


def _searched(net: Network, ties: DataFrame, numbered: DataFrame, depth: int | None) -> dict[int, int]:
    """Ordered pairs by distance; `numbered` has the vertices with their numbers (v, row)."""
    spark = net.spark
    words = min(WORDS, net.n // 64 + 1)
    group = 64 * words
    batch = max(1, STATES // max(net.n, 1)) * group
    counts: dict[int, int] = {}
    old, new = [f"s{k}" for k in range(words)], [f"x{k}" for k in range(words)]
    for low in range(0, net.n, batch):
        source = numbered.filter(F.col("row").between(low, low + batch - 1)).withColumn("bit", F.expr("shiftleft(1L, cast(row % 64 as int))"))
        bits = [F.when(F.floor(F.col("row") / 64) % words == k, F.col("bit")).otherwise(F.lit(0).cast("long")) for k in range(words)]
        begin = source.select("v", F.floor(F.col("row") / group).alias("g"), *[b.alias(c) for b, c in zip(bits, old)])
        # sources of one group stand at different vertices, so nothing is added up here
        state, path = stored(begin.select("v", "g", *old, *[F.col(s).alias(x) for s, x in zip(old, new)]))
        d = 0
        while True:
            sent = state.filter(" or ".join(f"{x} <> 0" for x in new)).select("v", "g", *new).join(ties, "v").groupBy(F.col("to").alias("v"), "g").agg(*[F.bit_or(x).alias(x) for x in new])
            met = state.select("v", "g", *old, *[F.lit(0).cast("long").alias(x) for x in new]).unionByName(sent.select("v", "g", *[F.lit(0).cast("long").alias(s) for s in old], *new))
            both = met.groupBy("v", "g").agg(*[F.bit_or(c).alias(c) for c in (*old, *new)])
            fresh = [F.col(x).bitwiseAND(F.bitwise_not(F.col(s))) for s, x in zip(old, new)]
            both = both.select("v", "g", *[F.col(s).bitwiseOR(F.col(x)).alias(s) for s, x in zip(old, new)], *[f.alias(x) for f, x in zip(fresh, new)])
            seen = Observation()
            then, next_path = stored(both.observe(seen, F.sum(sum((F.bit_count(x) for x in new), F.lit(0))).alias("c")))
            removed(spark, path)
            state, path, d, c = then, next_path, d + 1, seen.get["c"]
            if c:
                counts[d] = counts.get(d, 0) + c
            if not c or (depth is not None and d >= depth):
                break
        removed(spark, path)
    return counts
