"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from arcweave.llm.frames import removed, stored


def _least(edges: DataFrame, paths: list[str]) -> DataFrame:
    """For each u its smallest neighbour or itself; hubs are pre-aggregated before the shuffle. A written table, so that
    the join with it is of two plain exchanges and the adaptive plan can split a hub's rows."""
    got, path = stored(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    paths.append(path)
    return got


def _large_star(edges: DataFrame, paths: list[str]) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both, paths), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame, paths: list[str]) -> DataFrame:
    down, path = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    paths.append(path)
    least = _least(down, paths)
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _counted(edges: DataFrame) -> tuple[DataFrame, str, tuple]:
    """The links as a written table, where it lies, and their number and the sum of their hashes, taken while writing."""
    seen = Observation()
    x = F.xxhash64("u", "v")
    got, path = stored(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(x % (1 << 31)).alias("low"), F.sum(F.shiftright(x, 32)).alias("high")))
    found = seen.get
    return got, path, (found["n"], found["low"], found["high"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of `edges` (u, v): root is the smallest node that links reach.

    Each round is a few shuffles of the links and a table in the shared folder; it ends when every node
    points at its root. No links give no rows. Nulls are left out, repeated links and loops do no harm."""
    now, at, state = _counted(edges.filter("u is not null and v is not null and u <> v").select("u", "v").distinct())
    for _ in range(rounds if state[0] else 0):
        used: list[str] = []
        new, path, then = _counted(_small_star(_large_star(now, used), used))
        removed(edges.sparkSession, at, *used)
        now, at = new, path
        # done when no root has a root of its own and the stars are flat
        if then == state:
            break
        state = then
    else:
        if state[0]:
            raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
