"""Sums over all dyads of a design that does not compress, without a table of dyads.

Vertices are cut into blocks with what the terms look at. A pair of blocks is a row; its dyads come out of the two
arrays, are evaluated and added up where they come out, so a task puts out one row of sums, whatever it went through,
and nothing of the order of the dyads is written or shuffled. All dyads are taken as untouched; the listed ones that a tie
or a shared partner touches, and the unobserved ones, put that right by weights of either sign.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.functions.weights import log1pexp, logistic
from arcweave.network import Network
from arcweave.operators.base import TermSet
from arcweave.plans.scratch import stored
from arcweave.plans.sparse import idle, known, touched

#: Vertices of a block on average.
BLOCK = 512


def corrections(net: Network, terms: TermSet, changes) -> DataFrame:
    """(s0, s1, ..., n_tot, n_one): rows of the touched dyads as they are, less the same dyads and the unobserved ones as
    untouched. `changes` gives (i, j, y, s0, ...) of listed dyads."""
    net.listed = listed = touched(net, terms)
    keys = [f"s{k}" for k in range(len(terms))]
    rows = changes(net, terms, listed).select(*keys, F.lit(1).cast("long").alias("n_tot"), F.col("y").cast("long").alias("n_one"))
    gone = listed.select("i", "j") if net.missing is None else listed.select("i", "j").union(net.missing.select("i", "j"))
    less = idle(net, terms, gone).withColumns({"n_tot": F.lit(-1).cast("long"), "n_one": F.lit(0).cast("long")})
    got = rows.unionByName(less).groupBy(*keys).agg(F.sum("n_tot").alias("n_tot"), F.sum("n_one").alias("n_one"))
    return stored(got.filter("n_tot <> 0 or n_one <> 0"))[0]


def block_pairs(net: Network, terms: TermSet, block: int = BLOCK) -> DataFrame:
    """(b, c, x, z): two blocks and their vertices, for each pair of blocks; in an undirected network for unordered ones."""
    own = known(net, terms)
    own = own.withColumn("told", F.lit(True)) if net.silent is None else own.join(net.silent.withColumn("gone", F.lit(1)), "v", "left").withColumn("told", F.col("gone").isNull()).drop("gone")
    blocks = max(1, -(-net.n // block))
    cut, _ = stored(own.groupBy(F.pmod(F.xxhash64("v"), F.lit(blocks)).alias("b")).agg(F.collect_list(F.struct(*own.columns)).alias("x")))
    tasks = min(blocks * blocks, 4 * net.spark.sparkContext.defaultParallelism + blocks * blocks // 64)
    pairs = net.spark.range(0, blocks * blocks, 1, tasks).select(F.floor(F.col("id") / blocks).alias("b"), (F.col("id") % blocks).alias("c"))
    if not net.directed:
        pairs = pairs.filter("b <= c")
    return pairs.join(cut, "b").join(cut.toDF("c", "z"), "c").select("b", "c", "x", "z")


def block_sums(net: Network, terms: TermSet, pairs: DataFrame, beta) -> list[float]:
    """Over all dyads as untouched ones: log-likelihood, gradient and upper triangle of the Hessian, in a row."""
    p = len(terms)
    columns = pairs.schema["x"].dataType.elementType.names
    each = pairs.select("b", "c", F.explode("x").alias("x"), "z").select("b", "c", "x", F.explode("z").alias("z"))
    # of unordered pairs two blocks meet once, and a block with itself has each dyad both ways; changes have no direction
    each = each.filter("x.v <> z.v" if net.directed else "b < c or x.v < z.v")
    if net.rule:
        each = net._answered(each.withColumns({"i": F.col("x.v"), "j": F.col("z.v")}))  # listed ones are put right beside
    if net.silent is not None:
        each = each.filter("x.told" if net.directed else "x.told and z.told")
    rows = each.select(*[F.col(f"x.{c}").alias(f"{c}_i") for c in columns], *[F.col(f"z.{c}").alias(f"{c}_j") for c in columns])
    rows = rows.select(*[t.idle_column(net).cast("double").alias(f"s{k}") for k, t in enumerate(terms)])
    rows = rows.withColumn("eta", sum((float(b) * F.col(f"s{k}") for k, b in enumerate(beta)), F.lit(0.0)))
    rows = rows.withColumn("q", logistic(F.col("eta")))
    sums = [F.sum(-log1pexp(F.col("eta")))] + [F.sum(-F.col(f"s{a}") * F.col("q")) for a in range(p)]
    sums += [F.sum(-F.col(f"s{a}") * F.col(f"s{b}") * F.col("q") * (1 - F.col("q"))) for a in range(p) for b in range(a, p)]
    return [float(v or 0) for v in rows.agg(*[s.alias(f"c{k}") for k, s in enumerate(sums)]).first()]
