"""The compressed design without listing every dyad.

Dyads that no tie and no shared partner touches differ only by what their two vertices are: their rows are
counted, class of vertices by class of vertices, as all pairs of the classes minus the touched and the
unobserved ones. Work follows the ties and two-paths instead of the square of the vertices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.network import HUB, Network
from arcweave.operators.base import TermSet
from arcweave.plans import tiles

#: Pairs of vertex classes at most; with more, listing the dyads is no worse.
CLASS_PAIRS = 4_000_000
#: Vertices whose classes are broadcast at most; paths that a task adds up, about.
LIST_VERTICES, LIST_ROWS = 2_000_000, 1_000_000


def touched(net: Network, terms: TermSet) -> DataFrame:
    """(i, j, y, r) of the observed dyads with a tie either way, a shared partner or a covariate."""
    pairs = net.either
    if any(t.reach >= 2 for t in terms):
        pairs = pairs.unionByName(net.shared_partners("union" if net.directed else "und").select(F.col("a").alias("i"), F.col("b").alias("j")))
    for t in terms:
        if (own := t.touches(net)) is not None:
            pairs = pairs.unionByName(own)
    pairs = (pairs if net.directed else pairs.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))).distinct()
    pairs = net.observed(pairs)
    own = net.arcs.select("i", "j", F.lit(1).alias("y"))
    got = pairs.join(own, ["i", "j"], "left").fillna(0, ["y"])
    if not net.directed:
        return got.withColumn("r", F.col("y"))
    back = net.arcs.select(F.col("j").alias("i"), F.col("i").alias("j"), F.lit(1).alias("r"))
    return got.join(back, ["i", "j"], "left").fillna(0, ["r"])


def touched_rows(net: Network, terms: TermSet) -> int:
    """About so many rows of paths are gone through to find the touched dyads: from the degrees, without a join."""
    reach = max(t.reach for t in terms)
    return int(net.degrees.agg(F.sum(F.pow(F.col("d").cast("double"), F.lit(float(reach))))).first()[0] or 0)


def classes(net: Network, terms: TermSet) -> DataFrame:
    """(v, cls): cls is the least vertex with the same attributes and degrees, as far as the terms look at them."""
    need = sorted({a for t in terms for a in t.required_vertex_attributes})
    own = net.vertices.select("v", *[F.col(c).alias(f"k{n}") for n, c in enumerate(need)])
    keys = [f"k{n}" for n in range(len(need))]
    if sides := sorted({s for t in terms if t.untouched == "degrees" for s in t.degree_sides}):
        own, keys = own.join(net.degrees.select("v", *sides), "v"), [*keys, *sides]
    if not keys:
        return own.select("v", F.lit(0).cast("long").alias("cls"))
    least = own.groupBy(*keys).agg(F.min("v").alias("cls"))
    match = None
    for k in keys:
        same = own[k].eqNullSafe(least[k])
        match = same if match is None else match & same
    return own.join(least, match).select("v", "cls")


def few_classes(net: Network, terms: TermSet) -> bool:
    """Whether complement() would list the pairs of classes."""
    return classes(net, terms).select("cls").distinct().count() ** 2 <= CLASS_PAIRS


def supported(net: Network, terms: TermSet) -> bool:
    return all(t.untouched is not None and t.idle_column(net) is not None for t in terms)


def known(net: Network, terms: TermSet) -> DataFrame:
    """(v, attributes and degrees that the terms look at in an untouched dyad)"""
    need = sorted({a for t in terms for a in t.required_vertex_attributes})
    own = net.vertices.select("v", *need)
    return own.join(net.degrees.select("v", "dout", "din", "d"), "v") if any(t.untouched == "degrees" for t in terms) else own


def idle(net: Network, terms: TermSet, pairs: DataFrame) -> DataFrame:
    """Adds the changes s0, s1, ... of the pairs (i, j), taken as untouched, to their other columns."""
    own, keep = known(net, terms), [c for c in pairs.columns if c not in ("i", "j")]
    for e in ("i", "j"):
        pairs = pairs.join(own.toDF(e, *[f"{c}_{e}" for c in own.columns[1:]]), e)
    return pairs.select(*keep, *[t.idle_column(net).cast("double").alias(f"s{k}") for k, t in enumerate(terms)])


def paired(net: Network, own: DataFrame) -> DataFrame:
    """(i, j, s, y, n_tot) of an undirected network: how many touched dyads of two classes share s partners and are tied or not;
    i and j stand for their classes, which `own` (v, cls) has.

    A vertex sends each neighbour the list of its neighbours, so lists are shuffled instead of paths, each of them once
    and only the part beyond the receiver. Hubs send theirs in blocks. A receiver adds its lists up where they arrive."""
    small = F.broadcast if net.n <= LIST_VERTICES else lambda t: t
    both = net.pairs.join(small(own.toDF("i", "ci")), "i").join(small(own.toDF("j", "cj")), "j")
    sizes = both.groupBy("i").agg(F.ceil(F.count("*") / HUB).cast("int").alias("np")).filter("np > 1").withColumnRenamed("i", "k")
    parts = F.coalesce(F.col("np"), F.lit(1))
    out = both.select(F.col("i").alias("k"), F.col("j").alias("b"), F.col("cj").alias("c")).join(sizes, "k", "left").withColumn("p", F.pmod(F.xxhash64("b"), parts).cast("int"))
    lists = out.groupBy("k", "p").agg(F.sort_array(F.collect_list(F.struct("b", "c"))).alias("e")).select("k", "p", F.col("e.b").alias("bs"), F.col("e.c").alias("cs"))
    to = both.select(F.col("i").alias("a"), F.col("ci").alias("ca"), F.col("j").alias("k")).join(sizes, "k", "left").select("a", "ca", "k", F.explode(F.sequence(F.lit(0), parts - 1)).alias("p"))
    sent = to.join(lists, ["k", "p"]).withColumn("at", F.size(F.filter("bs", lambda b: b <= F.col("a")))).filter("at < size(bs)")
    beyond = lambda c: F.slice(c, F.col("at") + 1, F.size(c) - F.col("at")).alias(c)
    sent = sent.select("a", "ca", beyond("bs"), beyond("cs"), F.lit(1).alias("s"), F.lit(0).alias("y"))
    ties = both.filter("i < j").groupBy(F.col("i").alias("a"), F.col("ci").alias("ca")).agg(F.collect_list(F.struct("j", "cj")).alias("e"))
    sent = sent.unionByName(ties.select("a", "ca", F.col("e.j").alias("bs"), F.col("e.cj").alias("cs"), F.lit(0).alias("s"), F.lit(1).alias("y")))
    rows = int(net.degrees.agg(F.sum(F.col("d").cast("double") * F.col("d"))).first()[0] or 0) // 2
    tasks = max(int(net.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // LIST_ROWS))
    each = sent.repartition(tasks, "a").select("a", "ca", "cs", "s", "y", F.posexplode("bs").alias("pos", "b"))
    each = each.groupBy("a", "ca", "b", F.get("cs", "pos").alias("cb")).agg(F.sum("s").alias("s"), F.max("y").alias("y"))
    return each.groupBy(F.least("ca", "cb").alias("i"), F.greatest("ca", "cb").alias("j"), "s", "y").agg(F.count("*").alias("n_tot"))


def complement(net: Network, terms: TermSet, listed: DataFrame, own: DataFrame | None = None) -> DataFrame | None:
    """(i, j, y, r, n_tot): one row for each pair of classes with untouched dyads, i and j standing for their classes.
    None if there are too many classes. With `own`, the classes, `listed` is what paired() gives."""
    counted, own = own is not None, classes(net, terms).cache() if own is None else own
    told = own.withColumn("told", F.lit(1)) if net.silent is None else own.join(net.silent.withColumn("gone", F.lit(1)), "v", "left").withColumn("told", F.when(F.col("gone").isNull(), 1).otherwise(0))
    sizes = told.groupBy("cls").agg(F.count("*").alias("m"), F.sum("told").alias("told"), F.min("v").alias("v"))
    if sizes.count() ** 2 > CLASS_PAIRS:
        own.unpersist()
        return None
    out = listed.select("i", "j", *(["n_tot"] if counted else []))
    if net.missing is not None:
        out = out.unionByName(net.missing.select("i", "j"))
    small = F.broadcast if tiles.fits(net) else lambda t: t
    met = out.join(small(own.select(F.col("v").alias("i"), F.col("cls").alias("a"))), "i").join(small(own.select(F.col("v").alias("j"), F.col("cls").alias("b"))), "j")
    if not net.directed:
        met = met.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})
    used = met.groupBy("a", "b").agg((F.sum("n_tot") if counted else F.count("*")).alias("used"))
    one = sizes.select(F.col("cls").alias("a"), F.col("told").alias("ma"), F.col("m").alias("whole"), F.col("v").alias("i"))
    two = sizes.select(F.col("cls").alias("b"), F.col("m" if net.directed else "told").alias("mb"), F.col("v").alias("j"))
    every = one.join(F.broadcast(two), F.lit(True) if net.directed else F.col("a") <= F.col("b"))  # at most CLASS_PAIRS rows
    same = F.col("a") == F.col("b")
    # a silent vertex sends none of its dyads, in an undirected network it has none
    pairs = F.when(same, F.col("ma") * (F.col("whole") - 1) if net.directed else F.col("ma") * (F.col("ma") - 1) / 2).otherwise(F.col("ma") * F.col("mb"))
    if net.rule:
        used = used.unionByName(net.ruled(own).withColumnRenamed("hidden", "used")).groupBy("a", "b").agg(F.sum("used").alias("used"))
    left = every.join(used, ["a", "b"], "left").withColumn("n_tot", pairs.cast("long") - F.coalesce("used", F.lit(0)))
    return left.filter("n_tot > 0").select("i", "j", F.lit(0).alias("y"), F.lit(0).alias("r"), "n_tot")
