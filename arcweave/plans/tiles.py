"""All dyads of a network, tile by tile, without a shuffle of dyads or paths.

Vertices fall into blocks by a hash; two blocks make a tile, which is a row of one partition from the start. Its
vertices, their ties' other ends and the ends of those come from broadcast lists (a row for each vertex), so what a tile
adds up for a dyad is complete in its task. Dyads that nothing was added up for are what is left of the tile's columns.
Lists are broadcast only while they are of checked size (fits()); larger networks take the joins in network.py.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vertices of a block on average; vertices and ties that are broadcast at most (16 bytes each, and as often as a term has ways).
BLOCK, MAX_VERTICES, MAX_TIES = 4_096, 1_000_000, 3_000_000
#: The way that marks a dyad's own tie, and the reverse one.
OWN, BACK = 8, 9


def fits(net) -> bool:
    return net.missing is None and net.silent is None and net.n <= MAX_VERTICES and net.n_edges <= MAX_TIES


def blocks(net) -> int:
    return max(-(-net.n // BLOCK), min(8, net.n // 256 + 1))


def block_of(net, v: str | Column) -> Column:
    return F.pmod(F.xxhash64(v), F.lit(blocks(net))).cast("int")


def members(net, block: str, vs: str) -> DataFrame:
    """(block, vs): the sorted vertices of each block."""
    own = net.vertices.select("v").filter("v is not null")
    return F.broadcast(own.groupBy(block_of(net, "v").alias(block)).agg(F.sort_array(F.collect_set("v")).alias(vs)))


def grid(net) -> DataFrame:
    """(id, p, b): tiles of rows p and columns b, each in a partition of its own. In an undirected network p <= b."""
    r = blocks(net)
    tiles = net.spark.range(0, r * r, 1, r * r).select("id", F.floor(F.col("id") / r).cast("int").alias("p"), (F.col("id") % r).cast("int").alias("b"))
    return tiles if net.directed else tiles.filter("p <= b")


def heads(net) -> DataFrame:
    """(id, p, b, x): the rows of each tile."""
    return grid(net).join(members(net, "p", "xs"), "p").select("id", "p", "b", F.explode("xs").alias("x"))


def spread(net, rows: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, *columns) of all dyads, from `rows` (id, p, b, x, list): the dyads of a row x that have values are in its
    list of (to, *columns), the others get nulls."""
    rest = F.when(F.size("list") > 0, F.array_except("zs", F.col("list.to"))).otherwise(F.col("zs"))
    kind = F.col("kind")
    got = rows.join(members(net, "b", "zs"), "b").withColumn("kind", F.explode(F.array(F.lit(0), F.lit(1))))
    got = got.select("p", "b", "x", "kind", "list", F.explode_outer(F.when(kind == 1, rest)).alias("z"))
    got = got.select("p", "b", "x", "z", F.explode_outer(F.when(kind == 0, F.col("list"))).alias("e"))
    got = got.select("p", "b", "x", F.coalesce(F.col("e.to"), F.col("z")).alias("z"), *[F.col(f"e.{c}").alias(c) for c in columns])
    return _placed(net, got).select("i", "j", *columns)


def _placed(net, rows: DataFrame) -> DataFrame:
    """Rows x and columns z as dyads (i, j), once each, but for those that a rule hides."""
    if net.directed:
        return net.observed(rows.filter("x <> z").withColumnsRenamed({"x": "i", "z": "j"}))
    # two blocks meet in one tile, a block with itself has each dyad both ways
    return net.observed(rows.filter("z is not null and (p < b or x < z)").withColumns({"i": F.least("x", "z"), "j": F.greatest("x", "z")}))


def couples(net) -> DataFrame:
    """(i, j) of all dyads."""
    return _placed(net, heads(net).join(members(net, "b", "zs"), "b").select("p", "b", "x", F.explode("zs").alias("z"))).select("i", "j")


def lists(net, rows: DataFrame, key: list[str], end: bool = False) -> DataFrame:
    """(*key, at, to, w, offs): for each vertex `at` its others in the order of their blocks, with the weights w, and where
    each block starts. `rows` has (*key, at, to, w). With `end`, others that are no vertices are left out."""
    if end:
        rows = rows.join(net.vertices.select(F.col("v").alias("to")), "to", "left_semi")
    own = rows.groupBy(*key, "at").agg(F.sort_array(F.collect_list(F.struct(block_of(net, "to").alias("blk"), "to", "w"))).alias("e"))
    start = F.transform(F.sequence(F.lit(0), F.lit(blocks(net))), lambda k: F.size(F.filter(F.col("e.blk"), lambda x: x < k)))
    return own.select(*key, "at", F.col("e.to").alias("to"), F.col("e.w").alias("w"), start.alias("offs"))


def hop(rows: DataFrame, table: DataFrame, at: str, to: str, w: str, block: Column | None = None, outer: bool = False) -> DataFrame:
    """Goes from each row's vertex `at` along its way to others, all or those of a block: adds `to` and `w`."""
    kept = [c for c in rows.columns]
    got = rows.join(F.broadcast(table.toDF("way", at, "_to", "_w", "_offs")), ["way", at], "left" if outer else "inner")
    own, first = F.col("_to"), F.lit(0)
    if block is not None:
        first = F.get("_offs", block)
        own = F.slice("_to", first + 1, F.get("_offs", block + 1) - first)
    step = F.posexplode_outer if outer else F.posexplode
    got = got.select(*kept, "_w", first.alias("_first"), step(own).alias("_pos", to))
    return got.select(*kept, to, F.get("_w", F.col("_first") + F.col("_pos")).alias(w))


def tied(net) -> DataFrame:
    """(i, j, y, r) of all dyads."""
    own = net.arcs.select(F.col("i").alias("at"), F.col("j").alias("to"), F.lit(1).alias("y"))
    back = own.select(F.col("to").alias("at"), F.col("at").alias("to"), "y")
    if net.directed:
        rows = own.withColumn("r", F.lit(0)).union(back.select("at", "to", F.lit(0), F.lit(1))).groupBy("at", "to").agg(F.max("y").alias("y"), F.max("r").alias("r"))
    else:
        rows = own.union(back).withColumn("r", F.col("y"))
    rows = rows.join(net.vertices.select(F.col("v").alias("to")), "to", "left_semi")
    lists = rows.groupBy(F.col("at").alias("x"), block_of(net, "to").alias("b")).agg(F.collect_list(F.struct("to", "y", "r")).alias("list"))
    got = spread(net, heads(net).join(F.broadcast(lists), ["x", "b"], "left"), ["y", "r"])
    return got.select("i", "j", F.coalesce("y", F.lit(0)).alias("y"), F.coalesce("r", F.lit(0)).alias("r"))


def _relation(net, name: str) -> DataFrame:
    """(at, to) along the ties: out, in, either; or same, each vertex to itself."""
    own = net.pairs
    if name == "same":
        return net.vertices.select(F.col("v").alias("at"), F.col("v").alias("to"))
    if name == "in":
        return own.select(F.col("j").alias("at"), F.col("i").alias("to"))
    return (net.either if name == "either" else own).select(F.col("i").alias("at"), F.col("j").alias("to"))


def relations(net, ways: dict[int, str | DataFrame], end: bool = False) -> DataFrame:
    """Lists of several ways in one table, for hop(): names of relations, or tables (at, to, w)."""
    got = None
    for k, rel in ways.items():
        rows = _relation(net, rel).withColumn("w", F.lit(0.0)) if isinstance(rel, str) else rel.select("at", "to", F.col("w").cast("double").alias("w"))
        rows = rows.withColumn("way", F.lit(k))
        got = rows if got is None else got.unionByName(rows)
    return lists(net, got, ["way"], end)


def gathered(net, rows: DataFrame, sums: dict[str, Column], dense: bool) -> DataFrame:
    """Dyads (i, j, *sums, y, r) from paths (id, p, b, way, x, z): all of them with the sums over a dyad's paths, 0 without any;
    or, not `dense`, those that a path or a tie joins."""
    mark = lambda k: F.max((F.col("way") == k).cast("int"))
    each = rows.groupBy("id", "p", "b", "x", "z").agg(*[s.alias(c) for c, s in sums.items()], mark(OWN).alias("y"), mark(BACK if net.directed else OWN).alias("r"))
    columns = [*sums, "y", "r"]
    if not dense:
        return _placed(net, each.filter("z is not null")).select("i", "j", *columns)
    item = F.when(F.col("z").isNotNull(), F.struct(F.col("z").alias("to"), *columns))
    got = spread(net, each.groupBy("id", "p", "b", "x").agg(F.collect_list(item).alias("list")), columns)
    return got.withColumns({c: F.coalesce(c, F.lit(0)) for c in columns})


def _marks(net) -> dict[int, str]:
    """Ways that mark ties: of an undirected network both are one."""
    return {OWN: "out", BACK: "in"} if net.directed else {OWN: "out"}


def two_paths(net, ways: dict[int, tuple], counted: list[int], times: bool = False, dense: bool = True) -> DataFrame:
    """(i, j, c, g, y, r) of all dyads, or of those that something joins: c paths of the ways `counted` lead from i to j, and g is the sum of both steps'
    weights over the paths of all ways; with `times`, c is the sum of their products. `ways` has the two steps of each."""
    one = relations(net, {k: a for k, (a, _) in ways.items()} | {k: "same" for k in _marks(net)})
    two = relations(net, {k: b for k, (_, b) in ways.items()} | _marks(net), True)
    rows = heads(net).withColumn("way", F.explode(F.array(*[F.lit(k) for k in (*ways, *_marks(net))])))
    rows = hop(hop(rows, one, "x", "k", "lw", outer=True), two, "k", "z", "rw", F.col("b"), outer=True)
    path = F.col("way").isin(*ways) & F.col("z").isNotNull()
    c = F.when(path & F.col("way").isin(*counted), F.col("lw") * F.col("rw") if times else F.lit(1)).otherwise(0)
    return gathered(net, rows, {"c": F.sum(c), "g": F.sum(F.when(path, F.col("lw") + F.col("rw")).otherwise(0.0))}, dense)


def three_paths(net, ways: dict[int, tuple], weigh, dense: bool = True) -> DataFrame:
    """(i, j, g, y, r) of all dyads, or of those that something joins: each vertex of a tile reaches others by s paths of two steps; g is the sum of weigh(s)
    of those that reach the dyad's other end by the third step. A way is (side, three steps): side 0 starts from the tile's
    rows, side 1 from its columns."""
    marks = _marks(net)
    steps = [{k: w[1][n] for k, w in ways.items()} for n in range(3)]
    same = {k: "same" for k in marks}
    one, two, three = relations(net, steps[0] | same), relations(net, steps[1] | same), relations(net, steps[2] | marks, True)
    side = {k: w[0] for k, w in ways.items()} | {k: 0 for k in marks}
    start = F.array(*[F.struct(F.lit(k).alias("way"), F.col("b" if side[k] else "p").alias("m")) for k in side])
    far = F.col("way").isin(*[k for k in side if side[k]])
    rows = grid(net).withColumn("e", F.explode(start)).select("id", "p", "b", "e.way", "e.m")
    rows = rows.join(members(net, "m", "vs"), "m").select("id", "p", "b", "way", F.explode("vs").alias("v"))
    rows = hop(hop(rows, one, "v", "k", "lw", outer=True), two, "k", "u", "rw", outer=True)
    met = rows.groupBy("id", "p", "b", "way", "v", "u").agg(F.count("*").alias("s"))
    # a vertex is no partner of itself, but keeps its row of the tile
    met = met.withColumn("u", F.when((F.col("u") != F.col("v")) | F.col("way").isin(*marks), F.col("u")))
    got = hop(met.withColumn("q", F.when(F.col("way").isin(*marks), 0.0).otherwise(weigh(F.col("s")))), three, "u", "to", "_", F.when(far, F.col("p")).otherwise(F.col("b")), outer=True)
    got = got.filter(~far | F.col("to").isNotNull())
    got = got.select("id", "p", "b", "way", F.when(far, F.col("to")).otherwise(F.col("v")).alias("x"), F.when(far, F.col("v")).otherwise(F.col("to")).alias("z"), "q")
    return gathered(net, got, {"g": F.sum(F.when(F.col("z").isNull(), 0.0).otherwise(F.col("q")))}, dense)
