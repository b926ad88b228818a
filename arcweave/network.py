"""A network as DataFrames: vertices(v, attributes), arcs(i, j, attributes), missing(i, j)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.plans import tiles

#: For each kind of shared partner k of (a, b): which columns of a tie hold a and k, and which hold b and k.
SIDES = {"OTP": (("i", "j"), ("j", "i")), "ITP": (("j", "i"), ("i", "j")), "OSP": (("i", "j"), ("i", "j")), "ISP": (("j", "i"), ("j", "i")), "union": (("i", "j"), ("i", "j")), "und": (("i", "j"), ("i", "j"))}
#: Neighbours of a vertex that one cell of a join by common neighbours holds; a vertex with more gets a cell for each two blocks.
HUB = 2_000
#: Values that the key of a rule for unobserved dyads may have.
MAX_KEYS = 1_000


class Network:
    """A simple graph without loops. Undirected edges are stored once with i < j.

    `missing` lists dyads whose state was not observed; an arc stored there is its face value. `silent` (v) names
    respondents whose ties were not observed: all dyads that such a vertex sends, in an undirected network all it is in.
    They are kept as vertices and counted, never as a list of dyads. So is `rule` (key, hides), two SQL expressions: `hides`,
    over i and j, says which dyads were not observed, and depends on their ends by `key`, over v, alone, which has few values;
    in an undirected network it has no direction. The views
    below are lazy plans; each is built once for a handle, so terms that need one share it."""

    def __init__(self, vertices: DataFrame, arcs: DataFrame, directed: bool = True, missing: DataFrame | None = None, silent: DataFrame | None = None, rule: tuple[str, str] | None = None):
        if rule and silent is not None:
            raise ValueError("give either silent vertices or a rule")
        self.spark = vertices.sparkSession
        self.directed = directed
        self.kept = False
        self.rule = rule
        self.vertices = vertices.withColumn("v", F.col("v").cast("long"))
        self.arcs = self._canonical(arcs)
        self.silent = silent.select(F.col("v").cast("long").alias("v")).distinct().join(self.vertices.select("v"), "v", "left_semi") if silent is not None else None
        self.missing = self._answered(self._canonical(missing.select("i", "j"))) if missing is not None else None

    def _canonical(self, pairs: DataFrame) -> DataFrame:
        pairs = pairs.withColumns({"i": F.col("i").cast("long"), "j": F.col("j").cast("long")}).filter("i is not null and j is not null and i <> j")
        if not self.directed:
            pairs = pairs.withColumns({"i": F.least("i", "j"), "j": F.greatest("i", "j")})
        return pairs.dropDuplicates(["i", "j"])

    def _answered(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs that no silent vertex and no rule hides."""
        if self.rule:
            pairs = pairs.filter(~F.coalesce(F.expr(self.rule[1]), F.lit(False)))
        if self.silent is None:
            return pairs
        for e in ("i",) if self.directed else ("i", "j"):
            pairs = pairs.join(self.silent.toDF(e), e, "left_anti")
        return pairs

    def observed(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (i, j) that neither the list nor a silent vertex nor the rule hides."""
        pairs = self._answered(pairs)
        return pairs if self.missing is None else pairs.join(self.missing, ["i", "j"], "left_anti")

    def hidden(self) -> DataFrame | None:
        """(i, j) of all unobserved dyads, listed: for networks small enough for one task."""
        if self.rule:
            ids = self.vertices.select("v")
            every = self._canonical(ids.toDF("i").join(ids.toDF("j"), F.col("i") != F.col("j")))
            gone = every.filter(F.expr(self.rule[1]))
            return gone if self.missing is None else gone.union(self.missing.select("i", "j"))
        if self.silent is None:
            return self.missing
        rule = self.silent.toDF("i").join(self.vertices.select(F.col("v").alias("j")), F.col("i") != F.col("j"))
        rule = self._canonical(rule)
        return rule if self.missing is None else rule.union(self.missing.select("i", "j"))

    @classmethod
    def from_edges(cls, spark: SparkSession, n: int, edges: Iterable[tuple[int, int]], directed: bool = True, attributes: Mapping[str, list] | None = None, missing: Iterable[tuple[int, int]] = ()) -> "Network":
        """Vertices 1..n; attributes give a value for each vertex in order."""
        names = list(attributes or {})
        if names:
            rows = [(k + 1, *(attributes[a][k] for a in names)) for k in range(n)]
            vertices = spark.createDataFrame(rows, ["v", *names])
        else:
            vertices = spark.range(1, n + 1).toDF("v")
        pair = "i long, j long"
        missing = list(missing)
        return cls(vertices, spark.createDataFrame(list(edges), pair), directed, spark.createDataFrame(missing, pair) if missing else None)

    def with_vertex_attribute(self, table: DataFrame, name: str) -> "Network":
        """`table` has (v, name); vertices without a row have null."""
        return Network(self.vertices.drop(name).join(table.select(F.col("v").cast("long").alias("v"), name), "v", "left"), self.arcs, self.directed, self.missing, self.silent, self.rule)

    def with_edge_attribute(self, table: DataFrame, name: str) -> "Network":
        own = self._canonical(table.select("i", "j", name))
        return Network(self.vertices, self.arcs.drop(name).join(own, ["i", "j"], "left"), self.directed, self.missing, self.silent, self.rule)

    def cached(self) -> "Network":
        """Keeps the tables that every view reads, in memory or on executors' disks; lost parts are computed again."""
        self.vertices, self.arcs = self.vertices.cache(), self.arcs.cache()
        self.kept = True
        return self

    @cached_property
    def n(self) -> int:
        return self.vertices.count()

    @cached_property
    def n_edges(self) -> int:
        return self.arcs.count()

    @cached_property
    def n_missing(self) -> int:
        listed = self.missing.count() if self.missing is not None else 0
        if self.rule:
            ruled = self.ruled(self.vertices.select("v", F.lit(0).alias("cls"))).agg(F.sum("hidden")).first()[0]
            return listed + int(ruled or 0)
        if self.silent is None:
            return listed
        s = self.silent.count()
        return listed + (s * (self.n - 1) if self.directed else s * (self.n - s) + s * (s - 1) // 2)

    def ruled(self, classes: DataFrame) -> DataFrame:
        """(a, b, hidden): how many dyads from class a to class b, in an undirected network of both, the rule hides.
        `classes` has (v, cls). They are counted by pairs of keys."""
        key, hides = self.rule
        keyed = classes.withColumn("key", F.expr(key))
        keys = keyed.groupBy("key").agg(F.min("v").alias("v"))
        if keys.count() > MAX_KEYS:
            raise ValueError(f"the key of a rule has more than {MAX_KEYS} values")
        # of two ends with one key each vertex meets itself once
        met = keys.toDF("x", "i").join(F.broadcast(keys.toDF("z", "j")), F.expr(hides)).select("x", "z")
        sizes = keyed.groupBy("cls", "key").agg(F.count("*").alias("m"))
        one, two = sizes.toDF("a", "x", "ma"), sizes.toDF("b", "z", "mb")
        got = met.join(one, "x").join(two, "z")
        same = (F.col("a") == F.col("b")) & (F.col("x") == F.col("z"))
        got = got.withColumn("c", F.col("ma") * F.col("mb") - F.when(same, F.col("ma")).otherwise(0)).groupBy("a", "b").agg(F.sum("c").alias("hidden"))
        if self.directed:
            return got
        return got.filter("a <= b").withColumn("hidden", F.when(F.col("a") == F.col("b"), F.expr("hidden div 2")).otherwise(F.col("hidden")))

    @property
    def n_pairs(self) -> int:
        return self.n * (self.n - 1) // (1 if self.directed else 2)

    @property
    def n_dyads(self) -> int:
        """Observed dyads."""
        return self.n_pairs - self.n_missing

    @property
    def density(self) -> float:
        return self.n_edges / self.n_pairs if self.n_pairs else 0.0

    @cached_property
    def pairs(self) -> DataFrame:
        """(i, j) of every arc, both ways for an undirected network."""
        own = self.arcs.select("i", "j")
        return own if self.directed else own.union(own.select(F.col("j").alias("i"), F.col("i").alias("j")))

    @cached_property
    def either(self) -> DataFrame:
        """(i, j) if an arc runs either way."""
        own = self.arcs.select("i", "j")
        return own.union(own.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct()

    @cached_property
    def reciprocal(self) -> DataFrame:
        """(i, j) of arcs whose reverse exists too."""
        own = self.arcs.select("i", "j")
        return own.join(own.select(F.col("j").alias("i"), F.col("i").alias("j")), ["i", "j"], "left_semi")

    @cached_property
    def degrees(self) -> DataFrame:
        """(v, dout, din, d) of every vertex; in an undirected network all three are the degree."""
        ends = self.pairs.select(F.col("i").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("k")).union(self.pairs.select("j", F.lit(0), F.lit(1)))
        sums = ends.groupBy("v").agg(F.sum("o").alias("dout"), F.sum("k").alias("din"))
        got = self.vertices.select("v").join(sums, "v", "left").fillna(0, ["dout", "din"])
        return got.withColumn("d", F.col("dout") + F.col("din") if self.directed else F.col("dout"))

    def _lists(self, kind: str) -> tuple[DataFrame, DataFrame]:
        """(a, k) and (b, k): what may be a partner seen from either end."""
        base = self.either if kind == "union" else self.pairs
        (a, x), (b, z) = SIDES[kind]
        return base.select(F.col(a).alias("a"), F.col(x).alias("k")), base.select(F.col(b).alias("b"), F.col(z).alias("k"))

    @cached_property
    def most_neighbours(self) -> int:
        """Of any vertex, ties either way counted each."""
        return int(self.degrees.agg(F.max("d")).first()[0] or 0)

    def _paths(self, x: DataFrame, y: DataFrame) -> DataFrame:
        """x (a, k) joined with y (b, k) by k. The neighbours of a hub are cut into blocks by a hash on both sides, and each
        two blocks meet in a cell of their own, so no key has more than about HUB rows of a side and HUB squared results."""
        if self.most_neighbours <= HUB:
            return x.join(y, "k")
        for side, name in ((x, "p"), (y, "q")):
            blocks = side.groupBy("k").agg(F.ceil(F.count("*") / HUB).cast("int").alias(f"n{name}")).filter(F.col(f"n{name}") > 1)
            x, y = x.join(blocks, "k", "left"), y.join(blocks, "k", "left")
        one = lambda c: F.coalesce(c, F.lit(1))
        every = lambda c: F.explode(F.sequence(F.lit(0), one(F.col(c)) - 1))
        own = lambda end, c: F.pmod(F.xxhash64(end), one(F.col(c))).cast("int")
        x = x.select("a", "k", own("a", "np").alias("p"), every("nq").alias("q"))
        y = y.select("b", "k", every("np").alias("p"), own("b", "nq").alias("q"))
        return x.join(y, ["k", "p", "q"])

    def shared_partners(self, kind: str) -> DataFrame:
        """(a, b, s): ordered pairs with s > 0 shared partners. Kinds: OTP a>k>b, ITP b>k>a, OSP a>k<b, ISP a<k>b,
        union (either direction) and und (undirected)."""
        cache = self.__dict__.setdefault("_partners", {})
        if kind not in cache:
            if kind == "ITP":
                got = self.shared_partners("OTP").select(F.col("b").alias("a"), F.col("a").alias("b"), "s")
            else:
                got = self._paths(*self._lists(kind)).filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("s"))
            cache[kind] = got
        return cache[kind]

    def partners_of(self, asked: DataFrame, kind: str) -> DataFrame:
        """(a, b, s): those of the asked ordered pairs (a, b) that share s > 0 partners, as shared_partners has them.

        For each pair the shorter of the two ends' lists is gone through and looked up in the other one, so beyond one
        pass over the ties the rows made are the smaller degrees of the pairs asked for, whatever hubs they are joined to."""
        x, y = self._lists(kind)
        size = lambda rows, end: rows.groupBy(end).agg(F.count("*").alias(f"d{end}"))
        sized = asked.select("a", "b").filter("a <> b").distinct().join(size(x, "a"), "a").join(size(y, "b"), "b")
        # side 0 goes through the list of a, side 1 through that of b
        up = F.col("da") <= F.col("db")
        walked = sized.select("a", "b", F.when(up, 0).otherwise(1).alias("side"), F.when(up, F.col("a")).otherwise(F.col("b")).alias("near"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("far"))
        sides = lambda end, one, two: one.select(F.lit(0).alias("side"), F.col(one.columns[0]).alias(end), "k").union(two.select(F.lit(1), two.columns[0], "k"))
        return walked.join(sides("near", x, y), ["side", "near"]).join(sides("far", y, x), ["side", "far", "k"], "left_semi").groupBy("a", "b").agg(F.count("*").alias("s"))

    def lone_pairs(self, kind: str) -> tuple[DataFrame, DataFrame]:
        """The pairs of shared_partners in two parts: a row (c) with the number of ordered pairs (a, b) of which an end has
        one neighbour alone on its side, so that they share just that one; and (a, b, s) of the others. The former
        are counted neighbour by neighbour and never listed, so leaves of a star cost a row each."""
        x, y = self._lists(kind)
        lone = lambda rows, end: rows.join(rows.groupBy(end).agg((F.count("*") == 1).cast("long").alias("one")), end)
        x, y = lone(x, "a"), lone(y, "b")
        sums = lambda rows, n: rows.groupBy("k").agg(F.count("*").alias(f"all_{n}"), F.sum("one").alias(f"one_{n}"))
        c = F.col
        met = sums(x, "x").join(sums(y, "y"), "k").agg(F.coalesce(F.sum(c("one_x") * c("all_y") + (c("all_x") - c("one_x")) * c("one_y")), F.lit(0)).alias("c"))
        # a vertex met with itself
        own = x.withColumnRenamed("one", "ox").join(y.select(F.col("b").alias("a"), "k", F.col("one").alias("oy")), ["a", "k"]).agg(F.coalesce(F.sum(F.greatest("ox", "oy")), F.lit(0)).alias("own"))
        rest = self._paths(x.filter("one = 0").drop("one"), y.filter("one = 0").drop("one")).filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("s"))
        return met.crossJoin(own).select((c("c") - c("own")).alias("c")), rest  # two single rows

    @cached_property
    def closed(self) -> DataFrame:
        """(u, v, w, uv, vu, uw, wu, vw, wv): three vertices that are joined pairwise, once each, and which of the six ties exist.

        Each joined pair points from the end with fewer neighbours to the other, so a vertex points at no more than
        about the square root of twice the pairs, hubs included; paths that leave one vertex are then closed by a pair."""
        own = self.arcs.select("i", "j")
        if self.directed:
            sides = own.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), F.when(F.col("i") < F.col("j"), 1).otherwise(2).alias("way"))
            ties = sides.groupBy("a", "b").agg(F.sum("way").alias("way"))  # 1: up, 2: down, 3: both
        else:
            ties = own.select(F.col("i").alias("a"), F.col("j").alias("b"), F.lit(3).cast("long").alias("way"))
        ends = ties.select(F.col("a").alias("v")).union(ties.select("b")).groupBy("v").agg(F.count("*").alias("d"))
        ties = ties.join(ends.withColumnsRenamed({"v": "a", "d": "da"}), "a").join(ends.withColumnsRenamed({"v": "b", "d": "db"}), "b")
        rank = lambda d, v: F.struct(F.col(d).alias("d"), F.col(v).alias("v"))
        up = rank("da", "a") < rank("db", "b")
        pick = lambda x, z: F.when(up, x).otherwise(z)
        out = ties.select(pick(F.col("a"), F.col("b")).alias("x"), pick(F.col("b"), F.col("a")).alias("z"), pick(F.col("db"), F.col("da")).alias("dz"), pick(F.col("way").bitwiseAND(1), F.shiftright("way", 1)).alias("fore"), pick(F.shiftright("way", 1), F.col("way").bitwiseAND(1)).alias("back"))
        if self.kept:  # three joins read it
            out = out.cache()
        name = lambda z, f, b: out.select(F.col("x").alias("u"), F.col("z").alias(z), F.col("dz").alias(f"d{z}"), F.col("fore").alias(f), F.col("back").alias(b))
        paths = name("v", "uv", "vu").join(name("w", "uw", "wu"), "u").filter(rank("dv", "v") < rank("dw", "w")).drop("dv", "dw")
        return paths.join(out.select(F.col("x").alias("v"), F.col("z").alias("w"), F.col("fore").alias("vw"), F.col("back").alias("wv")), ["v", "w"])

    def tie_census(self, kinds: tuple[str, ...]) -> DataFrame:
        """(i, j, one column for each kind): ties and the partners their ends share, as shared_partners has them, where
        there are any. All kinds come from one pass over the closed triples and one aggregation."""
        each, c = [], lambda p, q: F.col(p + q)
        for x, y, z in (("u", "v", "w"), ("v", "u", "w"), ("u", "w", "v"), ("w", "u", "v"), ("v", "w", "u"), ("w", "v", "u")):
            if not self.directed and (x, y) not in (("u", "v"), ("u", "w"), ("v", "w")):
                continue
            ways = {"OTP": c(x, z) * c(z, y), "ITP": c(y, z) * c(z, x), "OSP": c(x, z) * c(y, z), "ISP": c(z, x) * c(z, y)} if self.directed else {}
            i, j = (F.col(x), F.col(y)) if self.directed else (F.least(x, y), F.greatest(x, y))
            each.append(F.struct(i.alias("i"), j.alias("j"), *[(c(x, y) * ways.get(k, F.lit(1))).cast("long").alias(k) for k in kinds]))
        some = lambda e: F.greatest(*[e[k] for k in kinds]) > 0 if len(kinds) > 1 else e[kinds[0]] > 0
        rows = self.closed.select(F.explode(F.filter(F.array(*each), some)).alias("e")).select("e.*")
        return rows.groupBy("i", "j").agg(*[F.sum(k).alias(k) for k in kinds])

    def tie_partners(self, kind: str) -> DataFrame:
        """(i, j, s): ties with s > 0 shared partners of one kind."""
        cache = self.__dict__.setdefault("_tie_partners", {})
        if kind not in cache:
            cache[kind] = self.tie_census((kind,)).withColumnRenamed(kind, "s")
        return cache[kind]

    @cached_property
    def joined(self) -> DataFrame:
        """(i, j, ties) of pairs joined either way, i < j, with 1 tie or 2."""
        return self.arcs.groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.count("*").alias("ties"))

    @cached_property
    def dyads(self) -> DataFrame:
        """(i, j, y, r) of every observed dyad: whether i>j and j>i exist, as a change-statistic query over all dyads must
        have them: in tiles, without a shuffle of dyads, or joined where the network is too large for these or has
        unobserved dyads; the vertex list is broadcast only while it is small."""
        if tiles.fits(self):
            return tiles.tied(self)
        ids = self.vertices.select("v")
        one, two = ids.withColumnRenamed("v", "i"), ids.withColumnRenamed("v", "j")
        if self.n <= 1_000_000:
            two = F.broadcast(two)
        every = one.join(two, F.col("i") != F.col("j") if self.directed else F.col("i") < F.col("j"))
        every = self.observed(every)
        own = self.arcs.select("i", "j", F.lit(1).alias("y"))
        got = every.join(own, ["i", "j"], "left").fillna(0, ["y"])
        if not self.directed:
            return got.withColumn("r", F.col("y"))
        back = self.arcs.select(F.col("j").alias("i"), F.col("i").alias("j"), F.lit(1).alias("r"))
        return got.join(back, ["i", "j"], "left").fillna(0, ["r"])

    def is_whole(self, pairs: DataFrame) -> bool:
        """Whether these are all dyads, or all that ties touch: then work may start from the ties."""
        return any(pairs is self.__dict__.get(k) for k in ("dyads", "listed"))

    def tiled(self, pairs: DataFrame) -> bool:
        """Whether these are all dyads and come in tiles: then no join may shuffle them."""
        return pairs is self.__dict__.get("dyads") and tiles.fits(self)

    def ends(self, pairs: DataFrame, columns: list[str], small: bool = False) -> DataFrame:
        """Adds each vertex column c as c_i and c_j; with `small`, the vertices are broadcast."""
        return self.joined_ends(pairs, self.vertices.select("v", *columns), small)

    def joined_ends(self, pairs: DataFrame, own: DataFrame, small: bool = False) -> DataFrame:
        """Adds the columns c of `own` (v, ...) as c_i and c_j."""
        for e in ("i", "j"):
            table = own.toDF(e, *[f"{c}_{e}" for c in own.columns[1:]])
            pairs = pairs.join(F.broadcast(table) if small else table, e, "left")
        return pairs

    def matrix(self):
        """The adjacency as a dense numpy array in vertex order, with the ids; for small networks only."""
        import numpy as np

        if self.n > 20_000:
            raise ValueError("matrix() is for networks of at most 20,000 vertices")
        ids = np.array(sorted(r[0] for r in self.vertices.select("v").collect()), np.int64)
        a = np.zeros((len(ids), len(ids)), bool)
        pairs = self.pairs.toPandas()
        a[np.searchsorted(ids, pairs["i"]), np.searchsorted(ids, pairs["j"])] = True
        return a, ids
