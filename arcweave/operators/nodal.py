"""Terms of vertex attributes. A null level matches nothing; a null number counts as 0."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.network import Network
from arcweave.operators.base import PairTerm, Term
from arcweave.plans import tiles

TRANSFORMS = {"none": lambda x: x, "log": F.log1p, "sqrt": F.sqrt}
TRANSFORMS_NP = {"none": lambda x: x, "log": np.log1p, "sqrt": np.sqrt}


#: Levels of an attribute, and entries of a covariate that a chain holds, at most: they go through the driver.
MAX_LEVELS, MAX_ENTRIES = 10_000, 5_000_000


def levels_of(net: Network, attribute: str) -> list:
    """Distinct values that occur, sorted; more than MAX_LEVELS raise an error."""
    got = [r[0] for r in net.vertices.select(attribute).filter(F.col(attribute).isNotNull()).distinct().orderBy(attribute).limit(MAX_LEVELS + 1).collect()]
    if len(got) > MAX_LEVELS:
        raise ValueError(f"{attribute} has more than {MAX_LEVELS} levels")
    return got


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def _values(net: Network, attribute: str, ids: np.ndarray) -> list:
    got = dict(net.vertices.select("v", attribute).collect())
    return [got.get(int(v)) for v in ids]


class _Level(PairTerm):
    """Shared by terms of one categorical attribute."""

    attribute: str

    @property
    def required_vertex_attributes(self):
        return (self.attribute,)

    def bind(self, net, ids):
        self._x = _values(net, self.attribute, ids)

    def _columns(self) -> tuple[Column, Column]:
        return F.col(f"{self.attribute}_i"), F.col(f"{self.attribute}_j")


class NodeFactor(_Level):
    """Ends of ties at vertices of a level. Without `level`, one statistic for each level but those at the
    positions `base` (from 1, in sorted order; 0 keeps all), or for each of `levels` in their order."""

    def __init__(self, attribute: str, level=None, levels=None, base=1):
        if level is not None and levels is not None:
            raise ValueError("give either level or levels")
        self.base = [base] if isinstance(base, int) else list(base)
        if any(b < 0 for b in self.base):
            raise ValueError("base must not be negative")
        self.attribute, self.level, self.levels = attribute, level, levels

    @property
    def name(self):
        return f"nodefactor.{self.attribute}" + (f".{self.level}" if self.level is not None else "")

    def expand(self, net):
        if self.level is not None:
            return [self]
        have = levels_of(net, self.attribute)
        if self.levels is not None:
            if unknown := [x for x in self.levels if x not in have]:
                raise ValueError(f"{self.name} has no level {unknown}")
            own = list(self.levels)
        else:
            own = [x for k, x in enumerate(have, 1) if k not in self.base]
        if not own:
            raise ValueError(f"{self.name} is left without levels")
        return [NodeFactor(self.attribute, level=x) for x in own]

    def _own(self, x: Column) -> Column:
        if self.level is not None:
            return _flag(x == F.lit(self.level))
        return _flag(x.isin(self.levels)) if self.levels is not None else _flag(x.isNotNull())

    def change_column(self, net):
        a, b = self._columns()
        return self._own(a) + self._own(b)

    def local(self, state, i, j, y):
        return (self._x[i] == self.level) + (self._x[j] == self.level)


class NodeCov(PairTerm):
    """Sum over ties of both ends' values, after an optional transform (log is log(x + 1))."""

    def __init__(self, attribute: str, transform: str = "none"):
        if transform not in TRANSFORMS:
            raise ValueError(f"unknown transform {transform!r}; there are {', '.join(TRANSFORMS)}")
        self.attribute, self.transform = attribute, transform
        self.required_vertex_attributes = (attribute,)

    @property
    def name(self):
        return f"nodecov.{self.attribute}"

    def _value(self, end: str) -> Column:
        return TRANSFORMS[self.transform](F.coalesce(F.col(f"{self.attribute}_{end}").cast("double"), F.lit(0.0)))

    def change_column(self, net):
        return self._value("i") + self._value("j")

    def bind(self, net, ids):
        self._x = TRANSFORMS_NP[self.transform](np.array([float(x or 0) for x in _values(net, self.attribute, ids)]))

    def local(self, state, i, j, y):
        return self._x[i] + self._x[j]


class NodeMatch(_Level):
    """Ties between equal values; with diff, one statistic for each level (or the one named)."""

    def __init__(self, attribute: str, diff: bool = False, level=None):
        if level is not None and not diff:
            raise ValueError("level needs diff=True")
        self.attribute, self.diff, self.level = attribute, diff, level

    @property
    def name(self):
        return f"nodematch.{self.attribute}" + (f".{self.level}" if self.level is not None else "")

    def expand(self, net):
        if self.diff and self.level is None:
            raise ValueError("diff=True needs a level")
        return [self]

    def change_column(self, net):
        a, b = self._columns()
        return _flag((a == b) & (a == F.lit(self.level))) if self.level is not None else _flag(a == b)

    def local(self, state, i, j, y):
        a, b = self._x[i], self._x[j]
        return float(a is not None and a == b and (self.level is None or a == self.level))


class NodeMismatch(_Level):
    """Ties between different values."""

    def __init__(self, attribute: str):
        self.attribute = attribute

    @property
    def name(self):
        return f"nodemismatch.{self.attribute}"

    def change_column(self, net):
        a, b = self._columns()
        return _flag(a != b)

    def local(self, state, i, j, y):
        a, b = self._x[i], self._x[j]
        return float(a is not None and b is not None and a != b)


class AbsDiff(PairTerm):
    """Sum over ties of |x_i - x_j| ** pow."""

    def __init__(self, attribute: str, pow: float = 1.0):
        self.attribute, self.pow = attribute, float(pow)
        self.required_vertex_attributes = (attribute,)

    @property
    def name(self):
        return f"absdiff.{self.attribute}"

    def change_column(self, net):
        a, b = (F.coalesce(F.col(f"{self.attribute}_{e}").cast("double"), F.lit(0.0)) for e in "ij")
        return F.pow(F.abs(a - b), F.lit(self.pow))

    def bind(self, net, ids):
        self._x = np.array([float(x or 0) for x in _values(net, self.attribute, ids)])

    def local(self, state, i, j, y):
        return abs(self._x[i] - self._x[j]) ** self.pow


class NodeMix(_Level):
    """Ties of one mixing cell (l1 to l2; in either order when undirected), or of each cell of the levels.

    Cells count with the tail fastest; levels2 drops (negative) or keeps (positive) them by position, 0 keeps all."""

    def __init__(self, attribute: str, l1=None, l2=None, levels=None, levels2=-1):
        if (l1 is None) != (l2 is None):
            raise ValueError("give both levels of a cell or neither")
        self.attribute, self.l1, self.l2, self.levels = attribute, l1, l2, levels
        self.levels2 = [levels2] if isinstance(levels2, int) else list(levels2)

    @property
    def name(self):
        return f"mix.{self.attribute}" + (f".{self.l1}.{self.l2}" if self.l1 is not None else "")

    def cells(self, net: Network) -> list[tuple]:
        own = list(self.levels) if self.levels is not None else levels_of(net, self.attribute)
        every = [(a, b) for y, b in enumerate(own) for x, a in enumerate(own) if net.directed or x <= y]
        pick = self.levels2
        if pick == [0]:
            return every
        if not pick or 0 in pick or (min(pick) < 0) == (max(pick) > 0) or any(abs(k) > len(every) for k in pick):
            raise ValueError(f"{self.name}: levels2 must be all negative or all positive, and name cells from 1 to {len(every)}")
        kept = [every[k - 1] for k in pick] if pick[0] > 0 else [c for k, c in enumerate(every, 1) if -k not in pick]
        if not kept:
            raise ValueError(f"{self.name} is left without cells")
        return kept

    def expand(self, net):
        return [self] if self.l1 is not None else [NodeMix(self.attribute, a, b) for a, b in self.cells(net)]

    def change_column(self, net):
        a, b = self._columns()
        held = (a == F.lit(self.l1)) & (b == F.lit(self.l2))
        if not net.directed:
            held = held | ((a == F.lit(self.l2)) & (b == F.lit(self.l1)))
        return _flag(held)

    def bind(self, net, ids):
        super().bind(net, ids)
        self._both = not net.directed

    def local(self, state, i, j, y):
        a, b = self._x[i], self._x[j]
        return float((a == self.l1 and b == self.l2) or (self._both and a == self.l2 and b == self.l1))


class OfEnds:
    """A covariate that follows a dyad's ends: `own` is a table (v, ...), `value` a column over its columns c as c_i and c_j,
    null where a vertex has no row. As a function it gives (i, j, x) for the pairs asked for."""

    def __init__(self, own: DataFrame, value: Column):
        self.own, self.value = own, value

    def __call__(self, net: Network, pairs: DataFrame) -> DataFrame:
        tiled = net.tiled(pairs)
        own = net.vertices.select("v").join(self.own, "v", "left") if tiled else self.own
        rows = net.joined_ends(tiles.couples(net) if tiled else pairs.select("i", "j"), own, tiled)
        return rows.select("i", "j", self.value.cast("double").alias("x"))


class EdgeCov(Term):
    """Sum over ties of a dyadic covariate: a table (i, j, x), a square matrix, an edge attribute, or a function that
    gives (i, j, x) for a network and the pairs (i, j) asked for, such as OfEnds; 0 elsewhere.

    An undirected network reads the entry with i < j."""

    dyad_dependent = False
    supports_missing = True
    untouched = "zero"
    reach = 1

    def __init__(self, source, name: str = "edgecov"):
        if isinstance(source, str):
            self._name, self.attribute, self.source = f"edgecov.{source}", source, None
            self.required_edge_attributes = (source,)
        else:
            self._name, self.attribute, self.source = name, None, source
            if callable(source):
                self.untouched = None
            elif not hasattr(source, "columns"):
                self.source = np.asarray(source, float)
                if self.source.ndim != 2 or self.source.shape[0] != self.source.shape[1]:
                    raise ValueError("a covariate matrix must be square")

    @property
    def name(self):
        return self._name

    def table(self, net: Network, pairs=None):
        if callable(self.source):
            return self.source(net, net.dyads if pairs is None else pairs)
        if self.attribute:
            return net.arcs.select("i", "j", F.coalesce(F.col(self.attribute).cast("double"), F.lit(0.0)).alias("x"))
        if isinstance(self.source, np.ndarray):
            i, j = np.nonzero(self.source)
            rows = [(int(a) + 1, int(b) + 1, float(self.source[a, b])) for a, b in zip(i, j) if net.directed or a < b]
            return net.spark.createDataFrame(rows, "i long, j long, x double")
        return self.source.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("x").cast("double").alias("x"))

    def touches(self, net):
        if callable(self.source):
            return None
        return self.table(net).filter("x <> 0").select("i", "j")

    def change(self, net, pairs):
        if isinstance(self.source, OfEnds):  # it has a row for each pair
            return self.source(net, pairs).select("i", "j", F.coalesce("x", F.lit(0.0)).alias("delta"))
        return pairs.select("i", "j").join(self.table(net, pairs), ["i", "j"], "left").select("i", "j", F.coalesce("x", F.lit(0.0)).alias("delta"))

    def stat(self, net):
        return net.arcs.select("i", "j").join(self.table(net, net.arcs), ["i", "j"]).agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("value"))

    def bind(self, net, ids):
        rows = self.table(net).filter("x <> 0")
        got = rows.limit(MAX_ENTRIES + 1).toPandas()
        if len(got) > MAX_ENTRIES:
            raise ValueError(f"a chain holds its covariate in one task; it may have {MAX_ENTRIES} entries")
        at = {int(v): k for k, v in enumerate(ids)}
        self._x = {(at[int(a)], at[int(b)]): x for a, b, x in zip(got.i, got.j, got.x) if int(a) in at and int(b) in at}

    def release(self):
        self.source = None

    def local(self, state, i, j, y):
        return self._x.get((i, j), 0.0)
