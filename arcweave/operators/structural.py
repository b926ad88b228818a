"""Terms of the ties alone.

Changes never enumerate more than they must: a count of partners or of a degree includes the dyad's own
tie y, so every formula subtracts y instead of looking at the network without the tie.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.functions.weights import choose, choose_np, power, ratio, weight, weight_np
from arcweave.network import Network
from arcweave.operators.base import PairTerm, Term
from arcweave.plans import tiles

KINDS = ("OTP", "ITP", "OSP", "ISP", "union")


class Edges(PairTerm):
    name = "edges"

    def change_column(self, net):
        return F.lit(1.0)

    def local(self, state, i, j, y):
        return 1.0


def _value(rows: DataFrame, x: Column) -> DataFrame:
    return rows.agg(F.coalesce(F.sum(x.cast("double")), F.lit(0.0)).alias("value"))


class Mutual(Term):
    """Pairs with ties both ways."""

    name = "mutual"
    requires_directed = True
    untouched = "vertices"
    reach = 1

    def stat(self, net):
        own = net.arcs.select("i", "j")
        back = own.select(F.col("j").alias("i"), F.col("i").alias("j"))
        return own.filter("i < j").join(back, ["i", "j"], "left_semi").agg(F.count("*").cast("double").alias("value"))

    def sums(self, net):
        return [("joined", F.count_if(F.col("ties") == 2))], lambda m: m

    def change(self, net, pairs):
        return pairs.select("i", "j", F.col("r").cast("double").alias("delta"))

    def idle_column(self, net):
        return F.lit(0.0)

    def dyad_column(self, net):
        return F.col("r")

    def local(self, state, i, j, y):
        return float(state.a[j, i])


def _partners(net: Network, pairs: DataFrame, kind: str, column: str, whole: bool) -> DataFrame:
    """Adds the partners that the ends of each dyad share; where not all dyads are asked for, of these alone."""
    got = net.shared_partners(kind) if whole else net.partners_of(pairs.select(F.col("i").alias("a"), F.col("j").alias("b")), kind)
    got = got.select(F.col("a").alias("i"), F.col("b").alias("j"), F.col("s").alias(column))
    return pairs.join(got, ["i", "j"], "left").fillna(0, [column])


class Triangle(Term):
    """Triangles; in a directed network transitive plus cyclic triples."""

    name = "triangle"
    untouched = "zero"

    def stat(self, net):
        if not net.directed:
            return net.closed.agg(F.count("*").cast("double").alias("value"))
        c = F.col
        # each order of the three is transitive if its first two ties and their shortcut exist
        orders = (("u", "v", "w"), ("u", "w", "v"), ("v", "u", "w"), ("v", "w", "u"), ("w", "u", "v"), ("w", "v", "u"))
        transitive = sum((c(x + y) * c(y + z) * c(x + z) for x, y, z in orders), F.lit(0))
        return _value(net.closed, transitive + c("uv") * c("vw") * c("wu") + c("vu") * c("wv") * c("uw"))

    def sums(self, net):
        if not net.directed:
            return [("partners", F.sum("und"))], lambda s: s / 3
        # a transitive triple is a tie whose ends point at a third; a cyclic one is seen from each of its ties
        return [("partners", F.sum("OSP")), ("partners", F.sum("ITP"))], lambda t, c: t + c / 3

    def partner_kinds(self, net):
        return ("OSP", "ITP") if net.directed else ("und",)

    def whole(self, net, dense=True):
        if not net.directed:
            return tiles.two_paths(net, {0: ("out", "out")}, [0], dense=dense).withColumn("delta", F.col("c").cast("double"))
        own = net.pairs.select(F.col("i").alias("at"), F.col("j").alias("to"))
        ties = own.union(own.select("to", "at")).groupBy("at", "to").agg(F.count("*").alias("w"))  # 1 or 2 each way
        return tiles.two_paths(net, {0: (ties, ties)}, [0], times=True, dense=dense).withColumn("delta", F.col("c").cast("double"))

    def change(self, net, pairs):
        if net.tiled(pairs):
            return self.whole(net).select("i", "j", "delta")
        rows = pairs.select("i", "j")
        kinds = ("OTP", "ITP", "OSP", "ISP") if net.directed else ("und",)
        for k in kinds:
            rows = _partners(net, rows, k, k, net.is_whole(pairs))
        return rows.select("i", "j", sum((F.col(k) for k in kinds), F.lit(0)).cast("double").alias("delta"))

    def local(self, state, i, j, y):
        a, t = state.a, state.t
        if not state.directed:
            return float(np.count_nonzero(a[i] & a[j]))
        return float(sum(np.count_nonzero(x & z) for x, z in ((a[i], t[j]), (t[i], a[j]), (a[i], a[j]), (t[i], t[j]))))


class _DegreeTerm(Term):
    """Shared by terms that add a function of each vertex's degree. `side`: dout, din or d."""

    side = "dout"
    untouched = "degrees"
    reach = 1

    @property
    def degree_sides(self):
        return (self.side,)

    def f(self, d: Column) -> Column:
        raise NotImplementedError

    def f_np(self, d):
        raise NotImplementedError

    def step(self, d: Column) -> Column:
        """f(d + 1) - f(d)."""
        return self.f(d + 1) - self.f(d)

    def step_np(self, d):
        return self.f_np(d + 1) - self.f_np(d)

    def stat(self, net):
        return _value(net.degrees, self.f(F.col(self.side)))

    def sums(self, net):
        return [("degrees", F.sum(self.f(F.col(self.side)).cast("double")))], lambda x: x

    def empty(self, n):
        return n * float(self.f_np(0))

    def _ends(self, net) -> tuple[str, ...]:
        return ("i", "j") if not net.directed else ("j",) if self.side == "din" else ("i",)

    def idle_column(self, net):
        return sum((self.step(F.col(f"{self.side}_{e}")) for e in self._ends(net)), F.lit(0.0))

    def dyad_column(self, net):
        return sum((self.step(F.col(f"{self.side}_{e}") - F.col("y")) for e in self._ends(net)), F.lit(0.0))

    def change(self, net, pairs):
        deg, tiled = F.col(self.side), net.tiled(pairs)
        # the step of an end with and without the dyad's tie is worked out once a vertex
        own = net.degrees.select("v", self.step(deg).cast("double").alias("free"), F.when(deg > 0, self.step(deg - 1)).cast("double").alias("held"))
        rows = pairs.select("i", "j", "y")
        ends = self._ends(net)
        for e in ends:
            table = own.withColumnsRenamed({"v": e, "free": f"free_{e}", "held": f"held_{e}"})
            rows = rows.join(F.broadcast(table) if tiled else table, e)
        return rows.select("i", "j", sum((F.when(F.col("y") == 0, F.col(f"free_{e}")).otherwise(F.col(f"held_{e}")) for e in ends), F.lit(0.0)).alias("delta"))

    def local(self, state, i, j, y):
        if not state.directed:
            return float(self.step_np(state.dout[i] - y) + self.step_np(state.dout[j] - y))
        return float(self.step_np(state.din[j] - y) if self.side == "din" else self.step_np(state.dout[i] - y))


class Kstar(_DegreeTerm):
    """Stars with k ends, out-stars in a directed network."""

    def __init__(self, k: int):
        if k < 2:
            raise ValueError("a star has at least 2 ends")
        self.k = k

    @property
    def name(self):
        return f"kstar{self.k}"

    def f(self, d):
        return choose(d, self.k)

    def step(self, d):
        return choose(d, self.k - 1)

    def f_np(self, d):
        return choose_np(d, self.k)

    def step_np(self, d):
        return choose_np(d, self.k - 1)


class TwoPath(Term):
    """Paths of two ties."""

    name = "twopath"
    untouched = "degrees"
    reach = 1

    def stat(self, net):
        if not net.directed:
            return _value(net.degrees, choose(F.col("d"), 2))
        back = net.arcs.select(F.col("j").alias("i"), F.col("i").alias("j"))
        both = net.arcs.select("i", "j").join(back, ["i", "j"], "left_semi").agg(F.count("*").alias("m"))
        return _value(net.degrees, F.col("din") * F.col("dout")).crossJoin(both).select((F.col("value") - F.col("m")).alias("value"))  # two single rows

    def sums(self, net):
        if not net.directed:
            return [("degrees", F.sum(choose(F.col("d"), 2)))], lambda x: x
        return [("degrees", F.sum(F.col("din") * F.col("dout"))), ("joined", F.count_if(F.col("ties") == 2))], lambda x, m: x - 2 * m

    def idle_column(self, net):
        return F.col("din_i") + F.col("dout_j") if net.directed else F.col("d_i") + F.col("d_j")

    def dyad_column(self, net):
        return self.idle_column(net) - 2 * F.col("r" if net.directed else "y")

    def change(self, net, pairs):
        own = net.degrees
        one, two = ("din", "dout") if net.directed else ("d", "d")
        small = F.broadcast if net.tiled(pairs) else lambda t: t
        rows = pairs.select("i", "j", "y", "r").join(small(own.select(F.col("v").alias("i"), F.col(one).alias("x"))), "i").join(small(own.select(F.col("v").alias("j"), F.col(two).alias("z"))), "j")
        return rows.select("i", "j", (F.col("x") + F.col("z") - 2 * F.col("r" if net.directed else "y")).cast("double").alias("delta"))

    def local(self, state, i, j, y):
        if state.directed:
            return float(state.din[i] + state.dout[j] - 2 * state.a[j, i])
        return float(state.dout[i] + state.dout[j] - 2 * y)


def _checked(decay: float) -> float:
    if not decay > 0:
        raise ValueError("decay must be positive")
    return float(decay)


class _Weighted(_DegreeTerm):
    def __init__(self, decay: float = 0.5):
        self.decay = _checked(decay)

    def f(self, d):
        return weight(d, self.decay)

    def step(self, d):
        return power(d, self.decay)

    def f_np(self, d):
        return weight_np(d, self.decay)

    def step_np(self, d):
        return ratio(self.decay) ** d


class GWDegree(_Weighted):
    """Geometrically weighted degrees (out-degrees in a directed network)."""

    @property
    def name(self):
        return f"gwdegree.fixed.{self.decay}"


class GWIDegree(_Weighted):
    side, requires_directed = "din", True

    @property
    def name(self):
        return f"gwideg.fixed.{self.decay}"


class GWODegree(_Weighted):
    requires_directed = True

    @property
    def name(self):
        return f"gwodeg.fixed.{self.decay}"


class Degree(_DegreeTerm):
    """Vertices of degree d; a range stands for one statistic each."""

    label, requires_undirected = "degree", True

    def __init__(self, d):
        self.range = [d] if isinstance(d, int) else list(d)
        if not self.range or min(self.range) < 0:
            raise ValueError("degrees must not be negative")
        self.d = self.range[0]

    @property
    def name(self):
        return f"{self.label}{self.d}"

    def expand(self, net):
        return [type(self)(d) for d in self.range]

    def f(self, d):
        return F.when(d == self.d, 1.0).otherwise(0.0)

    def f_np(self, d):
        return np.asarray(d == self.d, float)


class IDegree(Degree):
    label, side, requires_undirected, requires_directed = "idegree", "din", False, True


class ODegree(Degree):
    label, requires_undirected, requires_directed = "odegree", False, True


#: For each kind: the near and far end of the relation and which end of the dyad the near one is; and the pair.
PARTS = {
    "OTP": [("f", "t", "j", "i", "k"), ("t", "f", "i", "k", "j")],
    "ITP": [("f", "t", "j", "k", "i"), ("t", "f", "i", "j", "k")],
    "OSP": [("t", "f", "j", "i", "k")],
    "ISP": [("f", "t", "i", "j", "k")],
    "union": [("f", "t", "j", "i", "k"), ("f", "t", "i", "j", "k")],
    "und": [("f", "t", "j", "i", "k"), ("f", "t", "i", "j", "k")],
}


class _Partners(Term):
    """Shared by the weighted shared-partner terms. A new tie i>j lets pairs gain a partner:

    kind   pairs
    OTP    (i, b) for j>b, (a, j) for a>i
    ITP    (a, i) for j>a, (j, b) for b>i
    OSP    {i, u} for u>j
    ISP    {j, u} for i>u
    union  {i, k} for k~j, {j, k} for k~i; none if j>i is there
    und    {i, k} for k~j, {j, k} for k~i"""

    stem = ""

    def __init__(self, decay: float = 0.5, type: str = "OTP"):
        if type not in KINDS:
            raise ValueError(f"type must be one of {', '.join(KINDS)}")
        self.decay, self.type = _checked(decay), type

    @property
    def name(self):
        return f"{self.stem}{'' if self.type == 'OTP' else '.' + self.type}.fixed.{self.decay}"

    def kind(self, net) -> str:
        return self.type if net.directed else "und"

    def _gaining(self, net: Network, pairs: DataFrame) -> DataFrame:
        """(i, j, y, a, b): for each dyad the ordered or unordered pairs that gain a partner, in the orientation in
        which shared_partners has them. Only pairs that a path of two ties joins, through some partner or through
        the dyad itself, are listed by the callers."""
        kind = self.kind(net)
        out = self._near(net)
        own = pairs.select("i", "j", "y", "r")
        if kind == "union":
            own = own.filter("r = 0")
        rows = None
        for near, far, key, a, b in PARTS[kind]:
            part = own.join(out.withColumnsRenamed({near: key, far: "k"}), key).filter("k <> i and k <> j").select("i", "j", "y", F.col(a).alias("a"), F.col(b).alias("b"))
            rows = part if rows is None else rows.union(part)
        return rows

    def _near(self, net: Network) -> DataFrame:
        base = net.either if self.kind(net) == "union" else net.pairs
        return base.select(F.col("i").alias("f"), F.col("j").alias("t"))

    def _gain(self, rows: DataFrame, net: Network, times: str, whole: bool = False) -> DataFrame:
        sp = net.shared_partners(self.kind(net)) if whole else net.partners_of(rows, self.kind(net))
        rows = rows.join(sp, ["a", "b"], "left")
        each = F.col(times) * power(F.coalesce("s", F.lit(0)) - F.col("y"), self.decay) if times else power(F.coalesce("s", F.lit(0)) - F.col("y"), self.decay)
        return rows.groupBy("i", "j").agg(F.sum(each).alias("gain"))

    def _affected(self, state, i, j) -> list[tuple[np.ndarray, bool]]:
        """(others, whether they pair with i), orientation left to the caller."""
        a, t = state.a, state.t
        kind = self.type if state.directed else "und"
        if kind == "und":
            return [(a[j], "i"), (a[i], "j")]
        u = a | t if kind == "union" else None
        if kind == "union":
            return [] if a[j, i] else [(u[j], "i"), (u[i], "j")]
        return {"OTP": [(a[j], "i>"), (t[i], ">j")], "ITP": [(a[j], ">i"), (t[i], "j>")], "OSP": [(t[j], "i")], "ISP": [(a[i], "j")]}[kind]

    def _counts(self, state, x: int, others: np.ndarray, way: str) -> np.ndarray:
        """Partners of the pairs of x with each of the others."""
        a, t = state.a, state.t
        kind = self.type if state.directed else "und"
        if kind in ("und", "union"):
            m = a if kind == "und" else a | t
            return (m[others] & m[x]).sum(1)
        if kind == "OSP":
            return (a[others] & a[x]).sum(1)
        if kind == "ISP":
            return (t[others] & t[x]).sum(1)
        first = way.endswith(">")  # x comes first in the pair
        if kind == "OTP":
            return (t[others] & a[x]).sum(1) if first else (a[others] & t[x]).sum(1)
        return (a[others] & t[x]).sum(1) if first else (t[others] & a[x]).sum(1)

    def _local_gain(self, state, i, j, y, tied: bool) -> float:
        w, total = ratio(self.decay), 0.0
        kind = self.type if state.directed else "und"
        for near, way in self._affected(state, i, j):
            others = np.flatnonzero(near)
            others = others[(others != i) & (others != j)]
            x = i if "i" in way else j
            if tied and len(others):
                if kind in ("OTP", "ITP"):
                    m = (state.a[x, others] if way.endswith(">") else state.a[others, x]).astype(float)
                elif kind == "und":
                    m = state.a[x, others].astype(float)
                else:
                    m = state.a[x, others].astype(float) + state.a[others, x]
                others, m = others[m > 0], m[m > 0]
            else:
                m = np.ones(len(others))
            if len(others):
                total += float((m * w ** (self._counts(state, x, others, way) - y)).sum())
        return total

    def _own_count(self, state, i, j) -> int:
        return int(self._counts(state, i, np.array([j]), "i>")[0])


class GWESP(_Partners):
    """Geometrically weighted partners that tied vertices share."""

    stem = "gwesp"
    untouched = "zero"

    def stat(self, net):
        return _value(net.tie_partners(self.kind(net)), weight(F.col("s"), self.decay))  # no partner, no weight

    def sums(self, net):
        return [("partners", F.sum(weight(F.col(self.kind(net)), self.decay)))], lambda x: x

    def partner_kinds(self, net):
        return (self.kind(net),)

    def _ties(self, net: Network) -> DataFrame:
        """(a, b, m): tied pairs, both ways with the number of ties where the kind has no direction."""
        ties = net.pairs.select(F.col("i").alias("a"), F.col("j").alias("b"), F.lit(1).alias("m"))
        if self.kind(net) in ("OSP", "ISP", "union"):
            ties = ties.union(ties.select(F.col("b").alias("a"), F.col("a").alias("b"), "m")).groupBy("a", "b").agg(F.sum("m").alias("m"))
        return ties

    def _gain_from_ties(self, net: Network) -> DataFrame:
        """(i, j, gain) of all dyads with a gain: from each tied pair by the third vertex to the dyads that it is for, so
        that work follows the ties and their neighbours and no list of dyads."""
        kind = self.kind(net)
        s = net.tie_partners(kind).select(F.col("i").alias("a"), F.col("j").alias("b"), "s")
        if kind not in ("OTP", "ITP"):
            s = s.union(s.select(F.col("b").alias("a"), F.col("a").alias("b"), "s")).distinct()
        ties = self._ties(net).join(s, ["a", "b"], "left").fillna(0, ["s"])
        out, rows = self._near(net), None
        for near, far, key, a, b in PARTS[kind]:
            other = "i" if key == "j" else "j"
            own = ties.withColumnsRenamed({"a": a, "b": b})  # one of them is the other end, one is k
            part = own.join(out.withColumnsRenamed({near: key, far: "k"}), "k").filter(f"{key} <> {other}").select("i", "j", "m", "s")
            rows = part if rows is None else rows.union(part)
        if not net.directed:
            rows = rows.filter("i < j")
        own = net.arcs.select("i", "j", F.lit(1).alias("y"))
        rows = rows.groupBy("i", "j", "s").agg(F.sum("m").alias("m"))
        if kind == "union":
            rows = rows.join(own.select(F.col("j").alias("i"), F.col("i").alias("j")), ["i", "j"], "left_anti")
        rows = rows.join(own, ["i", "j"], "left").fillna(0, ["y"])
        return rows.groupBy("i", "j").agg(F.sum(F.col("m") * power(F.col("s") - F.col("y"), self.decay)).alias("gain"))

    def whole(self, net, dense=True):
        """(i, j, delta, y, r) of all dyads, in tiles: each third vertex brings the dyad's own partners and, from the ties that
        gain one, w to the power of what they share; a dyad's own tie is taken out of these by one power less."""
        kind = self.kind(net)
        s = net.tie_partners(kind).select(F.col("i").alias("a"), F.col("j").alias("b"), "s")
        if kind not in ("OTP", "ITP"):
            s = s.union(s.select(F.col("b").alias("a"), F.col("a").alias("b"), "s")).distinct()
        ties = self._ties(net).join(s, ["a", "b"], "left").fillna(0, ["s"])
        ties = ties.select(F.col("a").alias("at"), F.col("b").alias("to"), (F.col("m") * power(F.col("s"), self.decay)).alias("w"))
        back = ties.select(F.col("to").alias("at"), F.col("at").alias("to"), "w")
        ways = {
            "OTP": {0: ("out", "out"), 1: (ties, "in"), 2: ("in", ties)},
            "ITP": {0: (back, back)},
            "OSP": {0: ("out", "in"), 1: (ties, "out")},
            "ISP": {0: ("in", "out"), 1: ("out", ties)},
        }.get(kind, {0: (ties, ties)})
        got = tiles.two_paths(net, ways, [0], dense=dense)
        gain = F.when(F.col("y") == 1, F.col("g") / ratio(self.decay)).otherwise(F.col("g"))
        if kind == "union":
            gain = F.when(F.col("r") == 0, gain).otherwise(0.0)
        return got.select("i", "j", F.when(F.col("c") == 0, 0.0).otherwise(weight(F.col("c"), self.decay) + gain).alias("delta") if kind in ("ITP", "union", "und") else (F.when(F.col("c") == 0, 0.0).otherwise(weight(F.col("c"), self.decay)) + gain).alias("delta"), "y", "r")

    def change(self, net, pairs):
        kind = self.kind(net)
        if net.tiled(pairs):
            return self.whole(net).select("i", "j", "delta")
        if net.is_whole(pairs):
            gain = self._gain_from_ties(net)
        else:  # pairs that count are tied, so the tie is joined first and keeps the rest small
            gain = self._gain(self._gaining(net, pairs).join(self._ties(net), ["a", "b"]), net, "m")
        own = _partners(net, pairs.select("i", "j"), kind, "s", net.is_whole(pairs)).join(gain, ["i", "j"], "left")
        return own.select("i", "j", (weight(F.col("s"), self.decay) + F.coalesce("gain", F.lit(0.0))).alias("delta"))

    def local(self, state, i, j, y):
        return float(weight_np(self._own_count(state, i, j), self.decay)) + self._local_gain(state, i, j, y, True)


class GWDSP(_Partners):
    """Geometrically weighted partners that any two vertices share: ordered pairs for OTP and ITP, else unordered."""

    stem = "gwdsp"
    reach = 3

    def __init__(self, decay: float = 0.5, type: str = "OTP"):
        super().__init__(decay, type)
        # of dyads farther apart than three ties no gaining pair has a partner yet; the ties either way, which the kind
        # union follows, are not among a vertex's degrees
        self.untouched = None if type == "union" else "degrees"

    def touches(self, net):
        two = net.shared_partners("union" if net.directed else "und").select("a", F.col("b").alias("k"))
        three = two.join(net.either.select(F.col("i").alias("k"), F.col("j").alias("b")), "k").filter("a <> b").select("a", "b")
        return two.toDF("a", "b").union(three).distinct().toDF("i", "j")

    def idle_column(self, net):
        if self.untouched is None:
            return None
        return {"und": F.col("d_i") + F.col("d_j"), "OSP": F.col("din_j"), "ISP": F.col("dout_i")}.get(self.kind(net), F.col("din_i") + F.col("dout_j"))

    def stat(self, net):
        one, rows = net.lone_pairs(self.kind(net))
        half = 1 if self.kind(net) in ("OTP", "ITP") else 2  # unordered pairs stand there both ways
        rows = rows.agg(F.coalesce(F.sum(weight(F.col("s"), self.decay)), F.lit(0.0)).alias("rest"))
        return rows.crossJoin(one).select(((F.col("rest") + F.col("c") * weight(F.lit(1), self.decay)) / half).alias("value"))  # two single rows

    def whole(self, net, dense=True):
        """(i, j, delta, y, r) of all dyads, or of those that paths or ties join, in tiles. A pair that gains a partner counts w to the power of those it has: 1 with
        none, which the ends' degrees have, less 1 - w**s for each pair with s, which paths of three ties lead to."""
        kind = self.kind(net)
        base = net.either if kind == "union" else net.pairs
        both = {k: net.vertices.select("v").join(base.groupBy(F.col(e).alias("v")).agg(F.count("*").alias("d")), "v", "left").fillna(0, ["d"]) for k, e in (("out", "i"), ("in", "j"))}
        ways = {
            "OSP": {0: (0, ("out", "in", "out"))},
            "ISP": {0: (1, ("in", "out", "in"))},
            "und": {0: (0, ("out", "out", "out")), 1: (1, ("out", "out", "out"))},
            "union": {0: (0, ("either", "either", "either")), 1: (1, ("either", "either", "either"))},
        }.get(kind, {0: (0, ("out", "out", "in")), 1: (1, ("in", "in", "out"))})
        got = tiles.three_paths(net, ways, lambda s: 1 - power(s, self.decay), dense)
        # (end, its neighbours, the dyad's tie that is none of them)
        sides = {"OSP": [("j", "in", "y")], "ISP": [("i", "out", "y")], "und": [("i", "out", "y"), ("j", "out", "y")], "union": [("i", "out", "y"), ("j", "out", "y")]}.get(kind, [("j", "out", "r"), ("i", "in", "r")])
        pairs = F.lit(0)
        for e, k, tie in sides:
            got = got.join(F.broadcast(both[k].toDF(e, f"d_{e}")), e)
            pairs = pairs + F.col(f"d_{e}") - F.col(tie)
        gain = pairs.cast("double") - F.col("g")
        gain = F.when(F.col("y") == 1, gain / ratio(self.decay)).otherwise(gain)
        if kind == "union":
            gain = F.when(F.col("r") == 0, gain).otherwise(0.0)
        return got.select("i", "j", gain.alias("delta"), "y", "r")

    def change(self, net, pairs):
        if net.tiled(pairs):
            return self.whole(net).select("i", "j", "delta")
        gain = self._gain(self._gaining(net, pairs), net, "", net.is_whole(pairs))
        return pairs.select("i", "j").join(gain, ["i", "j"], "left").select("i", "j", F.coalesce("gain", F.lit(0.0)).alias("delta"))

    def local(self, state, i, j, y):
        return self._local_gain(state, i, j, y, False)
