"""The interface of model terms, and sets of them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.network import Network
from arcweave.plans import tiles


class Term:
    """One statistic of a network.

    Subclasses give `stat(net)`, a one-row table with a double column `value`, and one of
    `change(net, pairs)`, a table (i, j, delta) for the given dyads (i, j, y, r), or `change_column()` for
    terms that depend on the dyad and its ends alone. delta is the statistic with the tie minus without it,
    whatever the tie's present state. `local(state, i, j, y)` is the same number inside a sampling chain."""

    required_vertex_attributes: tuple[str, ...] = ()
    required_edge_attributes: tuple[str, ...] = ()
    requires_directed = False
    requires_undirected = False
    dyad_dependent = True
    supports_missing = False
    #: What the change of a dyad without ties and shared partners follows: "vertices" (their attributes), "degrees" (also
    #: their degrees), "zero" (it is 0), or None (anything).
    untouched: str | None = None
    #: The degrees that an untouched dyad's change follows, if any.
    degree_sides: tuple[str, ...] = ("din", "dout")
    #: Ties in a row that the touched dyads are apart at most.
    reach = 2

    def touches(self, net: Network) -> DataFrame | None:
        """(i, j) of further dyads whose change doesn't follow `untouched`."""
        return None

    @property
    def name(self) -> str:
        return type(self).__name__

    def dyad_column(self, net: Network) -> Column | None:
        """The change of any dyad over its y and r and its ends' attributes and degrees, named as in idle_column; None if
        it takes more than that. Such terms share one pass over the dyads."""
        return None

    def idle_column(self, net: Network) -> Column | None:
        """The change of a dyad without ties and shared partners, over its ends' attributes (a_i, a_j) and degrees (dout_i,
        din_i, d_i, ...); None if that is not all it follows."""
        return F.lit(0.0) if self.untouched == "zero" else None

    def sums(self, net: Network) -> tuple[list[tuple[str, Column]], Callable] | None:
        """The statistic from sums over tables that several terms share: (table, aggregate) each, and how their values make
        it. Tables are `degrees`, `joined` and, for the partners of ties by kind, `partners`. None: `stat` alone has it."""
        return None

    def expand(self, net: Network) -> list["Term"]:
        """The terms this one stands for, one for each statistic."""
        return [self]

    def stat(self, net: Network) -> DataFrame:
        raise NotImplementedError(f"{type(self).__name__} has no stat")

    def change(self, net: Network, pairs: DataFrame) -> DataFrame:
        raise NotImplementedError(f"{type(self).__name__} has no change")

    def bind(self, net: Network, ids: np.ndarray) -> None:
        """Fetches what `local` needs of a network's attributes; called once on the driver."""

    def release(self) -> None:
        """Drops what can't be sent to tasks, after `bind`."""

    def empty(self, n: int) -> float:
        """The statistic of n vertices without ties."""
        return 0.0

    def local(self, state, i: int, j: int, y: int) -> float:
        raise NotImplementedError(f"{type(self).__name__} has no local change")


class PairTerm(Term):
    """A term whose change is an expression over a dyad and its ends' attributes (columns <attribute>_i, _j)."""

    dyad_dependent = False
    supports_missing = True
    untouched = "vertices"
    reach = 1

    def change_column(self, net: Network) -> Column:
        raise NotImplementedError

    def idle_column(self, net):
        return self.change_column(net)

    def dyad_column(self, net):
        return self.change_column(net)

    def stat(self, net: Network) -> DataFrame:
        rows = net.ends(net.arcs.select("i", "j"), list(self.required_vertex_attributes))
        return rows.agg(F.coalesce(F.sum(self.change_column(net).cast("double")), F.lit(0.0)).alias("value"))

    def change(self, net: Network, pairs: DataFrame) -> DataFrame:
        tiled, need = net.tiled(pairs), list(self.required_vertex_attributes)
        rows = tiles.couples(net) if tiled else pairs.select("i", "j")
        rows = net.ends(rows, need, tiled) if need else rows
        return rows.select("i", "j", self.change_column(net).cast("double").alias("delta"))


class TermSet:
    """An ordered tuple of terms with distinct roles, kept under their coefficient names."""

    def __init__(self, terms: Iterable[Term]):
        self.terms = tuple(terms)

    @property
    def names(self) -> list[str]:
        return [t.name for t in self.terms]

    def __iter__(self) -> Iterator[Term]:
        return iter(self.terms)

    def __len__(self) -> int:
        return len(self.terms)

    def __getitem__(self, k):
        return self.terms[k]


def is_dyad_dependent(terms: Term | Iterable[Term]) -> bool:
    return terms.dyad_dependent if isinstance(terms, Term) else any(t.dyad_dependent for t in terms)


def required_vertex_attributes(term: Term) -> tuple[str, ...]:
    return tuple(term.required_vertex_attributes)


def required_edge_attributes(term: Term) -> tuple[str, ...]:
    return tuple(term.required_edge_attributes)


def requires_directed(term: Term) -> bool:
    return term.requires_directed


def requires_undirected(term: Term) -> bool:
    return term.requires_undirected


def _listed(names: Iterable[str]) -> str:
    return ", ".join(f":{n}" for n in sorted(names)) or "none"


def validate(net: Network, terms: Iterable[Term]) -> None:
    """Raises ValueError for a term that the network can't serve."""
    have = [c for c in net.vertices.columns if c != "v"]
    edge = [c for c in net.arcs.columns if c not in ("i", "j")]
    for t in terms:
        for kind, own, need in (("vertex", have, t.required_vertex_attributes), ("edge", edge, t.required_edge_attributes)):
            for a in need:
                if a not in own:
                    raise ValueError(f"{t.name} needs the {kind} attribute :{a}; the network has {_listed(own)}")
        if t.requires_directed and not net.directed:
            raise ValueError(f"{t.name} needs a directed network")
        if t.requires_undirected and net.directed:
            raise ValueError(f"{t.name} needs an undirected network")


def expanded(net: Network, terms: Iterable[Term]) -> TermSet:
    """Validated terms, those with several statistics replaced by one for each."""
    terms = list(terms)
    if not terms:
        raise ValueError("a model needs at least one term")
    validate(net, terms)
    return TermSet(x for t in terms for x in t.expand(net))
