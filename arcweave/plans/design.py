"""Statistics of a whole network, change statistics of dyads, and the compressed design of the pseudo-likelihood."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.network import Network
from arcweave.operators.base import PairTerm, Term, TermSet, expanded
from arcweave.plans import tiles
from arcweave.operators.structural import Triangle
from arcweave.plans.scratch import stored
from arcweave.plans.sparse import classes, complement, few_classes, idle, known, paired, supported, touched, touched_rows

#: Group keys keep this many decimals, so that sums built in another order stay one row.
DIGITS = 10
#: Dyads up to this number are listed: counting the untouched ones takes about as long as listing so many. A touched
#: dyad costs about as much as LISTED_EACH listed ones, as it is found by joins.
LISTED, LISTED_EACH = 8_000_000, 4


def compute(term: Term, net: Network) -> float:
    return float(term.stat(net).first()[0])


def _pair_row(net: Network, terms: dict[str, PairTerm]) -> DataFrame:
    """All terms that are expressions over a tie in one pass over the arcs."""
    need = sorted({a for t in terms.values() for a in t.required_vertex_attributes})
    rows = net.ends(net.arcs.select("i", "j"), need) if need else net.arcs.select("i", "j")
    return rows.agg(*[F.coalesce(F.sum(t.change_column(net).cast("double")), F.lit(0.0)).alias(c) for c, t in terms.items()])


def _numbered(terms: TermSet) -> tuple[dict[str, PairTerm], dict[str, Term]]:
    """Terms under plain column names, as two may have one name: those of a dyad and its ends alone, and the others."""
    named = {f"s{k}": t for k, t in enumerate(terms)}
    return {c: t for c, t in named.items() if isinstance(t, PairTerm)}, {c: t for c, t in named.items() if not isinstance(t, PairTerm)}


def summary_stats(net: Network, terms: Iterable[Term]) -> DataFrame:
    """One row with a double column for each statistic, named as its coefficient.

    Terms over a tie and its ends share one pass over the arcs; those that are sums over degrees, over joined pairs or
    over the partners of ties share one aggregation of each of these, so the closed triples are made once."""
    own = expanded(net, terms)
    cheap, rest = _numbered(own)
    parts = [_pair_row(net, cheap)] if cheap else []
    tables: dict[str, list] = {}
    values, kinds = {c: F.col(c) for c in cheap}, []
    for c, t in rest.items():
        got = t.sums(net)
        if got is None:
            parts.append(t.stat(net).withColumnRenamed("value", c))
            values[c] = F.col(c)
            continue
        for k, (name, x) in enumerate(got[0]):
            tables.setdefault(name, []).append(F.coalesce(x.cast("double"), F.lit(0.0)).alias(f"{c}_{k}"))
        values[c] = got[1](*[F.col(f"{c}_{k}") for k in range(len(got[0]))])
        kinds += t.partner_kinds(net) if any(name == "partners" for name, _ in got[0]) else ()
    for name, columns in tables.items():
        rows = net.tie_census(tuple(dict.fromkeys(kinds))) if name == "partners" else getattr(net, name)
        parts.append(rows.agg(*columns))
    got = reduce(lambda a, b: a.crossJoin(b), parts)  # single rows
    return got.select(*[values[f"s{k}"].cast("double").alias(f"s{k}") for k in range(len(own))]).toDF(*own.names)


def compute_all(net: Network, terms: Iterable[Term]) -> list[float]:
    return [float(x) for x in summary_stats(net, terms).first()]


def change_stat(term: Term, net: Network, i: int, j: int) -> float:
    """Of one dyad."""
    pairs = net.spark.createDataFrame([(i, j) if net.directed else (min(i, j), max(i, j))], "i long, j long")
    own = net.arcs.select("i", "j", F.lit(1).alias("y"))
    back = net.arcs.select(F.col("j").alias("i"), F.col("i").alias("j"), F.lit(1).alias("r"))
    pairs = pairs.join(own, ["i", "j"], "left").join(back, ["i", "j"], "left").fillna(0, ["y", "r"])
    return float(term.change(net, pairs).first()["delta"])


def _whole(net: Network, own: TermSet) -> tuple[str, Term] | None:
    """The one term that comes in tiles, where all others look at a dyad and its ends alone."""
    rest = [(f"s{k}", t) for k, t in enumerate(own) if t.dyad_column(net) is None]
    return rest[0] if len(rest) == 1 and hasattr(rest[0][1], "whole") and tiles.fits(net) else None


def _counts_triangles(net: Network, own: TermSet) -> bool:
    """Whether dyads differ by their partners' number alone, beside what their classes and ties are, in a network that no
    tiles hold."""
    rest = [t for t in own if t.dyad_column(net) is None]
    observed = net.missing is None and net.silent is None and not net.rule
    return not net.directed and observed and not tiles.fits(net) and bool(rest) and all(isinstance(t, Triangle) for t in rest)


def _touched_in_tiles(net: Network, own: TermSet) -> DataFrame | None:
    """(i, j, y, r, the change of the term of partners) of the dyads that a path or a tie joins, where tiles have them."""
    one = _whole(net, own)
    return one and one[1].whole(net, dense=False).select("i", "j", "y", "r", F.col("delta").alias(one[0]))


def _changes(net: Network, own: TermSet, pairs: DataFrame) -> DataFrame:
    """(i, j, y, s0, s1, ...): terms that look at a dyad and its ends alone in one pass, each of the others joined unless
    the pairs have it."""
    named = {f"s{k}": t for k, t in enumerate(own)}
    cheap = {c: x for c, t in named.items() if (x := t.dyad_column(net)) is not None}
    ends = known(net, TermSet(named[c] for c in cheap))
    rest = [c for c in named if c not in cheap]
    got = pairs
    if net.tiled(pairs) and (one := _whole(net, own)):  # its rows have the ties of all dyads
        got = one[1].whole(net).select("i", "j", "y", "r", F.col("delta").alias(one[0]))
    if len(ends.columns) > 1:
        got = net.joined_ends(got, ends, tiles.fits(net))
    done = [c for c in rest if c in got.columns]
    got = got.select("i", "j", "y", "r", *done, *[x.cast("double").alias(c) for c, x in cheap.items()])
    for c in rest:
        if c not in done:
            got = got.join(named[c].change(net, pairs).withColumnRenamed("delta", c), ["i", "j"])
    return got.select("i", "j", "y", *named)


def change_stat_all(net: Network, terms: Iterable[Term], pairs: DataFrame | None = None) -> DataFrame:
    """(i, j, y, one column for each statistic) of the given dyads, by default all observed ones."""
    own = expanded(net, terms)
    return _changes(net, own, net.dyads if pairs is None else pairs).toDF("i", "j", "y", *own.names)


def mple_design(net: Network, terms: Iterable[Term], sparse: bool | None = None) -> DataFrame:
    """Distinct rows of change statistics with n_tot dyads, n_one of them tied: map-side sums before the shuffle.

    Dyads that no tie or shared partner touches are counted instead of listed where every term allows it, vertices fall
    into few classes, and the measured number of touched ones is small beside all; sparse=True counts them in any network,
    sparse=False always lists them. With one term of partners at most, the touched ones come from tiles without a shuffle."""
    own = expanded(net, terms)
    keys = [F.round(f"s{k}", DIGITS).alias(f"s{k}") for k in range(len(own))]
    rest = None
    if sparse is None:
        sparse = net.n_pairs > LISTED and LISTED_EACH * touched_rows(net, own) < net.n_pairs
    if sparse and supported(net, own) and _counts_triangles(net, own) and few_classes(net, own):
        cls = classes(net, own).cache()
        listed = stored(paired(net, cls))[0]
        rest = complement(net, own, listed, cls)
        every = listed.unionByName(rest.select("i", "j", F.lit(0).cast("long").alias("s"), F.lit(0).alias("y"), "n_tot"))
        rows = net.joined_ends(every.withColumn("r", F.col("y")), known(net, own))
        values = [(F.col("s") if isinstance(t, Triangle) else t.dyad_column(net)).cast("double").alias(f"s{k}") for k, t in enumerate(own)]
        rows = rows.select("y", "n_tot", *values)
        return rows.groupBy(*keys).agg(F.sum("n_tot").alias("n_tot"), F.sum(F.col("y") * F.col("n_tot")).alias("n_one")).toDF(*own.names, "n_tot", "n_one")
    if sparse and supported(net, own):
        net.listed = listed = _touched_in_tiles(net, own)
        if listed is None:
            net.listed = listed = touched(net, own)
        rest = complement(net, own, listed)
    if rest is None:
        got = _changes(net, own, net.dyads).groupBy(*keys).agg(F.count("*").alias("n_tot"), F.sum("y").alias("n_one"))
        return got.toDF(*own.names, "n_tot", "n_one")
    rows = _changes(net, own, listed).select("y", *[f"s{k}" for k in range(len(own))], F.lit(1).cast("long").alias("n_tot"))
    values = idle(net, own, rest.select("i", "j", "n_tot")).select(F.lit(0).alias("y"), *[f"s{k}" for k in range(len(own))], "n_tot")
    every = rows.union(values)
    return every.groupBy(*keys).agg(F.sum("n_tot").alias("n_tot"), F.sum("y").alias("n_one")).toDF(*own.names, "n_tot", "n_one")


def terms_of(terms: Iterable[Term]) -> TermSet:
    return terms if isinstance(terms, TermSet) else TermSet(terms)
