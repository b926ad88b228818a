"""Statistics kept up from a log of changes against those of the whole network after each batch."""

import tempfile

import pytest
from helpers import AGE, GROUP, small

from arcweave.network import Network
from arcweave.operators.nodal import EdgeCov, NodeCov, NodeFactor, NodeMatch
from arcweave.operators.structural import GWDSP, GWESP, Degree, Edges, GWDegree, IDegree, Kstar, Mutual, Triangle
from arcweave.plans.design import compute_all
from arcweave.streaming.toggles import KeptStats

TERMS = {
    True: [Edges(), Triangle(), NodeFactor("group"), Mutual(), IDegree(0), GWESP(0.5, "ISP")],
    False: [Kstar(2), GWDegree(0.5), NodeCov("age"), NodeMatch("group"), GWDSP(0.5), Degree([0, 2])],
}
ROWS = "at long, i long, j long, on boolean, i_j string"
#: Several changes of one dyad, repeated rows, changes that change nothing, nulls, loops, ends that are no vertices, nothing.
BATCHES = [
    [(1, 1, 2, False, "x"), (2, 7, 1, True, "x"), (3, 7, 3, True, "x"), (3, 7, 3, True, "x")],
    [(9, 4, 6, True, "x"), (8, 4, 6, False, "x"), (4, 2, 3, True, "x"), (None, 1, 2, True, None), (5, 1, 2, False, None)],
    [],
    [(1, None, 2, True, "x"), (1, 3, 3, True, "x"), (1, 3, 99, True, "x"), (1, 5, 6, None, "x"), (2, 5, 6, False, "x")],
    [(1, 7, 1, False, "x"), (1, 7, 3, False, "x"), (1, 2, 6, True, "x"), (1, 6, 2, True, "x"), (1, 1, 2, True, "x")],
]


def place():
    return tempfile.mkdtemp(prefix="spark-")


def plain(arcs, rows, directed):
    """The set of ties after the rows, one by one in the order of `at`."""
    out = set(arcs)
    for _, i, j, on, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, bool(r[3]))):
        if None in (i, j, on) or i == j or not {i, j} <= set(range(1, 8)):
            continue
        e = (i, j) if directed or i < j else (j, i)
        out = out | {e} if on else out - {e}
    return out


@pytest.mark.parametrize("directed", [True, False])
def test_stream_equals_fresh_statistics(spark, directed):
    net = small(spark, directed)
    source, path = place(), place()
    kept = KeptStats(net, TERMS[directed], path, compact=2)
    ties = {tuple(r) for r in net.arcs.select("i", "j").collect()}
    for b, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(source)
        again = KeptStats(net, TERMS[directed], path, compact=2)  # goes on where the last one stopped
        again.stream(spark.readStream.schema(ROWS).parquet(source)).awaitTermination()
        ties = plain(ties, rows, directed)
        assert {tuple(r) for r in again.network().arcs.collect()} == ties
        fresh = Network.from_edges(spark, 7, ties, directed, {"group": GROUP, "age": AGE})
        assert [r.value for r in again.stats().collect()] == pytest.approx(compute_all(fresh, TERMS[directed]), abs=1e-9), b
    assert kept.last() == len(BATCHES) - 1
    assert [r.value for r in kept.stats(-1).collect()] == pytest.approx(compute_all(net, TERMS[directed]), abs=1e-9)


def test_a_batch_that_runs_again_changes_nothing(spark):
    kept = KeptStats(small(spark, True), [Edges(), Triangle()], place(), compact=2)
    for b in (0, 0, 1, 1, 1):
        kept.fold(spark.createDataFrame(BATCHES[b], ROWS), b)
    fresh = compute_all(kept.network(), [Edges(), Triangle()])
    assert [r.value for r in kept.stats().collect()] == fresh and kept.last() == 1


def test_no_ties_and_edge_attributes(spark):
    bare = Network.from_edges(spark, 4, [], False)
    kept = KeptStats(bare, [Edges(), Triangle()], place())
    kept.fold(spark.createDataFrame([(1, 2, 1, True), (1, 3, 2, True), (1, 1, 3, True)], "at int, i int, j int, on boolean"), 0)
    assert [r.value for r in kept.stats().collect()] == [3.0, 1.0]
    with pytest.raises(ValueError, match="edge attributes"):
        weighted = bare.with_edge_attribute(spark.createDataFrame([], "i long, j long, w double"), "w")
        KeptStats(weighted, [EdgeCov("w")], place())


def test_work_follows_the_changed_neighbourhood(spark):
    """One change far from a hub: the subnetwork that is looked at has a few ties of 40,000."""
    n = 20_000
    arcs = spark.range(2, n + 1).selectExpr("1L AS i", "id AS j").union(spark.range(2, n).selectExpr("id AS i", "id + 1 AS j"))
    far = spark.range(n + 1, n + 21).selectExpr("id AS i", "id + 1 AS j")
    net = Network(spark.range(1, n + 22).toDF("v"), arcs.union(far), False)
    kept = KeptStats(net, [Edges(), Triangle()], place())
    seen = []
    import arcweave.streaming.toggles as toggles

    whole = toggles.compute_all
    toggles.compute_all = lambda net, terms: seen.append(net.n_edges) or whole(net, terms)
    try:
        kept.fold(spark.createDataFrame([(1, n + 5, n + 7, True)], "at int, i long, j long, on boolean"), 0)
    finally:
        toggles.compute_all = whole
    assert max(seen) <= 8
    assert [r.value for r in kept.stats().collect()] == [2 * n - 3 + 20 + 1, n - 2 + 1]
