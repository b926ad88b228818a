import numpy as np
import pytest
from helpers import AGE, GROUP, brute, small

from arcweave.mcmc.kernel import State
from arcweave.mcmc.sample import bound_chain
from arcweave.network import Network
from arcweave.operators.base import is_dyad_dependent, required_vertex_attributes, requires_directed, requires_undirected
from arcweave.operators.nodal import AbsDiff, EdgeCov, NodeCov, NodeFactor, NodeMatch, NodeMismatch, NodeMix
from arcweave.operators.structural import KINDS, GWDSP, GWESP, Degree, Edges, GWDegree, GWIDegree, GWODegree, IDegree, Kstar, Mutual, ODegree, Triangle, TwoPath
from arcweave.plans.design import change_stat, change_stat_all, compute, compute_all, mple_design, summary_stats

COV = [[i * j % 7 for j in range(1, 8)] for i in range(1, 8)]
BOTH = {
    "edges": Edges(), "triangle": Triangle(), "kstar:2": Kstar(2), "kstar:3": Kstar(3), "twopath": TwoPath(), "gwdegree": GWDegree(0.5),
    "nodefactor:A": NodeFactor("group", level="A"), "nodecov": NodeCov("age"), "nodecovlog": NodeCov("age", "log"), "nodecovsqrt": NodeCov("age", "sqrt"),
    "nodematch": NodeMatch("group"), "nodematch:B": NodeMatch("group", diff=True, level="B"), "nodemismatch": NodeMismatch("group"),
    "absdiff": AbsDiff("age"), "absdiff:2": AbsDiff("age", 2.0), "mix:A.B": NodeMix("group", "A", "B"), "edgecov": EdgeCov(COV),
}
ONLY_DIRECTED = {"mutual": Mutual(), "gwideg": GWIDegree(0.5), "gwodeg": GWODegree(0.5), "idegree:1": IDegree(1), "odegree:2": ODegree(2), **{f"gwesp:{k}": GWESP(0.5, k) for k in KINDS}, **{f"gwdsp:{k}": GWDSP(0.5, k) for k in KINDS}}
ONLY_UNDIRECTED = {"degree:2": Degree(2), "degree:0": Degree(0), "gwesp:OTP": GWESP(), "gwdsp:OTP": GWDSP()}


def ring(n, extra, directed, seed):
    rng = np.random.default_rng(seed)
    edges = {(i, i % n + 1) for i in range(1, n + 1)}
    while len(edges) < n + extra:
        i, j = (int(x) for x in rng.integers(1, n + 1, 2))
        if i != j and (directed or ((j, i) not in edges)):
            edges.add((i, j))
    return sorted(edges)


@pytest.mark.parametrize("directed", [True, False])
def test_statistics_and_changes_match_brute_force(spark, directed):
    named = BOTH | (ONLY_DIRECTED if directed else ONLY_UNDIRECTED)
    for net, edges, n, group, age in (
        (small(spark, directed), None, 7, GROUP, AGE),
        (Network.from_edges(spark, 8, ring(8, 9, directed, 5), directed, {"group": [*GROUP, None], "age": [*AGE, None]}), ring(8, 9, directed, 5), 8, [*GROUP, None], [*AGE, 0.0]),
    ):
        own = {k: t for k, t in named.items() if k != "edgecov" or n == 7}
        edges = edges or [tuple(r) for r in net.arcs.select("i", "j").collect()]
        edges = [e if directed else (min(e), max(e)) for e in edges]
        got = compute_all(net, own.values())
        want = [brute(k, edges, n, directed, group, age) for k in own]
        assert np.allclose(got, want), dict(zip(own, zip(got, want)))
        rows = change_stat_all(net, own.values()).toPandas()
        assert len(rows) == net.n_dyads
        chain = bound_chain(net, own.values())
        state = State(chain.matrix(chain.ties), directed)
        for r in rows.to_numpy().tolist():
            i, j, y = int(r[0]), int(r[1]), int(r[2])
            plus, minus = {*edges, (i, j)}, {*edges} - {(i, j)}
            want = [brute(k, plus, n, directed, group, age) - brute(k, minus, n, directed, group, age) for k in own]
            assert np.allclose(r[3:], want), (i, j, [x for x in zip(own, r[3:], want) if abs(x[1] - x[2]) > 1e-9])
            here = [t.local(state, i - 1, j - 1, y) for t in chain.terms]
            assert np.allclose(here, want), (i, j, [x for x in zip(own, here, want) if abs(x[1] - x[2]) > 1e-9])
        assert np.allclose(chain.stats(chain.ties), got)


def test_hand_values(spark):
    w = 1 + (1 - np.exp(-0.5))
    a = Network.from_edges(spark, 5, [(1, 3), (3, 2), (1, 4), (4, 2), (1, 2)], True)
    assert np.allclose(compute_all(a, [GWESP(0.5, k) for k in KINDS]), [w, 0, 2, 2, 4 + w])
    assert np.allclose(compute_all(a, [GWDSP(0.5, k) for k in KINDS]), [w, w, 3, 3, 4 + 2 * w])
    c = Network.from_edges(spark, 3, [(1, 2), (2, 3), (3, 1)], True)
    assert np.allclose(compute_all(c, [GWESP(0.5, k) for k in KINDS]), [0, 3, 0, 0, 3])
    path = Network.from_edges(spark, 5, [(1, 2), (2, 3), (3, 4)], False)
    assert compute_all(path, [Degree(range(4))]) == [1, 2, 2, 0]
    both = Network.from_edges(spark, 3, [(1, 2), (2, 1), (2, 3)], True)
    assert compute(Mutual(), both) == 1 and change_stat(Mutual(), both, 3, 2) == 1 and change_stat(Mutual(), both, 1, 3) == 0


def test_names_and_expansion(spark):
    und, directed = small(spark, False), small(spark, True)
    assert summary_stats(und, [Edges(), NodeFactor("group")]).columns == ["edges", "nodefactor.group.B"]
    assert compute_all(und, [Edges(), NodeFactor("group", base=0)]) == [8, 10, 6]
    assert compute(NodeFactor("group", levels=["A", "B"]), und) == 16
    assert compute_all(und, [NodeMix("group", levels2=0)])[0] == brute("mix:A.A", [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (2, 5), (5, 6), (1, 5)], 7, False, GROUP)
    assert summary_stats(und, [NodeMix("group")]).columns == ["mix.group.A.B", "mix.group.B.B"]
    assert summary_stats(directed, [NodeMix("group", levels2=0)]).columns == ["mix.group.A.A", "mix.group.B.A", "mix.group.A.B", "mix.group.B.B"]
    assert summary_stats(und, [NodeMix("group", levels2=[3, 1])]).columns == ["mix.group.B.B", "mix.group.A.A"]
    assert [t.name for t in (GWESP(), GWESP(0.2, "ISP"), GWDSP(1.0, "union"), GWDegree(), Kstar(2), NodeCov("x", "log"), AbsDiff("x", 2))] == ["gwesp.fixed.0.5", "gwesp.ISP.fixed.0.2", "gwdsp.union.fixed.1.0", "gwdegree.fixed.0.5", "kstar2", "nodecov.x", "absdiff.x"]
    assert compute(NodeMatch("group", diff=True, level="Z"), und) == 0


@pytest.mark.parametrize("make", [lambda: NodeFactor("g", level="a", levels=["a"]), lambda: NodeFactor("g", base=-1), lambda: NodeMatch("g", level="a"), lambda: Kstar(1), lambda: Degree(-1), lambda: GWESP(0), lambda: GWESP(0.5, "XYZ"), lambda: NodeCov("a", "cube"), lambda: EdgeCov([[1, 2, 3]]), lambda: NodeMix("g", "a")])
def test_bad_terms(make):
    with pytest.raises(ValueError):
        make()


def test_bad_models(spark):
    und, directed = small(spark, False), small(spark, True)
    for net, term, match in ((und, Mutual(), "directed"), (directed, Degree(1), "undirected"), (und, NodeCov("wealth"), ":wealth.*:age, :group"), (und, NodeFactor("group", levels=["Z"]), "Z"), (und, NodeFactor("group", base=[1, 2]), "without"), (und, NodeMix("group", levels2=[1, -1]), "levels2"), (und, EdgeCov("weight"), ":weight"), (und, NodeMatch("group", diff=True), "level")):
        with pytest.raises(ValueError, match=match):
            summary_stats(net, [term])
    with pytest.raises(ValueError, match="at least one"):
        summary_stats(und, [])


def test_traits():
    assert is_dyad_dependent(GWESP()) and not is_dyad_dependent([Edges(), NodeCov("a"), EdgeCov("w")])
    assert required_vertex_attributes(NodeMix("g")) == ("g",) and requires_directed(Mutual()) and requires_undirected(Degree(1)) and not requires_undirected(IDegree(1))


def test_design_counts_every_dyad_once(spark):
    net = small(spark, True, missing=[(1, 2), (3, 7)])
    rows = mple_design(net, [Edges(), Mutual(), NodeMatch("group")]).toPandas()
    assert rows.n_tot.sum() == 40 == net.n_dyads and rows.n_one.sum() == 9


def test_edge_attribute_covariate(spark):
    net = small(spark, True)
    weights = spark.createDataFrame([(1, 2, 2.5), (2, 3, 4.0)], "i long, j long, w double")
    net = net.with_edge_attribute(weights, "w")
    assert compute(EdgeCov("w"), net) == 6.5 and EdgeCov("w").name == "edgecov.w"
    assert change_stat(EdgeCov("w"), net, 2, 3) == 4.0 and change_stat(EdgeCov("w"), net, 7, 3) == 0.0


def test_empty_network(spark):
    net = Network.from_edges(spark, 4, [], True)
    assert compute_all(net, [Edges(), Mutual(), Triangle(), TwoPath(), GWESP(), GWDSP(), GWIDegree(), IDegree(0), Kstar(2)]) == [0, 0, 0, 0, 0, 0, 0, 4, 0]


@pytest.mark.parametrize("directed", [True, False])
def test_counted_design_equals_listed_design(spark, directed):
    edges = [e for e in ring(30, 12, directed, 3)]
    missing = [(1, 2), (4, 20), (7, 9)]
    net = Network.from_edges(spark, 34, edges, directed, {"group": [None if k % 7 == 0 else "AB"[k % 2] for k in range(34)], "age": [float(k % 3) for k in range(34)]}, missing)
    cov = spark.createDataFrame([(2, 9, 1.5), (11, 30, 2.0)], "i long, j long, x double")
    models = [[Edges()], [Edges(), Triangle(), GWESP(0.5, "union"), EdgeCov(cov)], [Edges(), NodeMatch("group"), NodeCov("age"), TwoPath(), Kstar(2), *([Mutual(), GWIDegree()] if directed else [Degree(2)])]]
    models += [[Edges(), *(GWDSP(0.5, k) for k in KINDS if k != "union")] if directed else [Edges(), GWDSP(0.5), NodeMatch("group")]]
    for terms in models:
        names = [x.name for t in terms for x in t.expand(net)]
        one, two = (mple_design(net, terms, s).toPandas().round(8).sort_values(names).to_numpy(float).tolist() for s in (True, False))
        assert np.allclose(one, two, atol=1e-7) and sum(r[-2] for r in one) == net.n_dyads


def test_changes_of_all_dyads_start_from_the_ties(spark):
    """Both ways to the changes of shared-partner terms agree: for all dyads, from the ties, and for asked ones, from their ends."""
    for directed in (True, False):
        net = Network.from_edges(spark, 14, ring(14, 22, directed, 3), directed)
        listed = net.dyads.select("*")
        assert net.is_whole(net.dyads) and not net.is_whole(listed)
        for term in (Triangle(), *(GWESP(0.7, kind) for kind in (KINDS if directed else ("OTP",))), *((GWDSP(0.7, kind) for kind in ("ITP", "union")) if directed else ())):
            one, two = ({(r.i, r.j): r.delta for r in term.change(net, p).collect()} for p in (net.dyads, listed))
            assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)


def rows_shuffled(df):
    """Runs a plan; the rows that its shuffles wrote."""
    df._jdf.collectToPython()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name in ("AdaptiveSparkPlanExec", "ShuffleQueryStageExec", "BroadcastQueryStageExec", "ResultQueryStageExec"):
            todo.append(node.executedPlan() if name == "AdaptiveSparkPlanExec" else node.plan())
        got = node.metrics().get("shuffleRecordsWritten")
        if got.isDefined():
            total += got.get().value()
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return total


#: One term for each plan of a change: of the dyad alone, of its ends, their degrees, its ties, and the partner terms.
WHOLE = {
    True: [Edges(), AbsDiff("age"), GWDegree(0.5), IDegree(2), Mutual(), TwoPath(), Triangle(), *(GWESP(0.5, k) for k in KINDS), *(GWDSP(0.5, k) for k in KINDS)],
    False: [Edges(), NodeMatch("group"), GWDegree(0.5), Degree(2), TwoPath(), Triangle(), GWESP(0.5), GWDSP(0.5)],
}


@pytest.mark.parametrize("directed", [True, False])
def test_changes_of_all_dyads_shuffle_no_dyads(spark, directed):
    """Shuffles carry ties and vertices, however many dyads or paths there are, also where no table is small enough to be broadcast unasked."""
    n, edges = 300, ring(300, 500, directed, 6)
    net = Network.from_edges(spark, n, edges, directed, {"group": [GROUP[k % 7] for k in range(n)], "age": [AGE[k % 7] for k in range(n)]}).cached()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for term in WHOLE[directed][::3]:
            got = term.change(net, net.dyads)
            assert rows_shuffled(got) < 30 * (n + len(edges)) < net.n_dyads, term.name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_several_changes_of_all_dyads_shuffle_no_dyads(spark):
    """Terms of a dyad, its ends and their degrees share one pass over the tiles."""
    n, edges = 300, ring(300, 500, True, 6)
    net = Network.from_edges(spark, n, edges, True, {"group": [GROUP[k % 7] for k in range(n)]}).cached()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows_shuffled(change_stat_all(net, [Edges(), Mutual(), TwoPath(), NodeMatch("group")])) < 30 * (n + len(edges)) < net.n_dyads
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("directed", [True, False])
def test_changes_in_several_tiles(spark, monkeypatch, directed):
    """Blocks of about four vertices, a vertex without ties and a tie to an unknown one: as joined for the same dyads listed."""
    from arcweave.plans import tiles

    edges = ring(17, 30, directed, 8) + [(3, 99), (99, 7), (98, 3)]
    net = Network.from_edges(spark, 19, edges, directed, {"group": [GROUP[k % 7] for k in range(19)], "age": [AGE[k % 7] for k in range(19)]})
    monkeypatch.setattr(tiles, "BLOCK", 4)
    assert tiles.fits(net) and tiles.blocks(net) == 5
    monkeypatch.setattr(tiles, "MAX_TIES", 0)
    listed = net.dyads  # joined
    want = {type(t).__name__ + t.name: {(r.i, r.j): r.delta for r in t.change(net, listed.select("*")).collect()} for t in WHOLE[directed]}
    monkeypatch.undo()
    monkeypatch.setattr(tiles, "BLOCK", 4)
    del net.__dict__["dyads"]
    assert sorted(map(tuple, net.dyads.collect())) == sorted(map(tuple, listed.collect()))
    for term in WHOLE[directed]:
        assert net.tiled(net.dyads)
        rows = [(r.i, r.j, r.delta) for r in term.change(net, net.dyads).collect()]
        own = want[type(term).__name__ + term.name]
        assert len(rows) == len(own) and all(abs(own[i, j] - x) < 1e-9 for i, j, x in rows), term.name


def test_covariate_of_ends_is_not_joined_with_dyads(spark, monkeypatch):
    """Masks in columns and in maps agree, and no dyad is shuffled for them."""
    from pyspark.sql import functions as F

    from arcweave.operators.nodal import OfEnds
    from arcweave.sources import graphs

    net = graphs.user_network(spark, "/root/testdata/sf0.001").cached()
    monkeypatch.setattr(graphs, "MASK", 2)  # several masks
    columns = graphs.shared_types(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(graphs, "COLUMNS", 0)
    one, two = ({(r.i, r.j): r.delta for r in EdgeCov(c).change(net, net.dyads).collect()} for c in (columns, graphs.shared_types(spark, "/root/testdata/sf0.001")))
    assert one == two and len(one) == net.n_dyads and len(columns.own.columns) > 2
    n = 300
    net = Network.from_edges(spark, n, ring(n, 100, True, 6), True).cached()
    own = spark.range(2, n).select(F.col("id").alias("v"), (F.col("id") % 5).alias("x"))
    got = EdgeCov(OfEnds(own, F.col("x_i") * F.col("x_j"))).change(net, net.dyads)
    assert rows_shuffled(got) < 30 * n < net.n_dyads
    assert all(r.delta == (r.i % 5 * (r.j % 5) if min(r.i, r.j) > 1 and max(r.i, r.j) < n else 0) for r in got.collect())


def test_design_of_partners_shuffles_no_paths(spark):
    """The touched dyads of a design with one term of partners come from tiles, as counted as from a list of all dyads."""
    n = 300
    for terms in ([Edges(), GWDSP(0.5)], [Edges(), Triangle(), NodeMatch("group")]):
        net = Network.from_edges(spark, n, ring(n, 500, False, 6), False, {"group": [GROUP[k % 7] for k in range(n)]}).cached()
        got = mple_design(net, terms, sparse=True)
        assert rows_shuffled(got) < 30 * (n + 800)
        one, two = ({tuple(round(x, 6) for x in r[:-2]): tuple(r[-2:]) for r in x.collect()} for x in (got, mple_design(net, terms, sparse=False)))
        assert one == two and sum(x[0] for x in one.values()) == net.n_dyads


def rows_made(df):
    """Runs a plan; the most rows that any of its operators put out."""
    df._jdf.collectToPython()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        for inner in ("executedPlan", "plan"):
            if node.getClass().getSimpleName() in {"executedPlan": ("AdaptiveSparkPlanExec",), "plan": ("ShuffleQueryStageExec", "BroadcastQueryStageExec")}[inner]:
                todo.append(getattr(node, inner)())
        got = node.metrics().get("numOutputRows")
        if got.isDefined():
            most = max(most, got.get().value())
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return most


def test_changes_of_two_dyads_follow_their_degrees(spark):
    """A hub joined to all others beside a sparse rest: the shared partners of the whole network are never made."""
    n = 3_000
    edges = ring(n, 3 * n, False, 2) + [(1, k) for k in range(3, n)]
    net = Network.from_edges(spark, n, edges, False).cached()
    ties = {tuple(sorted(e)) for e in edges}
    near = {v: set() for v in range(1, n + 1)}
    for i, j in ties:
        near[i].add(j)
        near[j].add(i)
    asked = [(1, 2), (40, 900)]
    pairs = spark.createDataFrame([(i, j, int((i, j) in ties), int((i, j) in ties)) for i, j in asked], "i long, j long, y int, r int")
    for term in (Triangle(), GWESP(0.5), GWDSP(0.5)):
        got = term.change(net, pairs)
        assert rows_made(got) < 20_000 + 2 * len(ties)  # the ties are read, both ways
        made = {(r.i, r.j): r.delta for r in got.collect()}
        for i, j in asked:
            shared = near[i] & near[j]
            if isinstance(term, Triangle):
                want = len(shared)
            else:
                w, own = 1 - np.exp(-0.5), int((i, j) in ties)
                each = [(a, k) for a, b in ((i, j), (j, i)) for k in near[b] - {a} if isinstance(term, GWDSP) or k in near[a]]
                want = sum(w ** (len(near[a] & near[k]) - own) for a, k in each) + (np.exp(0.5) * (1 - w ** len(shared)) if isinstance(term, GWESP) else 0)
            assert abs(made[i, j] - want) < 1e-6


def test_partners_of_hubs_are_cut_into_cells(spark, monkeypatch):
    import arcweave.network as module

    rng = np.random.default_rng(4)
    edges = {(1, k) for k in range(2, 61)} | {(k, 61) for k in range(5, 50)} | {(int(a), int(b)) for a, b in rng.integers(1, 62, (40, 2)) if a != b}
    for directed in (True, False):
        own = sorted(edges) if directed else sorted({tuple(sorted(e)) for e in edges})
        want = Network.from_edges(spark, 64, own, directed)
        for kind in KINDS if directed else ("und",):
            whole = {(r.a, r.b): r.s for r in want.shared_partners(kind).collect()}
            count, rest = want.lone_pairs(kind)
            listed = {(r.a, r.b): r.s for r in rest.collect()}
            assert all(whole[k] == v for k, v in listed.items()) and count.first()[0] == len(whole) - len(listed) and all(whole[k] == 1 for k in whole.keys() - listed.keys())
            monkeypatch.setattr(module, "HUB", 7)
            cut = Network.from_edges(spark, 64, own, directed)
            cells = cut._paths(*cut._lists(kind))
            assert {(r.a, r.b): r.s for r in cut.shared_partners(kind).collect()} == whole
            # several cells for a hub, none of them beyond what its blocks allow by far
            sizes = [r["count"] for r in cells.groupBy("k", "p", "q").count().collect()]
            assert len(sizes) > cut._lists(kind)[0].select("k").distinct().count() - 3 and max(sizes) < 25 * 25
            monkeypatch.undo()


def test_statistic_of_a_large_star(spark):
    """50,000 leaves share one partner pairwise: 1.2 billion pairs are counted by the hub, not listed."""
    n = 50_001
    arcs = spark.range(2, n + 1).selectExpr("1L AS i", "id AS j")
    net = Network(spark.range(1, n + 1).toDF("v"), arcs, False)
    got = GWDSP(0.5).stat(net)
    assert rows_made(got) < 20 * n
    assert np.isclose(got.first()[0], (n - 1) * (n - 2) / 2)


def test_closed_triples_of_hubs(spark):
    """A wheel with a hub and a second hub: each triple once, whichever end has more neighbours."""
    rim = [(k, k % 20 + 1) for k in range(1, 21)]
    edges = rim + [(21, k) for k in range(1, 21)] + [(k, 22) for k in range(1, 11)]
    for directed in (True, False):
        net = Network.from_edges(spark, 22, edges, directed)
        e = set(edges)
        joined = lambda i, j: (i, j) in e or (j, i) in e
        want = {(i, j, k) for i in range(1, 23) for j in range(i + 1, 23) for k in range(j + 1, 23) if joined(i, j) and joined(j, k) and joined(i, k)}
        assert sorted(tuple(sorted((r.u, r.v, r.w))) for r in net.closed.collect()) == sorted(want) and len(want) > 25
        for kind in KINDS if directed else ("und",):
            got = {(r.i, r.j): r.s for r in net.tie_partners(kind).collect()}
            have = {(r.a, r.b): r.s for r in net.shared_partners(kind).collect()}
            ties = {(r.i, r.j) for r in net.arcs.collect()}
            assert got == {k: s for k, s in have.items() if k in ties}


def test_covariate_of_asked_pairs(spark):
    from pyspark.sql import functions as F

    net = small(spark, True)
    term = EdgeCov(lambda n, pairs: pairs.select("i", "j", (F.col("i") * F.col("j") % 7).cast("double").alias("x")), "cov")
    table = EdgeCov(COV)
    assert compute(term, net) == compute(table, net)
    one, two = ({(r.i, r.j): r.delta for r in t.change(net, net.dyads).collect()} for t in (term, table))
    assert one == two and mple_design(net, [term], sparse=True).count() == mple_design(net, [table], sparse=False).count()


def test_driver_collections_are_checked(spark, monkeypatch):
    from arcweave.diag import panels
    from arcweave.operators import nodal

    net = small(spark, False)
    monkeypatch.setattr(nodal, "MAX_LEVELS", 1)
    monkeypatch.setattr(nodal, "MAX_ENTRIES", 3)
    monkeypatch.setattr(panels, "MAX_VERTICES", 5)
    with pytest.raises(ValueError):
        nodal.levels_of(net, "group")
    with pytest.raises(ValueError):
        EdgeCov(COV).bind(net, np.arange(1, 8))
    with pytest.raises(ValueError):
        panels.distance_counts(net.arcs, net.vertices, False)


def test_ranges_of_a_crowded_day(spark):
    """The order of events holds across the stretches that a day is cut into."""
    from pyspark.sql import functions as F

    from arcweave.sources import graphs

    rows = [(k, f"2024-03-{1 + k % 3:02d} {k * 7 % 24:02d}:{k * 13 % 60:02d}:{k * 29 % 60:02d}", k * 31 % 17, "buy") for k in range(400)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    order = [r[2] for r in sorted(rows, key=lambda r: (r[1], r[0]))]
    want = {}
    for a, b in zip(order, order[1:]):
        if a != b:
            want[a, b] = want.get((a, b), 0) + 1
    before = graphs.RANGE_ROWS
    for most in (1_000_000, 9):
        graphs.time_ranges.__defaults__ = (most,)
        assert {(r.i, r.j): r.n for r in graphs.successors(events, "buy").collect()} == want
    graphs.time_ranges.__defaults__ = (before,)


def test_golden_values(tmp_path):
    from arcweave import load_golden

    (tmp_path / "g.toml").write_text("name = 'n'\n[fit]\ncoef = [1.5, -2]\n[fit.se]\nedges = 0.25\n")
    assert load_golden(str(tmp_path / "g.toml")) == {"name": "n", "fit": {"coef": [1.5, -2], "se": {"edges": 0.25}}}


def test_design_of_triangles_from_lists(spark, monkeypatch):
    """A network too large for tiles: neighbours' lists, hubs' in blocks, count as all dyads listed, and no path is shuffled."""
    from arcweave.plans import sparse, tiles

    n = 300
    edges = ring(n, 300, False, 6) + [(1, k) for k in range(3, 200)]
    net = Network.from_edges(spark, n, edges, False, {"group": [GROUP[k % 7] if k % 11 else None for k in range(n)]}).cached()
    terms = [Edges(), Triangle(), NodeMatch("group"), Degree(4)]
    rows = lambda d: sorted(tuple(round(x, 6) for x in r) for r in d.collect())
    want = rows(mple_design(net, terms, sparse=False))
    monkeypatch.setattr(tiles, "MAX_TIES", 0)
    monkeypatch.setattr(sparse, "HUB", 50)
    got = mple_design(net, terms, sparse=True)
    assert rows(got) == want and sum(r[-2] for r in want) == net.n_dyads
    paths = int(sum(r.d**2 for r in net.degrees.collect()))
    assert rows_shuffled(sparse.paired(net, sparse.classes(net, mple_terms(net, terms)))) < paths / 2


def mple_terms(net, terms):
    from arcweave.operators.base import expanded

    return expanded(net, terms)
