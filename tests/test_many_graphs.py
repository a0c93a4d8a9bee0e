"""Small graphs are solved together, and whole rings of a graph are found in one task."""

import numpy as np
import pyarrow as pa
import pytest

from ohmgraph.operators import graphmetrics, linalg, rowstats
from ohmgraph.operators.linalg import Graph
from ohmgraph.plans import jobs
from ohmgraph.queries import registry

from .conftest import against_sql


def random_graph(n, share, seed):
    rng = np.random.default_rng(seed)
    u, v = np.triu_indices(n, 1)
    kept = rng.random(len(u)) < share
    return Graph(n, u[kept], v[kept], rng.uniform(0.1, 3, kept.sum()))


def test_graphs_of_one_size_are_solved_together():
    graphs = [random_graph(n, share, 7 * n + k) for n in (1, 2, 5, 9, 40) for k, share in enumerate((0.0, 0.3, 0.9, 1.0))]
    rows = [(np.arange(g.n) * 3 + 1, g.u * 3 + 1, g.v * 3 + 1, g.w) for g in graphs]
    lists = [pa.array([r[i].tolist() for r in rows], pa.list_(t)) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.float64()))]
    batch = pa.RecordBatch.from_arrays(lists, ["nodes", "u", "v", "w"])
    steps = 0
    for part, skip in ((batch, 0), (batch.slice(3), 3)):
        for at, names, lp in linalg.stacked_inverses(part):
            steps += 1
            for row, own, one in zip(at, names, lp, strict=True):
                g = graphs[row + skip]
                assert own.tolist() == rows[row + skip][0].tolist() and np.allclose(one, np.linalg.pinv(g.laplacian()), atol=1e-9)
    assert steps == 2 * (4 + 4)  # a step a small size, and one a graph that is not small


def test_complete_graphs_and_their_rows(spark):
    n = spark.createDataFrame([("a", 4), ("a", 2), ("a", 9), ("a", 4), ("b", 1)], "graph_id string, node int")
    packed = {r.graph_id: (r.nodes, r.u, r.v, r.w) for r in linalg.complete(n).collect()}
    assert packed == {"a": ([2, 4, 9], [2, 2, 4], [4, 9, 9], [1.0] * 3), "b": ([1], [], [], [])}
    got = {(r.graph_id, r.i): (r.radius, r.anisotropy) for r in rowstats.packed_inverse_stats(linalg.complete(n), 0.18).collect()}
    assert set(got) == {("a", 2), ("a", 4), ("a", 9), ("b", 1)} and got["a", 4] == (2, pytest.approx(1 / (2 * 2**0.5))) and got["b", 1] == (0, 0.0)


def test_rows_of_orders_equal_their_sql(spark):
    left, right = against_sql(spark, registry.QUERIES["r13_r14_pinv_rows"], registry.ORACLES["r13_r14_pinv_rows"], "sf0.01")
    assert left and left == right


@pytest.mark.parametrize("n,share,unit", [(12, 0.9, True), (30, 0.5, True), (30, 0.5, False), (25, 0.12, True), (40, 0.15, False)])
def test_paths_by_matrix_equal_those_by_heap(monkeypatch, n, share, unit):
    g = random_graph(n, share, n)
    g.w = np.ones(len(g.w)) if unit else g.w
    some = [0, 3, n - 1]
    by_matrix = linalg.between_by_matrix(g.lengths(), np.arange(n)), linalg.between_by_matrix(g.lengths(), np.array(some))
    monkeypatch.setattr(linalg, "BY_MATRIX", 0)
    assert by_matrix[0].tolist() == g.path_betweenness(range(n)).tolist() and by_matrix[1].tolist() == g.path_betweenness(some).tolist()


@pytest.mark.parametrize("share", [0.2, 0.9])
def test_a_changed_graph_equals_one_made_anew(share):
    g = random_graph(30, share, 5)
    wild = Graph(30, g.u, g.v, g.w, _spectrum=g.spectrum(), _fiedler=g.fiedler(), _lp=g.lp)
    for k, factor in ((0, 0.4), (7, 1.7), (29, 1.0)):
        new, at = wild.changed(k, factor), (g.u == k) | (g.v == k)
        matrix = Graph(30, g.u, g.v, np.where(at, g.w * factor, g.w)).laplacian()
        lam, vec = np.linalg.eigh(matrix)
        assert np.allclose(wild.changed_matrix(k, factor), matrix) and np.allclose(new.eigs, lam) and np.allclose(new.lp, np.linalg.pinv(matrix), atol=1e-9)
        assert np.allclose(new.fiedler(vec[:, 1]), vec[:, 1], atol=1e-9)


def test_only_graphs_that_are_asked_for_are_solved(spark):
    nodes = spark.sql("SELECT g AS graph_id, n AS node, 'A' AS chain, n AS resseq, 'A' AS aa1, n * 3.0D AS x, 0.0D AS y, 0.0D AS z FROM VALUES ('a'), ('b') t(g), (SELECT explode(sequence(0, 4)) AS n)")
    asked = spark.sql("SELECT i AS mutation_id, 'a' AS graph_id, IF(i = 3, NULL, 'A') AS chain, 2 AS position, 'A' AS wild_type, 'W' AS mutation, 1.0D AS ddG FROM (SELECT explode(sequence(1, 4)) AS i)")
    assert {r.graph_id for r in jobs.usable_nodes(asked, nodes).collect()} == {"a"}
    assert [r.mutation_id for r in jobs.features_of_graphs(asked, nodes).orderBy("mutation_id").collect()] == [1, 2, 3, 4]


@pytest.mark.parametrize("cells", [1_000_000, 40])
def test_rings_equal_distances(monkeypatch, cells):
    monkeypatch.setattr(graphmetrics, "CELLS", cells)
    g = random_graph(30, 0.1, 4)
    far = np.where(np.eye(30, dtype=bool), 0.0, np.inf)
    far[g.u, g.v] = far[g.v, g.u] = 1.0
    for k in range(30):
        far = np.minimum(far, far[:, [k]] + far[[k]])
    sites = np.array([2, 3, 11, 29, 77])
    got = sorted(t for d in graphmetrics.rings(sites, g.u, g.v, 3) for t in zip(d["site"].tolist(), d["node"].tolist(), d["hop"].tolist(), strict=True))
    assert got == sorted((s, n, int(far[s, n])) for s in (2, 3, 11, 29) for n in range(30) if 1 <= far[s, n] <= 3)


def test_rings_are_not_found_by_shuffled_joins(spark):
    e = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("a", 5, 6), (None, 0, 1)], "graph_id string, u int, v int")
    seeds = spark.createDataFrame([("a", 0), ("a", 0), ("a", 9), ("b", 0), (None, 0)], "graph_id string, node int")
    shells = graphmetrics.hop_shells(e, seeds, 3)
    assert sorted(map(tuple, shells.select("graph_id", "site", "node", "hop").collect())) == [("a", 0, 1, 1), ("a", 0, 2, 2)]
    assert "Join" not in shells._jdf.queryExecution().optimizedPlan().toString()
