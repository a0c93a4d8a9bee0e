"""Resistances by projections against the pseudoinverse."""

import numpy as np
import pandas as pd
import pytest

from ohmgraph.operators import linalg, projections


def two_pieces(seed=0, n=60):
    """A graph of two components and a node without edges, as (n, u, v, w)."""
    rng = np.random.default_rng(seed)
    links = {(i, i + 1) for i in range(n - 2) if i != n // 2}
    for a, b in rng.integers(0, n - 1, (200, 2)):
        if a < b and (a > n // 2) == (b > n // 2):
            links.add((int(a), int(b)))
    u, v = (np.array(x) for x in zip(*sorted(links), strict=True))
    return n, u, v, rng.uniform(0.2, 3.0, len(u))


def frames(spark, graphs):
    nodes = pd.concat([pd.DataFrame({"graph_id": name, "node": np.arange(g[0])}) for name, g in graphs.items()])
    edges = pd.concat([pd.DataFrame({"graph_id": name, "u": g[1], "v": g[2], "weight": g[3]}) for name, g in graphs.items()])
    return spark.createDataFrame(nodes), spark.createDataFrame(edges)


def test_solution_is_that_of_the_pseudoinverse():
    n, u, v, w = two_pieces()
    y = np.random.default_rng(1).normal(size=(n, 3))
    graph = projections.Sparse(n, u, v, w)
    y = graph.centred(y)
    assert np.allclose(graph.solved(y), linalg.Graph(n, u, v, w).lp @ y, atol=1e-6)
    assert len(set(projections.components(n, u, v))) == 3
    assert not graph.solved(np.zeros((n, 1))).any()


def test_all_pairs_are_within_the_error_and_reruns_agree(spark):
    graphs = {"a": two_pieces(), "b": two_pieces(3, 30)}
    nodes, edges = frames(spark, graphs)
    pairs = nodes.withColumnRenamed("node", "i").join(nodes.withColumnRenamed("node", "j"), "graph_id").where("i <= j")
    got = projections.resistance_by_projections(nodes, edges, pairs, error=0.3).toPandas()
    assert len(got) == sum(n * (n + 1) // 2 for n, *_ in graphs.values())
    for name, own in got.groupby("graph_id"):
        lp = linalg.Graph(*graphs[name]).lp
        true = lp[own.i, own.i] + lp[own.j, own.j] - 2 * lp[own.i, own.j]
        far = own.i != own.j
        assert (np.abs(own.r - true)[far] <= 0.3 * true[far] + 1e-9).all() and (own.r[~far] == 0).all()
        off = (np.abs(own.r - true)[far] / np.maximum(true[far], 1e-12)).median()
        assert off < 0.1
    again = projections.resistance_by_projections(nodes.repartition(3), edges.repartition(5), pairs, error=0.3).toPandas()
    order = ["graph_id", "i", "j"]
    assert np.allclose(got.sort_values(order)["r"], again.sort_values(order)["r"], rtol=1e-9)


def test_small_graphs_stay_exact_and_unknown_nodes_have_no_row(spark):
    nodes, edges = frames(spark, {"a": two_pieces(), "b": two_pieces(3, 30)})
    pairs = spark.createDataFrame([("a", 0, 1), ("a", 0, 1), ("a", 0, 999), ("b", 2, 9), ("c", 0, 1)], "graph_id string, i int, j int")
    got = {(r.graph_id, r.i, r.j): r for r in projections.effective_resistance(nodes, edges, pairs, dense=40, error=0.5).collect()}
    assert {k: r.exact for k, r in got.items()} == {("a", 0, 1): False, ("b", 2, 9): True}
    lp = linalg.Graph(*two_pieces(3, 30)).lp
    assert got["b", 2, 9].r == pytest.approx(lp[2, 2] + lp[9, 9] - 2 * lp[2, 9])


def test_empty_tables_and_wrong_errors(spark):
    nodes, edges = frames(spark, {"a": two_pieces()})
    pairs = spark.createDataFrame([("a", 0, 1)], "graph_id string, i int, j int")
    assert projections.effective_resistance(nodes.limit(0), edges.limit(0), pairs).count() == 0
    alone = projections.effective_resistance(nodes, edges.limit(0), pairs, dense=10).collect()
    assert [(r.r, r.exact) for r in alone] == [(0.0, False)]
    with pytest.raises(ValueError):
        projections.node_projections(nodes, edges, error=0.0)
