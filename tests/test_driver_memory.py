"""Tables that grow with the rows never pass through the driver."""

import numpy as np
import pytest

from ohmgraph.operators import graphmetrics, linalg
from ohmgraph.queries import registry

from .conftest import DATA
from .test_many_graphs import random_graph


def test_graphs_meet_their_active_nodes_without_a_broadcast(spark):
    n = spark.sql("SELECT CAST(id % 9 AS STRING) AS graph_id, CAST(id DIV 9 AS INT) AS node FROM range(90)")
    e = n.where("node > 0").selectExpr("graph_id", "node - 1 AS u", "node AS v", "1.0D AS weight")
    wild = linalg.wt_properties(n, e, 3)
    plan = wild._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.index("MapInPandas") < plan.index("SortMergeJoin")  # the rows of n x n values are made above the join
    assert [(r.n, r.active, len(r.lp)) for r in wild.collect()] == [(10, [4, 5, 3], 800)] * 9


@pytest.mark.parametrize("cells", [1_000_000, 40])
def test_mean_resistances_of_rings_equal_dense_algebra(spark, monkeypatch, cells):
    """A graph with cycles, one in pieces, a tree, and one without a name; parts of rings that hold few sites."""
    monkeypatch.setattr(graphmetrics, "CELLS", cells)
    graphs = {"dense": random_graph(20, 0.3, 1), "pieces": random_graph(20, 0.06, 2), "tree": linalg.Graph(5, np.array([0, 1, 1, 3]), np.array([1, 2, 3, 4]), np.array([1.0, 2.0, 0.5, 4.0]))}
    nodes = [(k, 3 * i) for k, g in graphs.items() for i in range(g.n)] + [(None, 0), (None, 3), ("alone", 7)]
    edges = [(k, 3 * int(u), 3 * int(v), float(w)) for k, g in graphs.items() for u, v, w in zip(g.u, g.v, g.w, strict=True)] + [(None, 0, 3, 1.0)]
    n, e = spark.createDataFrame(nodes, "graph_id string, node int"), spark.createDataFrame(edges, "graph_id string, u int, v int, weight double")
    want = {}
    for k, g in graphs.items():
        far = np.where(np.eye(g.n, dtype=bool), 0.0, np.inf)
        far[g.u, g.v] = far[g.v, g.u] = 1.0
        for m in range(g.n):
            far = np.minimum(far, far[:, [m]] + far[[m]])
        lp = np.linalg.pinv(g.laplacian())
        r = np.diagonal(lp)[:, None] + np.diagonal(lp)[None, :] - 2 * lp
        want |= {(k, 3 * i, hop): r[i, far[i] == hop].mean() for i in range(g.n) for hop in (1, 2, 3) if (far[i] == hop).any()}
    got = {(r.graph_id, r.site, r.hop): r.mean_r for r in graphmetrics.shell_mean_resistance(n, e, 3).collect()}
    assert got == pytest.approx(want)


def test_rings_meet_their_resistances_without_a_join(spark):
    plan = registry.QUERIES["r9_shell_mean_resistance"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
