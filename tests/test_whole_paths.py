"""Paths of events are whole, and trees are solved without dense matrices."""

import duckdb
import numpy as np
import pytest

from ohmgraph.operators import linalg, rowstats
from ohmgraph.operators.linalg import Graph, Tree
from ohmgraph.queries import data, registry

from .conftest import plain


def random_tree(n, seed=0):
    rng = np.random.default_rng(seed)
    names = rng.permutation(n)
    u, v = names[[int(rng.integers(0, k)) for k in range(1, n)]], names[1:]
    return Graph(n, np.minimum(u, v), np.maximum(u, v), rng.uniform(0.1, 3, n - 1))


@pytest.mark.parametrize("n", [1, 2, 3, 8, 40])
def test_trees_equal_dense_algebra(n):
    g = random_tree(n, n)
    lp = np.linalg.pinv(g.laplacian())
    d = np.diagonal(lp)
    r = d[:, None] + d[None, :] - 2 * lp
    i, j = (x.ravel() for x in np.indices((n, n)))
    assert g.tree and np.allclose(g.lp, lp) and np.allclose(g.tree.rows(np.arange(n)[::-1]), r[::-1], atol=1e-9)
    assert np.allclose(g.tree.between(i, j), r.ravel(), atol=1e-9)
    assert np.allclose(g.tree.totals(), r.sum(1)) and np.allclose(g.tree.longest(), r.max(1), atol=1e-9)
    assert np.allclose(g.path_betweenness(), g.path_betweenness(range(n))) and g.kirchhoff() == pytest.approx(r.sum() / 2)
    assert np.allclose(g.tree.potentials(np.eye(n)), lp)
    dense = Graph(n, g.u, g.v, g.w, _lp=lp)
    dense.tree = None
    assert np.allclose([g.flow_betweenness(k, True) for k in range(n)], [dense.flow_betweenness(k, True) for k in range(n)])


def test_what_is_no_tree():
    assert Tree.of(4, np.array([0, 0, 1]), np.array([1, 2, 2]), np.ones(3)) is None  # a cycle and a node alone
    assert Tree.of(3, np.array([0]), np.array([1]), np.ones(1)) is None
    assert Tree.of(2, np.array([0]), np.array([1]), np.zeros(1)) is None


def test_second_vector_of_a_long_tree():
    g = random_tree(400, 3)
    want = np.linalg.eigh(g.laplacian())[1][:, 1]
    assert np.allclose(g.fiedler(want), want, atol=1e-7) and g._spectrum is None


def test_a_user_is_one_path(spark, tmp_path):
    spark.range(1400).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "id % 2 AS user_id", "CAST(id % 7 AS DOUBLE) AS value").write.parquet(f"{tmp_path}/events.parquet")
    paths = data.path_nodes(spark, str(tmp_path))
    assert sorted((r.graph_id, r["count"]) for r in paths.groupBy("graph_id").count().collect()) == [("0", 700), ("1", 700)]
    ends = rowstats.source_stats(paths, data.path_edges(paths)).where("i IN (0, 699)").collect()
    length = {k: sum(r.step for r in paths.where(f"graph_id = '{k}' AND node > 0").collect()) for k in "01"}
    assert len(ends) == 4 and all(2 * r.longest > 0 for r in ends)
    far = linalg.effective_resistance(paths, data.path_edges(paths), paths.where("node = 699").selectExpr("graph_id", "0 AS i", "node AS j")).collect()
    assert {r.graph_id: r.r for r in far} == pytest.approx(length)


def test_voltages_need_source_and_sinks(spark):
    n = spark.sql("SELECT g AS graph_id, explode(sequence(0, CASE g WHEN 'long' THEN 7 ELSE 3 END)) AS node FROM VALUES ('long'), ('short') t(g)")
    e = n.where("node > 0").selectExpr("graph_id", "node - 1 AS u", "node AS v", "1.0D AS weight")
    volts = {(r.graph_id, r.node): r.voltage for r in linalg.node_voltages(n, e, 0, [5]).collect()}
    assert {k for k, _ in volts} == {"long"} and volts["long", 0] - volts["long", 5] == pytest.approx(5)


PATHS = ["r3_r5_currents_and_power", "r9_shell_mean_resistance", "r10_r11_resistance_rows", "r12_r16_kirchhoff_and_commute", "l2_path_resistance", "l4_fiedler", "l6_current_flow_betweenness", "l7_betweenness_topk"]


@pytest.fixture(scope="module")
def long_paths(tmp_path_factory):
    """Users with 503 events, whose ids cross a multiple of 100,000, and one with 3 events."""
    folder = tmp_path_factory.mktemp("paths")
    events = """SELECT 99500 + i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i) AS ts, CASE WHEN i < 1006 THEN i % 2 ELSE 2 END AS user_id, (hash(i) % 100000) / 1000.0::DOUBLE AS value FROM range(1009) t(i)"""
    duckdb.connect().sql(f"COPY ({events}) TO '{folder}/events.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", PATHS)
def test_long_paths_equal_their_sql(spark, long_paths, name):
    df = registry.QUERIES[name](spark, long_paths)
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    con.sql(f"CREATE VIEW events AS FROM '{long_paths}/events.parquet'")
    rel = con.sql(f"SELECT {', '.join(df.columns)} FROM ({registry.ORACLES[name]})")
    key = lambda r: tuple(map(str, r))
    left, right = (sorted((tuple(map(plain, r)) for r in rows), key=key) for rows in (df.collect(), rel.fetchall()))
    assert left == right
    assert {r[df.columns.index("graph_id")] for r in left} == ({"0", "1"} if name == PATHS[0] else {"0", "1", "2"})
