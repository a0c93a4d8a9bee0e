"""Invariants of resistor networks, in numpy."""

import math

import numpy as np
import pytest

from ohmgraph.operators import features as f
from ohmgraph.operators.linalg import Graph
from ohmgraph.operators.models import correlation_p, incomplete_beta, ridge_from_gram, scores_from_gram
from ohmgraph.schema import FEATURE_GROUPS, FEATURES


def path(n=5):
    return Graph(n, np.arange(n - 1), np.arange(1, n), np.ones(n - 1))


def random_graph(n=20, seed=0):
    rng = np.random.default_rng(seed)
    u, v = np.nonzero(np.triu(rng.random((n, n)) < 0.3, 1) | np.eye(n, k=1, dtype=bool))
    return Graph(n, u, v, rng.uniform(0.5, 2, len(u)))


def test_path_resistances_are_lengths():
    g = path()
    assert np.allclose(g.resistances(), np.abs(np.subtract.outer(np.arange(5), np.arange(5))))
    assert np.allclose(g.lp, np.linalg.pinv(g.laplacian()))
    assert np.argmax([f.over(4, g.resistance_row(k).sum()) for k in range(5)]) == 2


def test_star_and_complete_graphs():
    star = Graph(5, np.zeros(4, int), np.arange(1, 5), np.array([1.0, 2, 4, 5]))
    assert star.resistances()[1, 2] == pytest.approx(1.5)
    assert star.flow_betweenness(0, True) == pytest.approx(1)
    assert star.flow_betweenness(1, True) == pytest.approx(0)
    u, v = np.triu_indices(6, 1)
    full = Graph(6, u, v, np.ones(15))
    assert np.allclose(full.resistances()[u, v], 2 / 6)


def test_foster_and_kirchhoff():
    g = random_graph()
    r = g.resistances()
    assert (g.w * r[g.u, g.v]).sum() == pytest.approx(g.n - 1)
    assert g.kirchhoff() == pytest.approx(r.sum() / 2)
    split = Graph(6, np.array([0, 1, 3]), np.array([1, 2, 4]), np.ones(3))
    assert split.null_modes() == 3
    assert np.isfinite(split.resistances()).all()


def test_voltages_obey_kirchhoffs_law():
    g = random_graph(seed=2)
    volts = g.voltages(3, np.array([7, 11]))
    net = g.laplacian() @ volts
    assert net[3] == pytest.approx(1) and net[7] == pytest.approx(-0.5) and abs(np.delete(net, [3, 7, 11])).max() < 1e-9


def test_fiedler_vector():
    x = random_graph(seed=1).fiedler()
    assert abs(x.sum()) < 1e-9 and x[np.abs(x).argmax()] > 0


def test_low_rank_update_is_a_full_inverse():
    g = random_graph(seed=3)
    for k, factor in ((0, 0.3), (5, 2.2), (9, 1.0)):
        assert np.allclose(g.changed_inverse(k, factor), np.linalg.pinv(g.changed(k, factor).laplacian()), atol=1e-12)


def test_path_betweenness_counts_pairs():
    assert path(6).path_betweenness().tolist() == [0, 8, 12, 12, 8, 0]
    assert path(6).most_between(3).tolist() == [2, 3, 1]


def test_betweenness_equals_counting_shortest_paths():
    g = random_graph(12, 4)
    g.w = np.random.default_rng(1).integers(1, 4, len(g.u)).astype(float)  # with ties
    near = np.full((12, 12), np.inf)
    near[g.u, g.v] = near[g.v, g.u] = g.w
    dist = near.copy()
    np.fill_diagonal(dist, 0)
    for k in range(12):
        dist = np.minimum(dist, dist[:, [k]] + dist[[k]])
    ways = lambda s, t: 1 if s == t else sum(ways(s, v) for v in range(12) if np.isfinite(near[v, t]) and dist[s, v] + near[v, t] == dist[s, t])
    count = np.array([[ways(s, t) for t in range(12)] for s in range(12)])
    want = [sum(count[s, k] * count[k, t] / count[s, t] for s in range(12) for t in range(12) if len({s, t, k}) == 3 and dist[s, k] + dist[k, t] == dist[s, t]) for k in range(12)]
    assert np.allclose(g.path_betweenness(), want)


def test_changed_graphs_agree_with_full_solutions():
    for seed in range(4):
        g = random_graph(25, seed)
        wild = g.fiedler()
        g._fiedler = wild
        for k, factor in ((0, 0.3), (7, 2.5), (24, 1.001)):
            fast, full = g.changed(k, factor), Graph(g.n, g.u, g.v, g.changed(k, factor).w)
            assert np.allclose(fast.lp, full.lp, atol=1e-10) and np.allclose(fast.eigs, full.eigs, atol=1e-10)
            assert np.allclose(fast.fiedler(wild), full.fiedler(wild), atol=1e-7)


def test_identity_change_changes_nothing():
    g = random_graph()
    out = dict(zip(FEATURES, f.all_features(g, True, f.site_of(g, True, g.most_between(), g.fiedler(), 5), 1.0), strict=True))
    assert all(abs(v) < 1e-8 for k, v in out.items() if k.startswith("delta_") or k.endswith("fold_change"))


def test_features_of_a_change():
    g = path()
    out = dict(zip(FEATURES, f.all_features(g, True, f.site_of(g, True, np.array([0, 4]), g.fiedler(), 2), 1.7), strict=True))
    assert out["conductance_degree_wt"] == 2 and out["conductance_degree_fold_change"] == pytest.approx(math.log2(1.7))
    assert out["delta_R_max"] >= abs(out["delta_R_global_mean"]) and all(map(math.isfinite, out.values()))
    assert sum(map(len, FEATURE_GROUPS.values())) == len(set(FEATURES)) == 83


def test_p_values_and_incomplete_beta():
    assert incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)
    assert correlation_p(0.5, 20) == pytest.approx(0.02477, abs=1e-4) and correlation_p(0.3, 2) == 1.0 and correlation_p(1.0, 9) == 0.0


def test_ridge_from_sums_equals_a_direct_fit():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 3))
    y = x @ [2, -1.5, 0.5] + rng.normal(0, 0.5, 50)
    a = np.column_stack([np.ones(50), x, y])
    coef, bias = ridge_from_gram(a.T @ a, 1.0)
    z = (x - x.mean(0)) / x.std(0)
    direct = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean())) / x.std(0)
    assert np.allclose(coef, direct)
    r2, mse = scores_from_gram(a.T @ a, coef, bias)
    err = y - x @ coef - bias
    assert mse == pytest.approx((err**2).mean()) and r2 == pytest.approx(1 - (err**2).sum() / ((y - y.mean()) ** 2).sum())
