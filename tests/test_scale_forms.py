"""Forms that never bring a whole group, matrix or list of groups to one task: against the plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ohmgraph.operators import contacts, folds, linalg, rowstats
from ohmgraph.operators import graphmetrics as G
from ohmgraph.plans import jobs
from ohmgraph.storage import fingerprint, reuse

from .test_linalg import random_graph


def greedy(sizes, k):
    load, out = [0] * k, []
    for s in sizes:
        at = load.index(min(load))
        load[at] += s
        out.append(at)
    return out, load


def test_dealing_runs_is_dealing_one_by_one():
    rng = np.random.default_rng(0)
    for _ in range(300):
        k = int(rng.integers(1, 7))
        sizes = sorted((int(x) for x in rng.integers(1, rng.integers(2, 40), rng.integers(1, 60))), reverse=True)
        want, load = greedy(sizes, k)
        loads, got = [0] * k, []
        for size in sorted(set(sizes), reverse=True):
            n = sizes.count(size)
            turns = folds.dealing(loads, size, n)
            for p in range(n):
                start, order = [t for t in turns if t[0] <= p][-1]
                got.append(order[(p - start) % len(order)])
        assert got == want and loads == load


@pytest.mark.parametrize("names", ["text", "number"])
def test_group_folds_equal_greedy_dealing(spark, names):
    rng = np.random.default_rng(4)
    sizes = {g: int(rng.integers(1, 9)) for g in range(70)} | {70: 90}
    name = (lambda g: f"p{g:03d}") if names == "text" else (lambda g: g * 40_000)
    rows = [(i, name(g)) for i, g in enumerate(g for g, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame(rows, f"mutation_id long, g {'string' if names == 'text' else 'long'}")
    order = sorted(sizes, key=lambda g: (-sizes[g], g))
    want = dict(zip(map(name, order), greedy([sizes[g] for g in order], 4)[0], strict=True))
    got = folds.group_folds(df, "g", 4).join(df, "mutation_id").collect()
    assert len(got) == len(rows) and all(r.fold == want[r.g] for r in got)
    logo = folds.leave_one_group_out(df, "g").join(df, "mutation_id").select("g", "fold").distinct().collect()
    assert sorted((r.g, r.fold) for r in logo) == [(name(g), i) for i, g in enumerate(sorted(sizes))]
    monkey = folds.RUNS
    try:
        folds.RUNS = 2  # sizes are joined, not broadcast
        assert sorted(folds.group_folds(df, "g", 4).collect()) == sorted((r.mutation_id, r.fold) for r in got)
    finally:
        folds.RUNS = monkey


@pytest.fixture(scope="module")
def graphs(spark):
    """Three graphs, one of a single node."""
    made = {f"g{s}": random_graph(n, s) for s, n in ((1, 20), (2, 33))}
    nodes = [(k, i * 3, 0.0) for k, g in made.items() for i in range(g.n)] + [("one", 7, 0.0)]
    edges = [(k, int(u) * 3, int(v) * 3, float(w)) for k, g in made.items() for u, v, w in zip(g.u, g.v, g.w, strict=True)]
    n = spark.createDataFrame(nodes, "graph_id string, node int, x double")
    return made, n, spark.createDataFrame(edges, "graph_id string, u int, v int, weight double")


def test_row_statistics_equal_those_of_pairs(graphs, monkeypatch):
    _, n, e = graphs
    monkeypatch.setattr(rowstats, "CHUNK", 7)
    r = linalg.effective_resistance(n, e)
    plain = {(x.graph_id, x.i): x for x in G.resistance_row_stats(r).join(G.resistance_centrality(r), ["graph_id", "i"]).collect()}
    got = rowstats.resistance_stats(n, e).collect()
    assert len(got) == len(plain) == 53
    for x in got:
        want = plain[x.graph_id, x.i]
        for c in ("harmonic_mean", "median", "skewness", "kurtosis", "centrality"):
            assert x[c] == pytest.approx(want[c], abs=1e-8), c
    s = rowstats.source_stats(n, e)
    far = {(x.graph_id, x.i): x.m for x in G.commute_time(r, e).groupBy("graph_id", "i").agg(F.max("commute_time").alias("m")).collect()}
    assert all(x.longest == pytest.approx(far[x.graph_id, x.i]) for x in s.where("graph_id <> 'one'").collect()) and s.count() == 54
    whole = {x.graph_id: x.kirchhoff for x in G.kirchhoff_index(r).collect()}
    assert all(x.k == pytest.approx(whole[x.graph_id]) for x in s.groupBy("graph_id").agg((F.sum("total_r") / 2).alias("k")).collect())
    rows = linalg.pinv_entries(n, e)
    plain = {(x.graph_id, x.i): (x.radius, x.anisotropy) for x in G.influence_radius(rows, 0.1).join(G.row_anisotropy(rows), ["graph_id", "i"]).collect()}
    for x in rowstats.inverse_stats(n, e, 0.1).collect():
        assert x.radius == plain[x.graph_id, x.i][0] and x.anisotropy == pytest.approx(plain[x.graph_id, x.i][1], abs=1e-9)


def test_terminals_and_betweenness_in_parts(spark, graphs, monkeypatch):
    made, n, e = graphs
    ends = [("g1", r, 3 * (r % 20), 1.0) for r in range(9)] + [("g1", r, 3 * ((r + 5) % 20), -1.0) for r in range(9)] + [("g2", 0, 0, 2.0), ("g2", 0, 96, -2.0), ("no", 0, 1, 1.0)]
    terminals = spark.createDataFrame(ends, "graph_id string, run int, node int, current double")
    monkeypatch.setattr(linalg, "RUNS", 4)
    got = {(r.graph_id, r.run, r.node): r.voltage for r in linalg.terminal_voltages(n, e, terminals).collect()}
    assert len(got) == 9 * 20 + 33
    for k, r in {(k, r) for k, r, _, _ in ends if k != "no"}:
        b = np.zeros(made[k].n)
        for _, _, node, c in (x for x in ends if x[:2] == (k, r)):
            b[node // 3] += c
        want = made[k].lp @ b
        assert all(got[k, r, 3 * i] == pytest.approx(want[i]) for i in range(made[k].n))
    monkeypatch.setattr(linalg, "SOURCES", 6)
    parts = {(r.graph_id, r.node): r.betweenness for r in linalg.path_betweenness(n, e).collect()}
    for k, g in made.items():
        assert [parts[k, 3 * i] for i in range(g.n)] == pytest.approx(g.path_betweenness().tolist())
    top = linalg.betweenness_topk(n, e, 3).collect()
    assert all([r.node for r in sorted(top, key=lambda r: r.rank) if r.graph_id == k] == [3 * int(i) for i in g.most_between(3)] for k, g in made.items())
    wild = {r.graph_id: r for r in linalg.wt_properties(n, e, 3).collect()}
    assert all(wild[k].active == g.most_between(3).tolist() for k, g in made.items()) and wild["one"].active == [0]


def test_stored_stages_know_their_inputs(spark, tmp_path):
    a = spark.createDataFrame([(1, 2.0), (2, None)], "id long, x double")
    key = lambda df, **s: fingerprint({"a": df}, s)
    assert key(a, cutoff=8.0) == key(a.orderBy(F.desc("id")).select("x", "id"), cutoff=8.0)
    assert len({key(a, cutoff=8.0), key(a, cutoff=6.0), key(a.unionByName(a), cutoff=8.0), key(a.limit(1), cutoff=8.0), key(a.withColumn("x", F.coalesce("x", F.lit(0.0))), cutoff=8.0)}) == 5
    made = []

    def build(n):
        return lambda: made.append(n) or spark.range(n)

    at = str(tmp_path / "stage")
    assert [reuse(spark, at, build(n), k).count() for n, k in ((3, "a"), (9, "a"), (4, "b"), (5, "b"), (6, "a"))] == [3, 3, 4, 4, 6]
    assert made == [3, 4, 6]


def test_a_changed_cutoff_gives_new_features(spark, tmp_path):
    rng = np.random.default_rng(2)
    xyz = np.cumsum(rng.normal(0, 2.4, (24, 3)), 0)
    atoms = spark.createDataFrame(
        [("1ABC", i, "ATOM", 1, "A", i + 1, "", "ALA", "CA", "", 1.0, *map(float, p)) for i, p in enumerate(xyz)],
        "pdb_id string, line_no long, record string, model int, chain string, resseq int, icode string, resname string, atom string, altloc string, occupancy double, x double, y double, z double",
    )
    muts = spark.createDataFrame([(i, "1ABC", "A", i + 2, "A", "V", 0.5) for i in range(3)], "mutation_id long, pdb_id string, chain string, position int, wild_type string, mutation string, ddG double")
    at = str(tmp_path / "features")
    wide = {r.mutation_id: r.conductance_degree_wt for r in jobs.stored_features(at, muts, atoms, cutoff=8.0).collect()}
    near = {r.mutation_id: r.conductance_degree_wt for r in jobs.stored_features(at, muts, atoms, cutoff=5.0).collect()}
    assert set(wide) == set(near) == {0, 1, 2} and all(near[i] <= wide[i] for i in wide) and near != wide


def test_scales_and_kinds_share_one_search(spark, monkeypatch):
    calls = []
    search = contacts.contact_pairs
    monkeypatch.setattr(contacts, "contact_pairs", lambda n, c=8.0: calls.append(c) or search(n, c))
    rng = np.random.default_rng(1)
    nodes = spark.createDataFrame([(f"g{k}", i, "A", i, "ACDEFGHIKLMNPQRSTVWY"[i % 20], *map(float, p)) for k in range(2) for i, p in enumerate(np.cumsum(rng.normal(0, 2.4, (15, 3)), 0))], "graph_id string, node int, chain string, resseq int, aa1 string, x double, y double, z double")
    muts = spark.createDataFrame([(i, f"g{i % 2}", "A", i % 15, "A", "V", float(i)) for i in range(12)], "mutation_id long, graph_id string, chain string, position int, wild_type string, mutation string, ddG double")
    both = jobs.multi_scale(muts, nodes, (8.0, 6.0))
    assert calls == [8.0] and both.count() == 12
    alone = {r.mutation_id: r.norton_current_wt for r in jobs.features_of_graphs(muts, nodes, cutoff=6.0).collect()}
    assert all(r.norton_current_wt_6A == pytest.approx(alone[r.mutation_id]) for r in both.collect())
    calls.clear()
    assert jobs.conductance_sensitivity(muts, nodes, cols=["norton_current_wt", "conductance_degree_wt"]).count() == 3 and calls == [8.0]


def test_current_flow_in_parts(graphs, monkeypatch):
    made, n, e = graphs
    monkeypatch.setattr(linalg, "FLOWS", 5)
    got = {(r.graph_id, r.node): r.betweenness for r in linalg.current_flow_betweenness(n, e).collect()}
    assert len(got) == 54 and got["one", 7] == 0
    for k, g in made.items():
        assert g.pieces() == g.null_modes()
        assert [got[k, 3 * i] for i in range(g.n)] == pytest.approx([g.flow_betweenness(i, g.null_modes() == 1) for i in range(g.n)])
    split = linalg.Graph(7, np.array([0, 1, 3, 4]), np.array([1, 2, 4, 5]), np.array([1.0, 3.0, 2.0, 0.1]))
    assert split.pieces() == split.null_modes() == 3


def test_restarts_of_kmeans_go_together(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 0.4, (40, 3)) for m in (0.0, 3.0, (5.0, -4.0, 1.0), -6.0)])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], ["mutation_id", *folds.SPECTRAL])
    z = (x - x.mean(0)) / x.std(0)
    got = {r.mutation_id: r.stratum for r in folds.spectral_strata(df, 4).collect()}
    want = np.repeat(range(4), 40)
    pairs = {(got[i], int(want[i])) for i in range(len(x))}
    assert len(got) == 160 and len(pairs) == 4  # the clusters, by other numbers
    passes = []
    monkeypatch.setattr(folds, "nearest", lambda zs, c, f=folds.nearest: passes.append(1) or f(zs, c))
    cols = [f"_z{c}" for c in folds.SPECTRAL]
    rows = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(z)], ["mutation_id", *cols])

    def plain(start):
        c = np.array(start)
        for _ in range(100):
            at = ((z[:, None] - c) ** 2).sum(-1).argmin(1)
            new = np.array([z[at == j].mean(0) if (at == j).any() else c[j] for j in range(len(c))])
            if np.abs(new - c).max() < 1e-9:
                break
            c = new
        return c, ((z[:, None] - c) ** 2).sum(-1).min(1).sum()

    from ohmgraph.operators.sampling import shuffle_key

    starts = [[[r[c] for c in cols] for r in rows.orderBy(shuffle_key("mutation_id", 7 + i), "mutation_id").limit(4).collect()] for i in range(6)]
    best = min((plain(s) for s in starts), key=lambda r: r[1])[0]
    assert np.allclose(folds.kmeans(rows, cols, 4, 6, 7), best, atol=1e-8)
    one = spark.createDataFrame([(i, 1.0, 1.0, 1.0) for i in range(6)], ["mutation_id", *folds.SPECTRAL])
    assert {r.stratum for r in folds.spectral_strata(one, 3).collect()} == {0}
    assert folds.spectral_folds(df.limit(0), 3).count() == 0
