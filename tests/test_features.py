"""All 83 features against their definitions in plain numpy, and the whole job from structure text."""

import math

import numpy as np
import pytest

from ohmgraph.operators import features as f
from ohmgraph.operators.linalg import Graph
from ohmgraph.plans import jobs
from ohmgraph.schema import FEATURES

from .test_linalg import path, random_graph

EPS, TINY = 1e-12, 1e-15


def entropy(x):
    p = np.abs(x) / max(np.abs(x).sum(), TINY)
    return -sum(q * math.log(q) for q in p if q > TINY)


def share_squares(x):
    s = np.abs(x).sum()
    return float(((np.abs(x) / s) ** 2).sum()) if s > TINY else 0.0


def betweenness(u, v, w, n, lp, k):
    """Share of the unit currents between all pairs of other nodes that passes k, pair by pair."""
    total = 0.0
    for s in range(n):
        for t in range(s):
            if k not in (s, t):
                volts = lp[:, s] - lp[:, t]
                total += 0.5 * sum(c * abs(volts[a] - volts[b]) for a, b, c in zip(u, v, w, strict=True) if k in (a, b))
    return total / ((n - 1) * (n - 2) / 2)


def side(u, v, w, n, k, active, like):
    """What one graph, wild or mutant, gives: names of its own."""
    lap = np.zeros((n, n))
    for a, b, c in zip(u, v, w, strict=True):
        lap[a, a] += c
        lap[b, b] += c
        lap[a, b] -= c
        lap[b, a] -= c
    lp = np.linalg.pinv(lap, rcond=1e-10, hermitian=True)
    values, vectors = np.linalg.eigh(lap)
    modes = [x for x in values if x > 1e-10]
    r = np.array([max(lp[k, k] + lp[j, j] - 2 * lp[k, j], 0) for j in range(n)])
    active = [a for a in active if a != k]
    sinks = active or [j for j in range(n) if j != k]
    volts = lp[:, k] - np.mean([lp[:, s] for s in sinks], axis=0)
    current = np.array([c * (volts[a] - volts[b]) for a, b, c in zip(u, v, w, strict=True)])
    power = np.array([c * (volts[a] - volts[b]) ** 2 for a, b, c in zip(u, v, w, strict=True)])
    at = np.array([k in (a, b) for a, b in zip(u, v, strict=True)])
    near = {j: {b if a == j else a for a, b in zip(u, v, strict=True) if j in (a, b)} for j in range(n)}
    seen, ring, shells = {k}, {k}, []
    for _ in range(3):
        ring = set().union(*(near[j] for j in ring)) - seen if ring else set()
        seen |= ring
        shells.append(float(np.mean([r[j] for j in ring])) if ring else 0.0)
    other = np.array([r[j] for j in range(n) if j != k])
    d = other - other.mean()
    var = (d**2).mean()
    fiedler = vectors[:, 1] * (1 if like is None or vectors[:, 1] @ like >= 0 else -1)
    lam = lambda j: modes[j - 1] if len(modes) >= j else 0.0
    ratio = lambda a, b, eps=TINY: a / b if abs(b) > eps else 0.0
    own = np.abs(current[at])
    connected = len(modes) == n - 1
    return {
        "r": r, "ecc": r.max(), "kf": n * np.trace(lp), "lam2": lam(2), "gap": ratio(lam(2), lam(3), EPS),
        "flow": betweenness(u, v, w, n, lp, k) if connected and n > 2 else 0.0, "close": (n - 1) / r.sum(), "self": lp[k, k],
        "transfer": np.mean([lp[k, a] for a in active]) if active else 0.0, "fiedler": fiedler[k], "vector": fiedler, "degree": sum(c for c, x in zip(w, at, strict=True) if x),
        "r_sinks": np.mean([r[s] for s in sinks]), "current": current, "power": power, "top": np.abs(current).max(), "i_entropy": entropy(current),
        "i_site": ratio(own.sum(), np.abs(current).sum()), "i_focus": share_squares(own), "uneven": own.max() / max(own.min(), TINY) if len(own) >= 2 else 1.0,
        "gain": ratio(np.mean([lp[s, k] for s in sinks]), lp[k, k]), "mutual": ratio(np.mean([lp[k, s] for s in sinks]), math.sqrt(abs(lp[k, k] * np.mean([lp[s, s] for s in sinks])))),
        "radius": sum(abs(lp[j, k]) > 0.1 * abs(lp[k, k]) for j in range(n) if j != k), "p_site": ratio(power[at].sum(), power.sum()), "p_entropy": entropy(power),
        "shells": shells, "shell_ratio": ratio(shells[1], shells[0]), "slope": (shells[1] - shells[0]) / max(shells[0], EPS), "trace": np.trace(lp),
        "row_entropy": entropy(lp[k]), "aniso": np.abs(lp[k]).std() / np.abs(lp[k]).mean(), "lam_max": values[-1], "mode_entropy": entropy(np.array(modes)),
        "harmonic": (other > TINY).sum() / sum(1 / x for x in other if x > TINY) if (other > TINY).any() else 0.0, "median": np.median(other),
        "skew": (d**3).mean() / var**1.5 if len(other) >= 3 and var > 1e-30 else 0.0, "kurt": (d**4).mean() / var**2 - 3 if len(other) >= 3 and var > 1e-30 else 0.0, "sinks": sinks, "active": active, "w": w,
    }


def by_definition(g, active, fiedler, k, factor):
    n, u, v = g.n, g.u.tolist(), g.v.tolist()
    w = side(u, v, g.w.tolist(), n, k, active, fiedler)
    m = side(u, v, [c * factor if k in (a, b) else c for a, b, c in zip(u, v, g.w.tolist(), strict=True)], n, k, active, w["vector"])
    dr, change = m["r"] - w["r"], lambda x: m[x] - w[x]
    log = lambda x: math.log2(max(abs(m[x]), EPS) / max(abs(w[x]), EPS))
    out = {
        "delta_R_active_site": dr[w["active"]].mean() if w["active"] else 0.0, "delta_R_global_mean": dr.mean(), "delta_R_max": abs(dr).max(), "delta_R_std": dr.std(),
        "R_eccentricity_wt": w["ecc"], "delta_R_eccentricity": change("ecc"), "delta_kirchhoff": change("kf"), "propagation_radius": (abs(dr) > 0.01).sum(),
        "delta_algebraic_connectivity": change("lam2"), "spectral_gap_ratio": w["gap"], "current_redistribution": np.linalg.norm(m["current"] - w["current"]) / np.linalg.norm(w["current"]),
        "conductance_degree_wt": w["degree"], "neighbor_current_asymmetry_wt": w["uneven"], "voltage_influence_radius_wt": w["radius"], "max_power_edge_wt": w["power"].max(),
        "R_shell_1_mean_wt": w["shells"][0], "R_shell_2_mean_wt": w["shells"][1], "R_shell_3_mean_wt": w["shells"][2], "delta_R_shell_ratio": change("shell_ratio"),
        "commute_time_to_active_wt": 2 * sum(w["w"]) * w["r_sinks"], "effective_path_count_wt": 1 / share_squares(w["current"]), "green_trace_fraction_wt": w["self"] / w["trace"],
        "R_active_site_wt": w["r_sinks"], "norton_current_wt": w["self"] / w["r_sinks"], "spectral_radius_ratio_wt": w["lam_max"] / w["lam2"], "effective_graph_resistance_wt": w["kf"] / (n * (n - 1) / 2),
        "R_active_fold_change": log("r_sinks"), "kirchhoff_fold_change": log("kf"), "conductance_degree_fold_change": log("degree"),
        "R_global_fold_change": math.log2(m["r"].mean() / w["r"].mean()), "voltage_fold_change": log("self"), "R_local_global_ratio_wt": w["shells"][0] / w["r"].mean(),
        "conductance_R_active_product": w["degree"] * w["r_sinks"], "fiedler_squared_wt": w["fiedler"] ** 2, "current_R_product_wt": w["top"] * w["r_sinks"],
        "voltage_conductance_product_wt": w["self"] * w["degree"], "power_deltaR_product": w["p_site"] * (dr[w["active"]].mean() if w["active"] else 0.0),
        "effective_conductance_to_active_wt": 1 / w["r_sinks"], "delta_effective_conductance_to_active": 1 / m["r_sinks"] - 1 / w["r_sinks"],
    }
    pairs = {
        "current_flow_betweenness": "flow", "resistance_centrality": "close", "voltage": "self", "transfer_voltage_active": "transfer", "fiedler_component": "fiedler", "max_edge_current": "top",
        "current_entropy": "i_entropy", "site_current_fraction": "i_site", "current_concentration": "i_focus", "voltage_transfer_ratio": "gain", "mutual_conductance": "mutual", "power_local_fraction": "p_site",
        "power_entropy": "p_entropy", "green_row_entropy": "row_entropy", "green_anisotropy": "aniso", "circuit_gain": "gain", "eigenvalue_entropy": "mode_entropy", "R_harmonic_mean": "harmonic",
        "R_median": "median", "R_skewness": "skew", "R_kurtosis": "kurt", "shell_gradient": "slope",
    }
    for name, x in pairs.items():
        out |= {f"{name}_wt": w[x], f"delta_{name}": change(x)}
    return out


SPLIT = Graph(7, np.array([0, 1, 0, 4, 5]), np.array([1, 2, 3, 5, 6]), np.array([1.0, 0.5, 2.0, 1.0, 3.0]))


@pytest.mark.parametrize("g", [path(7), random_graph(20, 5), random_graph(9, 2), SPLIT], ids=["path", "weighted", "small", "two parts"])
def test_all_features_by_definition(g):
    connected = g.null_modes() == 1
    fiedler = g.fiedler()
    for active in (g.most_between(), np.array([0, 3]), np.array([], int)):
        for k in (0, 2, 3, g.n - 1):
            site = f.site_of(g, connected, active, fiedler, k)
            for factor in (0.4, 1.6):
                got, want = dict(zip(FEATURES, f.all_features(g, connected, site, factor), strict=True)), by_definition(g, active, fiedler, k, factor)
                assert set(want) == set(FEATURES)
                for name in FEATURES:
                    if connected or "fiedler" not in name:  # with two parts the second mode is any of a plane
                        assert got[name] == pytest.approx(want[name], rel=1e-6, abs=1e-7), (name, k, factor, active)


def test_derived_features_equal_the_helper(spark):
    g, rows = random_graph(20, 5), []
    site = f.site_of(g, True, np.array([0, 3]), g.fiedler(), 5)
    for factor in (0.4, 1.7):
        rows.append((factor, g.n, *f.all_features(g, True, site, factor)))
    df = spark.createDataFrame(rows, "factor double, n int, " + ", ".join(f"{x} double" for x in FEATURES))
    made = f.derived_features(df.withColumnsRenamed({x: x for x in FEATURES})).collect()
    for r, given in zip(sorted(made, key=lambda r: r.factor), rows, strict=True):
        want = dict(zip(FEATURES, given[2:], strict=True))
        for name in [x for x in FEATURES if x.endswith(("fold_change", "product", "product_wt", "squared_wt"))]:
            assert r[name] == pytest.approx(want[name], rel=1e-6, abs=1e-9), name


def pdb_text(chains):
    rng, lines, serial = np.random.default_rng(7), [], 1
    for chain, n in chains.items():
        at = np.zeros(3)
        for i in range(n):
            at = at + rng.normal(0, 1.6, 3) + (1.5, 0, 0)
            lines.append(f"ATOM  {serial:5d}  CA  ALA {chain}{i + 1:4d}    {at[0]:8.3f}{at[1]:8.3f}{at[2]:8.3f}  1.00 20.00           C")
            serial += 1
    return "\n".join([*lines, "END"]) + "\n"


def test_feature_matrix_from_structures_of_two_chains(spark, tmp_path):
    from pyspark.sql import functions as F

    from ohmgraph.operators.linalg import from_rows
    from ohmgraph.sources.structures import read_structures

    (tmp_path / "1abc.pdb").write_text(pdb_text({"A": 24, "B": 18}))
    atoms = read_structures(spark, str(tmp_path / "*.pdb"))
    rows = [(1, "1ABC", "A", 5, "A", "W", 1.0), (2, "1ABC", "B", 5, "A", "D", -0.5), (3, "1ABC", None, 9, "A", "G", 0.1), (4, "1ABC", "B", 22, "A", "G", 0.1), (5, "1ABC", "C", 5, "A", "G", 0.1), (6, "9XYZ", "A", 5, "A", "G", 0.1), (7, "1ABC", "A", 6, "A", "K", None)]
    pdb = atoms.first().pdb_id
    rows = [(i, pdb if p == "1ABC" else p, *x) for i, p, *x in rows]
    m = spark.createDataFrame(rows, "mutation_id long, pdb_id string, chain string, position int, wild_type string, mutation string, ddG double")
    active = spark.createDataFrame([(pdb, "B", "3, 11")], "pdb_id string, chain string, sites string")
    made, rejects = jobs.build_feature_matrix(m, atoms, active=active)
    assert {r.mutation_id: r.reason for r in rejects.collect()} == {4: "residue_not_found", 5: "no_structure", 6: "no_structure", 7: "bad_value"}
    got = {r.mutation_id: r for r in made.collect()}
    assert set(got) == {1, 2, 3} and got[1].graph_id == got[3].graph_id == f"{pdb}:A" and got[2].graph_id == f"{pdb}:B"
    # by hand: one chain's contacts alone
    factor = {r.mutation_id: r.f for r in m.select("mutation_id", jobs.mutate.perturbation_factor(F.col("wild_type"), F.col("mutation")).alias("f")).collect()}
    for i, chain, site in ((1, "A", 4), (2, "B", 4), (3, "A", 8)):
        ca = atoms.where(F.col("chain") == chain).orderBy("line_no").select("x", "y", "z").toPandas().to_numpy()
        far = np.linalg.norm(ca[:, None] - ca[None], axis=2)
        u, v = np.nonzero(np.triu(far < 8, 1))
        g = Graph(len(ca), u, v, np.exp(-far[u, v] / 5))
        sites = np.array([2, 10]) if chain == "B" else g.most_between()
        want = by_definition(g, sites, g.fiedler(), site, factor[i])
        for name in FEATURES:
            assert got[i][name] == pytest.approx(want[name], rel=1e-5, abs=1e-6), (name, i)
