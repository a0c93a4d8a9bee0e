"""The circuit features of a mutation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import perturbation_factor, ratio, scale
from ..schema import FEATURES
from ..storage import saved
from .linalg import Graph

TINY, EPS = 1e-15, 1e-12


def share_entropy(x: np.ndarray) -> float:
    x = np.abs(x)
    s = x.sum()
    if s < TINY:
        return 0.0
    p = x / s
    p = p[p > TINY]
    return float(-(p * np.log(p)).sum())


def concentration(x: np.ndarray) -> float:
    x = np.abs(x)
    s = x.sum()
    return float((x * x).sum() / (s * s)) if s >= TINY else 0.0


def over(a: float, b: float, eps: float = TINY) -> float:
    return float(a / b) if abs(b) > eps else 0.0


def log_ratio(a: float, b: float) -> float:
    return float(np.log2(max(a, EPS) / max(b, EPS)))


def nth(eigs: np.ndarray, k: int) -> float:
    """The k-th smallest eigenvalue above 1e-10, from 1; 0 if there are fewer."""
    above = eigs[eigs > 1e-10]
    return float(above[k - 1]) if len(above) >= k else 0.0


def moments(x: np.ndarray) -> tuple[float, float]:
    """Biased skewness and excess kurtosis; 0 for under three values or none that differ."""
    d = x - x.mean() if len(x) else x
    v = float((d * d).mean()) if len(x) >= 3 else 0.0
    return (float((d**3).mean() / v**1.5), float((d**4).mean() / v**2 - 3)) if v > 1e-30 else (0.0, 0.0)


class State:
    """What the features ask of one graph, wild or mutant, about one site."""

    def __init__(self, g: Graph, k: int, sinks: np.ndarray, active: np.ndarray, rings: list[np.ndarray], connected: bool, like: np.ndarray | None):
        lp = g.lp
        self.r = r = g.resistance_row(k)
        other = np.delete(r, k)
        above = other[other > TINY]
        volts = g.voltages(k, sinks)
        drop = volts[g.u] - volts[g.v]
        self.current, self.power = g.w * drop, g.w * drop * drop
        here = (g.u == k) | (g.v == k)
        site, own = np.abs(self.current[here]), lp[k, k]
        self.eccentricity, self.kf = float(r.max()), g.kirchhoff()
        self.connectivity = nth(g.eigs, 2)
        self.flow = g.flow_betweenness(k, connected)
        self.centrality = over(g.n - 1, r.sum(), 0.0)
        self.voltage = float(own)
        self.transfer = float(lp[k, active].mean()) if len(active) else 0.0
        self.fiedler_vector = g.fiedler(like)
        self.fiedler = float(self.fiedler_vector[k])
        self.degree = float(g.w[here].sum())
        self.r_active = float(r[sinks].mean()) if len(sinks) else 0.0
        self.to_active = over(1.0, self.r_active)
        self.max_current = float(np.abs(self.current).max(initial=0.0))
        self.current_entropy = share_entropy(self.current)
        self.site_share = over(site.sum(), np.abs(self.current).sum())
        self.site_concentration = concentration(site)
        self.asymmetry = float(site.max() / max(site.min(), TINY)) if len(site) >= 2 else 1.0
        self.gain = over(lp[sinks, k].mean() if len(sinks) else 0.0, own)
        both = abs(own * np.diagonal(lp)[sinks].mean()) if len(sinks) else 0.0
        self.mutual = over(lp[k, sinks].mean() if len(sinks) else 0.0, np.sqrt(both))
        self.radius = float((np.abs(lp[:, k]) > 0.1 * abs(own)).sum() - 1) if abs(own) >= TINY else 0.0
        self.power_share = over(self.power[here].sum(), self.power.sum())
        self.power_entropy = share_entropy(self.power)
        self.ring = [float(r[x].mean()) if len(x) else 0.0 for x in rings]
        self.ring_ratio = over(self.ring[1], self.ring[0])
        self.gradient = (self.ring[1] - self.ring[0]) / max(self.ring[0], EPS)
        self.row_entropy = share_entropy(lp[k])
        row = np.abs(lp[k])
        self.anisotropy = over(row.std(), row.mean())
        self.eigen_entropy = share_entropy(g.eigs[g.eigs > 1e-10])
        self.harmonic = float(len(above) / (1 / above).sum()) if len(above) else 0.0
        self.median = float(np.median(other)) if len(other) else 0.0
        self.skewness, self.kurtosis = moments(other)
        self.mean = float(r.mean())


def rings_around(g: Graph, k: int, hops: int = 3) -> list[np.ndarray]:
    near = np.zeros((g.n, g.n), bool)
    near[g.u, g.v] = near[g.v, g.u] = True
    seen = np.zeros(g.n, bool)
    seen[k] = True
    last, out = seen.copy(), []
    for _ in range(hops):
        last = near[last].any(0) & ~seen
        seen |= last
        out.append(np.flatnonzero(last))
    return out


@dataclass
class Site:
    """What all changes at one site share."""

    k: int
    active: np.ndarray
    sinks: np.ndarray
    rings: list[np.ndarray]
    wild: State


def site_of(g: Graph, connected: bool, active: np.ndarray, fiedler: np.ndarray, k: int) -> Site:
    active = active[active != k]
    sinks = active if len(active) else np.delete(np.arange(g.n), k)
    rings = rings_around(g, k)
    return Site(k, active, sinks, rings, State(g, k, sinks, active, rings, connected, fiedler))


def all_features(g: Graph, connected: bool, site: Site, factor: float) -> list[float]:
    """The features of a change by a factor at a site, in the order of FEATURES."""
    k, active, sinks, rings, w = site.k, site.active, site.sinks, site.rings, site.wild
    m = State(g.changed(k, factor), k, sinks, active, rings, connected, w.fiedler_vector)
    dr, n = m.r - w.r, g.n
    d = lambda name: getattr(m, name) - getattr(w, name)
    pair = lambda name: (getattr(w, name), d(name))
    # fmt: off
    out = [
        float(dr[active].mean()) if len(active) else 0.0, dr.mean(), np.abs(dr).max(), dr.std(), w.eccentricity, d("eccentricity"),
        d("kf"), (np.abs(dr) > 0.01).sum(), d("connectivity"), over(nth(g.eigs, 2), nth(g.eigs, 3), EPS),
        *pair("flow"), *pair("centrality"),
        *pair("voltage"), *pair("transfer"),
        *pair("fiedler"), w.degree,
        *pair("to_active"), *pair("max_current"), *pair("current_entropy"), *pair("site_share"),
        over(np.linalg.norm(m.current - w.current), np.linalg.norm(w.current)), *pair("site_concentration"), w.asymmetry,
        *pair("gain"), *pair("mutual"), w.radius,
        *pair("power_share"), *pair("power_entropy"), w.power.max(initial=0.0),
        w.ring[0], w.ring[1], d("ring_ratio"), 2 * g.w.sum() * w.r_active, over(1.0, concentration(w.current)) or float(len(g.w)),
        over(w.voltage, np.trace(g.lp)), *pair("row_entropy"), *pair("anisotropy"),
        w.r_active, *pair("gain"), over(w.voltage, w.r_active),
        over(g.eigs[-1], nth(g.eigs, 2)), *pair("eigen_entropy"), over(w.kf, n * (n - 1) / 2),
        *pair("harmonic"), *pair("median"), *pair("skewness"), *pair("kurtosis"),
        log_ratio(m.r_active, w.r_active), log_ratio(m.kf, w.kf), log_ratio(m.degree, w.degree), log_ratio(m.mean, w.mean), log_ratio(abs(m.voltage), abs(w.voltage)),
        w.ring[2], *pair("gradient"), over(w.ring[0], w.mean),
    ]
    # fmt: on
    at = dict(zip(FEATURES, out, strict=False))
    out += [
        w.degree * w.r_active,
        w.fiedler**2,
        w.max_current * w.r_active,
        w.voltage * w.degree,
        w.power_share * at["delta_R_active_site"],
    ]
    return [float(x) if np.isfinite(x) else 0.0 for x in out]


def mutation_features(sites: DataFrame, wt: DataFrame, chunk: int = 128, by: str = "graph_id", id_col: str = "mutation_id") -> DataFrame:
    """(id, by, 83 features) of sites (id, by, node, factor). wt: wt_properties. Equal changes of a graph are computed once and joined to the mutations that make them."""
    asked = sites.where("node IS NOT NULL AND factor IS NOT NULL").select(id_col, by, "node", "factor")
    return asked.join(change_features(asked, wt, chunk, by), [by, "node", "factor"]).select(id_col, by, *FEATURES)


def change_features(sites: DataFrame, wt: DataFrame, chunk: int = 128, by: str = "graph_id") -> DataFrame:
    """(by, node, factor, 83 features) of the different changes among sites.

    A graph's changes are dealt to groups of some `chunk` rows, each with its own copy of the graph's row, so a protein with
    very many mutations takes many tasks.
    """
    changes = saved(sites.where("node IS NOT NULL AND factor IS NOT NULL").select(by, "node", "factor").distinct(), "changes")
    parts = changes.groupBy(by).agg(F.ceil(F.count("*") / chunk).cast("int").alias("_parts"))
    dealt = changes.join(parts, by).withColumn("_part", F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int")).drop("_parts")
    graphs = wt.select(by, "nodes", "u", "v", "w", "eigs", "fiedler", "lp", "components", "active").join(parts, by)
    copies = graphs.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    names = [by, "node", "factor", *FEATURES]

    def run(key: tuple, some: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(graph):
            return pd.DataFrame(columns=names)
        row = graph.iloc[0]
        nodes = np.asarray(row["nodes"])
        n = len(nodes)
        g = Graph(n, np.asarray(row["u"]), np.asarray(row["v"]), np.asarray(row["w"], float))
        g._lp = np.frombuffer(row["lp"]).reshape(n, n)
        g._spectrum = (np.asarray(row["eigs"], float), None)
        g._fiedler = wild = np.asarray(row["fiedler"], float)  # the stored vector: the same in every group
        connected, active = row["components"] == 1, np.asarray(row["active"], int)
        rows = []
        for node, own in some.groupby("node"):
            k = int(np.searchsorted(nodes, node))
            if k < n and nodes[k] == node:
                site = site_of(g, connected, active, wild, k)
                rows += [[key[0], node, f, *all_features(g, connected, site, f)] for f in own["factor"]]
        return pd.DataFrame(rows, columns=names)

    schema = f"{by} {dict(sites.dtypes)[by]}, node int, factor double, " + ", ".join(f"{f} double" for f in FEATURES)
    own = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns]).groupBy(by, "_part")  # noqa: E731  both may come from one table
    return own(dealt).cogroup(own(copies)).applyInPandas(run, schema)


def with_active_sites(wt: DataFrame, sites: DataFrame, by: str = "graph_id") -> DataFrame:
    """wt_properties with the active sites (by, node) that are given for some graphs."""
    given = sites.groupBy(by).agg(F.sort_array(F.collect_set("node")).alias("_given"))
    place = F.transform("_given", lambda n: (F.array_position("nodes", n) - 1).cast("int"))
    known = F.filter(place, lambda p: p >= 0)
    return wt.join(given, by, "left").withColumn("active", F.when(F.size(known) > 0, known).otherwise(F.col("active"))).drop("_given")


def derived_features(df: DataFrame) -> DataFrame:
    """The products of features and their five fold changes, from wild values, their changes, n (the graph's nodes) and factor.

    The mean resistance to the active sites is that of all sinks, so its fold change holds where there is an active site.
    """
    c = F.col
    log2 = lambda new, old: F.log2(F.greatest(new, F.lit(EPS)) / F.greatest(old, F.lit(EPS)))
    changed = lambda old, change: log2(old + c(change), old)
    kf = c("effective_graph_resistance_wt") * c("n") * (c("n") - 1) / 2
    mean = (c("n") - 1) / (c("n") * c("resistance_centrality_wt"))
    return df.withColumns(
        {
            "conductance_R_active_product": c("conductance_degree_wt") * c("R_active_site_wt"),
            "fiedler_squared_wt": c("fiedler_component_wt") * c("fiedler_component_wt"),
            "current_R_product_wt": c("max_edge_current_wt") * c("R_active_site_wt"),
            "voltage_conductance_product_wt": c("voltage_wt") * c("conductance_degree_wt"),
            "power_deltaR_product": c("power_local_fraction_wt") * c("delta_R_active_site"),
            "R_active_fold_change": changed(c("R_active_site_wt"), "delta_R_active_site"),
            "kirchhoff_fold_change": changed(kf, "delta_kirchhoff"),
            "conductance_degree_fold_change": log2(c("conductance_degree_wt") * c("factor"), c("conductance_degree_wt")),
            "R_global_fold_change": changed(mean, "delta_R_global_mean"),
            "voltage_fold_change": log2(F.abs(c("voltage_wt") + c("delta_voltage")), F.abs(c("voltage_wt"))),
        }
    )


def suffixed(df: DataFrame, suffix: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(f"{c}{suffix}") for c in df.columns if c not in keys])


def multi_scale_features(near: DataFrame, wide: DataFrame, id_col: str | list[str] = "mutation_id", by: str = "graph_id", suffix: str = "_6A") -> DataFrame:
    """Features at two cutoffs side by side; wide keeps its names. id_col: what both are joined by."""
    keys = [id_col] if isinstance(id_col, str) else id_col
    return wide.join(suffixed(near if by in keys else near.drop(by), suffix, keys), keys)


# The features that are compared between two scales.
CROSS_SCALE = [
    "delta_R_active_site", "delta_R_global_mean", "propagation_radius", "current_entropy_wt", "delta_algebraic_connectivity", "spectral_gap_ratio",
    "R_kurtosis_wt", "current_flow_betweenness_wt", "effective_graph_resistance_wt", "norton_current_wt",
]


def cross_scale_features(df: DataFrame, names: list[str] = CROSS_SCALE, suffix: str = "_6A") -> DataFrame:
    a, b = (lambda x: F.col(x)), (lambda x: F.col(f"{x}{suffix}"))
    made = {f"scale_diff_{x}": a(x) - b(x) for x in names} | {f"scale_ratio_{x}": ratio(a(x), b(x), EPS) for x in names}
    return df.withColumns(made)


def aa_substitution_features(df: DataFrame, extra: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Physicochemical changes of wild_type -> mutation; extra: name -> values by one letter, each giving a difference."""
    a, b = F.col("wild_type"), F.col("mutation")
    change = lambda i: scale(b, i) - scale(a, i)
    charged = lambda x: scale(x, 1) != 0
    swapped = lambda names: (a.isin(*names) != b.isin(*names)).cast("int")
    made = {
        "cc_volume_change": change(2) / 100,
        "cc_hydrophobicity_change": change(0),
        "cc_charge_change": change(1),
        "cc_abs_charge_change": F.abs(change(1)),
        "cc_impedance_factor": perturbation_factor(a, b),
        "cc_volume_ratio": scale(b, 2) / scale(a, 2),
        "cc_charge_swap": (charged(a) != charged(b)).cast("int"),
        "cc_pro_gly": swapped(["P", "G"]),
        "cc_cys": swapped(["C"]),
        "cc_wt_hydrophobicity": scale(a, 0) / 4.5,
    }
    for name, values in (extra or {}).items():
        of = lambda x, v=values: F.try_element_at(F.create_map(*[F.lit(y) for kv in v.items() for y in kv]), x)
        made[f"cc_{name}_change"] = of(b) - of(a)
    return df.withColumns(made)


def select_by_importance(importances: DataFrame, least: float = 0.005) -> DataFrame:
    """Features that matter enough, ranked; the table has a row a feature."""
    order = W.orderBy(F.desc("importance"), "feature")
    return importances.where(F.col("importance") >= least).withColumn("rank", F.row_number().over(order))
