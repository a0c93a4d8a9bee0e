"""Metrics of graphs and of distributions as joins and aggregates; every sum is combined before it is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .contacts import both_ways
from .linalg import Graph, packed, per_graph, together

TINY = 1e-15
#: Pairs of a site and a node, and steps along edges, that are held at once.
CELLS = 1_000_000


def conductance_degree(edges: DataFrame, by: str = "graph_id") -> DataFrame:
    return both_ways(edges, by).groupBy(by, "node").agg(F.sum("weight").alias("degree"))


def total_conductance(edges: DataFrame, by: str = "graph_id") -> DataFrame:
    return edges.groupBy(by).agg(F.sum("weight").alias("total"))


def _with_voltages(edges: DataFrame, volts: DataFrame, by: str) -> DataFrame:
    end = lambda e: volts.select(by, F.col("node").alias(e), F.col("voltage").alias(f"_{e}"))
    return edges.join(end("u"), [by, "u"]).join(end("v"), [by, "v"])


def edge_currents(edges: DataFrame, volts: DataFrame, by: str = "graph_id") -> DataFrame:
    """Signed current from u to v."""
    flow = F.col("weight") * (F.col("_u") - F.col("_v"))
    return _with_voltages(edges, volts, by).select(by, "u", "v", "weight", flow.alias("current"))


def edge_power(edges: DataFrame, volts: DataFrame, by: str = "graph_id") -> DataFrame:
    drop = F.col("_u") - F.col("_v")
    return _with_voltages(edges, volts, by).select(by, "u", "v", "weight", (F.col("weight") * drop * drop).alias("power"))


def at_sites(flows: DataFrame, sites: DataFrame, by: str = "graph_id") -> DataFrame:
    """The rows of currents or powers on edges at a site (by, node)."""
    ends = flows.withColumn("node", F.explode(F.array("u", "v")))
    return ends.join(sites.select(by, "node").distinct(), [by, "node"])


def entropy(df: DataFrame, col: str, by: list[str], out: str = "entropy") -> DataFrame:
    """-sum p ln p of the shares of |col| in their group, in one pass: ln S - sum x ln x / S, over shares above TINY."""
    x = F.abs(F.col(col))
    sums = df.groupBy(*by).agg(F.sum(x).alias("_s"), F.sum(F.when(x > 0, x * F.ln(x))).alias("_x"))
    value = F.when(F.col("_s") < TINY, 0.0).otherwise(F.ln("_s") - F.coalesce("_x", F.lit(0.0)) / F.col("_s"))
    return sums.select(*by, value.alias(out))


def herfindahl(df: DataFrame, col: str, by: list[str], out: str = "herfindahl") -> DataFrame:
    """Sum of squared shares of |col|, in one pass."""
    x = F.abs(F.col(col))
    sums = df.groupBy(*by).agg(F.sum(x).alias("_s"), F.sum(x * x).alias("_q"))
    return sums.select(*by, F.when(F.col("_s") < TINY, 0.0).otherwise(F.col("_q") / (F.col("_s") * F.col("_s"))).alias(out))


def hop_shells(edges: DataFrame, seeds: DataFrame, hops: int = 3, by: str = "graph_id") -> DataFrame:
    """(by, site, node, hop): the nodes whose shortest way from a site has hop edges.

    Rings are found in the task that holds a graph's edges, so only edges and sites are shuffled, never the pairs that a
    ring's edges lead to.
    """
    known = edges.where(F.col(by).isNotNull() & F.col("u").isNotNull() & F.col("v").isNotNull()).select(by, "u", "v", F.lit(1.0).alias("weight"))
    graphs = packed(seeds.where(F.col(by).isNotNull()).select(by, "node").distinct(), known, by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for b in batches for r in zip(*(b[c] for c in (by, "nodes", "u", "v")), strict=True))
        made = (((key,), part) for key, sites, u, v in rows for part in rings(np.asarray(sites), np.asarray(u), np.asarray(v), hops))
        yield from together(made, [by], ["site", "node", "hop"])

    kind = dict(seeds.dtypes)["node"]
    return graphs.mapInPandas(run, f"{by} {dict(seeds.dtypes)[by]}, site {kind}, node {kind}, hop int")


def rings(sites: np.ndarray, u: np.ndarray, v: np.ndarray, hops: int) -> Iterator[dict]:
    """Columns site, node, hop of one graph, for some sites at once; a ring's edges are followed in bounded parts."""
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    sites = sites[np.isin(sites, names)]
    start, other = np.concatenate([ends[: len(u)], ends[len(u) :]]), np.concatenate([ends[len(u) :], ends[: len(u)]])
    other = other[np.argsort(start, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(start, minlength=len(names)))])
    each = max(1, CELLS // max(1, len(names)))
    for a in range(0, len(sites), each):
        some = sites[a : a + each]
        seen = np.zeros((len(some), len(names)), bool)
        row, at = np.arange(len(some)), np.searchsorted(names, some)
        seen[row, at] = True
        for hop in range(1, hops + 1):
            near = np.zeros_like(seen)
            count = first[at + 1] - first[at]
            part = np.cumsum(count) // CELLS
            for p in np.unique(part):
                r, n, k = row[part == p], first[at[part == p]], count[part == p]
                near[np.repeat(r, k), other[np.repeat(n - np.cumsum(k) + k, k) + np.arange(k.sum())]] = True
            near &= ~seen
            seen |= near
            row, at = np.nonzero(near)
            if not len(row):
                break
            yield {"site": some[row], "node": names[at], "hop": np.full(len(row), hop, np.int32)}


def shell_mean_resistance(nodes: DataFrame, edges: DataFrame, hops: int = 3, by: str = "graph_id") -> DataFrame:
    """(by, site, hop, mean_r): the mean resistance from each node to each of its rings.

    Rings and resistances meet in the task that holds the graph, so no pair of nodes is written, shuffled or joined.
    """

    def make(g: Graph, names: np.ndarray) -> dict:
        found: dict[str, list] = {"site": [names[:0]], "hop": [np.zeros(0, np.int32)], "mean_r": [np.zeros(0)]}
        for part in rings(names, names[g.u], names[g.v], hops):  # a site's whole ring is in one part
            i, j = np.searchsorted(names, part["site"]), np.searchsorted(names, part["node"])
            r = g.tree.between(i, j) if g.tree else g.lp[i, i] + g.lp[j, j] - 2 * g.lp[i, j]
            sites, at = np.unique(i, return_inverse=True)
            found["site"].append(names[sites])
            found["hop"].append(part["hop"][: len(sites)])
            found["mean_r"].append(np.bincount(at, r) / np.bincount(at))
        return {k: np.concatenate(v) for k, v in found.items()}

    known = edges.where(F.col(by).isNotNull() & F.col("u").isNotNull() & F.col("v").isNotNull())
    return per_graph(nodes.where(F.col(by).isNotNull()), known, make, f"site {dict(nodes.dtypes)['node']}, hop int, mean_r double", by)


def resistance_row_stats(resistances: DataFrame, by: str = "graph_id") -> DataFrame:
    """Of each row without its own node: harmonic mean, median, biased skewness and excess kurtosis; of under three values 0."""
    other = resistances.where("i <> j").groupBy(by, "i")
    enough = F.count("*") >= 3
    above = F.col("r") > TINY
    stats = other.agg(
        F.count_if(above).alias("_n"),
        F.sum(F.when(above, 1 / F.col("r"))).alias("_inv"),
        F.percentile("r", 0.5).alias("median"),
        F.when(enough, F.skewness("r")).alias("skewness"),
        F.when(enough, F.kurtosis("r")).alias("kurtosis"),
    )
    harmonic = F.when(F.col("_n") > 0, F.col("_n") / F.col("_inv")).otherwise(0.0)
    zero = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)).alias(c)
    return stats.select(by, "i", harmonic.alias("harmonic_mean"), "median", zero("skewness"), zero("kurtosis"))


def resistance_centrality(resistances: DataFrame, by: str = "graph_id") -> DataFrame:
    row = resistances.groupBy(by, "i").agg(F.sum("r").alias("_s"), F.count("*").alias("_n"))
    return row.select(by, "i", F.when(F.col("_s") > 0, (F.col("_n") - 1) / F.col("_s")).otherwise(0.0).alias("centrality"))


def kirchhoff_index(resistances: DataFrame, by: str = "graph_id") -> DataFrame:
    return resistances.groupBy(by).agg((F.sum("r") / 2).alias("kirchhoff"))


def influence_radius(rows: DataFrame, threshold: float = 0.1, by: str = "graph_id") -> DataFrame:
    """Of rows (by, i, j, value): how many other values reach the share of the diagonal's."""
    diagonal = rows.where("i = j").select(by, "i", F.abs("value").alias("_d"))
    met = rows.join(diagonal, [by, "i"]).groupBy(by, "i", "_d").agg(F.count_if(F.abs("value") > threshold * F.col("_d")).alias("_n"))
    return met.select(by, "i", F.when(F.col("_d") < TINY, 0).otherwise(F.col("_n") - 1).cast("long").alias("radius"))


def row_anisotropy(rows: DataFrame, by: str = "graph_id") -> DataFrame:
    x = F.abs("value")
    sums = rows.groupBy(by, "i").agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_d"))
    return sums.select(by, "i", F.when(F.col("_m") < TINY, 0.0).otherwise(F.col("_d") / F.col("_m")).alias("anisotropy"))


def laplacian_rows(edges: DataFrame, by: str = "graph_id") -> DataFrame:
    """The entries of the weighted Laplacian that are not 0: (by, i, j, value)."""
    off = both_ways(edges, by).select(by, F.col("node").alias("i"), F.col("other").alias("j"), (-F.col("weight")).alias("value"))
    diagonal = conductance_degree(edges, by).select(by, F.col("node").alias("i"), F.col("node").alias("j"), F.col("degree").alias("value"))
    return off.unionByName(diagonal)


def commute_time(resistances: DataFrame, edges: DataFrame, by: str = "graph_id") -> DataFrame:
    """Expected steps of a random walk from i to j and back."""
    return resistances.join(total_conductance(edges, by), by).select(by, "i", "j", (2 * F.col("total") * F.col("r")).alias("commute_time"))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > TINY, part / whole).otherwise(0.0)
