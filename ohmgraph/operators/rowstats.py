"""Statistics of rows of resistances and of pseudoinverses, taken in the task that holds the graph.

A graph's n x n entries never leave its task: each row is reduced there, CHUNK rows at once, to a few numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .linalg import TINY, Graph, packed, per_graph, stacked_inverses

#: Rows of a matrix that are reduced at once.
CHUNK = 512

ROW_STATS = "i int, harmonic_mean double, median double, skewness double, kurtosis double, centrality double"


def moment(x: np.ndarray, k: int) -> np.ndarray:
    """The biased k-th standardised moment of each row; 0 where a row is constant or has under three values."""
    if x.shape[1] < 3:
        return np.zeros(len(x))
    mean = x.mean(1, keepdims=True)
    d = x - mean
    var = (d * d).mean(1)
    flat = var <= (1e-14 * np.maximum(np.abs(mean[:, 0]), TINY)) ** 2
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(flat, 0.0, (d**k).mean(1) / np.where(flat, 1.0, var) ** (k / 2))


def resistance_rows(g: Graph, rows: np.ndarray) -> np.ndarray:
    """Some rows of the resistances: as many as asked for, never all pairs."""
    if g.tree:
        return g.tree.rows(rows)
    d = np.diagonal(g.lp)
    r = np.maximum(d[rows, None] + d[None, :] - 2 * g.lp[rows], 0.0)
    r[np.arange(len(rows)), rows] = 0.0
    return r


def row_stats(g: Graph, names: np.ndarray) -> dict:
    """Of each node's resistances to the others: harmonic mean, median, skewness, excess kurtosis; and its centrality."""
    out: dict[str, list] = {k: [] for k in ("harmonic_mean", "median", "skewness", "kurtosis", "centrality")}
    if g.n < 2:  # nobody else to be compared with
        return {"i": [], **out}
    for a in range(0, g.n, CHUNK):
        at = np.arange(a, min(a + CHUNK, g.n))
        r = resistance_rows(g, at)
        total = r.sum(1)
        others = r[np.arange(g.n)[None, :] != at[:, None]].reshape(len(at), g.n - 1)
        above = others > TINY
        count = above.sum(1)
        inverse = np.where(above, 1 / np.where(above, others, 1.0), 0.0).sum(1)
        out["harmonic_mean"] += np.where(count > 0, count / np.where(count > 0, inverse, 1.0), 0.0).tolist()
        out["median"] += np.median(others, 1).tolist()
        out["skewness"] += moment(others, 3).tolist()
        kurtosis = moment(others, 4)
        out["kurtosis"] += np.where(kurtosis != 0, kurtosis - 3, 0.0).tolist()
        out["centrality"] += np.where(total > 0, (g.n - 1) / np.where(total > 0, total, 1.0), 0.0).tolist()
    return {"i": names, **out}


def resistance_stats(nodes: DataFrame, edges: DataFrame, by: str = "graph_id") -> DataFrame:
    """A row a node: what its resistances to the other nodes of its graph say."""
    return per_graph(nodes, edges, row_stats, ROW_STATS, by)


def inverse_stats(nodes: DataFrame, edges: DataFrame, threshold: float = 0.1, by: str = "graph_id") -> DataFrame:
    """(by, i, radius, anisotropy) of each row of the pseudoinverse: how many other values reach a share of the diagonal's, and how unlike the values are."""
    return packed_inverse_stats(packed(nodes, edges, by), threshold, by)


def packed_inverse_stats(graphs: DataFrame, threshold: float = 0.1, by: str = "graph_id") -> DataFrame:
    """inverse_stats of packed graphs. Small graphs of one size are solved together, so that a table of very many of them costs no step a graph."""

    def reduced(lp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.abs(lp)
        d = np.diagonal(x, axis1=1, axis2=2)
        radius = np.where(d < TINY, 0, (x > threshold * d[:, :, None]).sum(2) - 1)
        mean = x.mean(2)
        return radius, np.where(mean < TINY, 0.0, x.std(2) / np.where(mean < TINY, 1.0, mean))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, names, lp in stacked_inverses(b):
                radius, anisotropy = reduced(lp)
                key = b.column(by).take(pa.array(np.repeat(rows, names.shape[1])))
                yield pa.RecordBatch.from_arrays([key, pa.array(names.ravel().astype(np.int32)), pa.array(radius.ravel().astype(np.int64)), pa.array(anisotropy.ravel())], [by, "i", "radius", "anisotropy"])

    return graphs.mapInArrow(run, f"{by} {dict(graphs.dtypes)[by]}, i int, radius long, anisotropy double")


def source_stats(nodes: DataFrame, edges: DataFrame, by: str = "graph_id") -> DataFrame:
    """(by, i, total_r, longest): the sum of a node's resistances, and the longest commute from there, in steps of a random walk."""

    def make(g: Graph, names: np.ndarray) -> dict:
        if g.tree:
            return {"i": names, "total_r": g.tree.totals(), "longest": 2 * g.w.sum() * g.tree.longest()}
        total, most = [], []
        for a in range(0, g.n, CHUNK):
            r = resistance_rows(g, np.arange(a, min(a + CHUNK, g.n)))
            total += r.sum(1).tolist()
            most += (2 * g.w.sum() * r.max(1)).tolist()
        return {"i": names, "total_r": total, "longest": most}

    return per_graph(nodes, edges, make, "i int, total_r double, longest double", by)
