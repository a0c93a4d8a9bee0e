"""Effective resistances of graphs too large for a dense matrix, by random projections.

A resistance is a squared distance between two nodes' voltage vectors, one number for each edge of the graph. Random signs
project these vectors to a few numbers: a projection is one Laplacian system, solved by conjugate gradients with the
degrees as preconditioner. Projections are dealt to tasks, TOGETHER at a time; a task holds its graph's edges, never a
matrix. Pairs then meet their nodes' numbers by joins, and squares of differences are summed.

With 4 ln(n) / (e^2 / 2 - e^3 / 3) projections for n nodes, a pair's resistance is off by more than a share e with a
probability of at most 2 / n^2. Nodes in different components have what the pseudoinverse gives them, as in the
dense form. Reruns agree.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linalg

#: Projections of a graph that one task solves, and how many of them at once.
PROJECTIONS, TOGETHER = 32, 8
#: Relative residual at which a system counts as solved, and the most steps of a solution.
RESIDUAL, STEPS = 1e-8, 50_000


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        if (a == b).all():
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


class Sparse:
    """A graph's Laplacian by rows of neighbours."""

    def __init__(self, n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray):
        here, there, both = np.r_[u, v], np.r_[v, u], np.r_[w, w]
        order = np.argsort(here, kind="stable")
        self.there, self.w = there[order], both[order][:, None]
        self.rows, self.first = np.unique(here[order], return_index=True)
        self.degree = np.bincount(here, both, n).astype(float)[:, None]  # counts of nothing are whole numbers
        root = components(n, u, v)
        self.piece, self.size = np.unique(root, return_inverse=True, return_counts=True)[1:]
        self.inverse = np.divide(1.0, self.degree, out=np.zeros_like(self.degree), where=self.degree > 0)

    def times(self, x: np.ndarray) -> np.ndarray:
        out = self.degree * x
        if len(self.rows):
            out[self.rows] -= np.add.reduceat(self.w * x[self.there], self.first)
        return out

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less its mean over each component: the part that the Laplacian sees."""
        return x - np.stack([np.bincount(self.piece, c) / self.size for c in x.T], 1)[self.piece]

    def solved(self, y: np.ndarray) -> np.ndarray:
        """The pseudoinverse times the columns of y, which sum to 0 over each component."""
        x, r = np.zeros_like(y), y.copy()
        z = self.inverse * r
        p, rz = z.copy(), (r * z).sum(0)
        wanted = RESIDUAL * np.sqrt((y * y).sum(0))
        for _ in range(STEPS):
            on = np.sqrt((r * r).sum(0)) > wanted
            if not on.any():
                return self.centred(x)
            lp = self.times(p)
            step = np.divide(rz, (p * lp).sum(0), out=np.zeros_like(rz), where=on)
            x += step * p
            r -= step * lp
            z = self.inverse * r
            new = (r * z).sum(0)
            p = z + np.divide(new, rz, out=np.zeros_like(rz), where=on) * p
            rz = new
        raise ValueError(f"a graph of {len(y)} nodes was not solved in {STEPS} steps")


def projected(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, numbers: range, count: int) -> np.ndarray:
    """Some of count projections of a graph's nodes: n x len(numbers)."""
    graph, out = Sparse(n, u, v, w), []
    for a in range(0, len(numbers), TOGETHER):
        some = numbers[a : a + TOGETHER]
        y = np.empty((n, len(some)))
        for i, number in enumerate(some):
            flow = np.random.default_rng([n, number]).choice((-1.0, 1.0), len(w)) * np.sqrt(w / count)
            y[:, i] = np.bincount(u, flow, n) - np.bincount(v, flow, n)
        out.append(graph.solved(y))
    return np.hstack(out)


def node_projections(nodes: DataFrame, edges: DataFrame, error: float = 0.3, by: str = "graph_id") -> DataFrame:
    """(by, node, part, z): the nodes' projections, PROJECTIONS to a part."""
    if not 0 < error < 1:
        raise ValueError("the error is a share between 0 and 1")
    each = 4 / (error**2 / 2 - error**3 / 3)
    parts = nodes.groupBy(by).agg(F.greatest(F.lit(1), F.ceil(F.log(F.count("*")) * each)).alias("_k"))
    spread = lambda df: df.join(parts, by).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_k") - 1) / PROJECTIONS))))
    own = lambda df, *cols: spread(df).select(*[F.col(c).alias(c) for c in (by, "_part", "_k", *cols)]).groupBy(by, "_part", "_k")

    def solve(key: tuple, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(n):
            return pd.DataFrame(columns=[by, "node", "part", "z"])
        g, names = linalg.from_rows(n, e.sort_values(["u", "v", "weight"]))  # signs belong to edges in this order
        live = g.w > 0
        part, count = int(key[1]), int(key[2])
        z = projected(g.n, g.u[live], g.v[live], g.w[live], range(part * PROJECTIONS, min(count, (part + 1) * PROJECTIONS)), count)
        return pd.DataFrame({by: key[0], "node": names, "part": part, "z": list(z)})

    schema = f"{by} {dict(nodes.dtypes)[by]}, node int, part int, z array<double>"
    return own(nodes, "node").cogroup(own(edges, "u", "v", "weight")).applyInPandas(solve, schema)


def resistance_by_projections(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, error: float = 0.3, by: str = "graph_id") -> DataFrame:
    """(by, i, j, r) of the pairs (by, i, j) whose nodes are known, each within a share `error`; repeated pairs once."""
    z = node_projections(nodes, edges, error, by)
    end = lambda c: z.select(F.col(by).alias(f"_{c}"), F.col("node").alias(c), F.col("part").alias(f"_{c}_part"), F.col("z").alias(f"_{c}_z"))
    asked = pairs.select(by, F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j")).distinct()
    met = asked.join(end("i").withColumnRenamed("_i", by), [by, "i"]).join(end("j").withColumnRenamed("_j", by).withColumnRenamed("_j_part", "_i_part"), [by, "j", "_i_part"])
    square = F.aggregate(F.zip_with("_i_z", "_j_z", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return met.groupBy(by, "i", "j").agg(F.sum(square).alias("r"))


def effective_resistance(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, dense: int = 4_000, error: float = 0.3, by: str = "graph_id") -> DataFrame:
    """(by, i, j, r, exact) of the pairs asked for: from the pseudoinverse for graphs of at most `dense` nodes, else by projections."""
    sizes = nodes.groupBy(by).agg((F.count("*") <= dense).alias("_small"))
    side = lambda df, small: df.join(sizes.where(F.col("_small") == small).select(by), by, "left_semi")
    small, large = ([side(df, s) for df in (nodes, edges, pairs.select(by, "i", "j").distinct())] for s in (True, False))
    exact = linalg.effective_resistance(*small, by=by).withColumn("exact", F.lit(True))
    return exact.unionByName(resistance_by_projections(*large, error=error, by=by).withColumn("exact", F.lit(False)))
