"""Linear algebra of one graph at a time: small dense numpy helpers, run by Spark for all graphs."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import saved

NULL_MODE = 1e-10  # eigenvalues at most this share of the largest are null modes
TINY = 1e-15
#: Pairs of a graph that one task answers.
PAIRS = 100_000
#: Terminals of a graph's runs that one task answers.
RUNS = 2_000
#: Nodes of a graph whose current-flow betweenness one task computes.
FLOWS = 128
#: Sources of shortest paths in a graph that one task follows.
SOURCES = 256
#: Nodes up to which shortest paths go by matrix, from all sources at once, where lists of edges would be longer.
BY_MATRIX = 2_000
#: Bytes of results that a task gathers from graphs before it hands them on.
GATHERED = 8_000_000
#: Nodes of a tree up to which its spectrum is solved whole for a second vector.
WHOLE = 300
#: Nodes up to which graphs of one size are solved together, and entries of their matrices that are held at once.
SMALL, ENTRIES = 32, 500_000


class Tree:
    """A connected graph without cycles, its nodes at places of a walk that lists a subtree in one run. What a row needs is linear."""

    def __init__(self, order: np.ndarray, parent: np.ndarray, end: np.ndarray, r: np.ndarray):
        self.n, self.order, self.parent, self.end, self.r = len(order), order, parent, end, r
        self.size = end - np.arange(self.n)
        self.place = np.empty(self.n, int)
        self.place[order] = np.arange(self.n)

    @classmethod
    def of(cls, n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> Tree | None:
        """The tree that a graph is, or None."""
        if n < 1 or len(u) != n - 1 or not (np.isfinite(w) & (w > 0)).all():
            return None
        near: list[list] = [[] for _ in range(n)]
        for a, b, x in zip(u.tolist(), v.tolist(), (1 / w).tolist(), strict=True):
            near[a].append((b, x))
            near[b].append((a, x))
        order, parent, r, seen, left = [], [], [], [False] * n, [(0, -1, 0.0)]
        while left:
            at, above, x = left.pop()
            if seen[at]:
                return None
            seen[at] = True
            here = len(order)
            order.append(at)
            parent.append(above)
            r.append(x)
            left += [(b, here, y) for b, y in near[at] if not seen[b]]
        if len(order) < n:
            return None
        end = list(range(1, n + 1))
        for k in range(n - 1, 0, -1):
            end[parent[k]] = max(end[parent[k]], end[k])
        return cls(*(np.array(x, int) for x in (order, parent, end)), np.array(r, float))

    def below(self, x: np.ndarray) -> np.ndarray:
        """Sums over subtrees."""
        total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, 0)])
        return total[self.end] - total[:-1]

    def above(self, x: np.ndarray) -> np.ndarray:
        """Sums from the root down to each place."""
        change = np.zeros((self.n + 1, *x.shape[1:]))
        change[:-1] = x
        np.subtract.at(change, self.end, x)
        return np.cumsum(change[:-1], 0)

    def potentials(self, current: np.ndarray) -> np.ndarray:
        """What the pseudoinverse makes of currents (nodes, or nodes x columns): potentials with mean 0."""
        inside = current - current.mean(0)
        shape = (-1, *[1] * (current.ndim - 1))
        out = self.above(self.below(inside[self.order]) * self.r.reshape(shape))[self.place]
        return out - out.mean(0)

    def rows(self, nodes: np.ndarray) -> np.ndarray:
        """Rows of resistances to all nodes."""
        nodes = np.asarray(nodes)
        at = np.sort(self.place[nodes])
        lo, hi = np.searchsorted(at, np.arange(self.n)), np.searchsorted(at, self.end)
        out = np.empty((self.n, len(at)))
        out[0] = self.above(self.r)[at]
        for k in range(1, self.n):
            np.add(out[self.parent[k]], self.r[k], out=out[k])
            out[k, lo[k] : hi[k]] -= 2 * self.r[k]
        out[at, np.arange(len(at))] = 0.0
        return np.maximum(out[self.place][:, np.searchsorted(at, self.place[nodes])].T, 0.0)

    def between(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Resistances of pairs: what lies above one of them only. Ancestors by doubling."""
        a, b, high = self.place[i], self.place[j], self.above(self.r)
        holds = lambda x, y: (x <= y) & (y < self.end[x])
        jump = [np.maximum(self.parent, 0)]
        while jump[-1].any():
            jump.append(jump[-1][jump[-1]])
        low = a.copy()
        for up in reversed(jump):
            low = np.where(holds(low, b) | holds(up[low], b), low, up[low])
        low = np.where(holds(low, b), low, jump[0][low])
        return np.where(a == b, 0.0, (high[a] - high[low]) + (high[b] - high[low]))

    def totals(self) -> np.ndarray:
        """The sum of each node's resistances."""
        return (self.above(self.r).sum() + self.above(self.r * (self.n - 2 * self.size)))[self.place]

    def longest(self) -> np.ndarray:
        """Each node's largest resistance: the farthest node is an end of the longest way."""
        one = int(self.rows(np.array([0]))[0].argmax())
        other = int(self.rows(np.array([one]))[0].argmax())
        return self.rows(np.array([one, other])).max(0)

    def passing(self) -> np.ndarray:
        """Ordered pairs of other nodes whose way leads through a node: those in two of its branches."""
        up = self.n - self.size.astype(float)
        branches = up * up
        np.add.at(branches, self.parent[1:], self.size[1:].astype(float) ** 2)
        return ((self.n - 1.0) ** 2 - branches)[self.place]

    def second(self, rounds: int = 200) -> np.ndarray | None:
        """The second vector of the Laplacian by iteration of a block, or None where it stays unsettled."""
        block = np.random.default_rng(0).standard_normal((self.n, 6))
        for _ in range(rounds):
            block = np.linalg.qr(self.potentials(block))[0]
            image = self.potentials(block)
            value, turn = np.linalg.eigh(block.T @ image)
            x, image = block @ turn[:, -1], image @ turn[:, -1]
            if np.linalg.norm(image - value[-1] * x) <= 1e-11 * value[-1]:
                return x if value[-1] - value[-2] > 1e-6 * value[-1] else None
        return None


@dataclass
class Graph:
    """A weighted graph of n nodes with the spectrum of its Laplacian."""

    n: int
    u: np.ndarray
    v: np.ndarray
    w: np.ndarray
    _spectrum: tuple[np.ndarray, np.ndarray] | None = None
    _lp: np.ndarray | None = None
    _fiedler: np.ndarray | None = None

    @cached_property
    def tree(self) -> Tree | None:
        return Tree.of(self.n, self.u, self.v, self.w)

    def laplacian(self) -> np.ndarray:
        a = np.zeros((self.n, self.n))
        np.add.at(a, (self.u, self.v), self.w)
        a = a + a.T
        return np.diag(a.sum(1)) - a

    def spectrum(self) -> tuple[np.ndarray, np.ndarray]:
        if self._spectrum is None:
            self._spectrum = np.linalg.eigh(self.laplacian())
        return self._spectrum

    @property
    def eigs(self) -> np.ndarray:
        return self.spectrum()[0]

    @property
    def lp(self) -> np.ndarray:
        """The Laplacian's pseudoinverse."""
        if self._lp is None and self.tree:
            r = self.tree.rows(np.arange(self.n))
            mean = r.mean(0)
            self._lp = (mean[:, None] + mean[None, :] - r - mean.mean()) / 2
        if self._lp is None:
            lam, vec = self.spectrum()
            keep = lam > NULL_MODE * max(lam[-1], 0.0) if self.n else np.zeros(0, bool)
            self._lp = (vec[:, keep] / lam[keep]) @ vec[:, keep].T
        return self._lp

    def null_modes(self) -> int:
        return int((self.eigs <= NULL_MODE * max(self.eigs[-1], 0.0)).sum())

    def pieces(self) -> int:
        """Components: a pseudoinverse times its Laplacian is 1 less the means over components, so what its trace lacks is their number."""
        if not self.n or self.tree:
            return min(self.n, 1)
        at = np.diagonal(self.lp)
        return self.n - round(float((self.w * (at[self.u] + at[self.v] - 2 * self.lp[self.u, self.v])).sum()))

    def fiedler(self, like: np.ndarray | None = None) -> np.ndarray:
        """The second eigenvector. Its largest entry (the first such) is positive; or it points the way of another vector."""
        if self.n < 2:
            return np.zeros(self.n)
        x = self._fiedler
        if x is None and self._spectrum is None and self.n > WHOLE and self.tree:
            x = self.tree.second()
        x = self.spectrum()[1][:, 1] if x is None else x
        if like is not None:
            return -x if x @ like < 0 else x
        top = np.flatnonzero(np.abs(x) >= np.abs(x).max() - 1e-12)[0]
        return -x if x[top] < 0 else x

    def resistance_row(self, k: int) -> np.ndarray:
        d = np.diagonal(self.lp)
        row = np.maximum(d[k] + d - 2 * self.lp[k], 0.0)
        row[k] = 0.0
        return row

    def resistances(self) -> np.ndarray:
        d = np.diagonal(self.lp)
        r = np.maximum(d[:, None] + d[None, :] - 2 * self.lp, 0.0)
        np.fill_diagonal(r, 0.0)
        return r

    def kirchhoff(self) -> float:
        return float(self.tree.totals().sum() / 2) if self.tree else float(self.n * np.trace(self.lp))

    def neighbours(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        here, there = self.u == k, self.v == k
        return np.concatenate([self.v[here], self.u[there]]), np.concatenate([self.w[here], self.w[there]])

    def voltages(self, source: int, sinks: np.ndarray) -> np.ndarray:
        """Potentials with one unit of current in at the source and equal shares out at the sinks."""
        if self.tree:
            current = np.zeros(self.n)
            current[source] = 1.0
            np.subtract.at(current, sinks, 1 / max(1, len(sinks)))
            return self.tree.potentials(current)
        out = self.lp[:, source]
        return out - self.lp[:, sinks].mean(1) if len(sinks) else out

    def flow_betweenness(self, k: int, connected: bool) -> float:
        """Share of the current between all pairs that flows through k; sums of |differences| come from sorted values."""
        n = self.n
        if n < 3 or not connected:
            return 0.0
        if self.tree:  # all current between two nodes takes their one way
            return float(self.flows[k])
        near, w = self.neighbours(k)
        flow = np.sort(w[:, None] * (self.lp[k] - self.lp[near]), axis=1)
        return float(((flow @ (2 * np.arange(n) - n + 1)).sum() - (n - 1)) / ((n - 1) * (n - 2)))

    @cached_property
    def flows(self) -> np.ndarray:
        return self.tree.passing() / ((self.n - 1) * (self.n - 2))

    def path_betweenness(self, sources=None) -> np.ndarray:
        """Shortest-path betweenness with the weights as lengths, by a heap over lists of neighbours; of paths from some sources only, if given."""
        if sources is None and self.tree:
            return self.tree.passing()
        if self.n <= BY_MATRIX and self.n * self.n < 100 * len(self.w):
            lengths = self.lengths()
            if lengths is not None:
                return between_by_matrix(lengths, np.arange(self.n) if sources is None else np.asarray(sources))
        total, near = np.zeros(self.n), [[] for _ in range(self.n)]
        for u, v, w in zip(self.u.tolist(), self.v.tolist(), self.w.tolist(), strict=True):
            near[u].append((v, w))
            near[v].append((u, w))
        for s in range(self.n) if sources is None else sources:
            dist, paths, before = [math.inf] * self.n, [0.0] * self.n, [[] for _ in range(self.n)]
            done, order, heap = [False] * self.n, [], [(0.0, s)]
            dist[s], paths[s] = 0.0, 1.0
            while heap:
                d, at = heapq.heappop(heap)
                if done[at]:
                    continue
                done[at] = True
                order.append(at)
                for to, w in near[at]:
                    way = d + w
                    if way < dist[to]:
                        dist[to], paths[to], before[to] = way, paths[at], [at]
                        heapq.heappush(heap, (way, to))
                    elif way == dist[to] and not done[to]:
                        paths[to] += paths[at]
                        before[to].append(at)
            depend = [0.0] * self.n
            for x in reversed(order[1:]):
                share = (1 + depend[x]) / paths[x]
                for y in before[x]:
                    depend[y] += paths[y] * share
                total[x] += depend[x]
        return total

    def lengths(self) -> np.ndarray | None:
        """The weights as lengths between all nodes, infinite where there is no edge; None where a pair has two edges or a weight is no positive number."""
        out = np.full((self.n, self.n), np.inf)
        out[self.u, self.v] = out[self.v, self.u] = self.w
        once = np.isfinite(out).sum() == 2 * len(self.w) and (self.u != self.v).all()
        return out if once and (self.w > 0).all() else None

    def most_between(self, k: int = 5) -> np.ndarray:
        """The k nodes of highest betweenness; equals by node."""
        b = np.round(self.path_betweenness(), 9)
        return np.lexsort((np.arange(self.n), -b))[:k]

    def changed(self, k: int, factor: float) -> Graph:
        """The graph after a change at k. Where that keeps its components, only eigenvalues are solved for anew: the
        pseudoinverse comes from this one's, and the second vector by inverse iteration from this one's if it is alone."""
        at = (self.u == k) | (self.v == k)
        new = Graph(self.n, self.u, self.v, np.where(at, self.w * factor, self.w))
        if factor > 0 and self._fiedler is not None and self.n > 3:
            matrix = self.changed_matrix(k, factor)
            eigs = np.linalg.eigvalsh(matrix)
            top = max(eigs[-1], 0.0)
            alone = eigs[1] > 1e-6 * top and eigs[2] - eigs[1] > 1e-4 * top
            if alone:
                new._lp = self.changed_inverse(k, factor) if 3 * at.sum() < self.n else inverse_of_connected(matrix)
                x = nearest_vector(matrix, eigs[1], self._fiedler, top)
                new._spectrum, new._fiedler = (eigs, None), x
        return new

    @cached_property
    def matrix(self) -> np.ndarray:
        return self.laplacian()

    def changed_matrix(self, k: int, factor: float) -> np.ndarray:
        """The Laplacian after a change at k: that of the graph, with new values at k and on its neighbours' diagonal."""
        matrix = self.matrix.copy()
        more = (factor - 1) * self.matrix[k]
        diagonal = np.arange(self.n)
        matrix[diagonal, diagonal] -= more
        matrix[k] += more
        matrix[:, k] += more
        matrix[k, k] = factor * self.matrix[k, k]
        return matrix

    def changed_inverse(self, k: int, factor: float) -> np.ndarray:
        """The pseudoinverse after a change at k, by a low-rank update as wide as k has neighbours."""
        near, w = self.neighbours(k)
        if factor == 1.0 or not len(near):
            return self.lp
        ends = self.lp[:, [k]] - self.lp[:, near]
        inner = np.diag(1 / ((factor - 1) * w)) + ends[k] - ends[near]
        return self.lp - ends @ np.linalg.solve(inner, ends.T)


def inverse_of_connected(matrix: np.ndarray) -> np.ndarray:
    """The pseudoinverse of the Laplacian of a connected graph, whose one null vector is constant."""
    n = len(matrix)
    filled = max(float(np.trace(matrix)) / n, TINY)
    return np.linalg.inv(matrix + filled / n) - 1 / (filled * n)


def nearest_vector(matrix: np.ndarray, value: float, like: np.ndarray, top: float) -> np.ndarray:
    """The eigenvector of a single eigenvalue, by inverse iteration from a vector like it."""
    shifted, x = matrix - (value - 1e-12 * top) * np.eye(len(matrix)), like
    for _ in range(3):
        x = np.linalg.solve(shifted, x)
        x /= np.linalg.norm(x)
        if np.linalg.norm(matrix @ x - value * x) <= 1e-13 * top:
            break
    return x


def between_by_matrix(lengths: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """path_betweenness of paths from some sources: each step takes the nearest node left of every source, and adds in the order that a heap has."""
    n, row = len(lengths), np.arange(len(sources))
    dist, paths, left = np.full((len(sources), n), np.inf), np.zeros((len(sources), n)), np.full((len(sources), n), np.inf)
    dist[row, sources], paths[row, sources], left[row, sources] = 0.0, 1.0, 0.0
    order, last = np.empty((n, len(sources)), int), np.full((len(sources), n), -1)
    done = np.zeros((len(sources), n), bool)
    for step in range(n):
        at = left.argmin(1)
        reached = np.isfinite(left[row, at])
        order[step] = np.where(reached, at, -1)  # nodes out of reach are in no order
        last[row[reached], at[reached]] = step
        done[row, at] = True
        left[row, at] = np.inf
        way = dist[row, at][:, None] + lengths[at]
        way[~reached] = np.inf
        way[done] = np.inf
        here = paths[row, at][:, None]
        paths = np.where(way < dist, here, np.where((way == dist) & np.isfinite(way), paths + here, paths))
        dist = np.minimum(dist, way)
        left = np.where(done, np.inf, dist)
    depend = np.zeros((len(sources), n))
    for step in range(n - 1, 0, -1):
        at = order[step]
        end = dist[row, at]
        own = (at >= 0) & (at != sources)
        before = (dist + lengths[at] == end[:, None]) & (last < step) & own[:, None]
        share = np.where(own, (1 + depend[row, at]) / np.where(own, paths[row, at], 1.0), 0.0)
        depend += np.where(before, paths * share[:, None], 0.0)
    depend[row, sources] = 0.0
    return depend.sum(0)


def from_rows(nodes: pd.DataFrame, edges: pd.DataFrame) -> tuple[Graph, np.ndarray]:
    """A graph over its nodes' places, and the nodes' own numbers."""
    names = np.sort(nodes["node"].to_numpy())
    place = lambda c: np.searchsorted(names, edges[c].to_numpy())
    return Graph(len(names), place("u"), place("v"), edges["weight"].to_numpy(float)), names


def packed(nodes: DataFrame, edges: DataFrame, by: str = "graph_id") -> DataFrame:
    """A row (by, nodes, u, v, w) a graph that has nodes: its nodes in order, and its edges."""
    edge = f"struct<u:{dict(edges.dtypes)['u']},v:{dict(edges.dtypes)['v']},weight:double>"
    n = nodes.select(by, F.col("node").alias("_n"), F.lit(None).cast(edge).alias("_e"))
    e = edges.select(by, F.lit(None).cast(dict(nodes.dtypes)["node"]).alias("_n"), F.struct("u", "v", F.col("weight").cast("double").alias("weight")).cast(edge).alias("_e"))
    both = n.union(e).groupBy(by).agg(F.sort_array(F.collect_list("_n")).alias("nodes"), F.collect_list("_e").alias("_e"))  # neither list takes nulls
    return both.where(F.size("nodes") > 0).select(by, "nodes", "_e.u", "_e.v", F.col("_e.weight").alias("w"))


def unpacked(nodes, u, v, w, lp: bytes | None = None) -> tuple[Graph, np.ndarray]:
    """The graph of a packed row over its nodes' places, and the nodes' own numbers."""
    names = np.asarray(nodes)
    place = lambda x: np.searchsorted(names, x)
    known = None if lp is None else np.frombuffer(lp).reshape(len(names), -1)
    return Graph(len(names), place(u), place(v), np.asarray(w, float), _lp=known), names


def complete(nodes: DataFrame, by: str = "graph_id") -> DataFrame:
    """Packed graphs of nodes (by, node), each joined to all others of its graph by an edge of weight 1."""
    graphs = nodes.groupBy(by).agg(F.sort_array(F.collect_set("node")).alias("nodes"))
    later = lambda a: F.transform(F.filter("nodes", lambda b: b > a), lambda b: F.struct(a.alias("u"), b.alias("v")))
    paired = graphs.where(F.size("nodes") > 0).withColumn("_e", F.flatten(F.transform("nodes", later)))
    return paired.select(by, "nodes", "_e.u", "_e.v", F.transform("_e", lambda _: F.lit(1.0)).alias("w"))


def stacked_inverses(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of the batch, their nodes, their pseudoinverses) of packed graphs, those of one size together."""
    lists = {c: (np.asarray(x.offsets), x.values.to_numpy(zero_copy_only=False)) for c in ("nodes", "u", "v", "w") for x in [batch.column(c)]}
    (first, node), (start, u), v, w = lists["nodes"], lists["u"], lists["v"][1], lists["w"][1].astype(float)
    sizes, counts = np.diff(first), np.diff(start)
    for n in np.unique(sizes).tolist():
        every, each = np.flatnonzero(sizes == n), max(1, ENTRIES // (n * n)) if n <= SMALL else 1
        for a in range(0, len(every), each):
            rows = every[a : a + each]
            names = node[first[rows][:, None] + np.arange(n)]
            if n > SMALL:
                own = slice(start[rows[0]], start[rows[0] + 1])
                yield rows, names, unpacked(names[0], u[own], v[own], w[own])[0].lp[None]
                continue
            m = counts[rows]
            graph = np.repeat(np.arange(len(rows)), m)
            at = np.repeat(start[rows] - np.cumsum(m) + m, m) + np.arange(m.sum())
            place = lambda x: (names[graph] < x[at][:, None]).sum(1)  # noqa: B023, E731
            cells = (graph * n + place(u)) * n + place(v)
            weights = np.bincount(cells, w[at], len(rows) * n * n).reshape(-1, n, n)
            weights = weights + weights.transpose(0, 2, 1)
            lam, vec = np.linalg.eigh(weights.sum(2)[:, :, None] * np.eye(n) - weights)
            keep = lam > NULL_MODE * np.maximum(lam[:, -1:], 0.0)
            yield rows, names, (vec * np.where(keep, 1 / np.where(keep, lam, 1.0), 0.0)[:, None, :]) @ vec.transpose(0, 2, 1)


def together(made: Iterator[tuple[tuple, dict]], keys: list[str], names: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of the rows made for many graphs, so that a small graph costs no frame of its own."""

    def frame(held: list[tuple[tuple, dict]]) -> pd.DataFrame:
        counts = [len(next(iter(d.values()))) for _, d in held]
        out = {k: pd.Series([key[i] for key, _ in held]).repeat(counts).to_numpy() for i, k in enumerate(keys)}
        for c in names:
            parts = [d[c] for _, d in held]
            out[c] = np.concatenate(parts) if all(isinstance(x, np.ndarray) and x.ndim == 1 for x in parts) else list(chain.from_iterable(parts))
        return pd.DataFrame(out)

    size = lambda x: x.nbytes if isinstance(x, np.ndarray) else len(x) if isinstance(x, bytes) else 8
    held, total = [], 0
    for key, one in made:
        held.append((key, one))
        total += 100 + sum(x.nbytes if isinstance(x, np.ndarray) else sum(map(size, x)) for x in one.values())
        if total > GATHERED:
            yield frame(held)
            held, total = [], 0
    if held:
        yield frame(held)


def per_graph(nodes: DataFrame, edges: DataFrame, make: Callable[[Graph, np.ndarray], dict], schema: str, by: str = "graph_id") -> DataFrame:
    """Rows (by, ...schema) that make() gives for each graph that has nodes."""
    return per_packed(packed(nodes, edges, by), make, schema, by)


def per_packed(graphs: DataFrame, make: Callable[..., dict], schema: str, by: str = "graph_id", more: tuple[str, ...] = ()) -> DataFrame:
    """per_graph of packed graphs; make() takes what the columns `more` hold as well."""
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for b in batches for r in zip(*(b[c] for c in (by, "nodes", "u", "v", "w", *more)), strict=True))
        yield from together((((r[0],), make(*unpacked(*r[1:5]), *r[5:])) for r in rows), [by], names)

    return graphs.mapInPandas(run, f"{by} {dict(graphs.dtypes)[by]}, {schema}")


def laplacian_pinv(nodes: DataFrame, edges: DataFrame, by: str = "graph_id") -> DataFrame:
    return per_graph(nodes, edges, lambda g, i: {"i": i, "lp": list(g.lp)}, "i int, lp array<double>", by)


def pinv_entries(nodes: DataFrame, edges: DataFrame, by: str = "graph_id") -> DataFrame:
    """(by, i, j, value) of the pseudoinverse."""
    make = lambda g, i: {"i": np.repeat(i, g.n), "j": np.tile(i, g.n), "value": g.lp.ravel()}
    return per_graph(nodes, edges, make, "i int, j int, value double", by)


def effective_resistance(nodes: DataFrame, edges: DataFrame, pairs: DataFrame | None = None, by: str = "graph_id") -> DataFrame:
    """(by, i, j, r) for all pairs, or without a floor for the pairs (by, i, j) asked for."""
    if pairs is None:
        make = lambda g, i: {"i": np.repeat(i, g.n), "j": np.tile(i, g.n), "r": g.resistances().ravel()}
        return per_graph(nodes, edges, make, "i int, j int, r double", by)

    def look_up(names: np.ndarray, g: Graph, some: dict) -> dict:
        known = np.isin(some["i"], names) & np.isin(some["j"], names)
        one, two = some["i"][known], some["j"][known]
        i, j = np.searchsorted(names, one), np.searchsorted(names, two)
        return {"i": one, "j": two, "r": g.tree.between(i, j) if g.tree else g.lp[i, i] + g.lp[j, j] - 2 * g.lp[i, j]}

    return asked_of_graphs(nodes, edges, pairs.select(by, "i", "j"), ["i", "j"], PAIRS, look_up, "i int, j int, r double", by)


def asked_of_graphs(nodes: DataFrame, edges: DataFrame, asked: DataFrame, key: list[str], each: int, answer, schema: str, by: str = "graph_id") -> DataFrame:
    """What answer(nodes, graph, columns) gives for rows asked of graphs, some `each` rows a task; rows of one key stay together.

    A graph's pseudoinverse is computed once and goes to the tasks with the graph; a tree needs none.
    """
    held = lambda g, i: {k: [v] for k, v in {"nodes": i, "lp": None if g.tree else g.lp.tobytes(), "u": i[g.u], "v": i[g.v], "w": g.w}.items()}
    graphs = per_graph(nodes, edges, held, "nodes array<int>, lp binary, u array<int>, v array<int>, w array<double>", by)
    parts = asked.groupBy(by).agg(F.ceil(F.count("*") / each).alias("_parts"))
    cols, names = [c for c in asked.columns if c != by], [x.split()[0] for x in schema.split(", ")]
    same = F.col(by).eqNullSafe(F.col(f"_{by}"))
    own = parts.withColumnRenamed(by, f"_{by}")
    spread = asked.join(own, same).withColumn("_part", F.pmod(F.xxhash64(*key), F.col("_parts")))
    rows = spread.groupBy(by, "_part").agg(F.collect_list(F.struct(*cols)).alias("_rows")).select(by, "_part", *[F.col(f"_rows.{c}").alias(f"_{c}") for c in cols])
    copies = graphs.join(own, same).select(F.col(by).alias(f"_{by}"), "nodes", "lp", "u", "v", "w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_copy"))
    met = rows.join(copies, same & (F.col("_part") == F.col("_copy")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def made() -> Iterator[tuple[tuple, dict]]:
            for b in batches:
                for g, some, graph_key in zip(zip(*(b[c] for c in ("nodes", "u", "v", "w", "lp")), strict=True), zip(*(b[f"_{c}"] for c in cols), strict=True), b[by], strict=True):
                    graph, at = unpacked(*g)
                    yield (graph_key,), answer(at, graph, dict(zip(cols, map(np.asarray, some), strict=True)))

        yield from together(made(), [by], names)

    return met.select(by, "nodes", "u", "v", "w", "lp", *[f"_{c}" for c in cols]).mapInPandas(run, f"{by} {dict(nodes.dtypes)[by]}, {schema}")


def edge_resistance(nodes: DataFrame, edges: DataFrame, by: str = "graph_id") -> DataFrame:
    """(by, u, v, weight, r) for a graph's edges: their own pairs, never all."""

    def make(g: Graph, i: np.ndarray) -> dict:
        d = np.diagonal(g.lp)
        return {"u": i[g.u], "v": i[g.v], "weight": g.w, "r": d[g.u] + d[g.v] - 2 * g.lp[g.u, g.v]}

    return per_graph(nodes, edges, make, "u int, v int, weight double, r double", by)


def laplacian_spectrum(nodes: DataFrame, edges: DataFrame, by: str = "graph_id") -> DataFrame:
    return per_graph(nodes, edges, lambda g, i: {"eigs": [g.eigs]}, "eigs array<double>", by)


def fiedler_vector(nodes: DataFrame, edges: DataFrame, by: str = "graph_id") -> DataFrame:
    return per_graph(nodes, edges, lambda g, i: {"node": i, "value": g.fiedler()}, "node int, value double", by)


def null_modes(nodes: DataFrame, edges: DataFrame, by: str = "graph_id") -> DataFrame:
    """Number of components by the spectrum."""
    return per_graph(nodes, edges, lambda g, i: {"components": [g.null_modes()]}, "components int", by)


def node_voltages(nodes: DataFrame, edges: DataFrame, source: int, sinks: list[int], by: str = "graph_id") -> DataFrame:
    """(by, node, voltage) for a source and sinks of the same numbers in each graph that has them."""

    def make(g: Graph, i: np.ndarray) -> dict:
        if not np.isin([source, *sinks], i).all():
            return {"node": [], "voltage": []}
        return {"node": i, "voltage": g.voltages(int(np.flatnonzero(i == source)[0]), np.flatnonzero(np.isin(i, sinks)))}

    return per_graph(nodes, edges, make, "node int, voltage double", by)


def terminal_voltages(nodes: DataFrame, edges: DataFrame, terminals: DataFrame, by: str = "graph_id") -> DataFrame:
    """(by, run, node, voltage) for terminals (by, run, node, current): currents that flow in (positive) and out, and sum to 0 in a run.

    A graph may have many runs, each with its own sources and sinks; the pseudoinverse is computed once.
    """
    run_type = dict(terminals.dtypes)["run"]

    def solve(names: np.ndarray, g: Graph, some: dict) -> dict:
        known = pd.DataFrame(some)[np.isin(some["node"], names)]
        runs, volts = [], []
        for run, own in known.groupby("run"):
            current = np.zeros(g.n)
            np.add.at(current, np.searchsorted(names, own["node"]), own["current"].to_numpy(float))
            runs.append(run)
            volts.append(g.tree.potentials(current) if g.tree else g.lp @ current)
        return {"run": np.repeat(runs, g.n) if runs else [], "node": np.tile(names, len(runs)), "voltage": np.concatenate(volts) if volts else []}

    return asked_of_graphs(nodes, edges, terminals.select(by, "run", "node", "current"), ["run"], RUNS, solve, f"run {run_type}, node int, voltage double", by)


def current_flow_betweenness(nodes: DataFrame, edges: DataFrame, by: str = "graph_id") -> DataFrame:
    """(by, node, betweenness) by currents. A node takes a sort of a graph's values for each of its edges, so a graph's nodes are dealt to tasks."""

    def flow(names: np.ndarray, g: Graph, some: dict) -> dict:
        connected = g.pieces() == 1
        return {"node": some["node"], "betweenness": [g.flow_betweenness(int(k), connected) for k in np.searchsorted(names, some["node"])]}

    return asked_of_graphs(nodes, edges, nodes.select(by, "node"), ["node"], FLOWS, flow, "node int, betweenness double", by)


def betweenness_topk(nodes: DataFrame, edges: DataFrame, k: int = 5, by: str = "graph_id") -> DataFrame:
    """(by, rank, node): the nodes of highest betweenness; equals by node."""
    return packed_topk(packed(nodes, edges, by), k, by)


def packed_topk(graphs: DataFrame, k: int = 5, by: str = "graph_id") -> DataFrame:
    """betweenness_topk of packed graphs."""
    order = W.partitionBy(by).orderBy(F.desc(F.round("betweenness", 9)), "node")
    return packed_betweenness(graphs, by).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(by, "rank", "node")


def path_betweenness(nodes: DataFrame, edges: DataFrame, by: str = "graph_id") -> DataFrame:
    """(by, node, betweenness), the paths from some SOURCES nodes of a graph to a task; what they depend on a node for is summed.

    A graph of fewer edges than nodes is a tree, which is linear, or has many small pieces: it stays in one task."""
    return packed_betweenness(packed(nodes, edges, by), by)


def packed_betweenness(graphs: DataFrame, by: str = "graph_id") -> DataFrame:
    """path_betweenness of packed graphs."""
    parts = F.when(F.size("u") < F.size("nodes"), 1).otherwise(F.ceil(F.size("nodes") / SOURCES)).cast("int")
    spread = graphs.withColumn("_parts", parts).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).repartition(by, "_part")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def made() -> Iterator[tuple[tuple, dict]]:
            for b in batches:
                for key, count, part, *row in zip(*(b[c] for c in (by, "_parts", "_part", "nodes", "u", "v", "w")), strict=True):
                    g, names = unpacked(*row)
                    mine = None if count == 1 else range(part * SOURCES, min(g.n, (part + 1) * SOURCES))
                    yield (key,), {"node": names, "part_sum": g.path_betweenness(mine)}

        yield from together(made(), [by], ["node", "part_sum"])

    sums = spread.mapInPandas(run, f"{by} {dict(graphs.dtypes)[by]}, node int, part_sum double")
    return sums.groupBy(by, "node").agg(F.sum("part_sum").alias("betweenness"))


WT = "n int, nodes array<int>, u array<int>, v array<int>, w array<double>, eigs array<double>, fiedler array<double>, lp binary, lp_diag array<double>, trace double, kf double, components int, active array<int>"


def wt_properties(nodes: DataFrame, edges: DataFrame, active: int = 5, by: str = "graph_id") -> DataFrame:
    """One row a graph: all that its mutations share, so it is computed once. Node numbers inside are places in nodes.

    A graph meets its few active nodes before its n x n values are made, and by a join that sends no table to the driver: a file
    of packed graphs is far smaller than its rows, so Spark would take it, or what is made of it, for small enough to broadcast.
    """

    def make(g: Graph, i: np.ndarray, top: np.ndarray) -> dict:
        one = {"n": g.n, "nodes": i, "u": g.u, "v": g.v, "w": g.w, "eigs": g.eigs, "fiedler": g.fiedler(), "lp": g.lp.tobytes(), "lp_diag": np.diagonal(g.lp)}
        one |= {"trace": float(np.trace(g.lp)), "kf": g.kirchhoff(), "components": g.null_modes(), "active": np.searchsorted(i, top)}
        return {k: [v] for k, v in one.items()}

    graphs = saved(packed(nodes, edges, by), "graphs")  # the contacts are searched for once
    ranked = packed_topk(graphs, active, by).groupBy(by).agg(F.sort_array(F.collect_list(F.struct("rank", "node"))).alias("_top"))  # `active` nodes a graph
    met = graphs.join(ranked.select(by, F.col("_top.node").alias("_top")).hint("merge"), by)
    return per_packed(met, make, WT, by, ("_top",))
