"""Regression trees of all folds at once, grown level by level.

Columns are binned once. The fold is a key of the histograms: one pass over the rows adds, for every node of every tree of
every fold that a level splits, the weights and residuals by column and bin, where a row counts for all folds but its own.
The partial histograms of a node meet in one task, which picks its split; the driver holds splits, never rows. So a level of
boosting is one job, and a level of a whole forest is one job for each bounded group of nodes, however many folds there are.

Rows with the same codes are the same to a tree. So where columns have few codes together, one pass adds the rows by code,
fold and tree, and trees grow on these sums; how many passes there are no longer depends on levels.

A fold's trees depend on nothing but the rows outside it (bins come from the columns alone), so they are those of a fit for
that fold only. Samples and random cuts come from hashes of row, tree and node, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from math import prod
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..storage import delete, saved_at

#: Bins of a column; bytes of histograms that a task holds; folds, and trees of all folds, that grow together; trees between two writes of the predictions.
BINS, HELD, FOLDS, TOGETHER, WRITE = 32, 128 << 20, 128, 512, 20
#: Codes of all columns together up to which rows are added by them; trees of all folds that such a fit holds.
CELLS, KEPT = 1 << 16, 10_000
#: A forest without a depth stops here.
DEEPEST = 30
#: The cumulative shares of a Poisson variable with mean 1: how often a bootstrap takes a row.
TIMES = np.cumsum([0.36787944117144233 / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)])
NOBODY = -1  # the fold of a fit that leaves no row out

STATE = "id string, fold int, y double, h long, codes binary, pred binary"
SPLITS = "fold int, tree int, node int, feature int, cut int, gain double, n double, s double, n_left double, s_left double"
GROWN = "fold int, model string, tree int, feature array<int>, cut array<int>, left array<int>, value array<double>, gain array<double>"
#: What settings of a model leave out.
DEFAULTS = {"seed": 42, "leaf": 1, "subsample": 1.0}


class Split(NamedTuple):
    """What a tree takes of a row of SPLITS."""

    node: int
    feature: int
    cut: int
    gain: float
    n: float
    s: float
    n_left: float
    s_left: float


@dataclass
class Tree:
    """Nodes by number: column and bin to split by (rows with a larger code go right), the left child (the right one follows), the mean."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, r) -> list[int]:
        """Applies a row of SPLITS; the new nodes."""
        self.value[r.node] = r.s / r.n if r.n else 0.0
        if r.feature < 0:
            return []
        at = len(self.feature)
        self.feature[r.node], self.cut[r.node], self.left[r.node], self.gain[r.node] = r.feature, r.cut, at, r.gain
        n, s = r.n - r.n_left, r.s - r.s_left
        self.feature += [-1, -1]
        self.cut += [0, 0]
        self.left += [0, 0]
        self.gain += [0.0, 0.0]
        self.value += [r.s_left / r.n_left, s / n]
        return [at, at + 1]

    def nodes_of(self, codes: np.ndarray) -> np.ndarray:
        feature, cut, left = (np.array(x, np.int32) for x in (self.feature, self.cut, self.left))
        at, going = np.zeros(len(codes), np.int32), np.arange(len(codes))
        while len(going):
            going = going[feature[at[going]] >= 0]
            here = at[going]
            at[going] = left[here] + (codes[going, feature[here]] > cut[here])
        return at

    def values_of(self, codes: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes_of(codes)]


def uniform(h: np.ndarray, *salts: int) -> np.ndarray:
    """Numbers from 0 to 1 that follow from a row's hash and salts."""
    x = h.astype(np.uint64)
    for s in salts:
        x = (x ^ np.uint64((s + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
    return (x >> np.uint64(11)).astype(float) / 2**53


def weights(h: np.ndarray, tree: int, how: dict) -> np.ndarray:
    """How often a tree takes each row."""
    if how["kind"] == "rf":
        return np.searchsorted(TIMES, uniform(h, how["seed"], tree), side="right").astype(float)
    if how["kind"] == "gbt" and how["subsample"] < 1:
        return (uniform(h, how["seed"], tree) < how["subsample"]).astype(float)
    return np.ones(len(h))


# ---------------------------------------------------------------- rows


def bins(df: DataFrame, cols: list[str]) -> list[list[float]]:
    """The inner edges of each column's bins, by its quantiles."""
    found = df.select(*[F.col(c).cast("double") for c in cols]).approxQuantile(cols, [i / BINS for i in range(1, BINS)], 0.1 / BINS)
    return [sorted(set(q)) for q in found]


def codes_of(b: pa.RecordBatch, edges: list[list[float]], first: int) -> np.ndarray:
    """The bins of a batch's columns from one on. Missing values and NaN go to the last bin."""
    return np.stack([np.searchsorted(e, b.column(i + first).to_numpy(zero_copy_only=False).astype(float)) for i, e in enumerate(edges)], 1)


def binned(df: DataFrame, cols: list[str], label: str, fold: str, id_col: str, edges: list[list[float]]) -> DataFrame:
    """Rows of STATE: a byte a column."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = codes_of(b, edges, 4).astype(np.uint8)
            none = pa.array([b""] * b.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([c.tobytes() for c in codes], pa.binary()), none], names=["id", "fold", "y", "h", "codes", "pred"])

    named = df.select(
        F.col(id_col).cast("string").alias("id"), F.col(fold).cast("int").alias("fold"), F.col(label).cast("double").alias("y"), F.xxhash64(id_col).alias("h"),
        *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)],
    )
    return named.mapInArrow(code, STATE)


def held_bytes(column: pa.Array, kind: type) -> np.ndarray:
    """All values of a binary column one after another, read where Arrow holds them."""
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(offsets, wide, len(column) + 1, column.offset * np.dtype(wide).itemsize)
    return np.frombuffer(memoryview(data)[at[0] : at[-1]] if data is not None else b"", kind)


@dataclass
class Rows:
    fold: np.ndarray
    y: np.ndarray
    h: np.ndarray
    codes: np.ndarray
    pred: np.ndarray

    @staticmethod
    def of(b: pa.RecordBatch, p: int) -> Rows:
        bytes_of = lambda c, kind: held_bytes(b.column(c), kind).reshape(b.num_rows, -1)
        number = lambda c: b.column(c).to_numpy(zero_copy_only=False)
        return Rows(number("fold"), number("y"), number("h"), bytes_of("codes", np.uint8).reshape(b.num_rows, p), bytes_of("pred", np.float64))


def advanced(state: DataFrame, p: int, folds: list[int], trees: dict[tuple[int, int], Tree], how: dict) -> DataFrame:
    """The rows with the trees' values added: of boosting for each fold, of forests for a row's own fold only."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows = Rows.of(b, p)
            pred = with_trees(rows, folds, trees, how)
            yield b.set_column(b.schema.get_field_index("pred"), "pred", pa.array([x.tobytes() for x in pred], pa.binary()))

    return state.mapInArrow(add, STATE)


def with_trees(rows: Rows, folds: list[int], trees: dict[tuple[int, int], Tree], how: dict) -> np.ndarray:
    if how["kind"] == "gbt":
        pred = rows.pred.copy()
        for (k, _), t in trees.items():
            pred[:, folds.index(k)] += how["rate"] * t.values_of(rows.codes)
        return pred
    pred = rows.pred.copy() if rows.pred.shape[1] else np.zeros((len(rows.y), 1))
    for (k, _), t in trees.items():
        own = np.flatnonzero((rows.fold == k) | (k == NOBODY))
        pred[own, 0] += t.values_of(rows.codes[own]) / how["n"]
    return pred


# ---------------------------------------------------------------- growing


def level(state: DataFrame, p: int, folds: list[int], done: dict, growing: dict, nodes: list[tuple[int, int, int]], how: dict) -> list:
    """The best splits of nodes (fold, tree, node): one pass over the rows."""
    slots: dict[tuple[int, int], dict[int, int]] = {}
    for k, t, node in nodes:
        own = slots.setdefault((k, t), {})
        own[node] = len(own)
    size = p * BINS

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {key: np.zeros((2, len(own) * size)) for key, own in slots.items()}
        lookup = {key: np.full(len(growing[key].feature), -1) for key in slots}
        for key, own in slots.items():
            lookup[key][list(own)] = list(own.values())
        place = np.arange(p) * BINS
        for b in batches:
            if not b.num_rows:
                continue
            rows = Rows.of(b, p)
            pred = with_trees(rows, folds, done, how) if how["kind"] == "gbt" else None
            for (k, t), at in lookup.items():
                w = weights(rows.h, t, how) * (rows.fold != k)
                use = np.flatnonzero(w)
                slot = at[growing[k, t].nodes_of(rows.codes[use])]
                use, slot = use[slot >= 0], slot[slot >= 0]
                target = rows.y[use] - (pred[use, folds.index(k)] if pred is not None else 0.0)
                index = (slot[:, None] * size + place + rows.codes[use]).ravel()
                each = np.repeat(w[use], p)
                mine = held[k, t]
                mine[0] += np.bincount(index, each, mine.shape[1])
                mine[1] += np.bincount(index, each * np.repeat(target, p), mine.shape[1])
        for (k, t), own in slots.items():
            for node, i in own.items():
                two = held[k, t][:, i * size : (i + 1) * size]
                if two[0].any():
                    yield pa.RecordBatch.from_pydict({"fold": pa.array([k], pa.int32()), "tree": pa.array([t], pa.int32()), "node": pa.array([node], pa.int32()), "sums": pa.array([two.tobytes()], pa.binary())})

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], np.ndarray] = {}
        for b in batches:
            for k, t, node, sums in zip(*(c.to_pylist() for c in b.columns), strict=True):
                two = np.frombuffer(sums).reshape(2, p, BINS)
                held[k, t, node] = held[k, t, node] + two if (k, t, node) in held else two
        rows = [(*key, *best_split(two, key, how)) for key, two in held.items()]
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=[x.split()[0] for x in SPLITS.split(", ")]), schema=SPLIT_SCHEMA, preserve_index=False)

    return state.mapInArrow(partial, "fold int, tree int, node int, sums binary").repartition("fold", "tree", "node").mapInArrow(split, SPLITS).collect()


SPLIT_SCHEMA = pa.schema([(x.split()[0], pa.int32() if x.endswith("int") else pa.float64()) for x in SPLITS.split(", ")])


def best_split(sums: np.ndarray, key: tuple[int, int, int], how: dict) -> tuple:
    """(feature, cut, gain, n, s, n_left, s_left) of a node's sums (weights and residuals, by column and bin). Equal gains: the first column, the lowest cut."""
    (n, s) = sums[:, 0].sum(1)
    left = np.cumsum(sums, 2)[:, :, :-1]
    n_left, s_left = left
    n_right, s_right = n - n_left, s - s_left
    fits = (n_left >= how["leaf"]) & (n_right >= how["leaf"])
    if how["kind"] == "extra":  # one random cut a column, among those with rows on both sides
        both = (n_left > 0) & (n_right > 0)
        columns = np.arange(len(n_left), dtype=np.int64)
        pick = uniform(columns * 1_000_003 + key[2], how["seed"], key[1]) * both.sum(1)
        fits &= both & (np.cumsum(both, 1) - 1 == np.floor(pick)[:, None].astype(int))
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fits, s_left**2 / n_left + s_right**2 / n_right - s * s / n, -1.0)
    most = gain.max(initial=-1.0)
    if most <= 1e-12 * max(1.0, s * s / n if n else 0.0):
        return -1, 0, 0.0, n, s, 0.0, 0.0
    f, c = np.argwhere(gain >= most * (1 - 1e-9))[0]
    return int(f), int(c), float(gain[f, c]), n, s, float(n_left[f, c]), float(s_left[f, c])


def grow(state: DataFrame, p: int, folds: list[int], keys: list[tuple[int, int]], done: dict, how: dict) -> dict[tuple[int, int], Tree]:
    """Trees (fold, number), all by the same levels. done: boosting's trees that the state does not hold yet."""
    growing = {key: Tree() for key in keys}
    at = [(*key, 0) for key in keys]
    room = max(1, HELD // (p * BINS * 16))
    for _ in range((how["depth"] or DEEPEST) if p else 0):
        below = []
        for i in range(0, len(at), room):
            for r in sorted(level(state, p, folds, done, growing, at[i : i + room], how)):  # so that nodes are numbered alike in every run
                below += [(r.fold, r.tree, node) for node in growing[r.fold, r.tree].split(r)]
        at = sorted(below)
        if not at:
            break
    return growing


def importances(gains: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    return {k: g / g.sum() if g.sum() else g for k, g in gains.items()}


# ---------------------------------------------------------------- rows of equal codes


def by_cells(edges: list[list[float]], rows: int, folds: int) -> bool:
    """Whether the cells, the codes of all columns together, are few, and fewer than the rows."""
    size = prod(len(e) + 1 for e in edges)
    return 0 < len(edges) and size <= CELLS and size * (folds + 1) <= rows


@dataclass
class Fits:
    """A model's trees (fold, number) for some folds, and what its predictions start from there."""

    how: dict
    folds: list[int]
    trees: dict[tuple[int, int], Tree]
    start: list[float]

    def values_of(self, place: int, codes: np.ndarray) -> np.ndarray:
        rate = self.how["rate"] if self.how["kind"] == "gbt" else 1 / self.how["n"]
        out = np.full(len(codes), self.start[place])
        for t in range(self.how["n"]):
            if (self.folds[place], t) in self.trees:  # so far
                out += rate * self.trees[self.folds[place], t].values_of(codes)
        return out


def places(folds: list[int], fold: np.ndarray) -> np.ndarray:
    """Where rows' folds are among some; len(folds) for other folds."""
    order = np.argsort(folds)
    at = np.minimum(np.searchsorted(np.array(folds)[order], fold), len(folds) - 1)
    return np.where(np.array(folds)[order[at]] == fold, order[at], len(folds))


def cell_sums(df: DataFrame, cols: list[str], label: str, fold: str, id_col: str, edges: list[list[float]], folds: list[int], picked: list[tuple[dict, int]]) -> DataFrame:
    """(place, cell, sums): for each fold left out and each cell, over the rows outside the fold, the weights and weighted labels of picked trees. One pass over the rows."""
    widths, outside = [len(e) + 1 for e in edges], len(folds)
    size, schema, names = prod(widths), "place int, cell int, sums array<double>", ["place", "cell", "sums"]

    def told(place: np.ndarray, cell: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(np.arange(len(sums) + 1, dtype=np.int32) * sums.shape[1], pa.array(sums.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(cell.astype(np.int32)), lists], names)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2 * len(picked), (outside + 1) * size))
        for b in batches:
            if not b.num_rows:
                continue
            fold, y, h = (b.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            at = places(folds, fold) * size + np.ravel_multi_index(codes_of(b, edges, 3).T, widths)
            for i, (how, t) in enumerate(picked):
                w = weights(h, t, how)
                use = np.flatnonzero(w)
                np.add.at(held[2 * i], at[use], w[use])
                np.add.at(held[2 * i + 1], at[use], w[use] * y[use])
        found = np.flatnonzero(held[::2].any(0))
        for a in range(0, len(found), 10_000):
            some = found[a : a + 10_000]
            yield told(some // size, some % size, held[:, some].T)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, total = np.zeros(0, np.int32), np.zeros((0, outside + 1, 2 * len(picked)))
        for b in batches:
            place, cell = (b.column(c).to_numpy() for c in ("place", "cell"))
            every = np.union1d(cells, cell)
            if len(every) > len(cells):
                wider = np.zeros((len(every), *total.shape[1:]))
                wider[np.searchsorted(every, cells)] = total
                cells, total = every, wider
            np.add.at(total, (np.searchsorted(cells, cell), place), b.column("sums").flatten().to_numpy().reshape(len(cell), -1))
        for k in range(outside):
            sums = np.delete(total, k, 1).sum(1)
            found = np.flatnonzero(sums[:, ::2].any(1))
            if len(found):
                yield told(np.full(len(found), k), cells[found], sums[found])

    named = df.select(
        F.col(fold).cast("int").alias("fold"), F.col(label).cast("double").alias("y"), F.xxhash64(id_col).alias("h"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]
    )
    return named.mapInArrow(partial, schema).repartition("cell").mapInArrow(rest, schema)


def grow_on_cells(codes: np.ndarray, n: np.ndarray, s: np.ndarray, key: tuple[int, int], how: dict) -> Tree:
    """A tree (fold, number) from the sums of cells: weights and residuals."""
    tree, at, p = Tree(), [0], codes.shape[1]
    column, room = np.arange(p) * BINS, max(1, HELD // (p * BINS * 16))
    for _ in range(how["depth"] or DEEPEST):
        own, below = tree.nodes_of(codes), []
        for i in range(0, len(at), room):
            some = at[i : i + room]
            slot = np.full(len(tree.feature), -1)
            slot[some] = np.arange(len(some))
            use = np.flatnonzero((slot[own] >= 0) & (n != 0))
            index = (slot[own[use], None] * p * BINS + column + codes[use]).ravel()
            two = np.stack([np.bincount(index, np.repeat(x[use], p), len(some) * p * BINS).reshape(-1, p, BINS) for x in (n, s)], 1)
            below += [x for node, sums in zip(some, two, strict=True) if sums[0].any() for x in tree.split(Split(node, *best_split(sums, (*key, node), how)))]
        at = below
        if not at:
            break
    return tree


def grower(fits: dict[str, Fits], numbers: list[tuple[str, int]], widths: list[int]):
    """What makes of the sums of a fold's cells the next trees (model, number) of some models."""

    def grown(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("cell")
        codes, sums = np.stack(np.unravel_index(f["cell"].to_numpy(), widths), 1), np.stack(f["sums"])
        pred, out = {}, []
        for j, (name, t) in enumerate(numbers):
            fit, n, s = fits[name], sums[:, 2 * j], sums[:, 2 * j + 1]
            k = fit.folds[key[0]]
            if fit.how["kind"] == "gbt":
                if name not in pred:
                    pred[name] = fit.values_of(key[0], codes)
                s = s - n * pred[name]
            tree = grow_on_cells(codes, n, s, (k, t), fit.how)
            if fit.how["kind"] == "gbt":
                pred[name] = pred[name] + fit.how["rate"] * tree.values_of(codes)
            out.append((k, name, t, tree.feature, tree.cut, tree.left, tree.value, tree.gain))
        return pd.DataFrame(out, columns=[x.split()[0] for x in GROWN.split(", ")])

    return grown


def fit_on_cells(df: DataFrame, cols: list[str], label: str, fold: str, id_col: str, hows: dict[str, dict], left_out: list[int], edges: list[list[float]]) -> dict[str, Fits]:
    """The trees of several models for the folds left out: a pass over the rows for as many trees as a task can hold the sums of, and a task a fold that grows them."""
    hows = {name: DEFAULTS | how for name, how in hows.items()}
    own = {r[0]: (r.n, r.s) for r in df.groupBy(F.col(fold).cast("int")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("double")).alias("s")).collect()}  # a row a fold
    n, s = (sum(x[i] or 0 for x in own.values()) for i in (0, 1))
    means = [(s - (own.get(k, (0, 0))[1] or 0)) / max(1, n - own.get(k, (0, 0))[0]) for k in left_out]
    fits = {name: Fits(how, left_out, {}, means if how["kind"] == "gbt" else [0.0] * len(left_out)) for name, how in hows.items()}
    numbers = [(name, t) for name, how in hows.items() for t in range(how["n"])]
    widths = [len(e) + 1 for e in edges]
    each = max(1, HELD // (16 * (len(left_out) + 1) * prod(widths)))
    for i in range(0, len(numbers), each):
        some = numbers[i : i + each]
        sums = cell_sums(df, cols, label, fold, id_col, edges, left_out, [(hows[name], t) for name, t in some])
        made = sums.groupBy("place").applyInPandas(grower({name: replace(f, trees=dict(f.trees)) for name, f in fits.items()}, some, widths), GROWN).collect()
        for r in made:
            fits[r.model].trees[r.fold, r.tree] = Tree(r.feature, r.cut, r.left, r.value, r.gain)
    return fits


def predicted(df: DataFrame, cols: list[str], fold: str, fits: dict[str, Fits], edges: list[list[float]]) -> DataFrame:
    """Adds the predictions of each model for a row's fold: rows of folds that were not left out have none."""
    widths, wide, folds = [len(e) + 1 for e in edges], len(df.columns), next(iter(fits.values())).folds
    size, schema = prod(widths), StructType([*df.schema.fields, *[StructField(c, DoubleType()) for c in fits]])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {name: np.full(len(folds) * size, np.nan) for name in fits}  # a cell is predicted once a task
        for b in batches:
            place = places(folds, b.column(wide).to_numpy(zero_copy_only=False)) if folds != [NOBODY] else np.zeros(b.num_rows, int)
            here = np.flatnonzero(place < len(folds))
            at = (place * size + np.ravel_multi_index(codes_of(b, edges, wide + 1).T, widths))[here]
            out = []
            for name, f in fits.items():
                new = np.unique(at[np.isnan(known[name][at])])
                for k in np.unique(new // size):
                    own = new[new // size == k]
                    known[name][own] = f.values_of(int(k), np.stack(np.unravel_index(own % size, widths), 1))
                values = np.full(b.num_rows, np.nan)
                values[here] = known[name][at]
                out.append(pa.array(values, mask=place >= len(folds)))
            yield pa.RecordBatch.from_arrays([*b.columns[:wide], *out], names=schema.names)

    more = [F.col(fold).cast("int").alias("_place"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)]]
    return df.select("*", *more).mapInArrow(add, schema)


# ---------------------------------------------------------------- all folds


def fit_folds(df: DataFrame, cols: list[str], label: str, fold: str, id_col: str, how: dict, left_out: list[int], edges: list[list[float]] | None = None) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """(id, fold, y, yhat) of the rows in the folds left out, each by the trees that never saw its fold, and the columns' importances by fold.

    how: kind (gbt, rf or extra), n, depth, leaf, seed, and for gbt rate and subsample. left_out may be [NOBODY]: one fit on
    all rows, which then predicts them.
    """
    how = DEFAULTS | how
    edges = edges if edges is not None else bins(df, cols)
    if left_out and by_cells(edges, df.count(), len(left_out)):
        return _fit_cells(df, cols, label, fold, id_col, how, left_out, edges)
    spark, p = df.sparkSession, len(cols)
    start, path = saved_at(binned(df, cols, label, fold, id_col, edges), "binned")
    parts, gains = [], {}
    try:
        for i in range(0, len(left_out), FOLDS):
            some = left_out[i : i + FOLDS]
            out, gain = _fit(spark, start, p, some, how)
            parts.append(out)
            gains |= gain
    finally:
        delete(spark, path)
    every = parts[0] if parts else start.limit(0).select("id", "fold", "y", F.lit(0.0).alias("yhat"))
    for more in parts[1:]:
        every = every.unionByName(more)
    return every.withColumn("id", F.col("id").cast(dict(df.dtypes)[id_col])).withColumnRenamed("id", id_col), importances(gains)


def share(tree: Tree, p: int) -> np.ndarray:
    """Each column's share of a tree's gains."""
    one = np.zeros(p)
    for f, g in zip(tree.feature, tree.gain, strict=True):
        if f >= 0:
            one[f] += g
    return one / one.sum() if one.sum() else np.zeros(p)


def _fit_cells(df: DataFrame, cols: list[str], label: str, fold: str, id_col: str, how: dict, left_out: list[int], edges: list[list[float]]) -> tuple[DataFrame, dict[int, np.ndarray]]:
    each = max(1, min(FOLDS, KEPT // how["n"], HELD // (16 * prod(len(e) + 1 for e in edges)) - 1))
    parts, gains = [], {}
    for i in range(0, len(left_out), each):
        some = left_out[i : i + each]
        fits = fit_on_cells(df, cols, label, fold, id_col, {"yhat": how}, some, edges)
        rows = df.select(id_col, F.col(fold).cast("int").alias("fold"), F.col(label).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
        asked = rows if some == [NOBODY] else rows.where(F.col("fold").isin(some))
        parts.append(predicted(asked, [f"x{i}" for i in range(len(cols))], "fold", fits, edges).select(id_col, "fold", "y", "yhat"))
        for k in some:
            gains[k] = sum((share(t, len(cols)) for (f, _), t in fits["yhat"].trees.items() if f == k), np.zeros(len(cols)))
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return every, importances(gains)


def _fit(spark, start: DataFrame, p: int, folds: list[int], how: dict) -> tuple[DataFrame, dict[int, np.ndarray]]:
    gains = {k: np.zeros(p) for k in folds}
    path = None

    def write(df: DataFrame) -> DataFrame:
        nonlocal path
        back, new = saved_at(df, "trees")
        if path:
            delete(spark, path)
        path = new
        return back

    if how["kind"] == "gbt":
        own = {r.fold: (r.n, r.s) for r in start.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("s")).collect()}  # a row a fold
        n, s = (sum(x[i] or 0 for x in own.values()) for i in (0, 1))
        means = [(s - (own.get(k, (0, 0))[1] or 0)) / max(1, n - own.get(k, (0, 0))[0]) for k in folds]
        state = write(start.withColumn("pred", F.lit(np.array(means).tobytes())))
        steps = [[t] for t in range(how["n"])]
    else:
        state = start
        size = max(1, TOGETHER // len(folds))
        steps = [list(range(t, min(t + size, how["n"]))) for t in range(0, how["n"], size)]
    recent: dict[tuple[int, int], Tree] = {}
    for i, numbers in enumerate(steps):
        made = grow(state, p, folds, [(k, t) for t in numbers for k in folds], recent, how)
        for (k, _), t in made.items():
            gains[k] += share(t, p)
        recent |= made
        if how["kind"] != "gbt" or len(recent) >= WRITE * len(folds) or i == len(steps) - 1:
            state = write(advanced(state, p, folds, recent, how))
            recent = {}

    column = {k: i for i, k in enumerate(folds)}

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows = Rows.of(b, p)
            at = np.array([column.get(k, 0) for k in rows.fold]) if how["kind"] == "gbt" else np.zeros(len(rows.y), int)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("fold"), b.column("y"), pa.array(rows.pred[np.arange(len(at)), at])], names=["id", "fold", "y", "yhat"])

    asked = state if folds == [NOBODY] else state.where(F.col("fold").isin(folds))
    return asked.mapInArrow(last, "id string, fold int, y double, yhat double"), gains
