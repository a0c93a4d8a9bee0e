"""Vector code compression: product codes whose codebooks come from a dual-tree Lloyd iteration.

Vectors become whole numbers, written once, and are cut into equal parts; each part position has a codebook of entries.
In every round a task builds trees of median splits over the parts of its rows, batch by batch, and over the entries. It
walks pairs of nodes, one of either tree, from the roots down. The least and the
greatest distance of two nodes' boxes, in whole numbers, prune combinations: entries farther than another entry's
greatest distance can be nobody's nearest. Where one entry is left, the whole node is assigned by its count and its
cached sum; where several are left at a leaf, squared distances in whole numbers decide, ties to the lower index. Tasks
return a sum and a count for each entry; Spark adds them, and the driver holds the codebooks alone (entries x width).

The bounds are exact, so the result is that of a plain Lloyd iteration, whatever they prune.

Defined results: vectors that are null or hold null or non-finite components are dropped. Vectors of several lengths are
filled up with zeros to the longest, and that to a multiple of the parts. Whole numbers are kept within a bound (BITS) so
that all squared distances fit a long: components beyond some 100,000 count as that bound. Of rows with one vec_id the
smaller vector comes first as a starting entry; null ids come last. With fewer rows than entries there are fewer entries.
An empty table gives an empty one. Errors of a label that do not fit a long are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table_of, written

#: Rows of a leaf of the tree over parts; the tree over entries goes down to single ones.
LEAF = 64
#: A sum of squared distances over a whole vector stays below 2 to this power.
BITS = 62
#: Salts that deal the rows of one label to several tasks.
SALTS = 32


@dataclass(frozen=True)
class Settings:
    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024


# ---------------------------------------------------------------- trees


class Tree:
    """Rows (n, w) of whole numbers in the order of median splits, with the box, count and sum of every node.

    A node is a run of rows [start, end); children halve it. Nodes are numbered level by level, so that a level is a slice.
    """

    def __init__(self, rows: np.ndarray, leaf: int):
        self.rows = rows
        spans, level = [(0, len(rows))], [(0, len(rows))]
        kids: list[tuple[int, int]] = []
        while level:
            below = []
            for a, b in level:
                if b - a > leaf:
                    kids.append((len(spans) + len(below), 2))
                    mid = (a + b) // 2
                    below += [(a, mid), (mid, b)]
                else:
                    kids.append((0, 0))
            spans += below
            level = below
        self.start, self.end = (np.array(x) for x in zip(*spans, strict=True))
        self.kid, self.n_kids = (np.array(x) for x in zip(*kids, strict=True))
        # boxes and sums of leaves are read off the rows, those of other nodes off their children
        n, w = len(spans), rows.shape[1]
        self.lo, self.hi, self.sum = np.empty((n, w), np.int64), np.empty((n, w), np.int64), np.empty((n, w), np.int64)
        ends = np.flatnonzero(self.n_kids == 0)
        ends = ends[np.argsort(self.start[ends])]
        cuts = self.start[ends]
        self.lo[ends], self.hi[ends] = np.minimum.reduceat(rows, cuts), np.maximum.reduceat(rows, cuts)
        self.sum[ends] = np.add.reduceat(rows, cuts)
        for i in np.flatnonzero(self.n_kids)[::-1]:
            a = self.kid[i]
            self.lo[i], self.hi[i], self.sum[i] = np.minimum(self.lo[a], self.lo[a + 1]), np.maximum(self.hi[a], self.hi[a + 1]), self.sum[a] + self.sum[a + 1]


def split_order(rows: np.ndarray, leaf: int) -> np.ndarray:
    """The order in which Tree takes rows: runs halved by the median of their widest component."""
    order = np.arange(len(rows))
    todo = [(0, len(rows))]
    while todo:
        a, b = todo.pop()
        if b - a <= leaf:
            continue
        mid, own = (a + b) // 2, rows[order[a:b]]
        axis = int((own.max(0) - own.min(0)).argmax())
        order[a:b] = order[a:b][np.argpartition(own[:, axis], mid - a)]
        todo += [(a, mid), (mid, b)]
    return order


# ---------------------------------------------------------------- assignment


def gaps(lo_a, hi_a, lo_b, hi_b) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance between points of two boxes, in whole numbers."""
    apart = np.maximum(np.maximum(lo_a - hi_b, lo_b - hi_a), 0)
    across = np.maximum(hi_a - lo_b, hi_b - lo_a)
    return np.einsum("ij,ij->i", apart, apart), np.einsum("ij,ij->i", across, across)


class Book:
    """A part position's entries with the tree over them."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.order = split_order(entries, 1)
        self.tree = Tree(entries[self.order], 1)  # down to single entries
        self.norm = np.einsum("ij,ij->i", entries, entries)


def assign(parts: Tree, book: Book) -> tuple[list[tuple[int, int]], list[tuple[int, int, np.ndarray, np.ndarray]]]:
    """Nodes assigned whole (node, entry), and leaves decided row by row (start, end, entries of the rows, squared distances)."""
    whole, byrow = [], []
    p, e = np.zeros(1, np.int64), np.zeros(1, np.int64)  # pairs of nodes, sorted by the parts' node
    entries = book.tree
    while len(p):
        near, far = gaps(parts.lo[p], parts.hi[p], entries.lo[e], entries.hi[e])
        first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        best = np.minimum.reduceat(far, first)
        length = np.diff(np.r_[first, len(p)])
        keep = near <= np.repeat(best, length)
        p, e = p[keep], e[keep]
        single = entries.n_kids[e] == 0
        first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        length = np.diff(np.r_[first, len(p)])
        settled = np.logical_and.reduceat(single, first)  # only single entries are left
        one = settled & ((length == 1) | (parts.lo[p[first]] == parts.hi[p[first]]).all(1))  # or all rows are equal: then all that is left ties
        for i in np.flatnonzero(one):
            tied = e[first[i] : first[i] + length[i]]
            whole.append((int(p[first[i]]), int(book.order[entries.start[tied]].min())))
        leaf = parts.n_kids[p[first]] == 0
        for i in np.flatnonzero(settled & leaf & ~one):
            node = int(p[first[i]])
            a, b = int(parts.start[node]), int(parts.end[node])
            cand = np.sort(book.order[entries.start[e[first[i] : first[i] + length[i]]]])
            d = squared(parts.rows[a:b], book.entries[cand], book.norm[cand])
            at = d.argmin(1)  # the first of equals is the lower index
            byrow.append((a, b, cand[at], d[np.arange(b - a), at]))
        on = np.repeat(~one & ~(settled & leaf), length)
        p, e = p[on], e[on]
        # both sides of a pair go down, a side at its end stays
        for tree, side in ((parts, 0), (entries, 1)):
            own = (p, e)[side]
            n = np.maximum(tree.n_kids[own], 1)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            down = np.where(np.repeat(tree.n_kids[own] > 0, n), np.repeat(tree.kid[own], n) + step, np.repeat(own, n))
            other = np.repeat((e, p)[side], n)
            p, e = (down, other) if side == 0 else (other, down)
        order = np.argsort(p, kind="stable")
        p, e = p[order], e[order]
    return whole, byrow


def squared(rows: np.ndarray, entries: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Squared distances in whole numbers. Where all of them stay far below 2^53, doubles hold them exactly and multiply faster."""
    top = max(int(np.abs(rows).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * rows.shape[1] * top * top < 2**52 else np.int64
    x, y = rows.astype(kind), entries.astype(kind)
    return (np.einsum("ij,ij->i", x, x)[:, None] - 2 * (x @ y.T) + norm.astype(kind)).astype(np.int64)


# ---------------------------------------------------------------- jobs


def finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))


def prepared(vectors: DataFrame, settings: Settings, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, int]:
    """(vec_id, label, _x: whole numbers, all of one width), and the width of a part."""
    kept = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("_v")).where(finite(F.col("_v")))
    longest = kept.agg(F.max(F.size("_v"))).first()[0] or 0
    part = max(1, -(-longest // settings.parts))
    bound = int((2**BITS / (part * settings.parts)) ** 0.5) // 2
    whole = lambda x: F.greatest(F.lit(-bound), F.least(F.lit(bound), F.floor(x.cast("double") * settings.scale))).cast("long")
    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(part * settings.parts) - F.size("_v"))
    return kept.select("vec_id", "label", F.concat(F.transform("_v", whole), zeros).alias("_x")), part


def numbers(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    """The column _x of a batch as rows x parts x width."""
    return batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, parts, -1)


def trees(x: np.ndarray) -> Iterator[tuple[int, np.ndarray, Tree]]:
    """For each part position the order of the rows in its tree, and the tree."""
    for at in range(x.shape[1]):
        order = split_order(x[:, at], LEAF)
        yield at, order, Tree(x[order, at], LEAF)


def moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The entries after one round: means of the parts assigned to them, rounded down; unused entries stay."""
    parts, k, width = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)  # parts x entries x width, whatever the table holds

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = [Book(b) for b in shared.value if len(b)]
        total, count = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            for at, _, tree in trees(numbers(batch, parts)):
                whole, byrow = assign(tree, mine[at])
                for node, entry in whole:
                    total[at, entry] += tree.sum[node]
                    count[at, entry] += tree.end[node] - tree.start[node]
                for a, b, entries, _ in byrow:
                    np.add.at(total[at], entries, tree.rows[a:b])
                    count[at] += np.bincount(entries, minlength=k)
        at, entry = np.nonzero(count)
        yield rows_of(at, entry, count[at, entry], total[at, entry])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # all rows of an entry come to one task: one from each task before
        total, count = np.zeros((parts * k, width), np.int64), np.zeros(parts * k, np.int64)
        for batch in batches:
            at = batch.column("part").to_numpy() * k + batch.column("entry").to_numpy()
            np.add.at(total, at, batch.column("total").flatten().to_numpy().reshape(-1, width))
            np.add.at(count, at, batch.column("n").to_numpy())
        at = np.flatnonzero(count)
        yield rows_of(at // k, at % k, count[at], total[at])

    def rows_of(at, entry, n, total) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"part": at.astype(np.int32), "entry": entry.astype(np.int32), "n": n, "total": pa.array(list(total), pa.list_(pa.int64()))})

    schema = "part int, entry int, n long, total array<long>"
    found = rows.select("_x").mapInArrow(sums, schema).repartition("part", "entry").mapInArrow(added, schema).collect()  # a row an entry
    new = books.copy()
    for r in found:
        new[r.part, r.entry] = np.array(r.total, np.int64) // r.n  # rounds down, below zero too
    return new


def encoded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every row under the entries."""
    parts, _, _ = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = [Book(b) for b in shared.value if len(b)]
        for batch in batches:
            n = batch.num_rows
            code, error = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
            for at, order, tree in trees(numbers(batch, parts)) if n else ():
                entry, apart = np.zeros(n, np.int64), np.zeros(n, np.int64)
                whole, byrow = assign(tree, mine[at])
                for node, e in whole:
                    a, b = tree.start[node], tree.end[node]
                    off = tree.rows[a:b] - mine[at].entries[e]
                    entry[a:b], apart[a:b] = e, np.einsum("ij,ij->i", off, off)
                for a, b, entries, d in byrow:
                    entry[a:b], apart[a:b] = entries, d
                code[order, at] = entry
                error[order] += apart
            named = {"vec_id": batch.column("vec_id"), "label": batch.column("label"), "code": [c.tobytes().hex() for c in code], "error": error}
            yield pa.RecordBatch.from_pydict(named)

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(codes, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compress(vectors: DataFrame, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code: two hex digits a part, error: squared distance), written, and the codebooks (parts x entries x width)."""
    if settings.entries > 256:
        raise ValueError("a code has one byte a part: 256 entries at most")
    made, width = prepared(vectors, settings, id_col, vector_col, label_col)
    with table_of(made, "whole-vectors") as rows:
        seeds = rows.orderBy(F.asc_nulls_last("vec_id"), "_x").limit(settings.entries).select("_x").collect()
        books = np.array([r._x for r in seeds], np.int64).reshape(len(seeds), settings.parts, width).transpose(1, 0, 2).copy()
        for _ in range(settings.rounds if len(seeds) else 0):
            books = moved(rows, books)
        return written(encoded(rows, books), "codes"), books


def decoded(codes: DataFrame, books: np.ndarray, scale: int = 1024, code_col: str = "code", out: str = "vector") -> DataFrame:
    """Adds the vector that a code stands for: its entries one after the other, at the middle of the steps of 1 / scale."""
    middle = (books + 0.5) / scale

    @F.pandas_udf("array<double>")
    def vector(code: pd.Series) -> pd.Series:
        return pd.Series([np.concatenate([middle[at, e] for at, e in enumerate(bytes.fromhex(c))]) for c in code])

    return codes.withColumn(out, vector(F.col(code_col)))


def with_label_error(codes: DataFrame) -> DataFrame:
    """Adds label_error: the errors of all rows with the same label, nulls together. The rows of a label meet its sum in many tasks."""
    sums = codes.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    copies = sums.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = codes.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(SALTS)).cast("int"))
    met = dealt.join(copies, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_s")), "left")
    return met.drop("_label", "_s", "_salt")


def digest(books: np.ndarray) -> str:
    """sha256 of all components as decimal numbers, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
