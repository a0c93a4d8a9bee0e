"""Nearest neighbours by inner product with an inverted multi-index.

The two halves of a vector are quantised separately, so the pairs of their centroids are cells that hold the rows. A
query ranks the centroids of each half and walks the pairs in the order of their summed nearness with a heap, until the
cells it has met hold the asked share of all rows; their rows are reranked with the whole vectors in double precision. A
share of 1 is exact search. On vectors without structure, which no index prunes well, SHARE finds 0.9 of the nearest.

Codebooks are fitted on a bounded sample, SAMPLE rows or PER_CENTROID for each centroid; their centroids grow with the
fourth root of the rows. All rows are indexed, and the index is written once. Only the counts of the cells come to the
driver, so some square root of the rows. They deal the cells to shards of some BLOCK rows, a large cell to several;
queries meet shards in blocks too, so that a group holds bounded numbers of both, and each gives the best of its own rows.

Defined results: rows with null ids, and vectors that are null, empty, zero, hold null or non-finite values or are of
another than the most frequent dimension take no part. Of repeated query ids one row is answered; other repeated rows are
candidates each. Equal scores go to the smaller id. With few rows (LEAST) or fewer the search is exact.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Centroids of a half for ROWS rows or fewer.
CENTROIDS, ROWS = 64, 50_000
SHARE = 0.42
SAMPLE, PER_CENTROID = 20_000, 40
BLOCK = 8192
QUERIES = 4096
#: Queries whose walks a task does.
WALKS = 128
LEAST = 1024


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of at most k clusters; empty clusters keep their place."""
    c = x[np.random.default_rng(0).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)


def walk(one: np.ndarray, other: np.ndarray, sizes: np.ndarray, wanted: int) -> list[int]:
    """Cells, numbered i * len(other) + j, by falling one[i] + other[j], until they hold the wanted rows. Empty ones are left out."""
    a, b = np.argsort(-one, kind="stable").tolist(), np.argsort(-other, kind="stable").tolist()
    x, y, n = one.tolist(), other.tolist(), sizes.tolist()
    width, met, cells = len(b), 0, []
    heap = [(-(x[a[0]] + y[b[0]]), 0, 0)]
    while heap and met < wanted:
        _, i, j = heapq.heappop(heap)
        cell = a[i] * width + b[j]
        if n[cell]:
            met += n[cell]
            cells.append(cell)
        if j + 1 < width:
            heapq.heappush(heap, (-(x[a[i]] + y[b[j + 1]]), i, j + 1))
        if not j and i + 1 < len(a):
            heapq.heappush(heap, (-(x[a[i + 1]] + y[b[0]]), i + 1, 0))
    return cells


def best(ids: np.ndarray, rows: np.ndarray, own: int, query: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of one query among rows with rough scores (-inf: not met), by exact score and id."""
    rough = np.where(ids == own, -np.inf, rough)
    if len(rough) > k:
        limit = np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-9 * (1 + abs(rough[np.isfinite(rough)]).max(initial=0.0))
        keep = np.flatnonzero((rough >= limit) & np.isfinite(rough))
    else:
        keep = np.flatnonzero(np.isfinite(rough))
    exact = (rows[keep] * query).sum(1)
    order = np.lexsort((ids[keep], -exact))[:k]
    return ids[keep][order], exact[order]


def search(vectors: DataFrame, is_query: Column, k: int = 20, centroids: int = CENTROIDS, share: float = SHARE, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall("_v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("_v", lambda x: x != 0)
    named = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("_v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(F.col("id").isNotNull() & F.col("_v").isNotNull())
    sound = named.where(finite)
    found = sorted(((r["count"], r.d) for r in sound.groupBy(F.size("_v").alias("d")).count().collect()), reverse=True)
    if not found:
        return spark.createDataFrame([], schema)
    total, dim = found[0]
    sound = sound.where(F.size("_v") == dim)
    wide = max(centroids, round(centroids * (total / ROWS) ** 0.25))
    rows = max(SAMPLE, PER_CENTROID * wide)
    chosen = F.pmod(F.xxhash64("id", "_v"), F.lit(1_000_000)) < int(1e6 * min(1.0, rows / total)) + 1
    sample = np.array(sorted(r._v for r in sound.where(chosen).select("_v").limit(2 * rows).collect()) or [r._v for r in sound.limit(1).collect()])
    half = max(1, dim // 2)
    parts = (slice(0, half), slice(half, dim)) if dim > 1 else (slice(0, 1), slice(0, 0))
    books = [k_means(sample[:, p], wide if p.stop > p.start else 1) for p in parts]
    width = len(books[1])

    def cells_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k0 in range(0, len(f), 1024):
                some = f.iloc[k0 : k0 + 1024]
                x = np.stack(some["_v"].to_numpy())
                cell = nearest(x[:, parts[0]], books[0]) * width + nearest(x[:, parts[1]], books[1])
                yield pd.DataFrame({"id": some["id"], "cell": cell.astype(np.int32), "v": [r.tobytes() for r in x], "q": some["q"]})

    index = written(sound.mapInPandas(cells_of, "id long, cell int, v binary, q boolean"), "index")
    sizes = np.zeros(len(books[0]) * width, np.int64)
    for r in index.groupBy("cell").count().collect():  # a row a cell
        sizes[r.cell] = r["count"]
    wanted = max(math.ceil(share * total), min(total, LEAST))
    # small cells share a shard, large ones have several
    first, split, shard, load = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for c in np.flatnonzero(sizes):
        if load and load + sizes[c] > block:
            shard, load = shard + 1, 0
        first[c], split[c] = shard, max(1, math.ceil(sizes[c] / block))
        load += sizes[c]
        if split[c] > 1:
            shard, load = shard + split[c], 0
    once = index.where("q").groupBy("id").agg(F.min("v").alias("v"))
    asked = once.count()
    groups = max(1, math.ceil(asked / QUERIES))
    layout = spark.createDataFrame([(int(c), int(first[c]), int(split[c])) for c in np.flatnonzero(sizes)], "cell int, first long, split long")
    rows = (
        index.join(F.broadcast(layout), "cell")
        .select("id", "cell", "v", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("split"))).alias("shard"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    )

    def routes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each query and shard it visits, with the cells it visits there."""
        for f in frames:
            out: list[tuple] = []
            for name, raw in zip(f["id"], f["v"], strict=True):
                x = np.frombuffer(raw)
                cells = np.array(walk(books[0] @ x[parts[0]], books[1] @ x[parts[1]], sizes, wanted), np.int32)
                on = np.repeat(cells, split[cells])
                shards = np.repeat(first[cells], split[cells]) + np.concatenate([np.arange(s) for s in split[cells]])
                order = np.argsort(shards, kind="stable")
                cuts = np.flatnonzero(np.diff(shards[order])) + 1
                for c, s in zip(np.split(on[order], cuts), np.split(shards[order], cuts), strict=True):
                    out.append((name, raw, int(s[0]), c.tobytes()))
            yield pd.DataFrame(out, columns=["id", "v", "shard", "cells"])

    visits = once.repartition(max(1, math.ceil(asked / WALKS)), "id").mapInPandas(routes, "id long, v binary, shard long, cells binary").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))

    def rerank(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(queries) and len(held):
            ids, x = held["id"].to_numpy(), np.frombuffer(b"".join(held["v"])).reshape(len(held), -1)
            names, local = np.unique(held["cell"].to_numpy(), return_inverse=True)
            for k0 in range(0, len(queries), 128):
                some = queries.iloc[k0 : k0 + 128]
                q = np.frombuffer(b"".join(some["v"])).reshape(len(some), -1)
                met = np.stack([np.isin(names, np.frombuffer(c, np.int32)) for c in some["cells"]])
                rough = np.where(met[:, local], q @ x.T, -np.inf)
                for name, y, r in zip(some["id"], q, rough, strict=True):
                    got, score = best(ids, x, name, y, r, k)
                    out.append(pd.DataFrame({"query_id": name, "vec_id": got, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    near = visits.groupBy("shard", "part").cogroup(rows.groupBy("shard", "part")).applyInPandas(rerank, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
