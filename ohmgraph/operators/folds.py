"""Cross-validation folds as tables (id, fold). Ranks are taken in small ranges of a key and offset by the counts before."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..storage import saved
from .sampling import shuffle_key

ID = "mutation_id"


def ranked(df: DataFrame, by: list[str], bucket: Column, order: list[str], out: str) -> DataFrame:
    """Adds out: a row's place, from 0, in the order of by, bucket and then order. No task gets more than a bucket of a group."""
    kept = df.withColumn("_b", bucket)
    keys = [*by, "_b"]
    counts = kept.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = W.orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")  # a row a group and bucket
    inside = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    return kept.withColumn(out, inside).join(offsets, keys).withColumn(out, (F.col(out) + F.col("_before")).cast("long")).drop("_b", "_before")


def shuffled_rank(df: DataFrame, by: list[str], seed: int, id_col: str, digits: int = 3) -> DataFrame:
    """Adds _rank: a row's place, from 0, in a shuffled order of each group in turn.

    Without groups the rows are written once in their buckets' order, and a place is the distance from the bucket's first
    row. The key's first 15 digits are sorted as a number; the rest of it is made only where they are equal.
    """
    key = shuffle_key(id_col, seed)
    if by:
        return ranked(df.withColumn("_k", key), by, F.substring("_k", 1, digits), ["_k", id_col], "_rank").drop("_k")
    high = F.coalesce(F.conv(F.substring(key, 1, 15), 16, 10).cast("long"), F.lit(1 << 60))  # rows without an id come last
    kept = df.withColumn("_h", high).withColumn("_b", F.shiftright("_h", 60 - 4 * digits).cast("int"))
    lined = kept.repartition("_b").sortWithinPartitions("_h", key, id_col).drop("_h").withColumn("_at", F.monotonically_increasing_id())
    held = saved(lined, "lined")
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    buckets = held.groupBy("_b").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    offsets = buckets.select("_b", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset"))  # a row a bucket
    return held.join(F.broadcast(saved(offsets, "offsets")), "_b").withColumn("_rank", F.col("_at") + F.col("_offset")).drop("_b", "_at", "_offset")


def counted_values(df: DataFrame, col: str, by: list[str], size: int = 200_000) -> DataFrame:
    """(by, value, _n, _before): each distinct value of a group, how many rows have it and how many have a smaller one.

    Rows are counted by value before anything is ranked, so equal values cost one row.
    """
    return counted_before(df.groupBy(F.col(col).alias("value"), *by).agg(F.count("*").alias("_n")), by, size).select(*by, "value", "_n", "_before")


def counted_before(values: DataFrame, by: list[str], size: int = 200_000) -> DataFrame:
    """Adds _before to a table of the distinct values of groups: the sum of _n over a group's smaller values.

    Ranges of some `size` values are sorted, values before groups, since those hardly tell rows apart. Running sums of each
    group go through a range in a task, and what earlier ranges hold of the group is added to them.
    """

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far: dict[tuple, int] = {}
        for b in batches:
            n = b.column("_n").to_numpy()
            code = np.zeros(len(n), np.int64)
            for c in by:
                d = b.column(c).dictionary_encode()
                code = code * (len(d.dictionary) + 1) + d.indices.fill_null(len(d.dictionary)).to_numpy(zero_copy_only=False)
                code = np.unique(code, return_inverse=True)[1]  # numbers stay small, however many columns there are
            _, first, at = np.unique(code, return_index=True, return_inverse=True)
            keys = [tuple(repr(b.column(c)[int(i)].as_py()) for c in by) for i in first]
            sums = np.array([so_far.get(k, 0) for k in keys], np.int64)
            ends = sums[at] + pd.Series(n).groupby(at).cumsum().to_numpy()
            np.add.at(sums, at, n)
            so_far.update(zip(keys, sums.tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends - n, pa.int64())], names=[*b.schema.names, "_in"])

    values = saved(values, "values")
    ranges = max(1, math.ceil(values.count() / size))
    lined = values.repartitionByRange(ranges, "value", *by).sortWithinPartitions("value", *by).withColumn("_p", F.spark_partition_id())
    held = saved(lined.mapInArrow(running, StructType([*lined.schema.fields, StructField("_in", LongType())])), "ranges")
    parts = held.groupBy("_p", *by).agg(F.sum("_n").alias("_all"))  # a row a range and group in it
    earlier = F.coalesce(F.sum("_all").over(W.partitionBy(*by).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = saved(parts.select(F.col("_p").alias("_op"), *[F.col(c).alias(f"_o{c}") for c in by], earlier.alias("_offset")), "offsets")
    same = [F.col("_p") == F.col("_op"), *[F.col(c).eqNullSafe(F.col(f"_o{c}")) for c in by]]
    out = held.join(offsets, same).withColumn("_before", (F.col("_in") + F.col("_offset")).cast("long"))
    return out.drop("_p", "_in", "_op", "_offset", *[f"_o{c}" for c in by])


def percentiles(df: DataFrame, col: str, at: list[float]) -> list[float]:
    """Exact percentiles, interpolated linearly; only the values around them come to the driver."""
    values = saved(counted_values(df.where(F.col(col).isNotNull()), col, []), "ranks")
    n = values.agg(F.sum("_n")).first()[0] or 0
    if not n:
        return []
    spots = [q * (n - 1) for q in at]
    wanted = sorted({f(x) for x in spots for f in (math.floor, math.ceil)})
    here = F.exists(F.array(*[F.lit(x) for x in wanted]), lambda x: (x >= F.col("_before")) & (x < F.col("_before") + F.col("_n")))
    rows = values.where(here).collect()
    value = {x: float(next(r.value for r in rows if r._before <= x < r._before + r._n)) for x in wanted}
    return [value[math.floor(x)] + (value[math.ceil(x)] - value[math.floor(x)]) * (x - math.floor(x)) for x in spots]


def quantile_strata(df: DataFrame, col: str, n_bins: int = 5, out: str = "stratum", exact: bool = True) -> DataFrame:
    """Bin of a value among linearly interpolated percentiles; bins may stay empty where percentiles are equal."""
    at = [i / n_bins for i in range(1, n_bins)]
    edges = percentiles(df, col, at) if exact else df.agg(F.percentile_approx(col, at).alias("e")).first().e or []
    return df.withColumn(out, sum((F.when(F.col(col) >= e, 1).otherwise(0) for e in edges), F.lit(0)))


def stratified_folds(df: DataFrame, stratum: str, k: int = 5, seed: int = 42, id_col: str = ID) -> DataFrame:
    """Folds whose sizes, in each stratum and in all, differ by one at most."""
    out = shuffled_rank(df.select(id_col, stratum), [stratum], seed, id_col)
    return out.select(id_col, F.pmod(F.col("_rank"), F.lit(k)).cast("int").alias("fold"))


def property_folds(df: DataFrame, col: str, k: int = 5, n_bins: int = 5, seed: int = 42, id_col: str = ID) -> DataFrame:
    return stratified_folds(quantile_strata(df, col, n_bins), "stratum", k, seed, id_col)


def centrality_folds(df: DataFrame, k: int = 5, seed: int = 42, id_col: str = ID, col: str = "resistance_centrality_wt") -> DataFrame:
    """By strata of centrality; of the first other column if that is missing."""
    return property_folds(df, col if col in df.columns else next(c for c in df.columns if c != id_col), k, 5, seed, id_col)


def propagation_folds(df: DataFrame, k: int = 5, seed: int = 42, id_col: str = ID, col: str = "propagation_radius") -> DataFrame:
    return property_folds(df, col if col in df.columns else next(c for c in df.columns if c != id_col), k, 5, seed, id_col)


def kfold(df: DataFrame, k: int = 5, shuffle: bool = True, seed: int = 42, id_col: str = ID, keep: Sequence[str] = ()) -> DataFrame:
    """Plain folds: dealt out in shuffled order, or contiguous by id with the larger folds first. Ids are whole numbers. keep: columns that the rows bring along."""
    ids = df.select(id_col, *keep)
    if shuffle:
        return shuffled_rank(ids, [], seed, id_col).select(id_col, *keep, F.pmod(F.col("_rank"), F.lit(k)).cast("int").alias("fold"))
    base, extra = divmod(ids.count(), k)
    r = ranked(ids, [], F.floor(F.col(id_col) / 65536), [id_col], "_rank")
    large = extra * (base + 1)
    small = extra + F.floor((F.col("_rank") - large) / max(base, 1))
    return r.select(id_col, *keep, F.when(F.col("_rank") < large, F.floor(F.col("_rank") / (base + 1))).otherwise(small).cast("int").alias("fold"))


def repeated_kfold(df: DataFrame, k: int = 5, repeats: int = 3, seed: int = 42, id_col: str = ID) -> DataFrame:
    """(id, repeat, fold)"""
    parts = [kfold(df, k, True, seed + r, id_col).withColumn("repeat", F.lit(r)) for r in range(repeats)]
    return reduce(DataFrame.unionByName, parts)


def name_bucket(df: DataFrame, name: str) -> Column:
    """Ranges of names in their order: of numbers by value, of texts by how they begin."""
    if dict(df.dtypes)[name] in ("tinyint", "smallint", "int", "bigint"):
        return F.floor(F.col(name) / 65536)
    return F.substring(F.col(name).cast("string"), 1, 8)


def leave_one_group_out(df: DataFrame, group: str, k: int = 5, seed: int = 42, id_col: str = ID, keep: Sequence[str] = ()) -> DataFrame:
    """One fold a group, numbered by name; with under three groups plain folds."""
    groups = saved(df.select(group).distinct(), "groups")
    if groups.count() < 3:
        return kfold(df, k, True, seed, id_col, keep)
    numbered = ranked(groups, [], name_bucket(groups, group), [group], "fold").withColumn("fold", F.col("fold").cast("int"))
    return carrying(df, group, id_col, keep).join(numbered.withColumnRenamed(group, "_group"), "_group").select(id_col, *keep, "fold")


def carrying(df: DataFrame, group: str, id_col: str, keep: Sequence[str]) -> DataFrame:
    return df.select(id_col, F.col(group).alias("_group"), *keep)


#: Runs of groups of one size whose dealing is broadcast; more of them are joined.
RUNS = 10_000


def dealing(loads: list[int], size: int, count: int) -> list[tuple[int, list[int]]]:
    """How `count` groups of one size go, one by one, to the lightest fold (equals: the first): (from which group on, folds in turn), and the loads after.

    Fold f takes a group whenever its load is the least, so at loads L, L + size, L + 2 size and so on: the groups go to
    the smallest of all these numbers in order. Once a fold has joined in, the order of those that have repeats.
    """
    order = sorted(range(len(loads)), key=lambda f: (loads[f], f))
    start, out = 0, []
    for i in range(1, len(order) + 1):
        active = order[:i]
        turn = sorted(active, key=lambda f: (loads[f], f))
        if i < len(order):  # until the next fold is the lightest
            limit = (loads[order[i]], order[i])
            takes = {f: max(0, -(-(limit[0] - loads[f]) // size) + (f < limit[1] and (limit[0] - loads[f]) % size == 0)) for f in active}
            n = min(sum(takes.values()), count - start)
        else:
            n = count - start
        if n > 0:
            out.append((start, turn))
            each, more = divmod(n, len(turn))
            for j, f in enumerate(turn):
                loads[f] += size * (each + (j < more))
            start += n
        if start == count:
            break
    return out


def group_folds(df: DataFrame, group: str, k: int = 5, seed: int = 42, id_col: str = ID, keep: Sequence[str] = ()) -> DataFrame:
    """Whole groups a fold: the largest first (equals by name), each to the lightest fold.

    Groups of one size are dealt as a run, by arithmetic; there are no more sizes than the root of twice the rows, and only
    their counts come to the driver. A group's fold follows from its place in its run.
    """
    counts = saved(df.groupBy(group).agg(F.count("*").alias("_size")), "groups")
    runs = counts.groupBy("_size").agg(F.count("*").alias("n")).orderBy(F.desc("_size")).collect()  # a row a size
    n = sum(r.n for r in runs)
    if n < 2:
        return kfold(df, k, True, seed, id_col, keep)
    loads = [0] * min(k, n)
    dealt = [(r._size, dealing(loads, r._size, r.n)) for r in runs]
    table = df.sparkSession.createDataFrame(dealt, "_size long, _turns array<struct<start: long, folds: array<int>>>")
    places = ranked(counts, ["_size"], name_bucket(counts, group), [group], "_place")
    first = counts.groupBy("_size").agg(F.count("*").alias("_n"))
    earlier = first.withColumn("_from", F.coalesce(F.sum("_n").over(W.orderBy("_size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_size", "_from")  # a row a size
    told = table.join(earlier, "_size")
    met = places.join(F.broadcast(told) if len(dealt) <= RUNS else told, "_size").withColumn("_place", F.col("_place") - F.col("_from"))
    turn = F.element_at(F.filter("_turns", lambda t: t["start"] <= F.col("_place")), -1)
    fold = F.get(turn["folds"], ((F.col("_place") - turn["start"]) % F.size(turn["folds"])).cast("int"))
    return carrying(df, group, id_col, keep).join(met.select(F.col(group).alias("_group"), fold.alias("fold")), "_group").select(id_col, *keep, "fold")


SPECTRAL = ["fiedler_component_wt", "voltage_wt", "conductance_degree_wt"]


#: Rounds of k-means at most, and the move of a centre under which a run has settled.
ROUNDS, SETTLED = 20, 1e-4


def nearest(z: list[Column], centres: list[list[float]]) -> Column:
    """(d, c): the squared distance to the nearest centre and its number; equals by number."""
    gap = lambda centre: sum(((x - F.lit(float(v))) * (x - F.lit(float(v))) for x, v in zip(z, centre, strict=True)), F.lit(0.0))
    return F.array_min(F.array(*[F.struct(gap(centre).alias("d"), F.lit(c).alias("c")) for c, centre in enumerate(centres)]))


def kmeans(rows: DataFrame, cols: list[str], k: int, restarts: int, seed: int, id_col: str = ID) -> list[list[float]]:
    """The centres of the best of several k-means runs, all advanced together: one pass over the rows a round.

    A run starts from the k distinct rows with the smallest hashes of its own; a centre without rows stays.
    """
    places = rows.groupBy(*cols).agg(F.min(id_col).alias(id_col)).select(id_col, *cols)
    starts = [[[r[c] for c in cols] for r in places.orderBy(shuffle_key(id_col, seed + i), id_col).limit(k).collect()] for i in range(restarts)]
    runs, cost = dict(enumerate(starts)), {}
    moving = set(runs)
    names = [f"m_{c}" for c in cols]
    for _ in range(ROUNDS):
        if not moving:
            break
        now = {i: np.array(runs[i]) for i in sorted(moving)}

        def sums(frames: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            held = {i: np.zeros((len(centres), 2 + len(names))) for i, centres in now.items()}  # a task's counts, costs and sums of each centre
            for f in frames:
                x = f.to_numpy(float)
                for i, centres in now.items():
                    apart = sum((x[:, [j]] - centres[:, j]) ** 2 for j in range(len(names)))
                    at = apart.argmin(1)
                    each = (None, apart[np.arange(len(x)), at], *x.T)
                    held[i] += np.column_stack([np.bincount(at, weights, len(centres)) for weights in each])
            for i, total in held.items():
                found = np.flatnonzero(total[:, 0])
                yield pd.DataFrame(total[found, 1:], columns=["d", *names]).assign(run=i, c=found, n=total[found, 0].astype(int))[["run", "c", "n", "d", *names]]

        schema = ", ".join(["run int", "c int", "n long", "d double", *[f"{m} double" for m in names]])
        added = rows.select(*cols).mapInPandas(sums, schema).groupBy("run", "c")
        found = added.agg(F.sum("n").alias("n"), F.sum("d").alias("d"), *[(F.sum(m) / F.sum("n")).alias(m) for m in names]).collect()  # a row a centre of a run
        for i in sorted(moving):
            own = {r.c: r for r in found if r.run == i}
            new = [[own[c][f"m_{x}"] for x in cols] if c in own else centre for c, centre in enumerate(runs[i])]
            cost[i] = sum(r.d for r in own.values())
            if max(abs(a - b) for p, q in zip(new, runs[i], strict=True) for a, b in zip(p, q, strict=True)) < SETTLED:
                moving.discard(i)
            runs[i] = new
    return runs[min(cost, key=lambda i: (cost[i], i))]


def spectral_strata(df: DataFrame, k: int = 5, seed: int = 42, id_col: str = ID, cols: list[str] = SPECTRAL, restarts: int = 10) -> DataFrame:
    """(id, stratum): clusters of standardised spectral features."""
    have = [c for c in cols if c in df.columns] or [c for c in df.columns if c != id_col][:3]
    sums = df.agg(F.count("*").alias("n"), *[f(c).alias(f"{p}{c}") for c in have for f, p in ((F.avg, "m_"), (F.stddev_pop, "s_"))]).first()
    z = {c: (F.col(c) - (sums[f"m_{c}"] or 0.0)) / (sums[f"s_{c}"] if (sums[f"s_{c}"] or 0.0) > 1e-12 else 1.0) for c in have}
    rows = saved(df.select(id_col, *[v.cast("double").alias(f"_z{c}") for c, v in z.items()]), "spectral")
    names = [f"_z{c}" for c in have]
    if not sums["n"]:
        return rows.select(id_col, F.lit(0).alias("stratum"))
    centres = kmeans(rows, names, min(k, sums["n"]), restarts, seed, id_col)
    return rows.select(id_col, nearest([F.col(c) for c in names], centres)["c"].alias("stratum"))


def spectral_folds(df: DataFrame, k: int = 5, seed: int = 42, id_col: str = ID, cols: list[str] = SPECTRAL, restarts: int = 10) -> DataFrame:
    """Strata are clusters of standardised spectral features: the best of several k-means runs."""
    return stratified_folds(spectral_strata(df, k, seed, id_col, cols, restarts), "stratum", k, seed, id_col)


STRATEGIES = ("centrality", "propagation", "kirchhoff_grouped", "spectral")


def folds_by(strategy: str, df: DataFrame, k: int = 5, group: str | None = None, seed: int = 42, id_col: str = ID) -> DataFrame:
    if strategy == "kirchhoff_grouped":
        if not group:
            raise ValueError("grouped folds need a group column")
        return group_folds(df, group, k, seed, id_col)
    makers = {"centrality": centrality_folds, "propagation": propagation_folds, "spectral": spectral_folds}
    if strategy not in makers:
        raise ValueError(f"unknown strategy: {strategy}")
    return makers[strategy](df.drop(group) if group else df, k, seed, id_col)


def precompute_all_splits(df: DataFrame, k: int = 5, group: str | None = None, seed: int = 42, id_col: str = ID, strategies=STRATEGIES) -> DataFrame:
    """(id, strategy, fold) of all strategies; one that needs a group column is skipped where there is none."""
    made = [folds_by(s, df, k, group, seed, id_col).withColumn("strategy", F.lit(s)) for s in strategies if group or s != "kirchhoff_grouped"]
    return reduce(DataFrame.unionByName, made)
