"""Trees of all folds at once: against fits of one fold, against plain loops, and on odd rows."""

import math

import numpy as np
import pyarrow as pa
import pytest

from ohmgraph.operators import folds, models, trees

COLS = ["a", "b", "c"]
HOWS = {
    "gbt": {"kind": "gbt", "n": 4, "depth": 3, "rate": 0.3, "subsample": 0.7, "leaf": 3},
    "rf": {"kind": "rf", "n": 5, "depth": 4, "leaf": 2},
    "extra": {"kind": "extra", "n": 5, "depth": None, "leaf": 4},
}


def rows(spark, n=300, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(1)
    y = np.where(x[:, 0] > 0.2, 2.0, -1.0) + x[:, 1] * x[:, 2] + rng.normal(0, 0.2, n)
    made = [(i, f"g{i % 7}", i % 5, *map(float, x[i]), float(y[i])) for i in range(n)]
    return spark.createDataFrame(made, "mutation_id long, pdb_id string, fold int, a double, b double, c double, ddG double").repartition(3), x, y


@pytest.mark.parametrize("kind", HOWS)
def test_a_fold_among_others_is_a_fit_for_it_alone(spark, kind):
    df, _, y = rows(spark)
    edges = trees.bins(df, COLS)
    every, gains = trees.fit_folds(df, COLS, "ddG", "fold", "mutation_id", HOWS[kind], [0, 1, 2, 3, 4], edges)
    every = {r.mutation_id: (r.fold, r.y, r.yhat) for r in every.collect()}
    alone, own = trees.fit_folds(df.repartition(2), COLS, "ddG", "fold", "mutation_id", HOWS[kind], [3], edges)
    alone = {r.mutation_id: r.yhat for r in alone.collect()}
    assert len(every) == 300 and len(alone) == 60 and all(every[i][0] == i % 5 and every[i][1] == y[i] for i in every)
    assert all(every[i][2] == pytest.approx(v, abs=1e-9) for i, v in alone.items())
    assert gains[3] == pytest.approx(own[3]) and gains[3].sum() == pytest.approx(1)
    assert np.corrcoef([v[1] for v in every.values()], [v[2] for v in every.values()])[0, 1] > 0.6


def plain_boosting(codes, y, n, depth, rate, leaf):
    """Boosted trees by plain loops over all cuts."""

    def grow(at, target, level):
        s, m = target[at].sum(), len(at)
        best = None
        for f in range(codes.shape[1]) if level < depth else ():
            for c in range(trees.BINS - 1):
                go = codes[at, f] <= c
                a, b = at[go], at[~go]
                if len(a) >= leaf and len(b) >= leaf:
                    gain = target[a].sum() ** 2 / len(a) + target[b].sum() ** 2 / len(b) - s * s / m
                    if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-9)):
                        best = gain, f, c
        if best is None:
            return lambda row: s / m
        _, f, c = best
        go = codes[at, f] <= c
        low, high = grow(at[go], target, level + 1), grow(at[~go], target, level + 1)
        return lambda row: low(row) if row[f] <= c else high(row)

    made = [lambda row: y.mean()]
    pred = np.full(len(y), y.mean())
    for _ in range(n):
        tree = grow(np.arange(len(y)), y - pred, 0)
        pred += rate * np.array([tree(r) for r in codes])
        made.append(lambda row, tree=tree: rate * tree(row))
    return lambda row: sum(t(row) for t in made)


def test_boosting_against_plain_loops(spark):
    df, x, y = rows(spark, 120)
    edges = trees.bins(df, COLS)
    codes = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)], 1)
    got, _ = trees.fit_folds(df, COLS, "ddG", "fold", "mutation_id", {"kind": "gbt", "n": 3, "depth": 2, "rate": 0.4, "leaf": 4}, [0, 2], edges)
    got = {r.mutation_id: r.yhat for r in got.collect()}
    for k in (0, 2):
        rest = np.arange(120) % 5 != k
        model = plain_boosting(codes[rest], y[rest], 3, 2, 0.4, 4)
        assert all(got[i] == pytest.approx(model(codes[i]), abs=1e-9) for i in range(k, 120, 5))


def test_bounded_passes_and_chunks_give_the_same(spark, monkeypatch):
    df, _, _ = rows(spark, 150)
    full = {h: trees.fit_folds(df, COLS, "ddG", "fold", "mutation_id", HOWS[h], [0, 1, 2])[0].collect() for h in ("gbt", "rf")}
    for name, value in (("HELD", 3 * trees.BINS * 16 * 2), ("FOLDS", 2), ("TOGETHER", 4), ("WRITE", 2)):
        monkeypatch.setattr(trees, name, value)
    for h, want in full.items():
        got = {r.mutation_id: r.yhat for r in trees.fit_folds(df, COLS, "ddG", "fold", "mutation_id", HOWS[h], [0, 1, 2])[0].collect()}
        assert all(got[r.mutation_id] == pytest.approx(r.yhat, abs=1e-9) for r in want)


def test_odd_rows(spark):
    schema = "mutation_id long, fold int, a double, b double, ddG double"
    same = spark.createDataFrame([(i, i % 2, 1.0, None if i % 3 else math.nan, 2.5) for i in range(20)], schema)
    for how in HOWS.values():
        out, gains = trees.fit_folds(same, ["a", "b"], "ddG", "fold", "mutation_id", how, [0, 1])
        assert all(r.yhat == pytest.approx(2.5) for r in out.collect()) and gains[0].sum() == 0
    few = spark.createDataFrame([(1, 0, 1.0, 2.0, 3.0), (2, 1, 0.0, 0.0, -1.0)], schema)
    got = {r.mutation_id: r.yhat for r in trees.fit_folds(few, ["a", "b"], "ddG", "fold", "mutation_id", HOWS["gbt"] | {"subsample": 1.0}, [0, 1])[0].collect()}
    assert got == {1: -1.0, 2: 3.0}
    assert trees.fit_folds(few.limit(0), ["a"], "ddG", "fold", "mutation_id", HOWS["rf"], [0])[0].count() == 0


def test_leave_one_group_out_takes_a_job_a_level(spark, monkeypatch):
    df, _, _ = rows(spark, 210)
    calls = []
    level = trees.level
    monkeypatch.setattr(trees, "level", lambda *a: calls.append(len({n[0] for n in a[5]})) or level(*a))
    held = df.drop("fold").join(folds.leave_one_group_out(df, "pdb_id"), "mutation_id")
    out = models.predictions(held, COLS, model="gbt", settings={"n": 3, "depth": 2, "rate": 0.3})
    assert out.count() == 210 and len(calls) == 6 and max(calls) == 7


def test_extra_trees_and_stacking_evaluate(spark):
    df, _, _ = rows(spark, 200)
    x = df.drop("fold")
    m = models.train_and_evaluate(x, COLS, "extra_trees", k=3, settings={"n": 8, "depth": 5}).first()
    assert m.n_folds == 3 and m.n_samples == 200 and m.pearson_r > 0.5
    got = models.fit_predict(x.where("mutation_id < 150"), x.where("mutation_id >= 150"), COLS, model="extra_trees", settings={"n": 8, "depth": 5})
    assert got.count() == 50 and set(got.columns) == {"mutation_id", "y", "yhat"}


def test_binary_columns_are_read_in_place():
    values = [np.arange(i, i + 3, dtype=float).tobytes() for i in range(5)]
    for kind in (pa.binary(), pa.large_binary()):
        column = pa.array(values, kind)
        for part in (column, column.slice(1, 3), column.slice(4), column.slice(0, 0)):
            assert trees.held_bytes(part, np.float64).tobytes() == b"".join(part.to_pylist())
    assert len(trees.held_bytes(pa.array([b"", b""], pa.binary()), np.float64)) == 0
