"""Trees on the sums of rows with equal codes are those of a pass a level."""

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from ohmgraph.operators import folds, models, trees

HOWS = {
    "gbt": {"kind": "gbt", "n": 4, "depth": 3, "rate": 0.3, "subsample": 0.7, "leaf": 3},
    "rf": {"kind": "rf", "n": 5, "depth": 4, "leaf": 2},
    "extra": {"kind": "extra", "n": 5, "depth": 5, "leaf": 4},
}
COLS = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, [9, 5], (900, 2))
    made = [(i, i % 5, int(a), None if i % 71 == 0 else math.nan if i % 53 == 0 else float(b), float(a * b + (a > 4) + rng.normal())) for i, (a, b) in enumerate(x)]
    return spark.createDataFrame(made, "mutation_id long, fold int, a int, b double, ddG double").repartition(4).cache()


@pytest.mark.parametrize("kind", HOWS)
@pytest.mark.parametrize("folds", [[0, 1, 2, 3, 4], [3, 1], [trees.NOBODY]])
def test_cells_give_the_trees_of_all_rows(rows, monkeypatch, kind, folds):
    edges = trees.bins(rows, COLS)
    ask = lambda: trees.fit_folds(rows, COLS, "ddG", "fold", "mutation_id", HOWS[kind], folds, edges)
    passes = []
    level = trees.level
    monkeypatch.setattr(trees, "level", lambda *a: passes.append(1) or level(*a))
    got, gains = ask()
    got = {r.mutation_id: r for r in got.collect()}
    assert not passes
    with monkeypatch.context() as m:
        m.setattr(trees, "HELD", 16 * 60 * (len(folds) + 1) * 2)  # the sums of a few trees at once
        m.setattr(trees, "KEPT", 10)
        parts = {r.mutation_id: r.yhat for r in ask()[0].collect()}
    monkeypatch.setattr(trees, "CELLS", 0)
    want, own = ask()
    want = want.collect()
    assert passes and len(want) == len(got) == len(parts) > 0
    assert all(got[r.mutation_id].yhat == pytest.approx(r.yhat, abs=1e-9) and parts[r.mutation_id] == pytest.approx(r.yhat, abs=1e-9) and got[r.mutation_id].y == r.y and got[r.mutation_id].fold == r.fold for r in want)
    assert all(gains[k] == pytest.approx(own[k]) for k in folds)


def test_compared_models_share_folds_passes_and_ranks(rows, monkeypatch):
    """The metrics of a comparison are those of each model by itself; rows are shuffled into folds once, and no level of a tree takes a pass."""
    x, edges = rows.drop("fold").fillna(0.0, ["b"]), trees.bins(rows, COLS)
    x = x.withColumn("b", F.when(F.isnan("b"), 0.0).otherwise(F.col("b")))
    monkeypatch.setattr(trees, "bins", lambda df, cols: edges)  # approximate quantiles hang on the order of the rows
    small = {"gbt": HOWS["gbt"], "rf": HOWS["rf"]}
    asked = {"ridge": {}, "stacking": {k: {n: v for n, v in s.items() if n != "kind"} for k, s in small.items()}, "gbt": {"n": 3, "depth": 2}, "lasso": {"alpha": 0.3}, "extra_trees": {"n": 4, "depth": 4}}
    called = []
    for part, name in ((trees, "level"), (folds, "shuffled_rank")):
        monkeypatch.setattr(part, name, lambda *a, full=getattr(part, name), name=name: called.append(name) or full(*a))
    got = {r.model_type: r.asDict() for r in models.compare_models(x, COLS, asked, k=3).collect()}
    assert called == ["shuffled_rank"] and set(got) == set(asked)
    monkeypatch.setattr(trees, "CELLS", 0)
    want = models.compare_models(x, COLS, asked, k=3)
    assert "level" in called and set(want.columns) == set(next(iter(got.values())))
    for r in want.collect():
        for c, v in r.asDict().items():
            assert got[r.model_type][c] == (v if not isinstance(v, float) else pytest.approx(v, abs=1e-9)), (r.model_type, c)


def test_spearman_of_many_columns_equals_each(spark, monkeypatch):
    rng = np.random.default_rng(8)
    made = [(float(a) if a else None, float(b), float(c) if c % 7 else math.nan, 2.0) for a, b, c in rng.integers(0, [30, 12, 400], (500, 3))]
    df = spark.createDataFrame(made, "y double, p double, q double, same double")
    want = {c: models.spearman(df, "y", c).first().spearman_r for c in ("p", "q", "same")}
    assert models.spearman_together(df, "y", ["p", "q", "same"]) == pytest.approx(want, abs=1e-12)
    monkeypatch.setattr(models, "RANKS", 0)
    assert models.spearman_together(df, "y", ["q", "p"]) == pytest.approx({c: want[c] for c in "pq"}, abs=1e-12)
    assert models.spearman_together(df.limit(0), "y", ["p"]) == {"p": 0.0}
