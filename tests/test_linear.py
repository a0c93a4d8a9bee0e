"""Linear models from sums: against Spark's own fits, against brute force, and that rows are read once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ohmgraph.operators import folds, linear, models
from ohmgraph.queries import registry

from .conftest import against_sql

COLS = [f"x{i}" for i in range(8)]


def sums(x, y):
    a = np.column_stack([np.ones(len(x)), x, y])
    return a.T @ a


def data(n=400, seed=5):
    """Correlated columns, one of them constant, one a copy of another."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 8)) @ rng.normal(size=(8, 8)) + 3
    x[:, 6] = 2.5
    x[:, 7] = x[:, 0] * 2 - 1
    return x, 2 * x[:, 0] - x[:, 1] + 0.3 * x[:, 3] + rng.normal(0, 1.5, n)


@pytest.fixture(scope="module")
def rows(spark):
    x, y = data()
    return spark.createDataFrame([(i, f"g{i % 23}", *map(float, x[i]), float(y[i])) for i in range(len(x))], f"mutation_id long, pdb_id string, {', '.join(c + ' double' for c in COLS)}, ddG double").cache()


def test_penalised_fits_are_minima():
    x, y = data()
    g = sums(x, y)
    sd = np.where(x.std(0) > 1e-12, x.std(0), 1)
    z = (x - x.mean(0)) / sd
    for model, alpha, l1 in (("lasso", 0.1, 1.0), ("lasso", 1e-6, 1.0), ("lasso", 50.0, 1.0), ("elastic_net", 0.1, 0.5), ("elastic_net", 0.01, 0.2), ("elastic_net", 1.0, 0.8), ("elastic_net", 3.0, 0.0)):
        coef, b = linear.fit(g, model, {"alpha": alpha, "l1": l1})
        cost = lambda w: ((y - y.mean() - z @ w) ** 2).mean() / 2 + alpha * (l1 * np.abs(w).sum() + (1 - l1) / 2 * (w**2).sum())  # noqa: B023, E731
        w = coef * sd
        pull = z.T @ (y - y.mean() - z @ w) / len(y) - alpha * (1 - l1) * w
        assert np.allclose(pull[w != 0], alpha * l1 * np.sign(w[w != 0]), atol=1e-8) and (np.abs(pull[w == 0]) <= alpha * l1 + 1e-8).all()
        rng = np.random.default_rng(0)
        assert all(cost(w) <= cost(w + rng.normal(0, 0.01, 8)) + 1e-12 for _ in range(50))
        assert coef[6] == 0 and b == pytest.approx(y.mean() - coef @ x.mean(0))


def test_penalised_fits_equal_sparks(spark, rows):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    x, y = data()
    use = [0, 1, 2, 3, 4, 5]
    z = (x - x.mean(0)) / np.where(x.std(0) > 1e-12, x.std(0), 1)
    scaled = spark.createDataFrame([(*map(float, z[i, use]), float(y[i])) for i in range(len(x))], [*[f"z{j}" for j in use], "y"])
    vectors = VectorAssembler(inputCols=[f"z{j}" for j in use], outputCol="v").transform(scaled)
    for model, alpha, l1 in (("lasso", 0.1, 1.0), ("elastic_net", 0.1, 0.5), ("elastic_net", 1.0, 0.2)):
        one, two = alpha * l1, alpha * (1 - l1)
        reg = one + two * y.std(ddof=1)  # Spark divides the squared part by the label's deviation
        theirs = LinearRegression(featuresCol="v", labelCol="y", regParam=reg, elasticNetParam=one / reg, standardization=False, solver="l-bfgs", maxIter=2000, tol=1e-14).fit(vectors)
        coef, b = linear.fit(sums(x, y), model, {"alpha": alpha, "l1": l1}, use)
        assert np.allclose(coef[use] * x.std(0)[use], theirs.coefficients.toArray(), atol=1e-6)
        assert b + coef @ x.mean(0) == pytest.approx(theirs.intercept, abs=1e-6)


@pytest.mark.parametrize("model", ["ridge", "elastic_net", "lasso"])
def test_folds_and_grids_from_one_pass(spark, rows, model):
    x, y = data()
    fold = {r.mutation_id: r.fold for r in folds.kfold(rows, 5).collect()}
    at = np.array([fold[i] for i in range(len(x))])
    got = {r.mutation_id: r.yhat for r in models.predictions(rows.join(folds.kfold(rows, 5), "mutation_id"), COLS, model=model).collect()}
    for k in range(5):
        coef, b = linear.fit(sums(x[at != k], y[at != k]), model, models.MODELS[model])
        assert all(got[i] == pytest.approx(x[i] @ coef + b, abs=1e-8) for i in np.flatnonzero(at == k))
    tried = models.combinations(models.GRIDS.get(model, {"alpha": [0.01, 0.3]}))
    nested = {r.mutation_id: r.yhat for r in models.nested_linear(rows, COLS, model, tried, 5, 3, "ddG", "mutation_id").collect()}
    for k in range(5):  # the same by a job for each training set, as for other models
        train = rows.join(spark.createDataFrame([(i,) for i in range(len(x)) if at[i] != k], "mutation_id long"), "mutation_id")
        inner = {r.mutation_id: r.fold for r in folds.kfold(train, 3).collect()}
        own = np.array([inner.get(i, -1) for i in range(len(x))])
        r2 = []
        for s in tried:
            fits = [linear.fit(sums(x[(own >= 0) & (own != j)], y[(own >= 0) & (own != j)]), model, models.MODELS[model] | s) for j in range(3)]
            r2.append(np.mean([linear.scores(sums(x[own == j], y[own == j]), *f)[0] for j, f in enumerate(fits)]))
        coef, b = linear.fit(sums(x[own >= 0], y[own >= 0]), model, models.MODELS[model] | tried[int(np.argmax(r2))])
        assert all(nested[i] == pytest.approx(x[i] @ coef + b, abs=1e-7) for i in np.flatnonzero(at == k))


def test_inner_folds_follow_from_places():
    for k, inner, n in ((5, 3, 97), (2, 4, 30), (3, 3, 10)):
        for outer in range(k):
            rest = [g for g in range(n) if g % k != outer]
            assert [models.inner_fold(g, outer, k, inner) for g in rest] == [i % inner for i in range(len(rest))]
            assert all(models.inner_fold(g, outer, k, inner) == models.inner_fold(g % (k * inner), outer, k, inner) for g in rest)


def test_gram_holds_one_fold_at_a_time(spark):
    """As many folds as rows: each task emits a matrix for each fold that it has, in the order of folds."""
    df = spark.range(3000).select((F.col("id") * 7 % 3000).cast("int").alias("fold"), F.col("id").cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("ddG"))
    plan = models.gram_by_fold(df, ["a"], "ddG")._jdf.queryExecution().executedPlan().toString()
    assert "Sort [_f" in plan.replace("#", " ").replace("Sort [_f ", "Sort [_f")
    out = models.gram_by_fold(df, ["a"], "ddG").where("i = 1 AND j = 1").collect()
    assert sorted((r.fold, r.value) for r in out) == sorted((i * 7 % 3000, float(i) ** 2) for i in range(3000))


def test_leave_one_group_out_of_a_linear_model(rows):
    m = models.train_and_evaluate(rows, COLS, "elastic_net", "logo", "pdb_id").first()
    assert m.n_folds == 23 and m.n_samples == 400 and m.pearson_r > 0.8


def test_ablation_and_importances_of_lasso(rows):
    held = rows.withColumn("fold", (F.col("mutation_id") % 5).cast("int"))
    a = models.feature_ablation(held, COLS[:4], "lasso").orderBy("importance_rank").collect()
    assert a[0].r2_drop > 0.05 and len(a) == 4
    i = {r.feature: r.importance for r in models.feature_importances(rows, COLS, "lasso").collect()}
    assert i["x6"] == 0 and sum(v != 0 for v in i.values()) >= 3


@pytest.mark.parametrize("name", ["e5_penalised_one_column", "e15_nested_elastic_net", "e15_nested_cv"])
def test_registered_linear_queries(spark, name):
    made, expected = against_sql(spark, registry.QUERIES[name], registry.ORACLES[name])
    assert made == expected


def test_plain_folds_are_dealt_and_ranked_once(rows, monkeypatch):
    """kfold and repeated share the plain folds, whose predictions are made once; only three of five evaluations rank."""
    dealt, ranked = [], []
    kfold, spearman = models.cv.kfold, models.spearman
    monkeypatch.setattr(models.cv, "kfold", lambda df, k=5, shuffle=True, seed=42, *a: dealt.append(seed) or kfold(df, k, shuffle, seed, *a))
    monkeypatch.setattr(models, "spearman", lambda *a: ranked.append(1) or spearman(*a))
    got = {r.cv_strategy: r for r in models.multi_cv_evaluate(rows, COLS, "pdb_id", "ridge").collect()}
    assert dealt == [42, 43, 44] and len(ranked) == 3
    assert got["repeated"].pearson_r == got["kfold"].pearson_r and got["repeated"].n_folds == 3 * got["kfold"].n_folds


def test_sums_of_few_columns_are_those_of_numpy(rows):
    x = rows.withColumn("fold", (F.col("mutation_id") % 3).cast("int"))
    plain, fast = ({(r.fold, r.i, r.j): r.value for r in make(x, COLS, "ddG").collect()} for make in (models.gram_by_fold, models.gram_sums))
    assert fast == pytest.approx(plain, rel=1e-12, abs=1e-9)
