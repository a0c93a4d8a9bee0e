"""Models, their evaluation on folds, and ablation.

Linear models come from one pass: the sums that a least-squares fit needs are added by fold, and a fold's training sums
are the total's less its own (linear.py does the arithmetic, also for whole grids of penalties). Trees of all folds of a
cross-validation grow together (trees.py); a single fit of trees is Spark's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import correlation
from ..schema import FEATURE_GROUPS
from ..storage import saved
from . import folds as cv
from . import linear, trees
from .linear import scores as scores_from_gram  # noqa: F401  (its older name)

ID = "mutation_id"
LEAST = 4  # rows under which a model is not evaluated
#: Columns of A, one and the label among them, up to which Spark's own sums make A'A; distinct values whose ranks are broadcast.
FEW, RANKS = 10, 1_000_000


# ---------------------------------------------------------------- scaling and linear models


def standardize(df: DataFrame, cols: list[str], fold: str = "fold") -> DataFrame:
    """(…, test_fold): every row once for each fold, scaled by mean and population deviation of the rows outside it."""
    stats = [f(c).alias(f"{n}{c}") for c in cols for n, f in (("s_", F.sum), ("q_", lambda x: F.sum(F.col(x) * F.col(x))))]
    own = df.groupBy(F.col(fold).alias("test_fold")).agg(F.count("*").alias("n_"), *stats)
    every = own.agg(*[F.sum(c).alias(f"t_{c}") for c in own.columns if c != "test_fold"])
    rest = own.crossJoin(F.broadcast(every)).select("test_fold", *[(F.col(f"t_{c}") - F.col(c)).alias(c) for c in own.columns if c != "test_fold"])
    mean = {c: F.col(f"s_{c}") / F.col("n_") for c in cols}
    var = {c: F.greatest(F.lit(0.0), F.col(f"q_{c}") / F.col("n_") - mean[c] * mean[c]) for c in cols}
    scale = rest.select("test_fold", *[x for c in cols for x in (mean[c].alias(f"m_{c}"), F.when(var[c] > 1e-24, F.sqrt(var[c])).otherwise(1.0).alias(f"d_{c}"))])
    out = df.crossJoin(F.broadcast(scale))  # a row a fold
    return out.select(*[c for c in df.columns if c not in cols], "test_fold", *[((F.col(c) - F.col(f"m_{c}")) / F.col(f"d_{c}")).alias(c) for c in cols])


def gram_by_fold(df: DataFrame, cols: list[str], label: str, fold: str = "fold") -> DataFrame:
    """(fold, i, j, value): the entries i <= j of A'A for A = [1, cols, label], added by task before they are shuffled."""
    p = len(cols) + 2
    upper = np.triu_indices(p)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, g = None, None  # rows come fold by fold, so one matrix is held, however many folds there are
        for f in frames:
            for k, part in f.groupby("_f"):
                a = np.column_stack([np.ones(len(part)), part.drop(columns="_f").to_numpy(float)])
                if at is not None and k != at:
                    yield pd.DataFrame({"fold": at, "i": upper[0], "j": upper[1], "value": g[upper]})
                g, at = a.T @ a + (g if k == at else 0), k
        if at is not None:
            yield pd.DataFrame({"fold": at, "i": upper[0], "j": upper[1], "value": g[upper]})

    flat = df.select(F.col(fold).cast("int").alias("_f"), *[F.col(c).cast("double") for c in [*cols, label]])
    return flat.sortWithinPartitions("_f").mapInPandas(sums, "fold int, i int, j int, value double").groupBy("fold", "i", "j").agg(F.sum("value").alias("value"))


def gram_sums(df: DataFrame, cols: list[str], label: str, fold: str = "fold") -> DataFrame:
    """gram_by_fold; of few columns by Spark's own sums, without a sort or Python."""
    p = len(cols) + 2
    if p > FEW:
        return gram_by_fold(df, cols, label, fold)
    a = [F.lit(1.0), *[F.coalesce(F.col(c).cast("double"), F.lit(math.nan)) for c in [*cols, label]]]  # a missing value shows, as in numpy
    cells = [(i, j) for i in range(p) for j in range(i, p)]
    added = df.groupBy(F.col(fold).cast("int").alias("fold")).agg(*[F.sum(a[i] * a[j]).alias(f"s_{i}_{j}") for i, j in cells])
    return added.select("fold", F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s_{i}_{j}").alias("value")) for i, j in cells])))


def gram_matrix(rows, p: int) -> np.ndarray:
    """A matrix from its entries (i, j, value)."""
    m = np.zeros((p, p))
    for i, j, value in rows:
        m[i, j] = m[j, i] = value
    return m


def gram_total(gram: DataFrame, p: int) -> tuple[np.ndarray, int]:
    """The sum of all folds' matrices, and how many folds there are."""
    rows = gram.groupBy("i", "j").agg(F.sum("value").alias("value"), F.count("*").alias("n")).collect()
    return gram_matrix([(r.i, r.j, r.value) for r in rows], p), max((r.n for r in rows), default=0)


def by_fold(gram: DataFrame, p: int, make, schema: str) -> DataFrame:
    """What make(fold, its matrix, that of the rows outside it) gives for each fold, in tasks; with one fold both are the same."""
    total, folds = gram_total(gram, p)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        g = gram_matrix(rows[["i", "j", "value"]].itertuples(index=False), p)
        return pd.DataFrame(make(key[0], g, total - g if folds > 1 else g), columns=names)

    return gram.groupBy("fold").applyInPandas(run, schema)


def ridge_from_gram(g: np.ndarray, alpha: float = 1.0, use: list[int] | None = None) -> tuple[np.ndarray, float]:
    return linear.fit(g, "ridge", {"alpha": alpha}, use)


def linear_predictions(df: DataFrame, cols: list[str], label: str = "ddG", model: str = "ridge", settings: dict | None = None, fold: str = "fold", id_col: str = ID) -> DataFrame:
    """(id, fold, y, yhat), each row by the fit on the rows outside its fold."""
    chosen = MODELS[model] | (settings or {})

    def fit(k: int, own: np.ndarray, rest: np.ndarray) -> list[tuple]:
        coef, b = linear.fit(rest, model, chosen)
        return [(k, coef.tolist(), b)]

    held = saved(df.select(id_col, fold, label, *[c for c in cols if c != label]), "folds")  # the folds are dealt once
    gram = saved(gram_sums(held, cols, label, fold), "gram")
    return with_fits(held, saved(by_fold(gram, len(cols) + 2, fit, FITS), "fits"), cols, label, fold, id_col)


FITS = "_of int, _coef array<double>, _b double"


def with_fits(df: DataFrame, fits: DataFrame, cols: list[str], label: str, fold: str, id_col: str) -> DataFrame:
    """(id, fold, y, yhat) of rows by the fit of their fold."""
    dot = reduce(lambda a, b: a + b, [F.col(c).cast("double") * F.get("_coef", F.lit(i)) for i, c in enumerate(cols)], F.col("_b"))
    return df.join(fits, F.col(fold) == F.col("_of")).select(id_col, F.col(fold).alias("fold"), F.col(label).cast("double").alias("y"), dot.alias("yhat"))


def ridge_predictions(df: DataFrame, cols: list[str], label: str = "ddG", alpha: float = 1.0, fold: str = "fold", id_col: str = ID) -> DataFrame:
    return linear_predictions(df, cols, label, "ridge", {"alpha": alpha}, fold, id_col)


# ---------------------------------------------------------------- Spark's models

# Settings of the models.
MODELS = {
    "gbt": {"n": 500, "depth": 5, "rate": 0.02, "subsample": 0.8, "leaf": 5},
    "rf": {"n": 300, "depth": 10, "leaf": 3},
    "extra_trees": {"n": 300, "depth": 10, "leaf": 3},
    "ridge": {"alpha": 1.0},
    "elastic_net": {"alpha": 0.1, "l1": 0.5},
    "lasso": {"alpha": 0.1, "l1": 1.0},
    "stacking": {"gbt": {"n": 200, "depth": 4, "rate": 0.05, "subsample": 0.8, "leaf": 5}, "rf": {"n": 150, "depth": 8, "leaf": 3}, "folds": 3},
}
# What nested cross-validation tries.
GRIDS = {
    "gbt": {"n": [200, 500], "depth": [4, 5], "rate": [0.02, 0.05], "subsample": [0.8]},
    "rf": {"n": [200, 500], "depth": [8, 12, None], "leaf": [2, 5]},
    "ridge": {"alpha": [0.01, 0.1, 1.0, 10.0, 100.0]},
    "elastic_net": {"alpha": [0.01, 0.1, 1.0], "l1": [0.2, 0.5, 0.8]},
}


def assembled(df: DataFrame, cols: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=cols, outputCol="_x", handleInvalid="keep").transform(df)


def estimator(kind: str, label: str, settings: dict, seed: int = 42):
    """Spark's estimator for a model of trees."""
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    both = {"featuresCol": "_x", "labelCol": label, "predictionCol": "yhat"}
    s = MODELS.get(kind, {}) | settings
    if kind == "gbt":
        return GBTRegressor(maxIter=s["n"], maxDepth=s["depth"], stepSize=s["rate"], subsamplingRate=s["subsample"], minInstancesPerNode=s.get("leaf", 5), seed=seed, cacheNodeIds=True, checkpointInterval=20, **both)
    if kind == "rf":
        return RandomForestRegressor(numTrees=s["n"], maxDepth=s["depth"] or 30, minInstancesPerNode=s["leaf"], seed=seed, **both)
    raise ValueError(f"unknown model: {kind}")


def fit_predict(train: DataFrame, test: DataFrame, cols: list[str], label: str = "ddG", model: str = "gbt", settings: dict | None = None, id_col: str = ID, seed: int = 42) -> DataFrame:
    """(id, y, yhat) of the test rows."""
    settings = settings or {}
    if model in linear.KINDS:
        both = train.withColumn("_f", F.lit(0)).unionByName(test.withColumn("_f", F.lit(1)), allowMissingColumns=True)
        return linear_predictions(both, cols, label, model, settings, "_f", id_col).where("fold = 1").drop("fold") if not test.isEmpty() else test.select(id_col, F.col(label).alias("y"), F.lit(None).cast("double").alias("yhat"))
    if model == "stacking":
        return stacked(train, test, cols, label, settings, id_col, seed)
    if model == "extra_trees":
        both = train.withColumn("_f", F.lit(0)).unionByName(test.withColumn("_f", F.lit(1)), allowMissingColumns=True)
        return tree_predictions(both, cols, label, model, settings, "_f", id_col, [1]).drop("fold")
    fitted = estimator(model, label, settings, seed).fit(assembled(train, cols))
    return fitted.transform(assembled(test, cols)).select(id_col, F.col(label).cast("double").alias("y"), "yhat")


def stacked(train: DataFrame, test: DataFrame, cols: list[str], label: str, settings: dict, id_col: str, seed: int) -> DataFrame:
    """Base models' out-of-fold predictions feed a ridge; base models fitted on all training rows feed it for the test."""
    s = MODELS["stacking"] | settings
    bases = list(BASES)
    inner = train.join(cv.kfold(train, s["folds"], True, seed, id_col).withColumnRenamed("fold", "_inner"), id_col)
    both = train.withColumn("_f", F.lit(0)).unionByName(test.withColumn("_f", F.lit(1)), allowMissingColumns=True)
    named = lambda make: together([make(b).drop("fold").withColumn("base", F.lit(b)) for b in bases])
    seen = named(lambda b: tree_predictions(inner, cols, label, b, s[b], "_inner", id_col))
    unseen = named(lambda b: tree_predictions(both, cols, label, b, s[b], "_f", id_col, [1]))
    wide = lambda df: df.groupBy(id_col, "y").pivot("base", bases).agg(F.first("yhat")).withColumnRenamed("y", label)
    return fit_predict(wide(seen), wide(unseen), bases, label, "ridge", {"alpha": 1.0}, id_col)


TREES = {"gbt": "gbt", "rf": "rf", "extra_trees": "extra"}
BASES = ("gbt", "rf")  # of stacking


def tree_predictions(df: DataFrame, cols: list[str], label: str, model: str, settings: dict | None, fold: str, id_col: str = ID, left_out: list[int] | None = None) -> DataFrame:
    """(id, fold, y, yhat) of the rows of folds, each by the trees grown on the rows outside its fold; all folds grow together."""
    held = saved(df.select(id_col, label, fold, *cols), "folds")
    ks = left_out or sorted(r[0] for r in held.select(fold).distinct().collect())  # a row a fold
    how = {"kind": TREES[model]} | MODELS[model] | (settings or {})
    return trees.fit_folds(held, cols, label, fold, id_col, how, ks)[0].select(id_col, F.col("fold"), "y", "yhat")


def predictions(df: DataFrame, cols: list[str], label: str = "ddG", model: str = "ridge", settings: dict | None = None, fold: str = "fold", id_col: str = ID) -> DataFrame:
    """(id, fold, y, yhat) out of fold: one pass for the folds of a linear model, one a level for those of trees. Stacking goes fold by fold."""
    if model in linear.KINDS:
        return linear_predictions(df, cols, label, model, settings, fold, id_col)
    if model in TREES:
        return tree_predictions(df, cols, label, model, settings, fold, id_col)
    held = saved(df.select(id_col, label, fold, *cols), "folds")
    ks = sorted(r[0] for r in held.select(fold).distinct().collect())
    parts = [fit_predict(held.where(F.col(fold) != k), held.where(F.col(fold) == k), cols, label, model, settings, id_col).withColumn("fold", F.lit(k)) for k in ks]
    return reduce(DataFrame.unionByName, parts).select(id_col, "fold", "y", "yhat")


# ---------------------------------------------------------------- evaluation


def with_rank(df: DataFrame, ranks: DataFrame, col: str, by: list[str], out: str) -> DataFrame:
    """Adds out of a table (by, value, out) by the value of a column; the value is compared first, as groups hardly tell rows apart."""
    same = [F.col(col).eqNullSafe(F.col("_ovalue")), *[F.col(c).eqNullSafe(F.col(f"_o{c}")) for c in by]]
    named = ranks.select(*[F.col(c).alias(f"_o{c}") for c in [*by, "value"]], out)
    return df.join(F.broadcast(named) if ranks.count() <= RANKS else named, same).drop(*[f"_o{c}" for c in [*by, "value"]])


def average_rank(df: DataFrame, col: str, by: list[str], out: str) -> DataFrame:
    """Adds out: the mean rank of equal values in a group."""
    ranks = saved(cv.counted_values(df, col, by).withColumn(out, F.col("_before") + (F.col("_n") + 1) / 2), "ranks")
    return with_rank(df, ranks, col, by, out)


def spearman(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """(by, spearman_r): the correlation of mean ranks; 0 where a side is constant.

    Only the column with fewer values brings its ranks back to the rows. Their sum for each value of the other column is
    all that the products of ranks need, so that column is ranked by value alone.
    """
    by = by or []
    x = df.select(*by, a, b)
    kinds = x.agg(*[F.approx_count_distinct(c) for c in (a, b)]).first()
    many, few = (a, b) if kinds[0] >= kinds[1] else (b, a)
    group = [F.col(c).alias(f"_g{c}") for c in by]
    same = [F.col(c).eqNullSafe(F.col(f"_g{c}")) for c in by] or F.lit(True)

    def from_middle(values: DataFrame) -> DataFrame:
        """Adds _r: how far a value's mean rank is from the middle of its group, 0 where a side is constant."""
        size = values.groupBy(*group).agg(F.sum("_n").alias("_size"))
        out = values.join(F.broadcast(size), same)
        return out.select(*values.columns, (F.col("_before") + (F.col("_n") - F.col("_size")) / 2).alias("_r"))

    ranks = saved(from_middle(cv.counted_values(x, few, by)), "ranks")
    sums = with_rank(x, ranks, few, by, "_r").groupBy(F.col(many).alias("value"), *by).agg(F.count("*").alias("_n"), F.sum("_r").alias("_other"))
    ranked = from_middle(cv.counted_before(sums, by))
    r = F.col("_r")
    left = ranked.groupBy(*by).agg(F.sum(r * r * F.col("_n")).alias("_aa"), F.sum(r * F.col("_other")).alias("_ab"))
    right = ranks.groupBy(*group).agg(F.sum(r * r * F.col("_n")).alias("_bb"))
    both = left.join(F.broadcast(right), same)
    rho = F.col("_ab") / F.sqrt("_aa") / F.sqrt("_bb")
    return both.select(*by, F.when((F.col("_aa") > 0) & (F.col("_bb") > 0), rho).otherwise(0.0).alias("spearman_r"))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or 1e-300)
        c = 1 + num / c or 1e-300
        f *= c * d
        if i and abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def correlation_p(r: float, n: float) -> float:
    """Two-sided p-value of a correlation of n pairs."""
    if n < 3 or r != r:
        return 1.0
    if abs(r) >= 1:
        return 0.0
    return incomplete_beta((n - 2) / 2, 0.5, 1 - r * r)


def with_p_values(metrics: DataFrame) -> DataFrame:
    """pearson_p and spearman_p for a table of results."""

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([correlation_p(a, b) for a, b in zip(r, n, strict=True)])

    return metrics.withColumn("pearson_p", p("pearson_r", "n_samples")).withColumn("spearman_p", p("spearman_r", "n_samples"))


def evaluate(preds: DataFrame, by: list[str], n_features: int | None = None, correlations: bool = True) -> DataFrame:
    """Metrics of out-of-fold predictions (by, fold, y, yhat): R² and errors by fold, correlations over all if asked for."""
    held = saved(preds.select(*by, "fold", "y", "yhat"), "preds")
    err = F.col("y") - F.col("yhat")
    per_fold = held.groupBy(*by, "fold").agg(
        F.sum(err * err).alias("sse"), (F.var_pop("y") * F.count("y")).alias("sst"), F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"), F.count("*").alias("n")
    )
    r2 = F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst"))
    out = per_fold.groupBy(*by).agg(
        F.avg(r2).alias("cv_r2_mean"), F.stddev_pop(r2).alias("cv_r2_std"), F.sqrt(F.avg("mse")).alias("cv_rmse_mean"), F.avg("mae").alias("cv_mae_mean"),
        F.sum("n").alias("n_samples"), F.count("*").cast("int").alias("n_folds"),
    )
    if correlations:
        pooled = held.groupBy(*by).agg(correlation("y", "yhat").alias("pearson_r"))
        out = out.join(pooled, by).join(spearman(held, "y", "yhat", by), by)
    return out.withColumn("n_features", F.lit(n_features).cast("int"))


def named(preds: DataFrame, model: str, strategy: str) -> DataFrame:
    return preds.withColumn("model_type", F.lit(model)).withColumn("cv_strategy", F.lit(strategy))


def evaluate_on_folds(x: DataFrame, cols: list[str], model: str = "ridge", label: str = "ddG", settings: dict | None = None, strategy: str = "given", id_col: str = ID) -> DataFrame:
    """One row of metrics for a model on rows with their folds."""
    preds = predictions(x, cols, label, model, settings, "fold", id_col)
    return with_p_values(evaluate(named(preds, model, strategy), ["model_type", "cv_strategy"], len(cols)))


def evaluate_on_splits(x: DataFrame, folds: DataFrame, cols: list[str], model: str = "ridge", label: str = "ddG", settings: dict | None = None, strategy: str = "given", id_col: str = ID) -> DataFrame:
    """One row of metrics for a model on a table of folds (id, fold)."""
    return evaluate_on_folds(x.join(folds, id_col), cols, model, label, settings, strategy, id_col)


def with_importances(metrics: DataFrame, x: DataFrame, cols: list[str], model: str, label: str = "ddG", settings: dict | None = None) -> DataFrame:
    """The metrics with feature_importances, a map of a fit on all rows; null for stacking, which has none."""
    if model == "stacking":
        return metrics.withColumn("feature_importances", F.lit(None).cast("map<string,double>"))
    rows = feature_importances(x, cols, model, label, settings).collect()  # a row a feature
    pairs = [y for r in rows for y in (F.lit(r.feature), F.lit(r.importance))]
    return metrics.withColumn("feature_importances", F.create_map(*pairs))


def train_and_evaluate(x: DataFrame, cols: list[str], model: str = "ridge", how: str = "kfold", group: str | None = None, k: int = 5, label: str = "ddG", settings: dict | None = None, id_col: str = ID, made: dict | None = None) -> DataFrame:
    """A model on kfold, repeated, group or logo folds. With few rows there are fewer folds; under LEAST rows no result.

    made: a dict that calls for the same rows and model share; the plain folds' predictions and metrics, which both kfold and repeated need, are kept there.
    """
    made = {} if made is None else made
    n = x.count()
    if n < LEAST:
        return _no_result(x, model, how, n, len(cols))
    k = max(2, min(k, n)) if n < k else k
    if how == "logo" and n < 2 * LEAST or how in ("group", "logo") and not group:
        how = "kfold"
    keep, by = [label, *[c for c in cols if c != label]], ["model_type", "cv_strategy"]
    if how in ("kfold", "repeated"):
        dealt = lambda seed: predictions(cv.kfold(x, k, True, seed, id_col, keep), cols, label, model, settings, "fold", id_col).select("fold", "y", "yhat")
        if not made:
            made["preds"] = saved(dealt(42), "preds")
            made["metrics"] = saved(with_p_values(evaluate(named(made["preds"], model, how), by, len(cols))), "metrics")
        plain = made["metrics"].withColumn("cv_strategy", F.lit(how))
        if how == "kfold":
            return plain
        parts = [made["preds"], *[dealt(42 + r).withColumn("fold", F.col("fold") + r * k) for r in (1, 2)]]
        errors = evaluate(named(together(parts), model, how), by, len(cols), False).withColumn("n_samples", F.lit(n).cast("long"))
        return errors.join(plain.select("model_type", "pearson_r", "spearman_r", "pearson_p", "spearman_p"), "model_type")
    makers = {"group": cv.group_folds, "logo": cv.leave_one_group_out}
    if how not in makers:
        raise ValueError(f"unknown cross-validation: {how}")
    return evaluate_on_folds(makers[how](x, group, k, 42, id_col, keep), cols, model, label, settings, how, id_col)


METRICS = "model_type string, cv_strategy string, cv_r2_mean double, cv_r2_std double, cv_rmse_mean double, cv_mae_mean double, n_samples long, n_folds int, pearson_r double, spearman_r double, n_features int, pearson_p double, spearman_p double"


def _no_result(x: DataFrame, model: str, how: str, n: int, p: int) -> DataFrame:
    nan = math.nan
    return x.sparkSession.createDataFrame([(model, how, nan, nan, nan, nan, n, 0, nan, nan, p, nan, nan)], METRICS)


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def multi_cv_evaluate(x: DataFrame, cols: list[str], group: str | None = None, model: str = "ridge", k: int = 5, label: str = "ddG", settings: dict | None = None, id_col: str = ID) -> DataFrame:
    hows = ["kfold", "repeated"] + (["group", "logo"] if group and x.select(group).distinct().count() >= 3 else [])
    made: dict = {}
    return together([train_and_evaluate(x, cols, model, h, group, k, label, settings, id_col, made) for h in hows])


def compare_models(x: DataFrame, cols: list[str], models: dict[str, dict], how: str = "kfold", group: str | None = None, k: int = 5, label: str = "ddG", id_col: str = ID) -> DataFrame:
    """A row of metrics a model. On plain folds the rows are dealt, predicted by all models and ranked once."""
    if how == "kfold" and models and set(models) <= {*linear.KINDS, *TREES, "stacking"} and (n := x.count()) >= max(k, LEAST):
        placed = cv.shuffled_rank(x.select(id_col, label, *[c for c in cols if c != label]), [], 42, id_col)  # written there
        edges = trees.bins(placed, cols) if set(models) - set(linear.KINDS) else []
        if not set(models) - set(linear.KINDS) or trees.by_cells(edges, n, k):
            preds = saved(predicted_together(placed, cols, models, k, label, id_col, edges), "preds")
            return with_p_values(evaluate_together(preds, list(models), "kfold", len(cols)))
    return together([train_and_evaluate(x, cols, m, how, group, k, label, s, id_col) for m, s in models.items()])


def predicted_together(placed: DataFrame, cols: list[str], models: dict[str, dict], k: int, label: str, id_col: str, edges: list[list[float]]) -> DataFrame:
    """(fold, y, a column a model) out of fold, of rows with their places (_rank) in a shuffled order, of which a fold takes every k-th."""
    held = placed.withColumn("fold", F.pmod("_rank", F.lit(k)).cast("int"))
    settings = {m: MODELS[m] | (s or {}) for m, s in models.items()}
    hows = {m: {"kind": TREES[m]} | s for m, s in settings.items() if m in TREES}
    if "stacking" in models:
        bases = {f"_{b}": {"kind": TREES[b]} | MODELS[b] | settings["stacking"][b] for b in BASES}
        hows |= bases
    needed = [label, *[c for c in cols if c != label]]  # what predictions are made of and compared with
    out, fits = held.select("fold", *needed), {}
    if hows:
        out = trees.predicted(out, cols, "fold", trees.fit_on_cells(held, cols, label, "fold", id_col, hows, list(range(k)), edges), edges)
    if chosen := [m for m in models if m in linear.KINDS]:
        gram = saved(gram_sums(held, cols, label), "gram")
        make = lambda fold, own, rest: [(fold, m, coef.tolist(), float(b)) for m in chosen for coef, b in [linear.fit(rest, m, settings[m])]]
        for r in by_fold(gram, len(cols) + 2, make, "fold int, model string, coef array<double>, b double").collect():  # a row a model and fold
            fits[r.model, r.fold] = cols, r.coef, r.b
    for fold in range(k) if "stacking" in models else ():
        inner = settings["stacking"]["folds"]
        place = F.col("_rank") - F.floor((F.col("_rank") + (k - 1 - fold)) / k)  # among the rows outside the fold, whose shuffled order is the same
        train = held.where(F.col("fold") != fold).withColumn("_inner", F.pmod(place, F.lit(inner)).cast("int"))
        own = trees.bins(train, cols)
        grown = trees.fit_on_cells(train, cols, label, "_inner", id_col, bases, list(range(inner)), own)
        seen = trees.predicted(train.select("_inner", *needed), cols, "_inner", grown, own)
        g, _ = gram_total(gram_sums(seen.withColumn("_all", F.lit(0)), list(bases), label, "_all"), len(bases) + 2)
        coef, b = linear.fit(g, "ridge", {"alpha": 1.0})
        fits["stacking", fold] = list(bases), coef.tolist(), float(b)
    return out.select("fold", F.col(label).cast("double").alias("y"), *[F.col(m) if m in hows else by_fits({f: fits[m, f] for f in range(k)}).alias(m) for m in models])


def by_fits(fits: dict[int, tuple[list[str], list[float], float]]) -> Column:
    """What the linear fit (columns, coefficients, constant) of a row's fold predicts."""
    dot = lambda cols, coef, b: reduce(lambda x, y: x + y, [F.col(c).cast("double") * F.lit(v) for c, v in zip(cols, coef, strict=True)], F.lit(b))
    return F.coalesce(*[F.when(F.col("fold") == f, dot(*fit)) for f, fit in fits.items()])


def evaluate_together(preds: DataFrame, models: list[str], strategy: str, n_features: int | None = None) -> DataFrame:
    """evaluate() of several models' predictions of the same rows (fold, y, a column a model): a pass for their errors, and the labels are ranked once."""
    err = {m: F.col("y") - F.col(m) for m in models}
    told = [F.struct(F.lit(m).alias("model_type"), F.sum(e * e).alias("sse"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae")) for m, e in err.items()]
    per_fold = preds.groupBy("fold").agg((F.var_pop("y") * F.count("y")).alias("sst"), F.count("*").alias("n"), F.array(*told).alias("_m")).select("sst", "n", F.inline("_m"))
    r2 = F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst"))
    out = per_fold.groupBy("model_type").agg(
        F.avg(r2).alias("cv_r2_mean"), F.stddev_pop(r2).alias("cv_r2_std"), F.sqrt(F.avg("mse")).alias("cv_rmse_mean"), F.avg("mae").alias("cv_mae_mean"),
        F.sum("n").alias("n_samples"), F.count("*").cast("int").alias("n_folds"),
    )
    pearson = preds.agg(*[correlation("y", m).alias(m) for m in models]).first()
    rho = spearman_together(preds, "y", models)
    both = preds.sparkSession.createDataFrame([(m, strategy, pearson[m], rho[m]) for m in models], "model_type string, cv_strategy string, pearson_r double, spearman_r double")
    names = ["model_type", "cv_strategy", *[c for c in out.columns if c != "model_type"], "pearson_r", "spearman_r"]
    return out.join(F.broadcast(both), "model_type").select(*names, F.lit(n_features).cast("int").alias("n_features"))


def spearman_together(df: DataFrame, a: str, others: list[str]) -> dict[str, float]:
    """spearman() of one column with each of others, which bring their ranks to the rows, so that the one is ranked once."""
    n = df.count()
    middle = lambda: F.col("_before") + (F.col("_n") - F.lit(n)) / 2  # noqa: E731  how far a value's mean rank is from the middle
    counted = together([df.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("_n")).withColumn("_of", F.lit(c)) for c in others])
    ranks = saved(cv.counted_before(counted, ["_of"]).withColumn("_r", middle()), "ranks")
    right = {r._of: r.bb for r in ranks.groupBy("_of").agg(F.sum(F.col("_r") * F.col("_r") * F.col("_n")).alias("bb")).collect()}  # a row a column
    x = df.select(a, *others)
    for i, c in enumerate(others):
        x = with_rank(x, ranks.where(F.col("_of") == c).select("value", F.col("_r").alias(f"_r{i}")), c, [], f"_r{i}")
    sums = x.groupBy(F.col(a).alias("value")).agg(F.count("*").alias("_n"), *[F.sum(f"_r{i}").alias(f"_o{i}") for i in range(len(others))])
    ranked = cv.counted_before(sums, []).withColumn("_r", middle())
    left = ranked.agg(F.sum(F.col("_r") * F.col("_r") * F.col("_n")).alias("aa"), *[F.sum(F.col("_r") * F.col(f"_o{i}")).alias(f"ab{i}") for i in range(len(others))]).first()
    varies = lambda c: (left.aa or 0) > 0 and (right.get(c) or 0) > 0
    return {c: left[f"ab{i}"] / math.sqrt(left.aa) / math.sqrt(right[c]) if varies(c) else 0.0 for i, c in enumerate(others)}


def compare_models_resistance_cv(x: DataFrame, cols: list[str], models: dict[str, dict], splits: DataFrame, label: str = "ddG", id_col: str = ID) -> DataFrame:
    """Models by strategies on the same folds (id, strategy, fold)."""
    splits = saved(splits, "splits")
    names = sorted(r[0] for r in splits.select("strategy").distinct().collect())
    one = lambda s: splits.where(F.col("strategy") == s).drop("strategy")
    return together([evaluate_on_splits(x, one(s), cols, m, label, settings, s, id_col) for s in names for m, settings in models.items()])


def combinations(grid: dict[str, list]) -> list[dict]:
    out: list[dict] = [{}]
    for name, values in grid.items():
        out = [o | {name: v} for o in out for v in values]
    return out


def nested_cv(x: DataFrame, cols: list[str], model: str = "ridge", grid: dict[str, list] | None = None, k: int = 5, inner: int = 3, label: str = "ddG", id_col: str = ID) -> DataFrame:
    """Outer folds, each predicted with the settings that do best (R²) in inner folds of the rest."""
    tried = combinations(grid or GRIDS.get(model, {}))
    if model in linear.KINDS:
        preds = nested_linear(x, cols, model, tried, k, inner, label, id_col)
    else:
        preds = nested_by_fits(x, cols, model, tried, k, inner, label, id_col)
    named = preds.withColumn("model_type", F.lit(model)).withColumn("cv_strategy", F.lit("nested"))
    return with_p_values(evaluate(named, ["model_type", "cv_strategy"], len(cols)))


def inner_fold(place: int, outer: int, k: int, inner: int) -> int:
    """The inner fold that a row at a place of the shuffled order has among the rows outside an outer fold, which takes every k-th place."""
    return (place - (place + k - 1 - outer) // k) % inner


def nested_linear(x: DataFrame, cols: list[str], model: str, tried: list[dict], k: int, inner: int, label: str, id_col: str) -> DataFrame:
    """(id, fold, y, yhat) with the whole grid from one pass over the rows.

    Outer and inner folds both follow from a row's place in one shuffled order, and repeat with k * inner places. So sums for
    each place modulo k * inner are all that any training set of any fold needs.
    """
    placed = cv.shuffled_rank(x.select(id_col, label, *[c for c in cols if c != label]), [], 42, id_col)  # written there
    p, classes = len(cols) + 2, k * inner
    rows = gram_sums(placed.withColumn("_class", F.pmod("_rank", F.lit(classes))), cols, label, "_class").collect()  # k * inner matrices
    grams = np.zeros((classes, p, p))
    for c, i, j, value in rows:
        grams[c, i, j] = grams[c, j, i] = value
    settings = [MODELS[model] | s for s in tried]

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for fold in f["id"]:
                rest = [c for c in range(classes) if c % k != fold]
                best = linear.best_setting(grams[rest], [inner_fold(c, fold, k, inner) for c in rest], model, settings)
                coef, b = linear.fit(grams[rest].sum(0), model, settings[best])
                yield pd.DataFrame({"_of": [fold], "_coef": [coef.tolist()], "_b": [b]})

    fits = saved(x.sparkSession.range(0, k, 1, k).mapInPandas(search, FITS), "fits")
    return with_fits(placed.withColumn("fold", F.pmod("_rank", F.lit(k)).cast("int")), fits, cols, label, "fold", id_col)


def nested_by_fits(x: DataFrame, cols: list[str], model: str, tried: list[dict], k: int, inner: int, label: str, id_col: str) -> DataFrame:
    outer = saved(x.join(cv.kfold(x, k, True, 42, id_col), id_col), "outer")
    parts = []
    for f in range(k):
        train, test = outer.where(F.col("fold") != f).drop("fold"), outer.where(F.col("fold") == f).drop("fold")
        within = saved(train.join(cv.kfold(train, inner, True, 42, id_col), id_col), "inner")
        r2 = [evaluate(predictions(within, cols, label, model, s, "fold", id_col).withColumn("m", F.lit(0)), ["m"]).first()["cv_r2_mean"] for s in tried]
        best = tried[int(np.argmax([-np.inf if v is None or math.isnan(v) else v for v in r2]))]
        parts.append(fit_predict(train, test, cols, label, model, best, id_col).withColumn("fold", F.lit(f)))
    return together(parts).select(id_col, "fold", "y", "yhat")


def feature_importances(x: DataFrame, cols: list[str], model: str = "ridge", label: str = "ddG", settings: dict | None = None) -> DataFrame:
    """(feature, importance) of a fit on all rows: the trees' importances, or a linear model's coefficients on scaled columns."""
    if model in linear.KINDS:
        g, _ = gram_total(gram_by_fold(x.withColumn("_f", F.lit(0)), cols, label, "_f"), len(cols) + 2)
        sd = np.sqrt(np.maximum(np.diagonal(g)[1:-1] / g[0, 0] - (g[0, 1:-1] / g[0, 0]) ** 2, 0))
        values = linear.fit(g, model, MODELS[model] | (settings or {}))[0] * sd
    else:
        values = estimator(model, label, settings or {}).fit(assembled(x, cols)).featureImportances.toArray()
    return x.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(cols, values, strict=True)], "feature string, importance double")


# ---------------------------------------------------------------- ablation


def gram_scores(gram: DataFrame, p: int, tries: list[tuple[str, dict, list[int]]]) -> list[float]:
    """Mean R² over folds of linear fits (model, settings, columns), each on the rows outside a fold; folds without variance do not count."""

    def score(k: int, own: np.ndarray, rest: np.ndarray) -> list[tuple]:
        r2 = [linear.scores(own, *linear.fit(rest, model, settings, use))[0] for model, settings, use in tries]
        return [(t, x) for t, x in enumerate(r2) if not math.isnan(x)]

    means = by_fold(saved(gram, "gram"), p, score, "t int, r2 double").groupBy("t").agg(F.avg("r2").alias("r2")).collect()
    found = {r.t: r.r2 for r in means}
    return [found.get(t, math.nan) for t in range(len(tries))]


def _without(x: DataFrame, cols: list[str], drops: dict[str, list[str]], model: str, label: str, settings: dict | None, id_col: str) -> tuple[float, dict[str, float]]:
    """Mean R² over folds (column fold) with all columns and without each set of them."""
    if model in linear.KINDS:  # every refit is arithmetic on the same sums
        tries = [(model, MODELS[model] | (settings or {}), [i for i, c in enumerate(cols) if c not in gone]) for gone in [[], *drops.values()]]
        full, *rest = gram_scores(gram_by_fold(x, cols, label), len(cols) + 2, tries)
        return full, dict(zip(drops, rest, strict=True))
    r2 = lambda left: evaluate(predictions(x, left, label, model, settings, "fold", id_col).withColumn("m", F.lit(0)), ["m"]).first()["cv_r2_mean"]
    return r2(cols), {name: r2([c for c in cols if c not in gone]) for name, gone in drops.items()}


def feature_ablation(x: DataFrame, cols: list[str], model: str = "ridge", label: str = "ddG", settings: dict | None = None, id_col: str = ID) -> DataFrame:
    """(feature_dropped, r2_without, r2_drop, importance_rank); x has a fold column."""
    full, rest = _without(x, cols, {c: [c] for c in cols}, model, label, settings, id_col)
    rows = x.sparkSession.createDataFrame([(c, v, full - v) for c, v in rest.items()], "feature_dropped string, r2_without double, r2_drop double")
    return rows.withColumn("importance_rank", F.row_number().over(W.orderBy(F.desc("r2_drop"), "feature_dropped")))


def group_ablation(x: DataFrame, cols: list[str], groups: dict[str, list[str]] = FEATURE_GROUPS, model: str = "ridge", label: str = "ddG", settings: dict | None = None, id_col: str = ID) -> DataFrame:
    """(group_dropped, n_features_dropped, r2_without, r2_drop); groups without a column, or with all, are skipped."""
    sets = {g: [c for c in names if c in cols] for g, names in groups.items()}
    sets = {g: names for g, names in sets.items() if names and len(names) < len(cols)}
    full, rest = _without(x, cols, sets, model, label, settings, id_col)
    rows = [(g, len(sets[g]), v, full - v) for g, v in rest.items()]
    return x.sparkSession.createDataFrame(rows, "group_dropped string, n_features_dropped int, r2_without double, r2_drop double")
