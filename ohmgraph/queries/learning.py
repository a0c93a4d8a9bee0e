"""Queries over folds, models, ablation and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds, models, reports
from ..plans import jobs
from ..storage import saved
from .data import ROWS_SQL, mutations, nodes, rounded, rows, table
from .graphs import IMPORTANCE_SQL, part_importances

COLS = ["q", "d", "t"]
KEY = "md5('42:' || mutation_id)"


def sizes(f, x, *by):
    """Folds of a table, with the value that they were cut by."""
    return f.join(x, "mutation_id").groupBy("fold", *by).agg(F.count("*").alias("n"), F.sum("mutation_id").alias("ids"))


SIZES_SQL = "SELECT CAST(fold AS INTEGER) AS fold{by}, count(*) AS n, CAST(sum(mutation_id) AS BIGINT) AS ids FROM f GROUP BY ALL"
STRATA_SQL = f"""x AS ({ROWS_SQL}), e AS (SELECT quantile_cont(q, 0.2) AS a, quantile_cont(q, 0.4) AS b, quantile_cont(q, 0.6) AS c, quantile_cont(q, 0.8) AS d FROM x),
s AS (SELECT mutation_id, q, CAST(q >= a AS INTEGER) + CAST(q >= b AS INTEGER) + CAST(q >= c AS INTEGER) + CAST(q >= e.d AS INTEGER) AS stratum FROM x, e)"""


def c1_quantile_strata(spark, sf_dir):
    return folds.quantile_strata(rows(spark, sf_dir), "q", 5).groupBy("stratum").agg(F.count("*").alias("n"), F.round(F.sum("q"), 4).alias("q"))


C1_SQL = f"WITH {STRATA_SQL} SELECT stratum, count(*) AS n, round(sum(q), 4) AS q FROM s GROUP BY 1"


def c2_c4_property_folds(spark, sf_dir):
    x = rows(spark, sf_dir)
    a = folds.centrality_folds(x.select("mutation_id", F.col("q").alias("resistance_centrality_wt")))
    b = folds.propagation_folds(x.select("mutation_id", F.col("q").alias("propagation_radius")))
    return a.join(b.withColumnRenamed("fold", "other"), "mutation_id")


C2_SQL = f"""WITH {STRATA_SQL}, r AS (SELECT mutation_id, (row_number() OVER (ORDER BY stratum, {KEY}, mutation_id) - 1) % 5 AS fold FROM s)
SELECT mutation_id, CAST(fold AS INTEGER) AS fold, CAST(fold AS INTEGER) AS other FROM r"""


# Whole groups, the largest first, each to the lightest of five folds.
GREEDY_SQL = f"""x AS ({ROWS_SQL}), gc AS (SELECT pdb_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, pdb_id) AS i FROM x GROUP BY 1),
w(i, pdb_id, fold, loads) AS (
  SELECT 0::BIGINT, (SELECT min(pdb_id) FROM gc), 0::BIGINT, list_transform(range(CAST((SELECT least(5, count(*)) FROM gc) AS BIGINT)), lambda v: 0::BIGINT)
  UNION ALL SELECT gc.i, gc.pdb_id, list_position(w.loads, list_min(w.loads)) - 1, list_transform(w.loads, lambda v, j: CASE WHEN j = list_position(w.loads, list_min(w.loads)) THEN v + gc.n ELSE v END)
  FROM w JOIN gc ON gc.i = w.i + 1
), g AS (SELECT pdb_id, fold FROM w WHERE i > 0)"""


def c5_group_folds(spark, sf_dir):
    """Each group with its fold."""
    x = rows(spark, sf_dir)
    f = folds.group_folds(x, "pdb_id", 5).join(x.select("mutation_id", "pdb_id"), "mutation_id")
    return f.groupBy("pdb_id", "fold").agg(F.count("*").alias("n"))


C5_SQL = f"WITH RECURSIVE {GREEDY_SQL} SELECT pdb_id, CAST(fold AS INTEGER) AS fold, gc.n FROM g JOIN gc USING (pdb_id)"


def c7_kfold(spark, sf_dir):
    x = rows(spark, sf_dir)
    return folds.kfold(x, 5).join(folds.kfold(x, 5, shuffle=False).withColumnRenamed("fold", "plain"), "mutation_id")


C7_SQL = f"""SELECT mutation_id, CAST((row_number() OVER (ORDER BY {KEY}, mutation_id) - 1) % 5 AS INTEGER) AS fold, CAST(ntile(5) OVER (ORDER BY mutation_id) - 1 AS INTEGER) AS plain FROM ({ROWS_SQL})"""


def c8_repeated_kfold(spark, sf_dir):
    return folds.repeated_kfold(rows(spark, sf_dir), 4).groupBy("repeat", "fold").agg(F.count("*").alias("n"), F.sum("mutation_id").alias("ids"))


C8_SQL = f"""SELECT r AS repeat, CAST(fold AS INTEGER) AS fold, count(*) AS n, CAST(sum(mutation_id) AS BIGINT) AS ids FROM (
  SELECT r, mutation_id, (row_number() OVER (PARTITION BY r ORDER BY md5((42 + r) || ':' || mutation_id), mutation_id) - 1) % 4 AS fold FROM ({ROWS_SQL}), (VALUES (0), (1), (2)) t(r)) GROUP BY ALL"""


def c9_leave_one_group_out(spark, sf_dir):
    x = rows(spark, sf_dir)
    return sizes(folds.leave_one_group_out(x, "pdb_id"), x, "pdb_id")


C9_SQL = f"WITH f AS (SELECT mutation_id, pdb_id, dense_rank() OVER (ORDER BY pdb_id) - 1 AS fold FROM ({ROWS_SQL})) " + SIZES_SQL.format(by=", pdb_id")


#: A whole number: sums of discounts end in bits that depend on the order of adding, and many of them equal a percentile.
PROPAGATION = "CAST(pmod(mutation_id, 1000) AS DOUBLE)"


def strata_folds_sql(col):
    """Folds by strata of a column, shuffled within."""
    return f"""SELECT mutation_id, (row_number() OVER (ORDER BY stratum, {KEY}, mutation_id) - 1) % 5 AS fold FROM (
      SELECT mutation_id, CAST(v >= e[1] AS INTEGER) + CAST(v >= e[2] AS INTEGER) + CAST(v >= e[3] AS INTEGER) + CAST(v >= e[4] AS INTEGER) AS stratum
      FROM (SELECT mutation_id, {col} AS v FROM x), (SELECT quantile_cont({col}, [0.2, 0.4, 0.6, 0.8]) AS e FROM x))"""


SPLITS_SQL = f"""{GREEDY_SQL}, z AS (SELECT 'centrality' AS strategy, * FROM ({strata_folds_sql("q")}) UNION ALL SELECT 'propagation', * FROM ({strata_folds_sql("mutation_id % 1000")})
UNION ALL SELECT 'kirchhoff_grouped', mutation_id, fold FROM x JOIN g USING (pdb_id))"""


def c6_c10_all_splits(spark, sf_dir):
    """Sizes of all folds, and sums of the ids in them; clusters are not SQL's, but the sizes of the folds over them are."""
    x = rows(spark, sf_dir).select("mutation_id", "pdb_id", F.col("q").alias("resistance_centrality_wt"), F.expr(PROPAGATION).alias("propagation_radius"), F.col("t").alias("voltage_wt"), F.col("ddG").alias("conductance_degree_wt"))
    s = folds.precompute_all_splits(x, 5, "pdb_id")
    return s.groupBy("strategy", "fold").agg(F.count("*").alias("n"), F.countDistinct("mutation_id").alias("different"), F.sum(F.when(F.col("strategy") != "spectral", F.col("mutation_id"))).alias("ids"))


C10_SQL = f"""WITH RECURSIVE {SPLITS_SQL} SELECT strategy, CAST(fold AS INTEGER) AS fold, count(*) AS n, count(DISTINCT mutation_id) AS different, CAST(sum(mutation_id) AS BIGINT) AS ids FROM z GROUP BY 1, 2
UNION ALL SELECT 'spectral', CAST(f AS INTEGER), (n + 4 - f) // 5, (n + 4 - f) // 5, NULL FROM (SELECT count(*) AS n FROM x), range(5) t(f)"""


def with_folds(spark, sf_dir, k=5):
    return rows(spark, sf_dir).withColumn("fold", F.pmod("mutation_id", F.lit(k)).cast("int"))


def e1_standardize(spark, sf_dir):
    z = models.standardize(with_folds(spark, sf_dir).select("mutation_id", "fold", *COLS), COLS)
    return rounded(z.groupBy("test_fold", "fold").agg(F.count("*").alias("n"), F.avg("q").alias("q"), F.stddev_pop("t").alias("t")), "q", "t")


E1_SQL = f"""WITH x AS (SELECT *, mutation_id % 5 AS fold FROM ({ROWS_SQL})), s AS (SELECT k AS test_fold, avg(q) AS m, stddev_pop(q) AS sd, stddev_pop(t) AS st FROM x, (SELECT unnest(range(5)) AS k) WHERE fold <> k GROUP BY 1)
SELECT CAST(test_fold AS INTEGER) AS test_fold, CAST(fold AS INTEGER) AS fold, count(*) AS n, round(avg((q - m) / sd), 6) + 0.0 AS q, round(stddev_pop(t / st), 6) AS t FROM x, s GROUP BY 1, 2"""


def e4_e12_ridge_one_column(spark, sf_dir):
    """Ridge on one column without penalty: least squares."""
    preds = models.ridge_predictions(with_folds(spark, sf_dir), ["q"], "ddG", 0.0)
    return rounded(preds.groupBy("fold").agg(F.sum("yhat").alias("total"), F.max("yhat").alias("most"), F.sum("y").alias("y")), "total", "most", "y", digits=4)


E4_SQL = f"""WITH x AS (SELECT *, mutation_id % 5 AS fold FROM ({ROWS_SQL})), f AS (SELECT k, regr_slope(ddG, q) AS b, regr_intercept(ddG, q) AS a FROM x, (SELECT unnest(range(5)) AS k) WHERE fold <> k GROUP BY 1)
SELECT CAST(fold AS INTEGER) AS fold, round(sum(a + b * q), 4) AS total, round(max(a + b * q), 4) AS most, round(sum(ddG), 4) AS y FROM x JOIN f ON f.k = x.fold GROUP BY 1"""


def e12_gram_by_fold(spark, sf_dir):
    """Each sum as a mean over its fold: sums of prices end in halves that rounding could take either way."""
    g = saved(models.gram_by_fold(with_folds(spark, sf_dir), ["q", "d"], "ddG"), "gram")
    n = g.where("i = 0 AND j = 0").select("fold", F.col("value").alias("n"))
    return g.join(n, "fold").select("fold", "i", "j", F.round(F.col("value") / F.col("n"), 6).alias("mean"))


E12_SQL = f"""WITH x AS (SELECT mutation_id % 5 AS fold, [1.0::DOUBLE, q, d, ddG] AS a FROM ({ROWS_SQL}))
SELECT CAST(fold AS INTEGER) AS fold, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(avg(a[i + 1] * a[j + 1]), 6) AS mean FROM x, range(4) r(i), range(4) s(j) WHERE i <= j GROUP BY 1, 2, 3"""


def given_predictions(spark, sf_dir):
    x = with_folds(spark, sf_dir)
    return x.select("mutation_id", "model_type", "cv_strategy", "fold", F.col("ddG").alias("y"), (F.col("q") * 1.5 + F.col("d")).alias("yhat"))


PREDS_SQL = f"SELECT mutation_id, model_type, cv_strategy, mutation_id % 5 AS fold, ddG AS y, q * 1.5 + d AS yhat FROM ({ROWS_SQL})"


def e7_evaluate(spark, sf_dir):
    """Labels and predictions to six digits: sums of prices and discounts end in bits that depend on the order of adding, and ranks ask which are equal."""
    m = models.with_p_values(models.evaluate(rounded(given_predictions(spark, sf_dir), "y", "yhat"), ["model_type", "cv_strategy"], 2))
    return rounded(m.drop("pearson_p", "spearman_p"), "cv_r2_mean", "cv_r2_std", "cv_rmse_mean", "cv_mae_mean", "pearson_r", "spearman_r")


E7_SQL = f"""WITH p AS (SELECT * REPLACE (round(y, 6) + 0.0 AS y, round(yhat, 6) + 0.0 AS yhat) FROM ({PREDS_SQL})), f AS (SELECT model_type, cv_strategy, fold, 1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)) AS r2, avg((y - yhat) * (y - yhat)) AS mse, avg(abs(y - yhat)) AS mae, count(*) AS n FROM p GROUP BY 1, 2, 3),
r AS (SELECT *, rank() OVER (PARTITION BY model_type, cv_strategy ORDER BY y) + (count(*) OVER (PARTITION BY model_type, cv_strategy, y) - 1) / 2.0 AS a, rank() OVER (PARTITION BY model_type, cv_strategy ORDER BY yhat) + (count(*) OVER (PARTITION BY model_type, cv_strategy, yhat) - 1) / 2.0 AS b FROM p),
c AS (SELECT model_type, cv_strategy, corr(y, yhat) AS pr, corr(a, b) AS sr FROM r GROUP BY 1, 2)
SELECT model_type, cv_strategy, round(avg(r2), 6) AS cv_r2_mean, round(stddev_pop(r2), 6) AS cv_r2_std, round(sqrt(avg(mse)), 6) AS cv_rmse_mean, round(avg(mae), 6) AS cv_mae_mean, CAST(sum(n) AS BIGINT) AS n_samples,
  CAST(count(*) AS INTEGER) AS n_folds, round(any_value(pr), 6) AS pearson_r, round(any_value(sr), 6) AS spearman_r, 2 AS n_features FROM f JOIN c USING (model_type, cv_strategy) GROUP BY 1, 2"""


def e9_spearman(spark, sf_dir):
    return rounded(models.spearman(rows(spark, sf_dir), "q", "ddG", ["model_type"]), "spearman_r")


E9_SQL = f"""SELECT model_type, round(corr(a, b), 6) AS spearman_r FROM (SELECT model_type, rank() OVER (PARTITION BY model_type ORDER BY q) + (count(*) OVER (PARTITION BY model_type, q) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY model_type ORDER BY ddG) + (count(*) OVER (PARTITION BY model_type, ddG) - 1) / 2.0 AS b FROM ({ROWS_SQL})) GROUP BY 1"""

SMALL = {"gbt": {"n": 5, "depth": 3, "rate": 0.3}, "rf": {"n": 8, "depth": 5}, "ridge": {}, "elastic_net": {}, "lasso": {}}


def e2_e13_compare_models(spark, sf_dir):
    """All models on plain folds, with few trees; their correlations follow the price."""
    x = saved(rows(spark, sf_dir), "rows")
    return models.compare_models(x, COLS, SMALL | {"stacking": {"gbt": SMALL["gbt"] | {"subsample": 0.8, "leaf": 5}, "rf": SMALL["rf"] | {"leaf": 3}}}, k=3)


# Least squares of ddG on q with a penalty, over s (run, fold, q, ddG): the slope of standardised values shrinks by 1 + penalty / n.
def one_column_sql(penalty):
    return f"""k AS (SELECT DISTINCT run, fold FROM s),
f AS (SELECT k.run, k.fold, covar_pop(ddG, q) / (var_pop(q) * (1 + {penalty} / count(*))) AS b, avg(ddG) AS my, avg(q) AS mq FROM s JOIN k ON s.run = k.run AND s.fold <> k.fold GROUP BY ALL),
p AS (SELECT s.run, s.fold, ddG AS y, my + b * (q - mq) AS yhat FROM s JOIN f ON f.run = s.run AND f.fold = s.fold),
e AS (SELECT run, fold, 1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)) AS r2, avg((y - yhat) * (y - yhat)) AS mse, count(*) AS n FROM p GROUP BY ALL)"""


def shown(m, *cols):
    return rounded(m.select(*cols, "n_samples", "n_folds", "cv_r2_mean", "cv_rmse_mean", "pearson_r"), "cv_r2_mean", "cv_rmse_mean", "pearson_r", digits=4)


def e11_multi_cv(spark, sf_dir):
    return shown(models.multi_cv_evaluate(saved(rows(spark, sf_dir), "rows"), ["q"], "model_type", "ridge", 5), "cv_strategy")


E11_SQL = f"""WITH x AS ({ROWS_SQL}), s AS (
  SELECT 'kfold' AS run, (row_number() OVER (ORDER BY {KEY}, mutation_id) - 1) % 5 AS fold, q, ddG FROM x
  UNION ALL SELECT 'repeated' || r, (row_number() OVER (PARTITION BY r ORDER BY md5((42 + r) || ':' || mutation_id), mutation_id) - 1) % 5, q, ddG FROM x, (VALUES (0), (1), (2)) t(r)
  UNION ALL SELECT g, dense_rank() OVER (PARTITION BY g ORDER BY model_type) - 1, q, ddG FROM x, (VALUES ('group'), ('logo')) t(g)
), {one_column_sql(1.0)},
m AS (SELECT rtrim(run, '012') AS cv_strategy, avg(r2) AS r2, sqrt(avg(mse)) AS rmse, count(*) AS folds FROM e GROUP BY 1), c AS (SELECT run, corr(y, yhat) AS r FROM p GROUP BY 1)
SELECT cv_strategy, (SELECT count(*) FROM x) AS n_samples, CAST(folds AS INTEGER) AS n_folds, round(r2, 4) AS cv_r2_mean, round(rmse, 4) AS cv_rmse_mean, round(r, 4) AS pearson_r
FROM m JOIN c ON c.run = CASE cv_strategy WHEN 'repeated' THEN 'kfold' ELSE cv_strategy END"""


def e14_models_by_strategies(spark, sf_dir):
    """Two models of one column on all strategies; folds over clusters are not SQL's."""
    x = saved(rows(spark, sf_dir).withColumnsRenamed({"q": "resistance_centrality_wt", "t": "voltage_wt"}).withColumn("propagation_radius", F.expr(PROPAGATION)), "rows")
    splits = folds.precompute_all_splits(x.select("mutation_id", "pdb_id", "resistance_centrality_wt", "propagation_radius", "voltage_wt"), 5, "pdb_id")
    m = models.compare_models_resistance_cv(x, ["resistance_centrality_wt"], {"ridge": {}, "lasso": {}}, splits)
    known = F.col("cv_strategy") != "spectral"
    return shown(m.withColumns({c: F.when(known, F.col(c)) for c in ("cv_r2_mean", "cv_rmse_mean", "pearson_r")}), "model_type", "cv_strategy")


E14_SQL = f"""WITH RECURSIVE {SPLITS_SQL}, s AS (SELECT strategy AS run, fold, q, ddG FROM z JOIN x USING (mutation_id)), k AS (SELECT DISTINCT run, fold FROM s),
f AS (SELECT k.run, k.fold, covar_pop(ddG, q) / stddev_pop(q) AS c, stddev_pop(q) AS sd, avg(ddG) AS my, avg(q) AS mq, count(*) AS n FROM s JOIN k ON s.run = k.run AND s.fold <> k.fold GROUP BY ALL),
p AS (SELECT m, s.run, s.fold, ddG AS y, my + CASE m WHEN 'ridge' THEN c / (1 + 1.0 / n) ELSE sign(c) * greatest(0, abs(c) - 0.1) END * (q - mq) / sd AS yhat FROM s JOIN f ON f.run = s.run AND f.fold = s.fold, (VALUES ('ridge'), ('lasso')) a(m)),
e AS (SELECT m, run, fold, 1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)) AS r2, avg((y - yhat) * (y - yhat)) AS mse, count(*) AS n FROM p GROUP BY ALL), c AS (SELECT m, run, corr(y, yhat) AS r FROM p GROUP BY 1, 2)
SELECT m AS model_type, run AS cv_strategy, CAST(sum(n) AS BIGINT) AS n_samples, CAST(count(*) AS INTEGER) AS n_folds, round(avg(r2), 4) AS cv_r2_mean, round(sqrt(avg(mse)), 4) AS cv_rmse_mean, round(any_value(r), 4) AS pearson_r
FROM e JOIN c USING (m, run) GROUP BY 1, 2 UNION ALL SELECT m, 'spectral', (SELECT count(*) FROM x), 5, NULL, NULL, NULL FROM (VALUES ('ridge'), ('lasso')) a(m)"""


def e15_nested_cv(spark, sf_dir):
    return shown(models.nested_cv(rows(spark, sf_dir), ["q"], "ridge"), "model_type", "cv_strategy")


def e15_nested_elastic_net(spark, sf_dir):
    return shown(models.nested_cv(rows(spark, sf_dir), ["q"], "elastic_net"), "model_type", "cv_strategy")


# How the slope of one standardised column follows from c, its covariance with the label, n rows and the settings a and l.
SLOPES = {"ridge": "c / (1 + a / n)", "elastic_net": "sign(c) * greatest(0, abs(c) - a * l) / (1 + a * (1 - l))"}


def nested_sql(model):
    """Five outer folds, each with the settings that do best in three inner ones; equal settings by their order."""
    tried = models.combinations(models.GRIDS[model])
    values = ", ".join(f"({i}, {s['alpha']}::DOUBLE, {s.get('l1', 0)}::DOUBLE)" for i, s in enumerate(tried))
    fit = "covar_pop(ddG, q) / stddev_pop(q) AS c, stddev_pop(q) AS sd, avg(ddG) AS my, avg(q) AS mq, count(*) AS n"
    return f"""WITH x AS ({ROWS_SQL}), o AS (SELECT *, (row_number() OVER (ORDER BY {KEY}, mutation_id) - 1) % 5 AS fold FROM x), t AS (SELECT * FROM (VALUES {values}) t(nth, a, l)),
i AS (SELECT k, o.*, (row_number() OVER (PARTITION BY k ORDER BY {KEY}, mutation_id) - 1) % 3 AS part FROM o, range(5) t(k) WHERE fold <> k),
f AS (SELECT k, j, {fit} FROM i, range(3) u(j) WHERE part <> j GROUP BY 1, 2),
v AS (SELECT i.k, j, nth, 1 - sum(pow(ddG - my - ({SLOPES[model]}) * (q - mq) / sd, 2)) / (var_pop(ddG) * count(*)) AS r2 FROM i JOIN f ON f.k = i.k AND f.j = i.part, t GROUP BY 1, 2, 3),
best AS (SELECT k, nth FROM (SELECT k, nth, row_number() OVER (PARTITION BY k ORDER BY avg(r2) DESC, nth) AS r FROM v GROUP BY 1, 2) WHERE r = 1),
g AS (SELECT k, ({SLOPES[model]}) / sd AS b, my, mq FROM (SELECT k, {fit} FROM i GROUP BY 1) JOIN best USING (k) JOIN t USING (nth)),
p AS (SELECT fold, ddG AS y, my + b * (q - mq) AS yhat FROM o JOIN g ON g.k = o.fold), e AS (SELECT fold, 1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)) AS r2, avg((y - yhat) * (y - yhat)) AS mse, count(*) AS n FROM p GROUP BY 1)
SELECT '{model}' AS model_type, 'nested' AS cv_strategy, CAST(sum(n) AS BIGINT) AS n_samples, CAST(count(*) AS INTEGER) AS n_folds, round(avg(r2), 4) AS cv_r2_mean, round(sqrt(avg(mse)), 4) AS cv_rmse_mean, (SELECT round(corr(y, yhat), 4) FROM p) AS pearson_r FROM e"""


def e5_penalised_one_column(spark, sf_dir):
    """Elastic net and lasso on one column, as the models are set and with larger penalties."""
    x = saved(with_folds(spark, sf_dir), "rows")
    parts = [models.linear_predictions(x, ["q"], "ddG", m, {"alpha": a}).withColumn("model", F.lit(m)).withColumn("alpha", F.lit(a)) for m in ("elastic_net", "lasso") for a in E5_ALPHAS]
    return rounded(models.together(parts).groupBy("model", "alpha", "fold").agg(F.avg("yhat").alias("mean"), F.max("yhat").alias("most")), "mean", "most", digits=4)


E5_ALPHAS = [0.1, 5.0, 1000.0]
E5_SQL = f"""WITH x AS (SELECT *, mutation_id % 5 AS fold FROM ({ROWS_SQL})),
f AS (SELECT k, covar_pop(ddG, q) / stddev_pop(q) AS c, stddev_pop(q) AS sd, avg(ddG) AS my, avg(q) AS mq FROM x, range(5) u(k) WHERE fold <> k GROUP BY 1),
p AS (SELECT m AS model, a AS alpha, fold, my + ({SLOPES["elastic_net"]}) * (q - mq) / sd AS yhat FROM x JOIN f ON f.k = x.fold, (VALUES ('elastic_net', 0.5::DOUBLE), ('lasso', 1.0::DOUBLE)) t(m, l), (SELECT unnest({E5_ALPHAS}::DOUBLE[]) AS a))
SELECT model, alpha, CAST(fold AS INTEGER) AS fold, round(avg(yhat), 4) AS mean, round(max(yhat), 4) AS most FROM p GROUP BY 1, 2, 3"""


def e16_importances(spark, sf_dir):
    return rounded(models.feature_importances(rows(spark, sf_dir), ["q"], "ridge", "ddG", {"alpha": 0.0}), "importance", digits=5)


E16_SQL = f"SELECT 'q' AS feature, round(regr_slope(ddG, q) * stddev_pop(q), 5) AS importance FROM ({ROWS_SQL})"


def e17_feature_ablation(spark, sf_dir):
    """Without a column, a fit on the other one."""
    a = models.feature_ablation(with_folds(spark, sf_dir), ["q", "d"], settings={"alpha": 0.0})
    return rounded(a.select("feature_dropped", "r2_without"), "r2_without", digits=5)


E17_SQL = f"""WITH x AS (SELECT *, mutation_id % 5 AS fold FROM ({ROWS_SQL})), f AS (SELECT k, regr_slope(ddG, q) AS b, regr_intercept(ddG, q) AS a, regr_slope(ddG, d) AS e, regr_intercept(ddG, d) AS c FROM x, (SELECT unnest(range(5)) AS k) WHERE fold <> k GROUP BY 1),
r AS (SELECT fold, 1 - sum(pow(ddG - f.a - b * q, 2)) / (var_pop(ddG) * count(*)) AS with_q, 1 - sum(pow(ddG - f.c - f.e * x.d, 2)) / (var_pop(ddG) * count(*)) AS with_d FROM x JOIN f ON f.k = x.fold GROUP BY 1)
SELECT 'd' AS feature_dropped, round(avg(with_q), 5) AS r2_without FROM r UNION ALL SELECT 'q', round(avg(with_d), 5) FROM r"""


def e18_group_ablation(spark, sf_dir):
    """Without money a fit on q, without size one on d and t; groups without a column or with all are skipped."""
    g = models.group_ablation(with_folds(spark, sf_dir), COLS, {"size": ["q"], "money": ["d", "t"], "absent": ["zz"], "all": COLS})
    return rounded(g.select("group_dropped", "n_features_dropped", "r2_without"), "r2_without", digits=5)


E18_SQL = f"""WITH x AS (SELECT *, mutation_id % 5 AS fold FROM ({ROWS_SQL})),
m AS (SELECT k, 1 + 1.0 / count(*) AS a, avg(ddG) AS my, avg(q) AS mq, avg(d) AS md, avg(t) AS mt, covar_pop(ddG, q) / stddev_pop(q) AS cq, covar_pop(ddG, d) / stddev_pop(d) AS cd, covar_pop(ddG, t) / stddev_pop(t) AS ct,
  stddev_pop(q) AS sq, stddev_pop(d) AS sd, stddev_pop(t) AS st, corr(d, t) AS r FROM x, range(5) u(k) WHERE fold <> k GROUP BY 1),
p AS (SELECT fold, ddG AS y, my + cq / a * (q - mq) / sq AS money, my + (a * cd - r * ct) / (a * a - r * r) * (d - md) / sd + (a * ct - r * cd) / (a * a - r * r) * (t - mt) / st AS size FROM x JOIN m ON m.k = x.fold),
e AS (SELECT fold, 1 - sum(pow(y - money, 2)) / (var_pop(y) * count(*)) AS money, 1 - sum(pow(y - size, 2)) / (var_pop(y) * count(*)) AS size FROM p GROUP BY 1)
SELECT 'money' AS group_dropped, 2 AS n_features_dropped, round(avg(money), 5) AS r2_without FROM e UNION ALL SELECT 'size', 1, round(avg(size), 5) FROM e"""


def e19_conductance_sensitivity(spark, sf_dir):
    """All metrics for each kind of conductance."""
    return jobs.conductance_sensitivity(mutations(spark, sf_dir), nodes(spark, sf_dir, 24.0))


# ---------------------------------------------------------------- reports


def metrics(spark, sf_dir):
    """Metric-like rows: how good documents of a source and language are."""
    lab = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars"), "doc_id")
    return lab.groupBy(F.col("source").alias("model_type"), F.col("lang").alias("cv_strategy")).agg(
        F.avg(F.col("quality").cast("double")).alias("pearson_r"), F.avg(F.col("n_chars").cast("double")).alias("cv_rmse_mean"), F.avg(F.col("toxic").cast("double")).alias("spearman_r")
    )


METRICS_SQL = """SELECT source AS model_type, lang AS cv_strategy, avg(CAST(quality AS DOUBLE)) AS pearson_r, avg(CAST(n_chars AS DOUBLE)) AS cv_rmse_mean, avg(CAST(toxic AS DOUBLE)) AS spearman_r
FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2"""


def t1_best_per_key(spark, sf_dir):
    return rounded(reports.best_per_key(metrics(spark, sf_dir), "pearson_r", ["cv_strategy"], ["model_type"]), "pearson_r", "cv_rmse_mean", "spearman_r")


T1_SQL = f"""SELECT model_type, cv_strategy, round(pearson_r, 6) AS pearson_r, round(cv_rmse_mean, 6) AS cv_rmse_mean, round(spearman_r, 6) AS spearman_r
FROM (SELECT *, row_number() OVER (PARTITION BY cv_strategy ORDER BY pearson_r DESC, model_type) AS k FROM ({METRICS_SQL})) WHERE k = 1"""


def t2_comparison_table(spark, sf_dir):
    pub = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("method"), F.lit("published").alias("category"), F.lit("own").alias("eval_protocol"), (F.col("s_acctbal").cast("double") / 10000).alias("pearson_r"), F.lit(1.0).alias("rmse"), F.lit(0.5).alias("spearman_r"))
    return rounded(reports.comparison_table(pub, metrics(spark, sf_dir)), "pearson_r", "rmse", "spearman_r")


T2_SQL = f"""SELECT method, category, eval_protocol, round(pearson_r, 6) AS pearson_r, round(rmse, 6) AS rmse, round(spearman_r, 6) AS spearman_r, CAST(row_number() OVER (ORDER BY pearson_r DESC, method) AS INTEGER) AS rank FROM (
SELECT s_name AS method, 'published' AS category, 'own' AS eval_protocol, CAST(s_acctbal AS DOUBLE) / 10000 AS pearson_r, 1.0::DOUBLE AS rmse, 0.5::DOUBLE AS spearman_r FROM supplier
UNION ALL SELECT 'ours ' || model_type || ' (' || cv_strategy || ')', 'circuit', cv_strategy, pearson_r, cv_rmse_mean, spearman_r FROM ({METRICS_SQL}))"""


def t3_tiers(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal").cast("double") / 10000).alias("r"))
    return reports.with_tiers(s, "r").select("s_suppkey", "tier", "meets_target")


T3_SQL = """SELECT s_suppkey, CASE WHEN r >= 0.7 THEN 'EXCELLENT' WHEN r >= 0.6 THEN 'GOOD' WHEN r >= 0.5 THEN 'MODERATE' WHEN r >= 0.35 THEN 'FAIR' ELSE 'LOW' END AS tier, r >= 0.65 AS meets_target
FROM (SELECT s_suppkey, CAST(s_acctbal AS DOUBLE) / 10000 AS r FROM supplier)"""


def t4_metric_pivot(spark, sf_dir):
    return rounded(reports.metric_pivot(metrics(spark, sf_dir), "cv_rmse_mean", ["de", "en", "es", "fr"]), "de", "en", "es", "fr")


T4_SQL = "SELECT model_type, " + ", ".join(f"round(any_value(CASE WHEN cv_strategy = '{c}' THEN cv_rmse_mean END), 6) AS {c}" for c in ("de", "en", "es", "fr")) + f" FROM ({METRICS_SQL}) GROUP BY 1"


def t5_dataset_summary(spark, sf_dir):
    one, groups = reports.dataset_summary(rows(spark, sf_dir))
    return rounded(one.crossJoin(groups.agg(F.max("n").alias("largest"))), "min_value", "max_value", "valid_share")


T5_SQL = f"""SELECT count(*) AS n_mutations, count(DISTINCT pdb_id) AS n_proteins, round(min(ddG), 6) AS min_value, round(max(ddG), 6) AS max_value,
  count(*) FILTER (WHERE pdb_id IS NOT NULL AND isfinite(ddG)) AS n_valid, round(count(*) FILTER (WHERE pdb_id IS NOT NULL AND isfinite(ddG)) / count(*), 6) AS valid_share,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM ({ROWS_SQL}) GROUP BY pdb_id)) AS largest FROM ({ROWS_SQL})"""


def t6_feature_histograms(spark, sf_dir):
    h = reports.feature_histograms(rows(spark, sf_dir).select(F.floor("q").alias("q"), F.floor("ddG").alias("ddG")), ["q", "ddG"])
    return rounded(h, "lo", "hi", "mean", "std")


T6_SQL = f"""WITH f AS (SELECT unnest(['q', 'ddG']) AS feature, unnest([floor(q), floor(ddG)]) AS value FROM ({ROWS_SQL})), s AS (SELECT feature, min(value) AS a, max(value) AS b, avg(value) AS m, stddev_samp(value) AS sd FROM f GROUP BY 1)
SELECT feature, CAST(bin AS INTEGER) AS bin, round(a + (b - a) / 20 * bin, 6) AS lo, round(a + (b - a) / 20 * (bin + 1), 6) AS hi, count(*) AS n, round(m, 6) AS mean, round(sd, 6) AS std
FROM (SELECT f.feature, a, b, m, sd, least(19, floor((value - a) / ((b - a) / 20))) AS bin FROM f JOIN s USING (feature)) GROUP BY feature, bin, a, b, m, sd"""


def t7_feature_target_corr(spark, sf_dir):
    return rounded(reports.feature_target_corr(rows(spark, sf_dir).withColumn("same", F.lit(1.0)), [*COLS, "same"]), "r")


T7_SQL = "SELECT feature, round(r, 6) AS r, abs(r) > 0.2 AS strong FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, ddG) AS r FROM ({ROWS_SQL})" for c in COLS) + " UNION ALL SELECT 'same', 0.0::DOUBLE)"


def t8_prediction_summary(spark, sf_dir):
    return rounded(reports.prediction_summary(given_predictions(spark, sf_dir)), "r", "rho", "rmse", "slope", "intercept")


T8_SQL = f"WITH p AS ({PREDS_SQL}), k AS (SELECT rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS a, rank() OVER (ORDER BY yhat) + (count(*) OVER (PARTITION BY yhat) - 1) / 2.0 AS b FROM p) SELECT count(*) AS n, round(corr(y, yhat), 6) AS r, (SELECT round(corr(a, b), 6) FROM k) AS rho, round(sqrt(avg((y - yhat) * (y - yhat))), 6) AS rmse, round(regr_slope(y, yhat), 6) AS slope, round(regr_intercept(y, yhat), 6) AS intercept FROM p"


def t9_top_importances(spark, sf_dir):
    return rounded(reports.top(part_importances(spark, sf_dir), "importance", 15, ["feature"]), "importance", digits=9)


T9_SQL = f"SELECT feature, round(importance, 9) AS importance FROM ({IMPORTANCE_SQL}) ORDER BY importance DESC, feature LIMIT 15"


def t10_importance_by_source(spark, sf_dir):
    return rounded(reports.importance_by_source(part_importances(spark, sf_dir)), "importance", "share", digits=9)


T10_SQL = f"""SELECT CASE WHEN feature LIKE 'cc\\_%' ESCAPE '\\' THEN 'amino_acid' WHEN feature LIKE 'scale\\_%' ESCAPE '\\' THEN 'cross_scale' WHEN feature LIKE '%\\_6A' ESCAPE '\\' THEN '6A' ELSE '8A' END AS source,
  count(*) AS n, round(sum(importance), 9) AS importance, round(sum(importance), 9) AS share FROM ({IMPORTANCE_SQL}) GROUP BY 1"""

BOTH = {
    "c1_quantile_strata": (c1_quantile_strata, C1_SQL), "c2_c4_property_folds": (c2_c4_property_folds, C2_SQL), "c5_group_folds": (c5_group_folds, C5_SQL), "c7_kfold": (c7_kfold, C7_SQL),
    "c8_repeated_kfold": (c8_repeated_kfold, C8_SQL), "c9_leave_one_group_out": (c9_leave_one_group_out, C9_SQL), "c6_c10_all_splits": (c6_c10_all_splits, C10_SQL),
    "e1_standardize": (e1_standardize, E1_SQL), "e4_ridge_one_column": (e4_e12_ridge_one_column, E4_SQL), "e12_gram_by_fold": (e12_gram_by_fold, E12_SQL), "e7_e10_evaluate": (e7_evaluate, E7_SQL), "e9_spearman": (e9_spearman, E9_SQL),
    "e2_e13_compare_models": (e2_e13_compare_models, None), "e8_e11_multi_cv": (e11_multi_cv, E11_SQL), "e14_models_by_strategies": (e14_models_by_strategies, E14_SQL), "e15_nested_cv": (e15_nested_cv, nested_sql("ridge")),
    "e15_nested_elastic_net": (e15_nested_elastic_net, nested_sql("elastic_net")), "e5_penalised_one_column": (e5_penalised_one_column, E5_SQL),
    "e16_importances": (e16_importances, E16_SQL), "e17_feature_ablation": (e17_feature_ablation, E17_SQL), "e18_group_ablation": (e18_group_ablation, E18_SQL), "e19_conductance_sensitivity": (e19_conductance_sensitivity, None),
    "t1_best_per_key": (t1_best_per_key, T1_SQL), "t2_comparison_table": (t2_comparison_table, T2_SQL), "t3_tiers": (t3_tiers, T3_SQL), "t4_metric_pivot": (t4_metric_pivot, T4_SQL), "t5_dataset_summary": (t5_dataset_summary, T5_SQL),
    "t6_feature_histograms": (t6_feature_histograms, T6_SQL), "t7_feature_target_corr": (t7_feature_target_corr, T7_SQL), "t8_prediction_summary": (t8_prediction_summary, T8_SQL), "t9_top_importances": (t9_top_importances, T9_SQL),
    "t10_importance_by_source": (t10_importance_by_source, T10_SQL),
}
