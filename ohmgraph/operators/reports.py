"""Rankings, pivots and profiles of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import correlation, feature_source, meets_target, performance_tier
from .models import spearman


def best_per_key(metrics: DataFrame, metric: str, by: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """The row with the largest metric of each key, or of all; NaN and null never win, equals go to the first by ties."""
    order = W.partitionBy(*(by or [])).orderBy(F.desc_nulls_last("_v"), *(ties or []))
    value = F.when(~F.isnan(F.col(metric).cast("double")), F.col(metric))
    return metrics.withColumn("_v", value).withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_v", "_k")


PUBLISHED = ["method", "category", "eval_protocol", "pearson_r", "rmse", "spearman_r"]


def comparison_table(published: DataFrame, ours: DataFrame, prefix: str = "ours ", category: str = "circuit") -> DataFrame:
    """Published methods and ours (metrics rows), ranked by correlation; equals by name. A row a method."""
    own = ours.select(
        F.concat(F.lit(prefix), F.col("model_type"), F.lit(" ("), F.col("cv_strategy"), F.lit(")")).alias("method"),
        F.lit(category).alias("category"),
        F.col("cv_strategy").alias("eval_protocol"),
        "pearson_r",
        F.col("cv_rmse_mean").alias("rmse"),
        "spearman_r",
    )
    both = published.select(*PUBLISHED).unionByName(own)
    return both.withColumn("rank", F.row_number().over(W.orderBy(F.desc_nulls_last("pearson_r"), "method")))


def with_tiers(metrics: DataFrame, col: str = "pearson_r") -> DataFrame:
    return metrics.withColumn("tier", performance_tier(F.col(col))).withColumn("meets_target", meets_target(F.col(col)))


def metric_pivot(metrics: DataFrame, metric: str, columns: list[str], rows: str = "model_type", by: str = "cv_strategy") -> DataFrame:
    return metrics.groupBy(rows).pivot(by, columns).agg(F.first(metric, ignorenulls=True))


def dataset_summary(df: DataFrame, by: str = "pdb_id", value: str = "ddG") -> tuple[DataFrame, DataFrame]:
    """One row for the dataset, with how many of its rows are valid (have a group and a finite value), and the counts of its groups."""
    usable = F.col(by).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.abs(F.col(value)) < float("inf"))
    one = df.agg(F.count("*").alias("n_mutations"), F.countDistinct(by).alias("n_proteins"), F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.count_if(usable).alias("n_valid"), (F.count_if(usable) / F.count("*")).alias("valid_share"))
    return one, df.groupBy(by).agg(F.count("*").alias("n"))


def unpivoted(df: DataFrame, cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """(keep, feature, value): a row a feature."""
    return df.select(*(keep or []), F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols])))


def feature_histograms(df: DataFrame, cols: list[str], bins: int = 20) -> DataFrame:
    """(feature, bin, lo, hi, n, mean, std): equal-width bins that hold something; std is the sample's."""
    flat = unpivoted(df, cols)
    span = flat.groupBy("feature").agg(F.min("value").alias("lo_"), F.max("value").alias("hi_"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    width = (F.col("hi_") - F.col("lo_")) / bins
    at = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("lo_")) / width))).otherwise(0).cast("int")
    counted = flat.join(F.broadcast(span), "feature").withColumn("bin", at).groupBy("feature", "bin", "lo_", "hi_", "mean", "std").agg(F.count("*").alias("n"))
    edge = lambda i: F.col("lo_") + width * i
    return counted.select("feature", "bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"), "n", "mean", "std")


def feature_target_corr(df: DataFrame, cols: list[str], target: str = "ddG", flag: float = 0.2) -> DataFrame:
    """Correlation of each feature with the target, 0 where one does not vary."""
    flat = unpivoted(df, cols, [target])
    return flat.groupBy("feature").agg(correlation("value", target, 1e-12).alias("r")).withColumn("strong", F.abs("r") > flag)


def prediction_summary(preds: DataFrame) -> DataFrame:
    """n, r, rho, rmse and the line y = slope * yhat + intercept of out-of-fold predictions."""
    err = F.col("y") - F.col("yhat")
    one = preds.agg(
        F.count("*").alias("n"), correlation("y", "yhat").alias("r"), F.sqrt(F.avg(err * err)).alias("rmse"),
        F.regr_slope("y", "yhat").alias("slope"), F.regr_intercept("y", "yhat").alias("intercept"),
    )
    return one.crossJoin(spearman(preds, "y", "yhat").withColumnRenamed("spearman_r", "rho"))  # one row each


def top(df: DataFrame, col: str, n: int, ties: list[str]) -> DataFrame:
    """The n rows with the largest value; equals by ties."""
    return df.orderBy(F.desc_nulls_last(col), *ties).limit(n)


def importance_by_source(importances: DataFrame) -> DataFrame:
    """Features, importance and share of each set of features."""
    sums = importances.groupBy(feature_source(F.col("feature")).alias("source")).agg(F.count("*").alias("n"), F.sum("importance").alias("importance"))
    return sums.withColumn("share", F.col("importance") / F.sum("importance").over(W.partitionBy()))
