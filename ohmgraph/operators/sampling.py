"""Dedupe, sampling, limits and the split of mutations into usable ones and rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ["pdb_id", "position", "wild_type", "mutation"]


def shuffle_key(id_col: str, seed: int) -> Column:
    """A random-looking order that any engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def limit_entries(df: DataFrame, n: int, id_col: str = "mutation_id") -> DataFrame:
    """The first n rows by id: a top-k, kept per task and then merged."""
    return df.orderBy(id_col).limit(n)


def dedupe_mutations(df: DataFrame, keys: list[str] | None = None, id_col: str = "mutation_id") -> DataFrame:
    """The row with the smallest id of each key; min_by combines before the shuffle, so a hot key costs a row a task."""
    keys = keys or KEYS
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.col(id_col)).alias("_r"))
    return first.select(*[F.col(f"_r.{c}").alias(c) for c in df.columns])


def quota_sample(df: DataFrame, n: int, by: str, seed: int, id_col: str) -> DataFrame:
    """min(size, max(1, n // groups)) rows of each group, by the shuffle key, at most n in all."""
    groups = df.agg(F.countDistinct(by)).first()[0]
    quota = max(1, n // max(1, groups))
    order = W.partitionBy(by).orderBy("_k", id_col)
    part = df.withColumn("_k", shuffle_key(id_col, seed)).withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= quota)
    return part.orderBy("_rn", "_k", id_col).limit(n).drop("_rn", "_k")


def stratified_sample(df: DataFrame, n: int = 300, by: str = "pdb_id", seed: int = 42, id_col: str = "mutation_id") -> DataFrame:
    """At most n rows spread over groups; small groups are not topped up from others."""
    return df if df.count() <= n else quota_sample(df, n, by, seed, id_col)


def diverse_sample(df: DataFrame, n: int = 2648, by: str = "pdb_id", seed: int = 42, id_col: str = "mutation_id") -> DataFrame:
    """n rows spread over groups, topped up at random where groups are small."""
    if df.count() <= n:
        return df
    part = quota_sample(df, n, by, seed, id_col)
    rest = df.join(part.select(id_col), id_col, "left_anti").withColumn("_k", shuffle_key(id_col, seed))
    more = rest.orderBy("_k", id_col).limit(max(0, n - part.count())).drop("_k")
    return part.unionByName(more)


def keep_available(df: DataFrame, structures: DataFrame, by: str = "pdb_id") -> DataFrame:
    return df.join(structures.select(by).distinct(), by, "left_semi")


def distinct_structures(df: DataFrame, cap: int | None = None, by: str = "pdb_id", id_col: str = "mutation_id") -> DataFrame:
    """Groups in the order of their first id; groups that share one, as repeated ids do, by name."""
    first = df.groupBy(by).agg(F.min(id_col).alias("first_id")).orderBy("first_id", by)
    return first.limit(cap) if cap else first


def scored_and_rejected(mutations: DataFrame, nodes: DataFrame, sites: DataFrame, least: int = 2, by: str = "graph_id", id_col: str = "mutation_id", value: str = "ddG") -> tuple[DataFrame, DataFrame]:
    """Mutations that can be scored, and the others with the reason why not."""
    sizes = nodes.groupBy(by).agg(F.count("*").alias("_n"))
    found = sites.where(F.col("node").isNotNull()).select(id_col).distinct().withColumn("_hit", F.lit(True))
    reason = (
        F.when(F.col(value).isNull() | F.isnan(value), "bad_value")
        .when(F.col("_n").isNull(), "no_structure")
        .when(F.col("_n") < least, "graph_too_small")
        .when(F.col("_hit").isNull(), "residue_not_found")
    )
    marked = mutations.join(sizes, by, "left").join(found, id_col, "left").withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("_n", "_hit", "reason"), marked.where("reason IS NOT NULL").select(id_col, "reason")
