"""The library's inputs, derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import AMINO_ACIDS, LETTERS


#: A graph's rows come from one block of ids, so that more rows give more graphs, none of them larger: vectors, events
#: that change their graphs. Paths are whole.
VECTORS, MUTATED = 2_000, 100_000
#: Labels, and users modulo that, are below.
KINDS = 10


def graph(kind: Column, number: str, block: int, kinds: int = KINDS) -> Column:
    """The graph of a row: its kind in the block of its own number."""
    return (F.floor(F.col(number) / block) * kinds + kind).cast("string")


def graph_sql(kind: str, number: str, block: int, kinds: int = KINDS) -> str:
    return f"CAST({number} // {block} * {kinds} + {kind} AS VARCHAR)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str, size: float = 40.0) -> DataFrame:
    """Residues: a graph a label and block of vectors, coordinates from the first three components."""
    e = table(spark, sf_dir, "embeddings").withColumn("graph_id", graph(F.col("label"), "vec_id", VECTORS))
    order = W.partitionBy("graph_id").orderBy("vec_id")
    letter = F.substring(F.lit(LETTERS), F.pmod("vec_id", F.lit(20)).cast("int") + 1, F.lit(1))
    xyz = [(F.get("embedding", F.lit(i)).cast("double") * size).alias(c) for i, c in enumerate("xyz")]
    node = (F.row_number().over(order) - 1).cast("int")
    return e.select("graph_id", node.alias("node"), F.lit("A").alias("chain"), node.alias("resseq"), letter.alias("aa1"), *xyz)


def nodes_sql(size: float = 40.0) -> str:
    xyz = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) * {size} AS {c}" for i, c in enumerate("xyz"))
    return (
        "SELECT graph_id, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY vec_id) - 1 AS INTEGER) AS node, "
        f"substr('{LETTERS}', CAST(vec_id % 20 AS INTEGER) + 1, 1) AS aa1, {xyz} FROM (SELECT *, {graph_sql('label', 'vec_id', VECTORS)} AS graph_id FROM embeddings)"
    )


def edges_sql(size: float = 40.0, cutoff: float = 8.0, weight: str = "exp(-d / 5.0)") -> str:
    d = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
    return (
        f"SELECT graph_id, u, v, d AS distance, {weight} AS weight FROM (SELECT a.graph_id, a.node AS u, b.node AS v, {d} AS d "
        f"FROM ({nodes_sql(size)}) a JOIN ({nodes_sql(size)}) b ON a.graph_id = b.graph_id AND a.node < b.node) WHERE d < {cutoff}"
    )


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutations from events."""
    e = table(spark, sf_dir, "events")
    letter = lambda i: F.substring(F.lit(LETTERS), F.pmod(i, F.lit(20)).cast("int") + 1, F.lit(1))
    return e.select(
        F.col("event_id").alias("mutation_id"),
        graph(F.pmod("user_id", F.lit(10)), "event_id", MUTATED).alias("graph_id"),
        F.lit("A").alias("chain"),
        F.pmod(F.col("event_id") * 7, F.lit(50)).cast("int").alias("position"),
        letter(F.col("event_id")).alias("wild_type"),
        letter(F.col("event_id") * 3 + F.col("user_id") + 1).alias("mutation"),
        F.col("value").alias("ddG"),
    )


MUTATIONS_SQL = f"""SELECT event_id AS mutation_id, {graph_sql('user_id % 10', 'event_id', MUTATED)} AS graph_id, 'A' AS chain, CAST((event_id * 7) % 50 AS INTEGER) AS position,
  substr('{LETTERS}', CAST(event_id % 20 AS INTEGER) + 1, 1) AS wild_type,
  substr('{LETTERS}', CAST((event_id * 3 + user_id + 1) % 20 AS INTEGER) + 1, 1) AS mutation, value AS ddG FROM events"""

SCALES_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {h}::DOUBLE, {c}::DOUBLE, {v}::DOUBLE)" for a, b, h, c, v in AMINO_ACIDS) + ") t(aa1, aa3, h, c, v)"
FACTOR_SQL = "1 + 0.1 * (t.h - f.h) + 0.3 * abs(t.c - f.c) + 0.002 * abs(t.v - f.v)"


def path_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path a user: all its events in time; of events with one time and id the smaller value comes first."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id", "value")
    e = table(spark, sf_dir, "events")
    step = 1 + F.abs(F.col("value") - F.lag("value").over(order))
    return e.select(F.col("user_id").cast("string").alias("graph_id"), (F.row_number().over(order) - 1).cast("int").alias("node"), step.alias("step"))


def path_edges(path: DataFrame) -> DataFrame:
    link = path.where("node > 0")
    return link.select("graph_id", (F.col("node") - 1).alias("u"), F.col("node").alias("v"), F.lit(1.0).alias("distance"), (1 / F.col("step")).alias("weight"))


PATH_SQL = """SELECT CAST(user_id AS VARCHAR) AS graph_id, node, step, sum(coalesce(step, 0)) OVER (PARTITION BY user_id ORDER BY node) AS far FROM (
  SELECT user_id, CAST(row_number() OVER w - 1 AS INTEGER) AS node, 1 + abs(value - lag(value) OVER w) AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regression rows from lineitem, one for each order and line number."""
    total = lambda c: F.sum(F.col(c).cast("double"))
    li = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("mutation_id"))
    return li.agg(
        F.min("l_suppkey").alias("pdb_id"), total("l_quantity").alias("q"), total("l_discount").alias("d"), total("l_tax").alias("t"),
        F.min("l_returnflag").alias("model_type"), F.min("l_linestatus").alias("cv_strategy"), (total("l_extendedprice") / 1000).alias("ddG"),
    )


ROWS_SQL = """SELECT l_orderkey * 10 + l_linenumber AS mutation_id, min(l_suppkey) AS pdb_id, sum(CAST(l_quantity AS DOUBLE)) AS q, sum(CAST(l_discount AS DOUBLE)) AS d, sum(CAST(l_tax AS DOUBLE)) AS t,
  min(l_returnflag) AS model_type, min(l_linestatus) AS cv_strategy, sum(CAST(l_extendedprice AS DOUBLE)) / 1000 AS ddG FROM lineitem GROUP BY 1"""


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison, without negative zero."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in cols})
