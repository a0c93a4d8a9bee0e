"""Mutations as changed conductances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import perturbation_factor
from ..schema import LETTERS


def site_factors(located: DataFrame, **weights: float) -> DataFrame:
    """Located mutations with the factor of their substitution."""
    return located.withColumn("factor", perturbation_factor(F.col("wild_type"), F.col("mutation"), **weights))


def mutant_edges(edges: DataFrame, sites: DataFrame, by: str = "graph_id", id_col: str = "mutation_id") -> DataFrame:
    """The edges that a mutation changes, with their new weight: only those at its site, never the whole graph again."""
    ends = edges.select(by, "u", "v", "distance", F.col("weight").alias("wt_weight"), F.explode(F.array("u", "v")).alias("node"))
    out = ends.join(sites.where("node IS NOT NULL").select(id_col, by, "node", "factor"), [by, "node"])
    return out.select(id_col, by, "u", "v", "distance", "wt_weight", (F.col("wt_weight") * F.col("factor")).alias("weight"))


def saturation_scan(nodes: DataFrame, by: str = "graph_id") -> DataFrame:
    """Every residue with every other amino acid."""
    to = F.explode(F.array(*[F.lit(a) for a in LETTERS])).alias("mutation")
    return nodes.select(by, "node", "chain", F.col("resseq").alias("position"), F.col("aa1").alias("wild_type"), to).where("mutation <> wild_type")
