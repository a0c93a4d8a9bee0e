"""Residue nodes and contact graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import aa3_to_aa1, conductance
from ..storage import saved


def graph_key(pdb_id: str, chain: str) -> Column:
    """Names the graph of one chain; a mutation without a chain means chain A."""
    return F.concat_ws(":", F.col(pdb_id), F.coalesce(F.col(chain), F.lit("A")))


def residue_nodes(atoms: DataFrame, chain: str | None = None, per_chain: bool = False) -> DataFrame:
    """One node for each residue of a structure's first model that has a CA atom, numbered in file order.

    A graph is a whole structure, its one chain asked for, or (per_chain) each of its chains. HETATM lines are no
    residues. Of alternate locations the fullest counts.
    """
    graph = ["graph_id"]
    ca = atoms.where("record = 'ATOM' AND atom = 'CA' AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    ca = ca.where(F.col("chain") == chain) if chain else ca
    ca = ca.withColumn("graph_id", graph_key("pdb_id", "chain") if chain or per_chain else F.col("pdb_id"))
    place = ["chain", "resseq", "icode"]
    first = ca.withColumn("_m", F.min("model").over(W.partitionBy(*graph))).where("model = _m")
    best = W.partitionBy(*graph, *place).orderBy(F.desc_nulls_last("occupancy"), "altloc", "line_no")
    one = first.withColumn("_at", F.min("line_no").over(W.partitionBy(*graph, *place))).withColumn("_k", F.row_number().over(best)).where("_k = 1")
    node = (F.row_number().over(W.partitionBy(*graph).orderBy("_at")) - 1).cast("int")
    return one.select("graph_id", node.alias("node"), "chain", "resseq", "resname", aa3_to_aa1(F.col("resname")).alias("aa1"), "x", "y", "z")


def contact_edges(nodes: DataFrame, cutoff: float = 8.0, method: str = "exponential", tau: float = 5.0) -> DataFrame:
    """Pairs of nodes of a graph that are nearer than cutoff: graph_id, u < v, distance, weight."""
    return weighted(contact_pairs(nodes, cutoff), cutoff, method, tau)


def weighted(pairs: DataFrame, cutoff: float = 8.0, method: str = "exponential", tau: float = 5.0) -> DataFrame:
    """The edges among pairs (graph_id, u, v, distance) that were searched for with this cutoff or a larger one. Pairs without
    a conductance (distance 0 under an inverse square) are no edges."""
    edges = pairs.where(F.col("distance") < cutoff).withColumn("weight", conductance(F.col("distance"), method, tau))
    return edges.where("weight IS NOT NULL")


def contact_pairs(nodes: DataFrame, cutoff: float = 8.0) -> DataFrame:
    """Pairs of nodes of a graph that are nearer than cutoff: graph_id, u < v, distance.

    A range join: nodes fall into cubes of the cutoff's size and only meet nodes of their own cube and of the half of the
    cubes around it that come later, so the work grows with the contacts and each pair of cubes meets once.
    """
    cube = [F.floor(F.col(c) / cutoff).alias(f"c{c}") for c in "xyz"]
    here = nodes.select("graph_id", F.col("node").alias("u"), *[F.col(c).alias(f"u{c}") for c in "xyz"], *cube)
    step = F.array(*[F.struct(*[F.lit(i).alias(n) for i, n in zip((a, b, c), ("da", "db", "dc"), strict=True)]) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) >= (0, 0, 0)])
    near = (
        nodes.select("graph_id", F.col("node").alias("v"), *[F.col(c).alias(f"v{c}") for c in "xyz"], *cube, F.inline(step))
        .withColumns({f"c{c}": F.col(f"c{c}") + F.col(d) for c, d in zip("xyz", ("da", "db", "dc"), strict=True)})
    )
    square = sum(((F.col(f"u{c}") - F.col(f"v{c}")) * (F.col(f"u{c}") - F.col(f"v{c}")) for c in "xyz"), F.lit(0.0))
    own = (F.col("da") == 0) & (F.col("db") == 0) & (F.col("dc") == 0)
    met = here.join(near, ["graph_id", "cx", "cy", "cz"]).where(~own | (F.col("u") < F.col("v"))).withColumn("distance", F.sqrt(square))
    ends = [F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")]
    return met.where(F.col("distance") < cutoff).select("graph_id", *ends, "distance")


def both_ways(edges: DataFrame, by: str = "graph_id", carry: tuple[str, ...] = ("weight",)) -> DataFrame:
    """Each edge from both of its ends: node, other."""
    return edges.select(by, F.inline(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("other")), F.struct(F.col("v").alias("node"), F.col("u").alias("other")))), *carry)


def locate_sites(mutations: DataFrame, nodes: DataFrame, by: str = "graph_id") -> DataFrame:
    """Each mutation with the first node of its graph at its position, of its chain if it has one; node is null where there is none."""
    first = nodes.groupBy(by, "chain", "resseq").agg(F.min("node").alias("node"))
    anywhere = first.groupBy(by, "resseq").agg(F.min("node").alias("_any"))
    keyed = mutations.withColumn("_p", F.col("position")).withColumn("_c", F.col("chain"))
    one = keyed.join(first.select(by, F.col("chain").alias("_c"), F.col("resseq").alias("_p"), "node"), [by, "_c", "_p"], "left")
    out = one.join(anywhere.withColumnRenamed("resseq", "_p"), [by, "_p"], "left")
    return out.withColumn("node", F.when(F.col("_c").isNull(), F.col("_any")).otherwise(F.col("node"))).drop("_any", "_p", "_c")


def graph_size_guard(nodes: DataFrame, least: int = 2, by: str = "graph_id") -> DataFrame:
    """Nodes of graphs that have enough of them."""
    return nodes.join(nodes.groupBy(by).count().where(F.col("count") >= least).select(by), by, "left_semi")


def graph_components(nodes: DataFrame, edges: DataFrame, by: str = "graph_id") -> DataFrame:
    """node and component, its smallest node: labels fall to the smallest around and jump to their label's label."""
    arcs = saved(both_ways(edges, by, ()), "arcs")
    labels = saved(nodes.select(by, "node", F.col("node").alias("component")), "labels")
    while True:
        told = arcs.join(labels.select(by, F.col("node").alias("other"), F.col("component").alias("_c")), [by, "other"])
        least = told.groupBy(by, "node").agg(F.min("_c").alias("_c"))
        near = labels.join(least, [by, "node"], "left").select(by, "node", "component", F.least("component", F.coalesce("_c", "component")).alias("_new"))
        jump = labels.select(by, F.col("node").alias("_new"), F.col("component").alias("_far"))
        new = saved(near.join(jump, [by, "_new"]).select(by, "node", F.least("_new", "_far").alias("component"), F.col("component").alias("_old")), "labels")
        labels = new.drop("_old")
        if new.where("component <> _old").isEmpty():
            return labels
