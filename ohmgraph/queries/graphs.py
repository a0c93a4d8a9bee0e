"""Queries over graphs, their metrics and their algebra; identities of resistor networks give the SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import contacts, features, linalg, mutate, rowstats
from ..operators import graphmetrics as G
from ..plans import jobs
from ..schema import LETTERS
from ..storage import saved
from .data import FACTOR_SQL, MUTATIONS_SQL, PATH_SQL, SCALES_SQL, edges_sql, mutations, nodes, nodes_sql, path_edges, path_nodes, rounded, table


def edges(spark, sf_dir, size=40.0, **how):
    return contacts.contact_edges(nodes(spark, sf_dir, size), 8.0, **how)


def g2_contact_edges(spark, sf_dir):
    return rounded(edges(spark, sf_dir), "distance", "weight")


G2_SQL = f"SELECT graph_id, u, v, round(distance, 6) AS distance, round(weight, 6) AS weight FROM ({edges_sql()})"


def g3_conductance(spark, sf_dir):
    e = edges(spark, sf_dir)
    made = e.select("graph_id", *[C.conductance(F.col("distance"), m).alias(m) for m in jobs.METHODS])
    return rounded(made.groupBy("graph_id").agg(*[F.sum(m).alias(m) for m in jobs.METHODS]), *jobs.METHODS)


G3_SQL = f"""SELECT graph_id, round(sum(exp(-distance / 5.0)), 6) AS exponential, round(sum(1 / (distance * distance)), 6) AS inverse_square, round(sum(1.0::DOUBLE), 6) AS binary
FROM ({edges_sql()}) GROUP BY graph_id"""


def g4_locate_sites(spark, sf_dir):
    m = mutations(spark, sf_dir).withColumn("chain", F.when(F.col("mutation_id") % 3 == 0, None).when(F.col("mutation_id") % 3 == 1, "B").otherwise("A"))
    return contacts.locate_sites(m, nodes(spark, sf_dir)).select("mutation_id", "node")


G4_SQL = f"SELECT mutation_id, CASE WHEN mutation_id % 3 <> 1 THEN n.node END AS node FROM ({MUTATIONS_SQL}) m LEFT JOIN ({nodes_sql()}) n ON m.graph_id = n.graph_id AND m.position = n.node"


def g6_graph_size_guard(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("graph_id"), F.col("l_linenumber").alias("node"))
    return contacts.graph_size_guard(o, 4)


G6_SQL = "SELECT l_orderkey AS graph_id, l_linenumber AS node FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) >= 4)"


def g7_components(spark, sf_dir):
    n, e = nodes(spark, sf_dir, 60.0), edges(spark, sf_dir, 60.0)
    by_labels = contacts.graph_components(n, e).groupBy("graph_id").agg(F.countDistinct("component").cast("int").alias("components"), F.sum("component").alias("total"))
    return by_labels.join(linalg.null_modes(n, e).withColumnRenamed("components", "null_modes"), "graph_id")


G7_SQL = f"""WITH RECURSIVE e AS (SELECT graph_id, u, v FROM ({edges_sql(60.0)})), a AS (SELECT * FROM e UNION ALL SELECT graph_id, v, u FROM e),
r(graph_id, node, other) AS (SELECT graph_id, node, node FROM ({nodes_sql(60.0)}) UNION SELECT r.graph_id, r.node, a.v FROM r JOIN a ON a.graph_id = r.graph_id AND a.u = r.other),
c AS (SELECT graph_id, node, min(other) AS component FROM r GROUP BY ALL)
SELECT graph_id, CAST(count(DISTINCT component) AS INTEGER) AS components, CAST(sum(component) AS BIGINT) AS total, CAST(count(DISTINCT component) AS INTEGER) AS null_modes FROM c GROUP BY graph_id"""


def m1_perturbation_factor(spark, sf_dir):
    m = mutations(spark, sf_dir).select("mutation_id", C.perturbation_factor(F.col("wild_type"), F.col("mutation")).alias("factor"))
    return rounded(m, "factor")


M1_SQL = f"SELECT mutation_id, round({FACTOR_SQL}, 6) AS factor FROM ({MUTATIONS_SQL}) m JOIN ({SCALES_SQL}) f ON f.aa1 = m.wild_type JOIN ({SCALES_SQL}) t ON t.aa1 = m.mutation"


def sites(spark, sf_dir, size=24.0):
    return mutate.site_factors(contacts.locate_sites(mutations(spark, sf_dir), nodes(spark, sf_dir, size)))


def m2_mutant_edges(spark, sf_dir):
    made = mutate.mutant_edges(edges(spark, sf_dir), sites(spark, sf_dir, 40.0))
    return rounded(made.groupBy("mutation_id").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")), "weight")


M2_SQL = f"""SELECT m.mutation_id, count(*) AS n, round(sum(e.weight * ({FACTOR_SQL})), 6) AS weight FROM ({MUTATIONS_SQL}) m JOIN ({SCALES_SQL}) f ON f.aa1 = m.wild_type
JOIN ({SCALES_SQL}) t ON t.aa1 = m.mutation JOIN ({edges_sql()}) e ON e.graph_id = m.graph_id AND (e.u = m.position OR e.v = m.position) GROUP BY 1"""


def m3_saturation_scan(spark, sf_dir):
    return mutate.saturation_scan(nodes(spark, sf_dir)).select("graph_id", "node", "wild_type", "mutation")


M3_SQL = f"SELECT graph_id, node, aa1 AS wild_type, s.l AS mutation FROM ({nodes_sql()}), (SELECT unnest(string_split('{LETTERS}', '')) AS l) s WHERE s.l <> aa1"


def r1_r2_degrees(spark, sf_dir):
    e = edges(spark, sf_dir)
    return rounded(G.conductance_degree(e).join(G.total_conductance(e), "graph_id"), "degree", "total")


R1_SQL = f"""WITH e AS ({edges_sql()}), t AS (SELECT graph_id, sum(weight) AS total FROM e GROUP BY 1)
SELECT graph_id, node, round(sum(weight), 6) AS degree, round(any_value(total), 6) AS total FROM (SELECT graph_id, u AS node, weight FROM e UNION ALL SELECT graph_id, v, weight FROM e) JOIN t USING (graph_id) GROUP BY 1, 2"""


def path(spark, sf_dir):
    n = path_nodes(spark, sf_dir)
    return n, path_edges(n)


def r3_r5_currents_and_power(spark, sf_dir):
    """From the first event of a path to its sink, event 5: one unit flows on each edge between."""
    n, e = path(spark, sf_dir)
    volts = linalg.node_voltages(n, e, 0, [5])
    flows = G.edge_currents(e, volts).join(G.edge_power(e, volts).drop("weight"), ["graph_id", "u", "v"])
    at = G.at_sites(flows, e.select("graph_id", F.col("u").alias("node")))
    return rounded(at.select("graph_id", "u", "v", "node", "current", "power"), "current", "power")


# The order of data.path_nodes, whole: events that share time and id go by value, and what is missing comes first.
R3_PATH_SQL = PATH_SQL.replace("ORDER BY ts, event_id", "ORDER BY ts NULLS FIRST, event_id NULLS FIRST, value NULLS FIRST")
R3_SQL = f"""WITH p AS ({R3_PATH_SQL}), big AS (SELECT graph_id FROM p GROUP BY 1 HAVING max(node) >= 5), e AS (SELECT graph_id, node - 1 AS u, node AS v, step FROM p WHERE node > 0),
s AS (SELECT DISTINCT graph_id, u AS node FROM e)
SELECT e.graph_id, u, v, s.node, CASE WHEN v <= 5 THEN 1.0::DOUBLE ELSE 0.0 END AS current, CASE WHEN v <= 5 THEN round(step, 6) ELSE 0.0 END AS power
FROM e JOIN big USING (graph_id) JOIN s ON s.graph_id = e.graph_id AND (s.node = u OR s.node = v)"""


def r6_r7_entropy_and_concentration(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_extendedprice").cast("double").alias("x"))
    return rounded(G.entropy(li, "x", ["l_suppkey"]).join(G.herfindahl(li, "x", ["l_suppkey"]), "l_suppkey"), "entropy", "herfindahl")


R6_SQL = """WITH p AS (SELECT l_suppkey, CAST(l_extendedprice AS DOUBLE) / sum(CAST(l_extendedprice AS DOUBLE)) OVER (PARTITION BY l_suppkey) AS p FROM lineitem)
SELECT l_suppkey, round(-sum(p * ln(p)), 6) AS entropy, round(sum(p * p), 6) AS herfindahl FROM p GROUP BY 1"""


def r8_hop_shells(spark, sf_dir):
    e = edges(spark, sf_dir)
    seeds = nodes(spark, sf_dir).select("graph_id", "node")
    return G.hop_shells(e, seeds, 3).groupBy("graph_id", "site", "hop").agg(F.count("*").alias("n"), F.sum("node").alias("total"))


R8_SQL = f"""WITH e AS ({edges_sql()}), a AS (SELECT graph_id, u, v FROM e UNION SELECT graph_id, v, u FROM e), s0 AS (SELECT graph_id, node AS site, node FROM ({nodes_sql()})),
s1 AS (SELECT DISTINCT s.graph_id, site, a.v AS node FROM s0 s JOIN a ON a.graph_id = s.graph_id AND a.u = s.node EXCEPT SELECT * FROM s0),
s2 AS (SELECT DISTINCT s.graph_id, site, a.v AS node FROM s1 s JOIN a ON a.graph_id = s.graph_id AND a.u = s.node EXCEPT (SELECT * FROM s0 UNION SELECT * FROM s1)),
s3 AS (SELECT DISTINCT s.graph_id, site, a.v AS node FROM s2 s JOIN a ON a.graph_id = s.graph_id AND a.u = s.node EXCEPT (SELECT * FROM s0 UNION SELECT * FROM s1 UNION SELECT * FROM s2))
SELECT graph_id, site, hop, count(*) AS n, CAST(sum(node) AS BIGINT) AS total FROM (SELECT *, 1 AS hop FROM s1 UNION ALL SELECT *, 2 FROM s2 UNION ALL SELECT *, 3 FROM s3) GROUP BY ALL"""


def r9_shell_mean_resistance(spark, sf_dir):
    return rounded(G.shell_mean_resistance(*path(spark, sf_dir), 2), "mean_r")


R9_SQL = f"""WITH p AS ({PATH_SQL}) SELECT a.graph_id, a.node AS site, abs(a.node - b.node) AS hop, round(avg(abs(a.far - b.far)), 6) AS mean_r
FROM p a JOIN p b ON a.graph_id = b.graph_id AND abs(a.node - b.node) BETWEEN 1 AND 2 GROUP BY ALL"""


def r10_r11_resistance_rows(spark, sf_dir):
    n, e = path(spark, sf_dir)
    return rounded(rowstats.resistance_stats(n, e), "harmonic_mean", "median", "skewness", "kurtosis", "centrality", digits=4)


R10_SQL = f"""WITH p AS ({PATH_SQL}), r AS (SELECT a.graph_id, a.node AS i, abs(a.far - b.far) AS r FROM p a JOIN p b ON a.graph_id = b.graph_id AND a.node <> b.node),
s AS (SELECT *, r - avg(r) OVER (PARTITION BY graph_id, i) AS d FROM r)
SELECT graph_id, i, round(count(*) / sum(1 / r), 4) AS harmonic_mean, round(quantile_cont(r, 0.5), 4) AS median,
  CASE WHEN count(*) < 3 THEN 0 ELSE round(coalesce(avg(d * d * d) / nullif(pow(avg(d * d), 1.5), 0), 0), 4) END AS skewness,
  CASE WHEN count(*) < 3 THEN 0 ELSE round(coalesce(avg(d * d * d * d) / nullif(pow(avg(d * d), 2), 0) - 3, 0), 4) END AS kurtosis,
  round(count(*) / sum(r), 4) AS centrality FROM s GROUP BY graph_id, i"""


def r12_r16_kirchhoff_and_commute(spark, sf_dir):
    """A row a source i: the longest commute from there."""
    n, e = path(spark, sf_dir)
    s = saved(rowstats.source_stats(n, e), "sources")
    whole = s.groupBy("graph_id").agg((F.sum("total_r") / 2).alias("kirchhoff"))
    return rounded(rounded(whole.join(s.drop("total_r"), "graph_id"), "kirchhoff", digits=2), "longest", digits=1)


R12_SQL = f"""WITH p AS ({PATH_SQL}), w AS (SELECT graph_id, sum(CASE WHEN node > 0 THEN 1 / step ELSE 0 END) AS w FROM p GROUP BY 1),
k AS (SELECT a.graph_id, sum(abs(a.far - b.far)) / 2 AS k FROM p a JOIN p b ON a.graph_id = b.graph_id GROUP BY 1)
SELECT a.graph_id, a.node AS i, round(any_value(k), 2) AS kirchhoff, round(2 * any_value(w) * max(abs(a.far - b.far)), 1) AS longest
FROM p a JOIN p b ON a.graph_id = b.graph_id JOIN k ON k.graph_id = a.graph_id JOIN w ON w.graph_id = a.graph_id GROUP BY 1, 2"""


def r13_r14_pinv_rows(spark, sf_dir):
    """On complete graphs of equal weights, where the pseudoinverse is (I - J/n)/n: the lines of an order."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("graph_id"), F.col("l_linenumber").alias("node"))
    return rounded(rowstats.packed_inverse_stats(linalg.complete(li.where("graph_id IS NOT NULL")), 0.18), "anisotropy")


R13_SQL = """SELECT l_orderkey AS graph_id, l_linenumber AS i, CAST(CASE WHEN n = 1 THEN 0 WHEN 1.0 / (n - 1) > 0.18 THEN n - 1 ELSE 0 END AS BIGINT) AS radius,
  round(CASE WHEN n = 1 THEN 0 ELSE (n - 2) / (2.0 * sqrt(n - 1)) END, 6) AS anisotropy
FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) JOIN (SELECT l_orderkey, count(DISTINCT l_linenumber)::DOUBLE AS n FROM lineitem GROUP BY 1) USING (l_orderkey)"""


def r15_laplacian_rows(spark, sf_dir):
    return rounded(G.laplacian_rows(edges(spark, sf_dir)), "value")


R15_SQL = f"""WITH e AS ({edges_sql()}), a AS (SELECT graph_id, u AS i, v AS j, weight FROM e UNION ALL SELECT graph_id, v, u, weight FROM e)
SELECT graph_id, i, j, round(-weight, 6) AS value FROM a UNION ALL SELECT graph_id, i, i, round(sum(weight), 6) FROM a GROUP BY graph_id, i"""


def l1_l2_foster(spark, sf_dir):
    """Sum of conductance times effective resistance over a graph's edges: nodes less components."""
    n, e = nodes(spark, sf_dir, 24.0), edges(spark, sf_dir, 24.0)
    r = linalg.edge_resistance(n, e)
    return rounded(r.groupBy("graph_id").agg(F.sum(F.col("weight") * F.col("r")).alias("foster"), F.count("*").alias("n_edges")), "foster")


L1_SQL = f"""WITH e AS ({edges_sql(24.0)}), n AS (SELECT graph_id, count(DISTINCT node) AS n FROM (SELECT graph_id, u AS node FROM e UNION ALL SELECT graph_id, v FROM e) GROUP BY 1)
SELECT graph_id, CAST(any_value(n) - 1 AS DOUBLE) AS foster, count(*) AS n_edges FROM e JOIN n USING (graph_id) GROUP BY 1"""


def l2_path_resistance(spark, sf_dir):
    n, e = path(spark, sf_dir)
    pairs = n.where("node > 0").select("graph_id", F.lit(0).alias("i"), F.col("node").alias("j"))
    return rounded(linalg.effective_resistance(n, e, pairs), "r")


L2_SQL = f"SELECT graph_id, 0 AS i, node AS j, round(far, 6) AS r FROM ({PATH_SQL}) WHERE node > 0"


def l3_spectrum(spark, sf_dir):
    """Sums of eigenvalues and of their squares, from weights and degrees."""
    s = linalg.laplacian_spectrum(nodes(spark, sf_dir), edges(spark, sf_dir)).select("graph_id", F.explode("eigs").alias("x"))
    return rounded(s.groupBy("graph_id").agg(F.count("*").alias("n"), F.sum("x").alias("first"), F.sum(F.col("x") * F.col("x")).alias("second")), "first", "second")


L3_SQL = f"""WITH e AS ({edges_sql()}), d AS (SELECT graph_id, node, sum(weight) AS d FROM (SELECT graph_id, u AS node, weight FROM e UNION ALL SELECT graph_id, v, weight FROM e) GROUP BY 1, 2),
q AS (SELECT graph_id, sum(d * d) AS q FROM d GROUP BY 1), n AS (SELECT graph_id, count(*) AS n FROM ({nodes_sql()}) GROUP BY 1)
SELECT graph_id, any_value(n) AS n, round(2 * sum(weight), 6) AS first, round(any_value(q) + 2 * sum(weight * weight), 6) AS second FROM e JOIN q USING (graph_id) JOIN n USING (graph_id) GROUP BY 1"""


def unit_path(spark, sf_dir):
    """Paths of unit conductances, whose spectrum is known: a path a user."""
    n, e = path(spark, sf_dir)
    return n, e.withColumn("weight", F.lit(1.0))


UNIT_SQL = f"SELECT graph_id, node, CAST(count(*) OVER (PARTITION BY graph_id) AS DOUBLE) AS n FROM ({PATH_SQL})"


def l4_fiedler(spark, sf_dir):
    """On unit paths, half a cosine wave."""
    n, e = unit_path(spark, sf_dir)
    return rounded(linalg.fiedler_vector(n, e), "value", digits=5)


L4_SQL = f"SELECT graph_id, node, round(CASE WHEN n < 2 THEN 0 ELSE sqrt(2 / n) * cos(pi() * (node + 0.5) / n) END, 5) + 0.0 AS value FROM ({UNIT_SQL})"


def l5_node_voltages(spark, sf_dir):
    """The current that leaves each node: 1 at the source, -1/2 at two sinks, else 0; and the power, the drop from source to sinks."""
    n, e = nodes(spark, sf_dir, 24.0), edges(spark, sf_dir, 24.0)
    volts = saved(linalg.node_voltages(n, e, 3, [7, 11]), "volts")
    flow = G.edge_currents(e, volts)
    out = flow.select("graph_id", F.inline(F.array(F.struct(F.col("u").alias("node"), F.col("current").alias("c")), F.struct(F.col("v").alias("node"), (-F.col("current")).alias("c")))))
    return rounded(out.groupBy("graph_id", "node").agg(F.sum("c").alias("net")), "net")


L5_SQL = f"""SELECT DISTINCT graph_id, node, CASE node WHEN 3 THEN 1.0::DOUBLE WHEN 7 THEN -0.5::DOUBLE WHEN 11 THEN -0.5::DOUBLE ELSE 0.0::DOUBLE END AS net
FROM (SELECT graph_id, u AS node FROM ({edges_sql(24.0)}) UNION ALL SELECT graph_id, v FROM ({edges_sql(24.0)}))"""


def l5_terminal_voltages(spark, sf_dir):
    """Two runs in each graph with terminals from a table: the current that leaves each node."""
    n, e = nodes(spark, sf_dir, 24.0), edges(spark, sf_dir, 24.0)
    run = F.array(*[F.struct(F.lit(r).alias("run"), F.lit(i).alias("node"), F.lit(c).alias("current")) for r, i, c in ((1, 3, 1.0), (1, 7, -0.5), (1, 11, -0.5), (2, 0, 2.0), (2, 5, -2.0))])
    ends = n.select("graph_id").distinct().select("graph_id", F.inline(run))
    volts = saved(linalg.terminal_voltages(n, e, ends), "volts").withColumn("graph_id", F.concat_ws(":", "graph_id", "run"))
    each = e.withColumn("run", F.explode(F.array(F.lit(1), F.lit(2))))
    copies = each.select(F.concat_ws(":", "graph_id", "run").alias("graph_id"), "u", "v", "weight")
    flow = G.edge_currents(copies, volts)
    out = flow.select("graph_id", F.inline(F.array(F.struct(F.col("u").alias("node"), F.col("current").alias("c")), F.struct(F.col("v").alias("node"), (-F.col("current")).alias("c")))))
    return rounded(out.groupBy("graph_id", "node").agg(F.sum("c").alias("net")), "net")


L5B_SQL = f"""SELECT DISTINCT graph_id || ':' || run AS graph_id, node, CASE WHEN run = 1 AND node = 3 THEN 1.0::DOUBLE WHEN run = 1 AND node IN (7, 11) THEN -0.5::DOUBLE WHEN run = 2 AND node = 0 THEN 2.0::DOUBLE
WHEN run = 2 AND node = 5 THEN -2.0::DOUBLE ELSE 0.0::DOUBLE END AS net
FROM (SELECT graph_id, u AS node FROM ({edges_sql(24.0)}) UNION ALL SELECT graph_id, v FROM ({edges_sql(24.0)})), (VALUES (1), (2)) r(run)"""


def l6_current_flow_betweenness(spark, sf_dir):
    n, e = path(spark, sf_dir)
    return rounded(linalg.current_flow_betweenness(n, e), "betweenness")


L6_SQL = f"""SELECT graph_id, node, CASE WHEN n < 3 THEN 0.0::DOUBLE ELSE round(2.0 * node * (n - 1 - node) / ((n - 1) * (n - 2)), 6) END AS betweenness
FROM (SELECT graph_id, node, count(*) OVER (PARTITION BY graph_id) AS n FROM ({PATH_SQL}))"""


def l7_betweenness_topk(spark, sf_dir):
    """On paths, the middle nodes."""
    n, e = path(spark, sf_dir)
    return linalg.betweenness_topk(n, e, 5)


L7_SQL = f"""SELECT graph_id, CAST(rank AS INTEGER) AS rank, node FROM (SELECT graph_id, node, row_number() OVER (PARTITION BY graph_id ORDER BY node * (n - 1 - node) DESC, node) AS rank
FROM (SELECT graph_id, node, count(*) OVER (PARTITION BY graph_id) AS n FROM ({PATH_SQL}))) WHERE rank <= 5"""


def l8_wt_properties(spark, sf_dir):
    """On unit paths: spectrum, trace, active sites, an end's potential."""
    n, e = unit_path(spark, sf_dir)
    w = linalg.wt_properties(n, e)
    out = w.select(
        "graph_id", "n", "components", F.aggregate("eigs", F.lit(0.0), lambda a, x: a + x).alias("total"), F.get("eigs", F.lit(1)).alias("second"), F.element_at("eigs", -1).alias("last"),
        "kf", (F.col("trace") * F.col("n")).alias("trace_n"), F.get("lp_diag", F.lit(0)).alias("end"), F.get("fiedler", F.lit(0)).alias("fiedler_end"), F.size("u").alias("n_edges"),
        F.concat_ws(",", F.col("active").cast("array<string>")).alias("active"), (F.octet_length("lp") / 8).cast("long").alias("entries"),
    )
    return rounded(out.where("n > 1"), "total", "second", "last", "kf", "trace_n", "end", "fiedler_end", digits=4)


L8_SQL = f"""WITH u AS ({UNIT_SQL}), b AS (SELECT graph_id, node, row_number() OVER (PARTITION BY graph_id ORDER BY node * (n - 1 - node) DESC, node) AS rank FROM u),
a AS (SELECT graph_id, string_agg(CAST(node AS VARCHAR), ',' ORDER BY rank) AS active FROM b WHERE rank <= 5 GROUP BY 1)
SELECT graph_id, CAST(n AS INTEGER) AS n, 1 AS components, round(2 * (n - 1), 4) AS total, round(2 - 2 * cos(pi() / n), 4) AS second, round(2 - 2 * cos(pi() * (n - 1) / n), 4) AS last,
  round((n * n * n - n) / 6, 4) AS kf, round((n * n * n - n) / 6, 4) AS trace_n, round((n - 1) / 2 - (n * n - 1) / (6 * n), 4) AS "end", round(sqrt(2 / n) * cos(pi() / (2 * n)), 4) AS fiedler_end,
  CAST(n - 1 AS INTEGER) AS n_edges, active, CAST(n * n AS BIGINT) AS entries
FROM (SELECT DISTINCT graph_id, n FROM u WHERE n > 1) JOIN a USING (graph_id)"""


def l9_mutant_pinv(spark, sf_dir):
    """Foster's sum of every node's graph after a change there, by the low-rank update."""

    def make(g, i):
        total = []
        for k in range(g.n):
            lp, w = g.changed_inverse(k, 0.4 + 0.01 * k), g.changed(k, 0.4 + 0.01 * k).w
            total.append(float((w * (lp[g.u, g.u] + lp[g.v, g.v] - 2 * lp[g.u, g.v])).sum()))
        return {"node": i, "foster": total}

    n, e = nodes(spark, sf_dir, 24.0), edges(spark, sf_dir, 24.0)
    return rounded(linalg.per_graph(n, e, make, "node int, foster double"), "foster")


# Nodes less components; a component has one node that no smaller one reaches.
L9_SQL = f"""WITH RECURSIVE e AS MATERIALIZED ({edges_sql(24.0)}), a AS MATERIALIZED (SELECT graph_id, u, v FROM e UNION ALL SELECT graph_id, v, u FROM e), n AS (SELECT graph_id, node FROM ({nodes_sql(24.0)})),
r(graph_id, least, node) AS (SELECT graph_id, node, node FROM n UNION SELECT r.graph_id, r.least, a.v FROM r JOIN a ON a.graph_id = r.graph_id AND a.u = r.node WHERE a.v > r.least),
k AS (SELECT graph_id, count(*) FILTER (WHERE least = node) AS components FROM (SELECT graph_id, node, min(least) AS least FROM r GROUP BY 1, 2) GROUP BY 1)
SELECT graph_id, node, CAST(count(*) OVER (PARTITION BY graph_id) - components AS DOUBLE) AS foster FROM n JOIN k USING (graph_id)"""


def f1_mutation_features(spark, sf_dir):
    """All features of all mutations."""
    return jobs.features_of_graphs(mutations(spark, sf_dir), nodes(spark, sf_dir, 24.0))


def f1_feature_identities(spark, sf_dir):
    """The degree at the site, its fold change, and equal pairs among the features of all mutations."""
    x = f1_mutation_features(spark, sf_dir)
    same = F.abs(F.col("circuit_gain_wt") - F.col("voltage_transfer_ratio_wt")) < 1e-9
    sound = F.abs("delta_R_global_mean") <= F.col("delta_R_max") + 1e-9
    return rounded(x.select("mutation_id", "conductance_degree_wt", "conductance_degree_fold_change", same.alias("same"), sound.alias("sound")), "conductance_degree_wt", "conductance_degree_fold_change")


F1_SQL = f"""WITH e AS ({edges_sql(24.0)}), d AS (SELECT graph_id, node, sum(weight) AS d FROM (SELECT graph_id, u AS node, weight FROM e UNION ALL SELECT graph_id, v, weight FROM e) GROUP BY 1, 2)
SELECT mutation_id, round(coalesce(d, 0), 6) AS conductance_degree_wt, CASE WHEN d IS NULL THEN 0 ELSE round(log2({FACTOR_SQL}), 6) + 0.0 END AS conductance_degree_fold_change, true AS same, true AS sound
FROM ({MUTATIONS_SQL}) m JOIN ({SCALES_SQL}) f ON f.aa1 = m.wild_type JOIN ({SCALES_SQL}) t ON t.aa1 = m.mutation JOIN ({nodes_sql(24.0)}) n ON n.graph_id = m.graph_id AND n.node = m.position
LEFT JOIN d ON d.graph_id = n.graph_id AND d.node = n.node WHERE n.graph_id IN (SELECT graph_id FROM ({nodes_sql(24.0)}) GROUP BY 1 HAVING count(*) > 1)"""


def some_features(spark, sf_dir):
    """Features-like columns of every event."""
    ev = table(spark, sf_dir, "events")
    x = lambda i: F.col("value") * (i + 1) + F.col("user_id")
    return ev.select(F.col("event_id").alias("mutation_id"), F.lit("g").alias("graph_id"), *[x(i).alias(c) for i, c in enumerate(features.CROSS_SCALE)])


def f3_derived_features(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    q, t, d = (F.col(c).cast("double") for c in ("l_quantity", "l_tax", "l_discount"))
    made = li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("mutation_id"), q.alias("conductance_degree_wt"), (t + 1).alias("R_active_site_wt"), (d - 0.05).alias("fiedler_component_wt"),
        t.alias("max_edge_current_wt"), (d + 1).alias("voltage_wt"), t.alias("power_local_fraction_wt"), d.alias("delta_R_active_site"), t.alias("delta_voltage"),
        (q + 2).alias("n"), (d + 0.5).alias("factor"), (t + 2).alias("effective_graph_resistance_wt"), q.alias("delta_kirchhoff"), (d + 1).alias("resistance_centrality_wt"), t.alias("delta_R_global_mean"),
    )
    names = ["conductance_R_active_product", "fiedler_squared_wt", "current_R_product_wt", "voltage_conductance_product_wt", "power_deltaR_product", "voltage_fold_change",
             "R_active_fold_change", "kirchhoff_fold_change", "conductance_degree_fold_change", "R_global_fold_change"]
    return rounded(features.derived_features(made).select("mutation_id", *names), *names)


F3_SQL = """SELECT l_orderkey * 10 + l_linenumber AS mutation_id, round(q * (t + 1), 6) AS conductance_R_active_product, round((d - 0.05) * (d - 0.05), 6) AS fiedler_squared_wt, round(t * (t + 1), 6) AS current_R_product_wt,
  round((d + 1) * q, 6) AS voltage_conductance_product_wt, round(t * d, 6) AS power_deltaR_product, round(log2((d + 1 + t) / (d + 1)), 6) + 0.0 AS voltage_fold_change,
  round(log2((t + 1 + d) / (t + 1)), 6) + 0.0 AS R_active_fold_change, round(log2(((t + 2) * (q + 2) * (q + 1) / 2 + q) / ((t + 2) * (q + 2) * (q + 1) / 2)), 6) AS kirchhoff_fold_change,
  round(log2(d + 0.5), 6) + 0.0 AS conductance_degree_fold_change, round(log2(((q + 1) / ((q + 2) * (d + 1)) + t) / ((q + 1) / ((q + 2) * (d + 1)))), 6) + 0.0 AS R_global_fold_change
FROM (SELECT *, CAST(l_quantity AS DOUBLE) AS q, CAST(l_tax AS DOUBLE) AS t, CAST(l_discount AS DOUBLE) AS d FROM lineitem)"""


def f4_f5_multi_scale(spark, sf_dir):
    """All mutations at 8 and 6 angstroms, with all ten compared features."""
    return jobs.multi_scale(mutations(spark, sf_dir), nodes(spark, sf_dir, 24.0))


def f4_f5_scales(spark, sf_dir):
    wide = some_features(spark, sf_dir)
    near = wide.withColumns({c: F.col(c) / 2 for c in features.CROSS_SCALE})
    both = features.cross_scale_features(features.multi_scale_features(near, wide))
    names = ["norton_current_wt_6A", "scale_diff_norton_current_wt", "scale_ratio_norton_current_wt"]
    return rounded(both.select("mutation_id", *names), *names)


F4_SQL = """SELECT event_id AS mutation_id, round(x / 2, 6) AS norton_current_wt_6A, round(x / 2, 6) AS scale_diff_norton_current_wt, CASE WHEN x = 0 THEN 0.0 ELSE 2.0::DOUBLE END AS scale_ratio_norton_current_wt
FROM (SELECT *, value * 10 + user_id AS x FROM events)"""


def f6_aa_substitution(spark, sf_dir):
    x = features.aa_substitution_features(mutations(spark, sf_dir))
    names = ["cc_volume_change", "cc_hydrophobicity_change", "cc_abs_charge_change", "cc_impedance_factor", "cc_volume_ratio"]
    return rounded(x.select("mutation_id", *names, "cc_charge_swap", "cc_pro_gly", "cc_cys"), *names)


F6_SQL = f"""SELECT mutation_id, round((t.v - f.v) / 100, 6) AS cc_volume_change, round(t.h - f.h, 6) + 0.0 AS cc_hydrophobicity_change, round(abs(t.c - f.c), 6) AS cc_abs_charge_change,
  round({FACTOR_SQL}, 6) AS cc_impedance_factor, round(t.v / f.v, 6) AS cc_volume_ratio, CAST((f.c <> 0) <> (t.c <> 0) AS INTEGER) AS cc_charge_swap,
  CAST((f.aa1 IN ('P', 'G')) <> (t.aa1 IN ('P', 'G')) AS INTEGER) AS cc_pro_gly, CAST((f.aa1 = 'C') <> (t.aa1 = 'C') AS INTEGER) AS cc_cys
FROM ({MUTATIONS_SQL}) m JOIN ({SCALES_SQL}) f ON f.aa1 = m.wild_type JOIN ({SCALES_SQL}) t ON t.aa1 = m.mutation"""


def part_importances(spark, sf_dir):
    """Sources of parts as features, their share of the retail price as importance."""
    p = table(spark, sf_dir, "part")
    name = F.concat(F.when(F.col("p_size") % 4 == 0, "cc_").when(F.col("p_size") % 4 == 1, "scale_").otherwise(""), F.col("p_brand"), F.when(F.col("p_size") % 4 == 2, "_6A").otherwise(""))
    sums = p.groupBy(name.alias("feature")).agg(F.sum(F.col("p_retailprice").cast("double")).alias("s"))
    return sums.crossJoin(sums.agg(F.sum("s").alias("t"))).select("feature", (F.col("s") / F.col("t")).alias("importance"))


IMPORTANCE_SQL = """SELECT feature, s / sum(s) OVER () AS importance FROM (SELECT CASE p_size % 4 WHEN 0 THEN 'cc_' WHEN 1 THEN 'scale_' ELSE '' END || p_brand || CASE p_size % 4 WHEN 2 THEN '_6A' ELSE '' END AS feature,
  sum(CAST(p_retailprice AS DOUBLE)) AS s FROM part GROUP BY 1)"""


def f7_select_by_importance(spark, sf_dir):
    return rounded(features.select_by_importance(part_importances(spark, sf_dir), 0.01), "importance", digits=9)


F7_SQL = f"SELECT feature, round(importance, 9) AS importance, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM ({IMPORTANCE_SQL}) WHERE importance >= 0.01"

BOTH = {
    "g2_contact_edges": (g2_contact_edges, G2_SQL), "g3_conductance": (g3_conductance, G3_SQL), "g4_locate_sites": (g4_locate_sites, G4_SQL), "g6_graph_size_guard": (g6_graph_size_guard, G6_SQL),
    "g7_components": (g7_components, G7_SQL), "m1_perturbation_factor": (m1_perturbation_factor, M1_SQL), "m2_mutant_edges": (m2_mutant_edges, M2_SQL), "m3_saturation_scan": (m3_saturation_scan, M3_SQL),
    "r1_r2_degrees": (r1_r2_degrees, R1_SQL), "r3_r5_currents_and_power": (r3_r5_currents_and_power, R3_SQL), "r6_r7_entropy_and_concentration": (r6_r7_entropy_and_concentration, R6_SQL),
    "r8_hop_shells": (r8_hop_shells, R8_SQL), "r9_shell_mean_resistance": (r9_shell_mean_resistance, R9_SQL), "r10_r11_resistance_rows": (r10_r11_resistance_rows, R10_SQL),
    "r12_r16_kirchhoff_and_commute": (r12_r16_kirchhoff_and_commute, R12_SQL), "r13_r14_pinv_rows": (r13_r14_pinv_rows, R13_SQL), "r15_laplacian_rows": (r15_laplacian_rows, R15_SQL),
    "l1_l2_foster": (l1_l2_foster, L1_SQL), "l2_path_resistance": (l2_path_resistance, L2_SQL), "l3_spectrum": (l3_spectrum, L3_SQL), "l4_fiedler": (l4_fiedler, L4_SQL), "l5_node_voltages": (l5_node_voltages, L5_SQL),
    "l6_current_flow_betweenness": (l6_current_flow_betweenness, L6_SQL), "l7_betweenness_topk": (l7_betweenness_topk, L7_SQL), "l8_wt_properties": (l8_wt_properties, L8_SQL), "l9_mutant_pinv": (l9_mutant_pinv, L9_SQL),
    "f1_mutation_features": (f1_mutation_features, None), "f1_feature_identities": (f1_feature_identities, F1_SQL), "f3_derived_features": (f3_derived_features, F3_SQL), "f4_f5_scales": (f4_f5_scales, F4_SQL),
    "f6_aa_substitution": (f6_aa_substitution, F6_SQL), "f7_select_by_importance": (f7_select_by_importance, F7_SQL),
    "f4_f5_multi_scale": (f4_f5_multi_scale, None), "l5_terminal_voltages": (l5_terminal_voltages, L5B_SQL),
}
