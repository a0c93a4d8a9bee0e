"""Queries over sources, cleaning, sampling and dedupe."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import contacts, sampling
from ..sources import mutations as M
from ..sources import structures as S
from ..storage import shared_dir
from .data import MUTATIONS_SQL, SCALES_SQL, mutations, nodes, nodes_sql, rounded, table


def folder(spark, what):
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def raw_table(spark, sf_dir):
    """Untidy headers and values."""
    m = mutations(spark, sf_dir)
    i = F.col("mutation_id")
    return m.select(
        F.when(i % 23 == 0, F.lit("1ab")).otherwise(F.concat(F.lit(" "), F.lower(F.lit("ab")), F.lpad("graph_id", 2, "0"), F.lit("_x "))).alias("PDB"),
        F.when(i % 17 == 0, "n/a").otherwise(F.concat(F.col("position").cast("string"), F.lit(".0"))).alias("Residue Number"),
        F.lower("wild_type").alias("WT"),
        F.when(i % 19 == 0, F.lit(None)).otherwise(F.concat(F.col("mutation"), F.lit(" "))).alias("Mutant"),
        F.when(i % 29 == 0, "high").otherwise(F.col("ddG").cast("string")).alias("ddG (kcal/mol)"),
        F.when(i % 5 == 0, F.lit(None)).otherwise(F.lit("6.5")).alias("pH"),
    )


NORMAL_SQL = f"""SELECT 'AB' || lpad(graph_id, 2, '0') AS pdb_id, 'A' AS chain, position, wild_type, mutation, round(ddG, 6) AS ddG,
  CASE WHEN mutation_id % 5 = 0 THEN NULL ELSE 6.5::DOUBLE END AS pH, 25.0::DOUBLE AS temperature, '' AS protein_name
FROM ({MUTATIONS_SQL}) WHERE mutation_id % 23 <> 0 AND mutation_id % 17 <> 0 AND mutation_id % 19 <> 0 AND mutation_id % 29 <> 0 AND ddG IS NOT NULL"""


def n1_normalize_mutations(spark, sf_dir):
    return rounded(M.normalize_mutations(raw_table(spark, sf_dir)), "ddG")


def a1_read_mutations_csv(spark, sf_dir):
    raw_table(spark, sf_dir).write.option("header", True).csv(at := folder(spark, "csv"))
    return rounded(M.read_mutations_csv(spark, at), "ddG")


def a2_read_mutations_parquet(spark, sf_dir):
    m = mutations(spark, sf_dir)
    code = F.concat("wild_type", F.col("position").cast("string"), "mutation")
    raw = m.select(F.concat(F.lit("ab"), F.lpad("graph_id", 2, "0")).alias("pdb id"), "position", F.col("wild_type").alias("wild type"), code.alias("mutation"), F.col("mutation").alias("mut residue"), F.col("ddG").alias("ddg"))
    raw.select(*[F.col(f"`{c}`").alias(c.replace(" ", "_")) for c in raw.columns]).write.parquet(at := folder(spark, "parquet"))
    return rounded(M.read_mutations_parquet(spark, at), "ddG")


A2_SQL = f"""SELECT 'AB' || lpad(graph_id, 2, '0') AS pdb_id, 'A' AS chain, position, wild_type, mutation, round(ddG, 6) AS ddG, 7.0::DOUBLE AS pH, 25.0::DOUBLE AS temperature,
  '' AS protein_name FROM ({MUTATIONS_SQL}) WHERE ddG IS NOT NULL"""


def records(spark, sf_dir):
    """Nested records: the id here or in protein, the value in one of two fields, at times 0."""
    m, i = mutations(spark, sf_dir), F.col("mutation_id")
    pdb = F.concat(F.lit("ab"), F.lpad("graph_id", 2, "0"))
    value = F.when(i % 7 == 0, 0.0).otherwise(F.col("ddG"))
    return m.select(
        F.pmod(i, F.lit(8)).alias("g"),
        F.struct(
            F.when(i % 2 == 0, pdb).alias("pdb_id"), F.struct(F.when(i % 2 == 1, pdb).alias("pdb_id"), F.lit("p").alias("name")).alias("protein"),
            F.when(i % 3 == 0, F.col("position")).alias("position"), F.when(i % 3 != 0, F.col("position")).alias("residue_number"),
            F.col("wild_type"), F.when(i % 4 == 0, "").otherwise(F.col("mutation")).alias("mutation"), F.when(i % 4 == 0, F.col("mutation")).alias("mutant_residue"),
            F.when(i % 2 == 0, value).alias("ddG"), F.when(i % 2 == 1, value).alias("delta_delta_G"),
        ).alias("r"),
    )


def n3_normalize_api_records(spark, sf_dir):
    return rounded(M.normalize_api_records(records(spark, sf_dir).select("r.*")), "ddG")


def a3_read_mutations_json(spark, sf_dir):
    """One object with results a file."""
    whole = records(spark, sf_dir).groupBy("g").agg(F.to_json(F.struct(F.collect_list("r").alias("results"))).alias("value"))
    whole.write.partitionBy("g").text(at := folder(spark, "json"))
    return rounded(M.read_mutations_json(spark, f"{at}/*"), "ddG")


N3_SQL = f"""SELECT 'AB' || lpad(graph_id, 2, '0') AS pdb_id, 'A' AS chain, position, wild_type, mutation, round(CASE WHEN mutation_id % 7 = 0 THEN 0.0::DOUBLE ELSE ddG END, 6) AS ddG,
  7.0::DOUBLE AS pH, 25.0::DOUBLE AS temperature, 'p' AS protein_name FROM ({MUTATIONS_SQL}) WHERE mutation_id % 7 = 0 OR ddG IS NOT NULL"""


def pdb_lines(spark, sf_dir):
    """Structure files: two models, a chain, a HETATM and an alternate location a residue."""
    n = nodes(spark, sf_dir, 24.0)
    atom = lambda rec, alt, occ, name="CA ", dx=0.0: F.format_string(
        rec + "%5d  " + name + alt + "GLY A%4d    %8.3f%8.3f%8.3f" + f"{occ:6.2f}" + "  0.00", F.pmod(F.col("node"), F.lit(9999)), F.pmod(F.col("node"), F.lit(9999)), F.col("x") + dx, F.col("y"), F.col("z")
    )
    lines = F.concat_ws("\n", atom("ATOM  ", "B", 0.4, dx=1.0), atom("ATOM  ", "A", 0.6), atom("ATOM  ", " ", 1.0, "N  "), atom("HETATM", " ", 1.0))
    body = n.groupBy("graph_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", lines.alias("l")))), lambda s: s["l"]), "\n").alias("b"))
    return body.select("graph_id", F.concat(F.lit("MODEL        1\n"), "b", F.lit("\nENDMDL\nMODEL        2\n"), "b", F.lit("\nENDMDL\n")).alias("value"))


def a4_read_structures(spark, sf_dir):
    pdb_lines(spark, sf_dir).write.partitionBy("graph_id").text(at := folder(spark, "pdb"))
    atoms = S.read_structures(spark, f"{at}/*/part-*", "graph_id=([^/]+)/")
    return atoms.groupBy("record", "model", "atom", "chain", "altloc").agg(F.count("*").alias("n"), F.round(F.avg("z"), 3).alias("z"))


A4_SQL = f"""WITH n AS ({nodes_sql(24.0)})
SELECT record, CAST(model AS INTEGER) AS model, atom, 'A' AS chain, altloc, count(*) AS n, round(avg(round(z, 3)), 3) AS z
FROM n, (VALUES ('ATOM', 'CA', 'A'), ('ATOM', 'CA', 'B'), ('ATOM', 'N', ''), ('HETATM', 'CA', '')) a(record, atom, altloc), (VALUES (1), (2)) m(model) GROUP BY ALL"""


def g1_residue_nodes(spark, sf_dir):
    pdb_lines(spark, sf_dir).write.partitionBy("graph_id").text(at := folder(spark, "pdb"))
    atoms = S.read_structures(spark, f"{at}/*/part-*", "graph_id=([^/]+)/")
    made = contacts.residue_nodes(atoms)
    return rounded(made.groupBy("chain", "resseq", "resname", "aa1").agg(F.count("*").alias("n"), F.min("node").alias("node"), F.sum("x").alias("x"), F.sum("y").alias("y")), "x", "y", digits=3)


G1_SQL = f"""WITH n AS ({nodes_sql(24.0)})
SELECT 'A' AS chain, node AS resseq, 'GLY' AS resname, 'G' AS aa1, count(*) AS n, min(node) AS node, round(sum(round(x, 3)), 3) + 0.0 AS x, round(sum(round(y, 3)), 3) + 0.0 AS y FROM n GROUP BY node"""


def a5_write_results(spark, sf_dir):
    m = mutations(spark, sf_dir).withColumn("extra", F.create_map(F.lit("k"), F.col("ddG")))
    S.write_results(m, at := folder(spark, "out"), "csv", ["graph_id"])
    back = spark.read.option("header", True).csv(at)
    return back.groupBy(F.col("graph_id").cast("string").alias("graph_id")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("ddG").cast("double")), 4).alias("total"), F.lit(len(back.columns)).alias("n_columns"))


A5_SQL = f"SELECT graph_id, count(*) AS n, round(sum(ddG), 4) AS total, 7 AS n_columns FROM ({MUTATIONS_SQL}) GROUP BY graph_id"


def n4_limit_entries(spark, sf_dir):
    return sampling.limit_entries(mutations(spark, sf_dir), 200).select("mutation_id", "graph_id", "position")


def n5_parse_mutation_code(spark, sf_dir):
    i = F.col("mutation_id")
    code = F.when(i % 11 == 0, "bad").when(i % 13 == 0, F.concat_ws(":", F.lit("x"), "wild_type", "mutation")).otherwise(F.concat_ws(":", F.col("position").cast("string"), F.lower("wild_type"), "mutation"))
    p = mutations(spark, sf_dir).select("mutation_id", C.parse_mutation_code(code).alias("p"))
    return p.select("mutation_id", F.col("p").isNull().alias("bad"), "p.position", "p.wild_type", "p.mutation")


N5_SQL = f"""SELECT mutation_id, bad, CASE WHEN NOT bad THEN position END AS position, CASE WHEN NOT bad THEN wild_type END AS wild_type, CASE WHEN NOT bad THEN mutation END AS mutation
FROM (SELECT *, mutation_id % 11 = 0 OR mutation_id % 13 = 0 AS bad FROM ({MUTATIONS_SQL}))"""


def n6_parse_site_list(spark, sf_dir):
    sites = F.concat_ws(", ", F.col("position").cast("string"), F.lit("x"), (F.col("position") + 1).cast("string"))
    m = mutations(spark, sf_dir).select("mutation_id", "graph_id", F.posexplode(C.parse_site_list(sites)).alias("place", "resseq"))
    return m.join(nodes(spark, sf_dir).select("graph_id", "resseq", "node"), ["graph_id", "resseq"]).select("mutation_id", "place", "node")


N6_SQL = f"""WITH n AS ({nodes_sql()}), m AS (SELECT mutation_id, graph_id, CAST(a AS INTEGER) AS place, position + a AS resseq FROM ({MUTATIONS_SQL}), (VALUES (0), (1)) x(a))
SELECT mutation_id, place, node FROM m JOIN n ON m.graph_id = n.graph_id AND m.resseq = n.node"""


def n7_normalize_aa(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.substring("p_type", 1, 1).alias("one"), F.lower(F.substring("p_type", 1, 3)).alias("three"))
    return p.select("p_partkey", C.normalize_aa(F.lower("one")).alias("a"), C.normalize_aa(F.col("three")).alias("b"), C.aa3_to_aa1(C.normalize_aa(F.col("one"))).alias("c"), C.aa3_to_aa1(F.col("three")).alias("d"))


N7_SQL = f"""WITH s AS ({SCALES_SQL})
SELECT p_partkey, coalesce(s.aa3, upper(substr(p_type, 1, 1))) AS a, upper(substr(p_type, 1, 3)) AS b, coalesce(s.aa1, 'X') AS c, coalesce(z.aa1, 'X') AS d
FROM part LEFT JOIN s ON s.aa1 = upper(substr(p_type, 1, 1)) LEFT JOIN s z ON z.aa3 = upper(substr(p_type, 1, 3))"""


def n9_clean_features(spark, sf_dir):
    i = F.col("mutation_id")
    v = F.when(i % 7 == 0, float("nan")).when(i % 11 == 0, float("inf")).when(i % 13 == 0, F.lit(None)).otherwise(F.col("ddG"))
    return rounded(C.clean_features(mutations(spark, sf_dir).select("mutation_id", v.alias("v")), ["v"]), "v")


N9_SQL = f"""SELECT mutation_id, CASE WHEN mutation_id % 7 = 0 OR mutation_id % 11 = 0 OR mutation_id % 13 = 0 THEN 0.0::DOUBLE ELSE round(ddG, 6) END AS v FROM ({MUTATIONS_SQL})"""


def n10_scored_and_rejected(spark, sf_dir):
    i = F.col("mutation_id")
    m = mutations(spark, sf_dir).withColumn("ddG", F.when(i % 31 == 0, None).otherwise(F.col("ddG"))).withColumn("graph_id", F.when(i % 37 == 0, "none").otherwise(F.col("graph_id")))
    n = nodes(spark, sf_dir)
    good, bad = sampling.scored_and_rejected(m, n, contacts.locate_sites(m, n))
    return bad.groupBy("reason").agg(F.count("*").alias("n"), F.min("mutation_id").alias("first")).unionByName(good.select(F.lit("ok").alias("reason"), "mutation_id").groupBy("reason").agg(F.count("*").alias("n"), F.min("mutation_id").alias("first")))


N10_SQL = f"""WITH n AS ({nodes_sql()}), m AS (SELECT * REPLACE (CASE WHEN mutation_id % 31 = 0 THEN NULL ELSE ddG END AS ddG, CASE WHEN mutation_id % 37 = 0 THEN 'none' ELSE graph_id END AS graph_id) FROM ({MUTATIONS_SQL}))
SELECT CASE WHEN ddG IS NULL THEN 'bad_value' WHEN m.graph_id NOT IN (SELECT graph_id FROM n) THEN 'no_structure' WHEN n.node IS NULL THEN 'residue_not_found' ELSE 'ok' END AS reason,
  count(*) AS n, min(mutation_id) AS first FROM m LEFT JOIN n ON m.graph_id = n.graph_id AND m.position = n.node GROUP BY 1"""


def as_proteins(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("mutation_id"), F.col("l_suppkey").alias("pdb_id"), F.pmod("l_partkey", F.lit(50)).alias("position"), F.col("l_returnflag").alias("wild_type"), F.col("l_linestatus").alias("mutation"))


PROTEINS_SQL = "SELECT l_orderkey * 10 + l_linenumber AS mutation_id, l_suppkey AS pdb_id, l_partkey % 50 AS position, l_returnflag AS wild_type, l_linestatus AS mutation FROM lineitem"
SAMPLE_SQL = """, p AS (SELECT *, row_number() OVER (PARTITION BY pdb_id ORDER BY k, mutation_id) AS rn FROM (SELECT *, md5('42:' || mutation_id) AS k FROM d)
), q AS (SELECT * FROM p WHERE rn <= greatest(1, {n} // (SELECT count(DISTINCT pdb_id) FROM d)) ORDER BY rn, k, mutation_id LIMIT {n})"""


def u1_union_datasets(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("double").alias("v"), "c_mktsegment") if "c_mktsegment" in table(spark, sf_dir, "customer").columns else table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("double").alias("v"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").cast("double").alias("v"), F.lit(1).alias("extra"))
    return M.union_datasets({"customer": a, "none": None, "supplier": b}).select("dataset", "id", F.round("v", 6).alias("v"), "extra")


U1_SQL = "SELECT 'customer' AS dataset, c_custkey AS id, round(CAST(c_acctbal AS DOUBLE), 6) AS v, CAST(NULL AS INTEGER) AS extra FROM customer UNION ALL SELECT 'supplier', s_suppkey, round(CAST(s_acctbal AS DOUBLE), 6), 1 FROM supplier"


def u2_dedupe_mutations(spark, sf_dir):
    return sampling.dedupe_mutations(as_proteins(spark, sf_dir))


U2_SQL = f"SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY pdb_id, position, wild_type, mutation ORDER BY mutation_id) AS k FROM ({PROTEINS_SQL})) WHERE k = 1"


def u3_diverse_sample(spark, sf_dir):
    return sampling.diverse_sample(as_proteins(spark, sf_dir), 2648).select("mutation_id", "pdb_id")


U3_SQL = f"""WITH d AS (SELECT * FROM ({PROTEINS_SQL})){SAMPLE_SQL.format(n=2648)},
r AS (SELECT * FROM p WHERE mutation_id NOT IN (SELECT mutation_id FROM q) ORDER BY k, mutation_id LIMIT (SELECT 2648 - count(*) FROM q))
SELECT mutation_id, pdb_id FROM q UNION ALL SELECT mutation_id, pdb_id FROM r"""


def u4_stratified_sample(spark, sf_dir):
    return sampling.stratified_sample(as_proteins(spark, sf_dir), 300).select("mutation_id", "pdb_id")


U4_SQL = f"WITH d AS ({PROTEINS_SQL}){SAMPLE_SQL.format(n=300)} SELECT mutation_id, pdb_id FROM q"


def u5_keep_available(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("pdb_id"))
    return sampling.keep_available(as_proteins(spark, sf_dir), s).groupBy("pdb_id").agg(F.count("*").alias("n"))


U5_SQL = f"SELECT pdb_id, count(*) AS n FROM ({PROTEINS_SQL}) WHERE pdb_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY pdb_id"


def u6_distinct_structures(spark, sf_dir):
    return sampling.distinct_structures(as_proteins(spark, sf_dir), 40)


U6_SQL = f"SELECT pdb_id, min(mutation_id) AS first_id FROM ({PROTEINS_SQL}) GROUP BY pdb_id ORDER BY first_id, pdb_id LIMIT 40"

BOTH = {
    "n1_normalize_mutations": (n1_normalize_mutations, NORMAL_SQL),
    "a1_read_mutations_csv": (a1_read_mutations_csv, NORMAL_SQL),
    "a2_n2_read_mutations_parquet": (a2_read_mutations_parquet, A2_SQL),
    "n3_normalize_api_records": (n3_normalize_api_records, N3_SQL),
    "a3_read_mutations_json": (a3_read_mutations_json, N3_SQL),
    "a4_read_structures": (a4_read_structures, A4_SQL),
    "a5_write_results": (a5_write_results, A5_SQL),
    "g1_residue_nodes": (g1_residue_nodes, G1_SQL),
    "n4_limit_entries": (n4_limit_entries, f"SELECT mutation_id, graph_id, position FROM ({MUTATIONS_SQL}) ORDER BY mutation_id LIMIT 200"),
    "n5_parse_mutation_code": (n5_parse_mutation_code, N5_SQL),
    "n6_parse_site_list": (n6_parse_site_list, N6_SQL),
    "n7_n8_amino_acid_names": (n7_normalize_aa, N7_SQL),
    "n9_clean_features": (n9_clean_features, N9_SQL),
    "n10_scored_and_rejected": (n10_scored_and_rejected, N10_SQL),
    "u1_union_datasets": (u1_union_datasets, U1_SQL),
    "u2_dedupe_mutations": (u2_dedupe_mutations, U2_SQL),
    "u3_diverse_sample": (u3_diverse_sample, U3_SQL),
    "u4_stratified_sample": (u4_stratified_sample, U4_SQL),
    "u5_keep_available": (u5_keep_available, U5_SQL),
    "u6_distinct_structures": (u6_distinct_structures, U6_SQL),
}
