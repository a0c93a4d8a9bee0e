"""The registered queries over these operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fill_middle, license_scan, line_dedup, mixing, multi_index, packing, personal_data, quality_classifier, quality_rules, similarity, toxicity, url_filter, vector_codes
from .common import id_fold, table

URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
UP = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
BLANKS_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("_row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (SELECT *, translate(trim(line, {BLANKS_SQL}), {UP}) AS key FROM lines
), common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (SELECT k.*, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.ledger(table(spark, sf_dir, "documents"))
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed", "base_failed", "kept"]
    return quality_rules.judged(led, "v1").select("doc_id", *cols)


OP10_LEDGER = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), grams AS (
  SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM docs)
), again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n >= 2
), covered AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM again, range(3) AS x(d) GROUP BY doc_id
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, len(l) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM docs LEFT JOIN covered USING (doc_id)
), f AS (
  SELECT *, CAST(1 * CAST(n_words < 50 AS INT) + 2 * CAST(100 * n_repeat_words > 50 * n_words AS INT) + 4 * CAST(100 * n_symbols > 30 * n_words AS INT)
    + 8 * CAST(100 * n_dup_lines > 60 * n_lines AS INT) + 16 * CAST(word_chars > 25 * n_words AS INT) + 32 * CAST(word_chars < 2 * n_words AS INT)
    + 64 * CAST(100 * n_upper > 60 * word_chars AS INT) AS BIGINT) AS failed
  FROM m
)
"""
OP10_SQL = OP10_LEDGER + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed, failed & 3 > 0 AS base_failed, failed & 119 = 0 AS kept FROM f
"""


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the widest policy rejects, and rejects alone."""
    return quality_rules.ablation(quality_rules.ledger(table(spark, sf_dir, "documents")), "v2")


ABLATION_SQL = OP10_LEDGER + """
, r AS (SELECT * FROM (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('duplicate_lines', 8), ('long_words', 16), ('short_words', 32), ('shouting', 64)) x(rule, bit))
SELECT rule, CAST(count(*) FILTER (WHERE failed & bit > 0) AS BIGINT) AS n_failed, CAST(count(*) FILTER (WHERE failed = bit) AS BIGINT) AS n_only FROM r, f GROUP BY rule
"""


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("places")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.components_of(table(spark, sf_dir, "documents"), n=4, similarity=(80, 100))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, limit=2.0)
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "first_slot")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source
), w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s
), o AS (
  SELECT *, 2.0::DOUBLE * n AS cap, row_number() OVER (ORDER BY 2.0::DOUBLE * n / w, source NULLS LAST) AS k FROM w
), v AS (
  SELECT *, (1.5::DOUBLE * sum(n) OVER () - (sum(cap) OVER (ORDER BY k) - cap)) / (sum(w) OVER () - (sum(w) OVER (ORDER BY k) - w)) AS level FROM o
), f AS (SELECT min(level) FILTER (WHERE cap / w >= level) AS level FROM v WHERE k = (SELECT min(k) FROM v WHERE cap / w >= level)
), t AS (SELECT source, n, least(cap, w * coalesce((SELECT level FROM f), cap)) AS target FROM o
), p AS (
  SELECT d.*, n, target, CAST(floor(target + 0.5) AS BIGINT) AS wanted,
         CAST(sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT source, target, sum(target / total) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING) AS hi, total,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth, count(*) OVER () AS sources, CAST(ceil(total / 256) AS BIGINT) AS slots
  FROM (SELECT *, sum(target) OVER () AS total FROM t) WHERE target > 0
), i AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY nth), 0) AS lo, nth = sources - 1 AS ends FROM e
), g AS (
  SELECT slot, source FROM (SELECT unnest(range((SELECT max(slots) FROM i))) AS slot) JOIN i
    ON (CAST(slot AS DOUBLE) * 0.6180339887498949::DOUBLE) % 1.0::DOUBLE >= lo AND (ends OR (CAST(slot AS DOUBLE) * 0.6180339887498949::DOUBLE) % 1.0::DOUBLE < hi)
  UNION ALL SELECT slots + x.k * sources + nth, source FROM i, range(32) AS x(k)
), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM g
), m AS (
  SELECT *, greatest(0, least(size, wanted - start)) + greatest(0, least(size, wanted - n - start)) AS taken FROM p
)
SELECT doc_id, size, n AS source_size, round(target, 6) AS target, taken, CASE WHEN taken > 0 THEN slot END AS first_slot
FROM m LEFT JOIN r ON m.source IS NOT DISTINCT FROM r.source AND start // 256 = rank
"""


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (toxicity.fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = personal_data.find(docs, personal_data.fitted(docs))
    counts = [f"n_{k}" for k in personal_data.KINDS]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


OP9_SQL = f"""
WITH r AS (
  SELECT rule, verdict, split_part(rule, '/', 1) AS rh, substr(rule, instr(rule, '/')) AS rp
  FROM (VALUES {", ".join(f"('{r}', '{v}')" for r, v in URL_RULES)}) x(rule, verdict)
), u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {UP}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), j AS (
  SELECT p.*, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST, rule) AS k
  FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM j WHERE k = 1
"""


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    out = vector_codes.with_label_error(codes).withColumn("codebooks_sha256", F.lit(vector_codes.digest(books)))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op11_sql(rounds: int = 4) -> str:
    """Plain Lloyd iterations, a step for each; squared distances and indexes share a number, whose least is the nearest entry."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT row, x.p, min(CAST(x.xx - 2 * list_dot_product(x.x, b.c) + list_dot_product(b.c, b.c) AS BIGINT) * 256 + e) AS m
  FROM x JOIN b{r} b ON x.p = b.p GROUP BY row, x.p
)""")
        if r < rounds:
            steps.append(f"""
b{r + 1} AS MATERIALIZED (
  WITH s AS (SELECT p, e, i, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM (
         SELECT a.p, m % 256 AS e, unnest(range(1, w + 1)) AS i, unnest(x.x) AS v FROM a{r} a JOIN x ON a.row = x.row AND a.p = x.p) GROUP BY p, e, i),
  n AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS c FROM s GROUP BY p, e)
  SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM b{r} b LEFT JOIN n ON b.p = n.p AND b.e = n.e
)""")
    return f"""
WITH k AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS row, len(embedding) // 4 AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (
  SELECT *, list_dot_product(x, x) AS xx FROM (
    SELECT row, w, p, list_transform(embedding[p * w + 1:(p + 1) * w], lambda v: floor(1024 * CAST(v AS DOUBLE))) AS x FROM k, range(4) AS r(p))
), b0 AS MATERIALIZED (SELECT p, row AS e, x AS c FROM x WHERE row < 256
), {", ".join(steps)}
, o AS (SELECT row, string_agg(format('{{:02x}}', m % 256), '' ORDER BY p) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM a{rounds} GROUP BY row
), h AS (
  SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS s
  FROM (SELECT p, e, unnest(range(len(c))) AS i, unnest(c) AS v FROM b{rounds})
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM k JOIN o USING (row), h
"""


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), learn=id_fold(F.col("_id"), 3) != 1)
    scored = quality_classifier.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (id_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    again = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select("_row.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


OP13_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s
  FROM documents
), h AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(s, 1, 8) AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || substr(s, 9, 8) AS BIGINT) % (len(u) + 1) AS y,
         CAST('0x' || substr(s, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(s, 25, 8) AS BIGINT) % 100 AS h4
  FROM d
), p AS (
  SELECT doc_id, n, t, array_to_string(u[1:least(x, y)], '') AS prefix, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS middle,
         array_to_string(u[greatest(x, y) + 1:], '') AS suffix,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_multi_index": op1_multi_index,
    "op2_license_scan": op2_license_scan,
    "op3_near_dedup": op3_near_dedup,
    "op4_mixing": op4_mixing,
    "op5_line_dedup": op5_line_dedup,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_personal_data": op8_personal_data,
    "op9_url_filter": op9_url_filter,
    "op10_quality_rules": op10_quality_rules,
    "op11_vector_codes": op11_vector_codes,
    "op12_quality_classifier": op12_quality_classifier,
    "op13_fill_middle": op13_fill_middle,
    "quality_ablation": quality_ablation,
}
ORACLES: dict[str, str] = {"op4_mixing": OP4_SQL, "op5_line_dedup": OP5_SQL, "op9_url_filter": OP9_SQL, "op10_quality_rules": OP10_SQL, "op11_vector_codes": op11_sql(), "op13_fill_middle": OP13_SQL, "quality_ablation": ABLATION_SQL}
