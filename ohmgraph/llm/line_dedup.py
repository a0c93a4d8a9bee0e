"""Line dedup: lines that many documents share are dropped everywhere.

Explodes normalised lines, hashes them, counts the documents of each hash, marks lines over the threshold and
reassembles the rest by position. DataFrame functions only. Lines travel as two 64-bit hashes and a position, never as
text; only the marked positions, a short list a document, meet the texts again.

Defined results: a null text is an empty one and has one empty line. Each row is a document of its own, also where
doc_id is null or repeated. A line that recurs in one document counts once for it. Empty keys are never dropped. Extra
columns may have any name and are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, row_key


#: Parts into which the join deals a line's places: one line may stand in a third of all documents.
SALTS = 32


def line_key(line: Column) -> Column:
    """A line without white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("_h1"), F.xxhash64(F.lit(1), key).alias("_h2")]


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: _row (the document as it came), n_lines, n_dropped, kept (its other lines, joined by \\n)."""
    lines = docs.select(
        *row_key(F.col(id_col), F.col(text_col)),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("_row"),
        F.col(text_col).alias("_text"),
    ).withColumn("_lines", F.split(F.coalesce("_text", F.lit("")), "\n", -1))
    keys = lines.select("_k1", "_k2", F.transform("_lines", line_key).alias("_keys"))
    counted = (
        keys.select(F.explode_outer(F.array_distinct("_keys")).alias("_key"))
        .where(F.char_length("_key") >= min_chars)
        .select(*_hashes(F.col("_key")))
        .groupBy("_h1", "_h2")
        .count()
        .where(F.col("count") >= min_docs)
        .select("_h1", "_h2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    )
    marked = (
        keys.select("_k1", "_k2", F.posexplode_outer("_keys").alias("_pos", "_key"))
        .where(F.char_length("_key") >= min_chars)
        .select("_k1", "_k2", "_pos", F.pmod("_k1", F.lit(SALTS)).cast("int").alias("_salt"), *_hashes(F.col("_key")))
        .join(counted, ["_h1", "_h2", "_salt"])
        .groupBy("_k1", "_k2")
        .agg(F.collect_set("_pos").alias("_drop"))
    )
    none = F.array().cast("array<int>")
    return (
        lines.drop("_text")
        .join(marked, ["_k1", "_k2"], "left")
        .select("_row", "_lines", F.coalesce("_drop", none).alias("_drop"))
        .select(
            "_row",
            F.size("_lines").cast("long").alias("n_lines"),
            F.size("_drop").cast("long").alias("n_dropped"),
            F.array_join(
                F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop")), lambda p: F.col("_lines")[p]), "\n"
            ).alias("kept"),
        )
    )


def without_common_lines(docs: DataFrame, **how) -> DataFrame:
    """The documents, with the columns they came with, their texts without the dropped lines."""
    out = dedup_lines(docs, **how)
    new = {how.get("text_col", "text"): F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return out.select(*[(new[c] if c in new else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
