"""Structure files as atom rows, and the sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def read_structures(spark: SparkSession, path: str, id_pattern: str = r"([^/.]+)[^/]*$") -> DataFrame:
    """A row for each ATOM and HETATM line: pdb_id, line_no, record, model and the fixed-width fields. id_pattern: what of a file's path is its id, by default its name without extensions."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    kind = F.trim(F.substring("line", 1, 6))
    sorted_ = W.partitionBy("file").orderBy("line_no")
    marked = lines.where(kind.isin("ATOM", "HETATM", "MODEL")).withColumn("record", kind)
    modelled = marked.withColumn("model", F.greatest(F.lit(1), F.sum(F.when(F.col("record") == "MODEL", 1).otherwise(0)).over(sorted_)).cast("int"))
    text = lambda at, n: F.trim(F.substring("line", at, n))
    return modelled.where("record <> 'MODEL'").select(
        F.upper(F.regexp_extract("file", id_pattern, 1)).alias("pdb_id"),
        F.col("line_no").cast("long").alias("line_no"),
        "record",
        "model",
        text(22, 1).alias("chain"),
        text(23, 4).try_cast("int").alias("resseq"),
        text(27, 1).alias("icode"),
        text(18, 3).alias("resname"),
        text(13, 4).alias("atom"),
        text(17, 1).alias("altloc"),
        text(55, 6).try_cast("double").alias("occupancy"),
        *[text(at, 8).try_cast("double").alias(c) for c, at in (("x", 31), ("y", 39), ("z", 47))],
    )


def write_results(df: DataFrame, path: str, fmt: str = "parquet", by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Writes a table; CSV has no nested columns, so those are left out there."""
    if fmt == "csv":
        df = df.drop(*[f.name for f in df.schema if isinstance(f.dataType, MapType | ArrayType | StructType)])
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*by) if by else writer).save(path)


def write_features(features: DataFrame, path: str, fmt: str = "parquet") -> None:
    write_results(features, path, fmt, ["dataset"] if "dataset" in features.columns else None)
