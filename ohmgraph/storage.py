"""Tables that jobs write between their steps, in the folder that all executors share."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. A local folder takes its place only on a local master, where driver and tasks are one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='ohmgraph-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def saved_at(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """The table, written once as Parquet and read back, and where."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def saved(df: DataFrame, what: str = "step") -> DataFrame:
    """The table, written once and read back, so that later steps neither repeat it nor depend on executors."""
    return saved_at(df, what)[0]


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fingerprint(tables: dict[str, DataFrame], settings: dict) -> str:
    """A digest of settings and of tables: their columns, how many rows they have, and sums of the rows' hashes, so the order of rows does not matter."""
    told = [json.dumps(settings, sort_keys=True, default=str)]
    for name, df in sorted(tables.items()):
        cols = sorted(df.columns)
        half = lambda seed, cols=cols: F.sum(F.xxhash64(F.lit(seed), *[x for c in cols for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]).cast("decimal(38,0)"))
        told.append(f"{name} {sorted(df.dtypes)} {tuple(df.agg(F.count('*'), half(1), half(2)).first())}")
    return hashlib.sha256("\n".join(told).encode()).hexdigest()


def reuse(spark: SparkSession, path: str, build, key: str = "") -> DataFrame:
    """The table at path if it was finished there under the same key (such as a fingerprint); else build() is saved there."""
    manifest = f"{path.rstrip('/')}.manifest"
    at = spark._jvm.org.apache.hadoop.fs.Path(manifest)
    exists = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    if not exists or [r.value for r in spark.read.text(manifest).collect()] != [f"key {key}"]:
        if exists:
            delete(spark, manifest)  # first, so that a broken run leaves no manifest for another table
        build().write.mode("overwrite").parquet(path)
        spark.createDataFrame([(f"key {key}",)], "value string").coalesce(1).write.text(manifest)
    return spark.read.parquet(path)
