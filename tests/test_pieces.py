"""Queries over graphs in pieces equal their SQL: a node far from all others, and a graph of one node."""

import shutil

import pytest
from pyspark.sql import functions as F

from ohmgraph.queries import registry

from . import conftest


@pytest.mark.parametrize("name", ["l9_mutant_pinv", "f1_feature_identities"])
def test_graphs_in_pieces(spark, tmp_path, monkeypatch, name):
    (tmp_path / "t").mkdir()
    e = spark.read.parquet(f"{conftest.DATA}/sf0.001/embeddings.parquet")
    first = F.when((F.col("label") == 3) & (F.pmod("vec_id", F.lit(3)) == 0), F.get("embedding", F.lit(0)) + F.col("vec_id").cast("float") * 9).otherwise(F.get("embedding", F.lit(0)))
    far = e.where("label <> 4").unionByName(e.where("label = 4").orderBy("vec_id").limit(1)).withColumn("embedding", F.concat(F.array(first.cast("float")), F.slice("embedding", 2, 63)))
    far.toPandas().to_parquet(tmp_path / "t" / "embeddings.parquet")
    shutil.copyfile(f"{conftest.DATA}/sf0.001/events.parquet", tmp_path / "t" / "events.parquet")
    monkeypatch.setattr(conftest, "DATA", str(tmp_path))
    left, right = conftest.against_sql(spark, registry.QUERIES[name], registry.ORACLES[name], "t")
    assert left and left == right
