"""Steps whose cost has to grow with the rows alone."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ohmgraph.operators import folds, models


def test_nested_folds_make_their_rows_once(spark):
    """Places in the shuffled order come from one pass over the rows, and are those of a plain sort."""
    made = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            made.add(len(f))
            yield f

    x = spark.range(500).select(F.col("id").alias("mutation_id"), (F.col("id") % 7).cast("double").alias("q"), F.col("id").cast("double").alias("ddG"))
    got = models.nested_linear(x.mapInPandas(counted, x.schema), ["q"], "ridge", [{"alpha": 0.1}, {"alpha": 1.0}], 5, 3, "ddG", "mutation_id").collect()
    assert made.value == 500
    order = [r.mutation_id for r in x.orderBy(F.md5(F.concat(F.lit("42:"), F.col("mutation_id").cast("string"))), "mutation_id").collect()]
    assert {r.mutation_id: r.fold for r in got} == {m: i % 5 for i, m in enumerate(order)}


def test_ranges_of_values_add_nothing_to_the_plan(spark):
    df = spark.range(400).select((F.col("id") * 3 % 257).cast("double").alias("v"))
    plans = [len(folds.counted_values(df, "v", [], size)._jdf.queryExecution().optimizedPlan().toString()) for size in (1_000, 2)]
    assert plans[1] < 1.2 * plans[0]


@pytest.mark.parametrize("ranks", [1_000_000, 0])
def test_spearman_over_many_ranges(spark, monkeypatch, ranks):
    """Groups, a null group among them, ties, missing values and a constant side; values in ranges of three."""
    rng = np.random.default_rng(5)
    f = pd.DataFrame({"g": rng.choice(["a", "b", "c", None], 900), "h": rng.integers(0, 2, 900), "y": rng.integers(0, 60, 900) / 8, "z": rng.integers(0, 400, 900) * 1.0})
    f.loc[f.g == "c", "z"] = 4.0
    rows = [(r.g if isinstance(r.g, str) else None, int(r.h), None if i % 50 == 0 else float(r.y), float("nan") if i % 70 == 0 else float(r.z)) for i, r in enumerate(f.itertuples())]
    df = spark.createDataFrame(rows, "g string, h int, y double, z double")
    full = folds.counted_before
    monkeypatch.setattr(folds, "counted_before", lambda v, by, size=3: full(v, by, 3))
    monkeypatch.setattr(models, "RANKS", ranks)
    low, high = -1e9, 1e9  # nulls are ranked first, NaN last
    want = {}
    for key in {(g, h) for g, h, *_ in rows}:
        y, z = (pd.Series([(low if r[i] is None else high if r[i] != r[i] else r[i]) for r in rows if r[:2] == key]).rank() for i in (2, 3))
        want[key] = 0.0 if y.nunique() < 2 or z.nunique() < 2 else float(np.corrcoef(y, z)[0, 1])
    for a, b in (("y", "z"), ("z", "y")):
        got = {(r.g, r.h): r.spearman_r for r in models.spearman(df, a, b, ["g", "h"]).collect()}
        assert got == pytest.approx(want, abs=1e-12)
    assert models.spearman(df.where("h > 5"), "y", "z").first().spearman_r == 0.0
