"""Queries without SQL over all rows."""

import pytest

from ohmgraph.operators.features import CROSS_SCALE
from ohmgraph.queries import registry

from .conftest import DATA


def test_both_scales_of_all_mutations(spark):
    folder = f"{DATA}/sf0.001"
    one = registry.QUERIES["f1_mutation_features"](spark, folder)
    both = registry.QUERIES["f4_f5_multi_scale"](spark, folder)
    rows = {r.mutation_id: r for r in both.collect()}
    wide = {r.mutation_id: r for r in one.collect()}
    assert len(CROSS_SCALE) == 10 and set(rows) == set(wide)
    for i, r in rows.items():
        for c in CROSS_SCALE:
            assert r[c] == pytest.approx(wide[i][c], nan_ok=True) and r[f"scale_diff_{c}"] == pytest.approx(r[c] - r[f"{c}_6A"], nan_ok=True) and f"scale_ratio_{c}" in both.columns
