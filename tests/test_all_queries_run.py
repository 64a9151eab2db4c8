"""Queries without an oracle: what their rows must satisfy, on sf0.001 (the training-data queries have their own tests)."""

from __future__ import annotations

import pytest

import __spark_entry__ as E

from keystone_paths import SMALL

OWN_TESTS = {name for part in E._training_data() for name in part.queries()}
NO_ORACLE = sorted(set(E.queries()) - set(E.oracle_sql()) - OWN_TESTS)
RULES = {
    "importance": lambda v: 0 <= v <= 1,
    "overrun_probability": lambda v: 0 <= v <= 1,
    "maintenance_probability": lambda v: 0 <= v <= 1,
    "avg_probability": lambda v: v is None or 0 <= v <= 1,
    "predicted_days_until_maintenance": lambda v: 1 <= v <= 30,
    "est_days": lambda v: 1 <= v <= 30,
    "risk_level": lambda v: v in ("All", "High", "Medium", "Low"),
    "risk": lambda v: v in ("All", "Critical", "Watch", "Routine"),
    "recommendation": lambda v: "probability" in v or "risk" in v,
    "count": lambda v: v > 0,
    "accuracy": lambda v: 0 <= v <= 1,
    "roc_auc": lambda v: v is None or 0 <= v <= 1,
}
#: Sub-lists that a small table can leave empty.
MAY_BE_EMPTY = {"m18_high_risk_projects", "m18_critical_equipment"}


@pytest.mark.parametrize("name", NO_ORACLE)
def test_rows_are_plausible(spark, name):
    df = E.queries()[name](spark, SMALL)
    rows = df.collect()
    assert rows or name in MAY_BE_EMPTY
    known = [c for c in df.columns if c in RULES or c in ("metric", "train", "test")]
    assert known, df.columns
    for r in rows:
        assert all(RULES[c](r[c]) for c in known if c in RULES), r
    keys = [c for c in df.columns if c in ("project_id", "equipment_id", "feature", "metric")][:1]
    assert not keys or len({r[keys[0]] for r in rows}) == len(rows) or name == "m21_labelled_importance"
