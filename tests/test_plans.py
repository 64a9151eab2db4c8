"""Plan guards: filters reach the Parquet scan, columns are pruned, no cross joins."""

from __future__ import annotations

import datetime as _dt
import re

import pytest

from keystone.operators.equipment import usage_in_window
from keystone.operators.safety import safety_metrics
from keystone.sources.star import Star
from keystone.sources.warehouse import load_warehouse, save_star

from keystone_paths import SMALL


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("stored-star"))
    save_star(Star(spark, SMALL), root)
    return load_warehouse(spark, root)


def _plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def _scan(plan: str, column: str) -> str:
    lines = [ln for ln in plan.splitlines() if "FileScan" in ln and f"{column}#" in ln]
    assert lines, f"no scan reading {column}"
    return lines[0]


def test_date_window_is_pushed_to_the_scan(stored):
    plan = _plan(usage_in_window(stored["fact_equipment_usage"], _dt.date(1998, 1, 5), _dt.date(1998, 1, 9)))
    scan = _scan(plan, "hours_used")
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(date_id", scan), scan
    assert re.search(r"PushedFilters: \[[^\]]*LessThanOrEqual\(date_id", scan), scan
    cols = re.search(r"FileScan parquet \[([^\]]*)\]", scan).group(1)
    assert "operator_id" not in cols                       # column pruning


def test_safety_window_pushed(stored):
    plan = _plan(safety_metrics(stored, _dt.date(1997, 1, 1), _dt.date(1999, 12, 31)))
    assert "GreaterThanOrEqual(date_id" in _scan(plan, "severity")


@pytest.mark.parametrize("name", ["a1_project_performance", "a2_equipment_utilization",
                                  "a3_subcontractor_scorecard", "a5_safety_metrics",
                                  "a6_budget_variance", "m3_maintenance_snapshots",
                                  "q2_foreign_key_orphans"])
def test_no_cross_joins(spark, name):
    import __spark_entry__ as E
    plan = _plan(E.queries()[name](spark, SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_facts_are_reduced_before_semi_and_anti_joins(stored):
    """What meets a dimension on the right of such a join is one row for each project."""
    from keystone.operators.safety import zero_incident_projects
    plan = _plan(zero_incident_projects(stored, _dt.date(1997, 1, 1), _dt.date(1999, 12, 31)))
    assert "LeftAnti" in plan and "HashAggregate(keys=[project_id" in plan
