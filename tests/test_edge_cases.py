"""Edge rows: empty window, NULL budgets, retired fleet, inverted ranges."""

from __future__ import annotations

import datetime as _dt

import pytest

from keystone.operators.equipment import equipment_utilization
from keystone.operators.safety import safety_metrics
from keystone.sources.star import load_star

from keystone_paths import SMALL


@pytest.fixture(scope="module")
def star(spark):
    return load_star(spark, SMALL)


def test_safety_empty_window_gives_no_rows(star):
    assert safety_metrics(star, _dt.date(1980, 1, 1), _dt.date(1980, 12, 31)).count() == 0


def test_inverted_window_raises(star):
    with pytest.raises(ValueError):
        equipment_utilization(star, _dt.date(1998, 1, 9), _dt.date(1998, 1, 5))
    with pytest.raises(ValueError):
        safety_metrics(star, _dt.date(1998, 1, 9), _dt.date(1998, 1, 5))


def test_utilization_outside_calendar_is_idle_or_low(star):
    rows = equipment_utilization(star, _dt.date(1980, 1, 1), _dt.date(1980, 1, 31)).collect()
    assert rows and all(r.available_hours == 0 and r.utilization_pct is None for r in rows)
    assert {r.utilization_tier for r in rows} <= {"Idle", "Low (<50%)"}
    assert all(r.status != "RETIRED" for r in rows)


def test_null_budget_overruns_do_not_add_up(star):
    from keystone.operators.budget import budget_variance
    r = budget_variance(star).collect()
    assert any(x.labor_overrun + x.materials_overrun + x.equipment_overrun
               + x.subcontractor_overrun != x.cost_variance for x in r)


def test_planted_violations_are_counted(star):
    from pyspark.sql import functions as F

    from keystone.operators.quality import enum_violations, not_null_violations
    p = star["dim_projects"]
    first = p.agg(F.min("id")).first()[0]
    planted = dict(star)
    for t in ("dim_subcontractors", "dim_equipment", "dim_employees", "dim_materials", "fact_project_costs", "fact_labor_hours",
              "fact_equipment_usage", "fact_material_deliveries", "fact_safety_incidents", "fact_inspections", "dim_dates"):
        try:
            planted[t] = star[t]
        except KeyError:
            pass
    bad = F.when(F.col("id") == first, F.lit("SHED"))
    planted["dim_projects"] = p.withColumn("project_type", F.coalesce(bad, "project_type")) \
        .withColumn("project_name", F.when(F.col("id") != first, F.col("project_name")))
    rows = {tuple(r) for r in enum_violations(planted).collect()}
    assert rows == {("dim_projects", "project_type", "SHED", 1)}
    nulls = {(r.table_name, r.column_name): r.nulls for r in not_null_violations(planted).collect()}
    assert nulls["dim_projects", "project_name"] == 1 and sum(nulls.values()) == 1
