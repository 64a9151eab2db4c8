"""A1: project performance — cost vs budget by category, CPI, SPI, schedule variance."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystone.functions.exprs import days_between, dbl, dec_sum, label_case, rnd, safe_div

AS_OF = _dt.date(2026, 2, 17)


def cpi_status(cpi) -> F.Column:
    """Category budget status from the 3-dp CPI (NULL CPI → last branch)."""
    return label_case(None, [(cpi >= 1.00, "Under Budget"), (cpi >= 0.90, "Slightly Over"),
                             (cpi >= 0.75, "Over Budget")], "Significantly Over")


def project_schedule(projects: DataFrame, as_of: _dt.date = AS_OF) -> DataFrame:
    """Planned duration, elapsed days (open projects run to ``as_of``), variance, SPI."""
    planned = days_between("planned_end_date", "planned_start_date")
    elapsed = days_between(F.coalesce(F.col("actual_end_date"), F.lit(as_of)), "actual_start_date")
    return projects.select(
        "*",
        planned.cast("long").alias("planned_duration_days"),
        elapsed.cast("long").alias("elapsed_days"),
        (elapsed - planned).cast("long").alias("schedule_variance_days"),
        rnd(safe_div(planned, elapsed), 3).alias("spi"))


def project_performance(star: dict[str, DataFrame], project_id: int | None = None,
                        as_of: _dt.date = AS_OF) -> DataFrame:
    """A1 for one project (``project_id``) or, when None, for every project.

    One aggregate by (project, category); project totals come from a window
    over each project's ≤ 5 category rows. Projects without costs give no rows.
    """
    p = star["dim_projects"]
    c = star["fact_project_costs"]
    if project_id is not None:
        p = p.where(F.col("id") == F.lit(project_id))
        c = c.where(F.col("project_id") == F.lit(project_id))
    cat = c.groupBy("project_id", "cost_category").agg(
        dec_sum("amount", 4).alias("a"), dec_sum("budgeted_amount", 4).alias("b"))
    w = Window.partitionBy("project_id")
    cat = cat.select("*", F.sum("a").over(w).alias("ta"), F.sum("b").over(w).alias("tb"))

    cat = cat.select(
        "project_id", "cost_category",
        rnd("ta", 2).alias("total_actual"),
        rnd("tb", 2).alias("total_budgeted"),
        rnd(safe_div("tb", "ta"), 3).alias("overall_cpi"),
        rnd("a", 2).alias("actual_cost"),
        rnd("b", 2).alias("budgeted_cost"),
        rnd(F.col("b") - F.col("a"), 2).alias("variance"),
        rnd(safe_div(dbl(F.col("b") - F.col("a")) * 100.0, "b"), 2).alias("variance_pct"),
        rnd(safe_div("b", "a"), 3).alias("category_cpi"))
    cat = cat.select(
        "*",
        rnd(F.col("total_budgeted") - F.col("total_actual"), 2).alias("total_variance"),
        cpi_status(F.col("category_cpi")).alias("budget_status"),
        rnd(safe_div(F.col("actual_cost") * 100.0, "total_actual"), 2).alias("pct_of_total_spend"))

    meta = project_schedule(p, as_of)
    out = meta.join(cat, meta.id == cat.project_id)
    return out.select(
        "project_id", "project_name", "project_type", "status", "contract_value",
        "planned_start_date", "planned_end_date", "actual_start_date", "actual_end_date",
        "planned_duration_days", "elapsed_days", "schedule_variance_days", "spi",
        "total_actual", "total_budgeted", "total_variance", "overall_cpi",
        "cost_category", "actual_cost", "budgeted_cost", "variance", "variance_pct",
        "category_cpi", "budget_status", "pct_of_total_spend",
    ).orderBy("project_id", F.col("actual_cost").desc())
