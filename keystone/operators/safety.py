"""A5: OSHA-style safety metrics over a date window."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystone.functions.exprs import dec_sum, rnd, safe_div

OSHA_BASE = 200000.0      # 100 workers × 50 weeks × 40 hours


def zero_incident_projects(star: dict[str, DataFrame], start, end) -> DataFrame:
    """Started ACTIVE/COMPLETED projects with no incident in the window."""
    affected = (star["fact_safety_incidents"]
                .where(F.col("date_id").between(F.lit(start), F.lit(end)))
                .select("project_id").distinct())      # a row for each project, however many incidents it has
    p = star["dim_projects"].where(F.col("status").isin("ACTIVE", "COMPLETED")
                                   & F.col("actual_start_date").isNotNull())
    return p.join(affected, p.id == affected.project_id, "left_anti")


def safety_metrics(star: dict[str, DataFrame], start: _dt.date, end: _dt.date) -> DataFrame:
    """A5: one row per (severity, incident type) seen in the window, with window
    totals, OSHA rates per 200 000 labour hours and the zero-incident project
    count repeated on every row. No incidents → no rows."""
    if end < start:
        raise ValueError("end date is before start date")
    hours = (star["fact_labor_hours"].where(F.col("date_id").between(F.lit(start), F.lit(end)))
             .agg(F.coalesce(dec_sum("hours_worked", 1), F.lit(0)).alias("h"))).scalar()
    inc = star["fact_safety_incidents"].where(F.col("date_id").between(F.lit(start), F.lit(end)))
    it = F.col("incident_type")
    sev = F.col("severity")

    ib = inc.groupBy("severity", "incident_type").agg(
        F.count(F.lit(1)).alias("incident_count"), F.sum("days_lost").cast("long").alias("days_lost"))

    # Window totals from the ≤ 9-row breakdown itself (no second fact scan).
    def n_if(c):
        return F.sum(F.when(c, F.col("incident_count")).otherwise(0)).cast("long")

    totals = ib.agg(F.struct(
        F.sum("incident_count").cast("long").alias("total_incidents"),
        F.sum("days_lost").cast("long").alias("total_days_lost"),
        n_if(it == "INJURY").alias("injuries"), n_if(it == "NEAR_MISS").alias("near_misses"),
        n_if(it == "VIOLATION").alias("violations"), n_if(sev == "SEVERE").alias("severe_count"),
        n_if(sev == "MODERATE").alias("moderate_count"), n_if(sev == "MINOR").alias("minor_count"),
    ).alias("t")).scalar()
    zero = zero_incident_projects(star, start, end).agg(F.count(F.lit(1))).scalar()

    # Attach each scalar once as a column: every later reference reads the
    # column, so each one-row aggregate runs exactly once.
    ib = ib.withColumn("_h", hours).withColumn("_t", totals).withColumn("_z", zero)
    keys = ["total_incidents", "total_days_lost", "injuries", "near_misses", "violations",
            "severe_count", "moderate_count", "minor_count"]
    t = {k: F.col("_t").getField(k) for k in keys}
    h = F.col("_h")
    order = F.when(sev == "SEVERE", 1).when(sev == "MODERATE", 2).otherwise(3)
    return ib.select(
        "severity", "incident_type", "incident_count", "days_lost",
        rnd(safe_div(F.col("incident_count") * OSHA_BASE, h), 4).alias("osha_rate_this_type"),
        *[v.alias(k) for k, v in t.items()],
        rnd(safe_div(t["total_incidents"] * OSHA_BASE, h), 4).alias("osha_total_incident_rate"),
        rnd(safe_div(t["injuries"] * OSHA_BASE, h), 4).alias("osha_injury_rate"),
        rnd(h, 0).alias("total_labor_hours"),
        F.col("_z").alias("zero_incident_projects"),
    ).orderBy(order, "incident_type")
