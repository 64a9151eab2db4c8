"""A2: equipment utilisation over a date window."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystone.functions.exprs import dec_sum, flag, label_case, rnd, safe_div
from keystone.operators.ranking import Ordering, with_orderings


def working_days(dates: DataFrame, start, end) -> DataFrame:
    """One-row frame: non-weekend, non-holiday days of the calendar in [start, end]."""
    return (dates.where(F.col("date").between(F.lit(start), F.lit(end))
                        & ~F.col("is_weekend") & ~F.col("is_holiday"))
            .agg(F.count(F.lit(1)).alias("working_days")))


def usage_in_window(usage: DataFrame, start, end) -> DataFrame:
    """Per machine: hours, fuel, maintenance (NULL costs as 0) and projects served."""
    return (usage.where(F.col("date_id").between(F.lit(start), F.lit(end)))
            .groupBy("equipment_id").agg(
                dec_sum("hours_used", 4).cast("double").alias("u_hours"),
                dec_sum(F.coalesce("fuel_cost", F.lit(0)), 4).cast("double").alias("u_fuel"),
                dec_sum(F.coalesce("maintenance_cost", F.lit(0)), 4).cast("double").alias("u_maint"),
                F.countDistinct("project_id").alias("u_projects")))


def equipment_utilization(star: dict[str, DataFrame], start: _dt.date,
                          end: _dt.date, ranks: bool = True) -> DataFrame:
    """A2: every non-retired machine (machines without usage stay, as Idle).

    available = working days × 8 h; utilisation tier and ranks use the
    unrounded utilisation; the fleet percentile is 100·rank/count (ascending).
    Without ``ranks``, neither rank, percentile nor the order.
    """
    if end < start:
        raise ValueError("end date is before start date")
    wd = working_days(star["dim_dates"], start, end).scalar()
    u = usage_in_window(star["fact_equipment_usage"], start, end)
    e = star["dim_equipment"].where(F.col("status") != "RETIRED")
    base = e.join(u, e.id == u.equipment_id, "left").select(
        F.col("id").alias("equipment_id"), "equipment_name", "equipment_type", "hourly_rate",
        "status", "purchase_cost", "purchase_date",
        F.coalesce("u_hours", F.lit(0.0)).alias("h"),
        F.coalesce("u_fuel", F.lit(0.0)).alias("fuel"),
        F.coalesce("u_maint", F.lit(0.0)).alias("maint"),
        F.coalesce("u_projects", F.lit(0)).cast("long").alias("projects_served"))
    # All machines have the same available hours, so the order of hours is that of utilisation.
    out = base if not ranks else with_orderings(
        base, Ordering("h", parts=["equipment_type"], descending=True, rank="rank_in_type"), Ordering("h", rank="_fleet_rank"))
    out = out.withColumn("available_hours", (wd * 8).cast("long"))         # attached once
    out = out.select(
        "*",
        (F.col("h") * F.col("hourly_rate")).alias("revenue"),
        safe_div(F.col("h") * 100.0, "available_hours").alias("util"))
    percentile = []
    if ranks:
        # COUNT(*) OVER (): one row per non-retired machine (left join keeps them all).
        out = out.withColumn("_n_fleet", e.agg(F.count(F.lit(1))).scalar())
        ranked = lambda c: F.when(F.col("available_hours") > 0, F.col(c)).otherwise(F.lit(1)).cast("long")  # noqa: E731  no hours: all tie
        percentile = [ranked("rank_in_type").alias("rank_in_type"),
                      rnd(ranked("_fleet_rank") * 100.0 / F.col("_n_fleet"), 1).alias("fleet_utilization_percentile")]
    util = F.col("util")
    tier = label_case(None, [(util >= 75, "High (≥75%)"), (util >= 50, "Moderate (50–75%)"),
                             (F.col("h") > 0, "Low (<50%)")], "Idle")
    out = out.select(
        "equipment_id", "equipment_name", "equipment_type", "status",
        rnd("hourly_rate", 2).alias("hourly_rate"), "purchase_cost", "purchase_date",
        rnd("h", 1).alias("hours_used"), "available_hours",
        rnd(util, 2).alias("utilization_pct"),
        tier.alias("utilization_tier"),
        rnd("revenue", 2).alias("revenue_generated"),
        rnd("fuel", 2).alias("fuel_cost"),
        rnd("maint", 2).alias("maintenance_cost"),
        rnd(F.col("revenue") - F.col("fuel") - F.col("maint"), 2).alias("net_revenue"),
        "projects_served", *percentile,
        flag(util < 50).cast("long").alias("is_underutilized"),
    )
    return out.orderBy(F.col("utilization_pct").desc_nulls_last(), "equipment_id") if ranks else out
