"""Reports promised by the modelled system's documentation.

Inspection pass rates, delivery on-time rates, monthly cost curves, incident
trend with a rolling 12-month rate, equipment ROI and fuel trend. Money is
summed as DECIMAL; running and rolling windows are partitioned by project or
run over month rows (bounded by the calendar, not by the data volume).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystone.functions.exprs import dec_sum, month_key, rnd, safe_div

OSHA_BASE = 200000.0


def inspection_rates(star: dict[str, DataFrame], by: str = "project_id") -> DataFrame:
    """Inspections, passes, conditionals, fails and pass rate per ``by``
    (``project_id`` or ``inspector_name``)."""
    r = F.col("result")
    out = star["fact_inspections"].groupBy(by).agg(
        F.count(F.lit(1)).alias("inspections"),
        F.count(F.when(r == "PASS", 1)).alias("passed"),
        F.count(F.when(r == "CONDITIONAL", 1)).alias("conditional"),
        F.count(F.when(r == "FAIL", 1)).alias("failed"))
    return out.withColumn("pass_rate_pct", rnd(safe_div(F.col("passed") * 100.0, "inspections"), 2)) \
        .orderBy(by)


def delivery_performance(star: dict[str, DataFrame], by: str = "supplier") -> DataFrame:
    """R2: deliveries, on-time / delayed counts, on-time %, quantity and cost per
    ``by`` (``supplier`` via the material dimension, or ``project_id``)."""
    d = star["fact_material_deliveries"]
    s = F.col("delivery_status")
    out = d.groupBy("material_id" if by == "supplier" else by).agg(
        F.count(F.lit(1)).alias("deliveries"),
        F.count(F.when(s == "ON_TIME", 1)).alias("on_time"),
        F.count(F.when(s == "DELAYED", 1)).alias("delayed"),
        dec_sum("quantity", 4).alias("quantity"),
        dec_sum("total_cost", 4).alias("total_cost"))
    if by == "supplier":            # the fact is at material grain before it meets its dimension
        m = star["dim_materials"].select(F.col("id").alias("material_id"), "supplier")
        out = out.join(m, "material_id").groupBy(by).agg(
            *[F.sum(c).alias(c) for c in ("deliveries", "on_time", "delayed", "quantity", "total_cost")])
    out = out.withColumns({c: F.col(c).cast("double") for c in ("quantity", "total_cost")})
    return out.withColumn("on_time_pct", rnd(safe_div(F.col("on_time") * 100.0, "deliveries"), 2)) \
        .orderBy(by)


def monthly_cost_curve(star: dict[str, DataFrame]) -> DataFrame:
    """Per project and month, actual and budget with cumulative sums (NULL
    budgets skipped) and the cumulative CPI."""
    m = star["fact_project_costs"].groupBy("project_id", month_key("date_id").alias("month")).agg(
        dec_sum("amount", 4).alias("a"), F.coalesce(dec_sum("budgeted_amount", 4), F.lit(0)).alias("b"))
    w = Window.partitionBy("project_id").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    ca, cb = F.sum("a").over(w), F.sum("b").over(w)
    return m.select("project_id", "month",
                    F.col("a").cast("double").alias("actual_cost"),
                    F.col("b").cast("double").alias("budgeted_cost"),
                    ca.cast("double").alias("cumulative_actual"),
                    cb.cast("double").alias("cumulative_budgeted"),
                    rnd(safe_div(cb, ca), 3).alias("cumulative_cpi")) \
        .orderBy("project_id", "month")


def _month_index(d) -> Column:
    return F.year(d) * 12 + F.month(d) - 1


def incident_trend(star: dict[str, DataFrame]) -> DataFrame:
    """Per month: incidents, near misses, injuries, labour hours, the OSHA
    rate and the rolling 12-calendar-month incidents and rate."""
    inc = star["fact_safety_incidents"].groupBy(_month_index("date_id").alias("mi")).agg(
        F.count(F.lit(1)).alias("incidents"),
        F.count(F.when(F.col("incident_type") == "NEAR_MISS", 1)).alias("near_misses"),
        F.count(F.when(F.col("incident_type") == "INJURY", 1)).alias("injuries"))
    hrs = star["fact_labor_hours"].groupBy(_month_index("date_id").alias("mi")).agg(
        dec_sum("hours_worked", 1).alias("h"))
    m = inc.join(hrs, "mi", "full").select(
        "mi", *[F.coalesce(c, F.lit(0)).cast("long").alias(c)
                for c in ("incidents", "near_misses", "injuries")],
        F.coalesce("h", F.lit(0)).alias("h"))
    # Month rows only (≤ 12 per year): a frame over calendar months is bounded.
    w = Window.orderBy("mi").rangeBetween(-11, 0)
    rh = F.sum("h").over(w)
    ri = F.sum("incidents").over(w)
    return m.select(
        F.format_string("%04d-%02d", (F.col("mi") / 12).cast("int"), F.col("mi") % 12 + 1)
        .alias("month"),
        "incidents", "near_misses", "injuries", F.col("h").cast("double").alias("labor_hours"),
        rnd(safe_div(F.col("incidents") * OSHA_BASE, "h"), 4).alias("incident_rate"),
        ri.cast("long").alias("rolling_12m_incidents"),
        rnd(safe_div(ri * OSHA_BASE, rh), 4).alias("rolling_12m_rate")).orderBy("month")


def equipment_roi_by_type(star: dict[str, DataFrame]) -> DataFrame:
    """Per equipment type: machines, hours, revenue, running costs, net and
    ROI % of the purchase cost (all usage, all non-retired machines)."""
    u = star["fact_equipment_usage"].groupBy("equipment_id").agg(
        dec_sum("hours_used", 4).alias("h"), dec_sum(F.coalesce("fuel_cost", F.lit(0)), 4).alias("f"),
        dec_sum(F.coalesce("maintenance_cost", F.lit(0)), 4).alias("m"))
    e = star["dim_equipment"].where(F.col("status") != "RETIRED")
    j = e.join(u, e.id == u.equipment_id, "left")
    h = F.coalesce("h", F.lit(0)).cast("decimal(18,4)")
    rate = F.col("hourly_rate").cast("decimal(18,4)")
    g = j.groupBy("equipment_type").agg(
        F.count(F.lit(1)).alias("machines"), F.sum(h).cast("double").alias("hours"),
        F.sum((h * rate).cast("decimal(28,8)")).cast("double").alias("revenue"),
        F.sum(F.coalesce("f", F.lit(0))).cast("double").alias("fuel_cost"),
        F.sum(F.coalesce("m", F.lit(0))).cast("double").alias("maintenance_cost"),
        F.sum(F.col("purchase_cost").cast("decimal(20,2)")).cast("double").alias("purchase_cost"))
    net = F.col("revenue") - F.col("fuel_cost") - F.col("maintenance_cost")
    return g.select("equipment_type", "machines", "hours", "revenue", "fuel_cost",
                    "maintenance_cost", net.alias("net_revenue"), "purchase_cost",
                    rnd(safe_div(net * 100.0, "purchase_cost"), 2).alias("roi_pct")) \
        .orderBy("equipment_type")


def fuel_trend_by_month(star: dict[str, DataFrame]) -> DataFrame:
    """Fleet fuel cost, hours and fuel per hour by month."""
    u = star["fact_equipment_usage"]
    g = u.groupBy(month_key("date_id").alias("month")).agg(
        dec_sum(F.coalesce("fuel_cost", F.lit(0)), 4).cast("double").alias("fuel_cost"),
        dec_sum("hours_used", 4).cast("double").alias("hours"))
    return g.withColumn("fuel_per_hour", rnd(safe_div("fuel_cost", "hours"), 4)).orderBy("month")
