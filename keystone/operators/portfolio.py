"""Dashboard roll-ups re-aimed as DataFrame operators.

The second layer of small aggregations the dashboard computes over the
reports. Page chrome, colours and charts are not built; colour choices become
``good`` / ``warning`` / ``bad`` band labels. Means and sums of rounded report
values are taken over exact decimals so they do not depend on row order.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystone.functions.exprs import col, dbl, dec_sum, money_label, rnd, safe_div
from keystone.session import materialize
from keystone.operators.projects import AS_OF


def exact_mean(c, scale: int = 2) -> Column:
    """Mean of values carrying ``scale`` decimals (NULLs skipped), order-independent."""
    d = col(c).cast(f"decimal(30,{scale})")
    return safe_div(F.sum(d), F.count(d))


def exact_sum(c, scale: int = 2) -> Column:
    return F.sum(col(c).cast(f"decimal(30,{scale})")).cast("double")


# ---------------------------------------------------------------------------
# D19 band helpers (colour rules as labels)
# ---------------------------------------------------------------------------
def cpi_band(c) -> Column:
    x = col(c)
    return F.when(x.isNull(), F.lit(None)).when(x >= 1.0, "good").when(x >= 0.90, "warning") \
            .otherwise("bad")


def variance_band(c) -> Column:
    x = col(c)
    return F.when(x.isNull(), F.lit(None)).when(x <= 0, "good").when(x <= 15, "warning") \
            .otherwise("bad")


def utilization_band(c) -> Column:
    x = col(c)
    return F.when(x.isNull(), F.lit(None)).when(x >= 75, "good").when(x >= 50, "warning") \
            .otherwise("bad")


# ---------------------------------------------------------------------------
# Portfolio page
# ---------------------------------------------------------------------------
def portfolio_kpis(star: dict[str, DataFrame]) -> DataFrame:
    """Project counts by status, active / total contract value, portfolio CPI."""
    st = F.col("status")
    cv = F.col("contract_value").cast("decimal(20,2)")
    costs = star["fact_project_costs"].agg(
        rnd(safe_div(dec_sum("budgeted_amount", 4), dec_sum("amount", 4)), 3).alias("portfolio_cpi"))
    return star["dim_projects"].agg(
        F.count(F.when(st == "ACTIVE", 1)).alias("active_projects"),
        F.count(F.when(st == "COMPLETED", 1)).alias("completed_projects"),
        F.count(F.when(st == "PLANNING", 1)).alias("planning_projects"),
        F.count(F.when(st == "ON_HOLD", 1)).alias("on_hold_projects"),
        F.sum(F.when(st == "ACTIVE", cv).otherwise(F.lit(0).cast("decimal(20,2)")))
        .cast("double").alias("active_contract_value"),
        F.sum(cv).cast("double").alias("total_contract_value"),
    ).withColumn("portfolio_cpi", costs.scalar())


def status_distribution(star: dict[str, DataFrame]) -> DataFrame:
    """Projects per status."""
    return star["dim_projects"].groupBy("status").agg(F.count(F.lit(1)).alias("count")) \
        .orderBy(F.col("count").desc(), "status")


def project_list(star: dict[str, DataFrame]) -> DataFrame:
    """D3: started ACTIVE / ON_HOLD / COMPLETED projects in that order, then by name."""
    st = F.col("status")
    order = F.when(st == "ACTIVE", 1).when(st == "ON_HOLD", 2).otherwise(3)
    return (star["dim_projects"]
            .where(st.isin("ACTIVE", "COMPLETED", "ON_HOLD") & F.col("actual_start_date").isNotNull())
            .select("id", "project_name", "status", "project_type", "contract_value", "location")
            .orderBy(order, "project_name", "id"))


def variance_by_type(variance: DataFrame) -> DataFrame:
    """Mean variance % and project count per project type, with a band."""
    out = variance.groupBy("project_type").agg(
        rnd(exact_mean("variance_pct"), 2).alias("avg_variance"),
        F.count("project_name").alias("project_count"))
    return out.withColumn("band", variance_band("avg_variance")).orderBy("project_type")


def top_overruns(variance: DataFrame) -> DataFrame:
    """The top-5 overrun rows (ties kept) with a money label."""
    return (variance.where(F.col("top_5_overrun") == "Yes")
            .select("project_id", "project_name", "project_type", "variance_pct", "cost_variance",
                    money_label("cost_variance").alias("cost_variance_label"),
                    "budget_status", "primary_overrun_driver")
            .orderBy(F.col("variance_pct").desc(), "project_id"))


def cost_category_long(performance: DataFrame) -> DataFrame:
    """Actual / budgeted cost per category in long form (P8 unpivot)."""
    wide = performance.select("project_id", "cost_category",
                              F.col("actual_cost").alias("Actual"),
                              F.col("budgeted_cost").alias("Budgeted"))
    return wide.unpivot(["project_id", "cost_category"], ["Actual", "Budgeted"], "type", "amount")


def project_timeline(star: dict[str, DataFrame], as_of: _dt.date = AS_OF) -> DataFrame:
    """Planned and actual intervals per project (P9); an open project's actual
    interval ends at ``as_of``; a missing start drops the row."""
    p = star["dim_projects"]
    planned = p.where(F.col("planned_start_date").isNotNull() & F.col("planned_end_date").isNotNull()) \
        .select(F.col("id").alias("project_id"), F.lit("Planned").alias("phase"),
                F.col("planned_start_date").alias("start"), F.col("planned_end_date").alias("end"))
    actual = p.where(F.col("actual_start_date").isNotNull()) \
        .select(F.col("id").alias("project_id"), F.lit("Actual").alias("phase"),
                F.col("actual_start_date").alias("start"),
                F.coalesce("actual_end_date", F.lit(as_of)).alias("end"))
    return planned.unionByName(actual)


# ---------------------------------------------------------------------------
# Equipment page
# ---------------------------------------------------------------------------
UTILIZATION_TARGET = 65.0


def fleet_kpis(util: DataFrame) -> DataFrame:
    """Mean utilisation (and delta to the 65 % target), revenue, net revenue,
    number of under-utilised machines."""
    avg = exact_mean("utilization_pct")
    return util.agg(
        rnd(avg, 2).alias("avg_utilization_pct"),
        rnd(avg - UTILIZATION_TARGET, 2).alias("delta_vs_target"),
        exact_sum("revenue_generated").alias("total_revenue"),
        exact_sum("net_revenue").alias("total_net_revenue"),
        F.count(F.when(F.col("is_underutilized") == 1, 1)).alias("underutilized_count"))


def utilization_by_type(util: DataFrame) -> DataFrame:
    """Per equipment type mean utilisation, count, mean revenue and band."""
    out = util.groupBy("equipment_type").agg(
        rnd(exact_mean("utilization_pct"), 2).alias("avg_util"),
        F.count("equipment_name").alias("count"),
        rnd(exact_mean("revenue_generated"), 2).alias("avg_revenue"))
    return out.withColumn("band", utilization_band("avg_util")).orderBy("avg_util", "equipment_type")


def value_counts(df: DataFrame, c: str, name: str = "count") -> DataFrame:
    """Rows per value, most frequent first."""
    return df.groupBy(c).agg(F.count(F.lit(1)).alias(name)).orderBy(F.col(name).desc(), c)


def distinct_values(df: DataFrame, c: str) -> DataFrame:
    """The distinct non-NULL values of ``c`` in order (filter lists)."""
    return df.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c)


def utilization_tiers(util: DataFrame) -> DataFrame:
    """Machines per utilisation tier."""
    return value_counts(util, "utilization_tier")


# ---------------------------------------------------------------------------
# Subcontractor page
# ---------------------------------------------------------------------------
def scorecard_kpis(scorecard: DataFrame, trade: str | None = None) -> DataFrame:
    """Evaluated count, mean CPI, top performers, needs-improvement (F7 trade filter)."""
    df = scorecard if trade is None else scorecard.where(F.col("trade") == trade)
    tier = F.col("performance_tier")
    return df.agg(
        F.count(F.lit(1)).alias("subcontractors_evaluated"),
        rnd(exact_mean("cpi", 3), 3).alias("avg_cpi"),
        F.count(F.when(tier == "Top Performer", 1)).alias("top_performers"),
        F.count(F.when(tier == "Needs Improvement", 1)).alias("needs_improvement"))


def histogram(df: DataFrame, c: str, bins: int = 25) -> DataFrame:
    """Equal-width histogram of ``c`` over [min, max] (NULLs skipped).

    The input is read once, down to its distinct values and their counts; bounds
    and bins are taken from those.
    """
    values = materialize(df.select(dbl(c).alias("_x")).where("_x IS NOT NULL")
                         .groupBy("_x").agg(F.count(F.lit(1)).alias("_n")), "histogram-values")
    b = values.agg(F.struct(F.min("_x").alias("lo"), F.max("_x").alias("hi")).alias("b")).scalar()
    x, lo, hi = F.col("_x"), F.col("_b.lo"), F.col("_b.hi")
    width = (hi - lo) / float(bins)
    idx = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor((x - lo) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)))
    counts = (values.withColumn("_b", b)                           # bounds attached once
              .groupBy(idx.cast("long").alias("bin"), F.col("_b"))
              .agg(F.sum("_n").alias("count")))
    return (counts.select("bin", (lo + F.col("bin") * width).alias("bin_start"),
                          (lo + (F.col("bin") + 1) * width).alias("bin_end"), "count")
            .orderBy("bin"))


def cpi_histogram(scorecard: DataFrame, bins: int = 25) -> DataFrame:
    """D12."""
    return histogram(scorecard, "cpi", bins)


def performance_tiers(scorecard: DataFrame) -> DataFrame:
    """D13."""
    return value_counts(scorecard, "performance_tier")


def best_per_trade(scorecard: DataFrame) -> DataFrame:
    """The best subcontractor of each trade."""
    return (scorecard.where(F.col("top_in_trade") == "Yes")
            .select("trade", "company_name", "composite_score", "cpi", "client_rating",
                    "projects_count", "performance_tier")
            .orderBy("trade"))


# ---------------------------------------------------------------------------
# Labour and safety pages
# ---------------------------------------------------------------------------
def labor_kpis(labor: DataFrame) -> DataFrame:
    """Total hours and cost, mean effective rate, trades active."""
    return labor.agg(
        exact_sum("total_hours", 1).alias("total_hours"),
        exact_sum("total_labor_cost", 2).alias("total_labor_cost"),
        rnd(exact_mean("effective_cost_per_hour"), 2).alias("avg_effective_rate"),
        F.count(F.lit(1)).alias("trades_active"))


def trend_arrow(c) -> Column:
    """▲ when > 0, ▼ otherwise, — when NULL."""
    x = col(c)
    return F.when(x.isNull(), "—").when(x > 0, "▲").otherwise("▼")


def labor_trend(labor: DataFrame) -> DataFrame:
    """Month-over-month arrow per trade."""
    return labor.select("trade", "mom_hours_pct", trend_arrow("mom_hours_pct").alias("trend"))


SEVERITY_ORDER = ["SEVERE", "MODERATE", "MINOR"]


def incidents_by_severity(safety: DataFrame) -> DataFrame:
    """Incidents per severity, SEVERE → MINOR."""
    s = F.col("severity")
    order = F.when(s == "SEVERE", 1).when(s == "MODERATE", 2).when(s == "MINOR", 3).otherwise(4)
    return safety.groupBy("severity").agg(F.sum("incident_count").alias("incident_count")) \
        .orderBy(order, "severity")


def incidents_by_type(safety: DataFrame) -> DataFrame:
    """Incidents per type."""
    return safety.groupBy("incident_type").agg(F.sum("incident_count").alias("incident_count")) \
        .orderBy("incident_type")


def severity_type_matrix(safety: DataFrame) -> DataFrame:
    """Wide severity × type matrix (pivot over the fixed severity domain)."""
    return (safety.groupBy("incident_type").pivot("severity", ["MINOR", "MODERATE", "SEVERE"])
            .agg(F.sum("incident_count")).na.fill(0)
            .select("incident_type", F.col("MINOR").alias("minor"),
                    F.col("MODERATE").alias("moderate"), F.col("SEVERE").alias("severe"))
            .orderBy("incident_type"))


def performance_bands(performance: DataFrame) -> DataFrame:
    """CPI band per project category (A1 rows)."""
    return performance.select("project_id", "cost_category", "category_cpi",
                              cpi_band("category_cpi").alias("cpi_band"))


def variance_bands(variance: DataFrame) -> DataFrame:
    """Variance band per project (A6 rows)."""
    return variance.select("project_id", "variance_pct",
                           variance_band("variance_pct").alias("variance_band"))
