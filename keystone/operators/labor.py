"""A4: labour productivity by trade with month-over-month change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystone.functions.exprs import dbl, dec_sum, month_key, rnd, safe_div
from keystone.session import materialize


def _labor_by_trade(star: dict[str, DataFrame], project_id: int | None, *grain: Column) -> DataFrame:
    """Hours, cost and rates summed to (employee, ``grain``) before the trade is joined to them."""
    lh = star["fact_labor_hours"]
    if project_id is not None:                  # F7: optional filter (None = all projects)
        lh = lh.where(F.col("project_id") == F.lit(project_id))
    sums = lh.groupBy("employee_id", *grain).agg(
        dec_sum("hours_worked", 1).alias("h"),
        dec_sum(F.col("hours_worked") * F.col("hourly_rate"), 3).alias("c"),
        dec_sum("hourly_rate", 2).alias("rs"), F.count("hourly_rate").alias("rn"))
    e = star["dim_employees"].select(F.col("id").alias("e_id"), "trade")
    return sums.join(e, sums.employee_id == e.e_id).drop("e_id")


def monthly_labor_with_lag(star: dict[str, DataFrame], project_id: int | None = None) -> DataFrame:
    """Hours and cost per (trade, month) with the previous existing month's
    values (gaps are not filled); rows per trade are bounded by the months."""
    m = _labor_by_trade(star, project_id, month_key("date_id").alias("yr_month")) \
        .groupBy("trade", "yr_month").agg(F.sum("h").alias("mh"), F.sum("c").alias("mc"))
    w = Window.partitionBy("trade").orderBy("yr_month")
    return m.select("trade", "yr_month", F.col("mh").cast("double").alias("monthly_hours"),
                    F.col("mc").cast("double").alias("monthly_cost"),
                    F.lag("mh").over(w).cast("double").alias("prev_hours"),
                    F.lag("mc").over(w).cast("double").alias("prev_cost"))


def labor_productivity(star: dict[str, DataFrame], project_id: int | None = None) -> DataFrame:
    """A4: one row per trade.

    The trade domain is a fixed 9-value enum, so after the aggregates every
    window below runs over at most 9 rows (or 9 × months for the MoM part).
    """
    # One fact scan reduced to (employee, project, month); monthly sums and the
    # two distinct counts are then taken from this small frame.
    lt = materialize(_labor_by_trade(star, project_id, F.col("project_id"), month_key("date_id").alias("yr_month")),
                     "a4_labor")
    triples = lt.groupBy("trade", "employee_id", "project_id").agg(
        *[F.sum(c).alias(c) for c in ("h", "c", "rs", "rn")])
    la = triples.groupBy("trade").agg(
        F.sum("h").alias("h"), F.sum("c").alias("c"),
        F.sum("rs").alias("rate_sum"), F.sum("rn").alias("rate_n"),
        F.countDistinct("employee_id").alias("unique_employees"),
        F.countDistinct("project_id").alias("projects_worked"))
    la = la.select(
        "trade", rnd("h", 1).alias("total_hours"), rnd("c", 2).alias("total_labor_cost"),
        rnd(safe_div("rate_sum", "rate_n"), 2).alias("avg_hourly_rate"),
        "unique_employees", "projects_worked")

    monthly = lt.groupBy("trade", "yr_month").agg(F.sum("h").alias("mh"), F.sum("c").alias("mc"))
    wt = Window.partitionBy("trade").orderBy("yr_month")
    latest = (monthly.select("*", F.lag("mh").over(wt).alias("ph"), F.lag("mc").over(wt).alias("pc"),
                             F.max("yr_month").over(Window.partitionBy("trade")).alias("_last"))
              .where(F.col("yr_month") == F.col("_last"))
              .select(F.col("trade").alias("lm_trade"), F.col("yr_month").alias("latest_month"),
                      rnd(safe_div(dbl(F.col("mh") - F.col("ph")) * 100.0, "ph"), 2).alias("mom_hours_pct"),
                      rnd(safe_div(dbl(F.col("mc") - F.col("pc")) * 100.0, "pc"), 2).alias("mom_cost_pct")))

    out = la.join(latest, la.trade == latest.lm_trade, "left")
    w_all = Window.partitionBy()
    return out.select(
        "trade", "total_hours", "total_labor_cost", "avg_hourly_rate",
        rnd(safe_div("total_labor_cost", "total_hours"), 2).alias("effective_cost_per_hour"),
        "unique_employees",
        rnd(safe_div("total_hours", "unique_employees"), 1).alias("avg_hours_per_employee"),
        "projects_worked", "latest_month", "mom_hours_pct", "mom_cost_pct",
        F.rank().over(Window.orderBy(F.col("total_labor_cost").desc())).cast("long").alias("cost_rank"),
        F.rank().over(Window.orderBy(F.col("total_hours").desc())).cast("long").alias("hours_rank"),
        # shares of the rounded totals, summed exactly (order-independent)
        rnd(safe_div(F.col("total_hours") * 100.0,
                     F.sum(F.col("total_hours").cast("decimal(20,1)")).over(w_all)), 2)
        .alias("pct_of_total_hours"),
        rnd(safe_div(F.col("total_labor_cost") * 100.0,
                     F.sum(F.col("total_labor_cost").cast("decimal(22,2)")).over(w_all)), 2)
        .alias("pct_of_total_cost"),
    ).orderBy(F.col("total_labor_cost").desc(), "trade")


def monthly_distinct_sketches(df: DataFrame, entity: str, item: str, day: str = "date_id", lg_k: int = 12) -> DataFrame:
    """G3 opt-in: (entity, yr_month, sketch) with a mergeable sketch of the distinct items.

    Sketches of any months or entities merge into one of their union, so a distinct
    count over a year or a fleet needs no second look at the facts. The relative
    standard error is about 1.04 / sqrt(2**lg_k): 1.6 % by default.
    """
    return df.where(F.col(item).isNotNull()).groupBy(entity, month_key(day).alias("yr_month")) \
        .agg(F.hll_sketch_agg(item, F.lit(lg_k)).alias("sketch"))


def merged_distinct(sketches: DataFrame, *by: str, name: str = "distinct_items") -> DataFrame:
    """Estimated distinct items per ``by`` (over everything without it) from stored sketches."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(name))
