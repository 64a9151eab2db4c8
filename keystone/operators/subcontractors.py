"""A3: subcontractor performance scorecard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystone.functions.exprs import dbl, dec_sum, label_case, rnd, safe_div, yes_no
from keystone.operators.ranking import Ordering, with_orderings


def subcontractor_metrics(costs: DataFrame) -> DataFrame:
    """Two-level roll-up: (subcontractor, project) sums, then per subcontractor."""
    sub = costs.where((F.col("cost_category") == "SUBCONTRACTOR")
                      & F.col("subcontractor_id").isNotNull())
    per_project = sub.groupBy("subcontractor_id", "project_id").agg(
        dec_sum("amount", 4).alias("actual_cost"), dec_sum("budgeted_amount", 4).alias("budgeted_cost"))
    m = per_project.groupBy("subcontractor_id").agg(
        F.count(F.lit(1)).alias("projects_count"),     # one row per distinct project
        F.sum("actual_cost").alias("a"), F.sum("budgeted_cost").alias("b"))
    return m.select(
        "subcontractor_id", "projects_count",
        rnd("a", 2).alias("total_actual"), rnd("b", 2).alias("total_budgeted"),
        rnd(safe_div("b", "a"), 3).alias("cpi"),
        rnd(safe_div(dbl(F.col("b") - F.col("a")) * 100.0, "b"), 2).alias("budget_adherence_pct"))


def subcontractor_scorecard(star: dict[str, DataFrame], top_n: int = 10, ranks: bool = True) -> DataFrame:
    """A3: composite = 50·CPI + 30·rating/5 + 20·min(projects, 10)/10 (2 dp), overall
    and in-trade ranks, tier and the best subcontractor per trade (id breaks ties).
    Subcontractors without subcontract costs are not listed. Without ``ranks``, the
    scores alone: neither ranks, tier, best per trade nor the order."""
    sm = subcontractor_metrics(star["fact_project_costs"])
    s = star["dim_subcontractors"]
    projects = F.least(F.col("projects_count"), F.lit(10)).cast("double")
    composite = ((F.coalesce(F.col("cpi"), F.lit(0.0)) * 50.0)
                 + (F.col("rating") / 5.0 * 30.0)
                 + (projects / 10.0 * 20.0))
    scored = s.join(sm, s.id == sm.subcontractor_id).select(
        "subcontractor_id", "company_name", "trade", F.col("rating").alias("client_rating_raw"),
        F.col("years_in_business").cast("long").alias("years_in_business"), "projects_count",
        "total_actual", "total_budgeted", "cpi", "budget_adherence_pct",
        rnd(composite, 2).alias("composite_score"))
    if not ranks:
        return scored
    out = with_orderings(scored, Ordering("composite_score", descending=True, rank="overall_rank"),
                         Ordering("composite_score", parts=["trade"], descending=True, tie="subcontractor_id",
                                  rank="rank_in_trade", first="_top"))
    cpi, rating = F.col("cpi"), F.col("client_rating_raw")
    tier = label_case(None, [
        (F.col("overall_rank") <= top_n, "Top Performer"),
        ((cpi >= 1.0) & (rating >= 4.0), "Recommended"),
        (cpi >= 0.90, "Above Average"),
        (cpi < 0.80, "Needs Improvement"),
    ], "Average")
    return out.select(
        "subcontractor_id", "company_name", "trade",
        rnd("client_rating_raw", 1).alias("client_rating"), "years_in_business",
        "projects_count", "total_actual", "total_budgeted", "cpi", "budget_adherence_pct",
        "composite_score", "overall_rank", "rank_in_trade",
        tier.alias("performance_tier"), yes_no(F.col("_top")).alias("top_in_trade"),
    ).orderBy("overall_rank", "subcontractor_id")
