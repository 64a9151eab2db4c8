"""

``entry(spark)`` runs the flagship report (A6 budget variance) on sf0.001;
``queries()`` maps one key per implemented operator to ``(spark, sf_dir) ->
DataFrame``; ``oracle_sql()`` gives the independent DuckDB text for each key
that SQL can express (ML training and scoring keys have none).

Every query reads the whole derived star of ``sf_dir``; parameters (windows,
as-of dates) are the ones suggested in FIXTURES.md §2 for the test data.
"""

from __future__ import annotations

import datetime as _dt
import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystone.operators.budget import budget_variance
from keystone.operators.equipment import equipment_utilization
from keystone.operators.labor import labor_productivity
from keystone.operators.projects import project_performance
from keystone.operators.safety import safety_metrics
from keystone.operators.subcontractors import subcontractor_scorecard
from keystone.operators import extra as R
from keystone.operators import portfolio as D
from keystone.operators import quality as Q
from keystone.plans import features as M
from keystone.plans import models as MD
from keystone.plans.metrics import binary_metrics, class_balance
from keystone.plans.registry import get_model
from keystone.sources.star import load_star

SMOKE_DIR = "/root/testdata/sf0.001"
A1_AS_OF = _dt.date(2000, 12, 31)
A2_WINDOW = (_dt.date(1998, 1, 5), _dt.date(1998, 1, 9))
A5_WINDOW = (_dt.date(1997, 1, 1), _dt.date(1999, 12, 31))
M_AS_OF = _dt.date(2000, 12, 31)


def entry(spark: SparkSession) -> DataFrame:
    return budget_variance(load_star(spark, SMOKE_DIR))


def _star(fn, **kw):
    return lambda spark, sf_dir: fn(load_star(spark, sf_dir), **kw)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q = {
        "a1_project_performance": _star(project_performance, as_of=A1_AS_OF),
        "a2_equipment_utilization": _star(equipment_utilization, start=A2_WINDOW[0],
                                          end=A2_WINDOW[1]),
        "a3_subcontractor_scorecard": _star(subcontractor_scorecard),
        "a4_labor_productivity": _star(labor_productivity),
        "a5_safety_metrics": _star(safety_metrics, start=A5_WINDOW[0], end=A5_WINDOW[1]),
        "a6_budget_variance": _star(budget_variance),
    }
    a1 = lambda s: project_performance(s, as_of=A1_AS_OF)                        # noqa: E731
    a2 = lambda s: equipment_utilization(s, start=A2_WINDOW[0], end=A2_WINDOW[1], ranks=False)
    a3 = lambda s: subcontractor_scorecard(s, ranks=False)                       # noqa: E731
    a6 = lambda s: budget_variance(s, ranks=False)                               # noqa: E731
    a5 = lambda s: safety_metrics(s, start=A5_WINDOW[0], end=A5_WINDOW[1])       # noqa: E731
    over = {
        "d4_variance_by_type": (a6, D.variance_by_type),
        "d5_top_overruns": (budget_variance, D.top_overruns),
        "d6_cost_category_long": (a1, D.cost_category_long),
        "d8_fleet_kpis": (a2, D.fleet_kpis),
        "d9_utilization_by_type": (a2, D.utilization_by_type),
        "d10_utilization_tiers": (a2, D.utilization_tiers),
        "d11_scorecard_kpis": (subcontractor_scorecard, D.scorecard_kpis),
        "d12_cpi_histogram": (a3, D.cpi_histogram),
        "d13_performance_tiers": (subcontractor_scorecard, D.performance_tiers),
        "d14_best_per_trade": (subcontractor_scorecard, D.best_per_trade),
        "d15_labor_kpis": (labor_productivity, D.labor_kpis),
        "d16_labor_trend": (labor_productivity, D.labor_trend),
        "d17_incidents_by_severity": (a5, D.incidents_by_severity),
        "d17_incidents_by_type": (a5, D.incidents_by_type),
        "d18_severity_type_matrix": (a5, D.severity_type_matrix),
        "d19_cpi_bands": (a1, D.performance_bands),
        "d19_variance_bands": (a6, D.variance_bands),
    }
    q.update({
        "d1_portfolio_kpis": _star(D.portfolio_kpis),
        "d2_status_distribution": _star(D.status_distribution),
        "d3_project_list": _star(D.project_list),
        "d7_project_timeline": _star(D.project_timeline, as_of=A1_AS_OF),
        "g15_scorecard_trades": lambda spark, d: D.distinct_values(
            a3(load_star(spark, d)), "trade"),
    })
    q.update({
        "m2_cost_overrun_dataset": _star(M.cost_overrun_dataset),
        "m3_maintenance_snapshots": _star(M.maintenance_snapshots),
        "m4_maintenance_features": _star(M.maintenance_scoring_features, as_of=M_AS_OF),
    })
    q.update(ml_queries())
    q.update(generator_queries())
    from keystone.operators.labor import monthly_labor_with_lag
    from keystone.operators.safety import zero_incident_projects
    from keystone.sources.warehouse import load_summary, preview, run_sql
    q.update({
        "j5_zero_incident_projects": _star(lambda s: zero_incident_projects(
            s, A5_WINDOW[0], A5_WINDOW[1]).select(F.col("id").alias("project_id"), "status")),
        "w4_monthly_labor_with_lag": _star(monthly_labor_with_lag),
        "s10_load_summary": _star(load_summary),
        "s1_parameterised_sql": lambda spark, d: run_sql(
            spark, "SELECT id, project_name, contract_value FROM {p} "
                   "WHERE project_type = :ptype AND status = :status",
            {"ptype": "COMMERCIAL", "status": "ACTIVE"}, p=load_star(spark, d)["dim_projects"]),
        "s11_preview_top_variance": _star(lambda s: preview(
            budget_variance(s).select("project_id", "project_name", "variance_pct"), 5,
            [F.col("variance_pct").desc_nulls_last(), F.col("project_id")])),
        "j6_projects_with_costs": _star(lambda s: s["dim_projects"]
                                        .where(F.col("status").isin("ACTIVE", "COMPLETED")
                                               & F.col("actual_start_date").isNotNull())
                                        .join(s["fact_project_costs"].select("project_id").distinct(),
                                              F.col("id") == F.col("project_id"), "left_semi")
                                        .select("id", "project_name")),
    })
    q.update({
        "q1_enum_violations": _star(Q.enum_violations),
        "q2_foreign_key_orphans": _star(Q.foreign_key_orphans),
        "q3_not_null_violations": _star(Q.not_null_violations),
        "q4_primary_key_duplicates": _star(Q.primary_key_duplicates),
        "r1_inspections_by_project": _star(R.inspection_rates, by="project_id"),
        "r1_inspections_by_inspector": _star(R.inspection_rates, by="inspector_name"),
        "r2_delivery_by_supplier": _star(R.delivery_performance, by="supplier"),
        "r2_delivery_by_project": _star(R.delivery_performance, by="project_id"),
        "r3_monthly_cost_curve": _star(R.monthly_cost_curve),
        "r4_incident_trend": _star(R.incident_trend),
        "r5_equipment_roi_by_type": _star(R.equipment_roi_by_type),
        "r5_fuel_trend_by_month": _star(R.fuel_trend_by_month),
    })
    q.update(one_of_queries())
    q.update(rule_queries())
    q.update(warehouse_queries())
    for k, (rep, fn) in over.items():
        q[k] = (lambda rep, fn: lambda spark, d: fn(rep(load_star(spark, d))))(rep, fn)
    for part in _training_data():
        q.update(part.queries())
    return q


def _training_data() -> list:
    """Modules of the optional training-data part: its operators and its pipeline.

    Only their absence leaves them out; an error inside them is an error here."""
    specs = [importlib.util.find_spec(name) for name in ("corpus_pipeline", "keystone.llm")]
    if any(spec is None or spec.origin is None for spec in specs):      # a folder without modules has no origin
        return []
    import corpus_pipeline

    from keystone.llm import queries as operators

    return [operators, corpus_pipeline]


def warehouse_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """S5-S7 on a warehouse of their own in the shared folder, counted after the last
    commit, and G3 from stored sketches."""
    import uuid

    from keystone.operators.labor import merged_distinct, monthly_distinct_sketches
    from keystone.session import ensure_checkpoint_dir
    from keystone.sources import warehouse as W

    def filled(spark, star):
        """Projects, and costs in two batches of which the first is sent twice."""
        root = f"{ensure_checkpoint_dir(spark)}/keystone-warehouse-{uuid.uuid4().hex}"
        W.init_warehouse(spark, root)
        W.append(star["dim_projects"], root, "dim_projects", batch="projects")
        odd = F.col("project_id") % 2 == 1
        for name, rows in (("odd", odd), ("even", ~odd), ("odd", odd)):
            W.append(star["fact_project_costs"].where(rows), root, "fact_project_costs", batch=name)
        return root

    def appended(spark, d):
        return W.load_summary(W.load_warehouse(spark, filled(spark, load_star(spark, d))))

    def truncated(spark, d):
        root = filled(spark, load_star(spark, d))
        W.clear_facts(spark, root)
        return W.load_summary(W.load_warehouse(spark, root))

    def load_if_absent(spark, d):
        """Machines are loaded, projects stay: a second load of active ones changes nothing."""
        star = load_star(spark, d)
        root = f"{ensure_checkpoint_dir(spark)}/keystone-warehouse-{uuid.uuid4().hex}"
        W.save_star(star, root, "ignore", ["dim_projects"])
        active = {"dim_projects": star["dim_projects"].where("status = 'ACTIVE'"), "dim_equipment": star["dim_equipment"]}
        W.save_star(active, root, "ignore", list(active))
        W.init_warehouse(spark, root)
        return W.load_summary(W.load_warehouse(spark, root))

    def crews(star):
        """Estimates from monthly sketches against the exact counts, within five standard errors."""
        labor = star["fact_labor_hours"]
        about = merged_distinct(monthly_distinct_sketches(labor, "project_id", "employee_id"), "project_id")
        exact = labor.groupBy("project_id").agg(F.countDistinct("employee_id").alias("employees"))
        close = F.abs(F.col("distinct_items") - F.col("employees")) <= F.ceil(F.col("employees") * 0.08)
        return exact.join(about, "project_id").select("project_id", "employees", close.alias("within_bound"))

    return {"s5_append_batches": appended, "s6_truncate_facts": truncated, "s7_load_if_absent": load_if_absent,
            "g3_sketched_crews": _star(crews)}


def one_of_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Reports for one project or trade (F7), and the D20 / M16 / M17 rules over scores
    taken from the feature jobs, so that they can be checked without a forest."""
    def risk(star):
        p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.5) - F.col("early_phase_cpi")))
        ds = M.cost_overrun_dataset(star).select("project_id", p.alias("p"))
        return MD.risk_kpis(ds.withColumn("risk_level", MD.project_risk_band("p")), "risk_level", "p")

    def bands(star):
        p = F.least(F.lit(1.0), F.col("days_since_maintenance") / 4000.0)
        ds = M.maintenance_scoring_features(star, as_of=M_AS_OF).select("equipment_id", p.alias("p"))
        ds = ds.withColumn("days", MD.days_until_maintenance(F.col("p")))
        return ds.select("equipment_id", "days", MD.days_band("days").alias("days_band"),
                         MD.fleet_risk_band("p", "days").alias("risk"))

    return {
        "a1_one_project": _star(project_performance, as_of=A1_AS_OF, project_id=7),
        "a4_one_project": _star(labor_productivity, project_id=7),
        "d11_one_trade": _star(lambda s: D.scorecard_kpis(subcontractor_scorecard(s), "HVAC")),
        "m17_rule_risk_kpis": _star(risk),
        "d20_rule_machine_bands": _star(bands),
    }


def rule_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """M13-M16, M18 and M21 with rules in place of the forests, so that populations,
    features, type codes, bands, advice and days can be checked; also for one id (F8)."""
    def cost(star):
        p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.5) - F.col("early_phase_cpi")))
        return MD.Rule(p, MD.fit_label_encoder(star["dim_projects"], "project_type"), M.COST_FEATURES)

    def maint(star):
        p = F.least(F.lit(1.0), F.col("days_since_maintenance") / 4096.0)
        return MD.Rule(p, MD.fit_label_encoder(star["dim_equipment"], "equipment_type"), M.MAINTENANCE_FEATURES)

    flat = lambda df: df.select(*[c for c in df.columns if c != "features"], "features.*")
    projects = lambda s: MD.portfolio_risk(s, cost(s))                                    # noqa: E731
    machines = lambda s: MD.fleet_risk(s, maint(s), as_of=M_AS_OF)                        # noqa: E731

    def coverage(star):
        both = [(M.project_scoring_features(star), M.COST_FEATURES), (M.maintenance_scoring_features(star, M_AS_OF), M.MAINTENANCE_FEATURES)]
        (p, pf), (e, ef) = [(df, [f for f in feats if f in df.columns]) for df, feats in both]
        return MD.labelled_importance(MD.feature_coverage(p, pf).unionByName(MD.feature_coverage(e, ef)))

    return {
        "m13_rule_scores": _star(lambda s: flat(MD.score_projects(s, cost(s)).drop("contract_value"))),
        "m13_rule_one_project": _star(lambda s: flat(MD.predict_project(s, cost(s), 7).drop("contract_value"))),
        "m14_rule_scores": _star(lambda s: flat(MD.score_equipment(s, maint(s), as_of=M_AS_OF))),
        "m14_rule_one_machine": _star(lambda s: flat(MD.predict_machine(s, maint(s), 7, as_of=M_AS_OF))),
        "m15_rule_portfolio_risk": _star(projects),
        "m16_rule_fleet_risk": _star(machines),
        "m18_rule_high_risk_projects": _star(lambda s: MD.high_risk(projects(s), "risk_level", "High")),
        "m18_rule_critical_equipment": _star(lambda s: MD.high_risk(machines(s), "risk", "Critical")),
        "m21_feature_coverage": _star(coverage),
    }


def _rule_scores(star):
    """M9 input: the early-CPI rule (overrun when early CPI < 1) on the M2 dataset."""
    from pyspark.sql import functions as F
    ds = M.cost_overrun_dataset(star)
    return ds.select(F.col("will_overrun").alias("label"),
                     F.when(F.col("early_phase_cpi") < 1.0, 1).otherwise(0).alias("prediction"),
                     (-F.col("early_phase_cpi")).alias("score"))


def ml_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """M5/M9/M19 (oracle-checked) and the forest train / score operators (rows only)."""
    from pyspark.sql import functions as F

    def enc(spark, d):
        ds = M.cost_overrun_dataset(load_star(spark, d))
        return MD.fit_label_encoder(ds, "project_type").withColumnRenamed("label", "project_type")

    cost = lambda spark, d: get_model(spark, d, "cost")           # noqa: E731
    maint = lambda spark, d: get_model(spark, d, "maintenance")
    return {
        "m5_project_type_encoding": enc,
        "m9_binary_metrics": _star(lambda s: binary_metrics(_rule_scores(s))),
        "m19_cost_class_balance": _star(lambda s: class_balance(M.cost_overrun_dataset(s),
                                                                "will_overrun")),
        "m19_maintenance_class_balance": _star(lambda s: class_balance(
            M.maintenance_snapshots(s), "needs_maintenance_soon")),
        "m6_stratified_split": _star(lambda s: MD.stratified_split(
            M.cost_overrun_dataset(s), "will_overrun", ["project_id"]).groupBy(
            "will_overrun", "is_test").count()),
        "m10_cost_feature_importance": lambda spark, d: cost(spark, d).feature_importance,
        "m10_maintenance_feature_importance": lambda spark, d: maint(spark, d).feature_importance,
        "m11_cost_model_metrics": lambda spark, d: cost(spark, d).metrics(),
        "m12_maintenance_model_metrics": lambda spark, d: maint(spark, d).train_metrics,
        "m13_score_projects": lambda spark, d: MD.score_projects(load_star(spark, d), cost(spark, d)),
        "m14_score_equipment": lambda spark, d: MD.score_equipment(
            load_star(spark, d), maint(spark, d), as_of=M_AS_OF),
        "m15_portfolio_risk": lambda spark, d: MD.portfolio_risk(load_star(spark, d), cost(spark, d)),
        "m16_fleet_risk": lambda spark, d: MD.fleet_risk(load_star(spark, d), maint(spark, d),
                                                         as_of=M_AS_OF),
        "m17_portfolio_risk_kpis": lambda spark, d: MD.risk_kpis(
            MD.portfolio_risk(load_star(spark, d), cost(spark, d)), "risk_level",
            "overrun_probability"),
        "m17_fleet_risk_kpis": lambda spark, d: MD.risk_kpis(
            MD.fleet_risk(load_star(spark, d), maint(spark, d), as_of=M_AS_OF), "risk",
            "maintenance_probability"),
        "m18_high_risk_projects": lambda spark, d: MD.high_risk(
            MD.portfolio_risk(load_star(spark, d), cost(spark, d)), "risk_level", "High"),
        "m18_critical_equipment": lambda spark, d: MD.high_risk(
            MD.fleet_risk(load_star(spark, d), maint(spark, d), as_of=M_AS_OF), "risk", "Critical"),
        "m20_maintenance_metrics_table": lambda spark, d: maint(spark, d).metrics(),
        "m21_labelled_importance": lambda spark, d: MD.labelled_importance(
            cost(spark, d).feature_importance.unionByName(maint(spark, d).feature_importance)),
        "m3_class_by_type": _star(lambda s: M.maintenance_snapshots(s).groupBy("equipment_type")
                                  .agg(F.count(F.lit(1)).alias("snapshots"),
                                       F.sum("needs_maintenance_soon").alias("positives"))),
    }


STAR_END = _dt.date(2001, 12, 31)


def generator_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """N1-N6 and N11 over the given tables: calendars from the order dates, project
    structure from the derived projects."""
    from pyspark.sql import functions as F

    from keystone.sources import generate as G
    from keystone.sources.calendar import calendar_for_span, holiday_name
    from keystone.sources.star import read_base

    def windows(star):
        return G.project_windows(star["dim_projects"], A1_AS_OF, STAR_END)

    def cal(spark, d):
        return calendar_for_span(read_base(spark, d, "orders"), "o_orderdate")

    def holidays(spark, d):
        c = cal(spark, d).where("is_holiday")
        return c.select("date", "year", holiday_name(F.col("date")).alias("holiday"))

    def phase_costs(star):
        w = windows(star)
        c = star["fact_project_costs"].join(w, "project_id")
        ph = G.phase_attr(G.phase_index(F.col("start"), F.col("ref_end"), F.col("date_id")), "name")
        return c.groupBy(ph.alias("phase")).agg(F.count(F.lit(1)).alias("cost_rows"),
                                                F.sum("amount").cast("double").alias("actual_cost"))

    return {
        "n1_calendar": cal,
        "n2_holidays": holidays,
        "n3_project_windows": _star(lambda s: windows(s)),
        "n4_phase_costs": _star(phase_costs),
        "n5_weekly_spine": _star(lambda s: G.weekly_spine(windows(s)).select("project_id", "week")),
        "n6_budget_allocation": _star(lambda s: G.budget_allocation(
            windows(s), s["dim_projects"].select(F.col("id").alias("project_id"),
                                                 F.col("contract_value").alias("basis")))),
        "n11_inspection_dates": _star(lambda s: G.inspection_dates(windows(s))),
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL per key of ``queries()`` (omitted for non-SQL operators)."""
    from oracle_queries import all_oracles
    out = all_oracles()
    for part in _training_data():
        out.update(part.oracle_sql())
    return out
