"""Feature jobs and single reports against figures worked out by hand from the small star."""

from __future__ import annotations

import datetime as _dt

from keystone.operators.projects import project_performance
from keystone.plans import features as FE

MEASURES = ["age_days", "total_hours_used", "avg_hours_per_day", "fuel_cost_per_hour", "recent_fuel_cost_trend",
            "maintenance_event_count", "days_since_maintenance", "avg_maint_cost_per_event"]


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r.asDict() for r in df.collect()}


def test_early_phase_and_final_variance(site_star):
    rows = by(FE.cost_overrun_dataset(site_star), "project_id")
    assert set(rows) == {1, 2, *range(21, 33)}                   # finished ones alone
    # 300 planned days: 75 early days from 6 Feb hold three payments of 20 000 against 24 000
    assert [rows[1][c] for c in ("planned_duration", "early_phase_cpi", "variance_pct", "will_overrun")] == [300, 1.2, 21.25, 1]
    assert [rows[2][c] for c in ("planned_duration", "early_phase_cpi", "variance_pct", "will_overrun")] == [180, 1.25, -20.0, 0]
    assert rows[2]["square_footage"] == 0.0


def test_scoring_features_of_running_projects(site_star):
    rows = by(FE.project_scoring_features(site_star), "project_id")
    assert (rows[3]["early_phase_cpi"], rows[3]["planned_duration"]) == (0.9, 365)
    assert (rows[4]["early_phase_cpi"], rows[4]["planned_duration"]) == (1.0, 365)   # no costs, no planned end


def test_snapshots(site_star):
    rows = by(FE.maintenance_snapshots(site_star), "equipment_id", "snapshot_date")
    assert len(rows) == 4 * 3                                    # 1 March to 1 May
    got = {d: [rows[1, d][c] for c in (*MEASURES, "needs_maintenance_soon")] for m, d in rows if m == 1}
    assert got == {
        _dt.date(2023, 3, 1): [273, 351.0, 1.286, 5.0, 1.0, 1, 19, 250.0, 0],
        _dt.date(2023, 4, 1): [304, 537.0, 1.766, 5.0, 1.0, 1, 50, 250.0, 1],
        _dt.date(2023, 5, 1): [334, 714.0, 2.138, 5.0, 2.9667, 2, 21, 250.0, 0]}


def test_scoring_features_of_machines(site_star):
    rows = by(FE.maintenance_scoring_features(site_star, _dt.date(2023, 5, 1)), "equipment_id")
    assert [rows[1][c] for c in MEASURES] == [334, 714.0, 2.138, 5.0, 2.9667, 2, 21, 250.0]
    assert [rows[4][c] for c in ("has_usage", "age_days", "total_hours_used", "days_since_maintenance")] == [0, 120, 0.0, 120]
    assert rows[5]["age_days"] is None and rows[5]["avg_hours_per_day"] is None   # an unknown age isn't one day


def test_one_project_report(site_star):
    r, = project_performance(site_star, project_id=1, as_of=_dt.date(2024, 1, 1)).collect()
    assert (r.planned_duration_days, r.elapsed_days, r.total_actual, r.total_budgeted) == (300, 301, 291000.0, 240000.0)
    assert (r.category_cpi, r.budget_status, r.pct_of_total_spend) == (0.825, "Over Budget", 100.0)
    assert project_performance(site_star, project_id=4, as_of=_dt.date(2024, 1, 1)).count() == 0


def test_ids_reach_the_fact_before_it_is_summed(spark, site_star, tmp_path):
    """F8: a list becomes a pushed filter, a small frame a broadcast semi join below the aggregate."""
    from keystone.plans import features as M
    from keystone.sources import warehouse as W

    root = str(tmp_path / "wh")
    W.init_warehouse(spark, root)
    for t, df in site_star.items():
        if t != "dim_dates":
            W.append(df, root, t)
    star = W.load_warehouse(spark, root)
    whole = {r.equipment_id: r for r in M.maintenance_scoring_features(star).collect()}
    costs = {r.project_id: r for r in M.project_scoring_features(star).collect()}
    for ids in ([2], spark.createDataFrame([(2,), (2,)], "id long")):
        machine, project = M.maintenance_scoring_features(star, ids=ids), M.project_scoring_features(star, ids=ids)
        assert machine.collect() == [whole[2]] and project.collect() == [costs[2]]
        for df, column in ((machine, "hours_used"), (project, "budgeted_amount")):
            plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            scan = next(line for line in plan.splitlines() if "FileScan" in line and column in line)
            assert "EqualTo(" in scan if isinstance(ids, list) else "BroadcastHashJoin" in plan and "LeftSemi" in plan, plan
    none = M.only_ids(star["dim_projects"], "id", [])
    assert none.count() == 0 and M.only_ids(star["dim_projects"], "id", None).count() == len(costs)


def test_snapshots_read_usage_once_and_keep_both_histories_of_an_id(spark, site_star, tmp_path):
    from pyspark.sql import functions as F

    site_star["fact_equipment_usage"].write.parquet(str(tmp_path / "usage-once"))
    e = site_star["dim_equipment"]
    again = e.where("id = 1").withColumn("purchase_date", F.date_sub("purchase_date", 10))
    star = site_star | {"fact_equipment_usage": spark.read.parquet(str(tmp_path / "usage-once")),
                        "dim_equipment": e.unionByName(again).unionByName(e.where("id = 2"))}
    found = FE.maintenance_snapshots(star)
    assert found._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 1
    plain = sorted(map(tuple, FE.maintenance_snapshots(site_star).collect()))
    age = found.columns.index("age_days")
    older = [r for r in map(tuple, found.collect()) if r not in plain]
    assert sorted(r for r in map(tuple, found.collect()) if r in plain) == plain
    assert sorted((r[1], r[age]) for r in older) == sorted((r[1], r[age] + 10) for r in plain if r[0] == 1)


def test_ids_beyond_the_broadcast_bound_sort_no_fact(spark, site_star, monkeypatch):
    want = sorted(map(str, FE.project_scoring_features(site_star, site_star["dim_projects"].select("id")).collect()))
    monkeypatch.setattr(FE, "BROADCAST_IDS", 3)
    found = FE.project_scoring_features(site_star, site_star["dim_projects"].select("id"))
    assert sorted(map(str, found.collect())) == want
    kept = FE.only_ids(site_star["fact_project_costs"], "project_id", site_star["dim_projects"].select("id"))
    assert "SortMergeJoin" not in kept._jdf.queryExecution().sparkPlan().toString()


def test_sums_of_larger_tables_are_dealt_by_size(spark, site_star, tmp_path, monkeypatch):
    """A task's share of costs, daily sums and cutoffs must not follow the input."""
    import re

    from keystone import session
    from keystone.plans import features as FE

    site_star["fact_project_costs"].write.parquet(str(tmp_path / "costs"))
    star = site_star | {"fact_project_costs": spark.read.parquet(str(tmp_path / "costs"))}
    small = sorted(map(str, FE.project_scoring_features(star).collect()))
    assert session.partitions_for(site_star["fact_project_costs"]) == session.partitions_for(star["fact_project_costs"]) == 4
    monkeypatch.setattr(session, "PARTITION_BYTES", -(-session.input_bytes(star["fact_project_costs"]) // 9))
    for few in (FE.BROADCAST_IDS, 2):
        monkeypatch.setattr(FE, "BROADCAST_IDS", few)
        got = FE.project_scoring_features(star, star["dim_projects"].select("id"))
        assert sorted(map(str, got.collect())) == small
        plan = got._jdf.queryExecution().sparkPlan().toString() + got._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"hashpartitioning\(project_id#\d+L?(, date_id#\d+)?, 9\)", plan) and re.search(r"hashpartitioning\(pid#\d+L?, 9\)", plan)
