"""Warehouse round trip on Parquet under a private folder."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from keystone.sources import commits
from keystone.sources import warehouse as W
from keystone.sources.schema import FACTS, TABLES


def test_round_trip(spark, site_star, tmp_path):
    root = str(tmp_path / "wh")
    W.init_warehouse(spark, root)                                     # S4
    star = W.load_warehouse(spark, root)
    assert set(star) == set(TABLES) and all(star[t].count() == 0 for t in TABLES)
    W.append(site_star["fact_project_costs"], root, "fact_project_costs")   # S5
    W.append(site_star["dim_projects"], root, "dim_projects")
    star = W.load_warehouse(spark, root)
    assert star["fact_project_costs"].count() == 161
    summary = {r.table_name: r.row_count for r in W.load_summary(star).collect()}   # S10
    assert summary["dim_projects"] == 16 and summary["fact_project_costs"] == 161
    W.save_star({"dim_projects": site_star["dim_projects"].limit(1)}, root, mode="ignore",
                tables=["dim_projects"])                              # S7: kept as is
    assert W.load_warehouse(spark, root)["dim_projects"].count() == 16
    W.clear_facts(spark, root)                                        # S6
    star = W.load_warehouse(spark, root)
    assert all(star[t].count() == 0 for t in FACTS) and star["dim_projects"].count() == 16


def test_run_sql_and_preview(spark, site_star):
    out = W.run_sql(spark, "SELECT id FROM {p} WHERE contract_value > :v",      # S1
                    {"v": 300000.0}, p=site_star["dim_projects"])
    assert sorted(r.id for r in out.collect()) == [1, 3]
    top = W.preview(site_star["dim_projects"], 3, [F.col("id").desc()]).collect()   # S11
    assert [r.id for r in top] == [32, 31, 30]


def test_missing_tables_and_other_types(spark, site_star, tmp_path):
    root = str(tmp_path / "half")
    W.append(site_star["dim_projects"], root, "dim_projects")
    with pytest.raises(FileNotFoundError):
        W.load_warehouse(spark, root)
    costs = site_star["fact_project_costs"]
    floats = costs.withColumn("amount", F.col("amount").cast("double"))
    assert W.declared(floats, "fact_project_costs").schema["amount"].dataType == costs.schema["amount"].dataType
    with pytest.raises(ValueError):
        W.declared(costs.drop("amount"), "fact_project_costs")


def counts(spark, root):
    return {r.table_name: r.row_count for r in W.load_summary(W.load_warehouse(spark, root)).collect()}


def test_a_retried_batch_adds_nothing(spark, site_star, tmp_path):
    root = str(tmp_path / "wh")
    W.init_warehouse(spark, root)
    costs = site_star["fact_project_costs"]
    assert W.append(costs, root, "fact_project_costs", batch="b1")
    assert not W.append(costs, root, "fact_project_costs", batch="b1")
    assert W.append(costs, root, "fact_project_costs", batch="b2")
    assert counts(spark, root)["fact_project_costs"] == 322


def test_a_write_that_fails_midway_changes_nothing(spark, site_star, tmp_path):
    root = str(tmp_path / "wh")
    W.init_warehouse(spark, root)
    W.save_star(site_star, root, "append", ["dim_projects", "fact_project_costs"])
    before = counts(spark, root)
    bad = site_star["fact_project_costs"].withColumn("amount", F.raise_error(F.lit("lost")).cast("decimal(18,4)"))
    with pytest.raises(Exception, match="lost"):        # projects are written before the costs fail
        W.save_star({"dim_projects": site_star["dim_projects"], "fact_project_costs": bad}, root, "append", ["dim_projects", "fact_project_costs"])
    assert counts(spark, root) == before

    def dies(state):
        state["tables"].update({t: [] for t in FACTS})
        raise RuntimeError("the driver is gone")
    with pytest.raises(RuntimeError):                   # a truncate that dies before it is published
        commits.commit(spark, root, dies)
    assert counts(spark, root) == before
    with pytest.raises(ValueError):
        W.save_star(site_star, root, "upsert", ["dim_projects"])


def test_writers_that_meet_both_count(spark, site_star, tmp_path):
    """Each tries to take the same number; the one that loses goes on from the other's state."""
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path / "wh")
    W.init_warehouse(spark, root)
    with ThreadPoolExecutor(6) as pool:
        done = list(pool.map(lambda i: W.append(site_star["dim_projects"], root, "dim_projects", batch=f"b{i % 5}"), range(6)))
    assert sum(done) == 5 and counts(spark, root)["dim_projects"] == 80


def test_counts_read_no_column(spark, site_star, tmp_path):
    root = str(tmp_path / "wh")
    W.init_warehouse(spark, root)
    W.save_star(site_star, root, "append", ["dim_projects", "fact_project_costs"])
    plan = W.load_summary(W.load_warehouse(spark, root))._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) == 2 and all("ReadSchema: struct<>" in line for line in scans)


def test_load_if_absent_and_overwrite(spark, site_star, tmp_path):
    root = str(tmp_path / "wh")
    one = {"dim_projects": site_star["dim_projects"].limit(1)}
    assert W.save_star(site_star, root, "ignore", ["dim_projects"])
    W.save_star(one, root, "ignore", ["dim_projects"])
    W.init_warehouse(spark, root)
    assert counts(spark, root)["dim_projects"] == 16
    W.save_star(one, root, "overwrite", ["dim_projects"])
    assert counts(spark, root)["dim_projects"] == 1


def test_lines_meet_many_orders_without_a_sort(spark, tmp_path, monkeypatch):
    import datetime as dt

    from keystone.sources import star as S

    orders = [(k, k % 3, dt.datetime(1998, 1, 1)) for k in range(20)]
    lines = [(k % 25, 1, 1 + k % 7, 5.0, 100.0, 0.01, dt.datetime(1998, 2, 1), "R", 3) for k in range(90)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_tax double, "
                                 "l_shipdate timestamp, l_returnflag string, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    small = S.load_star(spark, str(tmp_path))["fact_project_costs"]
    monkeypatch.setattr(S, "HASH_JOIN_BYTES", 0)
    large = S.load_star(spark, str(tmp_path))["fact_project_costs"]
    assert "ShuffledHashJoin" in large._jdf.queryExecution().sparkPlan().toString()
    assert sorted(map(str, large.collect())) == sorted(map(str, small.collect())) and large.count()
