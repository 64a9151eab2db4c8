"""Training, scoring and persistence on the small star (few trees for speed)."""

from __future__ import annotations

import datetime as _dt
import math
import os

import pytest
from pyspark.sql import functions as F

from keystone.plans import models as MD

AS_OF = _dt.date(2023, 7, 1)


@pytest.fixture(scope="module")
def cost(site_star):
    return MD.train_cost_overrun_model(site_star, num_trees=8)


@pytest.fixture(scope="module")
def fleet(site_star):
    return MD.train_equipment_maintenance_model(site_star, num_trees=8)


def test_scores_tell_overruns_apart(site_star, cost):
    p = {r.project_id: r.overrun_probability for r in MD.score_projects(site_star, cost).collect()}
    assert min(p[i] for i in range(21, 33, 2)) > max(p[i] for i in range(22, 33, 2))
    assert all(0 <= x <= 1 for x in p.values())


def test_training_again_gives_the_same_scores(site_star, cost):
    again = MD.train_cost_overrun_model(site_star, num_trees=8)
    a, b = (sorted((r.project_id, r.overrun_probability) for r in MD.score_projects(site_star, m).collect()) for m in (cost, again))
    assert a == b


def test_metrics_importances_and_balance(cost, fleet):
    for m in (cost, fleet):
        values = [r.importance for r in m.feature_importance.collect()]
        assert values == sorted(values, reverse=True) and abs(sum(values) - 1) < 1e-3 and min(values) >= 0
        names = [r.metric for r in m.metrics().collect()]
        assert names == ["accuracy", "precision", "recall", "f1", "roc_auc"]
    b = cost.balance.first()
    assert (b.samples, b.positives) == (14, 7)


def test_unknown_ids_and_empty_training_sets_raise(site_star, cost, fleet):
    assert MD.predict_project(site_star, cost, 3).first().project_name == "Quay Bridge"
    assert MD.predict_machine(site_star, fleet, 4, AS_OF).first().equipment_name == "CR-4"
    for call in (lambda: MD.predict_project(site_star, cost, 999), lambda: MD.predict_machine(site_star, fleet, 999, AS_OF),
                 lambda: MD.train_cost_overrun_model(site_star | {"dim_projects": site_star["dim_projects"].where("id < 0")}),
                 lambda: MD.train_equipment_maintenance_model(site_star | {"dim_equipment": site_star["dim_equipment"].where("id < 0")})):
        with pytest.raises(ValueError):
            call()


def test_stored_models(spark, site_star, cost, tmp_path):
    path = str(tmp_path / "cost")
    with pytest.raises(FileNotFoundError):
        MD.load_artifact(spark, path)
    MD.save_artifact(cost, path)
    got = MD.load_artifact(spark, path)
    assert got.features == cost.features and got.category == "project_type"
    assert sorted(map(tuple, got.labels.collect())) == [("COMMERCIAL", 0), ("RESIDENTIAL", 1)]
    a, b = (sorted((r.project_id, r.overrun_probability) for r in MD.score_projects(site_star, m).collect()) for m in (cost, got))
    assert a == b
    (version,) = os.listdir(os.path.join(path, "versions"))
    for f in os.listdir(os.path.join(path, "versions", version, "meta")):            # a damaged model isn't a missing one
        if f.endswith(".parquet"):
            open(os.path.join(path, "versions", version, "meta", f), "wb").close()
    with pytest.raises(Exception) as e:
        MD.load_artifact(spark, path)
    assert not isinstance(e.value, FileNotFoundError)


def test_advice_days_and_bands_follow_the_probability(site_star, fleet, cost):
    for r in MD.score_equipment(site_star, fleet, AS_OF).collect():
        p, days = r.maintenance_probability, r.predicted_days_until_maintenance
        assert days == max(1, math.trunc(30 * (1 - p))) or abs(30 * (1 - p) - round(30 * (1 - p))) < 0.01
        word = "High" if p >= 0.7 else "Moderate" if p >= 0.4 else "Low"
        assert r.recommendation.startswith(f"{word} maintenance probability (") and f"{days} days" in r.recommendation
        assert "{" not in r.recommendation
    for r in MD.fleet_risk(site_star, fleet, AS_OF).collect():
        p, d = r.maintenance_probability, r.est_days
        assert r.risk == ("Critical" if p > 0.7 or d < 7 else "Watch" if p >= 0.5 or d <= 14 else "Routine")
    bands = site_star["dim_projects"].limit(1).select(*[MD.days_band(F.lit(d)).alias(f"d{d}") for d in (6, 7, 14, 15)]).first()
    assert tuple(bands) == ("bad", "warning", "warning", "good")


def test_risk_figures_hold_all_and_each_band(site_star, cost):
    risk = MD.portfolio_risk(site_star, cost)
    assert [r.project_id for r in risk.collect()] == [3]         # running and with costs
    rows = MD.risk_kpis(risk, "risk_level", "overrun_probability").collect()
    assert rows[0].risk_level == "All" and rows[0]["count"] == 1 and sum(r["count"] for r in rows[1:]) == 1


def test_split_takes_the_lowest_hashes_of_each_class(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7 == 0).cast("int").alias("y"))
    rows = MD.stratified_split(df, "y", ["id"]).withColumn("h", F.xxhash64("id", F.lit(42))).collect()
    for y in (0, 1):
        mine = sorted((r.h, r.is_test) for r in rows if r.y == y)
        quota = math.floor(0.25 * len(mine) + 0.5)
        assert [t for _, t in mine] == [True] * quota + [False] * (len(mine) - quota)


def test_codes_of_labels(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "t string")
    labels = MD.fit_label_encoder(df.where("t <> 'c' or t is null"), "t")
    got = {r.t: r.code for r in MD.encode(df, "t", labels, "code").collect()}
    assert got == {"a": 0, "b": 1, "c": 0, None: 0}


def test_both_sets_are_scored_side_by_side_in_as_many_partitions(site_star, monkeypatch):
    import threading

    meet, parts, real = threading.Barrier(2, timeout=60), [], MD.binary_metrics

    def together(rows, label):
        meet.wait()                      # breaks unless the other set's metrics are on their way
        parts.append(rows.rdd.getNumPartitions())
        return real(rows, label)

    monkeypatch.setattr(MD, "binary_metrics", together)
    monkeypatch.setattr(MD, "training_partitions", lambda rows: 3)
    trained = MD.train_cost_overrun_model(site_star, num_trees=3)
    assert parts == [3, 3]
    train, test = trained.train_metrics.first(), trained.test_metrics.first()
    assert train.n + test.n == 14 and 0 < test.n < train.n


def test_parts_of_a_model_are_stored_side_by_side(spark, cost, tmp_path, monkeypatch):
    """And node ids of rows times trees are never written out while it is trained; nothing is published if a part fails."""
    import threading

    from pyspark.sql.readwriter import DataFrameWriter

    meet, real, path = threading.Barrier(6, timeout=60), DataFrameWriter.parquet, str(tmp_path / "cost")
    assert cost.model.getCacheNodeIds() and cost.model.getCheckpointInterval() == -1

    def together(self, to, *a, **b):
        meet.wait()                      # breaks unless all six tables are on their way
        return real(self, to, *a, **b)

    def broken(self, to, *a, **b):
        if to.endswith("labels"):
            raise OSError("full")
        return real(self, to, *a, **b)

    monkeypatch.setattr(DataFrameWriter, "parquet", broken)
    with pytest.raises(OSError):
        MD.save_artifact(cost, path)
    with pytest.raises(FileNotFoundError):
        MD.load_artifact(spark, path)
    monkeypatch.setattr(DataFrameWriter, "parquet", together)
    MD.save_artifact(cost, path)
    monkeypatch.undo()
    assert MD.load_artifact(spark, path).feature_importance.collect() == cost.feature_importance.collect()


def test_two_writers_of_a_model(spark, site_star, cost, tmp_path):
    """Versions never mix: a reader has the one or the other, whole; an opened one stays readable."""
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "cost")
    MD.save_artifact(cost, path)
    opened = MD.load_artifact(spark, path)
    other = MD.train_cost_overrun_model(site_star, num_trees=3)
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda a: MD.save_artifact(a, path), (cost, other)))
    got = MD.load_artifact(spark, path)
    assert got.model.getNumTrees in (3, 8)
    same = cost if got.model.getNumTrees == 8 else other
    assert got.feature_importance.collect() == same.feature_importance.collect()
    assert opened.model.getNumTrees == 8 and opened.labels.count() == 2


def test_split_takes_the_least_hashes_of_each_class(spark):
    df = spark.range(3000).select("id", (F.col("id") % 7 == 0).cast("long").alias("y"))
    got = MD.stratified_split(df, "y", ["id"], 0.25, seed=5)
    hashed = [(r.y, r.h, r.is_test) for r in got.select("y", "is_test", F.xxhash64("id", F.lit(5)).alias("h")).collect()]
    for y in (0, 1):
        rows = sorted((h, t) for c, h, t in hashed if c == y)
        quota = math.floor(0.25 * len(rows) + 0.5)
        assert [t for _, t in rows] == [True] * quota + [False] * (len(rows) - quota)
    tiny = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1)], "id long, y long")
    assert MD.stratified_split(tiny, "y", ["id"]).where("is_test").count() == 1
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan


def test_the_same_forest_for_any_number_of_shuffle_partitions(spark, site_star):
    given = spark.conf.get("spark.sql.shuffle.partitions")
    scores = []
    try:
        for n in ("2", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            model = MD.train_equipment_maintenance_model(site_star, num_trees=5)
            scores.append(sorted((r.equipment_id, r.maintenance_probability) for r in MD.score_equipment(site_star, model, AS_OF).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", given)
    assert scores[0] == scores[1]


def test_rule_scores_missing_features_as_zero(spark):
    """F9 before scoring, ties to class 0, and the share of rows with a value."""
    rows = spark.createDataFrame([(1, None, 2.0), (2, float("nan"), 0.0), (3, float("inf"), 1.0), (4, 0.5, None), (5, 0.75, 3.0)], "id long, x double, y double")
    rule = MD.Rule(F.col("x"), None, ["x", "y"])
    got = {r.id: (r.score, r.prediction, r.y) for r in rule.score(rows).collect()}
    assert got == {1: (0.0, 0, 2.0), 2: (0.0, 0, 0.0), 3: (0.0, 0, 1.0), 4: (0.5, 0, 0.0), 5: (0.75, 1, 3.0)}
    assert {r.feature: r.importance for r in MD.feature_coverage(rows, ["x", "y"]).collect()} == {"x": 0.4, "y": 0.6}
    assert {r.importance for r in MD.feature_coverage(rows.limit(0), ["x", "y"]).collect()} == {None}


def test_rule_and_forest_share_populations(site_star, cost):
    """M15 lists the same projects in the same order, whoever scores."""
    rule = MD.Rule(F.lit(0.9), cost.labels, cost.features)
    a, b = ([r.project_id for r in MD.portfolio_risk(site_star, m).collect()] for m in (cost, rule))
    assert a == b


def test_training_rows_lie_in_bounded_partitions():
    """Each partition sends the sums of all open nodes, so their number must not follow the rows at 20 000 each."""
    assert [MD.training_partitions(n) for n in (0, 1, 20_000, 20_001, 1_077_776, 6_500_000)] == [1, 1, 1, 2, 12, 22]


def test_split_computes_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(400).select("id", (F.col("id") % 3 == 0).cast("int").alias("y")).mapInArrow(look, "id long, y int")
    assert MD.stratified_split(df, "y", ["id"]).where("is_test").count() == 101          # 34 of 134 and 67 of 266
    assert seen.value == 400


def test_portfolio_reads_costs_once(spark, site_star, tmp_path):
    site_star["fact_project_costs"].write.parquet(str(tmp_path / "costs-once"))
    star = site_star | {"fact_project_costs": spark.read.parquet(str(tmp_path / "costs-once"))}
    rule = MD.Rule(F.lit(0.9), MD.fit_label_encoder(star["dim_projects"], "project_type"), MD.FE.COST_FEATURES)
    risk = MD.portfolio_risk(star, rule)
    assert [r.project_id for r in risk.collect()] == [3]
    assert risk._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 1
