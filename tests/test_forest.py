"""The forest that is grown from counts of binned rows: against plain loops, and against Spark's."""

from __future__ import annotations

import datetime as _dt

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from keystone.plans import forest as FO
from keystone.plans import models as MD
from keystone.plans.metrics import binary_metrics

AS_OF = _dt.date(2023, 7, 1)


@pytest.fixture(scope="module")
def rows(spark):
    """1200 rows, two features that tell the class with a tenth of it wrong."""
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000.0                       # noqa: E731
    return spark.range(1200).select("id", F.round(u(1), 3).alias("a"), F.floor(u(2) * 5).cast("double").alias("b"), u(3).alias("e")) \
        .select("id", "a", "b", F.when((F.col("e") < 0.1) != ((F.col("a") > 0.6) & (F.col("b") >= 2)), 1).otherwise(0).cast("long").alias("y")).cache()


@pytest.fixture(scope="module")
def weights(rows):
    return MD.class_weights({r[0]: r[1] for r in rows.groupBy("y").count().collect()})


def _plain(x, y, times, cuts, w, depth, least):
    """A tree by plain loops: (feature, cut) and children, or the rows of a leaf by class."""
    count = tuple(int(times[y == k].sum()) for k in (0, 1))
    gini = lambda c: 1 - sum((n * v / sum(m * u for m, u in zip(c, w))) ** 2 for n, v in zip(c, w)) if sum(c) else 1.0       # noqa: E731
    heavy = lambda c: sum(n * v for n, v in zip(c, w))                                            # noqa: E731
    best = (1e-12, None)
    if depth and min(count):
        for f, ends in enumerate(cuts):
            for end in ends:
                left = x[:, f] <= end
                sides = [tuple(int(times[s & (y == k)].sum()) for k in (0, 1)) for s in (left, ~left)]
                if min(map(sum, sides)) >= least:
                    gain = gini(count) - sum(heavy(s) / heavy(count) * gini(s) for s in sides)
                    if gain > best[0] + 1e-12:
                        best = (gain, (f, end, left))
    if best[1] is None:
        return count
    f, end, left = best[1]
    sides = [_plain(x[s], y[s], times[s], cuts, w, depth - 1, least) for s in (left, ~left)]
    return (f, end, count, *sides)


def _nested(t, cuts, i=0):
    if t.cut[i] == FO.LEAF:
        return tuple(t.rows[i].tolist())
    c = t.child[i]
    return (int(t.feature[i]), cuts[t.feature[i]][(t.cut[i] - 1) // 2], tuple(t.rows[i].tolist()), _nested(t, cuts, c), _nested(t, cuts, c + 1))


def test_trees_are_those_of_plain_loops(rows, weights, monkeypatch):
    """Two features are both tried at each node; a row's bootstrap count is that of its block's seed."""
    monkeypatch.setattr(FO, "_pruned", lambda t, w: t)
    monkeypatch.setattr(FO, "BLOCK_ROWS", 500)
    got = FO.fit(rows, "y", ["a", "b"], ["id"], weights, 3, 4, 5, 1, 42)
    ordered = rows.orderBy("id").toPandas()
    x, y = ordered[["a", "b"]].to_numpy(), ordered["y"].to_numpy()
    for t, tree in enumerate(got.trees):
        times = np.concatenate([FO.POISSON[np.random.Generator(np.random.SFC64([42, t, k, 0])).integers(0, 1 << 16, 400, np.uint16)] for k in range(3)])
        assert _nested(tree, got.cuts) == _plain(x, y, times, got.cuts, got.weights, 4, 5)


def test_bootstrap_counts_are_poisson():
    shares = np.bincount(FO.POISSON) / len(FO.POISSON)
    assert abs((shares * np.arange(len(shares))).mean() * len(shares) - 1) < 1e-3
    assert abs(shares[0] - np.exp(-1)) < 1e-4 and abs(shares[3] - np.exp(-1) / 6) < 1e-4


def test_bins_lie_between_few_values_or_weighted_quantiles(spark):
    df = spark.range(8000).select((F.col("id") % 3).cast("double").alias("few"), (F.col("id") / 8000.0).alias("many"), F.lit(7.0).alias("one"),
                                  (F.col("id") >= 6000).cast("long").alias("y"))
    few, many, one = FO.bin_ends(df.repartition(3), "y", ["few", "many", "one"], (8000 / 12000, 8000 / 4000))
    assert few.tolist() == [0.5, 1.5] and one.tolist() == [] and len(many) == 31
    share = [v / 0.75 / 2 if v < 0.75 else 0.5 + (v - 0.75) * 2 for v in many]          # classes weigh the same
    assert max(abs(s - (k + 1) / 32) for k, s in enumerate(share)) < 0.01


def test_bins_do_not_depend_on_the_partitions_that_rows_come_from(spark):
    """With more rows than a partition tells values of."""
    df = spark.range(60_000).select("id", (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / 7.0).alias("x"), F.when(F.xxhash64("id", F.lit(1)) % 9 == 0, 1).otherwise(0).cast("long").alias("y"))
    given, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in (2, 9):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            seen.append(FO.bin_ends(FO.dealt(df.repartition(parts), "y", ["x"], ["id"], 3), "y", ["x"], (0.6, 4.5))[0].tolist())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", given)
    assert seen[0] == seen[1] and len(seen[0]) == 31


def test_as_good_as_sparks_forest(rows, weights):
    train, test = rows.where("id % 4 > 0"), rows.where("id % 4 = 0")
    own = FO.fit(train, "y", ["a", "b"], ["id"], weights, 30, 5, 3, 2, 42)
    x = MD._assemble(train.withColumn("weight", F.when(F.col("y") == 1, weights[1]).otherwise(weights[0])), ["a", "b"])
    spark_s = RandomForestClassifier(labelCol="y", weightCol="weight", numTrees=30, maxDepth=5, minInstancesPerNode=3, seed=42, featureSubsetStrategy="sqrt").fit(x)
    for part in (train, test):
        a = binary_metrics(own.score(part, ["a", "b"]), "y").first()
        b = binary_metrics(MD._scored(spark_s, MD._assemble(part, ["a", "b"])), "y").first()
        assert a.n == b.n and abs(a.accuracy - b.accuracy) < 0.02 and abs(a.roc_auc - b.roc_auc) < 0.02
    assert np.abs(own.featureImportances.toArray() - spark_s.featureImportances.toArray()).max() < 0.05
    assert 0.8 < sum(len(t.cut) for t in own.trees) / spark_s.totalNumNodes < 1.25       # leaves of one prediction are merged in both


def test_scores_are_mean_shares_of_class_1_and_ties_are_class_0(spark):
    leaf = FO.Tree.leaves(np.array([[2, 2]]))
    split = FO.Tree(np.array([0, 0, 0], np.int16), np.array([1, FO.LEAF, FO.LEAF], np.uint8), np.array([1, 1, 2]), np.array([0.2, 0, 0]),
                    np.array([[3, 2], [3, 1], [0, 1]]))
    f = FO.Forest([leaf, split], [np.array([0.5])], (1.0, 1.0))
    df = spark.createDataFrame([(1, 0.5, "x"), (2, 0.6, None)], "id long, a double, s string")
    assert [tuple(r) for r in f.score(df, ["a"]).orderBy("id").collect()] == [(1, 0.5, "x", 0.375, 0), (2, 0.6, None, 0.75, 1)]
    assert FO.Forest([leaf], [np.array([0.5])], (1.0, 1.0)).score(df, ["a"]).where("score = 0.5 and prediction = 0").count() == 2
    assert f.featureImportances.toArray().tolist() == [1.0]


def test_messages_of_few_nodes_and_shuffle_partitions_leave_the_forest_as_it_is(spark, rows, weights, monkeypatch):
    given, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts, nodes in (("2", 128), ("9", 3)):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            monkeypatch.setattr(FO, "NODES", nodes)
            f = FO.fit(rows.repartition(int(parts)), "y", ["a", "b"], ["id"], weights, 4, 5, 2, 3, 42)
            seen.append([_nested(t, f.cuts) for t in f.trees])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", given)
    assert seen[0] == seen[1]


def test_models_of_many_rows_are_grown_so(spark, site_star, monkeypatch, tmp_path):
    """Beyond ``SPARK_ROWS`` training rows; all parts of the model are made, stored and read as ever."""
    monkeypatch.setattr(MD, "SPARK_ROWS", 0)
    a = MD.train_equipment_maintenance_model(site_star, num_trees=6)
    assert isinstance(a.model, FO.Forest) and a.model.getNumTrees == 6
    values = [r.importance for r in a.feature_importance.collect()]
    assert values == sorted(values, reverse=True) and abs(sum(values) - 1) < 1e-3
    assert a.train_metrics.first().n + a.test_metrics.first().n == a.balance.first().samples
    MD.save_artifact(a, str(tmp_path / "fleet"))
    b = MD.load_artifact(spark, str(tmp_path / "fleet"))
    assert isinstance(b.model, FO.Forest) and b.model.weights == a.model.weights
    one, two = (sorted(map(str, MD.score_equipment(site_star, m, AS_OF).collect())) for m in (a, b))
    assert one == two and len(one) == site_star["dim_equipment"].count()
    monkeypatch.setattr(MD, "SPARK_ROWS", 10_000)
    assert not isinstance(MD.train_equipment_maintenance_model(site_star, num_trees=2).model, FO.Forest)
