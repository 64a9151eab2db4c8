"""E1-E18 helpers: rounding, exact sums, safe ratios, labels."""

from __future__ import annotations

import random
from decimal import Decimal

from pyspark.sql import functions as F

from keystone.functions import exprs as X


def test_rnd_half_away_from_zero(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (1.005,), (0.125,), (None,)], "x double")
    got = [r[0] for r in df.select(X.rnd("x", 0)).collect()][:2]
    assert got == [3.0, -3.0]
    r2 = [r[0] for r in df.select(X.rnd("x", 2)).collect()]
    assert r2[3] == 0.13 and r2[4] is None


def test_dec_sum_equals_sum(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 20), None if rnd.random() < 0.1 else
             Decimal(rnd.randint(-10 ** 12, 10 ** 12)) / Decimal(10 ** 4)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k int, v decimal(18,4)")
    a = {r.k: r.s for r in df.groupBy("k").agg(F.sum("v").alias("s")).collect()}
    b = {r.k: r.s for r in df.groupBy("k").agg(X.dec_sum("v", 4).alias("s")).collect()}
    assert a == b
    empty = df.where("k < 0").agg(X.dec_sum("v", 4).alias("s")).first().s
    assert empty is None


def test_safe_div_and_ratio(spark):
    df = spark.createDataFrame([(1.0, 0.0), (3.0, 2.0), (None, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(X.safe_div("a", "b")).collect()] == [None, 1.5, None]
    assert [r[0] for r in df.select(X.ratio_or("a", "b", 1.0)).collect()] == [1.0, 1.5, None]


def test_labels(spark):
    df = spark.createDataFrame([(1234567.0,), (-12345.0,), (7.4,), (None,)], "x double")
    assert [r[0] for r in df.select(X.money_label("x")).collect()] == ["$1.2M", "$-12K", "$7", "—"]
    t = spark.createDataFrame([("ON_HOLD",), ("ACTIVE",)], "s string")
    assert [r[0] for r in t.select(X.title_case("s")).collect()] == ["On Hold", "Active"]
    c = spark.createDataFrame([(12.0,), (-1.0,)], "x double")
    assert [r[0] for r in c.select(X.clamp("x", 0.0, 10.0)).collect()] == [10.0, 0.0]
