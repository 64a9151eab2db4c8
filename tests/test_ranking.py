"""Distributed ranks and neighbours equal Spark's windows for every type, direction and part."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from keystone.functions.exprs import dec_sum, rnd
from keystone.operators.ranking import Ordering, with_first_flag, with_orderings

VALUES = {
    "double": lambda r: float(r.randint(0, 40)),
    "long": lambda r: 2**62 + r.randint(0, 60),
    "decimal(20,4)": lambda r: Decimal(r.randint(0, 10**6)).scaleb(-4) + 10**15,
    "string": lambda r: "k" * r.randint(1, 3) + str(r.randint(0, 20)),
}


@pytest.fixture(scope="module", params=sorted(VALUES))
def frame(spark, request):
    r = random.Random(7)
    make = VALUES[request.param]
    hot = make(r)                                                # one value holds a fifth of the rows
    rows = [(i, r.choice(["A", "B", None]), hot if i % 5 == 0 else None if r.random() < 0.08 else make(r)) for i in range(400)]
    return spark.createDataFrame(rows, f"id long, g string, v {request.param}")


@pytest.mark.parametrize("desc", [True, False])
@pytest.mark.parametrize("parts", [[], ["g"]])
def test_orderings_equal_windows(frame, desc, parts):
    got = with_orderings(frame, Ordering("v", parts=parts, descending=desc, tie="id", rank="r", lead="ld", lag="lg", buckets=5))
    k = F.col("v").desc() if desc else F.col("v").asc()
    w, wt = Window.partitionBy(*parts).orderBy(k), Window.partitionBy(*parts).orderBy(k, "id")
    want = frame.select("id", F.rank().over(w).alias("r"), F.lead("v").over(wt).alias("ld"), F.lag("v").over(wt).alias("lg"))
    assert sorted(map(tuple, got.select("id", "r", "ld", "lg").collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


@pytest.mark.parametrize("desc", [True, False])
def test_first_flag_equals_row_number(frame, desc):
    got = with_first_flag(frame, "v", "id", "top", parts=["g"], descending=desc)
    k = F.col("v").desc() if desc else F.col("v").asc()
    want = frame.select("id", (F.row_number().over(Window.partitionBy("g").orderBy(k, "id")) == 1).alias("top"))
    assert sorted(map(tuple, got.select("id", "top").collect())) == sorted(map(tuple, want.collect()))


def test_sums_are_exact_at_any_size_and_partitioning(spark):
    big = spark.createDataFrame([(Decimal("100000000000000.0001"),)] * 20, "x decimal(20,4)").repartition(3)
    assert big.agg(dec_sum("x", 4).alias("s")).first().s == Decimal("2000000000000000.0020")
    cents = spark.createDataFrame([(x,) for x in (0.57, 0.29, 1.15, 2.3, 4.35)], "x double")
    for n in (1, 4):
        assert cents.repartition(n).agg(dec_sum("x", 2).alias("s")).first().s == Decimal("8.66")


def test_rounding_beyond_the_digits_of_a_double(spark):
    r = spark.range(1).select(rnd(F.lit(1e17), 2).alias("a"), rnd(F.lit(-2e15), 4).alias("b"), rnd(F.lit(2.345), 2).alias("c"),
                              rnd(F.lit(-0.5), 0).alias("d"), rnd(F.lit(None).cast("double"), 2).alias("e")).first()
    assert tuple(r) == (1e17, -2e15, 2.35, -1.0, None)


def test_ranked_reports_run_no_job_while_they_are_built(spark):
    """And read the facts once: the entity frame is one shared exchange."""
    import datetime as dt

    from keystone_paths import SMALL

    from keystone.operators.budget import budget_variance
    from keystone.operators.equipment import equipment_utilization
    from keystone.operators.subcontractors import subcontractor_scorecard
    from keystone.sources.star import load_star

    star = load_star(spark, SMALL)
    context = spark.sparkContext
    context.setJobGroup("ranked-reports", "none may run")
    try:
        reports = [budget_variance(star), subcontractor_scorecard(star),
                   equipment_utilization(star, dt.date(1998, 1, 5), dt.date(1998, 1, 9))]
        assert not context.statusTracker().getJobIdsForGroup("ranked-reports")
    finally:
        context.setJobGroup("after", "")
    for report in reports:
        report.collect()
        plan = report._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "ReusedExchange" in plan
    no_ranks = budget_variance(star, ranks=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in no_ranks and "percentile" not in no_ranks
