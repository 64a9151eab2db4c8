"""The deterministic project structure, as set-based Spark jobs.

Windows, phases, weekly spines, budget allocation and inspection dates are
computed for real project rows. Spines are unfolded after the joins: their planner
size estimate does not include the explode fan-out, so they are no join's side.
"""

from __future__ import annotations

import datetime as _dt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystone.functions.exprs import rnd

AS_OF = _dt.date(2026, 2, 17)
DATA_END = _dt.date(2026, 12, 31)


class Phase(NamedTuple):
    name: str
    begins: float
    ends: float
    cost_weight: float


# Construction phases (progress bounds, cost weight) and cost category splits.
PHASES = [Phase("foundation", 0.00, 0.20, 0.15), Phase("framing", 0.20, 0.45, 0.22),
          Phase("systems", 0.45, 0.75, 0.38), Phase("finishing", 0.75, 1.00, 0.25)]
CATEGORY_SPLITS = [("LABOR", 0.35), ("MATERIALS", 0.28), ("EQUIPMENT", 0.12),
                   ("SUBCONTRACTOR", 0.20), ("OTHER", 0.05)]


# ---------------------------------------------------------------------------
# N3-N6 deterministic project structure
# ---------------------------------------------------------------------------
def project_windows(projects: DataFrame, as_of: _dt.date = AS_OF,
                    data_end: _dt.date = DATA_END) -> DataFrame:
    """(project_id, start, end, ref_end) — data window of each started project
    (actual end, else the earlier of as_of and the planned end, capped at
    ``data_end``; empty windows dropped) and the end used for phase progress."""
    end = F.least(F.coalesce("actual_end_date",
                             F.least(F.lit(as_of), F.coalesce("planned_end_date", F.lit(as_of)))),
                  F.lit(data_end))
    ref_end = F.coalesce("actual_end_date", "planned_end_date", F.add_months("actual_start_date", 12))
    return (projects.where(F.col("actual_start_date").isNotNull())
            .select(F.col("id").alias("project_id"), F.col("actual_start_date").alias("start"),
                    end.alias("end"), ref_end.alias("ref_end"))
            .where(F.col("end") > F.col("start")))


def phase_index(start, ref_end, d) -> Column:
    """0..3 phase of day ``d`` by progress = days elapsed / total (clamped to
    [0, 0.9999]); the last phase is the fallback."""
    total = F.greatest(F.datediff(ref_end, start), F.lit(1))
    prog = F.greatest(F.lit(0.0), F.least(F.datediff(d, start) / total, F.lit(0.9999)))
    passed = [F.when(prog >= p.begins, 1).otherwise(0) for p in PHASES[1:]]
    return sum(passed[1:], passed[0])


def phase_attr(idx: Column, field: str) -> Column:
    """A field of the phase with that index."""
    return F.element_at(F.array(*[F.lit(getattr(p, field)) for p in PHASES]), idx + 1)


def _mondays() -> Column:
    first = F.next_day(F.date_sub("start", 1), "Mon")
    return F.when(first <= F.col("end"), F.sequence(first, F.col("end"), F.expr("INTERVAL 7 DAYS"))) \
            .otherwise(F.array(F.col("start")))


def weekly_spine(windows: DataFrame) -> DataFrame:
    """The Mondays of each window (the start itself when it holds no Monday)."""
    return windows.select("project_id", "start", "end", "ref_end", F.explode(_mondays()).alias("week"))


def budget_allocation(windows: DataFrame, basis: DataFrame) -> DataFrame:
    """Weekly budget per category: basis · category split · phase weight ÷
    weeks in that phase (``basis``: project_id, basis).

    Weeks are counted per phase while a project is still one row, and unfolded last: no
    week is shuffled or sorted."""
    phase = lambda week: phase_index(F.col("start"), F.col("ref_end"), week)                       # noqa: E731
    parts = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))     # by the weeks to come, not by these few bytes
    x = windows.repartition(parts, "project_id").join(basis.hint("shuffle_hash"), "project_id").withColumn("weeks", _mondays()) \
        .withColumn("phases", F.transform("weeks", phase))
    own = lambda k: F.size(F.filter("phases", lambda i: i == k)).cast("long")                      # noqa: E731
    whole = Window.partitionBy("project_id")               # one row a project, more if its id repeats
    x = x.withColumn("in_phase", F.array(*[F.sum(own(k)).over(whole) for k in range(len(PHASES))]))
    cells = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(s).alias("split")) for c, s in CATEGORY_SPLITS])
    x = x.select("project_id", "basis", "in_phase", F.explode(F.arrays_zip("weeks", "phases")).alias("w")) \
        .select("project_id", "basis", F.col("w.weeks").alias("week"), F.col("w.phases").alias("phase"),
                F.element_at("in_phase", F.col("w.phases") + 1).alias("weeks_in_phase"), F.explode(cells).alias("c"))
    weight = phase_attr(F.col("phase"), "cost_weight")
    return x.select(
        "project_id", F.col("week").alias("date_id"),
        phase_attr(F.col("phase"), "name").alias("phase"), F.col("c.category").alias("cost_category"),
        "weeks_in_phase",
        rnd(F.col("basis") * F.col("c.split") * weight / F.col("weeks_in_phase"), 2)
        .alias("planned_budget"))


def inspection_dates(windows: DataFrame) -> DataFrame:
    """N11 (dates): months are stepped one by one from the start, each step from the
    date before, so a day that a short month has clamped stays clamped (31 Jan,
    28 Feb, 28 Mar). While the step is not beyond the end, the 15th of its month,
    moved off weekends, is a date; dates beyond the end are dropped."""
    span = F.greatest(F.months_between(F.last_day("end"), F.trunc("start", "month")).cast("int") + 1, F.lit(1))
    steps = F.aggregate(F.sequence(F.lit(1), span), F.array("start"),
                        lambda acc, _: F.array_append(acc, F.add_months(F.element_at(acc, -1), 1)))
    x = windows.select("project_id", "end", F.explode(F.slice(steps, 2, span)).alias("ms")) \
        .where(F.col("ms") <= F.col("end"))
    d0 = F.date_add(F.trunc("ms", "month"), 14)
    d = F.date_add(d0, F.when(F.weekday(d0) >= 5, 7 - F.weekday(d0)).otherwise(0))
    return x.select("project_id", d.alias("date_id"), "end").where(F.col("date_id") <= F.col("end")) \
        .select("project_id", "date_id")
