"""The calendar job against an independent Python calendar."""

from __future__ import annotations

import calendar
import datetime as _dt

from keystone.sources.calendar import calendar_dates


def _py_holidays(y: int) -> set:
    def nth(month, wd, n):
        days = [d for d in range(1, calendar.monthrange(y, month)[1] + 1)
                if _dt.date(y, month, d).weekday() == wd]
        return _dt.date(y, month, days[n - 1] if n > 0 else days[-1])
    return {_dt.date(y, 1, 1), nth(1, 0, 3), nth(2, 0, 3), nth(5, 0, -1), _dt.date(y, 7, 4),
            nth(9, 0, 1), nth(11, 3, 4), _dt.date(y, 12, 25)}


def test_calendar_2022_2026(spark):
    rows = calendar_dates(spark, _dt.date(2022, 1, 1), _dt.date(2026, 12, 31)).collect()
    assert len(rows) == 1826
    hol = set().union(*[_py_holidays(y) for y in range(2022, 2027)])
    for r in rows:
        d = r.date
        assert r.day_of_week == d.weekday()
        assert r.week == d.isocalendar()[1]
        assert r.quarter == (d.month - 1) // 3 + 1
        assert r.month_name == d.strftime("%B")
        assert r.is_weekend == (d.weekday() >= 5)
        assert r.is_holiday == (d in hol), d


def test_empty_range(spark):
    assert calendar_dates(spark, _dt.date(2022, 1, 2), _dt.date(2022, 1, 1)).count() == 0


def test_budget_weeks_are_unfolded_after_the_last_shuffle(spark):
    """Also for ids that come twice: every week of a phase counts, whichever row it is from."""
    from collections import Counter

    import datetime as dt

    from keystone.sources import generate as G

    d = dt.date
    windows = spark.createDataFrame([(1, d(2023, 1, 4), d(2023, 6, 1), d(2023, 6, 1)), (1, d(2023, 1, 4), d(2023, 3, 1), d(2023, 6, 1)),
                                     (2, d(2023, 1, 4), d(2023, 1, 6), d(2023, 1, 6)), (None, d(2023, 1, 4), d(2023, 2, 6), d(2023, 2, 6))],
                                    "project_id long, start date, end date, ref_end date")
    basis = spark.createDataFrame([(1, 1000.0), (1, 50.0), (2, None)], "project_id long, basis double")
    out = G.budget_allocation(windows, basis)
    rows = out.collect()
    weeks = G.weekly_spine(windows).join(basis, "project_id").count()
    assert len(rows) == 5 * weeks > 0
    counted = Counter((r.project_id, r.phase) for r in rows)
    assert all(r.weeks_in_phase * 5 == counted[r.project_id, r.phase] for r in rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    assert plan.rindex("Generate") < plan.index("Exchange")
