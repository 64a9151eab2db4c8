"""Shared fixtures: one local Spark session and a small hand-made star."""

from __future__ import annotations

import datetime as _dt
import sys
from decimal import Decimal

import pytest
from keystone_paths import ROOT

sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from keystone.session import get_session
    s = get_session("local[4]", shuffle_partitions=4)
    yield s


# ---------------------------------------------------------------------------
# A small star: 2 finished projects with worked-out figures, 12 more to train on,
# one running, one without costs; 6 machines, of which 4 were used
# ---------------------------------------------------------------------------
def _d(s: str) -> _dt.date:
    return _dt.date.fromisoformat(s)


def _days(first: str, last: str):
    return [_d(first) + _dt.timedelta(days=k) for k in range((_d(last) - _d(first)).days + 1)]


@pytest.fixture(scope="session")
def site_star(spark):
    from keystone.sources.calendar import calendar_dates
    from keystone.sources.schema import SCHEMAS

    projects = [
        (1, "Harbour Hall", "COMMERCIAL", 400000.0, _d("2023-02-01"), _d("2023-11-28"), _d("2023-02-06"), _d("2023-12-04"), "COMPLETED", "A", None, 5000.0),
        (2, "Mill Court", "RESIDENTIAL", 250000.0, _d("2023-03-01"), _d("2023-08-28"), _d("2023-03-01"), _d("2023-08-20"), "COMPLETED", "B", None, None),
        (3, "Quay Bridge", "INFRASTRUCTURE", 900000.0, _d("2023-05-01"), _d("2024-04-30"), _d("2023-05-10"), None, "ACTIVE", "C", None, None),
        (4, "Green Lot", "RESIDENTIAL", 90000.0, _d("2023-05-01"), None, _d("2023-05-10"), None, "ACTIVE", "C", None, None)]
    costs = [(1, _dt.date(2023, m, 15), "LABOR", None, Decimal(20000 if m <= 4 else 33000), Decimal(24000)) for m in range(2, 12)]
    costs += [(2, _dt.date(2023, m, 10), "MATERIALS", None, Decimal(8000), Decimal(10000)) for m in range(3, 8)]
    costs += [(3, _dt.date(2023, m, 15), "EQUIPMENT", None, Decimal(20000), Decimal(18000)) for m in (6, 7)]
    for i in range(21, 33):
        over = i % 2
        projects.append((i, f"Site {i}", ["COMMERCIAL", "RESIDENTIAL"][i % 3 % 2], 100000.0 + 1000 * i, _d("2022-01-01"), _d("2022-12-31"),
                         _d("2022-01-03"), _d("2022-12-30"), "COMPLETED", "D", None, 800.0))
        costs += [(i, _dt.date(2022, m, 5), "LABOR", None, Decimal(13000 if over else 9000), Decimal(10000)) for m in range(1, 13)]
    machines = [(1, "EX-1", "EXCAVATOR", _d("2022-06-01"), None, None, "ACTIVE"), (2, "TR-2", "TRUCK", _d("2022-09-15"), None, None, "ACTIVE"),
                (3, "TR-3", "TRUCK", _d("2021-09-15"), None, None, "MAINTENANCE"), (4, "CR-4", "CRANE", _d("2023-01-01"), None, None, "ACTIVE"),
                (5, "LO-5", "LOADER", None, None, None, "ACTIVE"), (6, "EX-6", "EXCAVATOR", _d("2020-01-01"), None, None, "ACTIVE")]
    serviced = {1: {"2023-02-10", "2023-04-10"}, 2: {"2023-03-20"}, 3: {"2023-02-01", "2023-03-01", "2023-04-01", "2023-05-01"}, 6: set()}
    usage = [(1, m, d, 3.0 if d.isoformat() in on else 6.0, 15.0 if d.isoformat() in on else 30.0, 250.0 if d.isoformat() in on else 0.0, None)
             for m, on in serviced.items() for d in _days("2023-01-01", "2023-06-30")]
    frames = {"dim_projects": projects, "fact_project_costs": costs, "dim_equipment": machines, "fact_equipment_usage": usage}
    return {t: spark.createDataFrame(rows, SCHEMAS[t]) for t, rows in frames.items()} \
        | {"dim_dates": calendar_dates(spark, _dt.date(2022, 1, 1), _dt.date(2023, 12, 31))}
