"""Every registered query with an oracle equals its DuckDB formulation (sf0.001)."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                                "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import compare  # noqa: E402

from keystone_paths import SMALL  # noqa: E402

ORACLES = sorted(E.oracle_sql())


def test_every_oracle_key_is_registered():
    assert set(ORACLES) <= set(E.queries())


@pytest.mark.parametrize("name", ORACLES)
def test_matches_oracle(spark, name):
    r = compare(spark, SMALL, [name], verbose=False)[name]
    assert r["rows"] == r["oracle_rows"], r
    assert r["cols_match"], r
    assert r["hash_match"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "variance_pct" in df.columns
