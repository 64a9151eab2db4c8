"""bench.py prints exactly one JSON line with the agreed keys."""

from __future__ import annotations

import json
import os
import subprocess
import sys

from keystone_paths import ROOT, SMALL


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SMALL, BENCH_CPUS="2", BENCH_QUERIES="a6_budget_variance")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, cwd=ROOT,
                         capture_output=True, text=True, timeout=600, check=True).stdout
    lines = [ln for ln in out.splitlines() if ln.strip().startswith("{")]
    assert len(lines) == 1
    rec = json.loads(lines[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= set(rec)
    assert rec["unit"] == "sec" and rec["sf"] == 0.001
    assert set(rec["queries"]) == {"s3_build_stored_star", "a6_budget_variance"}
    assert abs(rec["value"] - sum(rec["queries"].values())) < 0.01
