"""python -m keystone report writes a registered query as Parquet."""

from __future__ import annotations

import os
import subprocess
import sys

import pyarrow.parquet as pq

from keystone_paths import ROOT, SMALL


def test_cli_report(tmp_path):
    out = str(tmp_path / "a3")
    subprocess.run([sys.executable, "-m", "keystone", "report", "a3_subcontractor_scorecard",
                    "--sf", SMALL, "--out", out], cwd=ROOT, check=True, timeout=600,
                   capture_output=True, env=dict(os.environ))
    t = pq.read_table(out)
    assert t.num_rows > 0 and "composite_score" in t.column_names
