"""bench.py prints exactly one JSON line with the fields the driver records."""

from __future__ import annotations

import json
import os
import subprocess
import sys
import tempfile

from .conftest import ROOT, SF_SMALL


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF_SMALL, BENCH_CPUS="2", BENCH_QUERIES="dwh_orders,mart_sales_daily",
               BENCH_SCRATCH=tempfile.mkdtemp(prefix="bench-", dir="/tmp"))
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, capture_output=True,
                         text=True, timeout=600)
    lines = [ln for ln in out.stdout.splitlines() if ln.strip()]
    assert len(lines) == 1, out.stdout
    d = json.loads(lines[0])
    assert d["metric"] and d["unit"] == "sec" and d["value"] > 0
    assert set(d["queries"]) == {"dwh_orders", "mart_sales_daily"} and not d["errors"]
    assert d["sf"] == 0.001
