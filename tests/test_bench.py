"""bench.py prints one JSON line with every registered query timed."""

from __future__ import annotations

import json
import os
import subprocess
import sys

from flowtally.plans import QUERIES
from tests.conftest import ROOT, SF0001


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF0001, BENCH_CPUS="2", BENCH_REPEAT="1", BENCH_DRIVER_MEMORY="2g")
    out = subprocess.run(
        [sys.executable, os.path.join(ROOT, "bench.py")],
        env=env, capture_output=True, text=True, timeout=900, check=True,
    ).stdout.strip().splitlines()
    assert len(out) == 1
    result = json.loads(out[0])
    assert result["unit"] == "sec" and result["sf"] == 0.001
    assert set(result["queries"]) == set(QUERIES)
    assert abs(result["value"] - sum(result["queries"].values())) < 0.01
