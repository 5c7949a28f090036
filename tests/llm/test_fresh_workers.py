"""The queries in Python workers that have run nothing before, as after the loss of an executor."""

import subprocess
import sys
from pathlib import Path

import pytest

SCRIPT = """
import sys
from pickflow.llm.queries import queries
from pickflow.session import build_session

settings = {"spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.python.worker.reuse": "false"}
spark = build_session("fresh", **settings)
for name in sys.argv[2:]:
    assert queries()[name](spark, sys.argv[1]).count() > 0, name
print("done")
"""


@pytest.mark.parametrize("names", [("op4_fingerprints", "op10_repeats"), ("op11_lexical_search", "op13_near_vectors"), ("op3_license_scan", "op5_quality", "op9_url_rules")])
def test_queries_without_worker_reuse(sf, names):
    ran = subprocess.run([sys.executable, "-c", SCRIPT, sf, *names], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, timeout=600)
    assert ran.stdout.strip().endswith("done"), ran.stderr[-3000:]
