"""A session that is started from another folder."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from vigilbus.session import build_session
spark = build_session("elsewhere", "local[2]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"})
from vigilbus.operators import federated
rows = [("a", 400.0 * i, i, [0.1 * i, 0.0], 1.0) for i in range(5)]
frame = spark.createDataFrame(rows, "client_id string, time_s double, round int, weights array<double>, loss double")
print("rows", federated.send_decisions(frame).count())
build_session()
spark.stop()
"""


def test_workers_import_the_package(tmp_path):
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(ROOT)], cwd=tmp_path, env=clean,
                          capture_output=True, text=True, timeout=170, check=False)
    assert "rows 5" in done.stdout, done.stderr[-2000:]
