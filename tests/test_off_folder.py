"""Queries run from any working folder, without the package on the workers' path."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from riskweave.plans import QUERIES
from riskweave.session import get_session, release, scratch_folder
spark = get_session("off", "local[4]", **{"spark.sql.shuffle.partitions": "4",
                                          "spark.ui.enabled": "false"})
for name in ("welch_t", "pearson_pairs"):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
from pathlib import Path
folder = Path(scratch_folder(spark))
assert folder.is_dir()
release(spark)
assert not folder.exists()
print("fine")
"""


def test_empty_folder_without_path(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(ROOT)], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]
