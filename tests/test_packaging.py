"""Python-worker jobs run from any working directory once the package is shipped."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

JOB = """
import sys
sys.path.insert(0, {repo!r})
from patchmetrics.operators.cascade import respond_with
from patchmetrics.session import build_session, ship_package
spark = build_session("local[1]", shuffle_partitions=1)
ship_package(spark)
import patchmetrics.functions.text as text

def run(batches):
    from patchmetrics.functions.text import WS_CLASS
    for pdf in batches:
        pdf["reply"] = pdf["prompt"] + WS_CLASS
        yield pdf[["reply"]]

rows = respond_with(spark.createDataFrame([("a",)], "prompt string"), run, "reply string").collect()
assert rows[0].reply == "a" + text.WS_CLASS, rows
print("fine")
"""


def test_worker_job_from_another_directory(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", JOB.format(repo=REPO)], cwd=tmp_path, env=env, capture_output=True, text=True,
                         timeout=300)
    assert out.stdout.strip().endswith("fine"), out.stderr[-2000:]
