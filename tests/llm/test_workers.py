"""Workers that cannot import the package run every operator with broadcast values."""

import os
import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, {repo!r})
from checks.compare import local_session
from reliefsignals.llm import jaccard, suffixes, queries
spark = local_session(2)
# Workers start from the driver's environment; only its sys.path has the repository.
def seen(rows):
    try:
        import reliefsignals
        yield 1
    except ImportError:
        yield 0
assert spark.sparkContext.parallelize([1], 1).mapPartitions(seen).collect() == [0]
docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
print("ROWS", jaccard.classes(spark, docs).count(), suffixes.digests(spark, docs).count(), docs.count())
"""


def test_operators_run_without_the_package_on_workers(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH",) and not k.startswith(("SPARK_", "PYSPARK_GATEWAY"))}
    done = subprocess.run([sys.executable, "-c", CODE.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    a, b, n = done.stdout.split("ROWS")[1].split()
    assert a == b == n


def test_the_session_of_the_checks_needs_no_duckdb(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"import sys; sys.modules['duckdb'] = None; sys.path.insert(0, {repo!r}); from checks.compare import local_session"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-3000:]
