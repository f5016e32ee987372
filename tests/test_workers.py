"""Queries run where executors can't import this package."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"
SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
def there(_):
    try:
        import longleaf
        return True
    except ImportError:
        return False
assert not spark.sparkContext.parallelize([1]).map(there).collect()[0]
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
for name in {names!r}:
    assert entry.queries()[name](spark, {data!r}).count() > 0, name
"""


def run_elsewhere(tmp_path, names):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO, names=names, data=DATA)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600, check=False)
    assert done.returncode == 0, done.stderr[-3000:]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_core_queries(tmp_path):
    run_elsewhere(tmp_path, ["html_blocks", "glossary_term_matches", "segment_pack_conversations", "stream_run_state"])
