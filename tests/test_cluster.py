"""Queries whose parts run in other processes than the driver's: nothing but shared folders is there for all of them."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pyspark
import pytest
from conftest import DATA, ROOT
from test_queries import plain

from tessera.plans import registry

SCRIPT = """
import json, sys
from tessera.session import session
import __spark_entry__
s = session("local-cluster[2,1,1024]", "cluster", spark_checkpoint_dir="file://" + sys.argv[2], spark_sql_shuffle_partitions="4", spark_ui_enabled="false", spark_driver_host="127.0.0.1")
out = {}
for name in sys.argv[3:]:
    try:
        df = __spark_entry__.queries()[name](s, sys.argv[1])
        out[name] = [df.columns, [list(r) for r in df.collect()]]
    except Exception as e:
        out[name] = str(e)[:2000]
print("RESULT" + json.dumps(out))
s.stop()
"""
NAMES = ["jdbc_federated_join", "jdbc_pushed_aggregate", "schema_discovery"]


@pytest.fixture(scope="module")
def results(tmp_path_factory):
    """Rows of the queries NAMES, run on two executors beside the driver."""
    home, shared = tmp_path_factory.mktemp("home"), tmp_path_factory.mktemp("shared")
    (home / "work").mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():  # executors' logs go to work in Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_"))} | {"PYTHONPATH": ROOT, "SPARK_HOME": str(home), "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", SCRIPT, DATA, str(shared), *NAMES], env=env, cwd=shared, capture_output=True, text=True, timeout=300)
    told = [x for x in done.stdout.splitlines() if x.startswith("RESULT")]
    assert told, done.stderr[-2000:]
    return json.loads(told[0].removeprefix("RESULT"))


@pytest.mark.parametrize("name", NAMES)
def test_on_executors(results, duck, name):
    assert isinstance(results[name], list), results[name]
    columns, rows = results[name]
    there = duck.sql(registry.ORACLES[name])
    assert sorted(there.columns) == sorted(columns)
    order = [there.columns.index(c) for c in columns]
    assert plain([tuple(r) for r in rows]) == plain([tuple(r[i] for i in order) for r in there.fetchall()])
