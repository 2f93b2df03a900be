"""Every registered query next to its SQL twin, at the smallest scale."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as spark_entry
import check_oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check_oracle.database(SF)


# Corpus operators without SQL have tests of their own.
CORPUS = {n for n in spark_entry.queries() if n.startswith("op") or n == "pipeline"}
OWN = sorted(set(spark_entry.oracle_sql()) | set(spark_entry.queries()) - CORPUS)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, name):
    assert check_oracle.compare(spark, con, name, SF) == ""


def test_entry(spark):
    assert spark_entry.entry(spark).limit(1).count() == 1


def test_twins_belong_to_queries():
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())
    without = set(spark_entry.queries()) - set(spark_entry.oracle_sql())
    own = without - CORPUS
    assert own == {"recall_cells", "recall_buckets"}


def test_workers_get_the_package(tmp_path):
    """Started from another folder, as on an executor, the Python workers find the package."""
    root = os.path.dirname(os.path.abspath(spark_entry.__file__))
    script = ("import sys; sys.path.insert(0, sys.argv[1])\n"
              "import __spark_entry__ as e, check_oracle as c\n"
              "q, s = e.queries(), c.session('2')\n"
              f"print(*[q[n](s, '{SF}').count() for n in ('neighbours_exact', 'parallel_fetch', 'embed_text_hash')])")
    done = subprocess.run([sys.executable, "-c", script, root], cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    assert all(int(n) > 0 for n in done.stdout.split())
