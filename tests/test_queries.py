import os
import subprocess
import sys
from pathlib import Path

import pytest
from compare import compare, duck

from siftmill import shared
from siftmill.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def db(small):
    return duck(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, db, small, name):
    assert compare(spark, db, QUERIES[name], SQL[name], small) == ""


def test_language_labels_do_not_part_near_duplicates(spark, tmp_path):
    words = [f"w{i}" for i in range(60)]
    text, other = " ".join(words), " ".join([*words[:58], "x", "y"])
    data = [(1, text, "EN"), (2, other, "en"), (3, other, None), (4, text.upper(), "de-x"), (5, None, "en"), (6, text, None)]
    spark.createDataFrame(data, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    links = [(r.id_a, r.id_b, r.n_a, r.n_b) for r in QUERIES["neardup_all_links"](spark, str(tmp_path)).collect()]
    members = sorted((r.doc_id, r.class_id) for r in QUERIES["neardup_all_members"](spark, str(tmp_path)).collect())
    assert links == [(1, 2, 3, 2)] and members == [(1, 1), (2, 2), (3, 2), (4, 1), (6, 1)]
    assert QUERIES["neardup_links"](spark, str(tmp_path)).count() == 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_executors_need_no_package(tmp_path):
    """Another working directory, and nothing of the repository on the path of the workers."""
    root = Path(__file__).resolve().parent.parent
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[2]').config('spark.checkpoint.dir', 'file://{tmp_path}/shared').config('spark.ui.enabled', 'false').getOrCreate()
import __spark_entry__ as e
print('rows', e.queries()['minhash_signatures'](spark, '/root/testdata/sf0.001').count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "rows 100" in done.stdout, done.stderr[-2000:]


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master, applicationId = "spark://x:7077", "a"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError):
        shared.shared_dir(Session())
