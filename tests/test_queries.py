"""Every core query with SQL gives DuckDB's rows; the others give rows."""

import os
import subprocess
import sys

import pytest

from statloom.queries import ORACLE_SQL, QUERIES
from tests.compare import same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), ORACLE_SQL[name], sf)


@pytest.mark.parametrize("name", ["logistic_regression", "gaussian_naive_bayes", "linear_regression", "kmeans", "principal_components", "ddm_drift", "adwin_drift"])
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns
    df.collect()


def test_topics_of_documents_with_rare_words(spark, tmp_path):
    rows = [(i, " ".join(f"w{j}" for j in range(2000))) for i in range(2)] + [(2 + i, " ".join([f"rare{i}x{j}" for j in range(20)] * 3)) for i in range(4)]
    rows += [(6, " ".join(f"rare7x{j}" for j in range(20)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    topics = {r.doc_id: r.topics for r in QUERIES["topic_model"](spark, str(tmp_path)).collect()}
    assert len(topics) == 7 and all(abs(sum(t) - 1) < 1e-6 for t in topics.values())


def test_queries_are_listed_without_a_session():
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries(), *e.oracle_sql())"], cwd=home, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert {"logistic_regression", "col_stats"} <= set(done.stdout.split())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
