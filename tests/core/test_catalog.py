"""Every registered query of the graph operators against its oracle, and the driver's entry points."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from lattica.plans import catalog
from tests.oracle import connection, same

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, con, name):
    same(catalog.QUERIES[name](spark, SF), con, catalog.ORACLE_SQL[name])


def test_rows_only(spark):
    for name in set(catalog.QUERIES) - set(catalog.ORACLE_SQL):
        assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    rows = __spark_entry__.entry(spark).groupBy("verdict").count().collect()
    assert {r["verdict"] for r in rows} == {"entailed", "contradicted", "unknown"}


def test_entry_without_the_training_data_operators(tmp_path):
    shutil.copytree(ROOT / "lattica", tmp_path / "lattica", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


@pytest.mark.parametrize("name", ["code_facts_python", "mutants", "patch_classes"])
def test_python_work_is_dealt_out(spark, monkeypatch, name):
    """A small table of many programs came to a single task."""
    monkeypatch.setattr(catalog, "CODE_ROWS", 20)
    found = catalog.QUERIES[name](spark, SF)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert name == "code_facts_python" or found.rdd.getNumPartitions() == -(-spark.read.parquet(f"{SF}/part.parquet").count() // 20)
