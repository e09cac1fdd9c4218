"""Every query with SQL gives DuckDB's rows; every query runs."""

import os

import duckdb
import pytest

from deltaloom.plans.catalog import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def fold(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    return "[" + ",".join(map(fold, value)) + "]" if isinstance(value, (list, tuple)) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted("|".join(fold(row[c]) for c in columns) for row in df.collect())
    if name in ORACLE_SQL:
        result = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        assert rows == sorted("|".join(fold(row[names.index(c)]) for c in columns) for row in result.fetchall())


def test_entry_imports_without_llm(tmp_path):
    """The entry module and its queries work where the llm folders and the pipeline are gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/deltaloom", tmp_path / "deltaloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'doc_changes_by_type' in q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
