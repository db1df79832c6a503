"""Every registered query of the merge against its SQL, and the registry without the
training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from seamline.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})".replace(", offset", ', "offset"').replace("SELECT offset", 'SELECT "offset"')).fetchall()
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, want))
    assert want


def test_expected_counts(spark, sf_dir):
    if not sf_dir.rstrip("/").endswith("sf0.001"):
        pytest.skip("counts of sf0.001")
    assert queries.sequenced_dedup(spark, sf_dir).count() == 990
    assert queries.gap_report(spark, sf_dir).count() == 10
    assert sorted((r["partition"], r["sent"], r["dropped"]) for r in queries.verdict_counts(spark, sf_dir).collect()) == [(0, 270, 364), (1, 230, 310), (2, 286, 386), (3, 204, 275)]


def test_registry_without_the_subpackage(tmp_path):
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "seamline", tmp_path / "seamline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); assert 'sequenced_dedup' in q and not any(k.startswith('op') and k[2].isdigit() for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
