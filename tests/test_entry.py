"""Every registered relational query against its SQL, on the smallest tables."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry_module
from tessera.plans import queries as core

AT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM '{AT}/{t}.parquet'")
    return found


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 4)
    return v if isinstance(v, (int, bool)) else str(v).removesuffix(" 00:00:00")


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = core.queries()[name](spark, AT)
    cursor = db.execute(core.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(plain(v) for v in r) for r in df.collect()), key=repr) == want


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry_without_the_corpus_operators(tmp_path):
    """With the optional subpackage gone the others are still registered."""
    top = os.path.dirname(os.path.abspath(entry_module.__file__))
    shutil.copytree(f"{top}/tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{top}/{name}"):
            shutil.copy(f"{top}/{name}", tmp_path)
    ask = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", ask], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout.splitlines()
    assert got == [" ".join(sorted(core.queries())), " ".join(sorted(core.oracle_sql()))]
