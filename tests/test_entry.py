"""The driver contract holds with and without the optional subpackage."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def test_entry_without_the_optional_subpackage():
    code = (
        "import sys\n"
        "class Absent:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('ebbflow.llm'):\n"
        "            raise ImportError(name)\n"
        "sys.meta_path.insert(0, Absent())\n"
        "import __spark_entry__ as e\n"
        "assert 'wc_hist' in e.queries() and 'pipeline' not in e.queries() and not [q for q in e.queries() if q.startswith('op')]\n"
        "assert set(e.oracle_sql()) <= set(e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["wc", "freq"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None or v != v:
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def batch_names() -> list[str]:
    from ebbflow.queries import SQL

    return [n for n in SQL if not n.startswith("s_")]


@pytest.mark.parametrize("name", batch_names())
def test_batch_queries_equal_their_sql(spark, duck, name):
    from ebbflow.queries import QUERIES, SQL

    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=str)
    want = duck.sql(f"SELECT {', '.join(cols)} FROM ({SQL[name]})").fetchall()
    assert got == sorted((tuple(plain(v) for v in r) for r in want), key=str)
