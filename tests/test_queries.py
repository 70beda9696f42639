"""Every query runs on the smallest tables; those with SQL equal it, and the core works without the text subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_core_queries_equal_their_sql(spark):
    import duckdb

    from lorestack.plans.registry import all_queries, all_sql
    from tools_compare import plain

    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    for name, query in all_queries().items():
        df = query(spark, str(DATA))
        columns = sorted(df.columns)
        got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
        if name in all_sql():
            result = con.execute(all_sql()[name])
            names = [d[0] for d in result.description]
            assert sorted(names) == columns, name
            assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), name


def test_core_doesnt_import_the_text_subpackage():
    code = "import sys; sys.modules['lorestack.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p2_found' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
