from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from chronolane.session import clear_scratch, local_session

    s = local_session(8, memory="8g", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    clear_scratch(s)


@pytest.fixture(scope="session")
def small() -> str:
    return SMALL


@pytest.fixture
def folder(spark):
    """A fresh folder on the shared file system."""
    from chronolane.session import scratch_path
    from chronolane.sources import files

    path = scratch_path(spark, "test")
    files.make_dir(spark, path)
    return path


def rows_of(df) -> list[tuple]:
    """Rows as sortable text-free tuples, NaN made comparable."""
    cols = sorted(df.columns)
    return sorted((tuple("nan" if isinstance(r[c], float) and r[c] != r[c] else r[c] for c in cols) for r in df.collect()), key=repr)


def compare_with_sql(spark, sf_dir: str, names: list[str]) -> list[str]:
    """Names of the queries whose rows differ from their SQL's in DuckDB."""
    import duckdb

    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in Path(sf_dir).iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    bad = []
    for name in names:
        got = rows_of(queries[name](spark, sf_dir))
        df = con.execute(sql[name])
        heads = [d[0] for d in df.description]
        at = [heads.index(c) for c in sorted(heads)]
        want = sorted((tuple("nan" if isinstance(r[i], float) and r[i] != r[i] else r[i] for i in at) for r in df.fetchall()), key=repr)
        if got != want:
            bad.append(name)
    return bad
