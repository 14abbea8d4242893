"""Every registered query of the reference's operators against its SQL, on the smallest tables."""

import math
from pathlib import Path

import pytest

import workload

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    return None if value is None or isinstance(value, float) and math.isnan(value) else value


@pytest.mark.parametrize("name", sorted(workload.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    frame = workload.QUERIES[name](spark, str(DATA))
    columns = sorted(frame.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in frame.collect())
    found = duck.execute(workload.SQL[name])
    order = [[d[0] for d in found.description].index(c) for c in columns]
    assert got == sorted(str([plain(r[i]) for i in order]) for r in found.fetchall())
    assert got


def test_library_does_not_need_the_optional_package():
    root = Path(__file__).resolve().parent.parent
    for path in [*(root / "scribeframe").rglob("*.py"), *(root / "workload").rglob("*.py")]:
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(encoding="utf-8"), path
