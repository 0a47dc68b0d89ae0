import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from sievewright.session import build, ship

    s = build(
        "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g", spark__ui__showConsoleProgress="false",
        spark__sql__warehouse__dir="/tmp/sievewright-warehouse",
    )
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    """DuckDB with the smallest tables as views."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in sorted(Path(f"{DATA}/sf0.001").glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    """A value as both engines can give it."""
    import datetime
    import decimal

    if isinstance(v, float):
        return "nan" if v != v else round(v, 5)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 5)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def table_of(columns, rows):
    order = sorted(columns)
    at = [list(columns).index(c) for c in order]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=str)


@pytest.fixture(scope="session")
def compare(spark, duck):
    """Runs a query and its SQL over the smallest tables and compares columns and rows."""

    def run(query, sql):
        df = query(spark, f"{DATA}/sf0.001")
        cur = duck.execute(sql)
        names = [c[0] for c in cur.description]
        assert sorted(df.columns) == sorted(names)
        assert table_of(df.columns, df.collect()) == table_of(names, cur.fetchall())

    return run
