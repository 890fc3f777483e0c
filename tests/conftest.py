import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quern.session import get_spark

    s = get_spark("tests", "4", 3)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import glob

    import duckdb

    db = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return db


@pytest.fixture(scope="session")
def rows_of():
    """(columns, rows) in a form that both engines print alike, sorted."""

    def plain(v):
        if isinstance(v, float):
            return f"{v:.6g}"
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        return "" if v is None else f"{float(v):.6g}" if hasattr(v, "as_tuple") else str(v)

    def form(columns, rows):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        return sorted(columns), sorted(tuple(str(plain(float(r[i]) if isinstance(r[i], int) and not isinstance(r[i], bool) else r[i])) for i in order) for r in rows)

    return form
