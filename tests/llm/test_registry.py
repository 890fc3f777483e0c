"""Every registered query of the subpackage runs on the smallest tables with stable columns."""

import pytest

from quern.llm import registry

COLUMNS = {"p1_found": ["table_name", "row_key"], "p3_found": ["field", "row_key"], "p4_found": ["table_name", "row_key"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_runs(spark, data, duck, rows_of, name):
    df = registry.QUERIES[name](spark, data)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert len(rows) == df.distinct().count()
    if name in registry.SQL:
        cur = duck.execute(registry.SQL[name])
        assert rows_of(df.columns, rows) == rows_of([c[0] for c in cur.description], cur.fetchall())
