"""Every query against its SQL on the smallest tables."""

import pytest

from opledger.plans import catalogue
from tests.conftest import rows_of

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, data, name):
    found = catalogue.QUERIES[name](spark, data)
    sql = catalogue.ORACLE[name]
    wanted = duck.execute(sql).df()
    names = sorted(wanted.columns)
    assert sorted(found.columns) == names
    assert {c: KINDS[t] for c, t in found.dtypes} == {r[0]: r[1] for r in duck.execute(f"DESCRIBE {sql}").fetchall()}
    assert rows_of(found.toPandas(), names) == rows_of(wanted, names)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
