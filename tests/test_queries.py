"""Every query against its SQL, and those without SQL against their shape."""

import pytest

import __spark_entry__ as entry
from sidera.plans import registry
from tests.compare import by_sql, rows


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    assert len(got.columns)
    if name in registry.ORACLES:
        assert rows(got) == rows(by_sql(registry.ORACLES[name], sf))
    else:
        assert len(got)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["user_id", "sequence", "seq_len"] and df.count()
    assert set(entry.oracle_sql()) <= set(entry.queries())
