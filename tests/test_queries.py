"""Every query that SQL can express, against SQL."""

from __future__ import annotations

import pytest

from tests.oracle import differences
from tidelog.queries import ALL


@pytest.mark.parametrize("name,query,sql", [a for a in ALL if a[2]], ids=lambda a: a if isinstance(a, str) and a.startswith("kv_") else "")
def test_query(spark, name, query, sql):
    assert differences(spark, query, sql) == []


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 12
    assert set(e.oracle_sql()) <= set(e.queries())
