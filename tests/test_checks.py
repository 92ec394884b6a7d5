"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from shelfmark.plans import checks

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
SQL = checks.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    yield connection
    connection.close()


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = [tuple("<null>" if r[i] is None else repr(r[i]) if not isinstance(r[i], float) else repr(r[i] + 0.0) for i in order) for r in rows]
    return sorted(columns), sorted(text)


@pytest.mark.parametrize("name", sorted(checks.queries()))
def test_check(spark, duck, name):
    frame = checks.queries()[name](spark, SF)
    got = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    if name in SQL:
        relation = duck.sql(SQL[name])
        assert got == canonical(relation.columns, relation.fetchall())
    assert got[1] or name == "stg_17_poll_states"


def test_plans_have_no_cross_join(spark):
    for name, query in checks.queries().items():
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
