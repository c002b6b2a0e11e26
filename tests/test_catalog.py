import pytest
from helpers import canonical, duck

from promptsift.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck(SQL[name], sf_dir)
    assert set(got.columns) == set(want.columns)
    assert canonical(got) == canonical(want[got.columns])


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.count() == 20 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_whole_funnel_is_stable(spark, sf_dir):
    runs = [sorted(map(tuple, QUERIES["funnel_sources"](spark, sf_dir).collect())) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == 20
