import pytest

from conftest import SF
from oracle import same
from quillmap.plans import atlas, lookups, stages  # noqa: F401


@pytest.mark.parametrize("name", sorted(atlas.SQL))
def test_query_equals_sql(spark, name):
    assert same(spark, SF, atlas.QUERIES[name], atlas.SQL[name]) > 0


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() == 1500 and df.where("radius < 600").count() == 0
    assert set(e.oracle_sql()) <= set(e.queries())
