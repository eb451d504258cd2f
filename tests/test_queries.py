import pytest

from cwlight.bench_queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, data, oracle, same, name):
    got = QUERIES[name](spark, data).toPandas()
    assert len(got)
    if name in ORACLE:
        same(got, oracle(ORACLE[name]))
