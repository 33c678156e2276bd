import pytest

from corpusloom import catalogue
from tests import oracle

QUERIES = catalogue.queries()
ORACLES = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, small, con, name):
    df = QUERIES[name](spark, small)
    if name in ORACLES:
        oracle.same(df, con, ORACLES[name])
    else:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and catalogue.FLAGSHIP in QUERIES


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["qid", "doc_id", "score", "rank"]
    assert set(QUERIES) <= set(e.queries())
