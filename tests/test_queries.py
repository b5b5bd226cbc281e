import pytest

from palimpsest.plans import queries as plans

from .compare import rows


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query_has_the_rows_of_its_sql(spark, sf_dir, duck, name):
    got = plans.QUERIES[name](spark, sf_dir).toArrow()
    if name in plans.SQL:
        assert rows(got) == rows(duck.sql(plans.SQL[name]).to_arrow_table())
    else:
        assert got.num_rows > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert {r.status for r in e.entry(spark).collect()} == {"add", "remove", "change", "unchanged"}
