import pytest

from palimpsest.llm import queries

from ..compare import rows


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_has_the_rows_of_its_sql(spark, sf_dir, duck, name):
    assert rows(queries.QUERIES[name](spark, sf_dir).toArrow()) == rows(duck.sql(queries.SQL[name]).to_arrow_table())
