import __spark_entry__ as entry
from docstruct.plans.queries import QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.queries()) and set(QUERIES) <= set(entry.oracle_sql())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "section_key", "content", "position"]
    assert df.count() > 0
