"""The queries on the small tables, against SQL where there is some."""

import pytest

from tests.compare import connect, difference
from tracewright.llm.queries import QUERIES, SQL

COLUMNS = {
    "p1_found": ["file_id"], "p2_found": ["project", "relpath", "license"], "p4_found": ["finding_id", "group_id"], "p5_found": ["file_id", "first_pos", "last_pos"],
    "p6_found": ["file_id_a", "file_id_b"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "seg_no", "lang"],
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    assert difference(QUERIES[name](spark, sf), connect(sf), SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_found_queries_give_distinct_rows_of_their_columns(spark, sf, name):
    df = QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    assert df.columns == COLUMNS[name] and rows and len(rows) == len(set(rows))
