"""Every registered query over the smallest tables: it runs, and its columns are as promised."""

import os

import pytest

from lorekiln.llm.queries import QUERIES

DATA = os.environ.get("LOREKILN_TEST_DATA", "/root/testdata/sf0.001")
COLUMNS = {
    "p1_found": ["record_id", "field_name", "defect"],
    "p2_found": ["temp_qid", "group_qid"],
    "p3_found": ["group_id", "field_name", "record_id"],
    "p4_found": ["temp_qid", "shared_chars"],
    "p6_found": ["accepted_id", "new_id"],
    "p7_ids": ["doc_id", "ids"],
    "p9_found": ["doc_id", "reading_level"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    df = QUERIES[name](spark, DATA)
    assert df.columns == COLUMNS.get(name, df.columns)
    assert df.count() > 0
