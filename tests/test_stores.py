"""Stored forms: the registered queries against their SQL, and payload texts."""

import pytest

from crossrank.sources import vendor

FOLDER = "/root/testdata/sf0.001"
STORED = [
    "payload_rows", "payload_warnings", "checksum_audit", "text_store", "immutable_run", "result_tables",
    "symbol_groups", "harmonised_results",
]


@pytest.mark.parametrize("name", STORED)
def test_query_equals_its_sql(spark, name):
    from compare import compare, duck

    import __spark_entry__ as entry

    assert compare(entry.queries()[name](spark, FOLDER), duck(FOLDER), entry.oracle_sql()[name]) == ""


def test_white_space_around_a_payload_is_ignored(spark):
    row = '{"date":"2031-05-06","adjusted_close":7.5}'
    landed = spark.createDataFrame(
        [("Q", f"\n [{row}]\r\n"), ("R", " not a list \n"), ("E", "[]"), ("N", None)], "symbol string, value string"
    )
    entries = vendor.payload_entries(landed)
    assert [(r["symbol"], r["entry_no"], r["adjusted_close"]) for r in vendor.payload_rows(entries).collect()] == [("Q", 0, 7.5)]
    warnings = [(r["symbol"], r["warning"]) for r in vendor.payload_warnings(entries).collect()]
    assert warnings == [("R", "unexpected payload: not a list")]
