"""Every query of the library against its SQL, on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import compare  # noqa: E402

from tallgrass import plans  # noqa: E402


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in sorted(os.listdir(sf)):
        c.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf, db, name):
    df = plans.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    if name not in plans.SQL:
        assert got
        return
    want = db.sql(plans.SQL[name])
    at = [want.columns.index(c) for c in cols]
    assert sorted(want.columns) == cols
    assert compare.digest(got) == compare.digest([tuple(x[i] for i in at) for x in want.fetchall()])


def test_line_counts_of_odd_texts(spark, tmp_path):
    """texts without a line had a row, rows of one key were not added up, and other line ends and a dotted I were taken otherwise than in the SQL."""
    hit = "hein month"
    texts = [None, "", "\n", "\n\n", hit, f"{hit}\n{hit}\n", "hein\nonth", "hein\ronth", "hein\r\nonth\x0bhein\x85hein onth", "a Warning\nFAILED", "WARNİNG\nfaİled\nwarnıng", hit]
    rows = [(k, x) for k, x in enumerate(texts)] + [(4, "hein\nfailed"), (4, ""), (5, None), (None, hit), (None, hit)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    df = plans.QUERIES["SCN6_report_counts"](spark, str(tmp_path))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(plans.SQL["SCN6_report_counts"])
    got = [tuple(r) for r in df.collect()]
    assert df.columns == want.columns and [t for _, t in df.dtypes] == [str(t).lower() for t in want.types]
    assert compare.digest(got) == compare.digest(want.fetchall()) and {r[0] for r in got}.isdisjoint({0, 1})
    assert {(4, 2, 1, 1), (7, 1, 1, 0), (9, 0, 0, 2), (10, 0, 0, 2), (None, 2, 2, 0)} <= set(got)
