import re

import __spark_entry__ as E
import duckdb
import pytest

SF = "/root/testdata/sf0.001"
SQL = ["op2_top_k", "op3_quality_rules", "op4_substring_dedup", "op10_license_scans", "op11_line_dedup", "op13_hard_negatives"]


def test_all_and_the_pipeline_are_registered():
    names = set(E.queries())
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14)) and "pipeline" in names
    assert set(SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", SQL)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(E.oracle_sql()[name]).df()
    got = E.queries()[name](spark, SF).toPandas()[list(want.columns)]
    order = list(want.columns)
    assert got.sort_values(order).values.tolist() == want.sort_values(order).values.tolist()
