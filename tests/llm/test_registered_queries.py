"""The registered corpus queries against their SQL, and on tables without rows."""

from __future__ import annotations

import os

import duckdb
import pytest

from brindle.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def by_sql(sql, folder):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        at = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return sorted(names), sorted(tuple(str(r[names.index(n)]) for n in sorted(names)) for r in cur.fetchall())


def by_spark(df):
    return sorted(df.columns), sorted(tuple(str(r[n]) for n in sorted(df.columns)) for r in df.collect())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, name):
    assert by_spark(QUERIES[name](spark, SF)) == by_sql(ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_odd_rows_against_sql(spark, tmp_path, name):
    """Null, empty, blank and very long texts, copies, one word, capitals, spaces that aren't ASCII, extra columns."""
    long_ = " ".join(f"w{i % 977}" for i in range(30_000))
    texts = [None, "", "  \t\n", "One", "one", "ONE two", "one two", "é" * 120, "é" * 120, long_, long_ + " end", "A b c d e " * 40, "a B c d e " * 40, "token=abcdef12"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "'x' AS tag", "'y' AS class", "1 AS block", "'z' AS way")
    rows = rows.selectExpr("*", "if(doc_id % 3 = 0, null, 'de') AS lang")
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 0, 1), (11, 1, 1), (12, None, None)], "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "ONE two é w3 one"), (2, None), (3, "- -"), (4, "end A abcdef12")], "item_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert by_spark(QUERIES[name](spark, str(tmp_path))) == by_sql(ORACLE_SQL[name], str(tmp_path))
