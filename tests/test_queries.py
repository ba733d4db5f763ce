"""All registered queries on the smallest tables: non-empty, stable column names, SQL for most."""

import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables are not here")


def test_names_are_unique_and_mostly_have_sql():
    names, sql = set(entry.queries()), entry.oracle_sql()
    assert set(sql) <= names and len(sql) >= 0.9 * len(names)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["wide_table", "event_distance", "duplicates", "grid_affine_sample", "fold_summary",
                                  "split_cluster", "weighted_features", "time_distribution", "ks_distance"])
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tools.check import TABLES, rows_of

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    result = con.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in result.description], result.fetchall())
