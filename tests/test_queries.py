"""Every query against its SQL in DuckDB, and the plans that matter."""

import duckdb
import pytest

from siltstone.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(frame, columns):
    norm = lambda v: "null" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(norm(v) for v in row) for row in frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist())


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert plain(got, columns) == plain(want, columns)


def test_entry_works_and_lists_the_queries(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["job_feed"](spark, SF))
    assert "PushedFilters: [IsNotNull(o_orderstatus), IsNotNull(o_orderdate), EqualTo(o_orderstatus,O)" in text
    assert "l_comment" not in plan(QUERIES["window_quality"](spark, SF)) and "TakeOrderedAndProject" in plan(QUERIES["scheduler_topk"](spark, SF))


def test_prefix_joins_are_no_nested_loops(spark):
    for name in ("prefix_join", "longest_prefix"):
        assert "NestedLoop" not in plan(QUERIES[name](spark, SF)) and "Cartesian" not in plan(QUERIES[name](spark, SF))
