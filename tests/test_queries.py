"""Every query against its SQL on the smallest driver tables, also under other plans."""

import os

import duckdb
import pytest

from lazyframe.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f[:-8]} as select * from read_parquet('{DATA}/{f}')")
    return c


def rows(frame, columns):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in frame[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, db, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), db.execute(ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


@pytest.mark.parametrize("conf", [{"spark.sql.shuffle.partitions": "1"}, {"spark.sql.adaptive.enabled": "false"}, {"spark.sql.autoBroadcastJoinThreshold": "-1"}])
@pytest.mark.parametrize("name", ["join_many", "combine_multi", "group_subset_ge_mean", "unique_cols"])
def test_plan_does_not_matter(spark, db, name, conf):
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = QUERIES[name](spark, DATA).toPandas()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert rows(got, sorted(got.columns)) == rows(db.execute(ORACLE_SQL[name]).fetchdf(), sorted(got.columns))


def test_predicates_and_columns_reach_the_scan(spark):
    plan = QUERIES["combine_mean"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(l_quantity,10.0)" in plan and "partial_avg" in plan and "l_comment" not in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
