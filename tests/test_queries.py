"""Every registered query with SQL against DuckDB on the smallest tables."""

import datetime

import duckdb
import pytest

from tessera.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float) and v == int(v) and abs(v) < 1e15:
        return int(v)
    if isinstance(v, list):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_rows_equal_sql(spark, db, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rel = db.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [list(rel.columns).index(c) for c in cols]
    assert sorted(repr([plain(r[c]) for c in cols]) for r in df.collect()) == sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())


def test_whole_tables_are_audited(spark, tmp_path):
    """Orders 2 and 5 leave the remainder 2 by 3; the events are of an odd user, errors too."""
    spark.createDataFrame([(2, 7, "LOW"), (5, 7, "LOW")], "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "error", 2.0), (1, "click", 4.0)], "user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    run = lambda name: registry.queries()[name](spark, str(tmp_path)).collect()
    assert [(r.o_custkey, r.left_sample, r.right_sample) for r in run("audit_overlap_examples_all")] == [(7, 2, 5)]
    assert {r.kind: r.shared for r in run("audit_leakage_kinds_all")} == {"o_custkey": 1, "o_orderkey": 0, "o_orderpriority": 1}
    assert {(r.metric, r.old, r.new) for r in run("metric_deltas_all")} == {("error", 2.0, 2.0), ("click", 4.0, 4.0)}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
