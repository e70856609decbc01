"""Every catalogue query against its SQL over the small tables."""

import os

import duckdb
import pytest

from millrace import catalogue as queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are absent")


@pytest.fixture(scope="module")
def base():
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return found


def rows(columns, values):
    order = sorted(columns)
    shown = [[v[columns.index(c)] for c in order] for v in values]
    return order, sorted(repr([round(x, 6) if isinstance(x, float) else x for x in r]) for r in shown)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, base, name):
    frame = queries.QUERIES[name](spark, SF)
    found = base.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert rows(frame.columns, [tuple(r) for r in frame.collect()]) == rows(columns, found.fetchall())


def test_hot_queries_have_no_python(spark):
    for name in ("cross_city_top6_first4", "keyed_upsert", "slug", "html_text", "query_generator", "last_write_wins"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan, name


def test_filters_reach_the_scan(spark):
    plan = queries.QUERIES["semi_negative"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(toxic,1)" in plan
