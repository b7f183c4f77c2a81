"""Every query against its SQL on the small tables, where they are there."""

import datetime
import decimal
from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.isoformat() if isinstance(v, datetime.date) else v


def order(row):
    return tuple((x is None, str(type(x)), 0 if x is None else x) for x in row)


@pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")
def test_queries_match_their_sql(spark):
    import __spark_entry__ as e
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries)
    wrong = []
    for name, text in sql.items():
        df = queries[name](spark, str(DATA))
        got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=order)
        found = con.execute(text)
        names = [d[0] for d in found.description]
        want = sorted((tuple(plain(v) for _, v in sorted(zip(names, r))) for r in found.fetchall()), key=order)
        if sorted(names) != sorted(df.columns) or got != want or not got:
            wrong.append((name, len(got), len(want)))
    assert not wrong
    assert e.entry(spark).count() > 0


@pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")
def test_plans_push_down_and_stay_in_the_jvm(spark):
    import re

    from quillspark.plans.queries import QUERIES

    plan = QUERIES["coverage"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


@pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")
@pytest.mark.parametrize("name", ["coverage", "coverage_by_identifier", "join_ref_author_year", "unresolved_marker"])
def test_texts_are_read_once(spark, name):
    import re

    from quillspark.plans.queries import QUERIES

    df = QUERIES[name](spark, str(DATA))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan parquet \[doc_id#\d+L,text#", plan)) <= 1
