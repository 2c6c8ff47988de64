"""Every registered query against its reference SQL on the small tables, and privacy of the result schemas."""

import duckdb
import pytest

import __spark_entry__ as entry
from sessionloom.plans import catalog
from sessionloom.schema import TEXT_COLUMNS

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def key(row):
    return tuple((x is None, type(x).__name__, repr(x)) for x in row)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, sf_dir, con):
    df = catalog.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    ours = sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=key)
    cur = con.execute(catalog.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=key)
    assert [key(r) for r in ours] == [key(r) for r in theirs]
    assert not (set(cols) & (TEXT_COLUMNS - {"text", "command"}))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


#: Queries whose operators once joined on a constant.
ONE_ROW = ["a13_git_habits", "a36_hygiene_stats", "h28_percent_share", "p2_own_baselines", "w11_type_p90", "w15_task_mix", "w17_effort_calibration",
           "w18_context_rot", "w19_episode_detail"]


@pytest.mark.parametrize("name", ONE_ROW)
def test_no_cross_join(name, spark, sf_dir, capsys):
    catalog.QUERIES[name](spark, sf_dir).explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
