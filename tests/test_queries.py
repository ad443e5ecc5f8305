"""Every named query against its oracle SQL on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from geolark.plans.catalogue import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
PIXELS = {"tile_scores", "tile_rgba"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(DIR):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{name}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (str, bytes, bytearray)):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return int(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name, tmp_path):
    rows = QUERIES[name](spark, DIR)
    columns = sorted(rows.columns)
    if name in PIXELS:  # too many rows for Python
        rows.write.parquet(str(tmp_path / name))
        names, both = ", ".join(columns), (f"SELECT {', '.join(columns)} FROM '{tmp_path / name}/*.parquet'", f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})")
        assert duck.execute(f"SELECT count(*) FROM ({both[0]})").fetchone() == duck.execute(f"SELECT count(*) FROM ({both[1]})").fetchone()
        assert duck.execute(f"SELECT count(*) FROM (({both[0]}) EXCEPT ALL ({both[1]}))").fetchone() == (0,), names
        return
    got = sorted((tuple(plain(r[c]) for c in columns) for r in rows.collect()), key=repr)
    result = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_arrow_scan_equals_expressions(spark):
    a, b = (sorted(map(tuple, QUERIES[n](spark, DIR).collect())) for n in ("sim_scan_expressions", "sim_scan_arrow"))
    assert a == b


def test_scan_does_not_shuffle_cells(spark):
    from geolark.operators.similarity import scan

    cells = spark.createDataFrame([(1, True, [1] * 64)], "pixel long, is_land boolean, q array<int>")
    pins = cells.selectExpr("cast(pixel as int) as pin_idx", "q")
    plan = scan(cells, pins)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_maps_are_checked_without_making_their_descriptions(spark, tmp_path):
    """Keys whose descriptions would not fit any memory."""
    keys = [-1, 0, 1000, 1001, 1 << 29, (1 << 30) - 1]
    spark.createDataFrame([(k, "c") for k in keys], "c_custkey long, c_name string").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    got = {r.id: r.ok for r in QUERIES["map_validate"](spark, str(tmp_path)).collect()}
    assert got == {k: k <= 1000 for k in keys}
    plan = QUERIES["map_validate"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "repeat(x" not in plan
