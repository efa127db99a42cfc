"""Every query against its oracle, and operators on cases that the tables lack."""

import decimal
import os

import duckdb
import pytest

from threadloom import operators as op
from threadloom.catalog import ORACLES, QUERIES
from threadloom.functions import entity_id, run_id, short_name

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    made = duckdb.connect()
    for name in os.listdir(SF):
        made.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return made


def plain(v):
    return str(v.normalize()) if isinstance(v, decimal.Decimal) else repr(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_oracle(spark, duck, name):
    rows = QUERIES[name](spark, SF)
    found = duck.execute(ORACLES[name])
    cols = [d[0] for d in found.description]
    assert sorted(cols) == sorted(rows.columns)
    want = sorted(tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(cols)) for r in rows.collect()) == want


def test_walk_stops(spark):
    """At missing parents, at records that are their own parents, and after so many hops."""
    rows = [("a", None, True), ("b", "a", False), ("c", "gone", False), ("d", "d", False), ("e", None, False)] + [(f"n{i}", f"n{i - 1}" if i else "a", False) for i in range(80)]
    found = op.nearest_ancestor(spark.createDataFrame(rows, "id string, parent string, hit boolean"), ["id"], ["parent"], __import__("pyspark").sql.functions.col("hit"))
    got = {r.id: (r.anc.id if r.anc else None, r.hops) for r in found.collect()}
    assert got["a"] == ("a", 0) and got["b"] == ("a", 1) and got["c"] == got["d"] == got["e"] == (None, None)
    assert got["n63"] == ("a", 64) and got["n64"] == (None, None)


def test_rows_without_a_key_stay(spark):
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (None, 3, "c"), (None, 3, "c")], "id int, place int, text string")
    assert sorted(r.text for r in op.first_wins(rows, ["id"], ["place"]).collect()) == ["a", "c", "c"]


def test_changes_and_tombstones(spark):
    old, new = (spark.createDataFrame(x, "id int, v string") for x in ([(1, "a"), (2, "b"), (3, None)], [(1, "a"), (2, "c"), (4, "d"), (3, None)]))
    assert {(r.id, r.change) for r in op.changes(old, new, ["id"], ["v"]).collect()} == {(1, "same"), (2, "changed"), (3, "same"), (4, "added")}


def test_names(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(
        entity_id("rel", F.lit("a/b"), F.lit(""), F.lit("c")).alias("id"), run_id(F.lit("x-wf_a-wf_b2.js")).alias("run"), run_id(F.lit("x.js")).alias("no_run"), short_name(F.lit(" a \n b" + "c" * 200)).alias("name")
    ).first()
    assert row.id == "rel/a_b/c" and row.run == "wf_b2" and row.no_run is None and row.name == "a b" + "c" * 157 + "…"


def test_gap_is_strict(spark):
    rows = spark.sql("select 1 as s, cast(ts as timestamp_ntz) as ts from values ('2020-01-01 00:00:00'), ('2020-01-01 00:10:00'), ('2020-01-01 00:20:01') as t(ts)")
    assert [r.segment for r in op.gap_segments(rows, ["s"], "ts", ["ts"], "10 minutes").orderBy("ts").collect()] == [0, 0, 1]


def test_manifests_of_many_sessions(spark, tmp_path):
    """No row per session and manifest, no block converted for a filter at the scan, and users without an id or with negative runs as the SQL has them."""
    duck = duckdb.connect()
    duck.execute("create table events as select u * 10 + i as event_id, timestamp '2024-01-01' as ts, nullif(u, 3) as user_id, case i % 3 when 0 then 'view' when 1 then 'click' else 'error' end as event_type, 1.0::double as value, '{\"k\": ' || (u % 5 - 2 + i // 6) || '}' as props from range(40) a(u), range(9) b(i)")
    duck.execute("create table supplier as select s - 5 as s_suppkey, nullif('s' || s, 's7') as s_name, 1 as s_nationkey, 0.0::double as s_acctbal from range(30) r(s)")
    for t in ("events", "supplier"):
        duck.execute(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    rows = QUERIES["tool_manifest"](spark, str(tmp_path))
    run = rows._jdf.queryExecution()
    filters = [line for line in run.optimizedPlan().toString().splitlines() if line.strip(" :+-").startswith("Filter")]
    assert filters and not any("from_json" in line for line in filters)
    assert not [kind for kind in ("NestedLoop", "Cartesian") if kind in run.sparkPlan().toString()]
    want = duck.execute(f"select user_id, k, label from ({ORACLES['tool_manifest']})").fetchall()
    assert (None, 1) in {x[:2] for x in want} and any(x[1] < 0 for x in want) and any(x[2] is None for x in want)
    assert sorted(map(repr, want)) == sorted(repr((r.user_id, r.k, r.label)) for r in rows.collect())
