"""Written tables: where they go without a setting, and that they are freed."""

import os
import subprocess
import sys
from pathlib import Path

from threadloom import operators as op
from threadloom.storage import drop_table, scratch, shared_dir, write_table

ROOT = Path(__file__).resolve().parent.parent


def held(spark) -> set:
    """The tables of these tests; others may use the folder at the same time."""
    place = shared_dir(spark).removeprefix("file://") + "/threadloom"
    return {x for x in os.listdir(place) if x.startswith(("inner", "kept", "out", "lost", "walk", "ancestors"))} if os.path.isdir(place) else set()


def test_scratch_frees_what_is_not_kept(spark):
    before = held(spark)
    with scratch(spark):
        with scratch(spark):
            write_table(spark.range(3), "inner")
            kept = write_table(spark.range(4), "kept", keep=True)
        assert kept.count() == 4 and len(held(spark) - before) == 1
    assert held(spark) == before
    out = write_table(spark.range(5), "out")
    assert out.count() == 5
    drop_table(out)
    assert held(spark) == before
    try:
        with scratch(spark):
            write_table(spark.range(3), "lost")
            raise KeyError
    except KeyError:
        assert held(spark) == before


def test_a_local_session_needs_no_setting(tmp_path):
    code = (
        "from pyspark.sql import SparkSession; from threadloom.storage import write_table, shared_dir\n"
        "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "assert s.conf.get('spark.checkpoint.dir', None) is None\n"
        "assert write_table(s.range(3), 'x').count() == 3 and shared_dir(s) == shared_dir(s)"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env=os.environ | {"SPARK_CONF_DIR": str(tmp_path)}, capture_output=True)


def test_walks_end_early_and_keys_may_repeat(spark):
    rows = [(i, i - 1 if i else None, i == 0) for i in range(16)] * 2
    df = spark.createDataFrame(rows, "id long, up long, top boolean")
    before = held(spark)
    with scratch(spark):
        got = op.nearest_ancestor(df, ["id"], ["up"], df.top).collect()
        assert sorted((r.id, r.anc.id, r.hops) for r in got) == [(i, 0, i) for i in range(16)]
        assert len(held(spark) - before) == 1  # the last round's table alone
        flat = op.nearest_ancestor(df.where("top"), ["id"], ["up"], df.top)
        assert flat.count() == 1
        pairs = op.ancestors(df.dropDuplicates(["id"]), ["id"], ["up"])
        assert {(r.id, r.anc.id, r.distance) for r in pairs.collect()} == {(i, j, i - j) for i in range(16) for j in range(i)}
    assert held(spark) == before


def test_points_in_intervals(spark):
    points = spark.createDataFrame([("a", 5), ("a", 10), ("a", 101), ("b", 5), (None, 5), ("a", None)], "k string, at long")
    spans = spark.createDataFrame([("a", 1, 10, 1), ("a", 10, 200, 2), ("a", 9, 3, 3), ("b", 6, 9, 4), (None, 0, 9, 5), ("a", None, 9, 6)], "k string, low long, high long, n long")
    for width in (1, 7, 1000):
        got = sorted((r.k, r["at"], r.n) for r in op.in_intervals(points, spans, ["k"], "at", "low", "high", width).collect())
        assert got == [("a", 5, 1), ("a", 10, 1), ("a", 10, 2), ("a", 101, 2)]


def test_merged_relations(spark):
    rows = [("x", "strong_inference", "b", "2", [2]), ("x", "exact_unique", "c", "3", [3]), ("x", "exact_unique", "a", "1", [1]), ("y", "exact_unique", "a", "1", [1]), ("y", "conflict", "b", "2", [2]), ("y", "exact_unique", "a", "3", [3]), (None, None, "z", "1", []), (None, "weak_inference", "w", "2", [9])]
    df = spark.createDataFrame(rows, "id string, quality string, via string, said string, evidence array<int>")
    got = {r.id: (r.quality, r.via, r.evidence) for r in op.merge_relations(df, ["id"]).collect()}
    assert got == {"x": ("exact_unique", "a", [1, 2, 3]), "y": ("conflict", "a; b", [1, 2, 3]), None: ("weak_inference", "w", [9])}
    assert op.merge_relations(df.limit(0), ["id"]).count() == 0
