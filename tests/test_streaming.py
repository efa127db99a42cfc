"""Following sources, and operators over streams."""

from __future__ import annotations

import time

import pytest

from tests.builder import Transcript
from threadloom.plans import rounds
from threadloom.streaming import follow as fw


def test_follow_makes_rounds_as_sources_grow(spark, tmp_path):
    t = Transcript(tmp_path / "src")
    t.turn("one")
    what = fw.Follow("f1", t.flush(), str(tmp_path / "root"), interval_s=0.5)
    running = fw.follow(spark, what, str(tmp_path / "check"))
    try:
        for wanted in (1, 2):
            until = time.time() + 120
            while rounds.rounds_of(spark, what.root).count() < wanted and time.time() < until and running.isActive:
                time.sleep(0.5)
            if wanted == 1:
                t.turn("two")
                t.flush()
    finally:
        running.stop()
    assert rounds.rounds_of(spark, what.root).count() == 2
    assert rounds.fold(spark, what.root, "nodes").where("kind = 'talk'").count() == 2


def test_stream_operators(spark, tmp_path):
    second = 1_000_000_000
    path, out = str(tmp_path / "in"), []
    schema = "session string, id string, ts_ns long"

    def write(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)

    write([("a", "1", 0), ("a", "2", 10 * second), ("a", "1", 5 * second), ("b", None, 0)])
    stream = spark.readStream.schema(schema).parquet(path)
    for name, df, mode in (("seg", fw.idle_segments(stream, "session", "ts_ns", 10), "update"), ("ids", fw.first_seen(stream), "append")):
        out.clear()

        def run():
            q = df.writeStream.outputMode(mode).foreachBatch(lambda b, _: out.extend(tuple(r) for r in b.collect())).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()  # noqa: B023
            q.awaitTermination()

        run()
        if name == "seg":
            assert sorted(out) == [("a", 0, 0, 10 * second, 3), ("b", 0, 0, 0, 1)]
            write([("a", "3", 20 * second + 1), ("a", "4", 21 * second)])
            out.clear()
            run()
            assert sorted(out) == [("a", 1, 20 * second + 1, 21 * second, 2)]
        else:
            assert len(out) == 5


def test_options_are_checked():
    with pytest.raises(ValueError):
        fw.Follow("", "a", "b")
    with pytest.raises(ValueError):
        fw.Follow("x", "a", "b", interval_s=0)
