"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

`queries` are over the tables. `transcript` times the record path over a built session of about 50,000 nodes: landing,
publishing its first round, folding it and answering; and publishing after one more turn, for which only that session is read.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from threadloom.catalog import QUERIES
from threadloom.plans import rounds
from threadloom.plans.view import Conversations

HEADLINE = ["view_conversations", "dedup_first", "calls_usage_last", "tool_join", "segment_cut", "epoch_cut", "talk_assign", "walk_back", "fold_lww", "round_diff", "spawn_resolve", "rel_merge", "input_digest", "conv_digest", "talk_labels", "star_revenue", "star_pricing"]
SESSION, TURNS = "0a0b0c0d-0001-4000-8000-000000000001", 6000


def turn(n: int, parent: str | None) -> list[str]:
    """The lines of one turn: a prompt, a call that uses a tool, its result and an answer."""
    at = lambda s: f"2026-{1 + n // 4000:02d}-{1 + n // 150 % 27:02d}T{n // 10 % 15 + 1:02d}:{n % 10 * 5 + s // 60:02d}:{s % 60:02d}.000Z"

    def line(name: str, up: str | None, second: int, kind: str, content: list, **more) -> str:
        return json.dumps({"uuid": f"{n}-{name}", "parentUuid": up, "type": kind, "timestamp": at(second), "message": {"content": content, **more.pop("message", {})}, **more})

    tool = f"tool-{n}"
    return [
        line("in", parent, 1, "user", [{"type": "text", "text": f"prompt {n} " * 20}], promptId=f"run-{n}", origin={"kind": "human"}),
        line("f1", f"{n}-in", 2, "assistant", [{"type": "text", "text": "working " * 30}], message={"id": f"call-{n}", "model": "m"}),
        line("f2", f"{n}-f1", 3, "assistant", [{"type": "tool_use", "id": tool, "name": f"Tool{n % 9}", "input": {"n": n}}], message={"id": f"call-{n}", "model": "m", "stop_reason": "tool_use", "usage": {"input_tokens": 5, "output_tokens": n % 100}}),
        line("res", f"{n}-f2", 4, "user", [{"type": "tool_result", "tool_use_id": tool, "content": "done " * 40}], promptId=f"run-{n}"),
        line("end", f"{n}-res", 9, "assistant", [{"type": "text", "text": "complete " * 30}], message={"id": f"last-{n}", "model": "m", "stop_reason": "end_turn"}),
    ]


def timed(work: Callable[[], object]) -> float:
    began = time.perf_counter()
    work()
    return round(time.perf_counter() - began, 3)


def drained(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def transcript(spark: SparkSession) -> dict[str, float]:
    place = Path(tempfile.mkdtemp(prefix="threadloom-bench-"))
    try:
        source, root = place / "src", str(place / "root")
        file = source / "-work" / f"{SESSION}.jsonl"
        file.parent.mkdir(parents=True)
        lines = [x for n in range(TURNS) for x in turn(n, f"{n - 1}-end" if n else None)]
        file.write_text("".join(f"{x}\n" for x in lines))
        took = {"collect": timed(lambda: rounds.collect(spark, str(source), root)), "publish": timed(lambda: rounds.publish(spark, root))}
        took["nothing_new"] = timed(lambda: (rounds.collect(spark, str(source), root), rounds.publish(spark, root)))
        with file.open("a") as f:
            f.write("".join(f"{x}\n" for x in turn(TURNS, f"{TURNS - 1}-end")))
        took["next_round"] = timed(lambda: (rounds.collect(spark, str(source), root), rounds.publish(spark, root)))
        took["nodes"] = rounds.fold(spark, root, "nodes").count()
        took["fold"] = min(timed(lambda: drained(rounds.fold(spark, root, "nodes"))) for _ in range(2))
        view = Conversations(spark, root)
        took["list"] = min(timed(lambda: view.list().collect()) for _ in range(2))
        took["talks"] = min(timed(lambda: drained(view.talks(SESSION))) for _ in range(2))
        took["one_talk"] = min(timed(lambda: view.talk(SESSION, f"talk/main/run-{TURNS // 2}").collect()) for _ in range(2))
        return took
    finally:
        shutil.rmtree(place, ignore_errors=True)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {name: min(timed(lambda name=name: drained(QUERIES[name](spark, sf_dir))) for _ in range(2)) for name in HEADLINE}
    more = transcript(spark) if os.environ.get("BENCH_TRANSCRIPT", "1") == "1" else {}
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "transcript": more}))


if __name__ == "__main__":
    main()
