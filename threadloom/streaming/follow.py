"""Continuous collection, and stateful operators over a stream of landed records.

Sources grow in place, which Spark's file source does not see; so a clock drives passes,
and the landed table itself is the cursor. A pass that is lost half way shows nothing and
is done again. What is landed can be read as a stream by any number of other queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.rounds import collect_pass, publish
from ..sources.tail import WINDOW, WINDOWS

__all__ = ["Follow", "drain", "first_seen", "follow", "idle_segments", "landed_stream", "one_pass", "start"]


@dataclass(frozen=True)
class Follow:
    """What to follow and where to. interval_s: seconds between passes; idle_gap_s: the quiet time that ends a segment; include and exclude: patterns over sessions' folders; window: bytes of a source read at once, windows of them in a pass at most."""

    name: str
    source_root: str
    root: str
    interval_s: float = 5
    idle_gap_s: float = 600
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    window: int = WINDOW
    windows: int = WINDOWS
    mode: str = "watch"

    def __post_init__(self) -> None:
        if not self.name or not self.source_root or not self.root:
            raise ValueError("a name, a source root and a root are needed")
        if self.interval_s <= 0 or self.idle_gap_s <= 0:
            raise ValueError("interval and idle gap are above 0")
        if self.window < 1 or self.windows < 1:
            raise ValueError("window and windows are 1 at least")
        if self.mode not in ("watch", "once"):
            raise ValueError(f"the mode is watch or once, not {self.mode!r}")


def one_pass(spark: SparkSession, what: Follow) -> tuple[int, int]:
    """Lands what is new and publishes the rounds it makes; the numbers of records and rounds. Where another pass holds the root, it does nothing."""
    seen = collect_pass(spark, what.source_root, what.root, what.include, what.exclude, what.window, what.windows)
    return (0, 0) if seen.busy else (seen.records, publish(spark, what.root, what.idle_gap_s).count())


def follow(spark: SparkSession, what: Follow, checkpoint: str) -> StreamingQuery:
    """A running query that makes a pass every interval, until stopped."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def each(batch: DataFrame, _: int) -> None:
        one_pass(batch.sparkSession, what)

    return clock.writeStream.queryName(what.name).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=f"{int(what.interval_s * 1000)} milliseconds").start()


def drain(spark: SparkSession, what: Follow) -> tuple[int, int]:
    """Passes until nothing is pending, then one publish: for history that is there already. The numbers of records and rounds."""
    records = 0
    while True:
        seen = collect_pass(spark, what.source_root, what.root, what.include, what.exclude, what.window, what.windows)
        records += seen.records
        if not seen.pending:
            return (records, 0) if seen.busy else (records, publish(spark, what.root, what.idle_gap_s).count())


def start(spark: SparkSession, what: Follow, checkpoint: str) -> StreamingQuery | None:
    """Does what the mode says: drains once, or follows."""
    if what.mode == "once":
        drain(spark, what)
        return None
    return follow(spark, what, checkpoint)


def landed_stream(spark: SparkSession, root: str) -> DataFrame:
    """Landed records as a stream, those of passes that were lost half way included: deduplicate by id."""
    schema = spark.read.parquet(f"{root}/landed").schema
    return spark.readStream.schema(schema).parquet(f"{root}/landed")


def first_seen(stream: DataFrame) -> DataFrame:
    """The first record of each id of a stream; state grows with the ids seen. Records without an id all stay."""
    return stream.where("id is not null").dropDuplicates(["session", "id"]).unionByName(stream.where("id is null"))


def idle_segments(stream: DataFrame, key: str, time_ns: str, gap_s: float) -> DataFrame:
    """Per key and batch: the segments touched, numbered from 0, with span and count so far. A longer pause (strictly) than the gap opens the next.

    A time earlier than the last one counts in the open segment. State is one row a key.
    """
    gap = int(gap_s * 1_000_000_000)
    out = f"{key} string, segment long, from_ns long, to_ns long, n long"

    def cut(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, start, end, n = state.get if state.exists else (-1, 0, 0, 0)
        times = sorted(int(t) for frame in frames for t in frame[time_ns].dropna())
        rows = []
        for t in times:
            if n == 0 or t - end > gap:
                if n and rows and rows[-1][0] == number:
                    rows[-1] = (number, start, end, n)
                number, start, end, n = number + 1, t, t, 0
                rows.append((number, start, end, n))
            start, end, n = min(start, t), max(end, t), n + 1
            if not rows:
                rows.append((number, start, end, n))
            rows[-1] = (number, start, end, n)
        if times:
            state.update((number, start, end, n))
            yield pd.DataFrame([(group[0], *r) for r in rows], columns=[key, "segment", "from_ns", "to_ns", "n"])

    state = "segment long, from_ns long, to_ns long, n long"
    return stream.groupBy(key).applyInPandasWithState(cut, out, state, "update", GroupStateTimeout.NoTimeout)
