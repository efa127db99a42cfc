"""Operators over ordered records of a stream: carrying, cutting, walking back.

Windows are per stream, whose order defines the result; those over one stream share
one sort. Walking parents takes a logarithmic number of joins. Rows that tie in the given order come in
any order, so give one that is total; null orders come first, and a null stream is a stream. Empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import drop_table, write_table

__all__ = ["ancestors", "carried", "changed_versions", "contiguity", "cut_before", "gap_segments", "in_intervals", "nearest_ancestor", "numbered", "previous"]

#: Hops that a walk to an ancestor may take.
MOST_HOPS = 64


def _window(stream: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*stream).orderBy(*order)


def so_far(stream: Sequence[str], order: Sequence[str]):
    return _window(stream, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def carried(value: Column, stream: Sequence[str], order: Sequence[str]) -> Column:
    """The last value that is not null, up to here."""
    return F.last(value, ignorenulls=True).over(so_far(stream, order))


def cut_before(boundary: Column, stream: Sequence[str], order: Sequence[str]) -> Column:
    """The number of the epoch: a boundary record opens the next one."""
    return F.sum(boundary.cast("long")).over(so_far(stream, order))


def previous(value: Column | str, stream: Sequence[str], order: Sequence[str]) -> Column:
    return F.lag(value).over(_window(stream, order))


def numbered(stream: Sequence[str], order: Sequence[Column | str]) -> Column:
    return F.row_number().over(Window.partitionBy(*stream).orderBy(*order))


def gap_segments(df: DataFrame, stream: Sequence[str], time: str, order: Sequence[str], gap: str, end: str | None = None) -> DataFrame:
    """df with a segment number from 0: a new one starts where the time since the end of the record before is longer than the gap (strictly)."""
    before = previous(end or time, stream, order)
    marked = df.withColumn("_cut", F.coalesce((F.col(time) - before) > F.expr(f"interval {gap}"), F.lit(False)))
    return marked.withColumn("segment", F.sum(F.col("_cut").cast("long")).over(so_far(stream, order))).drop("_cut")


def contiguity(df: DataFrame, stream: Sequence[str], number: str, order: Sequence[str]) -> DataFrame:
    """df with a status: first, ok (one more than the greatest so far), relanded (not more), or gap."""
    top = F.max(number).over(_window(stream, order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_top", top).withColumn(
        "status", F.when(F.col("_top").isNull(), "first").when(F.col(number) == F.col("_top") + 1, "ok").when(F.col(number) <= F.col("_top"), "relanded").otherwise("gap")
    ).drop("_top")


def nearest_ancestor(df: DataFrame, key: Sequence[str], parent: Sequence[str], found: Column, most_hops: int = MOST_HOPS) -> DataFrame:
    """key columns with `anc` (a struct of the key, of the nearest record at or above it for which found holds, or null) and `hops`.

    Pointer doubling: each round joins the open pointers, and only those, with the pointer of
    the record they have reached, so 64 hops take 7 joins at most, and fewer where
    chains are short: it stops when no pointer is open. A record that is its own parent,
    or whose parent is missing, ends the walk. A key that repeats gives one row: a record for which found holds
    before one without, then the least parent. Rows with a null in their key come back without an ancestor, unless found
    holds for them. An empty table gives no rows. Each round's table is freed once the next one is written.
    """
    own, up = F.struct(*[F.col(k).alias(k) for k in key]), F.struct(*[F.col(p).alias(k) for k, p in zip(key, parent, strict=True)])
    here = F.coalesce(found, F.lit(False))
    some_parent = F.lit(True)
    for p in parent:
        some_parent &= F.col(p).isNotNull()
    start = df.select(*key, here.alias("here"), F.when(~here & some_parent & (own != up), up).alias("at"))
    start = start.groupBy(*key).agg(F.bool_or("here").alias("here"), F.min("at").alias("at"))
    step = start.select(*key, F.when(F.col("here"), own).alias("anc"), F.when(~F.col("here"), F.col("at")).alias("at"), F.when(F.col("here"), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("hops"))
    step = write_table(step, "walk")
    hops = 1
    while hops <= most_hops and not (waiting := step.where("at is not null")).isEmpty():
        reached = step.select(F.struct(*key).alias("_at"), F.col("anc").alias("_anc"), F.col("at").alias("_next"), F.col("hops").alias("_hops"))
        moved = waiting.join(reached, F.col("at") == F.col("_at"), "left").select(
            *key, F.col("_anc").alias("anc"), F.when(F.col("_anc").isNull(), F.col("_next")).alias("at"),
            F.when(F.col("_hops").isNotNull(), F.col("hops") + F.col("_hops")).otherwise(F.col("hops")).alias("hops"),
        )
        after = write_table(step.where("at is null").unionByName(moved), "walk")
        drop_table(step)
        step, hops = after, hops * 2
    within = F.col("hops") <= most_hops
    return step.select(*key, F.when(within, F.col("anc")).alias("anc"), F.when(within & F.col("anc").isNotNull(), F.col("hops")).alias("hops"))


def in_intervals(points: DataFrame, intervals: DataFrame, on: Sequence[str], at: str, low: str, high: str, width: int) -> DataFrame:
    """Points with the columns of each interval of the same key that holds them, both ends included.

    An equi-join on the key and a bucket of so wide a stretch: an interval is in all buckets it touches (its length
    over the width, plus one), a point in one, so a key with a large share of the rows is
    dealt by time. Columns besides the key must differ. Null keys, points or ends match nothing; an interval that ends before it
    begins holds nothing; a point in several intervals comes once for each; repeated rows stay.
    """
    cut = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    spread = intervals.where(F.col(low) <= F.col(high)).withColumn("_bucket", F.explode(F.sequence(cut(low), cut(high))))
    joined = points.withColumn("_bucket", cut(at)).join(spread, [*on, "_bucket"]).drop("_bucket")
    return joined.where(F.col(at).between(F.col(low), F.col(high)))


def ancestors(df: DataFrame, key: Sequence[str], parent: Sequence[str], most_hops: int = MOST_HOPS) -> DataFrame:
    """key columns with `anc` (a struct of a key above it) and `distance`, for every record above each, as far as most_hops (a power of two).

    Doubling: pairs as far apart as the last round reached are joined with all pairs known so far, so 64 hops take 6 joins, fewer where
    chains are short. There are as many pairs as records times their depth. A parent that is missing ends the chain; on a cycle distances go
    on to most_hops. Keys must be unique; rows with a null in their key or parent have nothing above them; an empty table gives no rows.
    """
    name = lambda cols: F.struct(*[F.col(c).alias(k) for c, k in zip(cols, key, strict=True)])
    some = F.lit(True)
    for p in parent:
        some &= F.col(p).isNotNull()
    known = df.select(name(key).alias("_up")).distinct()
    pairs = df.where(some).select(*key, name(parent).alias("anc"), F.lit(1).cast("long").alias("distance")).join(known, F.col("anc") == F.col("_up"), "left_semi")
    pairs, reach = write_table(pairs, "ancestors"), 1
    while reach < most_hops and not (far := pairs.where(F.col("distance") == reach)).isEmpty():
        on = pairs.select(name(key).alias("_at"), F.col("anc").alias("_anc"), F.col("distance").alias("_more"))
        more = far.join(on, F.col("anc") == F.col("_at")).select(*key, F.col("_anc").alias("anc"), (F.col("distance") + F.col("_more")).alias("distance"))
        pairs, reach = write_table(pairs.unionByName(more), "ancestors"), reach * 2
    return pairs


def changed_versions(df: DataFrame, key: Sequence[str], order: Sequence[str], digest: str) -> DataFrame:
    """Of the versions of each key, in that order, those whose digest differs from the one before; the first always, a null differs from all but null."""
    before = previous(F.struct(F.col(digest).alias("d")), key, order)
    return df.withColumn("_before", before).where(F.col("_before").isNull() | ~F.col("_before.d").eqNullSafe(F.col(digest))).drop("_before")
