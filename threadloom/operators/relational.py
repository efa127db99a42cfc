"""Deduplication, grouping, matching, folding and auditing.

None of these needs a group in one task: they are partial aggregates and equi-joins,
which survive a key with a large share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = ["AMBIGUOUS", "CONFLICT", "NO_REQUEST", "RANK", "UNIQUE", "UNRESOLVED", "changes", "digest_of", "first_wins", "fold_latest", "fragments", "labelled", "match_pairs", "merge_relations", "missing", "slug"]

#: How well a match is known.
UNIQUE, AMBIGUOUS, UNRESOLVED, NO_REQUEST = "exact_unique", "exact_ambiguous", "unresolved", "no_request"


def first_wins(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in that order; rows with a null in their key are all kept. One partial aggregate, no window.

    Null orders come first. Rows that tie are told apart by all other columns that have an order, so the result does not hang on that of the table;
    repeated rows are one.
    """
    cols = df.columns
    known = F.lit(True)
    for k in key:
        known &= F.col(k).isNotNull()
    rest = [c for c in cols if c not in order]
    least = F.min(F.struct(*order, *rest))
    if any("map<" in t or "variant" in t for _, t in df.dtypes):  # these have no order
        least = F.min_by(F.struct(*order, *rest), F.struct(*order))
    best = df.where(known).groupBy(*key).agg(least.alias("row")).select(*[F.col(f"row.`{c}`") for c in cols])
    return best.unionByName(df.where(~known))


def fragments(df: DataFrame, key: str, order: Sequence[str], finished: Column, usage: str, synthetic: Column) -> DataFrame:
    """Calls from their fragments: their number, first and last place, whether any is synthetic or finished, and the usage of the last one, if any finished.

    Fragments without a call are one call of a null key; repeated fragments count each; of fragments that tie as last, any gives the usage, so give a total order.
    """
    place = F.struct(*order)
    made = df.groupBy(key).agg(
        F.count("*").alias("n_fragments"), F.min(order[0]).cast("long").alias("first_row"), F.max(order[0]).cast("long").alias("last_row"),
        F.bool_or(synthetic).alias("synthetic"), F.bool_or(finished).alias("finished"), F.max_by(usage, place).alias("usage"),
    )
    return made.withColumn("usage", F.when(F.col("finished"), F.col("usage")))


def match_pairs(df: DataFrame, key: Sequence[str], request: Column, result: Column, order: Sequence[str], value: Column) -> DataFrame:
    """Requests and results with the same key: the first of each, the number of results, and the quality of the match. One aggregate instead of a full outer join.

    Null keys match one another, as one key; repeated results count each; a row that is neither request nor result is left out, and a null condition is false. Ties in the order may give either row.
    """
    place = F.struct(*order)
    made = df.where(request | result).groupBy(*key).agg(
        F.min_by(F.when(request, value), F.when(request, place)).alias("request"), F.min_by(F.when(result, value), F.when(result, place)).alias("result"), F.count(F.when(result, 1)).alias("n_results"),
    )
    quality = F.when(F.col("request").isNull(), NO_REQUEST).when(F.col("n_results") == 0, UNRESOLVED).when(F.col("n_results") == 1, UNIQUE).otherwise(AMBIGUOUS)
    return made.withColumn("quality", quality)


def missing(left: DataFrame, right: DataFrame, on: Column | Sequence[str]) -> DataFrame:
    """Rows of left that right does not have; a null on either side matches nothing, so such rows of left all stay, repeated ones too."""
    return left.join(right, on, "left_anti")


def fold_latest(df: DataFrame, key: Sequence[str], order: Sequence[str], tombstone: Column | None = None) -> DataFrame:
    """The state after all revisions: the last row of each key, without those that are tombstones (a null condition is none). Null keys are one key; of rows that tie as last any counts, so give a total order."""
    cols = df.columns
    last = df.groupBy(*key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("row")).select("row.*")
    return last if tombstone is None else last.where(~tombstone)


def changes(before: DataFrame, after: DataFrame, key: Sequence[str], state: Sequence[str]) -> DataFrame:
    """What turns one state into another: added, changed, same or tombstone, by key. Keys must be unique in each state, as a fold gives them; null keys never match, so they are tombstones before and added after; null states are equal."""
    old = before.select(*key, F.struct(*state).alias("old"), F.lit(True).alias("was"))
    new = after.select(*key, F.struct(*state).alias("new"), F.lit(True).alias("is"))
    kind = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "tombstone").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    return old.join(new, list(key), "full").select(*key, kind.alias("change"))


#: How much a quality licenses.
RANK = {"exact_unique": 5, "exact_ambiguous": 4, "strong_inference": 3, "weak_inference": 2}


CONFLICT = "conflict"


def merge_relations(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Relations said more than once, from rows of key, quality, via, evidence (an array) and said (their order).

    All evidence in the order of said; the strongest quality, and of equally strong ones the way first said. A
    conflict outlasts any quality, and its way names all ways in the order they were first said.
    An unknown or null quality is the weakest; repeated rows give their evidence each; null keys are one key.
    """
    rank = F.coalesce(*[F.when(F.col("quality") == q, F.lit(r)) for q, r in RANK.items()], F.lit(0))
    best = F.struct(-rank, F.col("said"), F.col("via"))
    seen = F.array_sort(F.collect_list(F.struct("said", "via", "evidence")))
    made = df.groupBy(*key).agg(F.min_by(F.struct("quality", "via"), best).alias("best"), F.coalesce(F.bool_or(F.col("quality") == CONFLICT), F.lit(False)).alias("conflict"), seen.alias("seen"))
    ways = F.array_join(F.array_distinct(F.transform("seen", lambda s: s["via"])), "; ")
    return made.select(
        *key, F.when(F.col("conflict"), CONFLICT).otherwise(F.col("best.quality")).alias("quality"), F.when(F.col("conflict"), ways).otherwise(F.col("best.via")).alias("via"),
        F.flatten(F.transform("seen", lambda s: s["evidence"])).alias("evidence"),
    )


def digest_of(text: Column, digits: int = 12) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, digits)


def labelled(df: DataFrame, terms: DataFrame, on: Column, native: str, unified: str, out: str) -> DataFrame:
    """df with the native name of its terms, or the unified one where there is none. A term that repeats repeats the row; null terms have the unified name."""
    return df.join(terms, on, "left").withColumn(out, F.coalesce(native, unified))


def slug(path: Column) -> Column:
    """A path as a folder name: / . and space become -."""
    return F.translate(path, "/. ", "---")
