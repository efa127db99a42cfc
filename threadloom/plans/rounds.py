"""Round chains: what each pass over a conversation added, as appended Parquet under one root.

Layout: `landed`, `cursors`, `nodes`, `relations`, `unresolved` and `rounds`, each with a column `attempt`.
Writing `passes` or `rounds` last commits a pass: rows of an attempt that has no row there do not
count, so a job that is lost half way leaves nothing visible and can run again. A chain is
one conversation (session); all conversations that have new records advance in one job, and the others are not read.
One pass at a time may write a root: it holds the root's lock, and `publish` also checks that nobody else committed
since it folded. Tables written on the way are freed at the end of each pass.

Rounds verify themselves: a round's digest covers its header, its entities and the digest before it, and its input digest
the landed records it read. `audit_chain` computes both anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators import contiguity, nearest_ancestor
from ..sources import transcripts
from ..sources.tail import APPEND, CURSORS, WINDOW, WINDOWS
from ..storage import exclusive, remove, scratch, write_table
from .assembly import REF, Assembly, assemble

__all__ = ["PARSER", "Collected", "audit_chain", "audit_landed", "audit_rounds", "audit_sessions", "chain_digests", "collect", "collect_pass", "cursors_of", "fold", "landed_files", "landed_of", "policy_of", "publish", "rounds_of", "tree_problems"]

PARSER = "threadloom/2"
STATES = {
    "nodes": f"session string, id string, kind string, parent string, stream string, ref {REF}, refs array<{REF}>, attrs string, talk string, depth long",
    "relations": f"session string, id string, type string, `from` string, `to` string, quality string, via string, evidence array<{REF}>",
    "unresolved": "session string, id string, kind string, ref string, reason string, state string",
}
ENTITY = ", round long, tombstone boolean, attempt string"
ROUNDS = "session string, round long, previous string, from_seq long, through_seq long, input_digest string, parser string, policy string, n_nodes long, n_relations long, n_unresolved long, n_tombstones long, digest string, attempt string"


def policy_of(idle_gap_s: float) -> str:
    return f"v1+idle={idle_gap_s:g}s"


def _read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # nothing there, or nothing but an empty folder
            raise
        return spark.createDataFrame([], schema) if schema else None


def landed_of(spark: SparkSession, root: str) -> DataFrame | None:
    """Landed records of passes that were committed; None before the first."""
    landed = _read(spark, f"{root}/landed")
    passes = None if landed is None else _read(spark, f"{root}/passes", "attempt string")
    return None if landed is None else landed.join(passes, "attempt", "left_semi").drop("attempt")


@dataclass(frozen=True)
class Collected:
    """What a pass of collection saw and landed. pending: sources with more to read than a pass may; busy: 1 where another pass held the root."""

    sessions: int = 0
    sources_seen: int = 0
    sources_landed: int = 0
    records: int = 0
    bytes: int = 0
    sources_gone: int = 0
    conflicts: int = 0
    pending: int = 0
    busy: int = 0

    @property
    def complete(self) -> bool:
        """Whether all that was there is landed."""
        return not (self.pending or self.conflicts or self.busy)


def cursors_of(spark: SparkSession, root: str) -> DataFrame:
    """The last committed cursor of each source."""
    passes = _read(spark, f"{root}/passes", "attempt string, number long")
    rows = _read(spark, f"{root}/cursors", CURSORS + ", attempt string").join(passes, "attempt")
    return rows.groupBy("src").agg(F.max_by(F.struct("offset", "top", "known", "inode", "state"), "number").alias("c")).select("src", "c.*")


def collect_pass(spark: SparkSession, source_root: str, root: str, include: Sequence[str] = (), exclude: Sequence[str] = (), window: int = WINDOW, windows: int = WINDOWS) -> Collected:
    """Lands what is new below source_root in the selected sessions. Safe to run again at any time; without anything new it writes nothing that stays."""
    with exclusive(spark, root) as mine, scratch(spark):
        if not mine:
            return Collected(busy=1)
        attempt, before = "p" + uuid.uuid4().hex, landed_of(spark, root)
        old = write_table(cursors_of(spark, root), "cursors")
        seqs = None if before is None else before.groupBy("session").agg(F.max("seq").alias("before"))
        new, cursors = transcripts.land(spark, source_root, old, seqs, include, exclude, window, windows)
        path = f"{root}/landed/attempt={attempt}"
        new.write.parquet(path)
        stored = spark.read.schema(new.schema).parquet(path)
        n = stored.agg(F.count("*"), F.count_distinct("session"), F.count_distinct("src"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
        state = cursors.agg(F.count("*"), F.count_if(F.col("state") == "pending")).first()
        changed = cursors.join(old.select("src", F.struct(*[c for c in old.columns if c != "src"]).alias("was")), "src", "left")
        changed = changed.where(~F.struct(*[c for c in old.columns if c != "src"]).eqNullSafe(F.col("was"))).drop("was")
        moved = not changed.isEmpty()
        if moved:
            changed.withColumn("attempt", F.lit(attempt)).write.mode("append").parquet(f"{root}/cursors")
            number = (_read(spark, f"{root}/passes", "attempt string, number long").agg(F.max("number")).first()[0] or 0) + 1
            spark.range(1).select(F.lit(attempt).alias("attempt"), F.lit(number).cast("long").alias("number")).write.mode("append").parquet(f"{root}/passes")
        if not n[0]:
            remove(spark, path)
        conflicts = cursors_of(spark, root).where("startswith(state, 'conflict')").count()
        seen = transcripts.discover(spark, source_root)
        gone = 0 if before is None else transcripts.gone(seen, before).count()
        return Collected(n[1], state[0], n[2], n[0], n[3], gone, conflicts, state[1])


def collect(spark: SparkSession, source_root: str, root: str, **options) -> int:
    """collect_pass; the number of records."""
    return collect_pass(spark, source_root, root, **options).records


def landed_files(spark: SparkSession, root: str) -> DataFrame:
    """What was landed by source and pass, in the order of sequences: session, seq, src, source_kind, records, bytes, first and last line."""
    landed = landed_of(spark, root)
    if landed is None:
        return spark.createDataFrame([], "session string, seq long, src string, source_kind string, records long, bytes long, first_ord long, last_ord long")
    rows = landed.groupBy("session", "seq", "src", "source_kind").agg(F.count("*").alias("records"), F.sum("bytes").alias("bytes"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))
    return rows.orderBy("session", "seq")


def rounds_of(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, f"{root}/rounds", ROUNDS)


def fold(spark: SparkSession, root: str, kind: str, as_of: int | None = None) -> DataFrame:
    """The entities of a kind after all rounds, or after round `as_of`: the last revision of each id, without tombstones."""
    done = rounds_of(spark, root).select("session", "round", "attempt")
    df = _read(spark, f"{root}/{kind}", STATES[kind] + ENTITY).join(done, ["session", "round", "attempt"], "left_semi")
    if as_of is not None:
        df = df.where(F.col("round") <= as_of)
    state = [c for c in df.columns if c not in ("session", "id", "round", "tombstone", "attempt")]
    last = df.groupBy("session", "id").agg(F.max_by(F.struct(*state, "tombstone", "round"), "round").alias("w"))
    return last.where("not w.tombstone").select("session", "id", *[F.col(f"w.`{c}`").alias(c) for c in [*state, "round"]])


def _delta(kind: str, before: DataFrame, after: DataFrame) -> DataFrame:
    """Entities that are new or differ, and tombstones of those that are gone; an open reference that is gone is resolved instead."""
    state = [c for c in before.columns if c not in ("session", "id", "round")]
    old = before.select("session", "id", F.struct(*state).alias("old"))
    new = after.select("session", "id", F.struct(*[F.col(c) for c in state]).alias("new"))
    both = old.join(new, ["session", "id"], "full").where(~F.col("old").eqNullSafe(F.col("new")))
    if kind == "unresolved":
        both = both.where("new is not null or old.state = 'open'")
        closed = F.col("new").isNull()
        both = both.withColumn("new", F.when(closed, F.col("old").withField("state", F.lit("resolved"))).otherwise(F.col("new")))
        return both.select("session", "id", *[F.col(f"new.`{c}`").alias(c) for c in state], F.lit(False).alias("tombstone"))
    return both.select("session", "id", *[F.col(f"new.`{c}`").alias(c) for c in state], F.col("new").isNull().alias("tombstone"))


def _digest(df: DataFrame, key: list[str], text: Column, out: str) -> DataFrame:
    """SHA-256 over the sorted texts of a key, in two steps so that no row holds more than a 4096th of a large group."""
    parts = df.select(*key, F.sha2(text, 256).alias("h")).groupBy(*key, F.substring("h", 1, 3).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\0"), 256).alias("h"))
    return parts.groupBy(*key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("b", "h"))), "\0"), 256).alias(out))


HEADER = ("session", "round", "previous", "from_seq", "through_seq", "input_digest", "parser", "policy", "body")


def _header_digest() -> Column:
    return F.sha2(F.concat_ws("\0", *[F.col(c).cast("string") for c in HEADER]), 256)


def _entity_text(kind: str, columns: Sequence[str]) -> Column:
    return F.to_json(F.struct(F.lit(kind).alias("t"), *columns)).alias("text")


def _evidence(landed: DataFrame, key: list[str]) -> DataFrame:
    """The digest over whole landed records."""
    columns = sorted(c for c in landed.columns if c not in ("round", "through_seq"))
    return _digest(landed, key, F.to_json(F.struct(*columns)), "evidence")


def publish(spark: SparkSession, root: str, idle_gap_s: float = 600) -> DataFrame:
    """Assembles the sessions with records that no round has read yet and appends the next round of each; the new rows of `rounds`.

    Raises ValueError where a chain was built by another parser or policy: one chain is one
    interpretation; RuntimeError where another pass holds the root or committed meanwhile. A session whose evidence did
    not advance gets no round, and is not read.
    """
    attempt = uuid.uuid4().hex
    with exclusive(spark, root) as mine, scratch(spark):
        if not mine:
            raise RuntimeError(f"another pass holds {root}")
        _publish(spark, root, idle_gap_s, attempt)
    return rounds_of(spark, root).where(F.col("attempt") == attempt)


def _publish(spark: SparkSession, root: str, idle_gap_s: float, attempt: str) -> None:
    landed, policy = landed_of(spark, root), policy_of(idle_gap_s)
    if landed is None:
        return
    done = rounds_of(spark, root)
    if (other := done.where((F.col("parser") != PARSER) | (F.col("policy") != policy)).select("session", "parser", "policy").first()) is not None:
        raise ValueError(f"the chain of {other.session} was built by {other.parser} under {other.policy}; this is {PARSER} under {policy}")
    heads = done.groupBy("session").agg(F.max_by(F.struct("round", "through_seq", "digest", "input_digest"), "round").alias("head")).select("session", "head.*")
    # the watermark is fixed before assembly, which reads nothing above it
    head = landed.groupBy("session").agg(F.max("seq").alias("through")).join(heads, "session", "left").where(F.col("through") > F.coalesce("through_seq", F.lit(0)))
    head = write_table(head, "heads")
    if head.isEmpty():
        return
    behind = head.select("session")
    landed = landed.join(behind, "session", "left_semi")
    made: Assembly = assemble(landed, idle_gap_s, head.select("session", "through"))
    deltas = {}
    for kind, after in (("nodes", made.nodes), ("relations", made.relations), ("unresolved", made.unresolved)):
        deltas[kind] = write_table(_delta(kind, fold(spark, root, kind).join(behind, "session", "left_semi"), after), f"delta-{kind}")
    counts = None
    for kind, delta in deltas.items():
        counted = delta.groupBy("session").agg(F.count("*").alias(f"n_{kind}"), F.count_if("tombstone").alias(f"t_{kind}"))
        counts = counted if counts is None else counts.join(counted, "session", "full")
    texts = None
    for kind, delta in deltas.items():
        one = delta.select("session", _entity_text(kind, delta.columns))
        texts = one if texts is None else texts.unionByName(one)
    body = _digest(texts, ["session"], F.col("text"), "body")
    fresh = landed.join(head.select("session", "through_seq"), "session").where(F.col("seq") > F.coalesce("through_seq", F.lit(0)))
    whole = head.join(counts, "session", "left").join(body, "session", "left").join(_evidence(fresh, ["session"]), "session", "left")
    rows = whole.select(
        "session", (F.coalesce("round", F.lit(0)) + 1).cast("long").alias("round"), F.coalesce("digest", F.lit("")).alias("previous"), (F.coalesce("through_seq", F.lit(0)) + 1).cast("long").alias("from_seq"), F.col("through").alias("through_seq"),
        _chained(F.col("input_digest"), F.col("evidence")).alias("input_digest"), F.lit(PARSER).alias("parser"), F.lit(policy).alias("policy"),
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in deltas], sum((F.coalesce(f"t_{k}", F.lit(0)) for k in deltas), F.lit(0)).cast("long").alias("n_tombstones"), F.coalesce("body", F.lit("")).alias("body"))
    rows = write_table(rows.withColumn("digest", _header_digest()).drop("body").withColumn("attempt", F.lit(attempt)), "rounds")
    numbers = rows.select("session", "round")
    for kind, delta in deltas.items():
        stamped = delta.join(numbers, "session").withColumn("attempt", F.lit(attempt))
        stamped.select(*spark.createDataFrame([], STATES[kind]).columns, "round", "tombstone", "attempt").write.mode("append").parquet(f"{root}/{kind}")
    if rounds_of(spark, root).join(numbers, ["session", "round"], "left_semi").limit(1).count():
        raise RuntimeError("another pass committed these rounds meanwhile")
    rows.write.mode("append").parquet(f"{root}/rounds")


def _chained(before: Column, evidence: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(before, F.lit("")), F.lit("\0"), F.coalesce(evidence, F.lit(""))), 256)


def chain_digests(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Of rows(key, round, evidence) the input digest after the last round, each covering the one before, and n_rounds. Rounds must be unique in a key; null evidence is empty. The rounds of a key, a digest each, meet in one task."""
    order = F.array_sort(F.collect_list(F.struct("round", F.coalesce("evidence", F.lit("")).alias("evidence"))))
    digest = F.aggregate("rounds", F.lit(""), lambda before, r: _chained(before, r["evidence"]))
    return rows.groupBy(*key).agg(order.alias("rounds")).select(*key, digest.alias("digest"), F.size("rounds").cast("long").alias("n_rounds"))


def tree_problems(nodes: DataFrame, most_hops: int = 64) -> DataFrame:
    """Rows (session, id, problem) of nodes(session, id, parent, stream): repeated id, lost parent, crosses streams (a node and its parent), cycle (no root or lost parent within most_hops above it). A sound tree gives none."""
    known = nodes.groupBy("session", F.col("id").alias("parent")).agg(F.count("*").alias("n"), F.min("stream").alias("above"))
    joined = nodes.join(known, ["session", "parent"], "left")
    lost = F.col("parent").isNotNull() & F.col("n").isNull()
    marked = joined.select("session", "id", F.col("session").alias("up_session"), F.col("parent").alias("up"), (F.col("parent").isNull() | lost).alias("ends"))
    walked = nearest_ancestor(marked, ["session", "id"], ["up_session", "up"], F.col("ends"), most_hops)
    parts = [
        known.where("n > 1").select("session", F.col("parent").alias("id"), F.lit("repeated id").alias("problem")),
        joined.where(lost).select("session", "id", F.lit("lost parent").alias("problem")),
        joined.where("stream <> above").select("session", "id", F.lit("crosses streams").alias("problem")),
        walked.where("anc is null").select("session", "id", F.lit("cycle").alias("problem")),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def audit_chain(spark: SparkSession, root: str) -> DataFrame:
    """Problems of the chains: numbers, seqs or digests that do not follow, and digests that the stored entities or landed records do not give. No rows: all is well."""
    done = rounds_of(spark, root)
    keys = done.select("session", "round", "attempt")
    texts = None
    for kind, schema in STATES.items():
        df = _read(spark, f"{root}/{kind}", schema + ENTITY).join(keys, ["session", "round", "attempt"], "left_semi")
        columns = [c for c in df.columns if c not in ("round", "tombstone", "attempt")]
        one = df.select("session", "round", _entity_text(kind, [*columns, "tombstone"]))
        texts = one if texts is None else texts.unionByName(one)
    body = _digest(texts, ["session", "round"], F.col("text"), "body")
    landed = landed_of(spark, root)
    order = Window.partitionBy("session").orderBy("round")
    df = done.withColumn("before", F.lag(F.struct("round", "through_seq", "digest", "input_digest")).over(order))
    if landed is not None:
        # a sequence is read by the first round that reaches it
        seqs = landed.select("session", "seq").distinct().unionByName(done.select("session", F.col("through_seq").alias("seq"), "round"), allowMissingColumns=True)
        upward = Window.partitionBy("session").orderBy("seq", F.col("round").isNotNull(), "round").rowsBetween(Window.currentRow, Window.unboundedFollowing)
        seqs = seqs.withColumn("read_by", F.min("round").over(upward)).where("round is null and read_by is not null").select("session", "seq", F.col("read_by").alias("round"))
        df = df.join(_evidence(landed.join(seqs, ["session", "seq"]), ["session", "round"]), ["session", "round"], "left")
    else:
        df = df.withColumn("evidence", F.lit(None).cast("string"))
    df = df.join(body, ["session", "round"], "left").withColumn("body", F.coalesce("body", F.lit("")))
    first = F.col("before").isNull()
    checks = {
        "number": F.col("round") != F.when(first, 1).otherwise(F.col("before.round") + 1),
        "from_seq": F.col("from_seq") != F.when(first, 1).otherwise(F.col("before.through_seq") + 1),
        "previous": F.col("previous") != F.when(first, "").otherwise(F.col("before.digest")),
        "range": F.col("through_seq") < F.col("from_seq") - 1,
        "digest": F.col("digest") != _header_digest(),
        "input_digest": F.col("input_digest") != _chained(F.col("before.input_digest"), F.col("evidence")),
    }
    problems = F.array_compact(F.array(*[F.when(wrong, F.lit(name)) for name, wrong in checks.items()]))
    return df.select("session", "round", F.explode(problems).alias("problem"))


def audit_landed(spark: SparkSession, root: str) -> DataFrame:
    """Per landed source: records, bytes covered, gaps and relanded lines, and bytes between or under them; a growing source has none of these. Snapshots count their versions."""
    landed = landed_of(spark, root)
    if landed is None:
        return spark.createDataFrame([], "session string, src string, source_kind string, records long, bytes long, gaps long, relanded long, byte_gaps long")
    grows = F.col("source_kind").isin(*APPEND)
    rows = contiguity(landed.select("session", "src", "source_kind", "seq", "row", "ord", "off", "bytes"), ["session", "src"], "ord", ["seq", "row"])
    ends = F.lag(F.col("off") + F.col("bytes") + 1).over(Window.partitionBy("session", "src").orderBy("seq", "row"))
    rows = rows.withColumn("_jump", grows & (F.coalesce(ends, F.lit(0)) != F.col("off")))
    lost = (F.col("status") == "gap") | ((F.col("status") == "first") & (F.col("ord") != 1))
    return rows.groupBy("session", "src", "source_kind").agg(F.count("*").alias("records"), F.sum("bytes").alias("bytes"), F.count_if(lost).alias("gaps"), F.count_if(F.col("status") == "relanded").alias("relanded"), F.count_if("_jump").alias("byte_gaps"))


def audit_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Per session: sources by kind, records, bytes, sources in conflict, and sources with a problem."""
    per = audit_landed(spark, root)
    bad = F.col("gaps") + F.col("relanded") + F.col("byte_gaps") > 0
    kinds = [F.count_if(F.col("source_kind") == k).alias(f"n_{k}") for k in ("main", "agent", "meta", "journal", "manifest", "script")]
    stuck = cursors_of(spark, root).where("startswith(state, 'conflict')").select("src", F.lit(True).alias("stuck"))
    return per.join(stuck, "src", "left").groupBy("session").agg(*kinds, F.sum("records").alias("records"), F.sum("bytes").alias("bytes"), F.count("stuck").alias("conflicts"), F.count_if(bad).alias("problems"))


def audit_rounds(spark: SparkSession, root: str) -> DataFrame:
    """Problems inside rounds: an id twice in one, a state that is none, an edge without ends, a place above the watermark, counts that differ."""
    done = rounds_of(spark, root)
    parts = []
    for kind in STATES:
        df = _read(spark, f"{root}/{kind}", STATES[kind] + ENTITY).join(done.select("session", "round", "attempt", "through_seq", F.col(f"n_{kind}").alias("n")), ["session", "round", "attempt"])
        parts.append(df.groupBy("session", "round", "id").count().where("count > 1").select("session", "round", F.lit("repeated id").alias("problem")))
        counted = df.groupBy("session", "round", "n").count().where("n <> count")
        parts.append(counted.select("session", "round", F.lit("count differs").alias("problem")))
        if kind == "unresolved":
            parts.append(df.where("state not in ('open', 'resolved', 'terminal')").select("session", "round", F.lit("unknown state").alias("problem")))
        else:
            refs = F.col("evidence") if kind == "relations" else F.concat(F.array_compact(F.array("ref")), F.coalesce("refs", F.array().cast(f"array<{REF}>")))
            beyond = df.where(F.exists(refs, lambda r: r["seq"] > F.col("through_seq")))
            parts.append(beyond.select("session", "round", F.lit("place above the watermark").alias("problem")))
        if kind == "relations":
            parts.append(df.where("not tombstone and (`from` is null or `to` is null)").select("session", "round", F.lit("edge without ends").alias("problem")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole
