"""Streams, epochs, talks, segments and walks over the event log and the conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import operators as op
from ..functions import micros
from .base import Tables, query

USER, WHEN = ["user_id"], ["ts", "event_id"]
OVER = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
UPTO = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
GAP = "12 hours"
SEGMENTS = f"(SELECT *, CAST(sum(CASE WHEN ts - p > INTERVAL '12' HOUR THEN 1 ELSE 0 END) {UPTO} AS BIGINT) AS segment FROM (SELECT *, lag(ts) {OVER} AS p FROM events))"


@query("SELECT user_id, count(*) AS n, min(event_id) AS first_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM events GROUP BY 1")
def streams_summary(t: Tables) -> DataFrame:
    rows = t.events.withColumn("us", micros("ts"))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS title FROM events WHERE event_type <> 'view' GROUP BY 1")
def latest_title(t: Tables) -> DataFrame:
    return t.events.where(F.col("event_type") != "view").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("title"))


@query(f"SELECT event_id, user_id, coalesce(CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) {UPTO} AS BIGINT), 0) AS epoch, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) {UPTO} AS boundary FROM events")
def epoch_cut(t: Tables) -> DataFrame:
    opens = F.col("event_type") == "signup"
    return t.events.select("event_id", "user_id", op.cut_before(opens, USER, WHEN).alias("epoch"), op.carried(F.when(opens, F.col("event_id")), USER, WHEN).alias("boundary"))


@query(f"SELECT event_id AS boundary, user_id, lag(event_id) {OVER} AS follows FROM events WHERE event_type = 'signup'")
def epoch_follows(t: Tables) -> DataFrame:
    opens = t.events.where(F.col("event_type") == "signup")
    return opens.select(F.col("event_id").alias("boundary"), "user_id", op.previous("event_id", USER, WHEN).alias("follows"))


@query("SELECT l.event_id, l.k AS summary_of, r.event_id IS NOT NULL AS found FROM (SELECT event_id, user_id, CAST(props->>'$.k' AS INTEGER) AS k FROM events WHERE event_type = 'error') l LEFT JOIN (SELECT event_id FROM events WHERE event_type = 'signup') r ON r.event_id = l.k")
def epoch_summary(t: Tables) -> DataFrame:
    said = t.log.where(F.col("event_type") == "error").select("event_id", F.col("k").alias("summary_of"))
    opens = t.events.where(F.col("event_type") == "signup").select(F.col("event_id").alias("boundary"))
    return said.join(opens, F.col("boundary") == F.col("summary_of"), "left").select("event_id", "summary_of", F.col("boundary").isNotNull().alias("found"))


@query("SELECT event_id, k FROM (SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k FROM events WHERE event_type = 'signup') WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_id = k AND e.event_type <> 'view')")
def epoch_continuation(t: Tables) -> DataFrame:
    opens = t.log.where(F.col("event_type") == "signup").select("event_id", "k")
    known = t.events.where(F.col("event_type") != "view").select(F.col("event_id").alias("known"))
    return op.missing(opens, known, F.col("known") == F.col("k"))


@query(f"SELECT event_id, user_id, last_value(CASE WHEN event_type IN ('signup', 'view') THEN event_id END IGNORE NULLS) {UPTO} AS talk FROM events")
def talk_assign(t: Tables) -> DataFrame:
    starts = F.col("event_type").isin("signup", "view")
    return t.events.select("event_id", "user_id", op.carried(F.when(starts, F.col("event_id")), USER, WHEN).alias("talk"))


@query(f"SELECT event_id, CASE WHEN talk IS NOT NULL THEN 'talk/' || talk WHEN boundary IS NOT NULL THEN 'epoch/' || boundary ELSE 'stream/' || user_id END AS container FROM (SELECT event_id, user_id, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) {UPTO} AS talk, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) {UPTO} AS boundary FROM events)")
def talk_container(t: Tables) -> DataFrame:
    talk = op.carried(F.when(F.col("event_type") == "view", F.col("event_id")), USER, WHEN)
    epoch = op.carried(F.when(F.col("event_type") == "signup", F.col("event_id")), USER, WHEN)
    return t.events.select("event_id", F.coalesce(F.concat(F.lit("talk/"), talk.cast("string")), F.concat(F.lit("epoch/"), epoch.cast("string")), F.concat(F.lit("stream/"), F.col("user_id").cast("string"))).alias("container"))


@query(f"SELECT user_id, segment, count(*) AS n, epoch_us(min(ts)) AS from_us, epoch_us(max(ts)) AS to_us FROM {SEGMENTS} GROUP BY 1, 2")
def segment_cut(t: Tables) -> DataFrame:
    return _segments(t).drop("open_errors", "first_id")


def _segments(t: Tables) -> DataFrame:
    rows = op.gap_segments(t.events, USER, "ts", WHEN, GAP).withColumn("us", micros("ts"))
    return rows.groupBy("user_id", "segment").agg(
        F.count("*").alias("n"), F.min("us").alias("from_us"), F.max("us").alias("to_us"), F.count_if(F.col("event_type") == "error").alias("open_errors"), F.min("event_id").alias("first_id")
    )


@query(f"SELECT user_id, segment, 'segment/at_' || first_id AS id, to_us - from_us AS span_us, n FROM (SELECT user_id, segment, min(event_id) AS first_id, epoch_us(min(ts)) AS from_us, epoch_us(max(ts)) AS to_us, count(*) AS n FROM {SEGMENTS} GROUP BY 1, 2)")
def segment_rows(t: Tables) -> DataFrame:
    return _segments(t).select("user_id", "segment", F.concat(F.lit("segment/at_"), F.col("first_id").cast("string")).alias("id"), (F.col("to_us") - F.col("from_us")).alias("span_us"), "n")


@query("SELECT a.event_id AS segment, b.event_id AS child FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL '2' HOUR WHERE a.event_type = 'signup' AND b.event_type = 'error'")
def segment_children(t: Tables) -> DataFrame:
    """The equi key and two buckets of time make this a hash join: a child is in the opener's bucket or the next one."""
    width = 7_200_000_000
    opens = t.events.where(F.col("event_type") == "signup").select("user_id", F.col("event_id").alias("segment"), micros("ts").alias("from_us"))
    opens = opens.withColumn("bucket", F.explode(F.array(F.floor(F.col("from_us") / width), F.floor(F.col("from_us") / width) + 1)))
    errors = t.events.where(F.col("event_type") == "error").select("user_id", F.col("event_id").alias("child"), micros("ts").alias("us")).withColumn("bucket", F.floor(F.col("us") / width))
    return opens.join(errors, ["user_id", "bucket"]).where(F.col("us").between(F.col("from_us"), F.col("from_us") + width)).select("segment", "child")


TALK = "(SELECT conv_id, turn, role, text, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS talk FROM conversations)"


def _talks(t: Tables) -> DataFrame:
    starts = F.when(F.col("role") == "user", F.col("turn"))
    return t.conversations.withColumn("talk", op.carried(starts, ["conv_id"], ["turn"]))


@query("SELECT conv_id, turn, bool_or(role = 'user') AS any_external, count(role) > 0 AS stated FROM conversations GROUP BY 1, 2")
def run_triggers(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id", "turn").agg(F.bool_or(F.col("role") == "user").alias("any_external"), (F.count("role") > 0).alias("stated"))


@query(f"SELECT conv_id, talk, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n_steps FROM {TALK} WHERE talk IS NOT NULL GROUP BY 1, 2")
def talk_summary(t: Tables) -> DataFrame:
    return _talks(t).where("talk is not null").groupBy("conv_id", "talk").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n_steps"))


@query("""WITH RECURSIVE r(conv_id, turn, cur, role, hop) AS (SELECT conv_id, turn, turn, role, 0 FROM conversations UNION ALL
  SELECT r.conv_id, r.turn, c.turn, c.role, r.hop + 1 FROM r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn = r.cur - 1 WHERE r.role <> 'user' AND r.hop < 64)
  SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN cur END) AS ancestor, CAST(max(CASE WHEN role = 'user' THEN hop END) AS BIGINT) AS hops FROM r GROUP BY 1, 2""")
def walk_back(t: Tables) -> DataFrame:
    rows = t.turns.select("conv_id", "turn", "role", "parent_turn", F.col("conv_id").alias("parent_conv"))
    found = op.nearest_ancestor(rows, ["conv_id", "turn"], ["parent_conv", "parent_turn"], F.col("role") == "user")
    return found.select("conv_id", "turn", F.col("anc")["turn"].alias("ancestor"), "hops")


@query(f"SELECT conv_id, talk, count(*) AS n_steps, count(CASE WHEN role = 'assistant' THEN 1 END) AS n_replies, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM {TALK} WHERE talk IS NOT NULL GROUP BY 1, 2")
def talk_rollup(t: Tables) -> DataFrame:
    return _talks(t).where("talk is not null").groupBy("conv_id", "talk").agg(F.count("*").alias("n_steps"), F.count_if(F.col("role") == "assistant").alias("n_replies"), F.sum(F.octet_length("text").cast("long")).alias("n_bytes"))


@query(f"SELECT conv_id, turn, role AS kind, talk, CASE WHEN role = 'user' OR talk IS NULL THEN NULL ELSE talk END AS parent, CASE WHEN role = 'user' OR talk IS NULL THEN 1 ELSE 2 END AS depth, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 40) AS name FROM {TALK}")
def view_flow(t: Tables) -> DataFrame:
    from ..functions import one_line

    top = (F.col("role") == "user") | F.col("talk").isNull()
    return _talks(t).select("conv_id", "turn", F.col("role").alias("kind"), "talk", F.when(~top, F.col("talk")).alias("parent"), F.when(top, 1).otherwise(2).alias("depth"), F.left(one_line(F.col("text")), F.lit(40)).alias("name"))


@query(f"SELECT conv_id, count(*) AS steps, count(DISTINCT talk) AS talks, min(turn) AS from_turn, max(turn) AS to_turn, arg_min(left(text, 40), turn) FILTER (role = 'user') AS title, count(CASE WHEN talk IS NULL THEN 1 END) AS loose FROM {TALK} GROUP BY 1")
def view_conversations(t: Tables) -> DataFrame:
    return _talks(t).groupBy("conv_id").agg(
        F.count("*").alias("steps"), F.count_distinct("talk").alias("talks"), F.min("turn").alias("from_turn"), F.max("turn").alias("to_turn"),
        F.min_by(F.when(F.col("role") == "user", F.left("text", F.lit(40))), F.when(F.col("role") == "user", F.col("turn"))).alias("title"), F.count_if(F.col("talk").isNull()).alias("loose"),
    )


@query("SELECT conv_id, role AS kind, count(*) AS n FROM conversations GROUP BY 1, 2")
def view_overview(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id", F.col("role").alias("kind")).agg(F.count("*").alias("n"))


@query(f"SELECT conv_id, min(talk) AS first_talk, count(*) AS steps, count(DISTINCT talk) AS talks FROM {TALK} GROUP BY 1")
def stream_rows(t: Tables) -> DataFrame:
    return _talks(t).groupBy("conv_id").agg(F.min("talk").alias("first_talk"), F.count("*").alias("steps"), F.count_distinct("talk").alias("talks"))


@query(f"SELECT conv_id, talk, arg_min(left(text, 2000), turn) AS opening, arg_max(left(text, 2000), turn) FILTER (role = 'assistant') AS reply FROM {TALK} WHERE talk IS NOT NULL GROUP BY 1, 2")
def talk_labels(t: Tables) -> DataFrame:
    from ..functions import clip

    said = F.col("role") == "assistant"
    return _talks(t).where("talk is not null").groupBy("conv_id", "talk").agg(F.min_by(clip(F.col("text")), "turn").alias("opening"), F.max_by(F.when(said, clip(F.col("text"))), F.when(said, F.col("turn"))).alias("reply"))


@query("SELECT conv_id, turn, text FROM conversations JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) ON doc_id = conv_id WHERE role <> 'system'")
def view_texts(t: Tables) -> DataFrame:
    wanted = t.labels.where("toxic = 1").select(F.col("doc_id").alias("conv_id"))
    return t.conversations.where(F.col("role") != "system").join(wanted, "conv_id", "left_semi").select("conv_id", "turn", "text")


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN p IS NULL THEN 'first' WHEN turn = p + 1 THEN 'ok' WHEN turn <= p THEN 'relanded' ELSE 'gap' END AS status FROM (SELECT turn, max(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM conversations)) GROUP BY 1")
def audit_contiguity(t: Tables) -> DataFrame:
    return op.contiguity(t.conversations, ["conv_id"], "turn", ["turn"]).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT conv_id, count(*) AS records, CAST(sum(strlen(text)) AS BIGINT) AS bytes, max(turn) + 1 - count(*) AS missing FROM conversations GROUP BY 1")
def audit_session(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("records"), F.sum(F.octet_length("text").cast("long")).alias("bytes"), (F.max("turn") + 1 - F.count("*")).alias("missing"))


@query("SELECT coalesce(role, '*') AS kind, count(*) AS n FROM conversations GROUP BY ROLLUP (role)")
def rollup_kinds(t: Tables) -> DataFrame:
    return t.conversations.rollup("role").agg(F.count("*").alias("n")).select(F.coalesce("role", F.lit("*")).alias("kind"), "n")


@query("SELECT count(*) AS records, count(DISTINCT conv_id) AS sessions, count(CASE WHEN role = 'user' THEN 1 END) AS external, count(CASE WHEN role = 'assistant' THEN 1 END) AS steps, count(CASE WHEN text IS NULL OR text = '' THEN 1 END) AS empty FROM conversations")
def assembly_stats(t: Tables) -> DataFrame:
    return t.conversations.agg(
        F.count("*").alias("records"), F.count_distinct("conv_id").alias("sessions"), F.count_if(F.col("role") == "user").alias("external"), F.count_if(F.col("role") == "assistant").alias("steps"),
        F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("empty"),
    )
