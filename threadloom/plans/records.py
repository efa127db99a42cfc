"""Conversion of records, digests, text, sources and index reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import operators as op
from ..functions import clip, human_bytes, micros, run_id, short_name
from .base import Tables, query

LINE = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
EV = "(SELECT *, CAST(props->>'$.k' AS INTEGER) AS k FROM events)"


@query("SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'agent' WHEN 'user' THEN 'external' ELSE 'runtime' END AS producer, CASE role WHEN 'assistant' THEN 'assistant' WHEN 'user' THEN 'user' ELSE 'system' END AS kind, CAST(strlen(text) AS INTEGER) AS bytes, 'msg/' || conv_id || '/' || turn AS id FROM conversations")
def conv_records(t: Tables) -> DataFrame:
    role = F.col("role")
    return t.conversations.select(
        "conv_id", "turn", F.when(role == "assistant", "agent").when(role == "user", "external").otherwise("runtime").alias("producer"),
        F.when(role.isin("assistant", "user"), role).otherwise("system").alias("kind"), F.octet_length("text").alias("bytes"),
        F.concat_ws("/", F.lit("msg"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
    )


@query("SELECT doc_id, substr(sha256(text), 1, 12) AS sha, CAST(strlen(text) AS INTEGER) AS bytes FROM documents")
def conv_digest(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", op.digest_of(F.col("text")).alias("sha"), F.octet_length("text").alias("bytes"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations WHERE role <> 'system' AND text <> '' GROUP BY 1")
def conv_text(t: Tables) -> DataFrame:
    parts = t.conversations.where((F.col("role") != "system") & (F.col("text") != ""))
    return parts.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text"))


@query(f"SELECT doc_id, CASE WHEN length({LINE}) > 160 THEN left({LINE}, 160) || '…' ELSE {LINE} END AS name FROM documents")
def short_names(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", short_name(F.col("text")).alias("name"))


@query("SELECT doc_id, left(text, 2000) AS clipped, length(text) > 2000 AS cut FROM documents")
def clip_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", clip(F.col("text")).alias("clipped"), (F.length("text") > 2000).alias("cut"))


@query("SELECT min(doc_id) AS doc_id, substr(sha256(text), 1, 12) AS sha, count(*) AS copies FROM documents GROUP BY text")
def dedup_content(t: Tables) -> DataFrame:
    made = t.documents.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("sha")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    return made.select("doc_id", F.left("sha", F.lit(12)).alias("sha"), "copies")


@query(f"SELECT event_id, CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'purchase' THEN 'turn' WHEN k < 50 THEN 'command' ELSE 'notice' END || '/' || event_id AS id FROM {EV} WHERE event_type IN ('error', 'purchase', 'click')")
def control_steps(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    name = F.when(kind == "error", "error").when(kind == "purchase", "turn").when(F.col("k") < 50, "command").otherwise("notice")
    return t.log.where(kind.isin("error", "purchase", "click")).select("event_id", F.concat_ws("/", name, F.col("event_id").cast("string")).alias("id"))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'message.external' ELSE 'context.injection' END AS kind, CASE WHEN role = 'user' THEN 'input/' ELSE 'inject/' END || conv_id || '/' || turn AS id FROM conversations WHERE role IN ('user', 'system')")
def inputs(t: Tables) -> DataFrame:
    outer = F.col("role") == "user"
    return t.conversations.where(F.col("role").isin("user", "system")).select(
        "conv_id", "turn", F.when(outer, "message.external").otherwise("context.injection").alias("kind"), F.concat_ws("/", F.when(outer, "input").otherwise("inject"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id")
    )


@query(f"SELECT event_id, k, CAST(k * 2 AS BIGINT) AS twice, props->>'$.none' AS none FROM {EV}")
def json_attrs(t: Tables) -> DataFrame:
    return t.log.select("event_id", "k", (F.col("k") * 2).cast("long").alias("twice"), F.get_json_object("props", "$.none").alias("none"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/?]+)', 1) AS host, translate(url, '/. ', '---') AS slug FROM pages")
def src_slug(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_extract("url", "^https?://([^/?]+)", 1).alias("host"), op.slug(F.col("url")).alias("slug"))


@query(r"SELECT doc_id, nullif(regexp_extract('build-' || source || '-wf_' || doc_id || '.js', '^.*-(wf_[A-Za-z0-9][A-Za-z0-9_-]*)\.js$', 1), '') AS run, regexp_matches('a' || left(sha256(text), 16), '^a[0-9a-f]{16}$') AS is_agent FROM documents")
def src_run_id(t: Tables) -> DataFrame:
    name = F.concat(F.lit("build-"), F.col("source"), F.lit("-wf_"), F.col("doc_id").cast("string"), F.lit(".js"))
    agent = F.concat(F.lit("a"), F.left(F.sha2(F.col("text").cast("binary"), 256), F.lit(16)))
    return t.documents.select("doc_id", run_id(name).alias("run"), agent.rlike("^a[0-9a-f]{16}$").alias("is_agent"))


@query("SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1")
def idx_kinds(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))


@query(f"SELECT k, count(*) AS n FROM {EV} GROUP BY 1 ORDER BY n DESC, k LIMIT 8")
def idx_top_tools(t: Tables) -> DataFrame:
    """The report's eight most used tools."""
    return t.log.groupBy("k").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(8)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r <= 2")
def idx_sample(t: Tables) -> DataFrame:
    """The report's sample: two records of each stream."""
    return t.events.withColumn("r", op.numbered(["user_id"], ["ts", "event_id"])).where("r <= 2").select("user_id", "event_id", "event_type")


@query(f"SELECT count(*) AS entries, count(DISTINCT user_id) AS streams, count(DISTINCT k) AS tools, round(count(*) / count(DISTINCT k), 6) AS fan_out, count(k) AS with_tool FROM {EV}")
def idx_stats(t: Tables) -> DataFrame:
    return t.log.agg(F.count("*").alias("entries"), F.count_distinct("user_id").alias("streams"), F.count_distinct("k").alias("tools"), F.round(F.count("*") / F.count_distinct("k"), 6).alias("fan_out"), F.count("k").alias("with_tool"))


@query("SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS ord, line, CASE WHEN line = '' THEN 'other' ELSE 'text' END AS kind FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations)")
def idx_blocks(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("ord", "line")).withColumn("kind", F.when(F.col("line") == "", "other").otherwise("text"))


@query("SELECT CASE WHEN url IS NULL THEN 'null' WHEN NOT regexp_matches(url, '^https?://') THEN 'scheme' WHEN html IS NULL OR html = '' THEN 'empty' ELSE 'ok' END AS status, count(*) AS n FROM pages GROUP BY 1")
def audit_headers(t: Tables) -> DataFrame:
    status = F.when(F.col("url").isNull(), "null").when(~F.col("url").rlike("^https?://"), "scheme").when(F.col("html").isNull() | (F.col("html") == ""), "empty").otherwise("ok")
    return t.pages.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN (b * 10 // 1024) // 10 || '.' || (b * 10 // 1024) % 10 || ' KiB' ELSE (b * 10 // 1048576) // 10 || '.' || (b * 10 // 1048576) % 10 || ' MiB' END AS size FROM (SELECT doc_id, strlen(text) AS b FROM documents)")
def human_sizes(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", human_bytes("octet_length(text)").alias("size"))


@query("SELECT source, round(CAST(quantile_cont(n_chars, 0.5) AS DOUBLE), 6) AS p50, round(CAST(quantile_cont(n_chars, 0.99) AS DOUBLE), 6) AS p99, max(n_chars) AS largest FROM documents GROUP BY 1")
def size_percentiles(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.round(F.percentile("n_chars", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("n_chars", F.lit(0.99)), 6).alias("p99"), F.max("n_chars").alias("largest"))


@query("SELECT event_id, epoch_us(ts) AS us, epoch_us(ts) // 1000 AS ms FROM events")
def record_times(t: Tables) -> DataFrame:
    return t.events.select("event_id", micros("ts").alias("us")).withColumn("ms", F.expr("us div 1000"))
