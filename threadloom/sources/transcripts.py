"""Transcript folders as records: discovery, landing and conversion.

Files are found by Spark, read on from their cursors by `tail`, and converted in the JVM; folders of any
number of files are read in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import first_of
from ..storage import write_table
from .matcher import matches
from .tail import APPEND, WINDOW, WINDOWS, cursors_of, lines_of, tail

__all__ = ["APPEND", "collisions", "convert", "discover", "gone", "land", "landing", "selected", "sessions"]

# Shapes of ids and the places where sources of each kind lie.
SESSION_ID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
AGENT_ID = r"a[0-9a-f]{16}"
RUN = r"wf_[A-Za-z0-9][A-Za-z0-9_-]*"
PLACES = {
    "main": rf"^([^/]+)/({SESSION_ID})()()\.jsonl$",
    "agent": rf"^([^/]+)/({SESSION_ID})/subagents/agent-({AGENT_ID})()\.jsonl$",
    "agent_of_run": rf"^([^/]+)/({SESSION_ID})/subagents/workflows/[^/]+/agent-({AGENT_ID})()\.jsonl$",
    "meta": rf"^([^/]+)/({SESSION_ID})/subagents/agent-({AGENT_ID})()\.meta\.json$",
    "meta_of_run": rf"^([^/]+)/({SESSION_ID})/subagents/workflows/[^/]+/agent-({AGENT_ID})()\.meta\.json$",
    "journal": rf"^([^/]+)/({SESSION_ID})/subagents/workflows/()([^/]+)/journal\.jsonl$",
    "manifest": rf"^([^/]+)/({SESSION_ID})/workflows/()(wf_[^/]*)\.json$",
    "script": rf"^([^/]+)/({SESSION_ID})/workflows/scripts/()[^/]*-({RUN})\.js$",
}
KIND_OF = {"agent_of_run": "agent", "meta_of_run": "meta"}

RECORD = """type STRING, uuid STRING, parentUuid STRING, timestamp STRING, promptId STRING, agentId STRING, subtype STRING,
  logicalParentUuid STRING, isCompactSummary BOOLEAN, isMeta BOOLEAN, aiTitle STRING, description STRING, workflowName STRING,
  runId STRING, result STRING, parentAgentId STRING, toolUseId STRING, origin STRUCT<kind: STRING>,
  message STRUCT<id: STRING, model: STRING, stop_reason: STRING, content: STRING,
    usage: STRUCT<input_tokens: LONG, output_tokens: LONG, cache_read_input_tokens: LONG, cache_creation_input_tokens: LONG>>,
  toolUseResult STRING, attachment STRING, _bad STRING"""
#: Fields whose shape varies, read a second time as the shape that matters: null where they have another.
SHAPED = "message STRUCT<content: ARRAY<STRING>>, toolUseResult STRUCT<agentId: STRING, toolUseId: STRING, status: STRING, runId: STRING>"
ATTACHMENT = "type STRING, commandMode STRING, origin STRUCT<kind: STRING>, text STRING, content STRING"
BLOCK = """type STRING, text STRING, thinking STRING, signature STRING, id STRING, name STRING, input STRING, tool_use_id STRING,
  content STRING, is_error BOOLEAN, source STRUCT<media_type: STRING, data: STRING>"""
PART = "struct<k:string,text:string,data:string,id:string,of:string,name:string,failed:boolean,media:string,state:string,bytes:long>"
BAD = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}


def _qualified(spark: SparkSession, root: str) -> str:
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def _files(spark: SparkSession, root: str) -> DataFrame:
    """Files below root that hold a source, with what their place says."""
    base = _qualified(spark, root)
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jsonl,json,js}").load(root)
        .withColumn("src", F.expr(f"substring(path, {len(base) + 2})"))
    )
    place = F.coalesce(*[F.when(F.col("src").rlike(shape), F.lit(name)) for name, shape in PLACES.items()])

    def part(n: int) -> Column:
        return F.nullif(F.coalesce(*[F.when(F.col("place") == name, F.regexp_extract("src", shape, n)) for name, shape in PLACES.items()]), F.lit(""))

    kind = F.coalesce(*[F.when(F.col("place") == name, F.lit(kind)) for name, kind in KIND_OF.items()], "place")
    made = found.withColumn("place", place).where(F.col("place").isNotNull()).withColumn("source_kind", kind)
    stream = F.when(F.col("place") == "main", "main").otherwise(part(3))
    return made.select("src", "path", "source_kind", part(2).alias("session"), part(1).alias("dir"), stream.alias("stream"), part(4).alias("batch"), "length")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """Sources below root: src, path, source_kind, session, dir, stream, batch, length. File contents are not read."""
    return _files(spark, root)


def selected(sources: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """The sources of sessions that the patterns let in, whole sessions at a time: by the folder of the main transcript, or, where that is gone, if any of their folders fits and none is excluded."""
    if not include and not exclude:
        return sources
    judged = sessions(sources)
    one = matches(F.col("primary"), include, exclude)
    some = F.exists("dirs", lambda d: matches(d, include)) & ~F.exists("dirs", lambda d: ~matches(d, (), exclude))
    return sources.join(judged.where(F.when(F.col("primary").isNotNull(), one).otherwise(some)).select("session"), "session", "left_semi").select(*sources.columns)


def sessions(sources: DataFrame) -> DataFrame:
    """Per session: its folders, the folder of its main transcript (null: pruned), and how many sources of each kind it has."""
    counts = [F.count_if(F.col("source_kind") == k).alias(f"n_{k}") for k in ("main", "agent", "meta", "journal", "manifest", "script")]
    return sources.groupBy("session").agg(F.array_sort(F.collect_set("dir")).alias("dirs"), F.min(F.when(F.col("source_kind") == "main", F.col("dir"))).alias("primary"), *counts)


def _target() -> list[Column]:
    return [F.col("session"), F.col("source_kind"), F.coalesce("stream", "batch").alias("target")]


def collisions(sources: DataFrame) -> DataFrame:
    """Places that more than one source would land in, with the source that does (the first by name) and how many are refused."""
    return sources.groupBy(*_target()).agg(F.min("src").alias("src"), (F.count("*") - 1).alias("refused")).where("refused > 0")


def gone(sources: DataFrame, landed: DataFrame) -> DataFrame:
    """Landed sources that are no longer there, which is no error."""
    return landed.select("session", "src").distinct().join(sources.select("src"), "src", "left_anti")


def landing(sources: DataFrame) -> DataFrame:
    """The sources that land: of those with one landing place the first by name."""
    chosen = sources.groupBy(*_target()).agg(F.min("src").alias("src")).select("src")
    return sources.join(chosen, "src", "left_semi")


def land(spark: SparkSession, root: str, cursors: DataFrame | None = None, before: DataFrame | None = None, include: Sequence[str] = (), exclude: Sequence[str] = (), window: int = WINDOW, windows: int = WINDOWS) -> tuple[DataFrame, DataFrame]:
    """(records that are new since the cursors, all new cursors) of the selected sessions below root.

    Records have their place (seq, row): one seq per session and source of this pass, in the order of names, above those of
    `before` (session, before). A source that grows lands the lines after its last; another lands anew where its content changed.
    What was read is written once, and both results read that table.
    """
    sources = write_table(landing(selected(discover(spark, root), include, exclude)), "sources")
    tailed = write_table(tail(sources, cursors, window, windows), "tail")
    lines = lines_of(tailed).join(sources.drop("path", "length"), "src")
    # one row per source is numbered, not the lines
    firsts = lines.groupBy("session", "src").agg(F.min("ord").alias("first"))
    seqs = firsts.withColumn("seq", F.row_number().over(Window.partitionBy("session").orderBy("src")).cast("long"))
    if before is not None:
        seqs = seqs.join(before, "session", "left").withColumn("seq", F.col("seq") + F.coalesce("before", F.lit(0))).drop("before")
    placed = lines.join(seqs, ["session", "src"]).withColumn("row", F.col("ord") - F.col("first") + 1).drop("first")
    return convert(placed), cursors_of(tailed)


def _part(k: str | Column, state: str | Column = "available", **fields: Column) -> Column:
    whole = {"k": F.lit(k) if isinstance(k, str) else k, "state": F.lit(state) if isinstance(state, str) else state, **fields}
    names = ["k", "text", "data", "id", "of", "name", "failed", "media", "state", "bytes"]
    return F.struct(*[whole.get(n, F.lit(None)).alias(n) for n in names]).cast(PART)


def _size(c: Column) -> Column:
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")


def _raw_part(raw: Column, why: Column | str) -> Column:
    return _part("unknown", text=F.lit(why) if isinstance(why, str) else why, data=F.to_json(F.struct(raw.alias("raw"))), bytes=_size(raw))


def _is_object(raw: Column, whole: Column, path: str) -> Column:
    """Whether the value at a path is an object, and not a string that begins with a brace."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(whole), path, "variant"))
    return F.when(F.startswith(F.ltrim(raw), F.lit("{")), F.coalesce(F.startswith(kind, F.lit("OBJECT")), F.lit(False))).otherwise(F.lit(False))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once; as an expression it is computed anew wherever it stands."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _block_part(raw: Column, enriched: Column) -> Column:
    """The part of one content block; enriched is the structured form of a result, or null."""
    return _once(F.from_json(raw, BLOCK), lambda b: _parsed_part(raw, b, enriched))


def _parsed_part(raw: Column, b: Column, enriched: Column) -> Column:
    nested = F.from_json(raw, "content ARRAY<STRING>")["content"]
    is_object = _is_object(b["content"], raw, "$.content")

    def joined(nested: Column) -> Column:
        texts = F.filter(F.transform(nested, lambda x: F.from_json(x, "text STRING")["text"]), lambda x: x.isNotNull() & (x != ""))
        return F.when(nested.isNotNull(), F.array_join(texts, "\n")).when(is_object, F.lit("")).otherwise(F.coalesce(b["content"], F.lit("")))

    def result(text: Column) -> Column:
        return _part("result", of=b["tool_use_id"], text=text, failed=b["is_error"], data=F.coalesce(enriched, F.when(text == "", b["content"])), bytes=F.when(text == "", _size(b["content"])).otherwise(_size(text)))

    thought = F.coalesce(b["thinking"], F.lit(""))
    return (
        F.when(b["type"] == "text", _part("text", text=F.coalesce(b["text"], F.lit("")), bytes=_size(b["text"])))
        .when(b["type"].isin("thinking", "redacted_thinking"), _part("reasoning", F.when(b["type"] == "redacted_thinking", "redacted").when(thought == "", "unavailable").otherwise("available"), text=thought, bytes=_size(thought)))
        .when(b["type"].isin("tool_use", "server_tool_use"), _part("call", id=b["id"], name=b["name"], data=b["input"], bytes=_size(b["input"])))
        .when(b["type"] == "tool_result", _once(_once(nested, joined), result))
        .when(b["type"] == "image", _part("media", media=b["source"]["media_type"], data=b["source"]["data"], bytes=_size(b["source"]["data"])))
        .otherwise(_raw_part(raw, F.when(b["type"].isNull(), "a block of another shape").otherwise(F.concat(F.lit("unknown block type "), b["type"]))))
    )


def _loss(raw: Column) -> Column:
    b = F.from_json(raw, "type STRING, signature STRING")
    known = b["type"].isin("thinking", "redacted_thinking") & (F.coalesce(b["signature"], F.lit("")) != "")
    return F.when(known, F.struct(F.lit("reasoning signature").alias("what"), _size(b["signature"]).alias("bytes"), F.lit("opaque to readers").alias("why")))


def nanoseconds(time: Column) -> Column:
    """Nanoseconds since 1970 of an RFC 3339 time, to the microsecond; null where it is none."""
    shape = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
    return F.when(time.rlike(shape), F.unix_micros(F.try_to_timestamp(time)) * 1000)


def convert(lines: DataFrame) -> DataFrame:
    """Payloads as records: ids, links, flags, usage and parts. A payload that is not JSON is one unknown part; a null or empty one too."""
    kind = F.col("source_kind")
    df = lines.withColumn("d", F.from_json("payload", RECORD, BAD)).withColumn("s", F.from_json("payload", SHAPED))
    df = df.withColumn("a", F.from_json("d.attachment", ATTACHMENT))
    d, a, result, blocks = F.col("d"), F.col("a"), F.col("s.toolUseResult"), F.col("s.message.content")
    # the JSON value null is a record that says nothing
    good = ((d.isNotNull() & d["_bad"].isNull() & (F.trim("payload") != "")) | (F.trim("payload") == "null")) & (kind != "script")
    content, typ = d["message"]["content"], d["type"]
    has_result = result.isNotNull() & good
    is_text = blocks.isNull() & content.isNotNull() & ~_is_object(content, F.col("payload"), "$.message.content")

    def set_(c: Column) -> Column:
        return F.nullif(c, F.lit(""))

    def of_record(c: Column) -> Column:
        return F.when(good, c)

    no_meta, data_only = ~kind.isin("meta", "journal"), kind == "manifest"
    notice = F.when(is_text & F.contains(content, F.lit("<task-notification>")), content)
    notice_tool = set_(F.trim(F.regexp_extract(notice, r"(?s)<tool-use-id>(.*?)</tool-use-id>", 1)))
    notice_child = F.get(F.filter(F.transform(F.regexp_extract_all(notice, F.lit(r"(?s)<task-id>(.*?)</task-id>"), F.lit(1)), lambda x: F.trim(x)), lambda x: x.rlike(f"^{AGENT_ID}$")), F.lit(0))
    tool = F.coalesce(F.when(kind != "journal", set_(result["toolUseId"])), notice_tool)
    child = F.coalesce(F.when(kind == "meta", first_of(d["agentId"], F.col("stream"))).when(kind == "journal", set_(d["agentId"])).otherwise(set_(result["agentId"])), notice_child)
    caused = first_of(d["origin"]["kind"], a["origin"]["kind"])
    trigger = F.when(caused == "human", "external").when(caused == "task-notification", "notification").when(caused.isNotNull(), "unknown")
    queued = (typ == "attachment") & (a["type"] == "queued_command") & (a["commandMode"] == "prompt")
    meta = F.coalesce(d["isMeta"], F.lit(False))
    system, subtype = typ == "system", F.coalesce(d["subtype"], F.lit(""))
    flags = {
        "synthetic": (typ == "assistant") & (d["message"]["model"] == "<synthetic>"), "finished": (typ == "assistant") & (d["message"]["stop_reason"] != ""),
        "context_reset": system & (subtype == "compact_boundary"), "error": system & (subtype == "api_error"),
        "turn_duration": system & (subtype == "turn_duration"), "command": system & (subtype == "local_command"),
        "notice": system & ~subtype.isin("compact_boundary", "api_error", "turn_duration", "local_command"), "reset_summary": d["isCompactSummary"],
        "child_result": ((kind == "journal") & d["result"].isNotNull()) | (has_result & F.coalesce(result["status"] == "completed", F.lit(False))),
        "launch_ack": has_result & (result["status"] == "async_launched"),
        "external_input": (F.coalesce(queued, F.lit(False)) | F.coalesce((typ == "user") & (d["origin"]["kind"] == "human"), F.lit(False))) & ~meta & no_meta,
        "injected": ((typ == "attachment") & ~F.coalesce(queued, F.lit(False))) | meta,
    }
    producer = F.when(kind.isin("meta", "journal", "manifest", "script"), "runtime").when(good & (typ == "assistant"), "agent").when(good & (typ == "user"), "external").otherwise("runtime")
    attached = F.when(set_(a["text"]).isNotNull(), a["text"]).when(
        a["content"].isNotNull() & F.from_json("d.attachment", "content ARRAY<STRING>")["content"].isNull() & ~_is_object(a["content"], d["attachment"], "$.content"), a["content"]
    ).otherwise(F.lit(""))
    whole = F.array(_part("data", data=F.col("payload"), bytes=_size(F.col("payload"))))
    enriched = F.when(has_result, d["toolUseResult"])
    said = (
        F.when(typ == "attachment", F.array(F.when(attached != "", _part("text", text=attached, bytes=_size(attached))).otherwise(_part("data", data=d["attachment"], bytes=_size(d["attachment"])))))
        .when(blocks.isNotNull(), F.transform(blocks, lambda x: _block_part(x, enriched)))
        .when(is_text, F.array(_part("text", text=content, bytes=_size(content))))
        .when(content.isNotNull(), F.array(_raw_part(content, "content of another shape")))
    )
    # whether that has a part, without making the parts
    says = F.when(typ == "attachment", F.lit(True)).when(blocks.isNotNull(), F.size(blocks) > 0).otherwise(content.isNotNull())
    parts = (
        F.when(kind == "script", F.array(_raw_part(F.col("payload"), "program text"))).when(data_only, whole)
        .when(~good, F.array(_raw_part(F.col("payload"), "line is no JSON object"))).when(says, said).otherwise(whole)
    )
    dropped = F.when(good & ~data_only & (F.coalesce(typ, F.lit("")) != "attachment"), F.filter(F.transform(blocks, _loss), lambda x: x.isNotNull()))
    usage = d["message"]["usage"]
    body = good & ~data_only  # a manifest gives only its name and run

    def of_body(c: Column) -> Column:
        return F.when(body, c)

    return df.select(
        "session", "seq", "row", "src", "source_kind", "dir", "stream", "ord", "off", "sha", "bytes",
        F.coalesce(of_body(set_(result["runId"])), F.when(data_only, of_record(set_(d["runId"]))), F.col("batch")).alias("batch"),
        of_body(set_(d["uuid"])).alias("id"), of_body(set_(d["parentUuid"])).alias("parent"), of_body(set_(d["message"]["id"])).alias("call"), of_body(set_(d["promptId"])).alias("run"),
        of_body(set_(d["logicalParentUuid"])).alias("continues"), of_body(tool).alias("tool"), of_body(child).alias("child"),
        of_record(F.when(data_only, set_(d["workflowName"])).otherwise(first_of(d["aiTitle"], d["description"], d["workflowName"]))).alias("label"),
        of_body(set_(d["parentAgentId"])).alias("started_by"), producer.alias("producer"), of_body(set_(d["timestamp"])).alias("time"), of_body(nanoseconds(d["timestamp"])).alias("ts_ns"), of_body(trigger).alias("trigger"),
        F.array_compact(F.array(*[F.when(body & F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in flags.items()])).alias("flags"),
        of_body(F.when(usage.isNotNull(), F.struct(usage["input_tokens"].alias("input"), usage["output_tokens"].alias("output"), usage["cache_read_input_tokens"].alias("cache_read"), usage["cache_creation_input_tokens"].alias("cache_write")))).alias("usage"),
        parts.alias("parts"), dropped.alias("dropped"),
    )
