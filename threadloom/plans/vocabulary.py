"""The closed vocabulary of nodes, relations and qualities, with what transcripts call each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = ["FIELDS", "TERMS", "fields", "glossary", "rendered"]

# Each name of the model, and the field or value of a transcript that it comes from (empty: it is derived).
TERMS = {
    "role": {
        "id": "uuid", "parent": "parentUuid", "call": "message.id", "run": "promptId", "batch": "toolUseResult.runId", "stream": "agentId", "continues": "logicalParentUuid",
        "tool": "tool_use_id", "child": "toolUseResult.agentId", "time": "timestamp", "trigger": "origin.kind",
    },
    "structure": {"conversation": "", "segment": "", "session": "sessionId", "stream": "agentId", "epoch": "", "talk": "", "run": "promptId"},
    "step": {
        "message.external": 'origin.kind == "human"', "message.assistant": "text block", "message.synthetic": 'message.model == "<synthetic>"', "context.injection": "attachment",
        "llm.call": "message.id", "thinking": "thinking block", "tool": "tool_use + tool_result", "agent.call": "Agent, Skill or Workflow tool_use",
        "agent.launch_ack": 'toolUseResult.status == "async_launched"', "agent.output": "", "runtime.notification": "<task-notification>", "epoch.boundary": "system/compact_boundary",
        "epoch.summary": "isCompactSummary", "error.api": "system/api_error", "control.interrupt": "toolUseResult.interrupted", "control.permission": "permission-mode",
        "control.command": "system/local_command", "turn.duration": "system/turn_duration", "control.notice": "any other system record",
    },
    "relation": {
        "starts": "toolUseResult.agentId, or a run journal", "reports": "<task-notification>", "ends_with": "", "result_of": "tool_use_id", "follows": "logicalParentUuid",
        "summarizes": "parentUuid", "in_segment": "", "retries": "", "cancels": "toolUseResult.interrupted", "input_of": "",
    },
    "quality": {"exact_unique": "", "exact_ambiguous": "", "strong_inference": "", "weak_inference": "", "unresolved": "", "conflict": ""},
    "content": {"available": "", "redacted": "redacted_thinking", "omitted": "", "hash_only": "", "size_only": "", "truncated": "", "unavailable": ""},
    "trigger": {"external": 'origin.kind == "human"', "notification": 'origin.kind == "task-notification"', "unknown": ""},
    "stream role": {"main": "", "child": "", "auxiliary": "", "judge": ""},
}


def glossary(spark: SparkSession) -> DataFrame:
    """Every name of the model: its group, the unified name, the native one (the unified one where there is none), and whether it is derived."""
    rows = [(group, name, native or name, not native) for group, names in TERMS.items() for name, native in names.items()]
    return spark.createDataFrame(rows, "term_group string, unified string, native string, derived boolean")


#: What each field of a landed record holds.
FIELDS = {
    "session": "the conversation", "seq": "the pass and source that landed it, from 1 in each session", "row": "its place in that landing, from 1", "src": "the source file, below the source root",
    "source_kind": "main, agent, meta, journal, manifest or script", "dir": "the folder that holds the session", "stream": "main, or the child it belongs to", "ord": "the line of the source, from 1", "off": "the byte at which the line starts",
    "sha": "the first 12 digits of the SHA-256 of its bytes", "bytes": "its size in the source", "batch": "the run of a workflow that it belongs to or launched", "id": "its own id", "parent": "the id of the record it follows",
    "call": "the provider call it is a fragment of", "run": "the prompt cycle it states", "continues": "the record that a reset goes on from", "tool": "the tool use it is about", "child": "the child stream it is about",
    "label": "a title or description that it carries", "started_by": "the stream that started its child", "producer": "agent, external or runtime", "time": "the time it states", "ts_ns": "that time in nanoseconds since 1970",
    "trigger": "what set it off: external, notification or unknown", "flags": "facts without a field of their own", "usage": "tokens: input, output, cache_read, cache_write", "parts": "its pieces in order: text, reasoning, call, result, media, data or unknown",
    "dropped": "what was left out: its name, size and why",
}


def fields(spark: SparkSession) -> DataFrame:
    """What each field of a landed record holds."""
    return spark.createDataFrame(list(FIELDS.items()), "field string, meaning string")


def rendered(name: Column, terms: str = "unified") -> Column:
    """A name of the model as readers want it: unified; native, where there is one; or both, the native one in brackets. Other names stay as they are."""
    if terms not in ("unified", "native", "both"):
        raise ValueError(f"terms are unified, native or both, not {terms!r}")
    known = {u: n for names in TERMS.values() for u, n in names.items() if n and n != u}
    if terms == "unified":
        return name
    native = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[name]
    return F.coalesce(native if terms == "native" else F.concat(name, F.lit("  ("), native, F.lit(")")), name)
