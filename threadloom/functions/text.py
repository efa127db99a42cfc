"""Text, time, identity and JSON expressions, all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["clip", "entity_id", "first_of", "human_bytes", "journal_name", "landed_name", "landed_seq", "micros", "one_line", "readable", "record_uuid", "run_id", "short_id", "short_name", "stamp", "truncated"]

#: Fixed value: the form of a workflow run id, after the last -wf_ of a script's name.
RUN_ID = r"^.*-(wf_[A-Za-z0-9][A-Za-z0-9_-]*)\.js$"


def entity_id(*parts: Column | str) -> Column:
    """Parts joined by /, empty ones left out, their own / as _."""
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.concat_ws("/", *[F.nullif(F.replace(c, F.lit("/"), F.lit("_")), F.lit("")) for c in cols])


def first_of(*cols: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def short_name(text: Column, most: int = 160) -> Column:
    """One line of at most so many characters, with an ellipsis where it was cut."""
    line = one_line(text)
    return F.when(F.length(line) > most, F.concat(F.left(line, F.lit(most)), F.lit("…"))).otherwise(line)


def clip(text: Column, most: int = 2000) -> Column:
    """The first characters; never cuts one in two."""
    return F.left(text, F.lit(most))


def micros(column: str) -> Column:
    """Microseconds since 1970 of a column of timestamps without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{column}`)")


def run_id(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, RUN_ID, 1), F.lit(""))


def human_bytes(n: str) -> Column:
    """Bytes of an SQL expression in B, KiB, MiB or GiB, tenths rounded down."""

    def tenths(unit: int) -> str:
        part = f"(cast({n} as bigint) * 10 div {unit})"
        return f"concat({part} div 10, '.', {part} % 10"

    return F.expr(f"case when {n} < 1024 then concat({n}, ' B') when {n} < {1 << 20} then {tenths(1024)}, ' KiB') when {n} < {1 << 30} then {tenths(1 << 20)}, ' MiB') else {tenths(1 << 30)}, ' GiB') end")


def truncated(text: Column, most: int) -> Column:
    """The text, or its first characters and an ellipsis, at most so many in all. Null stays null."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("…"))).otherwise(text)


def short_id(id_: Column) -> Column:
    """What follows the last / of an id, at most 22 characters."""
    return truncated(F.substring_index(id_, "/", -1), 22)


def stamp(time: Column) -> Column:
    """A timestamp as a name that sorts: 20240131T235959.123456000Z, in UTC. Null stays null."""
    utc = F.to_utc_timestamp(time, F.current_timezone())
    return F.concat(F.date_format(utc, "yyyyMMdd'T'HHmmss.SSSSSS"), F.lit("000Z"))


def landed_name(prefix: Column, time: Column, seq: Column) -> Column:
    """The name of a landed file: prefix, stamp and a sequence of six digits at least."""
    number = seq.cast("string")
    return F.concat(prefix, F.lit("-"), stamp(time), F.lit("-"), F.lpad(number, F.greatest(F.length(number), F.lit(6)), F.lit("0")), F.lit(".sd"))


def landed_seq(name: Column) -> Column:
    """The sequence that a landed file's name ends with; null if it is no such name."""
    return F.nullif(F.regexp_extract(name, r"-(\d{6,})\.sd$", 1), F.lit("")).cast("long")


def record_uuid(line: Column) -> Column:
    """The uuid that a line states, found without parsing it; null if there is none."""
    return F.nullif(F.regexp_extract(line, r'"uuid"\s*:\s*"([^"\\]+)"', 1), F.lit(""))


def readable(parts: str) -> Column:
    """What a person would read in a list of parts: texts one below the other, or else the prompts of the first queued command."""
    texts = F.trim(F.array_join(F.transform(F.filter(parts, lambda p: (p["k"] == "text") & (p["text"] != "")), lambda p: p["text"]), "\n"))

    def prompts(p: Column) -> Column:
        said = F.from_json(F.coalesce(p["data"], p["text"]), "type STRING, prompt ARRAY<STRUCT<text: STRING>>")
        kept = F.filter(said["prompt"]["text"], lambda x: x != "")
        return F.when((said["type"] == "queued_command") & (F.size(kept) > 0), F.trim(F.array_join(kept, "\n")))

    queued = F.get(F.array_compact(F.transform(parts, prompts)), F.lit(0))
    return F.coalesce(F.nullif(texts, F.lit("")), queued, F.lit(""))


def journal_name(said: Column) -> Column:
    """The name in a journal's result: its surface, else its summary, else its verdict with the first refuted claim; null if it has none."""
    row = F.from_json(said, "type STRING, result STRUCT<surface: STRING, summary: STRING, verdict: STRING, refuted_claims: ARRAY<STRUCT<claim: STRING>>>")
    found = row["result"]
    claim = F.nullif(F.get(found["refuted_claims"], F.lit(0))["claim"], F.lit(""))
    verdict = F.nullif(found["verdict"], F.lit(""))
    name = F.coalesce(F.nullif(found["surface"], F.lit("")), F.nullif(found["summary"], F.lit("")), F.when(claim.isNotNull(), F.concat(verdict, F.lit(" · "), claim)).otherwise(verdict))
    return F.when(row["type"] == "result", F.nullif(short_name(name), F.lit("")))
