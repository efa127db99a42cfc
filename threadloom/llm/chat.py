"""Chat formatting: a hidden Markov model recovers the roles of a transcript's turns.

States are the roles; observations are features of a turn's lines (speaker marker,
lengths, number of lines, closing sign). Viterbi finds the best role sequence of
each conversation, and turns are rendered in one canonical form, markers taken off.
Parameters are smoothed counts over all labelled turns outside the held-out fold.

Turns are range-sorted by conversation and place, so one conversation may fill many
partitions. Each partition keeps its conversations whole but for its first and
last, and reports for those one small transition matrix; the driver chains these
(a few numbers per partition) into what enters and what follows each partition,
after which every partition finishes its own part of the exact Viterbi path.

``parse_transcripts`` takes texts that hold whole transcripts. There the line is the step: each role has a
state for lines that begin a turn and one for lines that go on with it, a line is seen
by its speaker marker, length and signs, and every run of lines that Viterbi recovers is rendered as one turn.

Defined results of ``recover``: one row per input row; a null text is an empty one; a null
conversation is one conversation, a null turn comes first; equal turns are in
order of their texts, and repeated rows stay; null roles teach nothing; without any known role every turn
is ``user``; an empty table gives no rows; texts are read whole; other columns are
not carried, so names cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, held_out, pick, write_table

#: Words that name a speaker, by role.
SPEAKERS = {"user": ("user", "human", "question", "customer"), "assistant": ("assistant", "ai", "bot", "answer", "agent"), "system": ("system", "instructions")}
MARKER = re.compile(r"\s*(?:[#*>\[(<|]+\s*)?(" + "|".join(w for ws in SPEAKERS.values() for w in ws) + r")(?:\s*[\])>|*]+\s*:?|\s*:)\s*", re.IGNORECASE)
ROLE_OF = {w: r for r, ws in SPEAKERS.items() for w in ws}
SMOOTH = 0.5
START, END = "<|{}|>\n", "\n<|end|>"


def observe(text: str | None) -> tuple[str | int, ...]:
    """The features of a turn."""
    text = text or ""
    found = MARKER.match(text)
    lines = text.splitlines()
    first = lines[0] if lines else ""
    last = text.rstrip()[-1:]
    return (
        ROLE_OF[found[1].lower()] if found else "none", len(text).bit_length(), len(first).bit_length(), min(len(lines), 12),
        last if last in ".?!:;" else "other", any(x.lstrip()[:1] in ("-", "*", "#", "`") for x in lines),
    )


def observe_line(line: str) -> tuple[str | int, ...]:
    """The features of a line besides its marker."""
    last = line.rstrip()[-1:]
    return len(line).bit_length(), last if last in ".?!:;" else "other", line.lstrip()[:1] in ("-", "*", "#", "`")


def render(role: str, text: str | None) -> str:
    """The canonical turn: its role, its text without speaker marker, line ends as \\n, no space at ends of lines."""
    text = text or ""
    found = MARKER.match(text)
    body = "\n".join(x.rstrip() for x in text[found.end() if found else 0 :].strip().splitlines())
    return START.format(role) + body + END


class Model:
    """Log shares: of first roles, of changes, and of each feature's values by role."""

    def __init__(self, counts: Counter):
        self.roles = sorted({k[1] for k in counts if k[0] == "role"}) or ["user"]
        k = len(self.roles)
        at = {r: i for i, r in enumerate(self.roles)}
        first, moves = np.full(k, SMOOTH), np.full((k, k), SMOOTH)
        self.seen: dict[tuple, np.ndarray] = {}
        self.lines: dict[tuple, np.ndarray] = {}  # counts of lines' features by role
        totals: dict[int, np.ndarray] = {}
        for key, n in counts.items():
            if key[0] == "first":
                first[at[key[1]]] += n
            elif key[0] == "move":
                moves[at[key[1]], at[key[2]]] += n
            elif key[0] == "seen":
                self.seen.setdefault(key[1:3], np.zeros(k))[at[key[3]]] += n
                totals.setdefault(key[1], np.zeros(k))[at[key[3]]] += n
            elif key[0] == "line":
                self.lines.setdefault(key[1:3], np.zeros(k))[at[key[3]]] += n
        self.first, self.moves = np.log(first / first.sum()), np.log(moves / moves.sum(1, keepdims=True))
        self.none = {f: np.log(SMOOTH / (t + SMOOTH * 20)) for f, t in totals.items()}
        self.seen = {fv: np.log((n + SMOOTH) / (totals[fv[0]] + SMOOTH * 20)) for fv, n in self.seen.items()}

    def emit(self, text: str | None) -> np.ndarray:
        zero = np.zeros(len(self.roles))
        return sum((self.seen.get((f, str(v)), self.none.get(f, zero)) for f, v in enumerate(observe(text))), zero)

    def through(self, scores: np.ndarray) -> np.ndarray:
        """What turns with these scores make of each role before them: roles by roles."""
        m = np.where(np.eye(len(self.roles), dtype=bool), 0.0, -np.inf)
        for e in scores:
            m = (m[:, :, None] + self.moves[None]).max(1) + e
        return m

    def path(self, scores: np.ndarray, before: np.ndarray | None, after: np.ndarray | None) -> list[int]:
        """The best roles, given what came before (scores of the last role before) and what follows (by the last role here)."""
        v = scores[0] + (self.first if before is None else (before[:, None] + self.moves).max(0))
        back = []
        for e in scores[1:]:
            step = v[:, None] + self.moves
            back.append(step.argmax(0))
            v = step.max(0) + e
        out = [int((v if after is None else v + after).argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]


def sort_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, part) as a written table, where each part is one sorted run of turns."""
    rows = pick(turns, conv_col, turn_col, role_col, text_col).toDF("conv_id", "turn", "role", "text")
    rows = rows.withColumns({"conv_id": F.col("conv_id").cast("long"), "turn": F.col("turn").cast("long")})
    order = rows.repartitionByRange("conv_id", "turn", F.xxhash64("text"), F.monotonically_increasing_id()).sortWithinPartitions("conv_id", "turn", F.xxhash64("text"))
    return write_table(order.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "turns")


def by_part(stored: DataFrame, *cols: str) -> DataFrame:
    """The parts again, each whole and sorted in one task."""
    return stored.select(*cols, "part", "place").repartition("part").sortWithinPartitions("part", "place")


def parts(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[int, list[tuple]]]:
    """(part, its rows) for each part of a task."""
    part, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[at] != part and rows:
                yield part, rows
                rows = []
            part = row[at]
            rows.append(row)
    if rows:
        yield part, rows


def runs(rows: list[tuple]) -> Iterator[list[tuple]]:
    """The conversations of a part."""
    start = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i][0] != rows[start][0]:
            yield rows[start:i]
            start = i


def fit(stored: DataFrame, fold_out: bool = True) -> Model:
    """Counts over all turns of conversations outside the held-out fold; each part counts its own, and what joins two parts is added from their ends."""
    known = stored.withColumn("role", F.when(~held_out(F.col("conv_id")) if fold_out else F.lit(True), F.col("role")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in parts(batches, 3):
            sums: Counter = Counter()
            for conv in runs(rows):
                whole = conv[0] is not rows[0]
                for i, row in enumerate(conv):
                    role = row[1]
                    if role is None:
                        continue
                    sums[("role", role)] += 1
                    for f, v in enumerate(observe(row[2])):
                        sums[("seen", str(f), str(v), role)] += 1
                    for line in (row[2] or "").splitlines():
                        for f, v in enumerate(observe_line(line)):
                            sums[("line", str(f), str(v), role)] += 1
                    if i and conv[i - 1][1] is not None:
                        sums[("move", conv[i - 1][1], role)] += 1
                    elif not i and whole:
                        sums[("first", role)] += 1
            sums[("ends", str(part), str(rows[0][0]), rows[0][1], str(rows[-1][0]), rows[-1][1])] = 1
            keys = list(sums)
            yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in keys], pa.list_(pa.string())), pa.array([sums[k] for k in keys], pa.int64())], names=["key", "n"])

    sums: Counter = Counter()
    ends = []
    counted = by_part(known, "conv_id", "role", "text").mapInArrow(count, "key array<string>, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    for key, n in counted.collect():  # features and roles, and one row per part
        if key[0] == "ends":
            ends.append((int(key[1]), *key[2:]))
        elif key[0] in ("seen", "line"):
            sums[(key[0], int(key[1]), key[2], key[3])] += n
        else:
            sums[tuple(key)] += n
    last = None
    for _, conv, role, last_conv, last_role in sorted(ends):
        if last is not None and last[0] == conv:
            if last[1] is not None and role is not None:
                sums[("move", last[1], role)] += 1
        elif role is not None:
            sums[("first", role)] += 1
        last = (last_conv, last_role)
    return Model(sums)


def chain(model: Model, edges: list[tuple]) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """What enters each part (scores of the last role before it) and what follows it (by its last role), of parts that share a conversation. edges: (part, first conv, head matrix or scores, last conv, tail, whole)."""
    enter: dict[int, np.ndarray] = {}
    follow: dict[int, np.ndarray] = {}
    edges = sorted(edges, key=lambda e: e[0])
    for a, b in zip(edges, edges[1:], strict=False):
        if a[3] == b[1]:  # one conversation goes on
            if a[5] and a[0] in enter:
                enter[b[0]] = (enter[a[0]][:, None] + a[2]).max(0)
            else:
                enter[b[0]] = a[4]
    for a, b in zip(edges[-2::-1], edges[:0:-1], strict=False):
        if a[3] == b[1]:
            rest = follow.get(b[0], np.zeros(len(model.roles))) if b[5] else np.zeros(len(model.roles))
            follow[a[0]] = (b[2] + rest[None, :]).max(1)
    return enter, follow


def recover(stored: DataFrame, model: Model) -> DataFrame:
    """Of the turns of sort_turns: conv_id, turn, role_pred and the rendered turn. Roles are not read."""
    spark = stored.sparkSession
    held = spark.sparkContext.broadcast(model)
    sorted_parts = by_part(stored, "conv_id", "turn", "text")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        k = len(model.roles)
        for part, rows in parts(batches, 3):
            convs = list(runs(rows))
            head = np.array([model.emit(r[2]) for r in convs[0]])
            tail = np.array([model.emit(r[2]) for r in convs[-1]]) if len(convs) > 1 else head
            v = tail[0] + model.first
            for e in tail[1:]:
                v = (v[:, None] + model.moves).max(0) + e
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([rows[0][0]], pa.int64()), pa.array([model.through(head).reshape(k * k).tolist()]), pa.array([rows[-1][0]], pa.int64()), pa.array([v.tolist()]), pa.array([len(convs) == 1])], names=["part", "first", "head", "last", "tail", "whole"])

    k = len(model.roles)
    found = sorted_parts.mapInArrow(ends, "part int, first bigint, head array<double>, last bigint, tail array<double>, whole boolean").collect()  # one row per part
    around = spark.sparkContext.broadcast(chain(model, [(p, a, np.array(h).reshape(k, k), b, np.array(t), w) for p, a, h, b, t, w in found]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, (enter, follow) = held.value, around.value
        for part, rows in parts(batches, 3):
            roles: list[str] = []
            convs = list(runs(rows))
            for i, conv in enumerate(convs):
                got = model.path(np.array([model.emit(r[2]) for r in conv]), enter.get(part) if not i else None, follow.get(part) if i == len(convs) - 1 else None)
                roles += [model.roles[x] for x in got]
            for i in range(0, len(rows), 2048):
                some = rows[i : i + 2048]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.int64()), pa.array([r[1] for r in some], pa.int64()), pa.array(roles[i : i + 2048], pa.string()), pa.array([render(x, r[2]) for x, r in zip(roles[i : i + 2048], some, strict=True)], pa.string())], names=["conv_id", "turn", "role_pred", "rendered"])

    return sorted_parts.mapInArrow(label, "conv_id bigint, turn bigint, role_pred string, rendered string")


#: Shares that turns in one table cell each cannot teach: of first lines that carry their own role's marker, or another's; of
#: later lines that carry any; and of lines that go on with their turn.
OWN, OTHER, STRAY, STAY = 0.85, 0.02, 0.005, 0.6


class LineModel:
    """The states of lines: of each role one that begins a turn and, after all of those, one that goes on with it."""

    def __init__(self, model: Model, own: float = OWN, other: float = OTHER, stray: float = STRAY, stay: float = STAY):
        self.roles, self.own, self.other, self.stray = model.roles, own, other, stray
        k = len(self.roles)
        totals: dict[int, np.ndarray] = {}
        for (f, _), n in model.lines.items():
            totals[f] = totals.get(f, np.zeros(k)) + n
        self.none = {f: np.log(SMOOTH / (t + SMOOTH * 20)) for f, t in totals.items()}
        self.seen = {fv: np.log((n + SMOOTH) / (totals[fv[0]] + SMOOTH * 20)) for fv, n in model.lines.items()}
        turn = np.concatenate((model.moves, model.moves)) + np.log(1 - stay)  # from either state of a role
        go_on = np.where(np.eye(k, dtype=bool), np.log(stay), -np.inf)
        self.moves = np.hstack((turn, np.concatenate((go_on, go_on))))
        self.first = np.concatenate((model.first, np.full(k, -np.inf)))

    def emit(self, line: str) -> np.ndarray:
        k = len(self.roles)
        found = MARKER.match(line)
        role = ROLE_OF[found[1].lower()] if found else None
        begin = np.full(k, np.log(1 - self.own - self.other if role is None else self.other))
        if role in self.roles:
            begin[self.roles.index(role)] = np.log(self.own)
        go_on = np.full(k, np.log(1 - self.stray if role is None else self.stray))
        zero = np.zeros(k)
        kind = sum((self.seen.get((f, str(v)), self.none.get(f, zero)) for f, v in enumerate(observe_line(line))), zero)
        return np.concatenate((begin + kind, go_on + kind))

    def turns(self, text: str | None) -> list[tuple[str, str]]:
        """(role, lines as they are) of each turn. Empty lines go on with the turn before them, or lead to the first one."""
        lines = (text or "").splitlines()
        some = [i for i, x in enumerate(lines) if x.strip()]
        if not some:
            return []
        v, back = self.first + self.emit(lines[some[0]]), []
        for i in some[1:]:
            step = v[:, None] + self.moves
            back.append(step.argmax(0))
            v = step.max(0) + self.emit(lines[i])
        path = [int(v.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path.reverse()
        k = len(self.roles)
        begins = [(i, self.roles[s]) for i, s in zip(some, path, strict=True) if s < k]
        stops = [i for i, _ in begins[1:]] + [len(lines)]
        return [(role, "\n".join(lines[a:b])) for (a, role), b in zip(begins, stops, strict=True)]


def parse_transcripts(rows: DataFrame, model: Model, id_col: str = "conv_id", text_col: str = "text") -> DataFrame:
    """Of texts that hold whole transcripts: id, turn (from 0), role_pred and the rendered turn. Narrow.

    A null text, or one of white space alone, has no turns; a text without any marker is split only where lines look like another
    role's; ids are as they are, and repeated rows give repeated turns; an empty table gives none. A text is held whole by its task.
    """
    held = rows.sparkSession.sparkContext.broadcast(LineModel(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                turns = [held.value.turns(t) for t in texts]
                owner = pa.array([i for i, own in enumerate(turns) for _ in own], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(owner), pa.array([n for own in turns for n in range(len(own))], pa.int64()), pa.array([r for own in turns for r, _ in own], pa.string()), pa.array([render(r, x) for own in turns for r, x in own], pa.string())],
                    names=["id", "turn", "role_pred", "rendered"],
                )

    some = pick(rows, id_col, text_col).toDF("id", "text")
    out = some.mapInArrow(run, f"id {some.schema['id'].dataType.simpleString()}, turn bigint, role_pred string, rendered string")
    return out.withColumnRenamed("id", id_col)
