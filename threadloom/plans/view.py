"""What users ask of conversations, as DataFrames over the folded rounds.

Structure comes from the fold; texts are joined last, and only for the places in the answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clip, journal_name, readable, short_id, short_name
from ..operators import first_wins
from . import rounds
from .assembly import entries_of
from .vocabulary import glossary

__all__ = ["Conversations", "counts_of", "tree_of"]

STRUCTURE = ("session", "segment", "stream", "epoch", "talk", "run")
#: Fixed value: the deepest level of a talk that is shown.
DEPTH = 12


#: The order of kinds below a node, and the kind that comes last.
TREE_ORDER, TREE_LAST = ("stream", "epoch", "talk", "run", "llm.call"), "segment"


def counts_of(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Rows (what, name, n): nodes by kind, edges by type and by quality; a null is a name of its own."""
    parts = [df.groupBy(F.lit(what).alias("what"), F.col(c).alias("name")).agg(F.count("*").alias("n")) for df, what, c in ((nodes, "kind", "kind"), (relations, "relation", "type"), (relations, "quality", "quality"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def tree_of(nodes: DataFrame, breadth: int, depth: int, order: Sequence[Column | str]) -> DataFrame:
    """Nodes (id, parent, kind, stream, ...) as a tree to print: id, parent, kind, stream, level, path; in the order of path.

    Children come by kind, then in the given order; at most so many of each node, so many levels deep. Roots, whose parent is
    null, are all there. A node whose parent is not there is not shown; ids must be unique; an empty table gives none.
    """
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(TREE_ORDER)], F.when(F.col("kind") == TREE_LAST, F.lit(9)), F.lit(5))
    level = nodes.where("parent is null").select("id", "parent", "kind", "stream", F.lit(0).alias("level"), F.array(F.lit(0)).alias("path"))
    nodes = nodes.where("parent is not null").withColumn("nth", F.row_number().over(Window.partitionBy("parent").orderBy(rank, *order))).where(F.col("nth") <= breadth)
    shown = level
    for i in range(1, depth + 1):
        up = level.select(F.col("id").alias("parent"), "path")
        level = nodes.join(up, "parent").select("id", "parent", "kind", "stream", F.lit(i).alias("level"), F.concat("path", F.array("nth")).alias("path"))
        shown = shown.unionByName(level)
    return shown.orderBy("path")


class Conversations:
    """Conversations of one root; each method returns a DataFrame. `as_of`: the state after that round."""

    def __init__(self, spark: SparkSession, root: str, as_of: int | None = None):
        self.spark, self.root = spark, root
        self.nodes, self.relations, self.unresolved = [rounds.fold(spark, root, k, as_of) for k in ("nodes", "relations", "unresolved")]

    def register(self, prefix: str = "conv_") -> None:
        """Makes nodes, relations, unresolved, landed and rounds views of spark.sql."""
        landed = rounds.landed_of(self.spark, self.root)
        for name, df in (("nodes", self.nodes), ("relations", self.relations), ("unresolved", self.unresolved), ("rounds", rounds.rounds_of(self.spark, self.root)), ("landed", landed)):
            if df is not None:
                df.createOrReplaceTempView(prefix + name)

    def glossary(self) -> DataFrame:
        return glossary(self.spark)

    def _times(self) -> DataFrame:
        return rounds.landed_of(self.spark, self.root).select("session", "seq", "row", F.col("ts_ns").alias("at_ns"))

    def _texts(self) -> DataFrame:
        """What a person would read in records: their text parts, one below the other, or else the prompts of a queued command."""
        return rounds.landed_of(self.spark, self.root).select("session", "seq", "row", readable("parts").alias("text"))

    def list(self) -> DataFrame:
        """Per conversation: title, talks, steps, streams, segments, first and last time (ms), open references."""
        kind = F.col("kind")
        counts = self.nodes.groupBy("session").agg(
            F.max(F.when(kind == "session", F.get_json_object("attrs", "$.title"))).alias("title"), F.count_if(kind == "talk").alias("talks"), F.count_if(~kind.isin(*STRUCTURE)).alias("steps"),
            F.count_if(kind == "stream").alias("streams"), F.count_if(kind == "segment").alias("segments"))
        spans = self._times().groupBy("session").agg(F.expr("min(at_ns) div 1000000").alias("from_ms"), F.expr("max(at_ns) div 1000000").alias("to_ms"))
        opens = self.unresolved.where("state = 'open'").groupBy("session").agg(F.count("*").alias("open"))
        return counts.join(spans, "session", "left").join(opens, "session", "left").na.fill(0, ["open"])

    def counts(self, session: str) -> DataFrame:
        """How many nodes of each kind, edges of each type and of each quality."""
        mine = F.col("session") == session
        return counts_of(self.nodes.where(mine), self.relations.where(mine)).orderBy("what", F.desc("n"), "name")

    def _in_talks(self, session: str) -> DataFrame:
        """Nodes with the talk above them (null: none) and how far below it they are, as the rounds hold them."""
        return self.nodes.where(F.col("session") == session)

    def talks(self, session: str) -> DataFrame:
        """Per talk: stream, segment, runs, steps, tools, span in ms, and its first words from outside and last reply."""
        inside = self._in_talks(session).where("talk is not null")
        timed = self._with(inside, self._times())
        kind = F.col("kind")
        rolled = timed.groupBy("session", "talk").agg(
            F.max(F.when(kind == "talk", F.col("stream"))).alias("stream"), F.min(F.when(kind == "talk", F.struct("ref.seq", "ref.row"))).alias("at"), F.count_if(kind == "run").alias("runs"), F.count_if(~kind.isin(*STRUCTURE)).alias("steps"),
            F.count_if(kind.isin("tool", "agent.call")).alias("tools"), F.expr("min(at_ns) div 1000000").alias("from_ms"), F.expr("max(at_ns) div 1000000").alias("to_ms"))
        # the first three injections of each talk stand in where nothing came from outside
        first = inside.where(kind == "context.injection").withColumn("nth", F.row_number().over(Window.partitionBy("talk").orderBy("ref.seq", "ref.row", "id"))).where("nth <= 3").drop("nth")
        words = self._with(inside.where(kind.isin("message.external", "message.assistant", "agent.output")).unionByName(first), self._texts())
        place, name = F.struct("ref.seq", "ref.row"), F.nullif(short_name(F.col("text")), F.lit(""))
        outside, put, reply = kind == "message.external", (kind == "context.injection") & name.isNotNull(), kind.isin("message.assistant", "agent.output")
        said = words.groupBy("session", "talk").agg(
            F.bool_or(outside).alias("any_outside"), F.min_by(F.when(outside, name), F.when(outside, place)).alias("outer"), F.min_by(F.when(put, name), F.when(put, place)).alias("inner"),
            F.max_by(F.when(reply, name), F.when(reply, place)).alias("reply"))
        said = said.select("session", "talk", F.when(F.col("any_outside"), F.col("outer")).otherwise(F.col("inner")).alias("name"), "reply")
        segments = self.relations.where("type = 'in_segment'").groupBy("session", F.col("from").alias("talk")).agg(F.min("to").alias("segment"))
        return rolled.join(segments, ["session", "talk"], "left").join(said, ["session", "talk"], "left").orderBy("at.seq", "at.row", "talk")

    def _with(self, nodes: DataFrame, records: DataFrame) -> DataFrame:
        """Nodes with columns of the record at their place."""
        keyed = nodes.withColumn("seq", F.col("ref.seq")).withColumn("row", F.col("ref.row"))
        return keyed.join(records, ["session", "seq", "row"], "left").drop("seq", "row")

    def segments(self, session: str) -> DataFrame:
        """Per segment: state, unmet gates, talks, span in ms."""
        inside = self.relations.where((F.col("type") == "in_segment") & (F.col("session") == session)).select("session", F.col("from").alias("talk"), F.col("to").alias("id"))
        spans = self.talks(session).select("session", "talk", "from_ms", "to_ms").join(inside, ["session", "talk"]).groupBy("session", "id").agg(F.count("*").alias("talks"), F.min("from_ms").alias("from_ms"), F.max("to_ms").alias("to_ms"))
        return self.nodes.where((F.col("kind") == "segment") & (F.col("session") == session)).select(
            "session", "id", F.get_json_object("attrs", "$.state").alias("state"), F.get_json_object("attrs", "$.gates_unmet").alias("gates_unmet")).join(spans, ["session", "id"], "left")

    def streams(self, session: str) -> DataFrame:
        """Per stream, the main one first: role, label, records, first talk, steps, and what started it."""
        nodes = self.nodes.where(F.col("session") == session)
        steps = nodes.where(~F.col("kind").isin(*STRUCTURE)).groupBy("stream").agg(F.count("*").alias("steps"))
        talks = nodes.where("kind = 'talk'").groupBy("stream").agg(F.min_by("id", F.struct("ref.seq", "ref.row")).alias("first_talk"))
        openers = self.relations.where((F.col("type") == "starts") & (F.col("session") == session)).groupBy(F.col("to").alias("id")).agg(F.array_sort(F.collect_list(F.struct("from", "quality", "via"))).alias("openers"))
        got = {k: F.get_json_object("attrs", f"$.{k}").alias(k) for k in ("role", "label", "records")}
        made = nodes.where("kind = 'stream'").select("id", "stream", "ref", got["role"], got["label"], got["records"].cast("long").alias("records"))
        made = made.join(steps, "stream", "left").join(talks, "stream", "left").join(openers, "id", "left").na.fill(0, ["steps"])
        made = made.join(self._journal_names(session), "stream", "left").withColumn("label", F.coalesce("label", "journal_name")).drop("journal_name")
        return made.orderBy(F.col("role") != "main", "ref.seq", "ref.row", "id")

    def _journal_names(self, session: str) -> DataFrame:
        """Names of child streams from the results in run journals: a surface, else a summary, else the verdict with its first refuted claim. The first that names a child counts."""
        rows = rounds.landed_of(self.spark, self.root).where((F.col("session") == session) & (F.col("source_kind") == "journal") & F.col("child").isNotNull())
        found = rows.select(F.col("child").alias("stream"), "seq", "row", F.explode("parts").alias("p")).select("stream", "seq", "row", F.coalesce("p.data", "p.text").alias("said"))
        named = found.withColumn("journal_name", journal_name(F.col("said"))).where("journal_name is not null")
        return named.groupBy("stream").agg(F.min_by("journal_name", F.struct("seq", "row")).alias("journal_name"))

    def flow(self, session: str) -> DataFrame:
        """Every step: id, kind, stream, talk, parent, time (ms), name, depth below its talk."""
        steps = self._with(self._in_talks(session).where(~F.col("kind").isin(*STRUCTURE)), self._times())
        return steps.select("id", "kind", "stream", "talk", "parent", F.expr("at_ns div 1000000").alias("at_ms"), F.get_json_object("attrs", "$.name").alias("name"), "depth", "ref").orderBy(*self._order())

    @staticmethod
    def _order() -> list[Column]:
        return [F.col("ref").isNull(), F.col("ref.seq"), F.col("ref.row"), F.col("ref.block").asc_nulls_first(), F.col("id")]

    def talk(self, session: str, talk: str) -> DataFrame:
        """The steps of one talk down to level 12: texts (clipped), results, duration from request to result (ms), and edges both ways."""
        inside = self._in_talks(session).where((F.col("talk") == talk) & (F.col("depth") < DEPTH))
        landed = rounds.landed_of(self.spark, self.root).where(F.col("session") == session)
        parts = landed.select("session", "seq", "row", "ts_ns", "parts")
        here = self._with(inside, parts)
        at_block = F.get("parts", F.coalesce("ref.block", F.lit(0)))
        whole = F.array_join(F.transform(F.filter("parts", lambda p: (p["k"] == "text") & (p["text"] != "")), lambda p: p["text"]), "\n")
        text = F.when(F.col("ref.block").isNotNull(), F.coalesce(at_block["text"], at_block["data"])).otherwise(whole)
        here = here.withColumn("text", clip(text)).withColumn("duration_ms", F.get_json_object(F.get("parts", F.lit(0))["data"], "$.durationMs").cast("long")).withColumn("began", F.col("ts_ns")).drop("parts", "ts_ns")
        answer = F.when(F.col("kind").isin("tool", "agent.call") & (F.get_json_object("attrs", "$.result_join") == "exact_unique"), F.get("refs", F.lit(1)))
        answered = here.withColumn("seq", answer["seq"]).withColumn("row", answer["row"]).withColumn("block", answer["block"]).join(parts, ["session", "seq", "row"], "left")
        got = F.get("parts", F.col("block"))
        took = F.when(F.col("ts_ns") >= F.col("began"), F.expr("(ts_ns - began) div 1000000"))
        steps = answered.withColumn("result", clip(F.coalesce(got["text"], got["data"]))).withColumn("failed", got["failed"]).withColumn("took_ms", took)
        mine = self.relations.where(F.col("session") == session)
        edge = F.struct("type", F.col("other").alias("id"), "quality", "via", "outgoing")
        edges = mine.select(F.col("from").alias("id"), "type", F.col("to").alias("other"), "quality", "via", F.lit(True).alias("outgoing")).unionByName(
            mine.select(F.col("to").alias("id"), "type", F.col("from").alias("other"), "quality", "via", F.lit(False).alias("outgoing"))).groupBy("id").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
        return steps.join(edges, "id", "left").select("id", "kind", "parent", "stream", "depth", "ref", F.expr("began div 1000000").alias("at_ms"), "text", "result", "failed", "took_ms", "duration_ms", "attrs", "edges").orderBy(*self._order())

    def record(self, session: str, seq: int, row: int) -> DataFrame:
        """One landed record, whole."""
        return rounds.landed_of(self.spark, self.root).where((F.col("session") == session) & (F.col("seq") == seq) & (F.col("row") == row))

    def tree(self, session: str, breadth: int = 6, depth: int = 6) -> DataFrame:
        """The containment tree as it is printed: at most so many children of each node, so many levels deep."""
        return tree_of(self.nodes.where(F.col("session") == session), breadth, depth, self._order())

    def open_references(self, session: str) -> DataFrame:
        """References that are still open, by id."""
        return self.unresolved.where((F.col("session") == session) & (F.col("state") == "open")).orderBy("id")

    def of_kind(self, session: str, kind: str) -> DataFrame:
        """Nodes of a kind, by id."""
        return self.nodes.where((F.col("session") == session) & (F.col("kind") == kind)).orderBy("id")

    def children(self, session: str, parent: str | None = None) -> DataFrame:
        """The nodes below a node in order, or without one the roots: nodes whose parent is null or no node."""
        mine = self.nodes.where(F.col("session") == session)
        if parent is not None:
            return mine.where(F.col("parent") == parent).orderBy(*self._order())
        return mine.join(mine.select(F.col("id").alias("parent")), "parent", "left_anti").select(*mine.columns).orderBy(*self._order())

    def overview(self, session: str) -> DataFrame:
        """What is said first of a conversation, as rows (what, name, n): node kinds, edge types and qualities by count, and the first twelve open references."""
        lost = self.open_references(session).limit(12).select(F.lit("unresolved").alias("what"), F.concat_ws(" ", "kind", short_id(F.col("ref"))).alias("name"), F.lit(1).cast("long").alias("n"))
        return self.counts(session).unionByName(lost)

    # the index: points of access by id, over the entries of landed records

    def entries(self, session: str) -> DataFrame:
        """Records without texts, the first of each id."""
        landed = rounds.landed_of(self.spark, self.root)
        return first_wins(entries_of(landed.where(F.col("session") == session)), ["session", "id"], ["seq", "row"])

    def entries_where(self, session: str, stream: str | None = None, batch: str | None = None, run: str | None = None, tool: str | None = None, child: str | None = None) -> DataFrame:
        """Entries of a stream, batch or run, or about a tool use or a child (those that name it), in landed order."""
        rows = self.entries(session)
        for name, value in (("stream", stream), ("batch", batch), ("run", run), ("tool", tool), ("child", child)):
            if value is not None:
                rows = rows.where(F.col(name) == value)
        return rows.orderBy("seq", "row")

    def stream_names(self, session: str) -> DataFrame:
        return self.entries(session).where("stream is not null").select("stream").distinct().orderBy("stream")

    def tool_blocks(self, session: str, tool: str) -> DataFrame:
        """The blocks of a tool use: its request and results, in landed order."""
        blocks = self.entries(session).select("seq", "row", "stream", F.explode("blocks").alias("b")).where(F.col("b.tool") == tool)
        return blocks.select("seq", "row", "stream", F.col("b.ord").alias("block"), F.col("b.kind").alias("kind"), F.col("b.name").alias("name")).orderBy("seq", "row", "block")

    def index_report(self, session: str) -> DataFrame:
        """Rows (what, name, n) over the entries of a session: records by kind, requests and results, fragments a call, entries with an id, and the eight tools most used."""
        rows = self.entries(session)
        blocks = rows.select(F.explode("blocks").alias("b")).select("b.*")
        n = F.count("*").cast("double")
        parts = [
            rows.groupBy(F.lit("kind").alias("what"), F.col("kind").alias("name")).agg(n.alias("n")),
            blocks.where("kind in ('tool_use', 'tool_result')").groupBy(F.lit("blocks").alias("what"), F.col("kind").alias("name")).agg(n.alias("n")),
            rows.where("kind = 'assistant' and call is not null").groupBy("call").agg(n.alias("n")).agg(F.avg("n").alias("n")).select(F.lit("calls").alias("what"), F.lit("fragments").alias("name"), "n"),
            rows.agg(F.count("id").cast("double").alias("n")).select(F.lit("ids").alias("what"), F.lit("known").alias("name"), "n"),
            blocks.where("kind = 'tool_use'").groupBy(F.lit("tool").alias("what"), F.coalesce("name", F.lit("")).alias("name")).agg(n.alias("n")).orderBy(F.desc("n"), "name").limit(8),
        ]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        return whole.orderBy("what", F.desc("n"), "name")

    def index_sample(self, session: str, per_stream: int = 2, most: int = 12) -> DataFrame:
        """The report's sample: so many entries of each stream in landed order, and so many in all."""
        order = Window.partitionBy("stream").orderBy("seq", "row")
        return self.entries(session).where("stream is not null").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_stream).orderBy("stream", "seq", "row").limit(most)
