"""Command line: python -m threadloom COMMAND. Answers are lines of JSON."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .plans import rounds
from .plans.view import Conversations
from .plans.vocabulary import fields, rendered
from .sources import transcripts
from .streaming.follow import drain, follow

COMMANDS = {
    "sources": "what is there to collect, by session", "collect": "land what is new", "parse": "publish the rounds of what is landed", "index": "a report of a session's entries", "show": "one record: SESSION SEQ ROW, or the blocks of a tool use: SESSION TOOL",
    "conversation": "an overview of a session", "view": "all conversations, or the talks of a session, or the steps of a talk", "glossary": "the names of the model", "fields": "the fields of landed records", "verify": "problems of what is landed and published; exit status 1 if there are any",
}


def tell(rows: DataFrame) -> int:
    """Prints the rows one by one as they come; their number."""
    n = 0
    for row in rows.toJSON().toLocalIterator():
        print(row)
        n += 1
    return n


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="threadloom", epilog="; ".join(f"{k}: {v}" for k, v in COMMANDS.items()))
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("args", nargs="*")
    parser.add_argument("-config", default="", help="a JSON or YAML file")
    parser.add_argument("-once", action="store_true", help="collect what is there and end")
    parser.add_argument("-terms", choices=("unified", "native", "both"), default="unified")
    parser.add_argument("-checkpoint", default="", help="a folder for the state of a running collection")
    said = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("threadloom").getOrCreate()
    what = config.load(said.config)
    own, args = Conversations, said.args
    if said.command == "sources":
        for one in what.sources:
            tell(transcripts.sessions(transcripts.selected(transcripts.discover(spark, one.source_root), one.include, one.exclude)).orderBy("session"))
    elif said.command == "collect":
        if said.once or all(one.mode == "once" for one in what.sources):
            for one in what.sources:
                print(f'{{"source": "{one.name}", "records": {drain(spark, one)[0]}}}')
        else:
            running = [follow(spark, one, f"{said.checkpoint or what.root + '/.follow'}/{one.name}") for one in what.sources]
            for query in running:
                query.awaitTermination()
    elif said.command == "parse":
        tell(rounds.publish(spark, what.root).orderBy("session"))
    elif said.command == "index":
        tell(own(spark, what.root).index_report(args[0]))
    elif said.command == "show":
        tell(own(spark, what.root).record(args[0], int(args[1]), int(args[2])) if len(args) == 3 else own(spark, what.root).tool_blocks(*args))
    elif said.command == "conversation":
        tell(own(spark, what.root).overview(args[0]).withColumn("name", rendered(F.col("name"), said.terms)))
    elif said.command == "view":
        view = own(spark, what.root)
        tell(view.list().orderBy("session") if not args else view.talks(args[0]) if len(args) == 1 else view.talk(*args).withColumn("kind", rendered(F.col("kind"), said.terms)))
    elif said.command == "glossary":
        tell(own(spark, what.root).glossary().orderBy("term_group", "unified"))
    elif said.command == "fields":
        tell(fields(spark))
    else:
        landed = rounds.audit_landed(spark, what.root).where("gaps + relanded + byte_gaps > 0")
        return 1 if tell(landed) + tell(rounds.audit_chain(spark, what.root)) + tell(rounds.audit_rounds(spark, what.root)) else 0
    return 0


if __name__ == "__main__":
    sys.exit(main())
