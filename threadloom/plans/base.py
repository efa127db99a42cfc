"""Registry of queries and oracles, and the tables as the record model sees them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def log(self) -> DataFrame:
        """events as a record log, with the link that props carry."""
        return self.events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))

    @property
    def turns(self) -> DataFrame:
        """conversations as transcript records: the parent of a turn is the one before."""
        return self.conversations.withColumn("parent_turn", F.col("turn") - 1)


def query(oracle: str | None = None):
    """Registers a function of Tables as the query of its name."""

    def add(made: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[made.__name__] = lambda spark, sf_dir: made(Tables(spark, sf_dir))
        if oracle:
            ORACLES[made.__name__] = oracle
        return made

    return add
