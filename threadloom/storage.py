"""The shared folder and tables written there, which cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders of local applications that name none, by application id.
OWN_DIRS: dict[str, str] = {}
#: Of each open scratch block, innermost last, the places of its tables.
SCRATCH: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. A folder of its own only where that is unset and Spark is local, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in OWN_DIRS:
        OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="threadloom-")
    return OWN_DIRS[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark)}/threadloom/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """The rows of df from a written table: its lineage is cut, and it outlives any executor. The innermost scratch block frees it at its end; with keep, the one around that, if any."""
    path = new_path(df.sparkSession, name)
    blocks = SCRATCH.get()[: -1 if keep else None]
    if blocks:
        blocks[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Frees the tables written inside, also after an error. What leaves the block must not read them, unless they were written with keep."""
    own: list[str] = []
    token = SCRATCH.set((*SCRATCH.get(), own))
    try:
        yield
    finally:
        SCRATCH.reset(token)
        for path in own:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a place of the shared folder, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def drop_table(df: DataFrame) -> None:
    """Frees a table that write_table made, once nothing reads it any more."""
    for path in {file.rpartition("/")[0] for file in df.inputFiles()}:
        remove(df.sparkSession, path)


#: Seconds after which a lock is taken to be that of a pass that was lost.
STALE_S = 6 * 3600


@contextmanager
def exclusive(spark: SparkSession, root: str, stale_s: float = STALE_S) -> Iterator[bool]:
    """Whether this block alone may write a root. It does not wait: where another one holds the lock, it gives False. A lock older than stale_s is taken over."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/.lock")
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(place.getParent())
    mine = store.createNewFile(place)
    if not mine and store.exists(place) and store.getFileStatus(place).getModificationTime() < (time.time() - stale_s) * 1000:
        store.delete(place, False)
        mine = store.createNewFile(place)
    try:
        yield mine
    finally:
        if mine:
            store.delete(place, False)
