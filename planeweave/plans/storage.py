"""Cutting lineage through files that every executor can read."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset and all runs on one machine (a local master, as in tests), a temporary folder is set; on a cluster,
    whose machines don't see each other's folders, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="planeweave-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write df as Parquet below the shared folder and read it back.

    The result depends on files only, so a lost executor costs at most the tasks it was running.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/planeweave/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._materialized = path
    return back


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that materialize() returned and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._materialized)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def give_back() -> None:
    """Hands memory that this process has freed back to the system, where the C library can; else it would stay the driver's."""
    gc.collect()
    trim()


def trim() -> None:
    found = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if found:
        found(0)


def giving_back(made: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """made, a function over batches, whose worker trims its memory before and after.

    Workers live on from task to task and stage to stage: what an earlier task has freed, such as a model that was sent, stays
    theirs beside all that the next task needs.
    """

    def run(batches: Iterator) -> Iterator:
        trim()
        yield from made(batches)
        trim()

    return run
