"""Tables between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

#: Spark then removes a statement's shuffle files when it ends, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset a local run takes a temporary folder; a cluster, whose machines share none, is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = _local_dir()
    return path.rstrip("/")


@lru_cache(1)
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="mnemion-")


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for a while."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Cuts the lineage (a lost executor costs a re-read, not the whole job) and gives the planner true sizes. The shuffle
    files of the write are of no more use once the table is there.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/mnemion/{name}-{uuid.uuid4().hex}"
    with setting(spark, CLEANUP, "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more. Anything else, as a source table, is an error and stays."""
    for df in tables:
        files = df.inputFiles()
        if not files:
            continue
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path
        root = hadoop(f"{shared_dir(spark)}/mnemion")
        system = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        folders = {f.rsplit("/", 1)[0] for f in files}
        path = hadoop(jvm.java.net.URI(folders.pop()))
        if folders or not path.getParent().equals(system.makeQualified(root)):
            raise ValueError(f"not a staged table: {files[0]}")
        system.delete(path, True)
