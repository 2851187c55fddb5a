"""Session defaults for running the library outside a managed cluster."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, partitions: int = 8, app: str = "corvellum", memory: str = "8g") -> SparkSession:
    """A local session with the settings the library is tested with."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a partition a core
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by spark.checkpoint.dir.

    Where that is unset a temporary folder is made on one machine, as in tests; on a cluster,
    whose nodes don't see each other's folders, it is an error.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not set_to:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        set_to = os.path.join(tempfile.gettempdir(), f"corvellum-{spark.sparkContext.applicationId}")
        spark.conf.set("spark.checkpoint.dir", set_to)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(set_to)
    return set_to


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for one run, within the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(table: DataFrame) -> DataFrame:
    """The table with its lineage cut by a file in the shared folder."""
    shared_folder(table.sparkSession)
    return table.checkpoint()


@contextlib.contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """What queries made and run within shuffle is removed from the disks as soon as they end."""
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")
    try:
        yield
    finally:
        spark.conf.set(clean, before)


def kept(table: DataFrame) -> DataFrame:
    """The table with its lineage cut by compressed files in the shared folder.

    For tables of texts: a checkpoint's rows are not compressed.  What was shuffled to make the
    table is removed from the disks as soon as it is written.
    """
    folder = new_folder(table.sparkSession, "kept")
    with cleaned(table.sparkSession):
        table.write.option("compression", "zstd").parquet(folder)
    return table.sparkSession.read.schema(table.schema).parquet(folder)


def tasks(spark: SparkSession) -> int:
    """Tasks of a stage that works long on little data, which adaptive execution would merge."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(table: DataFrame) -> DataFrame:
    """A table read from fewer file splits than there are cores, dealt out to all of them.

    For tables that go through Python row by row; the rows stay the same.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table._jdf.rdd().getNumPartitions() < cores else table
