"""Session helpers shared by the whole library: shared folders and written intermediate tables."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

#: Spark removes a statement's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that one task sorts or groups.
TASK_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see, read from ``spark.checkpoint.dir``.

    Only a local master (tests, a laptop) may leave it unset: then a folder of this
    machine is made and set. On a cluster executors could not see that, so it raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corpuscle-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts lineage: later stages, also after an executor is lost, read the files. What
    the step shuffled goes when the write ends. The table's files go with :func:`discard`,
    or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables from :func:`written` that nothing will read any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(df.written_to)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the Parquet tables in ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt(df: DataFrame, *by: str, least: int = 1) -> DataFrame:
    """Rows dealt to all tasks, ``least`` at least, by hash: a small file, of which much is made, would be one task's."""
    return df.repartition(max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by)


def spread(df: DataFrame, rows: int, *by: str, most: int | None = None) -> DataFrame:
    """``df`` dealt by hash of ``by`` so that a task's share of ``rows`` rows stays about ``most`` (else ``TASK_ROWS``), however many there are.

    Up to what the session's shuffle partitions hold, Spark may put small ones together;
    beyond it there are more partitions, so that a task's memory doesn't grow with the table.
    """
    n = math.ceil(rows / (most or TASK_ROWS))
    return df.repartition(*by) if n <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(n, *by)


def free_name(stem: str, *taken: Iterable[str]) -> str:
    """A column name that starts with ``stem`` and clashes with none of ``taken``, letters' case aside."""
    used = {c.lower() for names in taken for c in names}
    name, k = stem, 0
    while name.lower() in used:
        k += 1
        name = f"{stem}{k}"
    return name
