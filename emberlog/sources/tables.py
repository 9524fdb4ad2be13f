"""Stage tables: intermediate results that several later steps read, written once to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_made: dict[tuple[str, str, str], DataFrame] = {}


def shared_folder(spark) -> str:
    """``spark.checkpoint.dir``, or the context's checkpoint folder. A folder of our own is made on one machine only: elsewhere executors would not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="emberlog-stages-"))
    return _own[0]


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: computed once, its lineage cut, its size known to the planner."""
    path = f"{shared_folder(df.sparkSession)}/stages/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of one task of costly expressions.
TASK_ROWS = 100_000


def spread(df: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """A scan dealt out again, so that costly expressions after it run on all cores and no task has more than about ``task_rows`` rows, however few files, splits or row groups there are.

    For scans and what needs no shuffle.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // task_rows)))


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, wherever Spark's file systems have it; none if there is no such folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []


def numbered(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """The numbers n of a folder's ``<prefix>n``, in order."""
    return sorted(int(n[len(prefix) :]) for n in listed(spark, folder) if n.startswith(prefix) and n[len(prefix) :].isdigit())


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrites only the partitions that ``df`` has rows of: running a window again replaces it and nothing else."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def _stamp(spark: SparkSession, folder: str) -> int:
    """Changes when a file directly under the folder is added, removed, rewritten or resized."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return hash(tuple((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path))) if fs.exists(path) else 0


def once(spark: SparkSession, source: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The stage table ``name`` of ``source`` as it is, made by the first query of this application that needs it and read by the others.

    So a run's records and incidents are made once, as a scheduled run would store them, and every report reads them.
    """
    key = (spark.sparkContext.applicationId, f"{source} {_stamp(spark, source)}", name)
    if key not in _made:
        _made[key] = staged(make(), name)
    return _made[key]


def forget() -> None:
    """Make stage tables anew from here on (for timing a query with all that it needs)."""
    _made.clear()
