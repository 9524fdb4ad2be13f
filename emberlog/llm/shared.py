"""What the operators of this subpackage share: row identity, words, and tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_folder: list[str] = []
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    A folder of our own is made on one machine only: elsewhere executors would not see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="emberlog-"))
    return _own_folder[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/emberlog/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back.

    This cuts the lineage (a lost executor costs a read, not a recomputation), fixes what
    non-deterministic expressions gave, and gives the planner the table's real size.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`materialise` that no later plan reads."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/emberlog/" in folder:
                _delete(df.sparkSession, folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Paths made within go at the end, but for those that are taken out of the list.

    Results are lazy, so only who has written a result can say that the tables behind it are done with.
    """
    mark, paths = len(_made), []
    try:
        yield paths
    finally:
        for path in _made[mark:]:
            if path not in paths:
                _delete(spark, path)
        _made[mark:] = paths


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each finished SQL execution within are deleted at once, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def running(df: DataFrame, order: list, sums: dict[str, str], rank: str | None = None) -> DataFrame:
    """``df`` with the sum of each column over the rows before (``sums``: column -> new name) and, if named, the row's place from 0.

    The rows are sorted into ranges; each range starts from the totals of the ranges before, of which there is one row a range.
    So no task holds all rows. ``order`` must tell rows apart.
    """
    ranged = materialise(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    parts = {**sums, **({"_one": rank} if rank else {})}
    ranged = ranged.withColumn("_one", F.lit(1).cast("long"))
    totals = ranged.groupBy("_range").agg(*(F.sum(c).alias(f"_t_{c}") for c in parts))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    totals = totals.select("_range", *(F.coalesce(F.sum(f"_t_{c}").over(ahead), F.lit(0)).alias(f"_t_{c}") for c in parts))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(totals, "_range")
    for c, name in parts.items():
        out = out.withColumn(name, F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"_t_{c}"))
    return out.select(*df.columns, *parts.values())


def text_tie(text: str = "text") -> Column:
    """Hash of a row's text; with the document id it tells rows of one id apart. Rows alike in both are one document."""
    return F.xxhash64(F.col(text))


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Join condition: the named columns are equal, or null on both sides."""
    cond = left[names[0]].eqNullSafe(right[names[0]])
    for n in names[1:]:
        cond = cond & left[n].eqNullSafe(right[n])
    return cond
