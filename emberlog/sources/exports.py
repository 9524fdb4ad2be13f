"""Sinks: table exports, snapshots, audit rows, and the text reports that are read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.sources.tables import staged

DELIVERY_STATES = ("delivered", "failed", "suppressed", "skipped")


def flat(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON, as text formats need them."""
    nested = lambda t: isinstance(t, (T.ArrayType, T.MapType, T.StructType))
    return df.select(*(F.to_json(f.name).alias(f.name) if nested(f.dataType) else F.col(f.name) for f in df.schema.fields))


def export_table(df: DataFrame, folder: str, name: str, formats: tuple[str, ...] = ("csv", "json"), files: int | None = None) -> None:
    """The table as ``folder/name/format``. ``files``: write so few files (for tables that people open); else one per partition."""
    for kind in formats:
        out = flat(df) if kind == "csv" else df
        out = out.coalesce(files) if files else out
        out.write.mode("overwrite").option("header", "true").format(kind).save(f"{folder}/{name}/{kind}")


def export_daily(df: DataFrame, folder: str, name: str, day: str) -> bool:
    """The day's export, once: False if it is there already."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/day={day}/_SUCCESS")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return False
    flat(df).write.mode("overwrite").option("header", "true").csv(f"{folder}/{name}/day={day}")
    return True


def weekly_summary(rows: DataFrame, count: int = 10) -> DataFrame:
    """The errors with most occurrences."""
    return rows.orderBy(F.desc("occurrence_total"), "registry_key").limit(count)


def append_csv(df: DataFrame, path: str) -> None:
    """Rows added to a log of runs (registry health, key mappings)."""
    flat(df).write.mode("append").option("header", "true").csv(path)


def append_deliveries(deliveries: DataFrame, path: str) -> int:
    """Audit rows, added after a check of status, key and destination; the number of rows."""
    empty = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    state = F.lower(F.trim(F.coalesce("status", F.lit(""))))
    deliveries = staged(deliveries.withColumn("status", state), "deliveries")
    bad = deliveries.filter(~F.col("status").isin(*DELIVERY_STATES) | empty("dedup_key") | empty("destination")).limit(1).count()
    if bad:
        raise ValueError("a delivery has no known status, no key or no destination")
    deliveries.write.mode("append").parquet(path)
    return deliveries.count()


def snapshot(found: DataFrame, folder: str, count: int = 10) -> None:
    """A run's incidents as JSON, and its best scores."""
    found.write.mode("overwrite").json(f"{folder}/incidents")
    found.orderBy(F.desc("score"), "fingerprint").limit(count).write.mode("overwrite").json(f"{folder}/summary")


def read_snapshot(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(f"{folder}/incidents")


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Line-delimited JSON, a line at a time on the executors; broken lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def top_issues(lines: DataFrame, value: str = "value") -> DataFrame:
    """``rank, title, count`` of report lines like ``1. Title (42)`` or ``#1 Title: 42``."""
    pattern = r"^\s*#?(\d+)[.)]?\s+(.+?)\s*(?:\((\d+)[^)]*\)|:\s*(\d+))\s*$"
    g = lambda i: F.regexp_extract(value, pattern, i)
    return lines.filter(F.col(value).rlike(pattern)).select(g(1).cast("int").alias("rank"), g(2).alias("title"), F.coalesce(F.nullif(g(3), F.lit("")), g(4)).cast("long").alias("count"))


def report_fields(texts: DataFrame, fields: list[str], value: str = "value") -> DataFrame:
    """``Name: value`` fields of text reports, one row per report."""
    field = lambda f: F.nullif(F.trim(F.regexp_extract(value, rf"(?im)^\W*{f}\W*:\s*(.+)$", 1)), F.lit(""))
    return texts.select(*(field(f).alias(f.lower().replace(" ", "_")) for f in fields))


def regrouped_registry(entries: DataFrame) -> DataFrame:
    """An older registry (a row per fingerprint: problem_key, fingerprint, occurrences, first_seen, last_seen) by problem key."""
    return entries.groupBy("problem_key").agg(
        F.array_sort(F.collect_set("fingerprint")).alias("fingerprints"), F.sum("occurrences").alias("occurrences"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )
