"""Detections over a stream: each page of events leaves a mergeable part, and parts merge to what one run over all events finds.

A part has, per fingerprint, counts and sets, the page's decayed sum of counts (with the page's last window apart, as that may be the current one), the first message,
and trailing counts; per namespace and window, counts of the page's first and last window, which neighbours may share, and the strongest peaks of the windows in between, which are complete. The only events that a part
keeps are those of the last ``burst_seconds``, as context of the next page. So a page costs a page, and parts cost a row per fingerprint and page, whatever the history.

Pages follow each other in time. A part lies under its batch's number, so that a batch that runs again replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions import values as V
from emberlog.operators import incidents as I
from emberlog.operators import measure as M
from emberlog.operators import peaks as P
from emberlog.operators.parse import parse
from emberlog.sources.tables import numbered

KEEP = 1 - V.ALPHA
TABLES = ("measures", "peaks", "open", "tail")


class Rules(NamedTuple):
    """What a run knows beforehand; the names are those of ``incidents.detect``."""

    thresholds: DataFrame
    cap_rows: DataFrame
    burst_seconds: int = 60
    seconds: int = V.WINDOW_SECONDS


def _set(name: str) -> Column:
    return F.array_distinct(F.flatten(F.collect_list(name))).alias(name)


def _index(later: Column, earlier: Column, seconds: int) -> Column:
    return ((F.unix_seconds(later) - F.unix_seconds(earlier)) / seconds).cast("double")


def part(records: DataFrame, tail: DataFrame | None, rules: Rules) -> dict[str, DataFrame]:
    """A page's part. ``tail``: fingerprint, ts, seq of events before the page that trailing counts still see."""
    timed = records.filter(F.col("ts").isNotNull()).withColumn("w", V.bucket(F.col("ts"), rules.seconds))
    cells = timed.groupBy("fingerprint", "w").agg(
        F.count("*").cast("double").alias("n"), F.min(F.struct("seq", "error_type", "normalized_message")).alias("kind"),
        *(F.collect_set(c).alias(name) for c, name in (("namespace", "namespaces"), ("app_name", "apps"), ("app_version", "versions"))),
    )
    span = timed.agg(F.min("w").alias("page_first"), F.max("w").alias("page_last"))
    cells = cells.join(F.broadcast(span))  # one row
    last = F.col("w") == F.col("page_last")
    weight = F.pow(F.lit(KEEP), _index(F.col("page_last"), F.col("w"), rules.seconds))
    measures = cells.groupBy("fingerprint", "page_first", "page_last").agg(
        F.sum("n").alias("total"), F.sum(F.when(last, F.col("n")).otherwise(0.0)).alias("last_n"), F.sum(F.when(F.col("w") == F.col("page_first"), F.col("n")).otherwise(0.0)).alias("first_n"),
        F.sum(F.when(~last, F.col("n") * weight).otherwise(0.0)).alias("decayed"), F.min("kind").alias("kind"), *map(_set, ("namespaces", "apps", "versions")),
    )
    events = timed.select("fingerprint", "ts", "seq", F.lit(True).alias("new"))
    if tail is not None:
        events = events.unionByName(tail.select("fingerprint", "ts", "seq", F.lit(False).alias("new")))
    trail = M.trailing_counts(events, rules.burst_seconds).filter("new").groupBy("fingerprint").agg(F.count("*").alias("events"), F.max("in_window").alias("most"), F.sum("in_window").alias("counted"))
    counts = M.facts(records, rules.seconds).groupBy("namespace", "window_start", "fingerprint").agg(F.sum("error_count").alias("error_count")).join(F.broadcast(span))
    edge = F.col("window_start").isin(F.col("page_first"), F.col("page_last"))
    end = timed.agg(F.max("ts").alias("end"))
    recent = events.select("fingerprint", "ts", "seq").join(F.broadcast(end)).filter(F.col("ts") >= F.col("end") - F.expr(f"INTERVAL {int(rules.burst_seconds)} SECONDS")).drop("end")
    return {
        "measures": measures.join(trail, "fingerprint"), "peaks": P.namespace_peaks(counts.filter(~edge), rules.thresholds, rules.cap_rows),
        "open": counts.filter(edge).select("namespace", "window_start", "fingerprint", "error_count"), "tail": recent,
    }


def absorb(folder: str, rules: Rules) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes the part of each batch of log rows."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [n for n in numbered(spark, folder, "batch=") if n < number]
        tail = spark.read.parquet(f"{folder}/batch={before[-1]}/tail") if before else None
        records = parse(batch.filter(F.col("level") == "ERROR")).persist()
        if not records.isEmpty():
            for name, rows in part(records, tail, rules).items():
                rows.write.mode("overwrite").parquet(f"{folder}/batch={number}/{name}")
        records.unpersist()

    return put


def stream_detections(logs: DataFrame, folder: str, checkpoint: str, rules: Rules):
    """Starts a stream of log rows that keeps parts under ``folder``."""
    return logs.writeStream.foreachBatch(absorb(folder, rules)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark: SparkSession, folder: str, rules: Rules, burst_threshold: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """All parts as one: a row per fingerprint as ``incidents.flagged`` takes it, and the peaks."""
    paths = [f"{folder}/batch={n}" for n in numbered(spark, folder, "batch=")]
    if not paths:
        raise FileNotFoundError(f"no part under {folder}")
    read = lambda name: spark.read.parquet(*(f"{p}/{name}" for p in paths))
    rows = read("measures")
    span = rows.agg(F.min("page_first").alias("w0"), F.max("page_last").alias("w1"))
    rows = rows.join(F.broadcast(span))  # one row
    current = F.col("page_last") == F.col("w1")
    # weights count back from the window before the current one; the very first window seeds the mean with its whole weight
    since = F.pow(F.lit(KEEP), _index(F.col("w1"), F.col("page_last"), rules.seconds) - 1)
    history = F.lit(V.ALPHA) * since * F.when(current, F.col("decayed")).otherwise(F.col("decayed") + F.col("last_n"))
    seed = F.when((F.col("page_first") == F.col("w0")) & (F.col("w0") < F.col("w1")), F.col("first_n") * KEEP * F.pow(F.lit(KEEP), _index(F.col("w1"), F.col("w0"), rules.seconds) - 1)).otherwise(0.0)
    m = rows.groupBy("fingerprint").agg(
        F.sum("total").cast("long").alias("total_count"), F.sum(F.when(current, F.col("last_n")).otherwise(0.0)).alias("current_rate"), F.sum(history + seed).alias("ewma"), F.min("kind").alias("kind"),
        *map(_set, ("namespaces", "apps", "versions")), F.sum("events").alias("events"), F.max("most").alias("max_count"), (F.sum("counted") / F.sum("events")).alias("avg_count"),
    )
    m = m.withColumn("baseline_ewma", F.when(F.col("total_count") > F.col("current_rate"), F.greatest("ewma", F.lit(5e-324))).otherwise(0.0))
    m = m.withColumn("trend_ratio", F.when(F.col("baseline_ewma") > 0, F.col("current_rate") / F.col("baseline_ewma")).otherwise(1.0)).withColumn("burst_ratio", F.col("max_count") / F.col("avg_count"))
    m = m.withColumn("is_burst", (F.col("events") >= 2) & (F.col("burst_ratio") > burst_threshold))
    m = m.select(
        "fingerprint", "kind.error_type", "kind.normalized_message", F.col("kind.seq").alias("first_seq"), "total_count", "current_rate", "baseline_ewma", "trend_ratio", F.array_sort("namespaces").alias("namespaces"), F.size("namespaces").alias("namespace_count"),
        F.array_sort("apps").alias("apps"), F.size("apps").alias("app_count"), F.array_sort("versions").alias("versions"), "max_count", "burst_ratio", "is_burst",
    )
    edges = P.namespace_peaks(read("open"), rules.thresholds, rules.cap_rows)
    return m, P.strongest(read("peaks").select(*P.PEAK).unionByName(edges.select(*P.PEAK)))


def detections(spark: SparkSession, folder: str, rules: Rules, burst_threshold: float = 5.0, **known) -> DataFrame:
    """Flags, evidence, class, score and severity of each fingerprint, as of the last page."""
    m, found = merged(spark, folder, rules, burst_threshold)
    return I.scored(I.flagged(m, found, burst_threshold=burst_threshold, **known))
