"""Thresholds per namespace and weekday, and the peaks above them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions import values as V

PERCENTILE = 0.93
MIN_SAMPLES = 10
DEFAULT_THRESHOLD = 100.0


def train_thresholds(rows: DataFrame, as_of: str | None = None, weeks: int | None = None, p: float = PERCENTILE) -> DataFrame:
    """``namespace, dow, p93, samples, median, mean, max`` from counts per window (zeros included) before ``as_of``.

    A group is the windows of one namespace and weekday, bounded by time and not by events.
    """
    if as_of is not None:
        rows = rows.filter(F.col("window_start") < F.lit(as_of).cast("timestamp"))
        if weeks is not None:
            rows = rows.filter(F.col("window_start") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {7 * int(weeks)} DAYS"))
    v = F.collect_list(F.col("error_count").cast("double"))
    groups = rows.groupBy("namespace", F.weekday("window_start").alias("dow")).agg(v.alias("v"), F.count("*").alias("samples"), F.avg("error_count").alias("mean"), F.max("error_count").cast("double").alias("max"))
    return groups.select("namespace", "dow", V.floor_percentile(F.col("v"), p).alias("p93"), "samples", V.upper_median(F.col("v")).alias("median"), "mean", "max")


def caps(thresholds: DataFrame) -> DataFrame:
    """Per namespace: half the upper median and half the mean of its weekdays' thresholds."""
    g = thresholds.groupBy("namespace").agg(F.collect_list("p93").alias("v"), F.avg("p93").alias("avg_p93"), F.min("p93").alias("min_p93"), F.max("p93").alias("max_p93"), F.sum("samples").alias("total_samples"))
    return g.withColumn("median_p93", V.upper_median(F.col("v"))).withColumn("cap", (F.col("median_p93") + F.col("avg_p93")) / 2).drop("v")


def snapshot(thresholds: DataFrame, cap_rows: DataFrame, snapshot_id: str, completed_at: str, status: str = "complete") -> tuple[DataFrame, DataFrame]:
    """(snapshot row, its values): what a training run stores, thresholds rounded to two places."""
    spark = thresholds.sparkSession
    head = spark.range(1).select(F.lit(snapshot_id).alias("snapshot_id"), F.lit(completed_at).cast("timestamp").alias("completed_at"), F.lit(status).alias("status"))
    per_day = thresholds.select("namespace", "dow", F.round("p93", 2).alias("value"), "samples", F.lit("p93").alias("kind"))
    per_name = cap_rows.select("namespace", F.lit(None).cast("int").alias("dow"), F.round("cap", 2).alias("value"), F.col("total_samples").alias("samples"), F.lit("cap").alias("kind"))
    return head, per_day.unionByName(per_name).withColumn("snapshot_id", F.lit(snapshot_id))


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    return snapshots.filter("status = 'complete'").orderBy(F.desc("completed_at"), F.desc("snapshot_id")).limit(1)


def latest_values(snapshots: DataFrame, values: DataFrame) -> DataFrame:
    return values.join(F.broadcast(latest_snapshot(snapshots).select("snapshot_id")), "snapshot_id")  # one row


def with_thresholds(rows: DataFrame, thresholds: DataFrame, cap_rows: DataFrame, dow: Column, default: float = DEFAULT_THRESHOLD, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Adds ``p93`` and ``cap``: the weekday's threshold if it has samples enough, else the cap; a namespace without a cap has the default."""
    days = thresholds.filter(F.col("samples") >= min_samples).select("namespace", F.col("dow").alias("_dow"), F.col("p93").alias("_p93"))
    names = cap_rows.select("namespace", F.col("cap").alias("_cap"))
    joined = rows.withColumn("_dow", dow).join(names, "namespace", "left").join(days, ["namespace", "_dow"], "left")
    joined = joined.withColumn("cap", F.coalesce("_cap", F.lit(default))).withColumn("p93", F.coalesce("_p93", "_cap", F.lit(default)))
    return joined.drop("_dow", "_p93", "_cap")


def judged(rows: DataFrame, value: str = "error_count") -> DataFrame:
    """Adds ``is_peak`` and ``triggered_by`` (both, p93, cap or null) to rows with ``p93`` and ``cap``."""
    over, above = F.col(value) > F.col("p93"), F.col(value) > F.col("cap")
    return rows.withColumn("is_peak", over | above).withColumn("triggered_by", F.when(over & above, "both").when(over, "p93").when(above, "cap"))


def replaced_values(rows: DataFrame, value: str = "value", mean: str = "mean") -> DataFrame:
    """Adds ``replacement`` (the slot's mean or the lower threshold for peaks) and ``reason`` to judged rows."""
    limits = F.format_string("P93=%.0f, CAP=%.0f", F.bround("p93", 0), F.bround("cap", 0))
    shown = F.format_string("%.0f", F.bround(F.col(value).cast("double"), 0))
    said = F.when(F.col("is_peak"), F.concat(F.lit("PEAK ("), "triggered_by", F.lit("): value="), shown, F.lit(" > "), limits)).otherwise(F.concat(F.lit("OK: value="), shown, F.lit(" <= "), limits))
    return rows.withColumn("replacement", F.when(F.col("is_peak"), F.coalesce(mean, F.least("p93", "cap"))).otherwise(F.col(value).cast("double"))).withColumn("reason", said)


def namespace_peaks(fact_rows: DataFrame, thresholds: DataFrame, cap_rows: DataFrame, min_value: int = 1) -> DataFrame:
    """Peaks of namespace totals, each owned by the fingerprint that adds most (of equals the smallest); an owner keeps its strongest.

    Totals are aggregated and judged first, so that contributors are ranked in peak windows only.
    """
    per_fp = fact_rows.groupBy("namespace", "window_start", "fingerprint").agg(F.sum("error_count").alias("n"))
    totals = per_fp.groupBy("namespace", "window_start").agg(F.sum("n").alias("value"), F.count("*").alias("contributors"), F.min(F.struct((-F.col("n")).alias("down"), "fingerprint")).alias("owner")).filter(F.col("value") >= min_value)
    found = judged(with_thresholds(totals, thresholds, cap_rows, F.weekday("window_start")), "value").filter("is_peak")
    strength = F.greatest(F.coalesce(V.ratio(F.col("value"), F.col("p93")), F.lit(0.0)), F.coalesce(V.ratio(F.col("value"), F.col("cap")), F.lit(0.0)))
    found = found.withColumn("trigger_score", strength).withColumn("fingerprint", F.col("owner.fingerprint")).withColumn("contribution", -F.col("owner.down"))
    return strongest(found.select(*PEAK))


PEAK = ("fingerprint", "namespace", "window_start", "value", "contribution", "contributors", "p93", "cap", "triggered_by", "trigger_score")


def strongest(found: DataFrame) -> DataFrame:
    """Of each fingerprint's peaks the one of highest score (of equals the earliest, then the smallest namespace)."""
    best = F.min_by(F.struct(*PEAK[1:]), F.struct(-F.col("trigger_score"), F.col("window_start"), F.col("namespace"))).alias("b")
    return found.groupBy("fingerprint").agg(best).select("fingerprint", "b.*")


def threshold_grid(namespaces: DataFrame, thresholds: DataFrame, cap_rows: DataFrame, default: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Every namespace and weekday with its effective threshold: the weekday's, else the cap, else the default."""
    days = namespaces.sparkSession.range(7).select(F.col("id").cast("int").alias("dow"))
    grid = namespaces.select("namespace").distinct().crossJoin(F.broadcast(days))  # seven rows
    joined = grid.join(thresholds.select("namespace", "dow", "p93"), ["namespace", "dow"], "left").join(cap_rows.select("namespace", "cap"), "namespace", "left")
    return joined.withColumn("effective", F.coalesce("p93", "cap", F.lit(default)))


def slot_statistics(rows: DataFrame, shift_hours: int = 1) -> DataFrame:
    """Mean and deviation per weekday, hour, quarter and namespace, smoothed over three neighbours in time where there are three."""
    local = rows.withColumn("t", V.shifted(F.col("window_start"), shift_hours))
    keys = [F.weekday("t").alias("dow"), F.hour("t").alias("hour"), F.floor(F.minute("t") / 15).cast("int").alias("quarter"), F.col("namespace")]
    slots = local.select(*keys, "t", F.col("error_count").cast("double").alias("v"))
    by_slot = ["dow", "hour", "quarter", "namespace"]
    near = Window.partitionBy(*by_slot).orderBy("t").rowsBetween(-1, 1)
    whole = Window.partitionBy(*by_slot)
    smooth = slots.withColumn("s", F.when(F.count("*").over(whole) >= 3, F.avg("v").over(near)).otherwise(F.col("v")))
    return smooth.groupBy(*by_slot).agg(F.avg("s").alias("mean"), F.coalesce(F.stddev_samp("s"), F.lit(0.0)).alias("stddev"), F.count("*").alias("samples"))


# --- older rules, over values per slot of a day ---


def reference_by_neighbours(rows: DataFrame, count: int = 3) -> DataFrame:
    """Adds ``reference`` (mean of the values 15, 30, ... minutes before, same day only) and ``refs`` (how many there are)."""
    before = Window.partitionBy("namespace", F.to_date("window_start")).orderBy(F.unix_seconds("window_start")).rangeBetween(-V.WINDOW_SECONDS * count, -V.WINDOW_SECONDS)
    return rows.withColumn("reference", F.avg("error_count").over(before)).withColumn("refs", F.count("error_count").over(before))


def daily_average(rows: DataFrame) -> DataFrame:
    """Adds ``avg_24h``, the mean of the namespace's values in the 24 hours up to each window."""
    day = Window.partitionBy("namespace").orderBy(F.unix_seconds("window_start")).rangeBetween(-86400, 0)
    return rows.withColumn("avg_24h", F.avg("error_count").over(day))


def ratio_peaks(rows: DataFrame, baseline: DataFrame, *, either: bool = False, min_ratio: float = 3.0, min_multiplier: float = 2.5, min_value: float = 100.0) -> DataFrame:
    """Peaks by ratio to the windows before and by size against the day's mean; both must hold, or one with ``either``.

    ``baseline``: mean per (dow, hour, quarter, namespace), the reference where no window goes before.
    """
    r = daily_average(reference_by_neighbours(rows))
    keyed = r.select("*", *V.slot(F.col("window_start"))).join(baseline.select("dow", "hour", "quarter", "namespace", F.col("mean").alias("baseline_mean")), ["dow", "hour", "quarter", "namespace"], "left")
    keyed = keyed.withColumn("reference", F.coalesce("reference", "baseline_mean", F.lit(0.0))).withColumn("minimum", F.when(F.col("avg_24h") > 0, F.col("avg_24h") * min_multiplier).otherwise(F.lit(min_value)))
    keyed = keyed.withColumn("ratio", V.ratio(F.col("error_count"), F.col("reference")))
    large, steep = F.col("error_count") >= F.col("minimum"), F.coalesce(F.col("ratio") >= min_ratio, F.lit(False))
    based = F.coalesce(F.col("baseline_mean") > 0, F.lit(False)) & (F.col("reference") > 0)
    rule = (large | steep) if either else F.when(based, large & steep).otherwise(large)
    return keyed.withColumn("is_peak", rule)


def replaced_series(rows: DataFrame, limit: float = 300.0, steep: float = 20.0, lookback: int = 5) -> DataFrame:
    """Peaks against values in which earlier peaks are already replaced: ``namespace, window_start, error_count, reference, is_peak, replacement``.

    Each value depends on replacements before it, so a day's at most 96 values of a namespace are folded in order; the
    fold is one expression over an array that time bounds.
    """
    day = rows.groupBy("namespace", F.to_date("window_start").alias("day")).agg(F.array_sort(F.collect_list(F.struct(F.unix_seconds("window_start").alias("t"), F.col("error_count").cast("double").alias("v")))).alias("slots"))
    kind = "array<struct<t:bigint,v:double,reference:double,is_peak:boolean,replacement:double>>"

    def step(acc: Column, x: Column) -> Column:
        near = F.filter(acc, lambda p: (p["t"] < x["t"]) & (p["t"] >= x["t"] - lookback * V.WINDOW_SECONDS))
        total = F.aggregate(near, F.lit(0.0), lambda s, p: s + p["replacement"])
        reference = F.when(F.size(near) > 0, total / F.size(near)).otherwise(F.lit(0.0))
        peak = F.when(F.size(near) == 0, x["v"] > limit).otherwise((x["v"] > limit) | (reference <= 0) | (x["v"] >= steep * reference))
        new = F.when(peak & (F.size(near) > 0), reference).otherwise(x["v"])
        return F.concat(acc, F.array(F.struct(x["t"].alias("t"), x["v"].alias("v"), reference.alias("reference"), peak.alias("is_peak"), new.alias("replacement"))))

    folded = day.select("namespace", F.inline(F.aggregate("slots", F.array().cast(kind), step)))
    return folded.select("namespace", F.timestamp_seconds("t").alias("window_start"), F.col("v").alias("error_count"), "reference", "is_peak", "replacement")
