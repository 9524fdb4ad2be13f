"""Counts over time: facts, rates against a baseline, rolling baselines, bursts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions import values as V

FACT_KEY = ("window_start", "namespace", "app_name", "fingerprint")


def facts(records: DataFrame, seconds: int = V.WINDOW_SECONDS) -> DataFrame:
    """Exact counts per window, namespace, application and fingerprint; rows without a time are left out."""
    timed = records.filter(F.col("ts").isNotNull()).withColumn("window_start", V.bucket(F.col("ts"), seconds))
    return timed.groupBy(*FACT_KEY).agg(
        F.count("*").alias("error_count"), F.min("ts").alias("first_event_at"), F.max("ts").alias("last_event_at"), F.first("error_type").alias("error_type"), F.min("seq").alias("first_seq")
    )


def namespace_counts(fact_rows: DataFrame) -> DataFrame:
    return fact_rows.groupBy("namespace", "window_start").agg(F.sum("error_count").alias("error_count"))


def fingerprint_counts(fact_rows: DataFrame) -> DataFrame:
    return fact_rows.groupBy("fingerprint", "namespace", "window_start").agg(F.sum("error_count").alias("error_count"))


def windows(start: Column, end: Column, seconds: int = V.WINDOW_SECONDS) -> Column:
    """All window starts in [start, end)."""
    return F.sequence(start, end - F.expr(f"INTERVAL {int(seconds)} SECONDS"), F.expr(f"INTERVAL {int(seconds)} SECONDS"))


def dense_namespace_counts(fact_rows: DataFrame, namespaces: DataFrame, start: str | None = None, end: str | None = None, seconds: int = V.WINDOW_SECONDS) -> DataFrame:
    """A row for every window of [start, end) and monitored namespace, zeros included. Without bounds: from the first to the last window with facts.

    The grid is windows x namespaces and grows with time, not with events; counts are made before they meet it.
    """
    counts = namespace_counts(fact_rows)
    if start is None or end is None:
        step = F.expr(f"INTERVAL {int(seconds)} SECONDS")
        span = counts.agg(F.min("window_start").alias("a"), (F.max("window_start") + step).alias("b"))
    else:
        span = namespaces.sparkSession.range(1).select(F.lit(start).cast("timestamp").alias("a"), F.lit(end).cast("timestamp").alias("b"))
    grid = span.select(F.explode(windows(F.col("a"), F.col("b"), seconds)).alias("window_start")).crossJoin(namespaces.select("namespace").distinct())
    return grid.join(counts, ["window_start", "namespace"], "left").select("window_start", "namespace", F.coalesce("error_count", F.lit(0)).cast("long").alias("error_count"))


def ranked_counter(rows: DataFrame, key: str, by: str = "fingerprint", limit: int | None = None) -> DataFrame:
    """Counts of ``key`` per ``by`` as an array of (key, n): most frequent first, of equals the one that came first."""
    n = rows.filter(F.col(key).isNotNull()).groupBy(by, F.col(key).alias("key")).agg(F.count("*").alias("n"), F.min("seq").alias("seq"))
    if limit:
        top = Window.partitionBy(by).orderBy(F.desc("n"), "seq")
        n = n.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= limit)
    return _ranked(n, key, by)


def _ranked(n: DataFrame, key: str, by: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("down"), "seq", "key", "n")))
    return n.groupBy(by).agg(F.transform(ordered, lambda x: F.struct(x["key"].alias("key"), x["n"].alias("n"))).alias(key))


def _decayed(index: Column, size: Column) -> Column:
    """Weight of value ``index`` of ``size`` in an exponentially weighted mean that goes on from earlier values."""
    return F.lit(V.ALPHA) * F.pow(F.lit(1 - V.ALPHA), (size - 1 - index).cast("double"))


def _at(filled: Column, zeros: Column, j: Column) -> Column:
    """Element j of the sorted values, of which ``zeros`` are 0 and the rest are the sorted positive ``filled``."""
    return F.when(j < zeros, F.lit(0.0)).otherwise(F.get(filled, (j - zeros).cast("int")))


def _median(filled: Column, zeros: Column) -> Column:
    n = F.size(filled) + zeros
    return F.when(n == 0, F.lit(0.0)).otherwise((_at(filled, zeros, F.floor((n - 1) / 2)) + _at(filled, zeros, F.floor(n / 2))) / 2)


def _mad(filled: Column, zeros: Column, median: Column) -> Column:
    n = F.size(filled) + zeros
    far = F.sort_array(F.transform(filled, lambda x: F.abs(x - median)))
    below = F.size(F.filter(far, lambda d: d < median))
    at = lambda j: F.when(j < below, F.get(far, j.cast("int"))).when(j < below + zeros, median).otherwise(F.get(far, (j - zeros).cast("int")))
    return F.when(n <= 1, F.lit(0.0)).otherwise((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)


def cells(records: DataFrame, seconds: int = V.WINDOW_SECONDS) -> DataFrame:
    """Records by fingerprint, window (null without a time), namespace, application and originator: what facts, measurements and counters are sums of.

    ``first``: the record of least ``seq``, with what is read of it.
    """
    first = F.struct("seq", "error_type", "normalized_message", F.col("raw_message") if "raw_message" in records.columns else F.lit(None).cast("string").alias("raw_message"))
    return records.withColumn("w", V.bucket(F.col("ts"), seconds)).groupBy("fingerprint", "w", "namespace", "app_name", "originator").agg(
        F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.min(first).alias("first"), F.collect_set("app_version").alias("versions")
    )


def cell_facts(cell_rows: DataFrame) -> DataFrame:
    """The facts of ``facts``, from cells."""
    return cell_rows.filter("w is not null").groupBy(F.col("w").alias("window_start"), "namespace", "app_name", "fingerprint").agg(
        F.sum("n").alias("error_count"), F.min("first_at").alias("first_event_at"), F.max("last_at").alias("last_event_at"), F.min("first")["error_type"].alias("error_type"), F.min("first")["seq"].alias("first_seq")
    )


def cell_counter(cell_rows: DataFrame, key: str, by: str = "fingerprint") -> DataFrame:
    """``ranked_counter`` from cells."""
    return _ranked(cell_rows.filter(F.col(key).isNotNull()).groupBy(by, F.col(key).alias("key")).agg(F.sum("n").alias("n"), F.min("first")["seq"].alias("seq")), key, by)


def measure(records: DataFrame, history: DataFrame | None = None, type_history: DataFrame | None = None, seconds: int = V.WINDOW_SECONDS) -> DataFrame:
    """One row per fingerprint: current window against a baseline.

    A fingerprint's rates are its counts in all windows between the first and last of *any* fingerprint; the last
    window is the current one. The baseline (mean, EWMA, median, MAD) is over the windows before, after the rates that
    ``history`` (fingerprint, rates) has, or else ``type_history`` (error_type, rates). Windows without events are not
    laid out: zeros are counted, and EWMA weights follow from the index, so all is one aggregate per fingerprint.
    """
    plain = records.withColumn("originator", F.lit(None).cast("string")).withColumn("raw_message", F.lit(None).cast("string")).withColumn("normalized_message", F.lit(None).cast("string"))
    return measure_cells(cells(plain.withColumn("app_version", F.lit(None).cast("string")).filter(F.col("ts").isNotNull()), seconds), history, type_history, seconds)


def measure_cells(cell_rows: DataFrame, history: DataFrame | None = None, type_history: DataFrame | None = None, seconds: int = V.WINDOW_SECONDS) -> DataFrame:
    """``measure`` from cells."""
    timed = cell_rows.filter("w is not null")
    sets = timed.groupBy("fingerprint").agg(F.array_sort(F.collect_set("namespace")).alias("namespaces"), F.array_sort(F.collect_set("app_name")).alias("apps"))
    cells = timed.groupBy("fingerprint", "w").agg(F.sum("n").cast("double").alias("n"), F.min("first_at").alias("first"), F.max("last_at").alias("last"), F.min(F.struct("first.seq", "first.error_type")).alias("kind"))
    span = cells.agg(F.min("w").alias("w0"), F.max("w").alias("w1"))
    cells = cells.join(F.broadcast(span)).withColumn("i", V.window_index(F.col("w"), F.col("w0"), seconds)).withColumn("size", V.window_index(F.col("w1"), F.col("w0"), seconds))  # one row
    earlier = F.col("i") < F.col("size")
    m = cells.groupBy("fingerprint").agg(
        F.first("size").alias("size"), F.min("kind")["error_type"].alias("error_type"), F.sum(F.when(~earlier, F.col("n")).otherwise(0.0)).alias("current"), F.sum("n").cast("long").alias("total_count"),
        F.count("*").alias("active_windows"), F.sum(F.when(earlier, F.col("n") * _decayed(F.col("i"), F.col("size")))).alias("decayed"), F.max(F.when(F.col("i") == 0, F.col("n"))).alias("first_rate"),
        F.sort_array(F.collect_list(F.when(earlier, F.col("n")))).alias("rates"), F.min("first").alias("first_seen"), F.max("last").alias("last_seen"),
    ).join(sets, "fingerprint")
    none = F.array().cast("array<double>")
    m = m.join(history.select("fingerprint", F.col("rates").cast("array<double>").alias("past")), "fingerprint", "left") if history is not None else m.withColumn("past", F.lit(None).cast("array<double>"))
    if type_history is not None:
        m = m.join(type_history.select("error_type", F.col("rates").cast("array<double>").alias("type_past")), "error_type", "left").withColumn("past", F.coalesce("past", "type_past")).drop("type_past")
    m = m.withColumn("past", F.coalesce("past", none))
    # The first value of all seeds the mean with its whole weight
    seed = F.when(F.size("past") > 0, V.ewma(F.col("past")) * F.pow(F.lit(1 - V.ALPHA), F.col("size").cast("double"))).otherwise(
        F.coalesce("first_rate", F.lit(0.0)) * F.lit(1 - V.ALPHA) * F.pow(F.lit(1 - V.ALPHA), (F.col("size") - 1).cast("double"))
    )
    samples = F.col("size") + F.size("past")
    filled = F.sort_array(F.concat("rates", F.filter("past", lambda x: x > 0)))
    m = m.withColumn("ewma", F.when(F.col("size") == 0, V.ewma(F.col("past"))).otherwise(F.coalesce("decayed", F.lit(0.0)) + seed)).withColumn("filled", filled)
    # Repeated rounding keeps a mean of positive rates at the least positive number, where a power of the weight is zero
    m = m.withColumn("ewma", F.when(F.size("filled") > 0, F.greatest("ewma", F.lit(5e-324))).otherwise(F.col("ewma")))
    m = m.withColumn("zeros", samples - F.size("filled")).withColumn("median", _median(F.col("filled"), F.col("zeros")))
    m = m.withColumn("mad", _mad(F.col("filled"), F.col("zeros"), F.col("median"))).withColumn("mean", F.when(samples > 0, F.aggregate("filled", F.lit(0.0), lambda a, x: a + x) / samples).otherwise(F.lit(0.0)))
    m = m.withColumn("trend_ratio", F.when(F.col("ewma") > 0, F.col("current") / F.col("ewma")).otherwise(F.lit(1.0)))
    return m.select(
        "fingerprint", "error_type", F.col("current").cast("long").alias("current_count"), F.col("current").alias("current_rate"), F.col("ewma").alias("baseline_ewma"), F.col("mad").alias("baseline_mad"),
        F.col("median").alias("baseline_median"), F.col("mean").alias("baseline_mean"), samples.alias("sample_count"), "trend_ratio",
        F.when(F.col("trend_ratio") > 1.2, "increasing").when(F.col("trend_ratio") < 0.8, "decreasing").otherwise("stable").alias("trend_direction"), "total_count", "active_windows",
        "namespaces", F.size("namespaces").alias("namespace_count"), "apps", F.size("apps").alias("app_count"), "first_seen", "last_seen",
        F.floor((F.unix_micros("last_seen") - F.unix_micros("first_seen")) / 1_000_000).cast("long").alias("duration_sec"),
    )


def rolling_baseline(rates: DataFrame, key: str = "fingerprint", order: str = "window_start", value: str = "error_count", size: int = 20) -> DataFrame:
    """The baseline after each window, over the last ``size`` rates."""
    last = Window.partitionBy(key).orderBy(order).rowsBetween(1 - size, 0)
    rows = rates.withColumn("rates", F.collect_list(F.col(value).cast("double")).over(last)).withColumn("stddev", F.coalesce(F.stddev_samp(F.col(value)).over(last), F.lit(0.0)))
    return rows.select(
        key, order, V.ewma(F.col("rates")).alias("ewma"), V.array_median(F.col("rates")).alias("median"), V.array_mad(F.col("rates")).alias("mad"), V.array_mean(F.col("rates")).alias("mean"),
        "stddev", F.size("rates").alias("sample_count"),
    )


def trailing_counts(records: DataFrame, seconds: int = 60, key: str = "fingerprint") -> DataFrame:
    """``in_window``: events of the key in the ``seconds`` up to each event, of equal times only those that came before.

    Every event counts in its own period and is context for the next one, so that a period, not a key, is what one task holds.
    """
    span = seconds * 1_000_000
    timed = records.filter(F.col("ts").isNotNull()).withColumn("us", F.unix_micros("ts"))
    period = F.floor(F.col("us") / span)
    both = timed.withColumn("period", F.explode(F.array(period, period + 1))).withColumn("own", F.col("period") == period)
    order = Window.partitionBy(key, "period").orderBy("us", "seq")
    expired = Window.partitionBy(key, "period").orderBy("us").rangeBetween(Window.unboundedPreceding, -span - 1)
    counted = both.withColumn("in_window", F.row_number().over(order) - F.count("*").over(expired))
    return counted.filter("own").drop("us", "period", "own")


def bursts(records: DataFrame, seconds: int = 60, threshold: float = 5.0) -> DataFrame:
    """Per fingerprint the largest and mean trailing count; a burst if their ratio is above the threshold (two timed events at least)."""
    per = trailing_counts(records.select("fingerprint", "ts", "seq"), seconds).groupBy("fingerprint").agg(F.count("*").alias("events"), F.max("in_window").alias("max_count"), F.avg("in_window").alias("avg_count"))
    return per.withColumn("burst_ratio", F.col("max_count") / F.col("avg_count")).withColumn("is_burst", (F.col("events") >= 2) & (F.col("burst_ratio") > threshold))
