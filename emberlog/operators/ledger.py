"""The run ledger, authoritative facts, baselines from them, and daily rollups with retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions import values as V
from emberlog.sources.tables import staged

ROLLUP_KEY = ("rollup_date", "namespace", "application", "fingerprint", "error_type", "category", "subcategory")
FULL_DAY = 96


def authoritative_windows(namespace_rows: DataFrame, runs: DataFrame) -> DataFrame:
    """``run_id, window_start``: for each window the complete, not superseded run that ended last (then started last, then largest id)."""
    held = namespace_rows.select("run_id", "window_start").distinct()
    done = runs.filter((F.col("status") == "complete") & F.col("superseded_by_run_id").isNull()).select("run_id", "completed_at", "started_at")
    order = Window.partitionBy("window_start").orderBy(F.col("completed_at").desc_nulls_last(), F.desc("started_at"), F.desc("run_id"))
    return held.join(done, "run_id").withColumn("r", F.row_number().over(order)).filter("r = 1").select("run_id", "window_start")


def complete_rows(fact_rows: DataFrame, authority: DataFrame) -> DataFrame:
    return fact_rows.join(authority, ["run_id", "window_start"], "left_semi")


def superseded(runs: DataFrame, new_run: str, window_start: str, window_end: str) -> DataFrame:
    """The ledger after ``new_run`` has replayed a window: earlier complete runs of it are superseded."""
    same = (F.col("window_start") == F.lit(window_start).cast("timestamp")) & (F.col("window_end") == F.lit(window_end).cast("timestamp"))
    old = same & (F.col("status") == "complete") & (F.col("run_id") != new_run) & F.col("superseded_by_run_id").isNull()
    return runs.withColumns({"superseded_by_run_id": F.when(old, F.lit(new_run)).otherwise(F.col("superseded_by_run_id")), "status": F.when(old, "superseded").otherwise(F.col("status"))})


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with equal keys; of several new rows of a key the last by ``loaded_at`` if there is one."""
    if "loaded_at" in new.columns:
        latest = Window.partitionBy(*keys).orderBy(F.desc("loaded_at"))
        new = new.withColumn("_r", F.row_number().over(latest)).filter("_r = 1").drop("_r")
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def is_processed(days: DataFrame, authority: DataFrame) -> DataFrame:
    """Days that have an authoritative window."""
    return days.join(authority.select(F.to_date("window_start").alias("day")).distinct(), "day", "left_semi")


# --- baselines ---


def fingerprint_rates(fingerprints: DataFrame, fact_rows: DataFrame, authority: DataFrame, as_of: str, days: int = 7, min_samples: int = 3) -> DataFrame:
    """``fingerprint, rates``: counts in every complete window of the ``days`` before ``as_of``, zeros included.

    Only windows with events are rows. Zeros are laid between them in each fingerprint's array, by the windows' numbers.
    """
    end = F.lit(as_of).cast("timestamp")
    inside = (F.col("window_start") >= end - F.expr(f"INTERVAL {int(days)} DAYS")) & (F.col("window_start") < end)
    held = authority.filter(inside)
    n = complete_rows(fact_rows.filter(inside), held).groupBy("fingerprint", "window_start").agg(F.sum("error_count").alias("n"))
    numbered = held.select("window_start").distinct().withColumn("i", F.row_number().over(Window.orderBy("window_start")))  # 96 windows a day at most
    size = numbered.count()
    if size < min_samples:
        return fingerprints.select("fingerprint").distinct().withColumn("rates", F.array().cast("array<double>")).limit(0)
    some = n.join(numbered, "window_start").groupBy("fingerprint").agg(F.array_sort(F.collect_list(F.struct("i", F.col("n").cast("double").alias("n")))).alias("v"))
    zeros = lambda k: F.array_repeat(F.lit(0.0), k)
    before = lambda k: F.when(k > 0, F.get("v", k - 1)["i"]).otherwise(0)
    filled = F.flatten(F.transform("v", lambda x, k: F.concat(zeros(x["i"] - before(k) - 1), F.array(x["n"]))))
    rates = F.concat(filled, zeros(F.lit(size) - F.element_at("v", -1)["i"]))
    out = fingerprints.select("fingerprint").distinct().join(some, "fingerprint", "left")
    return out.select("fingerprint", F.when(F.col("v").isNull(), zeros(F.lit(size))).otherwise(rates).alias("rates"))


def baseline_stats(rates: DataFrame) -> DataFrame:
    r = F.col("rates")
    return rates.select("fingerprint", F.array_min(r).alias("min"), F.array_max(r).alias("max"), V.array_mean(r).alias("avg"), V.upper_median(r).alias("median"), F.size(r).alias("samples"))


def merged_slot_means(old: DataFrame, new: DataFrame) -> DataFrame:
    """Slot means of old and new samples, weighted by their number."""
    both = old.unionByName(new).groupBy("dow", "hour", "quarter", "namespace")
    return both.agg((F.sum(F.col("mean") * F.col("samples")) / F.sum("samples")).alias("mean"), F.sum("samples").alias("samples"))


# --- rollups and retention ---


def kind_rollup(complete_facts: DataFrame, cutoff: str) -> DataFrame:
    old = complete_facts.filter(F.col("window_start") < F.lit(cutoff).cast("timestamp")).withColumn("rollup_date", F.to_date("window_start"))
    return old.groupBy(*ROLLUP_KEY).agg(
        F.sum("error_count").alias("error_count"), F.countDistinct("window_start").alias("complete_window_count"), F.min("first_event_at").alias("first_event_at"), F.max("last_event_at").alias("last_event_at")
    )


def namespace_windows(complete_namespaces: DataFrame, legacy: DataFrame, cutoff: str) -> DataFrame:
    """Authoritative windows, and legacy rows (ts, namespace, error_count) of windows without one."""
    end = F.lit(cutoff).cast("timestamp")
    facts = complete_namespaces.filter(F.col("window_start") < end).select(F.to_date("window_start").alias("rollup_date"), "window_start", "namespace", "error_count", F.lit("authoritative_facts").alias("source_kind"))
    raw = legacy.filter(F.col("ts") < end).select(F.to_date("ts").alias("rollup_date"), F.col("ts").alias("window_start"), "namespace", F.coalesce("error_count", F.lit(0)).alias("error_count"), F.lit("legacy_peak_raw_data").alias("source_kind"))
    return facts.unionByName(raw.join(facts.select("window_start", "namespace"), ["window_start", "namespace"], "left_anti").select(*facts.columns))


def namespace_rollup(staged_windows: DataFrame) -> DataFrame:
    all_of = lambda kind: F.every(F.col("source_kind") == kind)
    kind = F.when(all_of("authoritative_facts"), "authoritative_facts").when(all_of("legacy_peak_raw_data"), "legacy_peak_raw_data").otherwise("mixed")
    return staged_windows.groupBy("rollup_date", "namespace").agg(F.sum("error_count").alias("error_count"), F.countDistinct("window_start").alias("complete_window_count"), kind.alias("source_kind"))


def rejected_days(existing: DataFrame, staged_windows: DataFrame) -> DataFrame:
    """Days that have a rollup already and whose replay is not a full day of authoritative windows."""
    days = staged_windows.groupBy("rollup_date").agg(F.countDistinct(F.when(F.col("source_kind") == "authoritative_facts", F.col("window_start"))).alias("windows"))
    return days.join(existing.select("rollup_date").distinct(), "rollup_date", "left_semi").filter(F.col("windows") < FULL_DAY)


def rollup_differences(staged_rollup: DataFrame, stored: DataFrame, keys: tuple[str, ...] = ROLLUP_KEY) -> DataFrame:
    """Staged rows that are not stored with the same counts; keys may be null on both sides."""
    s = stored.withColumnsRenamed({c: f"s_{c}" for c in stored.columns})
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"s_{k}"))
        cond = c if cond is None else cond & c
    differ = ~F.col("error_count").eqNullSafe(F.col("s_error_count")) | ~F.col("complete_window_count").eqNullSafe(F.col("s_complete_window_count"))
    return staged_rollup.join(s, cond, "left").filter(differ).select(*keys, "error_count", "s_error_count")


def maintain(complete_facts: DataFrame, complete_namespaces: DataFrame, legacy: DataFrame, stored_kinds: DataFrame, stored_namespaces: DataFrame, cutoff: str) -> dict[str, DataFrame]:
    """Retention in its order: roll up, refuse partial replays, replace, reconcile, keep what is newer than the cutoff."""
    windows = staged(namespace_windows(complete_namespaces, legacy, cutoff), "rollup-windows")  # read by the guard and the rollup
    if bad := rejected_days(stored_namespaces, windows).count():
        raise ValueError(f"{bad} days have a rollup and no full day of windows to replace it")
    kinds, names = staged(kind_rollup(complete_facts, cutoff), "rollup-kinds"), namespace_rollup(windows)
    new_kinds, new_names = upserted(stored_kinds, kinds, list(ROLLUP_KEY)), upserted(stored_namespaces, names, ["rollup_date", "namespace"])
    if bad := rollup_differences(kinds, new_kinds).count():
        raise ValueError(f"{bad} rollup rows do not reconcile")
    end = F.lit(cutoff).cast("timestamp")
    return {"kind_rollups": new_kinds, "namespace_rollups": new_names, "facts": complete_facts.filter(F.col("window_start") >= end), "namespaces": complete_namespaces.filter(F.col("window_start") >= end)}


# --- health views ---


def metadata_quality(fact_rows: DataFrame) -> DataFrame:
    n = F.col("error_count")
    part = lambda cond: F.sum(F.when(cond, n))
    return fact_rows.groupBy("run_id", "window_start").agg(
        F.sum(n).alias("total_events"), part(F.col("metadata_quality") == "structured").alias("structured_events"), part(F.col("metadata_quality") == "derived").alias("derived_events"),
        part(F.col("metadata_quality") == "unknown").alias("unknown_events"), part(F.col("error_type") == "UnknownError").alias("unknown_type_events"), part(F.col("subcategory") == "unclassified").alias("unclassified_events"),
        F.round(F.lit(100.0) * part(F.col("metadata_quality") == "unknown") / F.nullif(F.sum(n), F.lit(0)), 2).alias("unknown_pct"),
    )


def pipeline_health(runs: DataFrame, now: str) -> DataFrame:
    end = F.coalesce("completed_at", F.lit(now).cast("timestamp"))
    return runs.select(
        "run_id", "status", ((F.unix_micros(end) - F.unix_micros("started_at")) / 1e6).alias("duration_seconds"), (F.col("expected_count") - F.col("fetched_count")).alias("source_delta"),
        (F.col("fetched_count") - F.col("persisted_count")).alias("persistence_delta"),
    )


def delivery_health(deliveries: DataFrame) -> DataFrame:
    return deliveries.groupBy(F.date_trunc("hour", "attempted_at").alias("hour_start"), "notification_type", "destination", "status").agg(F.count("*").alias("deliveries"))


def delivery_outcomes(deliveries: DataFrame) -> DataFrame:
    """Per dedup key whether it was delivered, failed or suppressed in any attempt; unknown states and empty keys don't count."""
    rows = deliveries.select(F.trim("dedup_key").alias("dedup_key"), F.lower(F.trim("status")).alias("status")).filter((F.col("dedup_key") != "") & F.col("status").isin("delivered", "failed", "suppressed", "skipped"))
    any_of = lambda s: F.bool_or(F.col("status") == s)
    return rows.groupBy("dedup_key").agg(any_of("delivered").alias("delivered"), any_of("failed").alias("failed"), any_of("suppressed").alias("suppressed"))


def delivery_status(outcomes: DataFrame) -> DataFrame:
    """One row: failed if a key failed and was never delivered, partial, complete, suppressed or skipped."""
    lost, sent = F.bool_or(F.col("failed") & ~F.col("delivered")), F.bool_or("delivered")
    kind = F.when(lost, "failed").when(F.bool_or("failed") & sent, "partial").when(sent, "complete").when(F.bool_or("suppressed"), "suppressed").otherwise("skipped")
    return outcomes.agg(kind.alias("status"), F.count_if(F.col("failed") & ~F.col("delivered")).alias("failed_keys"), F.count_if("delivered").alias("delivered_keys"))


def missing_slots(days: Column, namespaces: DataFrame, stored: DataFrame) -> DataFrame:
    """Slots (day, hour, quarter, namespace) of the grid that have no stored row."""
    spark = namespaces.sparkSession
    slots = spark.range(FULL_DAY).select(F.floor(F.col("id") / 4).cast("int").alias("hour"), (F.col("id") % 4).cast("int").alias("quarter"))
    grid = spark.range(1).select(F.explode(days).alias("day")).crossJoin(F.broadcast(slots)).crossJoin(F.broadcast(namespaces.select("namespace").distinct()))  # 96 slots; a configured list
    return grid.join(stored, ["day", "hour", "quarter", "namespace"], "left_anti")
