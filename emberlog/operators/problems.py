"""Problems: incidents rolled up by key, ranked, filtered, with the message patterns behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions import text as X
from emberlog.functions import values as V


def keyed(found: DataFrame, key: Column | None = None) -> DataFrame:
    """Incidents with ``problem_key`` (the aggregator's by default) and its parts."""
    name = X.problem_key(F.col("category"), F.col("apps"), F.col("error_type"), F.col("normalized_message")) if key is None else key
    rows = found.withColumn("problem_key", name)
    return rows.withColumn("flow", F.split("problem_key", ":", 3)[1]).withColumn("error_class", F.split("problem_key", ":", 3)[2])


def occurrences(current: Column, traces: Column, samples: Column) -> Column:
    """The first positive of count, traces and samples; one if none is."""
    positive = lambda c: F.when(c > 0, c)
    return F.coalesce(positive(current), positive(traces), positive(samples), F.lit(1)).cast("long")


def _unions(found: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Per problem the sorted sets of what the arrays ``names`` hold. Values are made distinct before they meet, so no row holds the arrays of all incidents."""
    marked = lambda i: lambda v: F.struct(F.lit(i).alias("i"), v.alias("v"))
    entries = F.concat(*(F.transform(F.coalesce(n, F.array().cast("array<string>")), marked(i)) for i, n in enumerate(names)))
    values = found.select("problem_key", F.inline(entries)).distinct()
    return values.groupBy("problem_key").agg(*(F.array_sort(F.collect_set(F.when(F.col("i") == i, F.col("v")))).alias(n) for i, n in enumerate(names)))


_PROBLEM_COLUMNS = (
    "problem_key", "category", "flow", "error_class", "incident_count", "total_occurrences", "fingerprints", "first_seen", "last_seen", "apps", "namespaces", "versions", "has_spike", "has_burst", "has_new", "has_regression",
    "has_cascade", "is_cross_namespace", "max_score", "max_severity", "sample_messages", "normalized_message", "error_type", "app_counts",
)


def problems(found: DataFrame) -> DataFrame:
    """One row per problem key: totals, sets, flags of any incident, the highest score with its severity (of equals the earliest incident's)."""
    rows = found.withColumn("n", occurrences(F.col("total_count"), F.lit(0), F.lit(1)))
    order = F.struct(F.col("score").alias("score"), (-F.col("first_seq")).alias("s"))
    flag = lambda c: F.bool_or(c)
    sets = ("apps", "namespaces", "versions")
    return rows.groupBy("problem_key").agg(
        F.first("category").alias("category"), F.first("flow").alias("flow"), F.first("error_class").alias("error_class"), F.count("*").alias("incident_count"), F.sum("n").alias("total_occurrences"),
        F.array_sort(F.collect_set("fingerprint")).alias("fingerprints"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), flag("is_spike").alias("has_spike"), flag("is_burst").alias("has_burst"), flag("is_new").alias("has_new"), flag("is_regression").alias("has_regression"),
        flag("is_cascade").alias("has_cascade"), flag("is_cross_namespace").alias("is_cross_namespace"), F.max("score").alias("max_score"), F.max_by("severity", order).alias("max_severity"),
        F.min_by("normalized_message", F.when(F.col("normalized_message") != "", F.col("first_seq"))).alias("normalized_message"), F.min_by("error_type", F.when(F.col("error_type") != "", F.col("first_seq"))).alias("error_type"),
    ).join(_unions(found, sets), "problem_key", "left").withColumns({s: F.coalesce(s, F.array().cast("array<string>")) for s in sets}).join(_first_samples(found), "problem_key", "left").join(_app_counts(found), "problem_key", "left").select(*_PROBLEM_COLUMNS)


def _first_samples(found: DataFrame, most: int = 5) -> DataFrame:
    """The first ``most`` sample messages of each problem. Rows beyond are left out before the shuffle, so no row holds all samples of a large problem."""
    rank = F.row_number().over(Window.partitionBy("problem_key").orderBy("first_seq", "sample_message"))
    first = found.select("problem_key", "first_seq", "sample_message").withColumn("rank", rank).filter(F.col("rank") <= most)
    return first.groupBy("problem_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "sample_message"))), lambda s: s["sample_message"]).alias("sample_messages"))


def _app_counts(found: DataFrame) -> DataFrame:
    """Counts by application of each problem as a map in order of name, summed by (problem, application) first."""
    entries = found.select("problem_key", F.explode("app_counts").alias("e")).groupBy("problem_key", F.col("e.key").alias("key")).agg(F.sum("e.n").alias("n"))
    return entries.groupBy("problem_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias("app_counts"))


def _summed(entries: str) -> Column:
    """Entries (key, n) in order of key as a map of sums."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    total = lambda k: F.aggregate(F.filter(entries, lambda e: e["key"] == k), F.lit(0).cast("long"), lambda a, e: a + e["n"])
    return F.map_from_arrays(keys, F.transform(keys, total))


def with_priority(rows: DataFrame, confidence: Column | None = None) -> DataFrame:
    sure = F.lit("") if confidence is None else confidence
    p = V.priority_score(F.col("max_score"), F.col("total_occurrences"), F.size("apps"), sure, F.col("has_new"), F.col("is_cross_namespace"), F.col("has_spike"), F.col("has_burst"))
    return rows.withColumn("priority", p)


def by_priority(rows: DataFrame, limit: int | None = None) -> DataFrame:
    out = rows.orderBy(F.desc("priority"), F.desc("total_occurrences"), F.desc("incident_count"), "problem_key")
    return out.limit(limit) if limit else out


def filtered(rows: DataFrame, min_score: float = 0, min_occurrences: int = 0, categories: list[str] | None = None, only_new: bool = False, only_spike: bool = False) -> DataFrame:
    out = rows.filter((F.col("max_score") >= min_score) & (F.col("total_occurrences") >= min_occurrences))
    if categories:
        out = out.filter(F.col("category").isin(categories))
    out = out.filter("has_new") if only_new else out
    return out.filter("has_spike") if only_spike else out


def is_actionable(min_occurrences: int = 50, confidence: Column | None = None) -> Column:
    """Severe, frequent, spiking, crossing namespaces or sure of their cause; rare unknown ones only if they spike or cross."""
    few = F.col("total_occurrences") < min_occurrences
    wide = F.col("has_spike") | F.col("is_cross_namespace")
    left_out = ((F.col("category") == "unknown") & few & ~wide) | ((F.col("error_class") == "unknown_error") & (F.col("total_occurrences") == 0))
    sure = F.lit(False) if confidence is None else F.coalesce(confidence == "high", F.lit(False))
    return ~left_out & (F.col("max_severity").isin("critical", "high") | ~few | wide | sure)


def peaks_of(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Problems that spike or burst, by score and volume."""
    out = rows.filter("has_spike or has_burst").orderBy(F.desc("max_score"), F.desc("total_occurrences"), "problem_key")
    return out.limit(limit) if limit else out


def patterns(found: DataFrame, limit: int = 5) -> DataFrame:
    """The message patterns of each problem: ``problem_key, rank, message, count, share_pct, signal, app``.

    Incidents are grouped by what their message says; wrappers count only where a problem has nothing else. The best by
    signal, count and key are kept, each text once.
    """
    text = X.useful_or(F.col("sample_message"), X.useful_content(F.col("normalized_message")))
    rows = found.withColumn("n", occurrences(F.col("total_count"), F.lit(0), F.lit(1))).withColumn("said", text)
    whole = Window.partitionBy("problem_key")
    rows = rows.withColumn("total", F.sum("n").over(whole)).withColumn("any_said", F.bool_or(F.col("said") != "").over(whole))
    rows = rows.filter((F.col("said") != "") | ~F.col("any_said")).withColumn("message", F.when(F.col("any_said"), F.col("said")).otherwise(F.substring("sample_message", 1, 250)))
    rows = rows.withColumn("signal", F.when(F.col("any_said"), X.signal_score(F.col("message"))).otherwise(F.lit(-1))).withColumn("key", X.trace_message(F.col("message"))).filter("key != ''")
    groups = rows.groupBy("problem_key", "key").agg(
        F.max_by("message", F.struct("signal", (-F.col("first_seq")).alias("s"))).alias("message"), F.max("signal").alias("signal"), F.sum("n").alias("count"), F.first("total").alias("total"),
        F.array_sort(F.flatten(F.collect_list("app_counts"))).alias("entries"),
    )
    groups = groups.withColumn("good", F.bool_or(F.col("signal") >= -2).over(whole)).filter((F.col("signal") >= -2) | ~F.col("good"))
    shown = X.let(X.smart_trim(F.col("message")), lambda t: F.when(t != "", t).otherwise(F.substring("message", 1, 250)))
    groups = groups.withColumn("message", shown).withColumn("text", F.lower(F.substring(X.trace_message(shown), 1, 80)))
    best = Window.partitionBy("problem_key", "text").orderBy(F.desc("signal"), F.desc("count"), "key")
    ranked = groups.withColumn("r", F.row_number().over(best)).filter("r = 1").withColumn("rank", F.row_number().over(Window.partitionBy("problem_key").orderBy(F.desc("signal"), F.desc("count"), "key"))).filter(F.col("rank") <= limit)
    app = V.ranked_counts(_summed("entries"))
    return ranked.select("problem_key", "rank", "message", "count", F.round(F.col("count") / F.col("total") * 100, 1).alias("share_pct"), "signal", F.coalesce(F.get(app, F.lit(0))["key"], F.lit("?")).alias("app"))


def root_causes(pattern_rows: DataFrame, step_texts: DataFrame | None = None) -> DataFrame:
    """Per problem the pattern that says most; one that only repeats a step (problem_key, text) counts last."""
    rows = pattern_rows.withColumn("text", F.lower(F.substring(X.trace_message(F.col("message")), 1, 80)))
    if step_texts is not None:
        rows = rows.join(step_texts.select("problem_key", "text", F.lit(-50).alias("dup")).distinct(), ["problem_key", "text"], "left")
    else:
        rows = rows.withColumn("dup", F.lit(0))
    rows = rows.withColumn("fit", (F.col("signal") >= 0).cast("int"))
    order = F.struct("fit", F.coalesce("dup", F.lit(0)).alias("dup"), "signal", "count", (-F.col("rank")).alias("r"))
    best = rows.groupBy("problem_key").agg(F.max_by(F.struct("app", "message", "signal"), order).alias("b"))
    return best.select(
        "problem_key", F.col("b.app").alias("service"), F.col("b.message").alias("message"), F.when(F.col("b.signal") > 0, "ERROR").otherwise("WARN").alias("level"),
        F.when(F.col("b.signal") >= 3, "high").when(F.col("b.signal") > 0, "medium").otherwise("low").alias("confidence"),
    )


# --- versions ---


def version_stats(found: DataFrame) -> DataFrame:
    """Per problem and version: occurrences, incidents, first and last time."""
    rows = found.select("problem_key", F.explode("versions").alias("version"), "total_count", "first_seen", "last_seen")
    return rows.groupBy("problem_key", "version").agg(F.sum("total_count").alias("occurrences"), F.count("*").alias("incidents"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def version_impact(stats: DataFrame) -> DataFrame:
    """Per problem: a version with over 3 times the mean of the others, the newest with over half of all, and a gap between versions."""
    whole = Window.partitionBy("problem_key")
    number = X.semver(F.col("version"))
    rows = stats.withColumn("n", F.count("*").over(whole)).withColumn("total", F.sum("occurrences").over(whole)).withColumn("semver", number)
    rows = rows.withColumn("top", F.row_number().over(whole.orderBy(F.desc("occurrences"), "version")) == 1)
    by_version = whole.orderBy(F.col("semver").desc_nulls_last(), F.desc("version"))
    rows = rows.withColumn("newest", F.row_number().over(by_version) == 1).withColumn("newer", F.when(F.lag("semver").over(by_version).isNotNull(), F.lag("occurrences").over(by_version)))
    rows = rows.withColumn("older", F.when(F.lead("semver").over(by_version).isNotNull(), F.lead("occurrences").over(by_version))).withColumn("numbered", F.count("semver").over(whole))
    others = (F.col("total") - F.col("occurrences")) / (F.col("n") - 1)
    spike = F.col("top") & (F.col("n") >= 2) & (F.try_divide(F.col("occurrences").cast("double"), others) > 3)
    fresh = F.col("newest") & F.col("semver").isNotNull() & (F.col("numbered") >= 2) & (F.col("occurrences") > F.col("total") * 0.5)
    gap = F.col("semver").isNotNull() & (F.col("occurrences") < F.col("newer") * 0.2) & (F.col("occurrences") < F.col("older") * 0.2)
    out = rows.groupBy("problem_key").agg(
        F.count("*").alias("total_versions"), F.sum("occurrences").alias("total_occurrences"), F.max(F.when(spike, F.col("version"))).alias("spike_version"),
        F.max(F.when(fresh, F.col("version"))).alias("new_version"), F.bool_or(F.coalesce(gap, F.lit(False))).alias("has_regression"), F.max(F.when(F.col("newest"), F.col("version"))).alias("newest_version"),
    )
    return out.withColumn("has_version_spike", F.col("spike_version").isNotNull()).withColumn("has_new_version_issue", F.col("new_version").isNotNull())


def version_summary(impact: DataFrame) -> DataFrame:
    return impact.agg(
        F.count_if("has_version_spike").alias("version_spikes"), F.count_if("has_regression").alias("regressions"), F.count_if("has_new_version_issue").alias("new_version_issues"),
    )
