"""Daily and peak reports, comparisons of rules, and checks of stored data.

Most read stored incident rows: window_start, namespace, fingerprint, error_count, apps, top_app, error_type, category,
subcategory, score, severity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions import text as X
from emberlog.functions import values as V

DAY = "day"


def with_day(rows: DataFrame) -> DataFrame:
    return rows.withColumn(DAY, F.to_date("window_start"))


# --- daily report ---


def daily_statistics(rows: DataFrame, *dims: str) -> DataFrame:
    """Incidents (fingerprints) and errors per day, and by the given columns."""
    return with_day(rows).groupBy(DAY, *dims).agg(F.countDistinct("fingerprint").alias("incidents"), F.sum("error_count").alias("errors"), F.countDistinct(F.when(F.col("severity") == "critical", F.col("fingerprint"))).alias("critical"))


def day_over_day(days: DataFrame) -> DataFrame:
    """Change in percent against the day before, and the day's status."""
    w = Window.orderBy(DAY)  # a row per day
    pct = lambda c: F.coalesce((F.col(c) - F.lag(c).over(w)) / F.nullif(F.lag(c).over(w), F.lit(0)) * 100, F.lit(0.0))
    out = days.withColumn("error_change", pct("errors")).withColumn("incident_change", pct("incidents"))
    return out.withColumn("status", V.day_status(F.col("error_change"), F.col("incident_change"), F.col("critical")))


def top_per_app(rows: DataFrame, count: int = 10) -> DataFrame:
    """The fingerprints with most errors of each day and application."""
    n = with_day(rows).groupBy(DAY, "app_name", "fingerprint").agg(F.sum("error_count").alias("n"))
    order = Window.partitionBy(DAY, "app_name").orderBy(F.desc("n"), "fingerprint")
    return n.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def related_apps(rows: DataFrame) -> DataFrame:
    """Applications of one day that share fingerprints, and how many. Few applications have one fingerprint, which bounds the pairs."""
    a = with_day(rows).select(DAY, "fingerprint", "app_name").distinct()
    b = a.withColumnRenamed("app_name", "other")
    return a.join(b, [DAY, "fingerprint"]).filter("app_name < other").groupBy(DAY, "app_name", "other").agg(F.count("*").alias("shared"))


def daily_clusters(rows: DataFrame, count: int = 10, least: int = 2) -> DataFrame:
    """Per day the largest groups of fingerprints of one class whose three commonest applications are the same."""
    per_app = with_day(rows).groupBy(DAY, "fingerprint", "app_name").agg(F.first("category").alias("category"), F.first("subcategory").alias("subcategory"), F.sum("error_count").alias("n"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("down"), "app_name")))
    per = per_app.groupBy(DAY, "fingerprint").agg(F.first("category").alias("category"), F.first("subcategory").alias("subcategory"), ranked.alias("apps"), F.sum("n").alias("n"))
    first = F.array_sort(F.transform(F.slice("apps", 1, 3), lambda x: x["app_name"]))
    g = per.groupBy(DAY, "category", "subcategory", first.alias("apps")).agg(F.count("*").alias("incidents"), F.sum("n").alias("errors")).filter(F.col("incidents") >= least)
    order = Window.partitionBy(DAY).orderBy(F.desc("errors"), "category", "subcategory", F.array_join("apps", ","))
    return g.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def known_or_new(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Per day how many fingerprints are known."""
    per = with_day(rows).select(DAY, "fingerprint").distinct().join(known.select("fingerprint", F.lit(True).alias("k")).distinct(), "fingerprint", "left")
    return per.groupBy(DAY).agg(F.count_if("k").alias("known"), F.count_if(F.col("k").isNull()).alias("new"))


def growing(rows: DataFrame, pct: float = 20.0) -> DataFrame:
    """Fingerprints with over ``pct`` percent more errors in the later half of their days than in the earlier half."""
    per = with_day(rows).groupBy("fingerprint", DAY).agg(F.sum("error_count").alias("n"))
    order, whole = Window.partitionBy("fingerprint").orderBy(DAY), Window.partitionBy("fingerprint")
    halves = per.withColumn("r", F.row_number().over(order)).withColumn("k", F.count("*").over(whole)).withColumn("late", F.col("r") > F.floor(F.col("k") / 2)).filter("k >= 2")
    part = lambda late: F.coalesce(F.sum(F.when(F.col("late") == late, F.col("n"))), F.lit(0))
    g = halves.groupBy("fingerprint").agg(F.greatest(part(False), F.lit(1)).alias("before"), part(True).alias("after"))
    return g.withColumn("change_pct", (F.col("after") - F.col("before")) / F.col("before") * 100).filter(F.col("change_pct") > pct)


def overall_change(days: DataFrame) -> DataFrame:
    """One row: change in percent of errors and incidents from the first day to the last."""
    first, last = (lambda c: F.min_by(c, DAY)), (lambda c: F.max_by(c, DAY))
    pct = lambda c: F.coalesce((last(c) - first(c)) / F.nullif(first(c), F.lit(0)) * 100, F.lit(0.0))
    return days.agg(pct("errors").alias("errors_change"), pct("incidents").alias("incidents_change"))


# --- peaks ---


def is_peak_row(strict: bool = True) -> Column:
    """Rows that a peak report shows: spikes, bursts and high scores; the broad form also scores of 30 or more."""
    p = F.col("is_spike") | F.col("is_burst") | (F.col("score") >= 70)
    return p if strict else p | (F.col("score") >= 30)


def grouped_peaks(rows: DataFrame) -> DataFrame:
    """Peaks by namespace and error type: span, sums, largest, mean reference that is not zero, commonest application, worst severity."""
    modal = rows.groupBy("namespace", "error_type", "top_app").agg(F.count("*").alias("n")).groupBy("namespace", "error_type").agg(F.min_by("top_app", F.struct((-F.col("n")).alias("d"), "top_app")).alias("app"))
    g = rows.groupBy("namespace", "error_type").agg(
        F.count("*").alias("windows"), F.sum("error_count").alias("total"), F.max("error_count").alias("largest"), F.avg(F.when(F.col("reference") > 0, F.col("reference"))).alias("mean_reference"), F.min("window_start").alias("first_window"),
        F.max("window_start").alias("last_window"), F.max_by("severity", V.severity_rank(F.col("severity"))).alias("severity"),
    )
    return g.join(modal, ["namespace", "error_type"])


def group_stats(rows: DataFrame, now: str, by: tuple[str, ...] = ("namespace", "error_type")) -> DataFrame:
    """Counts of broad and strict peaks, and of those of the last day."""
    recent = F.col("window_start") >= F.lit(now).cast("timestamp") - F.expr("INTERVAL 1 DAY")
    return rows.groupBy(*by).agg(F.count_if(is_peak_row(False)).alias("broad"), F.count_if(is_peak_row()).alias("strict"), F.count_if(is_peak_row() & recent).alias("strict_24h"), F.sum("error_count").alias("errors"))


def peak_rates(judged_rows: DataFrame) -> DataFrame:
    """Per namespace and weekday: windows, peaks, their share, and the largest value that is no peak."""
    g = judged_rows.groupBy("namespace", F.weekday("window_start").alias("dow")).agg(F.count("*").alias("windows"), F.count_if("is_peak").alias("peaks"), F.max(F.when(~F.col("is_peak"), F.col("error_count"))).alias("max_normal"))
    return g.withColumn("peak_pct", F.col("peaks") / F.col("windows") * 100)


def value_stats(judged_rows: DataFrame) -> DataFrame:
    """Per namespace: values above zero, least, mean, largest, deviation, and peaks among them."""
    v = F.col("error_count")
    return judged_rows.groupBy("namespace").agg(
        F.count_if(v > 0).alias("filled"), F.min(v).alias("min"), F.avg(v).alias("avg"), F.max(v).alias("max"), F.stddev_samp(v).alias("stddev"), F.count_if("is_peak").alias("peaks"),
    )


def value_distribution(judged_rows: DataFrame, steps: tuple[int, ...] = (0, 1, 2, 5, 10)) -> DataFrame:
    """How many windows fall into each range of values, by what triggered a peak."""
    cases = None
    for a, b in zip(steps, (*steps[1:], None), strict=True):
        cond = (F.col("error_count") >= a) & (F.col("error_count") < b) if b is not None else F.col("error_count") >= a
        name = f"{a}-{b - 1}" if b is not None else f"{a}+"
        cases = F.when(cond, name) if cases is None else cases.when(cond, name)
    return judged_rows.groupBy(cases.alias("range"), F.coalesce("triggered_by", F.lit("none")).alias("triggered_by")).agg(F.count("*").alias("windows"))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def coverage(rows: DataFrame) -> DataFrame:
    """Per namespace: first and last window, and days with any."""
    return rows.groupBy("namespace").agg(F.min("window_start").alias("first_window"), F.max("window_start").alias("last_window"), F.countDistinct(F.to_date("window_start")).alias("days"))


def far_from_baseline(rows: DataFrame, slots: DataFrame, least_ratio: float = 2.0, count: int = 20) -> DataFrame:
    """The windows furthest above their slot's mean: a join on weekday, hour, quarter and namespace."""
    keyed = rows.select("*", *V.slot(F.col("window_start"))).join(slots.select("dow", "hour", "quarter", "namespace", "mean"), ["dow", "hour", "quarter", "namespace"], "left")
    far = keyed.withColumn("ratio", V.ratio(F.col("error_count"), F.col("mean"))).filter(F.col("ratio") >= least_ratio)
    return far.orderBy(F.desc("ratio"), "window_start", "namespace").limit(count)


def top_error_ids(logs: DataFrame, count: int = 5, seconds: int = V.WINDOW_SECONDS) -> DataFrame:
    """Per window and namespace the commonest error ids (what stands before the first #, else the error type)."""
    rows = logs.filter("ts is not null").groupBy(V.bucket(F.col("ts"), seconds).alias("window_start"), "namespace", F.coalesce(X.error_id(F.col("raw_message")), F.col("error_type")).alias("error_id")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("window_start", "namespace").orderBy(F.desc("n"), "error_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def quality_examples(rows: DataFrame, count: int = 3) -> DataFrame:
    """The messages that say most of each (namespace, error_type): one per kind first, then the best of what is left."""
    kind = F.substring(X.alert_text(F.col("message")), 1, 60)
    scored = rows.withColumn("quality", X.quality_score(F.col("message"), F.col("error_type"))).withColumn("kind", kind)
    in_kind = Window.partitionBy("namespace", "error_type", "kind").orderBy(F.desc("quality"), "seq")
    ranked = scored.withColumn("again", (F.row_number().over(in_kind) > 1).cast("int"))
    order = Window.partitionBy("namespace", "error_type").orderBy("again", F.desc("quality"), "seq")
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def known_peak_match(peaks: DataFrame, known: DataFrame) -> DataFrame:
    """The known peak of each peak: same error type and namespace, 2 more for the application, 3 for the flow; an even match of two names none.

    ``peaks``: id, error_type, namespace, app, flow. ``known``: known_id, error_type, namespace, app, flow.
    """
    k = known.withColumnsRenamed({"app": "k_app", "flow": "k_flow"})
    both = peaks.join(k, ["error_type", "namespace"]).withColumn("points", 5 + F.when(F.col("app") == F.col("k_app"), 2).otherwise(0) + F.when(F.col("flow") == F.col("k_flow"), 3).otherwise(0))
    order = Window.partitionBy("id").orderBy(F.desc("points"), "known_id")
    top = both.withColumn("r", F.rank().over(Window.partitionBy("id").orderBy(F.desc("points")))).filter("r = 1").withColumn("ties", F.count("*").over(Window.partitionBy("id")))
    return top.withColumn("first", F.row_number().over(order)).filter("first = 1").select("id", F.when(F.col("ties") == 1, F.col("known_id")).alias("known_id"), "points")


# --- rules compared ---


def stricter_rules(rows: DataFrame, least_baseline: float = 0.5, least_new: int = 5, high: float = 70.0) -> DataFrame:
    """What-if flags: no burst on too low a baseline, a spike for so many events without any baseline, high scores count as peaks."""
    burst = F.col("is_burst") & (F.col("baseline_ewma") >= least_baseline)
    spike = F.col("is_spike") | ((F.col("baseline_ewma") == 0) & (F.col("total_count") >= least_new))
    return rows.withColumn("burst_fixed", burst).withColumn("spike_fixed", spike).withColumn("peak_fixed", burst | spike | (F.col("score") >= high))


def rule_changes(rows: DataFrame) -> DataFrame:
    """One row: peaks before and after, gained and lost."""
    old, new = F.col("is_spike") | F.col("is_burst"), F.col("peak_fixed")
    return rows.agg(F.count_if(old).alias("before"), F.count_if(new).alias("after"), F.count_if(new & ~old).alias("gained"), F.count_if(old & ~new).alias("lost"))


def replay_differences(now: DataFrame, before: DataFrame, by: str = "severity") -> DataFrame:
    """Counts per ``by`` of two runs side by side."""
    a, b = (x.groupBy(by).agg(F.count("*").alias(n)) for x, n in ((now, "now"), (before, "before")))
    both = a.join(b, by, "full")
    return both.select(by, F.coalesce("now", F.lit(0)).alias("now"), F.coalesce("before", F.lit(0)).alias("before"), (F.coalesce("now", F.lit(0)) - F.coalesce("before", F.lit(0))).alias("difference"))


def regrouped(rows: DataFrame, per_day: bool = False) -> DataFrame:
    """Stored rows made incidents again, by fingerprint or by fingerprint and day."""
    keys = ["fingerprint", DAY] if per_day else ["fingerprint"]
    return with_day(rows).groupBy(*keys).agg(F.sum("error_count").alias("errors"), F.min("window_start").alias("first_window"), F.max("window_start").alias("last_window"), F.array_sort(F.collect_set("namespace")).alias("namespaces"), F.max("score").alias("score"))


# --- views ---


def latest_health(service_rows: DataFrame) -> DataFrame:
    """The last row of each application and namespace."""
    rest = [c for c in service_rows.columns if c not in ("app_name", "namespace")]
    last = service_rows.groupBy("app_name", "namespace").agg(F.max_by(F.struct(*rest), "window_start").alias("_l"))
    return last.select(*(c if c not in rest else F.col(f"_l.{c}").alias(c) for c in service_rows.columns))


def new_unresolved(signatures: DataFrame) -> DataFrame:
    """New errors that are no known issue, with a suggested severity, most frequent first."""
    n = F.col("occurrences")
    suggested = F.when(n > 100, "critical").when(n > 50, "high").when(n > 10, "medium").otherwise("low")
    return signatures.filter(F.col("is_new") & ~F.col("is_known_issue")).withColumn("suggested", suggested).orderBy(F.desc("occurrences"))


def unhealthy_dependencies(dependencies: DataFrame, least_pct: float = 5.0) -> DataFrame:
    """Dependencies marked unhealthy or that fail in over ``least_pct`` percent of calls."""
    return dependencies.filter(~F.col("is_healthy") | (F.col("failure_rate") > least_pct)).orderBy(F.desc("failure_rate"), "source", "target")


def active_cascades(cascades: DataFrame, issues: DataFrame) -> DataFrame:
    """Cascades that have not ended, with their known issue's title."""
    return cascades.filter("ended_at is null").join(issues.select("issue_id", "title"), "issue_id", "left")


def version_table(records: DataFrame) -> DataFrame:
    """Each application's versions with their events and first appearance."""
    return records.filter("app_version is not null").groupBy("app_name", "app_version").agg(F.count("*").alias("events"), F.min(F.unix_micros("ts")).alias("first_us"))


def propagation_table(found: DataFrame, key: str = "registry_key") -> DataFrame:
    """Per problem: how many namespaces it reached, the first of them, and the time from the first to the last."""
    first = found.select(key, F.explode("namespaces").alias("namespace"), F.unix_micros("first_seen").alias("us")).groupBy(key, "namespace").agg(F.min("us").alias("us"))
    return first.groupBy(key).agg(F.count("*").cast("int").alias("namespaces"), F.min_by("namespace", F.struct("us", "namespace")).alias("first_namespace"), (F.max("us") - F.min("us")).alias("spread_us"))
