"""Traces: timelines, patterns, ownership, propagation and root causes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions import text as X
from emberlog.sources.tables import staged

SEVERE = ("ERROR", "FATAL")


def top_traces(records: DataFrame, limit: int) -> DataFrame:
    """The traces with most events (of equals the smallest id)."""
    return records.filter(F.col("trace_id").isNotNull()).groupBy("trace_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "trace_id").limit(limit)


def first_events(records: DataFrame, per_trace: int, total: int | None = None) -> DataFrame:
    """The first ``per_trace`` events of each trace, in time; with ``total``, the first so many of all by time."""
    by_time = Window.partitionBy("trace_id").orderBy(F.col("ts").asc_nulls_last(), "seq")
    out = records.filter(F.col("trace_id").isNotNull()).withColumn("_r", F.row_number().over(by_time)).filter(F.col("_r") <= per_trace).drop("_r")
    return out.orderBy("ts", "seq").limit(total) if total else out


def trace_context(logs: DataFrame, trace_ids: DataFrame, start: str, end: str, max_traces: int = 200, max_events: int = 3000) -> DataFrame:
    """Events of all levels of at most ``max_traces`` given traces within [start, end), the first ``max_events``."""
    wanted = trace_ids.select("trace_id").distinct().orderBy("trace_id").limit(max_traces)
    rows = logs.filter((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))
    return rows.join(F.broadcast(wanted), "trace_id", "left_semi").orderBy("ts", "seq").limit(max_events)  # max_traces ids at most


def timelines(records: DataFrame, max_traces: int | None = None, max_events: int = 10_000) -> DataFrame:
    """``trace_id, events``: what happened in each trace, in time, events without a time last.

    An event has app, error_class, message, namespace, level, signal, ts. Both limits are features of the operator.
    """
    rows = records.filter(F.col("trace_id").isNotNull())
    if max_traces:
        rows = rows.join(top_traces(rows, max_traces).select("trace_id"), "trace_id", "left_semi")
    rows = first_events(rows, max_events)
    raw = F.when(F.col("raw_message") != "", F.col("raw_message")).otherwise(F.col("normalized_message"))
    level = F.coalesce(F.col("level"), F.lit("ERROR")) if "level" in records.columns else F.lit("ERROR")
    # What the next expressions use several times comes out of a generator, computed once
    said = F.inline(F.array(F.struct(X.useful_content(raw).alias("said"), X.event_error_class(F.col("error_type"), F.col("normalized_message")).alias("error_class"))))
    rows = rows.select("trace_id", "ts", "seq", F.col("app_name").alias("app"), "namespace", level.alias("level"), "normalized_message", said)
    rows = rows.withColumn("useful", F.when(F.col("said") != "", F.col("said")).otherwise(F.col("normalized_message")))
    rows = rows.select("*", F.inline(F.array(F.struct(X.smart_trim(F.col("useful")).alias("trimmed"), X.signal_score(F.col("useful")).alias("signal")))))
    shown = F.when(F.col("trimmed") != "", F.col("trimmed")).otherwise(F.substring("useful", 1, 200))
    event = F.struct(F.col("ts").isNull().alias("untimed"), "ts", "seq", "app", "error_class", shown.alias("message"), "namespace", "level", "signal")
    return rows.select("trace_id", event.alias("e")).groupBy("trace_id").agg(F.array_sort(F.collect_list("e")).alias("events"))


def signature(events: Column) -> Column:
    """The trace's course: (app, error_class) in time, repeats in a row once."""
    # The step before is read from the events themselves, so that the array is walked once
    before = lambda i: F.get(events, i - 1)
    changed = F.filter(events, lambda e, i: (i == 0) | (before(i)["app"] != e["app"]) | (before(i)["error_class"] != e["error_class"]))
    return F.transform(changed, lambda e: F.struct(e["app"].alias("app"), e["error_class"].alias("error_class")))


def apps_in_order(events: Column) -> Column:
    return F.array_distinct(F.transform(events, lambda e: e["app"]))


def root_cause(events: Column) -> Column:
    """The first event that says something (signal 2 or more), else the first; sure if it says much and opens the trace."""
    numbered = F.transform(events, lambda e, i: F.struct(i.alias("i"), e.alias("e")))
    said = F.filter(numbered, lambda x: x["e"]["signal"] >= 2)
    x = F.coalesce(F.get(said, F.lit(0)), F.get(numbered, F.lit(0)))
    sure = F.when((x["e"]["signal"] >= 3) & (x["i"] == 0), "high").when(x["e"]["signal"] >= 2, "medium").otherwise("low")
    return F.struct(x["e"]["app"].alias("service"), x["e"]["error_class"].alias("error_class"), x["e"]["message"].alias("message"), x["e"]["ts"].alias("ts"), sure.alias("confidence"))


def outcome(events: Column) -> Column:
    """The last severe event, else the last."""
    severe = F.filter(events, lambda e: e["level"].isin(*SEVERE))
    e = F.coalesce(F.try_element_at(severe, F.lit(-1)), F.try_element_at(events, F.lit(-1)))
    return F.struct(e["app"].alias("service"), e["error_class"].alias("error_class"), e["message"].alias("message"), e["ts"].alias("ts"))


def duration_ms(events: Column) -> Column:
    t = F.transform(F.filter(events, lambda e: e["ts"].isNotNull()), lambda e: F.unix_micros(e["ts"]))
    return F.coalesce(F.floor((F.array_max(t) - F.array_min(t)) / 1000), F.lit(0)).cast("long")


def trace_patterns(lines: DataFrame, min_occurrences: int = 1, signature_of: Callable[[Column], Column] = signature, cause_of: Callable[[Column], Column] = root_cause) -> DataFrame:
    """Traces of one course as one pattern: how often, how many events, and the trace that shows it best.

    The course is hashed for grouping; what a pattern collects per trace is small (its id and count) except for the
    representative, which an aggregate by order keeps alone.
    """
    e = F.col("events")
    rows = lines.filter(F.size("events") > 0).withColumn("signature", signature_of(e)).withColumn("n", F.size("events"))
    best = F.struct(F.size(apps_in_order(e)).alias("apps"), F.col("n").alias("n"), (-F.length("trace_id")).alias("l"))
    groups = rows.groupBy("signature").agg(F.count("*").alias("occurrences"), F.sum("n").alias("total_errors"), F.min_by("trace_id", F.struct((-best["apps"]).alias("a"), (-F.col("n")).alias("b"), F.length("trace_id").alias("c"), "trace_id")).alias("representative"))
    groups = groups.filter(F.col("occurrences") >= min_occurrences)
    shown = groups.join(lines.withColumnRenamed("trace_id", "representative"), "representative")
    return shown.select(
        "signature", "occurrences", "total_errors", (F.col("total_errors") / F.col("occurrences")).alias("avg_errors"), "representative", cause_of(F.col("events")).alias("root_cause"), outcome(F.col("events")).alias("outcome"),
        F.transform("signature", lambda s: s["app"]).alias("propagation_path"),
    )


def owners(problem_traces: DataFrame) -> DataFrame:
    """``trace_id, problem_key``: each trace's problem with most events in it (of equals the largest key). Input: problem_key, trace_id, n."""
    sums = problem_traces.filter(F.col("trace_id").isNotNull()).groupBy("trace_id", "problem_key").agg(F.sum("n").alias("n"))
    return sums.groupBy("trace_id").agg(F.max(F.struct("n", "problem_key"))["problem_key"].alias("problem_key"))


def ownership(problem_traces: DataFrame, lines: DataFrame) -> DataFrame:
    """Per problem, over the traces that it alone owns: traces, events, commonest error class, and the trace that shows it best."""
    owned = owners(problem_traces).join(lines, "trace_id")
    e = F.col("events")
    per_trace = owned.groupBy("problem_key").agg(
        F.count("*").alias("owned_traces"), F.sum(F.size("events")).alias("total_errors"),
        F.min_by("trace_id", F.struct((-F.size(apps_in_order(e))).alias("a"), (-F.size("events")).alias("b"), F.length("trace_id").alias("c"), "trace_id")).alias("representative"),
    )
    classes = owned.select("problem_key", F.explode("events").alias("e")).groupBy("problem_key", "e.error_class").agg(F.count("*").alias("n"), F.min("e.seq").alias("s"))
    primary = classes.groupBy("problem_key").agg(F.min_by("error_class", F.struct((-F.col("n")).alias("d"), "s")).alias("primary_error_class"), F.count("*").alias("error_classes"))
    return per_trace.join(primary, "problem_key").join(lines.select(F.col("trace_id").alias("representative"), apps_in_order(F.col("events")).alias("propagation_path")), "representative")


# --- propagation ---


def trace_contexts(records: DataFrame) -> DataFrame:
    """Per trace: deployments, namespaces, events, first and last time, and the deployment of the earliest event."""
    rows = records.filter(F.col("trace_id").isNotNull())
    return rows.groupBy("trace_id").agg(
        F.array_sort(F.collect_set("app_name")).alias("deployments"), F.array_sort(F.collect_set("namespace")).alias("namespaces"), F.count("*").alias("events"), F.min("ts").alias("first_event"), F.max("ts").alias("last_event"),
        F.min_by("app_name", F.when(F.col("ts").isNotNull(), F.struct("ts", "seq"))).alias("root"), F.min("seq").alias("first_seq"),
    )


def propagation(contexts: DataFrame) -> DataFrame:
    """One row over all traces with two or more deployments: commonest root (of equals the one seen first), deployments, upper median of times."""
    spread = contexts.filter(F.size("deployments") > 1)
    roots = spread.groupBy("root").agg(F.count("*").alias("n"), F.min("first_seq").alias("s")).agg(F.min_by("root", F.struct((-F.col("n")).alias("d"), "s")).alias("root_deployment"))
    seconds = (F.unix_micros("last_event") - F.unix_micros("first_event")) / 1e6
    whole = spread.agg(F.count("*").alias("trace_count"))
    affected = spread.select(F.explode("deployments").alias("d")).distinct().agg(F.array_sort(F.collect_list("d")).alias("affected"))
    upper = _upper_median(spread.select(seconds.alias("sec")))
    return roots.join(F.broadcast(affected)).join(F.broadcast(whole)).join(F.broadcast(upper)).withColumn("propagated", F.coalesce(F.col("trace_count") > 0, F.lit(False)))  # one row each


def _upper_median(values: DataFrame) -> DataFrame:
    """The value at place n // 2 in order, from counts of distinct values and their running total by range."""
    n = values.groupBy("sec").agg(F.count("*").alias("n"))
    ordered = n.repartitionByRange("sec").withColumn("p", F.spark_partition_id())
    within = staged(ordered.withColumn("run", F.sum("n").over(Window.partitionBy("p").orderBy("sec"))), "ranges")  # ranges come from a sample; all uses must see the same ones
    parts = within.groupBy("p").agg(F.max("run").alias("m"))
    before = parts.alias("a").join(parts.select(F.col("p").alias("q"), F.col("m").alias("k")).alias("b"), F.col("q") < F.col("p"), "left").groupBy("p").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("before"))
    total = parts.agg(F.sum("m").alias("total"))
    placed = within.join(F.broadcast(before), "p").join(F.broadcast(total))  # a row per partition, and one row
    return placed.filter(F.col("before") + F.col("run") > F.floor(F.col("total") / 2)).agg(F.min("sec").alias("propagation_sec"))


def trace_propagation(lines: DataFrame) -> DataFrame:
    """Per trace: services in order of appearance, fan-out, and the kind of propagation."""
    e = F.col("events")
    rows = lines.select("trace_id", apps_in_order(e).alias("services"), F.array_distinct(F.transform(e, lambda x: x["namespace"])).alias("namespaces"), duration_ms(e).alias("duration_ms"), F.size(F.filter(e, lambda x: x["level"].isin(*SEVERE))).alias("errors"))
    n = F.size("services")
    kind = F.when(n == 0, "none").when(n == 1, "single").when((n >= 3) & (F.col("errors") >= 2), "cascade").when(n == 2, "linear").otherwise("fan_out")
    return rows.select("trace_id", "services", F.get("services", F.lit(0)).alias("root_service"), n.alias("service_count"), (n - 1).alias("fan_out"), F.size("namespaces").alias("namespace_count"), (F.size("namespaces") > 1).alias("is_cross_namespace"), "duration_ms", kind.alias("propagation_type"))


def problem_propagation(problem_rows: DataFrame, per_trace: DataFrame | None = None, problem_traces: DataFrame | None = None) -> DataFrame:
    """Per problem: the propagation of its trace with most services if that has two or more, else one from its applications in order of name."""
    n = F.size("apps")
    plain = problem_rows.select(
        "problem_key", F.coalesce(F.get("apps", F.lit(0)), F.lit("")).alias("root_service"), n.alias("service_count"), F.greatest(n - 1, F.lit(0)).alias("fan_out"), (F.size("namespaces") > 1).alias("is_cross_namespace"),
        F.when(n == 0, "none").when(n == 1, "single").when(n == 2, "linear").otherwise("fan_out").alias("propagation_type"),
    )
    if per_trace is None or problem_traces is None:
        return plain
    own = problem_traces.select("problem_key", "trace_id").distinct().join(per_trace, "trace_id")
    fields = ("root_service", "service_count", "fan_out", "is_cross_namespace", "propagation_type")
    best = own.groupBy("problem_key").agg(F.min_by(F.struct(*fields), F.struct((-F.col("service_count")).alias("d"), "trace_id")).alias("b"))
    joined = plain.join(best.filter(F.col("b.service_count") > 1), "problem_key", "left")
    return joined.select("problem_key", *(F.coalesce(F.col(f"b.{f}"), F.col(f)).alias(f) for f in fields))


def propagation_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("problems"), F.count_if(F.col("propagation_type") == "cascade").alias("cascades"), F.count_if("is_cross_namespace").alias("cross_namespace"),
        F.avg("fan_out").alias("avg_fan_out"), F.max("fan_out").alias("max_fan_out"),
    )


def flow_root_cause(lines: DataFrame) -> DataFrame:
    """Per trace: the first severe event (sure), else the first warning, else the first event."""
    e = F.col("events")
    first = lambda cond: F.get(F.filter(e, cond), F.lit(0))
    severe, warn = first(lambda x: x["level"].isin(*SEVERE)), first(lambda x: x["level"] == "WARN")
    chosen = F.coalesce(severe, warn, F.get(e, F.lit(0)))
    how = F.when(severe.isNotNull(), F.struct(F.lit("high").alias("confidence"), F.lit("trace_error").alias("method"))).when(warn.isNotNull(), F.struct(F.lit("medium").alias("confidence"), F.lit("trace_warn").alias("method"))).otherwise(F.struct(F.lit("low").alias("confidence"), F.lit("trace_first").alias("method")))
    return lines.filter(F.size("events") > 0).select("trace_id", chosen["app"].alias("service"), chosen["message"].alias("message"), chosen["level"].alias("level"), how["confidence"].alias("confidence"), how["method"].alias("method"))


def problem_root_cause(found: DataFrame) -> DataFrame:
    """Per problem the incident of the highest score (of equals the earliest): its first app and message."""
    best = found.groupBy("problem_key").agg(F.max_by(F.struct("apps", "namespaces", "normalized_message", "score", "fingerprint"), F.struct("score", (-F.col("first_seq")).alias("s"))).alias("b"))
    return best.select(
        "problem_key", F.coalesce(F.get("b.apps", F.lit(0)), F.lit("unknown")).alias("service"), F.col("b.normalized_message").alias("message"), F.when(F.col("b.score") >= 60, "ERROR").otherwise("WARN").alias("level"),
        F.lit("medium").alias("confidence"), F.col("b.fingerprint").alias("fingerprint"),
    )


# --- traces of incidents ---


def incident_traces(found: DataFrame, traces: DataFrame) -> DataFrame:
    """``problem_key, trace_id, incidents, apps, has_error``: incidents grouped by trace. ``traces``: fingerprint, trace_id, n."""
    rows = found.select("problem_key", "fingerprint", "apps", "is_spike", "is_burst", "score").join(traces, "fingerprint")
    severe = F.col("is_spike") | F.col("is_burst") | (F.col("score") >= 60)
    return rows.groupBy("problem_key", "trace_id").agg(F.count("*").alias("incidents"), F.array_distinct(F.flatten(F.collect_list("apps"))).alias("apps"), F.bool_or(severe).alias("has_error"), F.sum("n").alias("n"))


def representative_traces(per_trace: DataFrame, count: int = 3) -> DataFrame:
    """Up to ``count`` traces of each problem by fan-out, incidents and id."""
    order = Window.partitionBy("problem_key").orderBy(F.desc(F.size("apps")), F.desc("incidents"), "trace_id")
    return per_trace.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count).select("problem_key", "rank", "trace_id")


def representative_trace(per_trace: DataFrame) -> DataFrame:
    """The one trace of each problem: incidents, ten for a severe one, a point for every service; of equals the smallest id."""
    points = F.col("incidents") + F.when(F.col("has_error"), 10).otherwise(0) + F.size("apps")
    return per_trace.groupBy("problem_key").agg(F.min_by(F.struct("trace_id", points.alias("points")), F.struct((-points).alias("d"), "trace_id")).alias("b")).select("problem_key", "b.trace_id", "b.points")
