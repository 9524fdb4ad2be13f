"""Alerts: clusters of problems that are one issue, their payloads, and whether to send them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions import text as X
from emberlog.functions import values as V
from emberlog.sources.tables import staged


def trace_links(problem_traces: DataFrame, share: float = 0.5) -> DataFrame:
    """Links a, b of problems that share at least ``share`` of the smaller one's traces: not all such pairs, but enough to connect all that they connect.

    A containment join with a prefix filter. Traces are ordered by how few problems have them. If n traces are to share ceil(n * share) with a larger
    set, one of the first n - ceil(n * share) + 1 is shared, so only those are looked up; a trace that all problems have comes last and is looked up by few.
    Where one shared trace is enough (sets of one or two, by halves), all problems with a trace are linked to the least such set that has it.
    """
    t = problem_traces.select("problem_key", "trace_id").distinct()
    rarity = t.groupBy("trace_id").agg(F.count("*").alias("spread"))
    sizes = t.groupBy("problem_key").agg(F.count("*").alias("size"))
    rows = t.join(rarity, "trace_id").join(sizes, "problem_key").withColumn("least", F.ceil(F.col("size") * F.lit(share)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("problem_key").orderBy("spread", "trace_id")))
    rows = staged(rows.select("problem_key", "trace_id", "size", "least", "rank"), "alert-traces")
    leaders = rows.filter("least <= 1").groupBy("trace_id").agg(F.min("problem_key").alias("a"))
    stars = leaders.join(rows.select("trace_id", F.col("problem_key").alias("b")), "trace_id").filter("a <> b").select("a", "b")
    probes = rows.filter("least > 1 AND rank <= size - least + 1").select("trace_id", F.col("problem_key").alias("a"), F.col("size").alias("a_size"), "least")
    larger = rows.select("trace_id", F.col("problem_key").alias("b"), F.col("size").alias("b_size"))
    met = probes.join(larger, "trace_id").filter("a_size < b_size OR (a_size = b_size AND a < b)").select("a", "b", "least").distinct()
    sets = rows.select("problem_key", "trace_id")
    shared = met.join(sets.withColumnRenamed("problem_key", "a"), "a").join(sets.withColumnRenamed("problem_key", "b"), ["b", "trace_id"]).groupBy("a", "b", "least").agg(F.count("*").alias("n"))
    return stars.unionByName(shared.filter("n >= least").select("a", "b")).distinct()


def event_keys(problem_rows: DataFrame, least_run: int = 5) -> DataFrame:
    """``problem_key, volume, shingle, app, namespace``: problems of one volume, application and namespace whose messages share a run of ``least_run`` cause tokens share a key.

    Messages share such a run if and only if they share a shingle of so many tokens.
    """
    messages = F.concat(F.array("normalized_message"), F.coalesce("sample_messages", F.array().cast("array<string>")))
    rows = problem_rows.filter("total_occurrences > 0").select("problem_key", F.col("total_occurrences").alias("volume"), "apps", "namespaces", F.explode(F.array_distinct(messages)).alias("message"))
    rows = rows.filter("message is not null").withColumn("tokens", X.cause_tokens(F.col("message")))
    starts = F.sequence(F.lit(1), F.size("tokens") - (least_run - 1))
    shingles = F.when(F.size("tokens") >= least_run, F.transform(starts, lambda i: F.array_join(F.slice("tokens", i, least_run), " ")))
    keyed = rows.select("problem_key", "volume", "apps", "namespaces", F.explode(shingles).alias("shingle")).distinct()
    return keyed.withColumn("app", F.explode("apps")).withColumn("namespace", F.explode("namespaces")).select("problem_key", "volume", "shingle", "app", "namespace")


_EVENT = ("volume", "shingle", "app", "namespace")


def event_links(keys: DataFrame) -> DataFrame:
    """Links a, b: each problem to the least one of each of its keys."""
    least = keys.groupBy(*_EVENT).agg(F.min("problem_key").alias("a"))
    return least.join(keys, list(_EVENT)).filter("a <> problem_key").select("a", F.col("problem_key").alias("b")).distinct()


def components(nodes: DataFrame, edges: DataFrame, node: str = "problem_key", max_rounds: int = 50) -> DataFrame:
    """Adds ``cluster``, the least node that edges reach: least labels are passed along until none changes, a stage table a round."""
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = nodes.select(F.col(node).alias("n"), F.col(node).alias("cluster"))
    for _ in range(max_rounds):
        near = both.join(labels, F.col("b") == F.col("n")).groupBy("a").agg(F.min("cluster").alias("m"))
        step = labels.join(near, F.col("n") == F.col("a"), "left").select("n", F.col("cluster").alias("old"), F.least("cluster", F.coalesce("m", "cluster")).alias("cluster"))
        # A label's own label is as good
        own = labels.select(F.col("n").alias("k"), F.col("cluster").alias("c2"))
        new = staged(step.join(own, F.col("cluster") == F.col("k")).select("n", "old", F.least("cluster", "c2").alias("cluster")), "labels")
        labels = new.select("n", "cluster")
        if new.filter("cluster <> old").isEmpty():
            return labels.withColumnRenamed("n", node)
    raise RuntimeError(f"clusters did not settle in {max_rounds} rounds")


def clusters(problem_rows: DataFrame, problem_traces: DataFrame, share: float = 0.5) -> DataFrame:
    """``problem_key, cluster, primary, rank, same``: problems of one issue. ``same`` says that a problem is the cluster's first one's events in other words, or shares its traces.

    Links connect; whether a problem is linked to its primary itself is asked of that one pair.
    """
    keys = staged(event_keys(problem_rows), "alert-shingles")
    edges = trace_links(problem_traces, share).unionByName(event_links(keys)).distinct()
    named = components(problem_rows.select("problem_key"), edges)
    order = Window.partitionBy("cluster").orderBy(F.desc("max_score"), F.desc("total_occurrences"), "problem_key")
    rows = named.join(problem_rows.select("problem_key", "max_score", "total_occurrences"), "problem_key").withColumn("rank", F.row_number().over(order))
    first = rows.filter("rank = 1").select("cluster", F.col("problem_key").alias("primary"))
    rows = staged(rows.join(first, "cluster").select("problem_key", "cluster", "primary", "rank"), "alert-clusters")
    pairs = rows.filter("rank > 1").select("problem_key", "primary")
    t = problem_traces.select("problem_key", "trace_id").distinct()
    sizes = t.groupBy("problem_key").agg(F.count("*").alias("size"))
    shared = pairs.join(t, "problem_key").join(t.withColumnRenamed("problem_key", "primary"), ["primary", "trace_id"]).groupBy("problem_key", "primary").agg(F.count("*").alias("shared"))
    shared = shared.join(sizes, "problem_key").join(sizes.withColumnsRenamed({"problem_key": "primary", "size": "p_size"}), "primary").filter(F.col("shared") / F.least("size", "p_size") >= share).select("problem_key")
    alike = pairs.join(keys, "problem_key").join(keys.withColumnRenamed("problem_key", "primary"), ["primary", *_EVENT]).select("problem_key")
    linked = shared.unionByName(alike).distinct().withColumn("linked", F.lit(True))
    return rows.join(linked, "problem_key", "left").select("problem_key", "cluster", "primary", "rank", F.coalesce("linked", F.col("rank") == 1).alias("same"))


def payloads(problem_rows: DataFrame, cluster_rows: DataFrame) -> DataFrame:
    """One payload per cluster: the primary's words; counts of the same events by maximum, of other events by sum."""
    rows = problem_rows.join(cluster_rows, "problem_key")
    top = F.max(F.when(F.col("same"), F.col("total_occurrences")))
    rest = F.coalesce(F.sum(F.when(~F.col("same"), F.col("total_occurrences"))), F.lit(0))
    per = rows.groupBy("cluster").agg(
        F.first("primary").alias("primary"), F.count("*").alias("cluster_size"), (F.coalesce(top, F.lit(0)) + rest).alias("error_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("apps")))).alias("apps"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("namespaces")))).alias("namespaces"), F.bool_or("has_spike").alias("has_spike"),
    )
    words = problem_rows.select(F.col("problem_key").alias("primary"), "category", "flow", "error_class", "normalized_message", "max_score")
    return per.join(words, "primary").withColumn("peak_key", F.concat_ws(":", F.lit("PEAK"), "category", "flow", F.when(F.col("has_spike"), "spike").otherwise("burst")))


def with_known(payload_rows: DataFrame, known_peaks: DataFrame, window_start: str, lookback_min: int = 60) -> DataFrame:
    """Adds what the registry knows of a peak (peak_key, apps, namespaces, mean_count, last_seen): is_known, continues, what is new in scope, and the trend.

    A peak seen within the look-back continues; then its trend is its count against its mean (a fifth up or down). Any other is rising.
    """
    k = known_peaks.select("peak_key", F.col("apps").alias("k_apps"), F.col("namespaces").alias("k_ns"), F.col("mean_count").alias("k_mean"), F.col("last_seen").alias("k_last"))
    rows = payload_rows.join(k, "peak_key", "left")
    goes_on = F.coalesce(F.col("k_last") >= F.lit(window_start).cast("timestamp") - F.expr(f"INTERVAL {int(lookback_min)} MINUTES"), F.lit(False))
    r = V.ratio(F.col("error_count"), F.col("k_mean"))
    none = F.array().cast("array<string>")
    return rows.select(
        *payload_rows.columns, F.col("k_apps").isNotNull().alias("is_known"), goes_on.alias("continues"), F.array_except("apps", F.coalesce("k_apps", none)).alias("new_apps"),
        F.array_except("namespaces", F.coalesce("k_ns", none)).alias("new_namespaces"), F.when(~goes_on | r.isNull() | (r >= 1.2), "rising").when(r <= 0.8, "falling").otherwise("stable").alias("trend"),
    )


def shown_namespaces(counts: DataFrame, least: int = 100, share: float = 0.01) -> DataFrame:
    """Namespaces of a payload (key, namespace, n) with ``least`` events or a hundredth of all, whichever is more; the largest where none has."""
    whole = Window.partitionBy("key")
    rows = counts.withColumn("limit", F.greatest(F.lit(least), F.sum("n").over(whole) * share)).withColumn("r", F.row_number().over(whole.orderBy(F.desc("n"), "namespace")))
    rows = rows.withColumn("any", F.bool_or(F.col("n") >= F.col("limit")).over(whole))
    return rows.filter((F.col("n") >= F.col("limit")) | (~F.col("any") & (F.col("r") == 1))).select("key", "namespace", "n")


def decision(now: Column, cooldown_min: int = 45, heartbeat_min: int = 120, min_delta_pct: float = 30.0) -> Column:
    """Struct (send, reason): the first rule that fits. State columns begin with ``s_`` and are null for a peak not alerted before."""
    yes, no = (lambda r: F.struct(F.lit(True).alias("send"), r.alias("reason"))), (lambda r: F.struct(F.lit(False).alias("send"), r.alias("reason")))
    lit = F.lit
    delta = F.abs(F.col("error_count") - F.col("s_count")) / F.greatest(F.col("s_count"), lit(1)) * 100
    both = lambda a, b: (F.coalesce(a, lit("")) != "") & (F.coalesce(b, lit("")) != "")
    originator = F.coalesce(F.nullif("test_originator", lit("")), lit(None))
    return (
        F.when(F.col("is_test"), no(F.concat(lit("test_peak_suppressed"), F.coalesce(F.concat(lit(":"), originator), lit("")))))
        .when(F.col("s_sent_at").isNull(), yes(lit("first_seen_in_state"))).when(~F.col("is_known"), yes(lit("new_peak")))
        .when(both(F.col("s_window"), F.col("window_key")) & (F.col("s_window") == F.col("window_key")), no(lit("same_window_duplicate")))
        .when(both(F.col("s_trend"), F.col("trend")) & (F.col("s_trend") != F.col("trend")), yes(lit("trend_changed")))
        .when((F.col("error_count") > 0) & (F.col("s_count") > 0) & (delta >= min_delta_pct), yes(F.concat(lit("count_delta_"), F.format_string("%.1f", F.bround(delta, 1)), lit("_pct"))))
        .when((F.size("new_apps") > 0) | (F.size("new_namespaces") > 0), yes(lit("scope_changed"))).when(now < F.col("s_cooldown_until"), no(lit("cooldown_active")))
        .when(now - F.expr(f"INTERVAL {int(heartbeat_min)} MINUTES") >= F.col("s_sent_at"), yes(lit("heartbeat"))).otherwise(no(lit("no_trigger" if cooldown_min <= 0 else "no_material_change")))
    )


def decided(payload_rows: DataFrame, state: DataFrame, now: str, **limits) -> DataFrame:
    """Payloads with ``send`` and ``reason``. ``state``: peak_key, s_sent_at, s_window, s_trend, s_count, s_cooldown_until."""
    out = payload_rows.join(state, "peak_key", "left").withColumn("_d", decision(F.lit(now).cast("timestamp"), **limits))
    return out.select(*payload_rows.columns, "_d.send", "_d.reason")


def recorded(state: DataFrame, delivered: DataFrame, now: str, cooldown_min: int = 45) -> DataFrame:
    """The state after delivery: delivered peaks with a key have a new entry, others keep theirs."""
    at = F.lit(now).cast("timestamp")
    new = delivered.filter(F.coalesce("peak_key", F.lit("")) != "").select(
        "peak_key", at.alias("s_sent_at"), F.col("window_key").alias("s_window"), F.col("trend").alias("s_trend"), F.col("error_count").cast("long").alias("s_count"), (at + F.expr(f"INTERVAL {max(0, int(cooldown_min))} MINUTES")).alias("s_cooldown_until")
    )
    return state.join(new.select("peak_key"), "peak_key", "left_anti").unionByName(new)
