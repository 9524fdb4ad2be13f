"""Detection, scoring and classification: one incident per fingerprint of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog import rules
from emberlog.functions import text as X
from emberlog.functions import values as V
from emberlog.functions.text import first_match
from emberlog.operators import measure as M
from emberlog.operators import peaks as P
from emberlog.sources.tables import staged

FLAGS = ("is_spike", "is_burst", "is_new", "is_cross_namespace", "is_silence", "is_regression", "is_cascade")


# --- classification ---


def classified(error_type: Column, normalised: Column, taxonomy: list[tuple] = rules.TAXONOMY) -> Column:
    """Struct (category, subcategory) of the first rule, by falling priority, of which a pattern is in ``type message``."""
    said = F.concat(X.full(error_type), F.lit(" "), X.full(normalised))
    pair = lambda c, s: F.struct(F.lit(c).alias("category"), F.lit(s).alias("subcategory"))
    ordered = sorted(taxonomy, key=lambda r: -r[0])
    return first_match(((said.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), pair(c, s)) for _, c, s, patterns in ordered), pair("unknown", "unclassified"))


def classify(kinds: DataFrame, taxonomy: list[tuple] = rules.TAXONOMY) -> DataFrame:
    """Adds category and subcategory to rows with error_type and normalized_message; meant for distinct fingerprints, not events."""
    return kinds.withColumn("_c", classified(F.col("error_type"), F.col("normalized_message"), taxonomy)).select(*kinds.columns, "_c.category", "_c.subcategory")


def with_rule(taxonomy: list[tuple], priority: int, category: str, subcategory: str, patterns: list[str]) -> list[tuple]:
    return [*taxonomy, (priority, category, subcategory, patterns)]


def refined(category: Column, texts: list[Column], refinements: list[tuple] = rules.REFINEMENTS, domain: dict[str, tuple[str, str]] | None = None, domain_texts: list[Column] | None = None) -> Column:
    """Struct (category, subcategory): an unknown category from the first rule with a word in the texts; words of the domain go before all."""
    low = F.lower(F.concat_ws(" ", *(F.nullif(t, F.lit("")) for t in texts)))
    pair = lambda c, s: F.struct(F.lit(c).alias("category"), F.lit(s).alias("subcategory"))
    general = F.when(category != "unknown", F.struct(category.alias("category"), F.lit("").alias("subcategory"))).otherwise(first_match(((X.has_any(low, words), pair(c, s)) for words, c, s in refinements), pair("unknown", "")))
    if not domain:
        return general
    own = F.lower(F.concat_ws(" ", *(domain_texts or texts)))
    return first_match(((own.contains(word.lower()), pair(*cs)) for word, cs in domain.items()), general)


# --- scoring ---


def score_parts(f: dict[str, Column], total: Column, trend_ratio: Column, n_namespaces: Column, weights: dict[str, int] = rules.SCORE_WEIGHTS) -> Column:
    """Struct of the score's parts. What grows with the trend or the namespaces is added whether or not the flag is set."""
    w = lambda flag, name: F.coalesce(f[flag], F.lit(False)).cast("int") * weights[name]
    steep = F.when(trend_ratio > 2, F.least(F.lit(5.0), trend_ratio - 2) * 2).otherwise(F.lit(0.0))
    wide = F.when(n_namespaces > 2, F.least(F.lit(5), n_namespaces - 2) * 3).otherwise(F.lit(0))
    return F.struct(
        F.least(F.lit(30.0), total / 10).alias("base"), (w("is_spike", "spike") + steep).alias("spike"), w("is_burst", "burst").alias("burst"), w("is_new", "new").alias("new"),
        w("is_regression", "regression").alias("regression"), w("is_cascade", "cascade").alias("cascade"), (w("is_cross_namespace", "cross_ns") + wide).alias("cross_ns"),
    )


def score_total(parts: Column) -> Column:
    names = ("base", "spike", "burst", "new", "regression", "cascade", "cross_ns")
    total = parts[names[0]]
    for n in names[1:]:
        total = total + parts[n]
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))


# --- detection ---


def known_keys(keys: DataFrame, known_problems: DataFrame, known_peaks: DataFrame) -> DataFrame:
    """Of ``keys`` (problem_key) those that are known: as a problem, as a peak, or by a peak's category and flow. Two equi-joins."""
    part = lambda i: F.get(F.split("problem_key", ":"), F.lit(i))
    named = known_problems.select("problem_key").unionByName(known_peaks.select(F.col("peak_key").alias("problem_key")))
    of_peaks = known_peaks.select(F.get(F.split("peak_key", ":"), F.lit(1)).alias("c"), F.get(F.split("peak_key", ":"), F.lit(2)).alias("f")).distinct()
    distinct = keys.select("problem_key").distinct()
    direct = distinct.join(named, "problem_key", "left_semi")
    by_flow = distinct.withColumn("c", F.lower(part(0))).withColumn("f", part(1)).join(of_peaks, ["c", "f"], "left_semi").select("problem_key")
    return direct.unionByName(by_flow).distinct()


def detect(
    records: DataFrame, *, thresholds: DataFrame | None = None, cap_rows: DataFrame | None = None, known_fingerprints: DataFrame | None = None, known_problem_keys: DataFrame | None = None,
    fixes: DataFrame | None = None, history: DataFrame | None = None, burst_seconds: int = 60, burst_threshold: float = 5.0, spike_ratio: float = 3.0, cells: DataFrame | None = None,
) -> DataFrame:
    """Measurements with the flags of all rules and their evidence.

    ``thresholds`` and ``cap_rows`` make namespace peaks; without them a spike is a rate above ``spike_ratio`` times the
    baseline. All but bursts is made of ``cells`` (``measure.cells`` of the records, made here if not given). ``known_fingerprints`` (fingerprint), ``known_problem_keys`` (problem_key), ``fixes`` (fingerprint, fixed_in).
    """
    cells = staged(M.cells(records), "cells") if cells is None else cells
    first = cells.groupBy("fingerprint").agg(F.min("first").alias("f")).select("fingerprint", "f.normalized_message", F.col("f.seq").alias("first_seq"))
    versions = cells.select("fingerprint", F.explode("versions").alias("v")).groupBy("fingerprint").agg(F.collect_set("v").alias("versions"))
    out = M.measure_cells(cells, history).join(first, "fingerprint").join(versions, "fingerprint", "left").withColumn("versions", F.coalesce("versions", F.array().cast("array<string>")))
    out = out.join(M.bursts(records, burst_seconds, burst_threshold), "fingerprint", "left")
    peak_rows = P.namespace_peaks(M.cell_facts(cells), thresholds, cap_rows) if thresholds is not None else None
    return flagged(out, peak_rows, known_fingerprints=known_fingerprints, known_problem_keys=known_problem_keys, fixes=fixes, burst_threshold=burst_threshold, spike_ratio=spike_ratio)


def flagged(
    measured: DataFrame, peak_rows: DataFrame | None, *, known_fingerprints: DataFrame | None = None, known_problem_keys: DataFrame | None = None, fixes: DataFrame | None = None, burst_threshold: float = 5.0, spike_ratio: float = 3.0,
) -> DataFrame:
    """The flags of all rules and their evidence, from a row per fingerprint with its measurement, first message, versions and burst."""
    out, none = measured.withColumn("is_burst", F.coalesce("is_burst", F.lit(False))), F.lit(None)
    if peak_rows is not None:
        found = peak_rows.select("fingerprint", F.struct("namespace", "window_start", "value", "contribution", "contributors", "p93", "cap", "triggered_by").alias("peak"))
        out = out.join(found, "fingerprint", "left").withColumn("is_spike", F.col("peak").isNotNull())
    else:
        kind = "struct<namespace:string,window_start:timestamp,value:bigint,contribution:bigint,contributors:bigint,p93:double,cap:double,triggered_by:string>"
        out = out.withColumn("peak", none.cast(kind)).withColumn("is_spike", (F.col("baseline_ewma") > 0) & (F.col("trend_ratio") > spike_ratio))
    out = out.withColumn("registry_key", X.registry_key(none.cast("string"), F.col("apps"), F.col("error_type"), F.col("normalized_message"), F.col("namespaces")))
    if known_fingerprints is not None:
        out = out.join(known_fingerprints.select("fingerprint", F.lit(True).alias("seen")).distinct(), "fingerprint", "left")
    else:
        out = out.withColumn("seen", none.cast("boolean"))
    if known_problem_keys is not None:
        out = out.join(known_problem_keys.select(F.col("problem_key").alias("registry_key"), F.lit(True).alias("seen_key")).distinct(), "registry_key", "left")
    else:
        out = out.withColumn("seen_key", none.cast("boolean"))
    if fixes is not None:
        out = out.join(fixes.select("fingerprint", "fixed_in"), "fingerprint", "left")
    else:
        out = out.withColumn("fixed_in", none.cast("string"))
    latest = X.latest_version(F.col("versions"))
    out = out.withColumn("latest_version", latest).withColumn("is_regression", F.coalesce(F.col("fixed_in").isNotNull() & F.col("latest_version").isNotNull() & X.version_at_least(F.col("latest_version"), F.col("fixed_in")), F.lit(False)))
    out = out.withColumn("is_new", F.col("seen").isNull() & F.col("seen_key").isNull()).withColumn("is_cross_namespace", F.col("namespace_count") >= 2)
    out = out.withColumn("is_silence", (F.col("current_rate") == 0) & (F.col("baseline_ewma") > 5)).withColumn("is_cascade", F.lit(False))
    return out.withColumn("evidence", _evidence(burst_threshold, spike_ratio)).drop("seen", "seen_key")


def _evidence(burst_threshold: float, spike_ratio: float) -> Column:
    number = lambda c: c.cast("double") if isinstance(c, Column) else F.lit(c).cast("double")
    one = lambda rule, base, now, limit, said: F.struct(F.lit(rule).alias("rule"), number(base).alias("baseline"), number(now).alias("current"), number(limit).alias("threshold"), said.alias("message"))
    p = F.col("peak")
    peak_id = F.concat(F.lit("SPIKE:NS:"), p["namespace"], F.lit(":"), F.date_format(p["window_start"], "yyyy-MM-dd'T'HH:mm:ssXXX"))
    cases = [
        (p.isNotNull(), one("spike_p93_cap", None, p["value"], F.least(p["p93"], p["cap"]), F.concat(F.lit("namespace "), p["namespace"], F.lit(" total "), p["value"].cast("string"), F.lit(" exceeds thresholds, peak_id="), peak_id))),
        (F.col("is_spike") & p.isNull(), one("spike_ewma", F.col("baseline_ewma"), F.col("current_rate"), spike_ratio, F.format_string("ratio (%.2f) > threshold", "trend_ratio"))),
        (F.col("is_burst"), one("burst", None, F.col("max_count"), burst_threshold, F.format_string("max/avg ratio (%.2f)", "burst_ratio"))),
        (F.col("is_new"), one("new_fingerprint", None, None, None, F.concat(F.lit("fingerprint "), "fingerprint", F.lit(" not seen before")))),
        (F.col("seen").isNull() & F.col("seen_key").isNotNull(), one("new_fingerprint_known_problem", None, None, None, F.concat(F.lit("fingerprint is new, but problem "), "registry_key", F.lit(" is known")))),
        (F.col("is_cross_namespace"), one("cross_namespace", None, F.col("namespace_count"), 2, F.format_string("in %d namespaces", "namespace_count"))),
        (F.col("is_silence"), one("silence", F.col("baseline_ewma"), 0, None, F.format_string("expected ~%.1f errors but got 0", "baseline_ewma"))),
        (F.col("is_regression"), one("regression", None, None, None, F.concat(F.lit("was fixed in "), "fixed_in", F.lit(", but appeared in "), "latest_version"))),
    ]
    return F.array_compact(F.array(*(F.when(c, e) for c, e in cases)))


def scored(detected: DataFrame) -> DataFrame:
    """Adds category, score and severity."""
    parts = score_parts({f: F.col(f) for f in FLAGS}, F.col("total_count"), F.col("trend_ratio"), F.col("namespace_count"))
    found = classify(detected).withColumn("score_parts", parts)
    return found.withColumn("score", score_total(F.col("score_parts"))).withColumn("severity", V.severity(F.col("score")))


def incidents(records: DataFrame, run_date: str = "1970-01-01", **known) -> DataFrame:
    """One row per fingerprint: measurement, flags, evidence, score, severity, category, and who it hit (most often first)."""
    cells = staged(M.cells(records), "cells")
    found = scored(detect(records, cells=cells, **known))
    for name, key in (("app_counts", "app_name"), ("namespace_counts", "namespace"), ("originator_counts", "originator")):
        found = found.join(M.cell_counter(cells, key).withColumnRenamed(key, name), "fingerprint", "left")
    samples = cells.groupBy("fingerprint").agg(F.min("first")["raw_message"].alias("sample_message"))
    found = found.join(samples, "fingerprint", "left")
    names = lambda c: F.transform(c, lambda x: x["key"])
    return found.withColumn("apps", names("app_counts")).withColumn("namespaces", names("namespace_counts")).withColumn("versions", F.array_sort("versions")).withColumn("run_date", F.lit(run_date).cast("date"))


def with_incident_ids(found: DataFrame) -> DataFrame:
    """Adds ``incident_id`` (inc-YYYYMMDD-NNN) in order of first arrival: numbers within ranges of a range sort, after the counts of the ranges before."""
    ordered = found.repartitionByRange("first_seq").sortWithinPartitions("first_seq").withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    ordered = staged(ordered, "ordered")  # ranges come from a sample; both uses must see the same ones
    counts = ordered.groupBy("_p").agg(F.count("*").alias("_n"))
    starts = counts.alias("a").join(counts.select(F.col("_p").alias("_q"), F.col("_n").alias("_m")).alias("b"), F.col("_q") < F.col("_p"), "left").groupBy("_p").agg(F.coalesce(F.sum("_m"), F.lit(0)).alias("_before"))
    numbered = ordered.join(F.broadcast(starts), "_p")  # a row per partition
    return numbered.withColumn("incident_id", F.concat(F.lit("inc-"), F.date_format("run_date", "yyyyMMdd"), F.lit("-"), F.format_string("%03d", F.col("_before") + F.col("_k") + 1))).drop("_p", "_k", "_before")


def fingerprint_traces(records: DataFrame) -> DataFrame:
    """``fingerprint, trace_id, n``: how many events of the fingerprint each trace has. Kept as rows; a row per incident could not hold them."""
    return records.filter(F.col("trace_id").isNotNull()).groupBy("fingerprint", "trace_id").agg(F.count("*").alias("n"))


def summary(found: DataFrame) -> DataFrame:
    """Incidents by severity and category."""
    return found.groupBy("severity", "category").agg(F.count("*").alias("incidents"), F.sum("total_count").alias("events"))


# --- rows that a run stores ---


def incident_rows(fact_rows: DataFrame, found: DataFrame) -> DataFrame:
    """Per window, namespace and fingerprint: count, applications and the one with most (of equals the smallest name), with the incident's score and class."""
    per_app = fact_rows.groupBy("window_start", "namespace", "fingerprint", "app_name").agg(F.sum("error_count").alias("n"))
    rows = per_app.groupBy("window_start", "namespace", "fingerprint").agg(
        F.sum("n").alias("error_count"), F.array_sort(F.collect_set("app_name")).alias("apps"), F.min(F.struct((-F.col("n")).alias("down"), "app_name"))["app_name"].alias("top_app")
    )
    return rows.join(found.select("fingerprint", "error_type", "category", "subcategory", "score", "severity"), "fingerprint")


def missing_incidents(fact_rows: DataFrame, found: DataFrame) -> DataFrame:
    """Fingerprints with facts and no incident; a run must have none."""
    return fact_rows.select("fingerprint").distinct().join(found.select("fingerprint"), "fingerprint", "left_anti")


def detection_rows(fact_rows: DataFrame, found: DataFrame) -> DataFrame:
    """Every window, namespace and fingerprint with each piece of its incident's evidence."""
    where = fact_rows.select("window_start", "namespace", "fingerprint").distinct()
    return where.join(found.select("fingerprint", F.explode("evidence").alias("e")), "fingerprint").select("window_start", "namespace", "fingerprint", "e.rule", "e.baseline", "e.current", "e.threshold", "e.message")


def reconcile(expected: int, fetched: int, records: DataFrame, fact_rows: DataFrame, namespace_rows: DataFrame) -> None:
    """Raises unless as many events were expected, fetched, processed, and are in the facts and in the namespace windows."""
    counts = {
        "expected": expected, "fetched": fetched, "processed": records.count(), "facts": fact_rows.agg(F.coalesce(F.sum("error_count"), F.lit(0))).first()[0],
        "namespaces": namespace_rows.agg(F.coalesce(F.sum("error_count"), F.lit(0))).first()[0],
    }
    if len(set(counts.values())) != 1:
        raise ValueError(f"counts differ: {counts}")
