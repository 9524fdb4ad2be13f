"""Queries over a run: flags, scores, classes, incidents and the rows that a run stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog import rules
from emberlog.functions import text as X
from emberlog.operators import incidents as I
from emberlog.operators import measure, peaks
from emberlog.plans import logs as G
from emberlog.plans import sql as S
from emberlog.plans.catalog import query
from emberlog.sources.tables import once

R = G.R

_CAT = S.case(
    (("(" + " OR ".join(S.matches("error_type || ' ' || normalized_message", "(?i)" + p) for p in ps) + ")", f"{{'c': {S.quoted(c)}, 's': {S.quoted(s)}}}") for _, c, s, ps in sorted(rules.TAXONOMY, key=lambda r: -r[0])),
    "{'c': 'unknown', 's': 'unclassified'}",
)
_SUBS = {
    # Half of the fingerprints are known, and fixes are known for some: by the first character of their name
    "fps": f"""SELECT fingerprint, min(error_type) AS error_type, arg_min(normalized_message, seq) AS normalized_message, min(seq) AS first_seq, CAST(count(*) AS BIGINT) AS total, count(DISTINCT namespace) AS n_ns,
        list_sort(list(DISTINCT namespace)) AS namespaces, list_sort(list(DISTINCT app_name)) AS apps, min(us) AS first_us, max(us) AS last_us,
        list_distinct(list(app_version) FILTER (app_version IS NOT NULL)) AS versions FROM rec GROUP BY fingerprint""",
    "classed": f"SELECT *, {_CAT} AS k FROM fps",
    "per_fp": "SELECT namespace, w, fingerprint, CAST(sum(n) AS BIGINT) AS n FROM facts GROUP BY ALL",
    "totals": f"""SELECT t.namespace, w, t.v AS value, contributors, owner, contribution, coalesce(CASE WHEN p.samples >= 10 THEN p.p93 END, c.cap, 100) AS p93, coalesce(c.cap, 100) AS cap FROM
        (SELECT namespace, w, CAST(sum(n) AS BIGINT) AS v, count(*) AS contributors, arg_min(fingerprint, (-n, fingerprint)) AS owner, arg_min(n, (-n, fingerprint)) AS contribution FROM per_fp GROUP BY ALL) t
        LEFT JOIN caps c USING (namespace) LEFT JOIN p93 p ON p.namespace = t.namespace AND p.dow = {S.weekday('w')}""",
    "owned": """SELECT * FROM (SELECT *, greatest(value / nullif(p93, 0), value / nullif(cap, 0), 0) AS strength, row_number() OVER (PARTITION BY owner ORDER BY greatest(value / nullif(p93, 0), value / nullif(cap, 0), 0) DESC, w, namespace) AS r
        FROM totals WHERE value > p93 OR value > cap) WHERE r = 1""",
    "lastw": "SELECT max(w) AS w1, min(w) AS w0 FROM rec",
    "trail": "SELECT fingerprint, row_number() OVER (PARTITION BY fingerprint ORDER BY us, seq) - count(*) OVER (PARTITION BY fingerprint ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 3600000001 PRECEDING) AS c FROM rec",
    "burst": "SELECT fingerprint, count(*) >= 2 AND max(c) / avg(c) > 1.5 AS is_burst FROM trail GROUP BY fingerprint",
    "cells": "SELECT fingerprint, w, CAST(count(*) AS DOUBLE) AS n FROM rec GROUP BY ALL",
    # The weighted mean in closed form; where powers vanish a positive mean stays at the least positive number
    "trend": """SELECT fingerprint, current, CASE WHEN h > 0 THEN greatest(e, 5e-324::DOUBLE) ELSE 0 END AS ewma FROM (SELECT fingerprint, coalesce(sum(n) FILTER (w = w1), 0) AS current, coalesce(sum(n) FILTER (w < w1), 0) AS h,
        coalesce(sum(n * (CASE WHEN w = w0 THEN 1 ELSE 0.3::DOUBLE END) * pow(0.7::DOUBLE, (w1 - w) // 900 - 1)) FILTER (w < w1), 0) AS e FROM cells, lastw GROUP BY fingerprint)""",
    "flags": """SELECT f.*, k.c AS category, k.s AS subcategory, o.owner IS NOT NULL AS is_spike, b.is_burst, f.fingerprint[1] IN ('0','1','2','3','4','5','6','7') AS seen, f.n_ns >= 2 AS is_cross, t.current = 0 AND t.ewma > 5 AS is_silence,
        CASE WHEN t.ewma > 0 THEN t.current / t.ewma ELSE 1 END AS ratio, coalesce(f.fingerprint[1] IN ('2', '9', 'a') AND list_max(list_transform(f.versions, lambda v: list_transform(regexp_extract_all(v, '\\d+'), lambda x: CAST(x AS BIGINT)))) >= [2, 9, 0], false) AS is_regression
        FROM classed f LEFT JOIN owned o ON o.owner = f.fingerprint JOIN burst b USING (fingerprint) JOIN trend t USING (fingerprint)""",
    "inc": """SELECT *, least(100, least(30, total / 10) + 25 * CAST(is_spike AS INT) + CASE WHEN ratio > 2 THEN least(5, ratio - 2) * 2 ELSE 0 END + 20 * CAST(is_burst AS INT) + 15 * CAST(NOT seen AS INT) + 35 * CAST(is_regression AS INT)
        + 15 * CAST(is_cross AS INT) + CASE WHEN n_ns > 2 THEN least(5, n_ns - 2) * 3 ELSE 0 END) AS score FROM flags""",
    "sev": "SELECT *, CASE WHEN score >= 80 THEN 'critical' WHEN score >= 60 THEN 'high' WHEN score >= 40 THEN 'medium' WHEN score >= 20 THEN 'low' ELSE 'info' END AS severity FROM inc",
}
S.TABLES.update(_SUBS)
S.NEEDS.update({
    "fps": ["rec"], "classed": ["fps"], "per_fp": ["facts"], "totals": ["per_fp", "caps"], "owned": ["totals"], "lastw": ["rec"], "trail": ["rec"], "burst": ["trail"], "cells": ["rec"], "trend": ["cells", "lastw"],
    "flags": ["classed", "owned", "burst", "trend"], "inc": ["flags"], "sev": ["inc"],
})


def known(spark: SparkSession, d: str) -> dict:
    """What a run knows beforehand in these queries: thresholds, half of the fingerprints, fixes of some."""
    thr, cap = G.trained(spark, d)
    fps = G.facts(spark, d).select("fingerprint").distinct()
    first = F.substring("fingerprint", 1, 1)
    return {
        "thresholds": thr, "cap_rows": cap, "known_fingerprints": fps.filter(first.between("0", "7")), "fixes": fps.filter(first.isin("2", "9", "a")).withColumn("fixed_in", F.lit("2.9.0")),
        "burst_seconds": 3600, "burst_threshold": 1.5,
    }


def incidents(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "incidents", lambda: I.incidents(G.records(spark, d), "2024-01-31", **known(spark, d)))


@query(S.ctes("owned") + " SELECT owner AS fingerprint, namespace, w AS window_start, value, contribution, contributors, round(strength, 6) AS trigger_score, CASE WHEN value > p93 AND value > cap THEN 'both' WHEN value > p93 THEN 'p93' ELSE 'cap' END AS triggered_by FROM owned")
def namespace_peaks(spark, d):
    """A6, A7."""
    thr, cap = G.trained(spark, d)
    p = peaks.namespace_peaks(G.facts(spark, d), thr, cap)
    return p.select("fingerprint", "namespace", G.epoch("window_start"), "value", "contribution", "contributors", R("trigger_score").alias("trigger_score"), "triggered_by")


@query(S.ctes("sev") + """ SELECT fingerprint, category, subcategory, is_spike, is_burst, NOT seen AS is_new, is_cross AS is_cross_namespace, is_silence, is_regression, round(score, 6) AS score, severity, total AS total_count,
    coalesce(array_to_string(list_sort(versions), ','), '') AS versions FROM sev""")
def detections(spark, d):
    """Flags, score and class of every fingerprint."""
    i = incidents(spark, d)
    return i.select(
        "fingerprint", "category", "subcategory", "is_spike", "is_burst", "is_new", "is_cross_namespace", "is_silence", "is_regression", R("score").alias("score"), "severity", "total_count",
        F.array_join("versions", ",").alias("versions"),
    )


@query(S.ctes("sev") + """ SELECT rule, count(*) AS n, count(DISTINCT fingerprint) AS fingerprints FROM (SELECT fingerprint, unnest(list_filter([CASE WHEN is_spike THEN 'spike_p93_cap' END, CASE WHEN is_burst THEN 'burst' END,
    CASE WHEN NOT seen THEN 'new_fingerprint' END, CASE WHEN is_cross THEN 'cross_namespace' END, CASE WHEN is_silence THEN 'silence' END, CASE WHEN is_regression THEN 'regression' END], lambda x: x IS NOT NULL)) AS rule FROM sev) GROUP BY rule""")
def evidence(spark, d):
    """Evidence of all rules."""
    e = incidents(spark, d).select("fingerprint", F.explode("evidence").alias("e"))
    return e.groupBy("e.rule").agg(F.count("*").alias("n"), F.countDistinct("fingerprint").alias("fingerprints"))


@query(S.ctes("sev") + """ SELECT 'inc-20240131-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS incident_id, fingerprint
    FROM (SELECT fingerprint, row_number() OVER (ORDER BY first_seq) AS n FROM sev)""")
def incident_ids(spark, d):
    """M32."""
    return I.with_incident_ids(incidents(spark, d)).select("incident_id", "fingerprint")


@query(S.ctes("sev") + " SELECT severity, category, count(*) AS incidents, CAST(sum(total) AS BIGINT) AS events FROM sev GROUP BY ALL")
def incident_summary(spark, d):
    """A54."""
    return I.summary(incidents(spark, d))


@query(
    S.ctes("sev") + """, a AS (SELECT w, namespace, fingerprint, app_name, sum(n) AS n FROM facts GROUP BY ALL)
    SELECT w AS window_start, namespace, a.fingerprint, CAST(sum(n) AS BIGINT) AS error_count, array_to_string(list_sort(list(app_name)), ',') AS apps, arg_min(app_name, (-n, app_name)) AS top_app, min(severity) AS severity
    FROM a JOIN sev USING (fingerprint) GROUP BY w, namespace, a.fingerprint"""
)
def incident_facts(spark, d):
    """A10, J26."""
    rows = I.incident_rows(G.facts(spark, d), incidents(spark, d))
    return rows.select(G.epoch("window_start"), "namespace", "fingerprint", "error_count", F.array_join("apps", ",").alias("apps"), "top_app", "severity")


@query(
    S.ctes("sev") + """, r AS (SELECT fingerprint, unnest(list_filter([CASE WHEN is_spike THEN 'spike_p93_cap' END, CASE WHEN is_burst THEN 'burst' END,
    CASE WHEN NOT seen THEN 'new_fingerprint' END, CASE WHEN is_cross THEN 'cross_namespace' END, CASE WHEN is_silence THEN 'silence' END, CASE WHEN is_regression THEN 'regression' END], lambda x: x IS NOT NULL)) AS rule FROM sev)
    SELECT DISTINCT w AS window_start, namespace, fingerprint, rule FROM facts JOIN r USING (fingerprint)"""
)
def detection_facts(spark, d):
    """A11, K12."""
    return I.detection_rows(G.facts(spark, d), incidents(spark, d)).select(G.epoch("window_start"), "namespace", "fingerprint", "rule")


_REFINE = S.case(((S.has_any("t", w), f"{{'c': {S.quoted(c)}, 's': {S.quoted(s)}}}") for w, c, s in rules.REFINEMENTS), "{'c': 'unknown', 's': ''}")


@query(S.ctes("fps") + f""", t AS (SELECT fingerprint, lower(normalized_message || ' ' || error_type) AS t FROM fps), r AS (SELECT fingerprint, {_REFINE} AS r, contains(t, 'account') AS own FROM t)
    SELECT fingerprint, r.c AS category, r.s AS subcategory, CASE WHEN own THEN 'accounts' ELSE r.c END AS domain_category FROM r""")
def refined_categories(spark, d):
    """Refinement of unknown categories, also with words of a domain."""
    k = G.by_fingerprint(G.records(spark, d))
    texts = [F.col("normalized_message"), F.col("error_type")]
    r, o = I.refined(F.lit("unknown"), texts), I.refined(F.lit("unknown"), texts, domain={"Account": ("accounts", "")})
    return k.select("fingerprint", r["category"].alias("category"), r["subcategory"].alias("subcategory"), o["category"].alias("domain_category"))


@query(S.ctes("rec") + """, k AS (SELECT fingerprint, min(seq) AS s FROM rec GROUP BY 1), p AS (SELECT DISTINCT 'UNKNOWN:' || split_part(x, ':', 2) || ':' || split_part(x, ':', 3) AS problem_key FROM (SELECT 'UNKNOWN:' || """
    + G.RFLOW_SQL + " || ':' || " + G.RCLASS_SQL + """ AS x FROM rec))
    SELECT problem_key FROM p WHERE problem_key = 'UNKNOWN:billing:timeout' OR (split_part(problem_key, ':', 2) = 'card_opening')""")
def known_problem_keys(spark, d):
    """Keys that are known as problems, or by category and flow of a peak."""
    r = G.records(spark, d)
    keys = r.select(X.registry_key(F.lit(None).cast("string"), F.array("app_name"), F.col("error_type"), F.col("normalized_message")).alias("problem_key"))
    problems = spark.createDataFrame([("UNKNOWN:billing:timeout",)], "problem_key string")
    peak_keys = spark.createDataFrame([("PEAK:unknown:card_opening:spike",)], "peak_key string")
    return I.known_keys(keys, problems, peak_keys)


@query(S.ctes("dense") + " SELECT (SELECT count(*) FROM rec) AS processed, (SELECT CAST(sum(n) AS BIGINT) FROM facts) AS fact_events, (SELECT CAST(sum(n) AS BIGINT) FROM ns_counts) AS namespace_events, 0::BIGINT AS unmatched")
def reconciliation(spark, d):
    """Events in each stage of a run, and fingerprints without an incident."""
    r, f = G.records(spark, d), G.facts(spark, d)
    one = lambda df, c: df.agg(c)
    a = one(r, F.count("*").alias("processed"))
    b, c = one(f, F.sum("error_count").alias("fact_events")), one(measure.namespace_counts(f), F.sum("error_count").alias("namespace_events"))
    missing = one(I.missing_incidents(f, G.by_fingerprint(r)), F.count("*").alias("unmatched"))
    return a.join(b).join(c).join(missing)  # one row each
