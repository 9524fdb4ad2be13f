"""Queries over problems and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog import rules
from emberlog.functions import values as V
from emberlog.operators import problems as P
from emberlog.operators import traces as T
from emberlog.operators.incidents import fingerprint_traces
from emberlog.plans import detection as D
from emberlog.plans import logs as G
from emberlog.plans import sql as S
from emberlog.plans.catalog import query, table
from emberlog.sources import logs as L
from emberlog.sources.tables import once

R = G.R
_CLASSES = str(rules.GENERIC_CLASSES)
_PATTERN = "list_filter(list_transform(apps_ranked, lambda app_name: " + S.case(((S.has("lower(app_name)", p), S.quoted(f)) for p, f in rules.FLOWS), "NULL") + "), lambda f: f IS NOT NULL)[1]"
_PARTS = G.FLOW_SQL[G.FLOW_SQL.rindex("ELSE coalesce") + 5 : -4]
_TRACE = "trim(regexp_replace(" + S.replaced("x", rules.TRACE_NORMALISATION) + ", '\\s+', ' ', 'g'))"
_UNINF = ", ".join(map(S.quoted, rules.UNINFORMATIVE_TYPES))
S.TABLES.update({
    "ranked_apps": """SELECT fingerprint, list(app_name ORDER BY n DESC, sq) AS apps_ranked, arg_min(app_name, (-n, sq)) AS app_name FROM
        (SELECT fingerprint, app_name, count(*) AS n, min(seq) AS sq FROM rec GROUP BY ALL) GROUP BY fingerprint""",
    "samples": "SELECT fingerprint, arg_min(raw_message, seq) AS sample_message FROM rec GROUP BY fingerprint",
    "incx": "SELECT s.*, normalized_message AS message, apps_ranked, app_name, sample_message FROM sev s JOIN ranked_apps USING (fingerprint) JOIN samples USING (fingerprint)",
    "keyed0": f"SELECT *, coalesce({_PATTERN}, {_PARTS}) AS flow, {G.ECLASS_SQL} AS ec, {G.DISC_SQL} AS words FROM incx",
    "keyed1": f"SELECT *, CASE WHEN (ec = 'unknown_error' OR list_contains({_CLASSES}, lower(ec)) OR list_contains({_CLASSES}, lower(error_type))) AND words <> '' THEN ec || '__' || words ELSE ec END AS eclass FROM keyed0",
    "keyed": "SELECT *, category || ':' || flow || ':' || eclass AS problem_key FROM keyed1",
    "prob": """SELECT problem_key, min(category) AS category, min(flow) AS flow, min(eclass) AS error_class, count(*) AS incident_count, CAST(sum(total) AS BIGINT) AS total_occurrences, min(first_us) AS first_us, max(last_us) AS last_us,
        list_sort(list_distinct(flatten(list(apps)))) AS apps, list_sort(list_distinct(flatten(list(namespaces)))) AS namespaces, bool_or(is_spike) AS has_spike, bool_or(is_burst) AS has_burst, bool_or(NOT seen) AS has_new,
        bool_or(is_regression) AS has_regression, bool_or(is_cross) AS is_cross_namespace, max(score) AS max_score, arg_max(severity, (score, -first_seq)) AS max_severity,
        list_sort(list_distinct(flatten(list(coalesce(versions, []))))) AS versions, arg_min(normalized_message, first_seq) AS message FROM keyed GROUP BY problem_key""",
    "prio": """SELECT *, least(150, max_score + least(20, log10(total_occurrences + 1) * 6) + least(10, greatest(len(apps) - 1, 0) * 2) + 8 * CAST(has_new AS INT) + 5 * CAST(is_cross_namespace AS INT)
        + 5 * CAST(has_spike AS INT) + 3 * CAST(has_burst AS INT)) AS priority FROM prob""",
    "tev0": f"SELECT *, {G.USEFUL_SQL} AS u FROM (SELECT *, raw_message AS message FROM rec) WHERE trace_id IS NOT NULL",
    "tev1": f"SELECT *, CASE WHEN u <> '' THEN u ELSE normalized_message END AS useful, {G.useful_sql('normalized_message')} AS nu FROM tev0",
    "tev2": f"SELECT * REPLACE (useful AS message), {_TRACE} AS tm FROM (SELECT *, lower(CASE WHEN nu <> '' THEN nu ELSE normalized_message END) AS x FROM tev1)",
    "tev": f"""SELECT trace_id, us, seq, app_name, namespace, {G._SIGNAL} AS signal, CASE WHEN lower(error_type) NOT IN ({_UNINF}) THEN error_type
        ELSE coalesce(nullif(array_to_string(list_filter(string_split(lower(tm), ' '), lambda w: length(w) > 3)[1:4], '_'), ''), 'unknown') END AS error_class, row_number() OVER (PARTITION BY trace_id ORDER BY us, seq) AS pos FROM tev2""",
    "tl": """SELECT trace_id, list({'app': app_name, 'error_class': error_class, 'signal': signal, 'ns': namespace} ORDER BY pos) AS ev, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM tev GROUP BY trace_id""",
    "steps": """SELECT *, list_transform(list_filter(list_transform(range(1, len(ev) + 1), lambda i: {'i': i, 's': ev[i].app || '/' || ev[i].error_class}), lambda x: x.i = 1 OR ev[x.i - 1].app || '/' || ev[x.i - 1].error_class <> x.s), lambda x: x.s) AS sig FROM tl""",
    "seen_apps": "SELECT trace_id, list(app_name ORDER BY p) AS apps FROM (SELECT trace_id, app_name, min(pos) AS p FROM tev GROUP BY ALL) GROUP BY trace_id",
    "ptr": "SELECT problem_key, trace_id, count(DISTINCT fingerprint) AS incidents, count(*) AS n, list_distinct(flatten(list(apps_ranked))) AS apps, bool_or(is_spike OR is_burst OR score >= 60) AS has_error FROM keyed JOIN (SELECT fingerprint, trace_id FROM rec WHERE trace_id IS NOT NULL) USING (fingerprint) GROUP BY ALL",
    "own": "SELECT trace_id, arg_max(problem_key, (n, problem_key)) AS problem_key FROM ptr GROUP BY trace_id",
})
S.NEEDS.update({
    "ranked_apps": ["rec"], "samples": ["rec"], "incx": ["sev", "ranked_apps", "samples"], "keyed0": ["incx"], "keyed1": ["keyed0"], "keyed": ["keyed1"], "prob": ["keyed"], "prio": ["prob"], "tev0": ["rec"], "tev1": ["tev0"],
    "tev2": ["tev1"], "tev": ["tev2"], "tl": ["tev"], "steps": ["tl"], "seen_apps": ["tev"], "ptr": ["keyed"], "own": ["ptr"],
})
joined = lambda c, by=",": F.array_join(c, by)


def keyed(spark: SparkSession, d: str) -> DataFrame:
    """Incidents with problem keys."""
    return once(spark, d, "keyed", lambda: P.keyed(D.incidents(spark, d)))


def rolled(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "problems", lambda: P.problems(keyed(spark, d)))


def traces_of(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints' events per trace."""
    return fingerprint_traces(G.records(spark, d))


def lines(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "timelines", lambda: T.timelines(G.records(spark, d)))


@query(S.ctes("prob") + """ SELECT problem_key, category, flow, error_class, incident_count, total_occurrences, array_to_string(apps, ',') AS apps, array_to_string(namespaces, ',') AS namespaces, array_to_string(versions, ',') AS versions,
    has_spike, has_burst, has_new, has_regression, is_cross_namespace, round(max_score, 6) AS max_score, max_severity, message, (last_us - first_us) // 1000000 AS span_sec FROM prob""")
def problems(spark, d):
    """A23-A25."""
    p = rolled(spark, d)
    return p.select(
        "problem_key", "category", "flow", "error_class", "incident_count", "total_occurrences", joined("apps").alias("apps"), joined("namespaces").alias("namespaces"), joined("versions").alias("versions"), "has_spike", "has_burst",
        "has_new", "has_regression", "is_cross_namespace", R("max_score").alias("max_score"), "max_severity", F.col("normalized_message").alias("message"),
        F.floor((F.unix_micros("last_seen") - F.unix_micros("first_seen")) / 1_000_000).cast("long").alias("span_sec"),
    )


@query(S.ctes("prio") + " SELECT problem_key, round(priority, 6) AS priority, total_occurrences, incident_count FROM prio ORDER BY priority DESC, total_occurrences DESC, incident_count DESC, problem_key LIMIT 25")
def top_problems(spark, d):
    """The problems that come first."""
    p = P.by_priority(P.with_priority(rolled(spark, d)), 25)
    return p.select("problem_key", R("priority").alias("priority"), "total_occurrences", "incident_count")


@query(S.ctes("prio") + """ SELECT problem_key, has_spike OR has_burst AS is_peak, total_occurrences >= 5 AND has_new AS is_selected,
    CASE WHEN len(namespaces) >= 4 OR len(apps) >= 8 THEN 'SYSTEMIC' WHEN len(namespaces) >= 2 THEN 'CROSS_NS' ELSE 'LOCAL' END AS scope FROM prio WHERE max_score >= 20 AND category IN ('timeout', 'database', 'business', 'auth')""")
def selected_problems(spark, d):
    """P1, P4, P5, M26."""
    p = P.filtered(rolled(spark, d), min_score=20, categories=["timeout", "database", "business", "auth"])
    return p.select("problem_key", (F.col("has_spike") | F.col("has_burst")).alias("is_peak"), ((F.col("total_occurrences") >= 5) & F.col("has_new")).alias("is_selected"), V.scope(F.size("namespaces"), F.size("apps")).alias("scope"))


@query(S.ctes("keyed") + """, v AS (SELECT problem_key, unnest(versions) AS version, total, first_us FROM keyed) SELECT problem_key, version, CAST(sum(total) AS BIGINT) AS occurrences, count(*) AS incidents FROM v GROUP BY ALL""")
def version_stats(spark, d):
    """A32."""
    return P.version_stats(keyed(spark, d)).select("problem_key", "version", "occurrences", "incidents")


@query(
    S.ctes("keyed") + """, v0 AS (SELECT problem_key, version, CAST(sum(total) AS BIGINT) AS o FROM (SELECT problem_key, unnest(versions) AS version, total FROM keyed) GROUP BY ALL),
    v AS (SELECT *, count(*) OVER (PARTITION BY problem_key) AS n, sum(o) OVER (PARTITION BY problem_key) AS t, list_transform(string_split(version, '.'), lambda x: CAST(x AS BIGINT)) AS k FROM v0),
    r AS (SELECT *, row_number() OVER (PARTITION BY problem_key ORDER BY o DESC, version) AS top, row_number() OVER w AS newest, lag(o) OVER w AS newer, lead(o) OVER w AS older FROM v WINDOW w AS (PARTITION BY problem_key ORDER BY k DESC, version DESC))
    SELECT problem_key, count(*) AS total_versions, coalesce(max(version) FILTER (top = 1 AND n >= 2 AND o > 3 * (t - o) / (n - 1)), '-') AS spike_version, coalesce(max(version) FILTER (newest = 1 AND n >= 2 AND o > t * 0.5), '-') AS new_version,
    coalesce(bool_or(o < newer * 0.2 AND o < older * 0.2), false) AS has_regression FROM r GROUP BY problem_key"""
)
def version_impact(spark, d):
    """A33, W19."""
    v = P.version_impact(P.version_stats(keyed(spark, d)))
    return v.select("problem_key", "total_versions", F.coalesce("spike_version", F.lit("-")).alias("spike_version"), F.coalesce("new_version", F.lit("-")).alias("new_version"), "has_regression")


_HEAD250 = "substring(u, 1, 247)"
_CUT250 = f"length(regexp_extract({_HEAD250}, '(?s)^(.*)[ .]', 1))"
_SHORT = f"CASE WHEN length(u) <= 250 THEN u ELSE CASE WHEN {_CUT250} > 125 THEN substring({_HEAD250}, 1, {_CUT250}) ELSE {_HEAD250} END || '...' END"
_SAID = {
    "said": f"SELECT problem_key, fingerprint, first_seq, total AS n, sample_message, CASE WHEN a <> '' THEN a ELSE b END AS said FROM (SELECT *, {G.useful_sql('sample_message')} AS a, {G.useful_sql('normalized_message')} AS b FROM keyed)",
    "heard": "SELECT *, sum(n) OVER (PARTITION BY problem_key) AS whole, bool_or(said <> '') OVER (PARTITION BY problem_key) AS any_said FROM said",
    "told": "SELECT * EXCLUDE (said), CASE WHEN any_said THEN said ELSE substring(sample_message, 1, 250) END AS message FROM heard WHERE said <> '' OR NOT any_said",
    "marked": f"SELECT *, CASE WHEN any_said THEN {G._SIGNAL} ELSE -1 END AS signal, {_TRACE} AS key FROM (SELECT *, message AS x FROM told)",
    "key_apps": "SELECT problem_key, key, arg_min(app_name, (-c, app_name)) AS app FROM (SELECT problem_key, key, app_name, count(*) AS c FROM marked JOIN (SELECT fingerprint, app_name FROM rec) USING (fingerprint) GROUP BY ALL) GROUP BY ALL",
    "kept": """SELECT * FROM (SELECT *, bool_or(signal >= -2) OVER (PARTITION BY problem_key) AS good FROM (SELECT problem_key, key, arg_max(message, (signal, -first_seq)) AS message, CAST(max(signal) AS INT) AS signal, CAST(sum(n) AS BIGINT) AS count, max(whole) AS whole
        FROM marked WHERE key <> '' GROUP BY ALL)) WHERE signal >= -2 OR NOT good""",
    "shown": f"SELECT * EXCLUDE (message, u), CASE WHEN u <> '' THEN {_SHORT} ELSE substring(message, 1, 250) END AS message FROM (SELECT *, {G.useful_sql('message')} AS u FROM kept)",
    "best": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY problem_key, lower(substring({_TRACE}, 1, 80)) ORDER BY signal DESC, count DESC, key) AS r FROM (SELECT *, message AS x FROM shown)) WHERE r = 1",
    "pattern": "SELECT problem_key, CAST(row_number() OVER (PARTITION BY problem_key ORDER BY signal DESC, count DESC, key) AS INT) AS rank, message, count, round(count / whole * 100, 1) AS share_pct, signal, app FROM best JOIN key_apps USING (problem_key, key)",
}
S.TABLES.update(_SAID)
S.NEEDS.update({"said": ["keyed"], "heard": ["said"], "told": ["heard"], "marked": ["told"], "key_apps": ["marked", "rec"], "kept": ["marked"], "shown": ["kept"], "best": ["shown"], "pattern": ["best", "key_apps"]})


@query(S.ctes("pattern") + " SELECT * FROM pattern WHERE rank <= 5")
def problem_patterns(spark, d):
    """Checked against a loop in the tests as well."""
    return P.patterns(keyed(spark, d))


@query(S.ctes("pattern") + """, b AS (SELECT problem_key, arg_max({'app': app, 'message': message, 'signal': signal}, (signal >= 0, signal, count, -rank)) AS b FROM pattern WHERE rank <= 8 GROUP BY 1)
    SELECT problem_key, b.app AS service, b.message AS message, CASE WHEN b.signal > 0 THEN 'ERROR' ELSE 'WARN' END AS level, CASE WHEN b.signal >= 3 THEN 'high' WHEN b.signal > 0 THEN 'medium' ELSE 'low' END AS confidence FROM b""")
def problem_root_causes(spark, d):
    """Root causes from patterns."""
    return P.root_causes(P.patterns(keyed(spark, d), 8))


@query(S.ctes("steps", "seen_apps") + """ SELECT s.trace_id, n AS n_events, array_to_string(sig, '|') AS signature, array_to_string(apps, ',') AS apps, (last_us - first_us) // 1000 AS duration_ms,
    coalesce(list_filter(ev, lambda e: e.signal >= 2)[1].app, ev[1].app) AS root_service, CASE WHEN ev[1].signal >= 3 THEN 'high' WHEN len(list_filter(ev, lambda e: e.signal >= 2)) > 0 THEN 'medium' ELSE 'low' END AS confidence,
    ev[-1].app AS outcome_service FROM steps s JOIN seen_apps USING (trace_id)""")
def trace_timelines(spark, d):
    """Timeline, course, root cause and outcome of every trace."""
    e = F.col("events")
    step = F.transform(T.signature(e), lambda s: F.concat(s["app"], F.lit("/"), s["error_class"]))
    return lines(spark, d).select(
        "trace_id", F.size(e).cast("long").alias("n_events"), joined(step, "|").alias("signature"), joined(T.apps_in_order(e)).alias("apps"), T.duration_ms(e).alias("duration_ms"), T.root_cause(e)["service"].alias("root_service"),
        T.root_cause(e)["confidence"].alias("confidence"), T.outcome(e)["service"].alias("outcome_service"),
    )


@query(S.ctes("steps", "seen_apps") + """ SELECT array_to_string(sig, '|') AS signature, count(*) AS occurrences, CAST(sum(n) AS BIGINT) AS total_errors, arg_min(trace_id, (-len(apps), -n, length(trace_id), trace_id)) AS representative
    FROM steps JOIN seen_apps USING (trace_id) GROUP BY 1""")
def trace_patterns(spark, d):
    """A29."""
    p = T.trace_patterns(lines(spark, d))
    return p.select(joined(F.transform("signature", lambda s: F.concat(s["app"], F.lit("/"), s["error_class"])), "|").alias("signature"), "occurrences", "total_errors", "representative")


@query(S.ctes("own", "tl", "seen_apps") + """ SELECT problem_key, count(*) AS owned_traces, CAST(sum(t.n) AS BIGINT) AS total_errors, arg_min(trace_id, (-len(apps), -t.n, length(trace_id), trace_id)) AS representative
    FROM own JOIN tl t USING (trace_id) JOIN seen_apps USING (trace_id) GROUP BY problem_key""")
def trace_ownership(spark, d):
    """A30, J24."""
    traces = keyed(spark, d).select("problem_key", "fingerprint").join(traces_of(spark, d), "fingerprint")
    return T.ownership(traces, lines(spark, d)).select("problem_key", "owned_traces", "total_errors", "representative")


@query(S.ctes("rec") + """, c AS (SELECT trace_id, list_sort(list(DISTINCT app_name)) AS deps, count(DISTINCT namespace) AS n_ns, count(*) AS events, max(us) - min(us) AS us, arg_min(app_name, (us, seq)) AS root, min(seq) AS s FROM rec WHERE trace_id IS NOT NULL GROUP BY 1)
    SELECT trace_id, array_to_string(deps, ',') AS deployments, n_ns AS namespaces, events, us AS span_us, root FROM c""")
def trace_contexts(spark, d):
    """A27, D22."""
    c = T.trace_contexts(G.records(spark, d))
    return c.select("trace_id", joined("deployments").alias("deployments"), F.size("namespaces").cast("long").alias("namespaces"), "events", (F.unix_micros("last_event") - F.unix_micros("first_event")).alias("span_us"), "root")


#: Conversations as traces: a trace has one deployment per role, a turn is a second.
_TALK = "SELECT 'c-' || conv_id AS trace_id, turn AS seq, role AS app_name, turn AS sec FROM conversations"


@query(f"""WITH t AS ({_TALK}), c AS (SELECT trace_id, list_sort(list(DISTINCT app_name)) AS deps, max(sec) - min(sec) AS sec, arg_min(app_name, (sec, app_name)) AS root, min(seq) AS s FROM t GROUP BY 1), p AS (SELECT * FROM c WHERE len(deps) > 1)
    SELECT (SELECT root FROM (SELECT root, count(*) AS n, min(s) AS m FROM p GROUP BY root) ORDER BY n DESC, m, root LIMIT 1) AS root_deployment, (SELECT array_to_string(list_sort(list_distinct(flatten(list(deps)))), ',') FROM p) AS affected,
    (SELECT count(*) FROM p) AS trace_count, (SELECT CAST(list_sort(list(sec))[count(*) // 2 + 1] AS DOUBLE) FROM p) AS propagation_sec""")
def trace_spread(spark, d):
    """Propagation over all traces; conversations stand for traces, roles for deployments."""
    c = table(spark, d, "conversations")
    r = c.select(F.concat(F.lit("c-"), "conv_id").alias("trace_id"), F.col("turn").alias("seq"), F.col("role").alias("app_name"), F.lit("n").alias("namespace"), F.timestamp_seconds("turn").alias("ts"))
    p = T.propagation(T.trace_contexts(r))
    return p.select("root_deployment", joined("affected").alias("affected"), "trace_count", "propagation_sec")


_KIND = "CASE WHEN len(apps) <= 1 THEN 'single' WHEN len(apps) >= 3 AND n >= 2 THEN 'cascade' WHEN len(apps) = 2 THEN 'linear' ELSE 'fan_out' END"


@query(S.ctes("prob") + """, p AS (SELECT problem_key, apps[1] AS root_service, len(apps) AS k, len(namespaces) > 1 AS x FROM prob)
    SELECT problem_key, root_service, CAST(k AS INT) AS service_count, CAST(k - 1 AS INT) AS fan_out, x AS is_cross_namespace, CASE WHEN k = 1 THEN 'single' WHEN k = 2 THEN 'linear' ELSE 'fan_out' END AS propagation_type FROM p""")
def problem_propagation(spark, d):
    """Propagation of problems by their applications."""
    return T.problem_propagation(rolled(spark, d))


@query(S.ctes("tl", "seen_apps") + f" SELECT trace_id, array_to_string(apps, ',') AS services, CAST(len(apps) - 1 AS INT) AS fan_out, {_KIND} AS propagation_type, (last_us - first_us) // 1000 AS duration_ms FROM tl JOIN seen_apps USING (trace_id)")
def trace_propagation(spark, d):
    """Propagation along traces."""
    return T.trace_propagation(lines(spark, d)).select("trace_id", joined("services").alias("services"), "fan_out", "propagation_type", "duration_ms")


@query(S.ctes("prob") + " SELECT count(*) AS problems, count(*) FILTER (len(namespaces) > 1) AS cross_namespace, round(avg(len(apps) - 1), 6) AS avg_fan_out, CAST(max(len(apps) - 1) AS INT) AS max_fan_out FROM prob")
def propagation_summary(spark, d):
    """A31."""
    s = T.propagation_summary(T.problem_propagation(rolled(spark, d)))
    return s.select("problems", "cross_namespace", R("avg_fan_out").alias("avg_fan_out"), "max_fan_out")


@query(S.ctes("keyed") + """ SELECT problem_key, arg_max(apps_ranked[1], (score, -first_seq)) AS service, arg_max(fingerprint, (score, -first_seq)) AS fingerprint, CASE WHEN max(score) >= 60 THEN 'ERROR' ELSE 'WARN' END AS level FROM keyed GROUP BY 1""")
def score_root_causes(spark, d):
    """Root cause from the incident of the highest score."""
    return T.problem_root_cause(keyed(spark, d)).select("problem_key", "service", "fingerprint", "level")


@query(S.ctes("ptr") + """, r AS (SELECT problem_key, trace_id, row_number() OVER (PARTITION BY problem_key ORDER BY len(apps) DESC, incidents DESC, trace_id) AS rank FROM ptr) SELECT problem_key, CAST(rank AS INT) AS rank, trace_id FROM r WHERE rank <= 3""")
def representative_traces(spark, d):
    """X18."""
    return T.representative_traces(T.incident_traces(keyed(spark, d), traces_of(spark, d)))


@query(S.ctes("ptr") + """ SELECT problem_key, arg_min(trace_id, (-(incidents + 10 * CAST(has_error AS INT) + len(apps)), trace_id)) AS trace_id, CAST(max(incidents + 10 * CAST(has_error AS INT) + len(apps)) AS BIGINT) AS points FROM ptr GROUP BY 1""")
def representative_trace(spark, d):
    """X17."""
    return T.representative_trace(T.incident_traces(keyed(spark, d), traces_of(spark, d))).select("problem_key", "trace_id", F.col("points").cast("long").alias("points"))


@query(S.ctes("tev") + """, t AS (SELECT trace_id FROM tev GROUP BY 1 ORDER BY count(*) DESC, trace_id LIMIT 20) SELECT trace_id, seq FROM tev WHERE pos <= 3 AND trace_id IN (SELECT trace_id FROM t) ORDER BY us, seq LIMIT 40""")
def top_trace_events(spark, d):
    """The first three events of the twenty busiest traces, forty in all."""
    r = G.records(spark, d)
    rows = r.join(T.top_traces(r, 20).select("trace_id"), "trace_id", "left_semi")
    return T.first_events(rows, 3, 40).select("trace_id", "seq")


@query(S.ctes("logs") + """, w AS (SELECT DISTINCT trace_id FROM logs WHERE level = 'ERROR' AND trace_id IS NOT NULL ORDER BY trace_id LIMIT 200) SELECT trace_id, seq, level FROM logs WHERE trace_id IN (SELECT trace_id FROM w)
    AND us >= 1704067200000000 AND us < 1705276800000000 ORDER BY us, seq LIMIT 3000""")
def trace_context(spark, d):
    """Events of all levels of the first 200 traces with errors."""
    logs = L.log_events(table(spark, d, "events"))
    ids = logs.filter("level = 'ERROR' and trace_id is not null").select("trace_id")
    return T.trace_context(logs, ids, "2024-01-01", "2024-01-15").select("trace_id", "seq", "level")
