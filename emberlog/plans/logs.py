"""Queries over log events: parsing, texts, facts, measures, thresholds and peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog import rules
from emberlog.functions import text as X
from emberlog.functions import values as V
from emberlog.operators import measure, peaks
from emberlog.operators.parse import by_fingerprint, parse
from emberlog.plans import sql as S
from emberlog.plans.catalog import query, table
from emberlog.sources import logs as L
from emberlog.sources.tables import once, spread

MONITORED = ["shop-prod-01", "shop-prod-02", "cards-uat-01", "cards-dev-04", "core-sit"]
R = lambda c: F.round(c, 6)


def errors(spark: SparkSession, d: str) -> DataFrame:
    return L.errors(L.log_events(table(spark, d, "events")))


def records(spark: SparkSession, d: str) -> DataFrame:
    """Events are dealt out as they are stored: the log view's texts, made of four columns, are made by the tasks that parse them."""
    return once(spark, d, "records", lambda: parse(L.errors(L.log_events(spread(table(spark, d, "events"))))))


def facts(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "facts", lambda: measure.facts(records(spark, d)))


def monitored(spark: SparkSession) -> DataFrame:
    return L.namespace_scope(spark, MONITORED)


def dense(spark: SparkSession, d: str) -> DataFrame:
    return measure.dense_namespace_counts(facts(spark, d), monitored(spark))


def trained(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = once(spark, d, "thresholds", lambda: peaks.train_thresholds(dense(spark, d)))
    return rows, peaks.caps(rows)


def epoch(c: str) -> F.Column:
    return F.unix_seconds(c).alias(c)


@query(S.ctes("logs") + " SELECT seq, namespace, app_name, message FROM logs WHERE level = 'ERROR' AND us >= 1704412800000000 AND us < 1705276800000000 AND namespace IN ('shop-prod-01', 'cards-uat-01')")
def log_scan(spark, d):
    """The pushed-down source query; the scan reads only row groups within the days asked for."""
    raw = L.between(table(spark, d, "events"), "2024-01-05", "2024-01-15")
    return L.errors(L.log_events(raw), namespaces=["shop-prod-01", "cards-uat-01"]).select("seq", "namespace", "app_name", "message")


@query(S.ctes("errs") + " SELECT seq, us, coalesce(namespace, '-') AS namespace, app_name, coalesce(app_version, '-') AS app_version, coalesce(exception_type, '-') AS exception_type, substring(message, 1, 500) AS message FROM errs")
def flat_documents(spark, d):
    """Nested raw documents as flat records."""
    e = errors(spark, d)
    docs = e.select(
        "message", F.struct(F.col("app_name").alias("name"), F.col("app_version").alias("version")).alias("application"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("@timestamp"),
        F.struct("namespace").alias("kubernetes"), F.struct(F.col("exception_type").alias("type")).alias("exception"), F.col("seq").cast("string").alias("spanId"), "level",
    )
    flat = L.flat_records(docs)
    dash = lambda c: F.coalesce(c, F.lit("-")).alias(c)
    return flat.select(F.col("span_id").cast("long").alias("seq"), F.unix_micros("ts").alias("us"), dash("namespace"), "app_name", dash("app_version"), dash("exception_type"), "message")


@query(S.ctes("rec") + " SELECT seq, us, namespace, app_name, coalesce(app_version, '-') AS app_version, environment, normalized_message, error_type, fingerprint FROM rec")
def parsed_records(spark, d):
    """Records of all errors."""
    return records(spark, d).select("seq", F.unix_micros("ts").alias("us"), "namespace", "app_name", F.coalesce("app_version", F.lit("-")).alias("app_version"), "environment", "normalized_message", "error_type", "fingerprint")


@query(S.ctes("rec") + " SELECT fingerprint, count(*) AS n, min(seq) AS first_seq, min(error_type) AS error_type, min(normalized_message) AS normalized_message FROM rec GROUP BY fingerprint")
def fingerprints(spark, d):
    """A1."""
    return by_fingerprint(records(spark, d))


_T = "trim({})".format("regexp_replace(message, '\\s+', ' ', 'g')")
_LINE = "regexp_replace(trim(message), '^\\s+|\\s+$', '', 'g')"
_PLAIN100 = "substring(trim(" + S.replaced("message", [(r"\b\d+\b", "N"), (r"(?i)\b[0-9a-f]{8,}\b", "ID"), (r"\s+", " ")]) + "), 1, 100)"
_GUESS = S.case(((S.has_any("lower(error_type || ' ' || message)", w), S.quoted(c)) for w, c in rules.GUESSES), "'unknown'")
_SUB = S.case([*((f"category = {S.quoted(c)} AND " + S.has_any("lower(error_type || ' ' || message)", w), S.quoted(s)) for c, w, s in rules.SUBGUESSES), ("category = 'auth'", "'unauthorized'")], "'general'")
_SIGNAL = (
    f"CASE WHEN regexp_matches(trim(message), {S.quoted('(?i)' + rules.WRAPPER_HANDLED)}) THEN -10 WHEN regexp_matches(lower(message), {S.quoted(rules.WRAPPER_CASE)}) THEN -5 "
    "WHEN contains(lower(message), 'anonymize original error detail') THEN -8 ELSE CAST(length(message) >= 40 AS INT) + 3 * ("
    + " + ".join(f"CAST(regexp_matches(lower(message), {S.quoted(p)}) AS INT)" for p in rules.SIGNAL_GOOD) + ") - 3 * (" + " + ".join(f"CAST(regexp_matches(lower(message), {S.quoted(p)}) AS INT)" for p in rules.SIGNAL_BAD) + ") END"
)
_COUNT = lambda words: " + ".join(f"CAST({S.has('lower(message)', w)} AS INT)" for w in words)


def useful_sql(c: str) -> str:
    code = lambda i: f"regexp_extract({c}, {S.quoted(rules.STRUCTURED_CODE)}, {i})"
    return f"""CASE WHEN regexp_matches(trim({c}), {S.quoted('(?i)' + rules.WRAPPER_HANDLED)}) OR regexp_matches({c}, {S.quoted('(?i)' + rules.WRAPPER_CASE)}) THEN ''
    WHEN regexp_matches({c}, {S.quoted(rules.HANDLE_FAULT)}) THEN trim(regexp_extract({c}, {S.quoted(rules.HANDLE_FAULT)}, 1))
    WHEN regexp_matches({c}, {S.quoted(rules.STRUCTURED_CODE)}) THEN {code(6)} || '#' || {code(7)} || ' → ' || {code(8)} || ' (' || {code(9)} || ')' ELSE rtrim(split_part({c}, chr(10), 1)) END"""


USEFUL_SQL = useful_sql("message")


@query(
    S.ctes("typed") + f""", g AS (SELECT *, {_GUESS} AS category FROM typed), h AS (SELECT *, {_SUB} AS subcategory FROM g)
    SELECT seq, category, subcategory, substring(md5(category || '|' || subcategory || '|' || {_PLAIN100}), 1, 16) AS grouped_fingerprint, {USEFUL_SQL} AS useful, {_SIGNAL} AS signal,
    trim(regexp_replace({S.replaced('message', rules.TRACE_NORMALISATION)}, '\\s+', ' ', 'g')) AS trace_message, coalesce({S.extract('message', rules.STRUCTURED_STATUS)}, '') AS http_status,
    trim(regexp_replace({_T}, '{rules.STACK_FRAME}.*$', '')) AS no_stack,
    lower(trim({S.replaced('message', [('[0-9a-fA-F]{8,}', '<ID>'), (chr(92) + 'd+', '<ID>'), (chr(92) + 's+', ' ')])})) AS alert_text,
    CAST(length(message) >= 40 AS INT) + 3 * ({_COUNT(rules.ALERT_GOOD)}) - 3 * ({_COUNT(rules.ALERT_BAD)}) AS alert_signal,
    2 * ({_COUNT(rules.QUALITY_GOOD)}) - 3 * ({_COUNT(rules.QUALITY_BAD)}) + CAST(least(length(message) // 80, 5) AS INT) + 2 * CAST(lower(error_type) NOT IN ('', 'unknownerror', 'simpleerror') AS INT) AS quality,
    coalesce(CASE WHEN contains(message, '#') THEN split_part(message, '#', 1) END, '-') AS error_id FROM h"""
)
def message_texts(spark, d):
    """F6, F18, F20, F21, F32, F33, F36, F37, F42, F45, F46."""
    e = errors(spark, d).withColumn("error_type", X.error_type(F.col("message"), F.col("exception_type"), F.col("stack_trace"), F.col("http_status")))
    m, t = F.col("message"), F.col("error_type")
    category = X.guessed_category(t, m)
    return e.select(
        "seq", category.alias("category"), X.guessed_subcategory(category, t, m).alias("subcategory"), X.grouped_fingerprint(t, m).alias("grouped_fingerprint"), X.useful_content(m).alias("useful"),
        X.signal_score(m).alias("signal"), X.trace_message(m).alias("trace_message"), X.http_status_of(m).alias("http_status"), X.without_stack(m).alias("no_stack"), X.alert_text(m).alias("alert_text"),
        X.alert_signal(m).alias("alert_signal"), X.quality_score(m, t).alias("quality"), F.coalesce(X.error_id(m), F.lit("-")).alias("error_id"),
    )


_FLOW = S.case(((S.has("lower(app_name)", p), S.quoted(f)) for p, f in rules.FLOWS), "coalesce(nullif(array_to_string(list_filter(string_split(lower(app_name), '-'), lambda p: NOT list_contains(" + str(rules.FLOW_SKIP) + ", p) AND length(p) > 2)[1:2], '_'), ''), 'unknown')")
_RFLOW = S.case(((S.has("lower(app_name)", p), S.quoted(f)) for p, f in rules.REGISTRY_FLOWS), "coalesce(nullif(array_to_string(list_filter(string_split(lower(app_name), '-'), lambda p: NOT list_contains(" + str(rules.REGISTRY_FLOW_SKIP) + ", p))[1:2], '_'), ''), 'unknown')")
_UNINF = "lower(error_type) IN (" + ", ".join(map(S.quoted, rules.UNINFORMATIVE_TYPES)) + ")"
ECLASS_SQL = (
    f"CASE WHEN {_UNINF} THEN " + S.case(((S.has_any("lower(normalized_message)", w), S.quoted(c)) for w, c in rules.MESSAGE_CLASSES), "'unknown_error'")
    + " ELSE " + S.case(((S.has_any("lower(error_type)", w), S.quoted(c)) for w, c in rules.TYPE_CLASSES), "substring(lower(replace(error_type, ' ', '_')), 1, 50)") + " END"
)
RCLASS_SQL = S.case(
    ((S.matches("error_type || ' ' || normalized_message", "(?i)" + p), S.quoted(c)) for p, c in rules.REGISTRY_CLASSES),
    "CASE WHEN error_type = 'UnknownError' THEN 'unclassified' ELSE lower(regexp_replace(regexp_replace(error_type, '(.)([A-Z][a-z]+)', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) END",
)
FLOW_SQL, RFLOW_SQL = _FLOW, _RFLOW
#: Words that tell vague classes apart, of a column ``normalized_message`` (as ``message``).
DISC_SQL = "substring(array_to_string(regexp_extract_all(lower(" + S.replaced("(" + USEFUL_SQL + ")", [(rules.FQCN_PREFIX, ""), (rules.BARE_PREFIX, "")]) + "), '[a-zA-Z]{4,}')[1:5], '_'), 1, 50)"


@query(
    S.ctes("rec") + f""", k AS (SELECT seq, app_name, error_type, normalized_message, normalized_message AS message FROM rec), c AS (SELECT seq, error_type, {_FLOW} AS flow, {_RFLOW} AS registry_flow, {ECLASS_SQL} AS error_class,
    {RCLASS_SQL} AS registry_class, {DISC_SQL} AS words FROM k)
    SELECT seq, flow, registry_flow, error_class, registry_class, words, 'UNKNOWN:' || registry_flow || ':' || registry_class AS registry_key,
    'unknown:' || flow || ':' || CASE WHEN (error_class = 'unknown_error' OR list_contains({rules.GENERIC_CLASSES}, lower(error_class)) OR list_contains({rules.GENERIC_CLASSES}, lower(error_type))) AND words <> ''
        THEN error_class || '__' || words ELSE error_class END AS problem_key FROM c"""
)
def problem_keys(spark, d):
    """Both dialects of flows, error classes and keys."""
    r, apps = records(spark, d), F.array("app_name")
    t, m = F.col("error_type"), F.col("normalized_message")
    return r.select(
        "seq", X.flow(apps).alias("flow"), X.registry_flow(apps).alias("registry_flow"), X.error_class(t, m).alias("error_class"), X.registry_error_class(t, m).alias("registry_class"), X.discriminator(m).alias("words"),
        X.registry_key(F.lit(None).cast("string"), apps, t, m).alias("registry_key"), X.problem_key(F.lit("unknown"), apps, t, m).alias("problem_key"),
    )


@query(
    S.ctes("errs") + """, v AS (SELECT DISTINCT app_name, app_version AS v FROM errs WHERE app_version IS NOT NULL), p AS (SELECT *, list_transform(regexp_extract_all(v, '\\d+'), lambda x: CAST(x AS BIGINT)) AS n FROM v),
    b AS (SELECT *, lead(v) OVER (PARTITION BY app_name ORDER BY v) AS o, lead(n) OVER (PARTITION BY app_name ORDER BY v) AS m FROM p)
    SELECT app_name, v AS version, o AS other, n >= m AS at_least, CASE WHEN regexp_matches(v, '^\\d+\\.\\d+') THEN v ELSE '-' END AS loose,
    coalesce(regexp_extract(v, '^v?(\\d+)\\.(\\d+)\\.(\\d+)', 2), '') AS minor FROM b WHERE o IS NOT NULL"""
)
def version_order(spark, d):
    """Each version of an application and the next one by spelling, compared by their numbers."""
    v = errors(spark, d).filter("app_version is not null").select("app_name", F.col("app_version").alias("version")).distinct()
    both = v.withColumn("other", F.lead("version").over(Window.partitionBy("app_name").orderBy("version"))).filter("other is not null")
    minor = F.coalesce(X.semver(F.col("version"))["minor"].cast("string"), F.lit(""))
    return both.select("app_name", "version", "other", X.version_at_least(F.col("version"), F.col("other")).alias("at_least"), F.coalesce(X.loose_version(F.col("version")), F.lit("-")).alias("loose"), minor.alias("minor"))


@query(S.ctes("facts") + " SELECT w AS window_start, namespace, app_name, fingerprint, n AS error_count, first_us, last_us, error_type FROM facts")
def error_facts(spark, d):
    """A5, K11, M1."""
    f = facts(spark, d)
    return f.select(epoch("window_start"), "namespace", "app_name", "fingerprint", "error_count", F.unix_micros("first_event_at").alias("first_us"), F.unix_micros("last_event_at").alias("last_us"), "error_type")


@query(S.ctes("dense") + " SELECT w AS window_start, namespace, n AS error_count FROM dense")
def namespace_windows(spark, d):
    """Dense zero-filled windows."""
    return dense(spark, d).select(epoch("window_start"), "namespace", "error_count")


@query(S.ctes("p93") + " SELECT namespace, dow, p93, samples, median, round(mean, 6) AS mean, max FROM p93")
def thresholds(spark, d):
    """A12, M3, M8, M9, X39."""
    return trained(spark, d)[0].select("namespace", F.col("dow").cast("long").alias("dow"), "p93", "samples", "median", R("mean").alias("mean"), "max")


@query(S.ctes("caps") + " SELECT namespace, round(cap, 6) AS cap, median_p93, round(avg_p93, 6) AS avg_p93, min_p93, max_p93, total_samples FROM caps")
def threshold_caps(spark, d):
    """A13."""
    return trained(spark, d)[1].select("namespace", R("cap").alias("cap"), "median_p93", R("avg_p93").alias("avg_p93"), "min_p93", "max_p93", "total_samples")


JUDGED_SQL = S.ctes("caps") + f""", judged AS (SELECT d.w, d.namespace, d.n, CASE WHEN p.samples >= 10 THEN p.p93 ELSE c.cap END AS p93, c.cap FROM dense d JOIN caps c USING (namespace)
    JOIN p93 p ON p.namespace = d.namespace AND p.dow = {S.weekday('d.w')})"""


@query(JUDGED_SQL + " SELECT w AS window_start, namespace, n AS error_count, p93, round(cap, 6) AS cap, CASE WHEN n > p93 AND n > cap THEN 'both' WHEN n > p93 THEN 'p93' ELSE 'cap' END AS triggered_by FROM judged WHERE n > p93 OR n > cap")
def peak_windows(spark, d):
    """Which 15-minute namespace windows exceed their weekday's threshold or the cap."""
    rows = dense(spark, d)
    thr = peaks.train_thresholds(rows)
    found = peaks.judged(peaks.with_thresholds(rows, thr, peaks.caps(thr), F.weekday("window_start"))).filter("is_peak")
    return found.select(epoch("window_start"), "namespace", "error_count", "p93", R("cap").alias("cap"), "triggered_by")


@query(
    JUDGED_SQL + """ SELECT w AS window_start, namespace, CASE WHEN n > p93 OR n > cap THEN least(p93, cap) ELSE CAST(n AS DOUBLE) END AS replacement,
    (CASE WHEN n > p93 OR n > cap THEN 'PEAK (' || CASE WHEN n > p93 AND n > cap THEN 'both' WHEN n > p93 THEN 'p93' ELSE 'cap' END || '): value=' || n || ' > ' ELSE 'OK: value=' || n || ' <= ' END)
    || 'P93=' || CAST(round_even(p93, 0) AS BIGINT) || ', CAP=' || CAST(round_even(cap, 0) AS BIGINT) AS reason FROM judged"""
)
def peak_rows(spark, d):
    """Row detector with replacement and reason."""
    rows = dense(spark, d)
    thr = peaks.train_thresholds(rows)
    j = peaks.judged(peaks.with_thresholds(rows, thr, peaks.caps(thr), F.weekday("window_start")))
    j = peaks.replaced_values(j.withColumn("mean", F.lit(None).cast("double")), "error_count")
    return j.select(epoch("window_start"), "namespace", "replacement", "reason")


@query(S.ctes("caps") + """ SELECT m.namespace, CAST(g.d AS INT) AS dow, round(coalesce(p.p93, c.cap, 100), 6) AS effective FROM monitored m, (SELECT unnest(range(7)) AS d) g
    LEFT JOIN (SELECT * FROM p93 WHERE dow < 5) p ON p.namespace = m.namespace AND p.dow = g.d LEFT JOIN (SELECT * FROM caps WHERE namespace <> 'core-sit') c ON c.namespace = m.namespace""")
def threshold_grid(spark, d):
    """Threshold of every namespace and weekday, with fallbacks to the cap and the default."""
    thr, cap = trained(spark, d)
    g = peaks.threshold_grid(monitored(spark), thr.filter("dow < 5"), cap.filter("namespace != 'core-sit'"))
    return g.select("namespace", "dow", R("effective").alias("effective"))


@query(
    S.ctes("rec") + """, cells AS (SELECT fingerprint, w, count(*) AS n FROM rec GROUP BY ALL), b AS (SELECT min(w) AS w0, max(w) AS w1 FROM cells),
    grid AS (SELECT f.fingerprint, x.w FROM (SELECT DISTINCT fingerprint FROM cells) f, (SELECT unnest(range(w0, w1 + 900, 900)) AS w FROM b) x),
    rates AS (SELECT g.fingerprint, list(CAST(coalesce(c.n, 0) AS DOUBLE) ORDER BY g.w) AS v FROM grid g LEFT JOIN cells c USING (fingerprint, w) GROUP BY g.fingerprint),
    past AS (SELECT fingerprint, v[-1] AS current, v[:-2] AS h, list_sort(v[:-2]) AS s FROM rates),
    st AS (SELECT *, list_reduce(h, lambda a, x: 0.3::DOUBLE * x + 0.7::DOUBLE * a) AS ewma, (s[(len(s) - 1) // 2 + 1] + s[len(s) // 2 + 1]) / 2 AS median, list_avg(h) AS mean FROM past),
    de AS (SELECT *, list_sort(list_transform(h, lambda x: abs(x - median))) AS dv FROM st), m AS (SELECT *, (dv[(len(dv) - 1) // 2 + 1] + dv[len(dv) // 2 + 1]) / 2 AS mad, CASE WHEN ewma > 0 THEN current / ewma ELSE 1.0 END AS ratio FROM de),
    i AS (SELECT fingerprint, count(*) AS total_count, count(DISTINCT w) AS active_windows, count(DISTINCT namespace) AS namespace_count, array_to_string(list_sort(list(DISTINCT app_name)), ',') AS apps, (max(us) - min(us)) // 1000000 AS duration_sec FROM rec GROUP BY fingerprint)
    SELECT m.fingerprint, CAST(current AS BIGINT) AS current_count, round(ewma, 6) AS ewma, round(median, 6) AS median, round(mad, 6) AS mad, round(mean, 6) AS mean, len(h) AS sample_count,
    CASE WHEN ratio > 1.2 THEN 'increasing' WHEN ratio < 0.8 THEN 'decreasing' ELSE 'stable' END AS trend_direction, total_count, active_windows, CAST(namespace_count AS INT) AS namespace_count, apps, CAST(duration_sec AS BIGINT) AS duration_sec FROM m JOIN i USING (fingerprint)"""
)
def measurements(spark, d):
    """A2, A4, M2, M6, M7."""
    m = measure.measure(records(spark, d))
    return m.select(
        "fingerprint", "current_count", R("baseline_ewma").alias("ewma"), R("baseline_median").alias("median"), R("baseline_mad").alias("mad"), R("baseline_mean").alias("mean"), "sample_count", "trend_direction", "total_count",
        "active_windows", "namespace_count", F.array_join("apps", ",").alias("apps"), "duration_sec",
    )


@query(
    S.ctes("ns_counts") + """, r AS (SELECT namespace, w, list(CAST(n AS DOUBLE)) OVER last AS v, stddev_samp(n) OVER last AS sd FROM ns_counts WINDOW last AS (PARTITION BY namespace ORDER BY w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    s AS (SELECT *, list_sort(v) AS o FROM r), q AS (SELECT *, (o[(len(o) - 1) // 2 + 1] + o[len(o) // 2 + 1]) / 2 AS median FROM s), z AS (SELECT *, list_sort(list_transform(v, lambda x: abs(x - median))) AS dv FROM q)
    SELECT namespace, w AS window_start, round(list_reduce(v, lambda a, x: 0.3::DOUBLE * x + 0.7::DOUBLE * a), 6) AS ewma, median, (dv[(len(dv) - 1) // 2 + 1] + dv[len(dv) // 2 + 1]) / 2 AS mad,
    round(list_avg(v), 6) AS mean, round(coalesce(sd, 0), 6) AS stddev, CAST(len(v) AS INT) AS sample_count FROM z"""
)
def rolling_baselines(spark, d):
    """A3."""
    b = measure.rolling_baseline(measure.namespace_counts(facts(spark, d)), "namespace")
    return b.select("namespace", epoch("window_start"), R("ewma").alias("ewma"), "median", "mad", R("mean").alias("mean"), R("stddev").alias("stddev"), "sample_count")


@query(
    S.ctes("rec") + """, o AS (SELECT fingerprint, row_number() OVER (PARTITION BY fingerprint ORDER BY us, seq) - count(*) OVER (PARTITION BY fingerprint ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 3600000001 PRECEDING) AS c FROM rec)
    SELECT fingerprint, count(*) AS events, CAST(max(c) AS BIGINT) AS max_count, round(avg(c), 6) AS avg_count, count(*) >= 2 AND max(c) / avg(c) > 1.5 AS is_burst FROM o GROUP BY fingerprint"""
)
def bursts(spark, d):
    """Trailing counts in arrival order (an hour here, for the tables' thin streams)."""
    b = measure.bursts(records(spark, d), 3600, 1.5)
    return b.select("fingerprint", "events", F.col("max_count").cast("long").alias("max_count"), R("avg_count").alias("avg_count"), "is_burst")


@query(
    S.ctes("rec") + """, c AS (SELECT fingerprint, app_name AS k, count(*) AS n, min(seq) AS s FROM rec GROUP BY ALL)
    SELECT fingerprint, string_agg(k || '=' || n, ',' ORDER BY n DESC, s) AS apps FROM c GROUP BY fingerprint"""
)
def app_counters(spark, d):
    """Most common applications of each fingerprint."""
    c = measure.ranked_counter(records(spark, d), "app_name")
    return c.select("fingerprint", F.array_join(F.transform("app_name", lambda x: F.concat(x["key"], F.lit("="), x["n"].cast("string"))), ",").alias("apps"))


@query(
    S.ctes("dense") + """, t AS (SELECT namespace, to_timestamp(w + 3600) AT TIME ZONE 'UTC' AS t, w, CAST(n AS DOUBLE) AS v FROM dense),
    k AS (SELECT namespace, CAST(isodow(t) - 1 AS INT) AS dow, CAST(hour(t) AS INT) AS hour, CAST(minute(t) // 15 AS INT) AS quarter, w, v FROM t),
    s AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY namespace, dow, hour, quarter) >= 3 THEN avg(v) OVER (PARTITION BY namespace, dow, hour, quarter ORDER BY w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) ELSE v END AS x FROM k)
    SELECT namespace, dow, hour, quarter, round(avg(x), 6) AS mean, round(coalesce(stddev_samp(x), 0), 6) AS stddev, count(*) AS samples FROM s GROUP BY ALL"""
)
def slot_statistics(spark, d):
    """A14, M4, W10."""
    s = peaks.slot_statistics(dense(spark, d))
    return s.select("namespace", "dow", "hour", "quarter", R("mean").alias("mean"), R("stddev").alias("stddev"), "samples")


RATIO_SQL = S.ctes("dense") + """, r AS (SELECT *, avg(n) OVER near AS ref, avg(n) OVER day AS a24 FROM dense WINDOW near AS (PARTITION BY namespace, w // 86400 ORDER BY w RANGE BETWEEN 2700 PRECEDING AND 900 PRECEDING),
    day AS (PARTITION BY namespace ORDER BY w RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)), k AS (SELECT *, coalesce(ref, 0) AS reference, CASE WHEN a24 > 0 THEN a24 * 2.5 ELSE 100 END AS minimum FROM r)"""


@query(RATIO_SQL + " SELECT namespace, w AS window_start, n AS error_count, round(reference, 6) AS reference, round(minimum, 6) AS minimum FROM k WHERE n >= minimum OR (reference > 0 AND n / reference >= 3)")
def ratio_peaks(spark, d):
    """Peaks by the ratio to the three windows before or by size against the day's mean."""
    none = spark.createDataFrame([], "dow int, hour int, quarter int, namespace string, mean double")
    p = peaks.ratio_peaks(dense(spark, d), none, either=True).filter("is_peak")
    return p.select("namespace", epoch("window_start"), "error_count", R("reference").alias("reference"), R("minimum").alias("minimum"))


@query(S.ctes("dense").replace("WITH", "WITH RECURSIVE", 1) + """, d AS (SELECT namespace, w, CAST(n AS DOUBLE) AS v, row_number() OVER (PARTITION BY namespace, w // 86400 ORDER BY w) AS k FROM dense),
    f AS (SELECT namespace, w, k, v, 0.0::DOUBLE AS reference, v > 6 AS is_peak, v AS replacement, [v] AS near FROM d WHERE k = 1 UNION ALL
    SELECT namespace, w, k, v, ref, peak, new, list_append(near, new)[-5:] FROM (SELECT *, CASE WHEN peak THEN ref ELSE v END AS new FROM (SELECT *, v > 6 OR ref <= 0 OR v >= 3 * ref AS peak
    FROM (SELECT d.namespace, d.w, d.k, d.v, f.near, list_sum(f.near) / len(f.near) AS ref FROM f JOIN d ON d.namespace = f.namespace AND d.w = f.w + 900 AND d.k = f.k + 1))))
    SELECT namespace, w AS window_start, v AS error_count, round(reference, 6) AS reference, is_peak, round(replacement, 6) AS replacement FROM f""")
def replaced_series(spark, d):
    """A fold over values already replaced; checked against a loop in the tests as well."""
    p = peaks.replaced_series(dense(spark, d), limit=6.0, steep=3.0)
    return p.select("namespace", epoch("window_start"), "error_count", R("reference").alias("reference"), "is_peak", R("replacement").alias("replacement"))
