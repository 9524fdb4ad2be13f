"""Queries over what is written and read back, over rules and limits of the caller's own, and over streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog import rules
from emberlog.functions import sql as SF
from emberlog.functions import text as X
from emberlog.operators import alerts as A
from emberlog.operators import incidents as I
from emberlog.operators import ledger as L
from emberlog.operators import measure as M
from emberlog.operators import peaks
from emberlog.operators.parse import parse
from emberlog.plans import detection as D
from emberlog.plans import logs as Q
from emberlog.plans import sql as S
from emberlog.plans import state as T
from emberlog.plans.catalog import query, table
from emberlog.sources import exports as E
from emberlog.sources import logs as LS
from emberlog.sources.tables import shared_folder, spread, staged
from emberlog.streaming import detections as DS
from emberlog.streaming import facts as ST
from emberlog.streaming import keyed as KS


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/stages/{name}-{uuid.uuid4().hex}"


# --- files written and read back ---


@query("SELECT event_id, user_id, event_type FROM events")
def ndjson_rows(spark, d):
    """A line of JSON and a line cut short for each event; the broken lines are dropped."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    line = F.to_json(F.struct(*e.columns))
    folder = _folder(spark, "ndjson")
    e.select(F.explode(F.array(line, F.substring(line, 1, 12))).alias("value")).write.text(folder)
    return E.read_ndjson(spark, folder, e.schema)


@query(f"WITH l AS ({T._LINES}) SELECT CAST(dow AS INT) AS dow, CAST(hour AS INT) AS hour, CAST(quarter AS INT) AS quarter, namespace, round(sum(mean * samples) / sum(samples), 6) AS mean, max(sd) AS stddev, CAST(sum(samples) AS BIGINT) AS samples FROM l GROUP BY ALL")
def pattern_blocks(spark, d):
    """Slot statistics from older reports of pattern blocks, duplicates merged."""
    i, u = F.col("event_id"), F.col("user_id")
    block = F.format_string("Pattern (%d, %d, %d, 'ns-%d'): mean=%.1f, std=%.1f, samples=%d", u % 7, u % 24, i % 4, u % 3, (i % 50).cast("double"), (u % 9).cast("double"), i % 20 + 1)
    folder = _folder(spark, "blocks")
    table(spark, d, "events").select(block.alias("value")).write.text(folder)
    m = LS.merge_slots(LS.pattern_block_slots(spark, folder))
    return m.select("dow", "hour", "quarter", "namespace", Q.R("mean").alias("mean"), "stddev", "samples")


@query("SELECT CAST(event_id % 50 + 1 AS INT) AS rank, 'Issue of ' || event_type AS title, user_id AS count FROM events")
def top_issue_lines(spark, d):
    """Ranked issues from lines of reports, in both of their forms, among other lines."""
    r, u = F.col("event_id") % 50 + 1, F.col("user_id")
    title = F.concat(F.lit("Issue of "), "event_type")
    line = F.when(u % 2 == 0, F.concat(r, F.lit(". "), title, F.lit(" ("), u, F.lit(" events)"))).otherwise(F.concat(F.lit("#"), r, F.lit(" "), title, F.lit(": "), u))
    rows = table(spark, d, "events").select(F.explode(F.array(line, F.concat(F.lit("seen by "), title))).alias("value"))
    return E.top_issues(rows)


@query("SELECT CAST(user_id AS VARCHAR) AS total_errors, event_type || '-app' AS top_app, '-' AS worst_namespace FROM events")
def report_fields(spark, d):
    """Named fields of text reports; a field that a report lacks is null."""
    text = F.concat(F.lit("Report\n- Total errors: "), "user_id", F.lit("\nTop app : "), "event_type", F.lit("-app\n"))
    f = E.report_fields(table(spark, d, "events").select(text.alias("value")), ["Total errors", "Top app", "Worst namespace"])
    return f.select("total_errors", "top_app", F.coalesce("worst_namespace", F.lit("-")).alias("worst_namespace"))


@query(S.ctes("sev") + """ SELECT fingerprint, category, subcategory, severity, round(score, 6) AS score, total AS total_count, array_to_string(namespaces, ',') AS namespaces, array_to_string(apps, ',') AS apps FROM sev""")
def snapshot_rows(spark, d):
    """A run's incidents written as JSON and read back."""
    found = D.incidents(spark, d)
    folder = _folder(spark, "snapshot")
    E.snapshot(found, folder)
    back = E.read_snapshot(spark, folder, found.schema)
    joined = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    return back.select("fingerprint", "category", "subcategory", "severity", Q.R("score").alias("score"), "total_count", joined("namespaces"), joined("apps"))


@query(S.ctes("rkeyed") + """ SELECT registry_key, min(category) AS category, '["' || array_to_string(list_sort(list_distinct(flatten(list(apps)))), '","') || '"]' AS apps FROM rkeyed GROUP BY registry_key""")
def exported_registry(spark, d):
    """A table exported as CSV, arrays as JSON, and read back."""
    folder = _folder(spark, "exports")
    E.export_table(T.registry(spark, d).select("registry_key", "category", "apps"), folder, "problems", ("csv",))
    return spark.read.schema("registry_key string, category string, apps string").option("header", "true").csv(f"{folder}/problems/csv")


# --- retention ---

_KEPT = f"w >= {T._CUT_SEC}"


@query(S.ctes("cfacts") + f""", k AS (SELECT w // 86400 AS day, namespace, app_name, fingerprint, error_type, sum(c) AS e FROM cfacts WHERE w < {T._CUT_SEC} GROUP BY ALL), o AS (SELECT *, w - 60 * 86400 AS o FROM dense)
    SELECT 'kind_rollups' AS part, day, namespace, CAST(sum(e) AS BIGINT) AS error_count, count(*) AS rows FROM k GROUP BY ALL UNION ALL
    SELECT 'namespace_rollups', w // 86400, namespace, CAST(sum(n) AS BIGINT), count(*) FROM dense WHERE w < {T._CUT_SEC} GROUP BY ALL UNION ALL
    SELECT 'namespace_rollups', o // 86400, namespace, CAST(sum(n) AS BIGINT), count(*) FROM o GROUP BY ALL UNION ALL SELECT 'namespace_rollups', 19600, 'gone', 7, 96 UNION ALL
    SELECT 'facts', w // 86400, namespace, CAST(sum(c) AS BIGINT), count(*) FROM cfacts WHERE {_KEPT} GROUP BY ALL UNION ALL
    SELECT 'namespaces', w // 86400, namespace, CAST(sum(n) AS BIGINT), count(*) FROM dense WHERE {_KEPT} GROUP BY ALL""")
def maintained_tables(spark, d):
    """What retention leaves: rollups (stored ones replaced, others kept, legacy windows filled in) and what is newer than the cutoff."""
    _, facts, names = T.complete(spark, d)
    facts, names = staged(facts, "complete-facts"), staged(names, "complete-namespaces")
    legacy = Q.dense(spark, d).select((F.col("window_start") - F.expr("INTERVAL 60 DAYS")).alias("ts"), "namespace", "error_count")
    stale = L.kind_rollup(facts, "2024-01-10").withColumn("error_count", F.col("error_count") + 5)
    middle = names.filter(F.col("window_start").between("2024-01-08", "2024-01-09 23:59:59"))
    old = L.namespace_rollup(L.namespace_windows(middle, legacy.limit(0), T._CUT)).withColumn("error_count", F.col("error_count") + 5)
    gone = spark.createDataFrame([(19600, "gone", 7, 96, "legacy_peak_raw_data")], "d int, namespace string, error_count long, complete_window_count long, source_kind string")
    old = old.unionByName(gone.select(F.date_from_unix_date("d").alias("rollup_date"), *gone.columns[1:]))
    left = L.maintain(facts, names, legacy, stale, old, T._CUT)
    day = lambda c: F.datediff(c, F.lit("1970-01-01")).cast("long").alias("day")
    per = lambda part, at, rows: left[part].groupBy(F.lit(part).alias("part"), day(at), "namespace").agg(F.sum("error_count").alias("error_count"), rows.alias("rows"))
    one = F.count("*")
    parts = [per("kind_rollups", "rollup_date", one), per("namespace_rollups", "rollup_date", F.sum("complete_window_count")), per("facts", "window_start", one), per("namespaces", "window_start", one)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# --- rules and limits of the caller's own ---


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    return Q.records(spark, d).groupBy("fingerprint").agg(F.min("error_type").alias("error_type"), F.min_by("normalized_message", "seq").alias("normalized_message"))


@query(S.ctes("classed") + """ SELECT fingerprint, CASE WHEN own THEN 'pool' ELSE k.c END AS category, CASE WHEN own THEN 'closed_pool' ELSE k.s END AS subcategory
    FROM (SELECT *, regexp_matches(error_type || ' ' || normalized_message, '(?i)pool .*closed|HEAP SPACE') AS own FROM classed)""")
def own_classification(spark, d):
    """A rule added at run time goes before the others by its priority."""
    own = I.with_rule(rules.TAXONOMY, 10_000, "pool", "closed_pool", ["pool .*closed", "HEAP SPACE"])
    return I.classify(_kinds(spark, d), own).select("fingerprint", "category", "subcategory")


_OWN_WORDS = [(["token", "closed"], "session", "ended"), *rules.REFINEMENTS[1:]]
_SAID = "lower(concat_ws(' ', nullif(error_type, ''), nullif(normalized_message, '')))"


@query(S.ctes("classed") + ", s AS (SELECT fingerprint, k.c AS c, " + _SAID + " AS said FROM classed), r AS (SELECT fingerprint, c, " + S.case(((S.has_any("said", w), f"{{'c': {S.quoted(c)}, 's': {S.quoted(s)}}}") for w, c, s in _OWN_WORDS), "{'c': 'unknown', 's': ''}") + """ AS k FROM s)
    SELECT fingerprint, CASE WHEN c <> 'unknown' THEN c ELSE k.c END AS category, CASE WHEN c <> 'unknown' THEN '' ELSE k.s END AS subcategory FROM r""")
def own_refinement(spark, d):
    """U4: category rules added and removed; only unknown categories are refined."""
    kinds = I.classify(_kinds(spark, d))
    r = I.refined(F.col("category"), [F.col("error_type"), F.col("normalized_message")], _OWN_WORDS)
    return kinds.select("fingerprint", r["category"].alias("category"), r["subcategory"].alias("subcategory"))


@query(S.ctes("dense") + f""", j AS (SELECT namespace, w, n, CASE WHEN namespace = 'shop-prod-01' AND {S.weekday('w')} = 0 THEN 1.0 WHEN namespace = 'shop-prod-01' THEN 2.0 WHEN namespace = 'core-sit' THEN 0.5 ELSE 1.5 END AS p93,
    CASE namespace WHEN 'shop-prod-01' THEN 2.0 WHEN 'core-sit' THEN 0.5 ELSE 1.5 END AS cap FROM dense WHERE n > 0)
    SELECT namespace, w AS window_start, CAST(p93 AS DOUBLE) AS p93, CAST(cap AS DOUBLE) AS cap, CASE WHEN n > p93 AND n > cap THEN 'both' WHEN n > p93 THEN 'p93' WHEN n > cap THEN 'cap' ELSE '-' END AS triggered_by FROM j""")
def own_thresholds(spark, d):
    """Thresholds given in memory; a weekday of few samples falls back to the cap, a namespace without one to the default."""
    days = spark.createDataFrame([("shop-prod-01", 0, 1.0, 20), ("shop-prod-01", 1, 1.0, 5)], "namespace string, dow int, p93 double, samples long")
    caps = spark.createDataFrame([("shop-prod-01", 2.0), ("core-sit", 0.5)], "namespace string, cap double")
    rows = Q.dense(spark, d).filter("error_count > 0")
    j = peaks.judged(peaks.with_thresholds(rows, days, caps, F.weekday("window_start"), 1.5))
    return j.select("namespace", Q.epoch("window_start"), "p93", "cap", F.coalesce("triggered_by", F.lit("-")).alias("triggered_by"))


# --- texts and ids ---


@query(S.ctes("errs") + f" SELECT seq, substring({S.replaced('message', rules.STORED_MESSAGE)}, 1, {rules.STORED_LENGTH}) AS stored FROM errs")
def stored_messages(spark, d):
    """The SQL function of stored texts."""
    SF.register(spark)
    return spark.sql("SELECT seq, normalize_error_message(message) AS stored FROM {rows}", rows=Q.errors(spark, d))


@query("""WITH v AS (SELECT o_orderkey, CAST(o_custkey % 40 AS DOUBLE) AS e, CAST(o_orderkey % 3 * 10 AS DOUBLE) AS b, o_custkey % 3 AS c, o_custkey % 4 AS h, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey END AS p, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 7 END AS cap FROM orders)
    SELECT o_orderkey, round(greatest(0, 100 - least(50, CASE WHEN b > 0 THEN (e / b - 1) * 30 ELSE e / 2 END) - c * 10 - h * 5), 2) AS health, CAST(CASE WHEN p IS NOT NULL THEN p WHEN cap IS NOT NULL THEN cap ELSE 100 END AS DOUBLE) AS threshold FROM v""")
def scored_orders(spark, d):
    """The SQL functions of health and thresholds; orders stand for windows."""
    SF.register(spark)
    return spark.sql("""SELECT o_orderkey, calculate_health_score(CAST(o_custkey % 40 AS DOUBLE), CAST(o_orderkey % 3 * 10 AS DOUBLE), CAST(o_custkey % 3 AS INT), CAST(o_custkey % 4 AS INT)) AS health,
        effective_threshold(CAST(IF(o_custkey % 5 = 0, NULL, o_custkey) AS DOUBLE), CAST(IF(o_orderkey % 2 = 0, NULL, 7) AS DOUBLE)) AS threshold FROM {o}""", o=table(spark, d, "orders"))  # fmt: skip


_STEP = lambda c: f"list_distinct(list_filter(regexp_extract_all(lower(trim(regexp_replace({S.replaced(c, rules.TRACE_NORMALISATION)}, '\\s+', ' ', 'g'))), '[a-z0-9]+'), lambda x: len(x) > 2 AND x NOT IN ({', '.join(map(S.quoted, rules.STEP_STOP_WORDS))})))"


@query(S.ctes("rec") + f""", s AS (SELECT trace_id, app_name, raw_message, count(*) AS n, min(seq) AS first_seq FROM rec WHERE trace_id IS NOT NULL GROUP BY ALL), t AS (SELECT *, {_STEP('raw_message')} AS b FROM s),
    p AS (SELECT *, lag(app_name) OVER o AS app, lag(n) OVER o AS m, lag(b) OVER o AS a FROM t WINDOW o AS (PARTITION BY trace_id ORDER BY first_seq))
    SELECT trace_id, first_seq, app = app_name AND m = n AND len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b)) / least(len(a), len(b)) >= 0.75 AS same FROM p WHERE app IS NOT NULL""")
def duplicate_steps(spark, d):
    """steps of a trace that say what the step before them says."""
    r = Q.records(spark, d).filter(F.col("trace_id").isNotNull())
    steps = r.groupBy("trace_id", "app_name", "raw_message").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    o = Window.partitionBy("trace_id").orderBy("first_seq")
    before = steps.withColumns({"p_app": F.lag("app_name").over(o), "p_n": F.lag("n").over(o), "p_msg": F.lag("raw_message").over(o)}).filter(F.col("p_app").isNotNull())
    same = X.same_steps(F.col("p_app"), F.col("p_n"), F.col("p_msg"), F.col("app_name"), F.col("n"), F.col("raw_message"))
    return before.select("trace_id", "first_seq", same.alias("same"))


@query(S.ctes("owned") + " SELECT owner AS fingerprint, 'SPIKE:NS:' || namespace || ':' || strftime(make_timestamp(w * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS peak_id FROM owned")
def evidence_peaks(spark, d):
    """the ids of peaks that pieces of evidence name."""
    said = D.incidents(spark, d).select("fingerprint", F.explode("evidence").alias("e"))
    return said.select("fingerprint", X.peak_id(F.col("e.message")).alias("peak_id")).filter("peak_id is not null")


@query(S.ctes("rec") + """ SELECT app_name, sha256('{"index":"logs-' || app_name || '","namespaces":["' || array_to_string(list_sort(list(DISTINCT namespace)), '","') || '"]}') AS contract FROM rec GROUP BY app_name""")
def query_contracts(spark, d):
    """The hash of the canonical JSON of what a run reads."""
    per = Q.records(spark, d).groupBy("app_name").agg(F.collect_set("namespace").alias("namespaces"))
    return per.select("app_name", X.query_contract(F.concat(F.lit("logs-"), "app_name"), F.col("namespaces")).alias("contract"))


_HALF, _HALF_SEC = "2024-01-16 00:00:00", 1705363200
_WITHOUT = lambda c: f"array_to_string(list_sort(list_filter(p.{c}, lambda x: NOT list_contains(coalesce(k.{c}, []), x))), ',')"


@query(S.ctes("facts") + f""", h AS (SELECT fingerprint AS peak_key, w < {_HALF_SEC} AS old, CAST(sum(n) AS DOUBLE) AS c, list(DISTINCT app_name) AS apps, list(DISTINCT namespace) AS namespaces, max(last_us) AS last FROM facts GROUP BY ALL),
    j AS (SELECT p.peak_key, k.peak_key IS NOT NULL AS is_known, coalesce(k.last >= {(_HALF_SEC - 7200) * 1_000_000}, false) AS continues, {_WITHOUT('apps')} AS new_apps, {_WITHOUT('namespaces')} AS new_namespaces, p.c / k.c AS r
    FROM (SELECT * FROM h WHERE NOT old) p LEFT JOIN (SELECT * FROM h WHERE old) k USING (peak_key))
    SELECT peak_key, is_known, continues, new_apps, new_namespaces, CASE WHEN NOT continues OR r IS NULL OR r >= 1.2 THEN 'rising' WHEN r <= 0.8 THEN 'falling' ELSE 'stable' END AS trend FROM j""")
def continued_peaks(spark, d):
    """Which peaks of the second half of the month go on from the first, what is new in their scope, and their trend."""
    f = Q.facts(spark, d)
    half = lambda cond: f.filter(cond).groupBy(F.col("fingerprint").alias("peak_key")).agg(F.sum("error_count").alias("error_count"), F.collect_set("app_name").alias("apps"), F.collect_set("namespace").alias("namespaces"), F.max("last_event_at").alias("last_seen"))
    at = F.lit(_HALF).cast("timestamp")
    old = half(F.col("window_start") < at).withColumn("mean_count", F.col("error_count").cast("double"))
    new = A.with_known(half(F.col("window_start") >= at).drop("last_seen"), old, _HALF, 120)
    joined = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    return new.select("peak_key", "is_known", "continues", joined("new_apps"), joined("new_namespaces"), "trend")


# --- streams ---


def _pages(rows: DataFrame, at: str = "ts", pages: int = 4) -> list[DataFrame]:
    """Rows cut in the order of time into pages of about as many rows each."""
    us = F.unix_micros(F.col(at).cast("timestamp"))
    cuts = rows.agg(F.percentile_approx(us, [i / pages for i in range(1, pages)], 10_000).alias("c")).first()["c"] or []  # a few numbers
    page = sum((F.when(us > c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    return [rows.filter(F.coalesce(page, F.lit(0)) == i) for i in range(len(set(cuts)) + 1)]


def _streamed(spark: SparkSession, pages: list[DataFrame], transform: Callable[[str], DataFrame], mode: str | None = None, start: Callable | None = None, read: bool = True) -> DataFrame | None:
    """All that a stream emits. Page after page arrives in a folder, which ``transform`` reads as a stream; each time it starts again where it stopped."""
    folder = _folder(spark, "stream")
    put = lambda rows, number: rows.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
    for page in pages:
        spread(page).write.mode("append").parquet(f"{folder}/in")  # files enough for all cores
        stream = transform(f"{folder}/in")
        run = start(stream, f"{folder}/out", f"{folder}/state") if start else stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch") if read else None


def _event_stream(spark: SparkSession, d: str, transform: Callable[[DataFrame], DataFrame], mode: str | None = None, start: Callable | None = None) -> DataFrame:
    e = table(spark, d, "events")
    return _streamed(spark, _pages(e), lambda folder: transform(ST.read_events(spark, folder, e.schema)), mode, start)


_FACT = ("namespace", "app_name", "fingerprint")


@query(S.ctes("facts") + " SELECT w AS window_start, namespace, app_name, fingerprint, CAST(n AS BIGINT) AS error_count, first_us, last_us FROM facts")
def streamed_facts(spark, d):
    """The facts of a stream's pages together are the batch's facts."""
    per = _event_stream(spark, d, lambda logs: logs, start=ST.write_facts).groupBy("window_start", *_FACT).agg(F.sum("error_count").alias("error_count"), F.min("first_event_at").alias("a"), F.max("last_event_at").alias("z"))
    return per.select(Q.epoch("window_start"), *_FACT, "error_count", F.unix_micros("a").alias("first_us"), F.unix_micros("z").alias("last_us"))


@query(S.ctes("facts") + """, m AS (SELECT max(last_us) // 1000 - 900000 AS mark FROM facts) SELECT w AS window_start, namespace, app_name, fingerprint, CAST(n AS BIGINT) AS error_count FROM facts, m WHERE (w + 900) * 1000 <= mark""")
def watermarked_facts(spark, d):
    """Facts of tumbling windows, each emitted once, when the watermark has passed its end; the last windows wait for more events."""
    rows = _event_stream(spark, d, ST.windowed_facts, "append")
    return rows.select(Q.epoch("window_start"), *_FACT, "error_count")


@query(S.ctes("trail") + " SELECT fingerprint, count(*) AS events, CAST(max(c) AS BIGINT) AS max_count, CAST(sum(c) AS BIGINT) AS sum_count FROM trail GROUP BY fingerprint")
def streamed_bursts(spark, d):
    """Burst counts kept per fingerprint in list state, settled by event-time timers; keys silent for a day are forgotten."""
    emitted = _event_stream(spark, d, lambda logs: KS.stream_bursts(parse(logs.filter("level = 'ERROR'")), 3600), "update")
    return KS.burst_totals(emitted)


_ALERT_ROWS = """, pay AS (SELECT namespace AS peak_key, w, n, coalesce(lag(w) OVER o >= w - 21600, false) AS is_known, (w // 900) % 11 = 0 AS is_test, (w // 900) % 23 = 0 AS wider, row_number() OVER o AS i,
    CASE WHEN lag(n) OVER o IS NULL OR n >= 1.2 * lag(n) OVER o THEN 'rising' WHEN n <= 0.8 * lag(n) OVER o THEN 'falling' ELSE 'stable' END AS trend FROM ns_counts WINDOW o AS (PARTITION BY namespace ORDER BY w))"""
_SENT = "(reason <> 'test_peak_suppressed' AND reason NOT IN ('same_window_duplicate', 'cooldown_active', 'no_material_change'))"
_DECIDED = """CASE WHEN p.is_test THEN 'test_peak_suppressed' WHEN s_at IS NULL THEN 'first_seen_in_state' WHEN NOT p.is_known THEN 'new_peak' WHEN s_at = p.w THEN 'same_window_duplicate' WHEN s_trend <> p.trend THEN 'trend_changed'
    WHEN abs(p.n - s_n) * 100.0 / s_n >= 30 THEN 'count_delta_pct' WHEN p.wider THEN 'scope_changed' WHEN p.w < s_at + 2700 THEN 'cooldown_active' WHEN p.w - 7200 >= s_at THEN 'heartbeat' ELSE 'no_material_change' END"""


def alert_payload_rows(spark: SparkSession, d: str) -> DataFrame:
    """A payload for every namespace and window with errors, in arrival order of no particular kind: what the windows before say of it, and some made flags."""
    n = M.namespace_counts(Q.facts(spark, d))
    o = Window.partitionBy("namespace").orderBy("window_start")
    before, w = F.lag("error_count").over(o), F.unix_seconds("window_start")
    some = lambda cond: F.when(cond, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return n.select(
        F.col("namespace").alias("peak_key"), F.col("window_start").alias("at"), F.date_format("window_start", "yyyyMMddHHmm").alias("window_key"), "error_count",
        F.when(before.isNull() | (F.col("error_count") >= 1.2 * before), "rising").when(F.col("error_count") <= 0.8 * before, "falling").otherwise("stable").alias("trend"), ((F.floor(w / 900)) % 11 == 0).alias("is_test"),
        F.lit("").alias("test_originator"), F.coalesce(F.lag(w).over(o) >= w - 21600, F.lit(False)).alias("is_known"), some(F.floor(w / 900) % 23 == 0).alias("new_apps"), some(F.lit(False)).alias("new_namespaces"),
    )


@query(
    S.ctes("ns_counts").replace("WITH", "WITH RECURSIVE", 1) + _ALERT_ROWS + f""", run AS (SELECT peak_key, 0::BIGINT AS i, NULL::BIGINT AS w, NULL::BIGINT AS n, NULL::VARCHAR AS reason, NULL::BIGINT AS s_at, NULL::VARCHAR AS s_trend, NULL::BIGINT AS s_n FROM (SELECT DISTINCT peak_key FROM pay)
    UNION ALL SELECT peak_key, i, w, n, reason, CASE WHEN {_SENT} THEN w ELSE s_at END, CASE WHEN {_SENT} THEN trend ELSE s_trend END, CASE WHEN {_SENT} THEN n ELSE s_n END
    FROM (SELECT p.peak_key, p.i, p.w, p.n, p.trend, {_DECIDED} AS reason, s_at, s_trend, s_n FROM run JOIN pay p ON p.peak_key = run.peak_key AND p.i = run.i + 1)),
    m AS (SELECT max(w) * 1000 - 900000 AS mark FROM pay)
    SELECT peak_key, w, CAST(n AS BIGINT) AS error_count, reason, {_SENT} AS send FROM run, m WHERE i > 0 AND w * 1000 <= mark"""
)
def streamed_alerts(spark, d):
    """Decisions on paged payloads, kept per peak with cooldown and heartbeat; a payload is decided once the watermark has passed it."""
    rows = alert_payload_rows(spark, d)
    rows = staged(rows, "payloads")
    emitted = _streamed(spark, _pages(rows, "at"), lambda folder: KS.stream_decisions(spark.readStream.schema(rows.schema).parquet(folder)), "append")
    decided = emitted.filter(~F.col("reason").isin("cooldown_over", "heartbeat_due"))
    return decided.select("peak_key", F.floor(F.col("us") / 1_000_000).alias("w"), "error_count", F.regexp_replace("reason", r"delta_[\d.]+_", "delta_").alias("reason"), "send")


@query(S.ctes("sev") + """ SELECT fingerprint, category, subcategory, is_spike, is_burst, NOT seen AS is_new, is_cross AS is_cross_namespace, is_silence, is_regression, round(score, 6) AS score, severity, total AS total_count,
    coalesce(array_to_string(list_sort(versions), ','), '') AS versions FROM sev""")
def streamed_detections(spark, d):
    """Detections from mergeable parts of pages, as one run over all events finds them."""
    known = D.known(spark, d)
    rules = DS.Rules(known.pop("thresholds"), known.pop("cap_rows"), known.pop("burst_seconds"))
    parts = _folder(spark, "parts")
    e = table(spark, d, "events")
    _streamed(spark, _pages(e), lambda folder: ST.read_events(spark, folder, e.schema), start=lambda logs, out, state: DS.stream_detections(logs, parts, state, rules), read=False)
    i = DS.detections(spark, parts, rules, **known)
    return i.select(
        "fingerprint", "category", "subcategory", "is_spike", "is_burst", "is_new", "is_cross_namespace", "is_silence", "is_regression", Q.R("score").alias("score"), "severity", "total_count",
        F.array_join("versions", ",").alias("versions"),
    )
