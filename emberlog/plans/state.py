"""Queries over stored state: the run ledger, baselines, rollups, the registry and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog import rules
from emberlog.functions import values as V
from emberlog.operators import alerts as A
from emberlog.operators import ledger as L
from emberlog.operators import measure, peaks
from emberlog.operators import problems as P
from emberlog.operators import registry as G
from emberlog.plans import detection as D
from emberlog.plans import logs as Q
from emberlog.plans import problems as B
from emberlog.plans import sql as S
from emberlog.plans.catalog import query, table
from emberlog.sources import logs as LS

R = Q.R
#: Two runs of each day: the second one on even days only, failed on every third.
_RUNS = "SELECT 'a-' || d AS run_id, 'complete' AS status, d, d + 1 AS done FROM days UNION ALL SELECT 'b-' || d, CASE WHEN d % 3 = 0 THEN 'failed' ELSE 'complete' END, d, d + 2 FROM days WHERE d % 2 = 0"
S.TABLES.update({
    "days": "SELECT DISTINCT w // 86400 AS d FROM dense", "runs": _RUNS,
    "auth": "SELECT run_id, d FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY done DESC, run_id DESC) AS r FROM runs WHERE status = 'complete') WHERE r = 1",
    # The second run of a day counts one event more in every fact
    "cfacts": "SELECT f.*, a.run_id, n + CASE WHEN a.run_id[1] = 'b' THEN 1 ELSE 0 END AS c FROM facts f JOIN auth a ON a.d = f.w // 86400",
})
S.NEEDS.update({"days": ["dense"], "runs": ["days"], "auth": ["runs"], "cfacts": ["facts", "auth"]})


def ledger(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, namespace rows, fact rows) of two runs a day."""
    dense = Q.dense(spark, d)
    day = F.floor(F.unix_seconds("window_start") / 86400).cast("long")
    days = dense.select(day.alias("d")).distinct()
    at = lambda k: F.timestamp_seconds((F.col("d") + k) * 86400)
    one = lambda letter, status, done: days.select(F.concat(F.lit(f"{letter}-"), "d").alias("run_id"), status.alias("status"), "d", at(done).alias("completed_at"), at(done).alias("started_at"))
    runs = one("a", F.lit("complete"), 1).unionByName(one("b", F.when(F.col("d") % 3 == 0, "failed").otherwise("complete"), 2).filter("d % 2 = 0"))
    runs = runs.withColumn("superseded_by_run_id", F.lit(None).cast("string"))
    held = runs.select("run_id", "d")
    names = dense.withColumn("d", day).join(held, "d").drop("d")
    facts = Q.facts(spark, d).withColumn("d", day).join(held, "d").drop("d").withColumn("error_count", F.col("error_count") + F.col("run_id").startswith("b").cast("int"))
    return runs, names, facts


def complete(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(authority, complete facts, complete namespace rows)."""
    runs, names, facts = ledger(spark, d)
    authority = L.authoritative_windows(names, runs)
    facts = L.complete_rows(facts, authority).withColumnRenamed("app_name", "application").withColumn("category", F.lit("unknown")).withColumn("subcategory", F.lit("-"))
    return authority, facts, L.complete_rows(names, authority)


@query(S.ctes("auth") + " SELECT a.run_id, count(DISTINCT w) AS windows FROM auth a JOIN dense ON w // 86400 = d GROUP BY a.run_id")
def authoritative_windows(spark, d):
    """W1, J3, R7."""
    return complete(spark, d)[0].groupBy("run_id").agg(F.count("*").alias("windows"))


@query(S.ctes("cfacts") + " SELECT w // 86400 AS day, run_id, CAST(sum(c) AS BIGINT) AS events, count(*) AS rows FROM cfacts GROUP BY ALL")
def complete_facts(spark, d):
    """Facts of authoritative runs only."""
    f = complete(spark, d)[1]
    return f.groupBy(F.floor(F.unix_seconds("window_start") / 86400).cast("long").alias("day"), "run_id").agg(F.sum("error_count").alias("events"), F.count("*").alias("rows"))


_CUT = "2024-01-20"
_CUT_SEC = 1705708800


@query(S.ctes("cfacts") + f""" SELECT CAST(w // 86400 AS BIGINT) AS day, namespace, app_name AS application, fingerprint, CAST(sum(c) AS BIGINT) AS error_count, count(DISTINCT w) AS complete_window_count, min(first_us) AS first_us, max(last_us) AS last_us
    FROM cfacts WHERE w < {_CUT_SEC} GROUP BY ALL""")
def kind_rollups(spark, d):
    """A18."""
    r = L.kind_rollup(complete(spark, d)[1], _CUT)
    return r.select(F.datediff("rollup_date", F.lit("1970-01-01")).cast("long").alias("day"), "namespace", "application", "fingerprint", "error_count", "complete_window_count", F.unix_micros("first_event_at").alias("first_us"), F.unix_micros("last_event_at").alias("last_us"))


@query(S.ctes("dense") + f""", a AS (SELECT w, namespace, n, 1 AS k FROM dense WHERE w < {_CUT_SEC} AND NOT (namespace = 'core-sit' AND w // 86400 % 2 = 0)), b AS (SELECT w, namespace, n, 0 AS k FROM dense WHERE w < {_CUT_SEC} AND namespace IN ('core-sit', 'cards-uat-01')),
    u AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.w = b.w AND a.namespace = b.namespace))
    SELECT w // 86400 AS day, namespace, CAST(sum(n) AS BIGINT) AS error_count, count(DISTINCT w) AS complete_window_count, CASE WHEN bool_and(k = 1) THEN 'authoritative_facts' WHEN bool_and(k = 0) THEN 'legacy_peak_raw_data' ELSE 'mixed' END AS source_kind FROM u GROUP BY ALL""")
def namespace_rollups(spark, d):
    """Daily namespace rollup of authoritative windows and legacy rows where there are none."""
    dense = Q.dense(spark, d)
    even = F.floor(F.unix_seconds("window_start") / 86400) % 2 == 0
    facts = dense.filter(~((F.col("namespace") == "core-sit") & even))
    legacy = dense.filter(F.col("namespace").isin("core-sit", "cards-uat-01")).withColumnRenamed("window_start", "ts")
    r = L.namespace_rollup(L.namespace_windows(facts, legacy, _CUT))
    return r.select(F.datediff("rollup_date", F.lit("1970-01-01")).cast("long").alias("day"), "namespace", "error_count", "complete_window_count", "source_kind")


@query(S.ctes("cfacts") + f""", r AS (SELECT w // 86400 AS day, namespace, app_name, fingerprint, sum(c) AS e FROM cfacts WHERE w < {_CUT_SEC} GROUP BY ALL)
    SELECT day, fingerprint, namespace, app_name AS application, CAST(e AS BIGINT) AS error_count, CAST(e + 1 AS BIGINT) AS s_error_count FROM r WHERE fingerprint[1] = 'a'""")
def rollup_reconciliation(spark, d):
    """Staged rows that are stored with other counts (those of some fingerprints here)."""
    r = L.kind_rollup(complete(spark, d)[1], _CUT)
    stored = r.withColumn("error_count", F.col("error_count") + F.col("fingerprint").startswith("a").cast("int"))
    return L.rollup_differences(r, stored).select(F.datediff("rollup_date", F.lit("1970-01-01")).cast("long").alias("day"), "fingerprint", "namespace", "application", "error_count", "s_error_count")


@query(S.ctes("cfacts") + """, f AS (SELECT DISTINCT fingerprint FROM facts), g AS (SELECT DISTINCT w FROM dense WHERE w >= 1705622400 AND w < 1706227200), c AS (SELECT fingerprint, w, sum(c) AS c FROM cfacts GROUP BY ALL),
    r AS (SELECT f.fingerprint, list(CAST(coalesce(c.c, 0) AS DOUBLE)) AS v FROM f CROSS JOIN g LEFT JOIN c ON c.fingerprint = f.fingerprint AND c.w = g.w GROUP BY f.fingerprint)
    SELECT fingerprint, list_min(v) AS min, list_max(v) AS max, round(list_avg(v), 6) AS avg, list_sort(v)[len(v) // 2 + 1] AS median, CAST(len(v) AS INT) AS samples FROM r""")
def fingerprint_baselines(spark, d):
    """Rates of the week before a run, zeros of complete windows included."""
    authority, facts, _ = complete(spark, d)
    fps = Q.facts(spark, d).select("fingerprint").distinct()
    b = L.baseline_stats(L.fingerprint_rates(fps, facts, authority, "2024-01-26"))
    return b.select("fingerprint", "min", "max", R("avg").alias("avg"), "median", "samples")


@query(S.ctes("facts") + """, q AS (SELECT w, n, error_type, CASE fingerprint[1] WHEN 'a' THEN 'unknown' WHEN 'b' THEN 'derived' ELSE 'structured' END AS k FROM facts)
    SELECT w AS window_start, CAST(sum(n) AS BIGINT) AS total_events, CAST(coalesce(sum(n) FILTER (k = 'structured'), 0) AS BIGINT) AS structured_events, CAST(coalesce(sum(n) FILTER (k = 'unknown'), 0) AS BIGINT) AS unknown_events,
    CAST(coalesce(sum(n) FILTER (error_type = 'UnknownError'), 0) AS BIGINT) AS unknown_type_events, coalesce(round(100.0::DOUBLE * sum(n) FILTER (k = 'unknown') / sum(n), 2), 0) AS unknown_pct FROM q GROUP BY w""")
def metadata_quality(spark, d):
    """A20."""
    one = F.substring("fingerprint", 1, 1)
    f = Q.facts(spark, d).withColumn("run_id", F.lit("r")).withColumn("subcategory", F.lit("-")).withColumn("metadata_quality", F.when(one == "a", "unknown").when(one == "b", "derived").otherwise("structured"))
    q = L.metadata_quality(f)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return q.select(Q.epoch("window_start"), "total_events", zero("structured_events"), zero("unknown_events"), zero("unknown_type_events"), zero("unknown_pct"))


_DELIVERY = "SELECT date_trunc('hour', ts) AS hour, CASE user_id % 2 WHEN 0 THEN 'email' ELSE 'chat' END AS destination, CASE event_type WHEN 'click' THEN 'delivered' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'suppressed' ELSE 'skipped' END AS status, 'k' || user_id AS dedup_key FROM events"


def _deliveries(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", "delivered").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "suppressed").otherwise("skipped")
    return e.select(F.col("ts").cast("timestamp").alias("attempted_at"), F.lit("peak").alias("notification_type"), F.when(F.col("user_id") % 2 == 0, "email").otherwise("chat").alias("destination"), kind.alias("status"), F.concat(F.lit("k"), "user_id").alias("dedup_key"))


@query(f"WITH x AS ({_DELIVERY}) SELECT epoch_us(hour) // 1000000 AS hour, destination, status, count(*) AS deliveries FROM x GROUP BY ALL")
def delivery_health(spark, d):
    """A21."""
    return L.delivery_health(_deliveries(spark, d)).select(F.unix_seconds("hour_start").alias("hour"), "destination", "status", "deliveries")


@query(f"""WITH x AS ({_DELIVERY}), k AS (SELECT dedup_key, bool_or(status = 'delivered') AS a, bool_or(status = 'failed') AS f, bool_or(status = 'suppressed') AS s FROM x GROUP BY 1)
    SELECT CASE WHEN bool_or(f AND NOT a) THEN 'failed' WHEN bool_or(f) AND bool_or(a) THEN 'partial' WHEN bool_or(a) THEN 'complete' WHEN bool_or(s) THEN 'suppressed' ELSE 'skipped' END AS status,
    count(*) FILTER (f AND NOT a) AS failed_keys, count(*) FILTER (a) AS delivered_keys FROM k""")
def delivery_status(spark, d):
    """A22, S30."""
    return L.delivery_status(L.delivery_outcomes(_deliveries(spark, d)))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_orderstatus AS status, CAST(o_custkey % 600 AS DOUBLE) AS duration_seconds, o_custkey - o_custkey % 7 - (o_custkey - o_custkey % 11) AS source_delta, o_custkey - o_custkey % 11 - o_custkey AS persistence_delta FROM orders""")
def pipeline_health(spark, d):
    """Duration and count differences of runs; orders stand for runs."""
    o = table(spark, d, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    k = F.col("o_custkey")
    runs = o.select(F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderstatus").alias("status"), at.alias("started_at"), F.timestamp_seconds(F.unix_seconds(at) + k % 600).alias("completed_at"), (k - k % 7).alias("expected_count"), (k - k % 11).alias("fetched_count"), k.alias("persisted_count"))
    return L.pipeline_health(runs, "2024-01-01")


@query(S.ctes("dense") + """, s AS (SELECT w // 86400 AS day, w // 3600 % 24 AS hour, w // 900 % 4 AS quarter, namespace FROM dense WHERE n > 0),
    g AS (SELECT d.day, h.h AS hour, q.q AS quarter, m.namespace FROM (SELECT unnest(range(19725, 19730)) AS day) d, (SELECT unnest(range(24)) AS h) h, (SELECT unnest(range(4)) AS q) q, monitored m)
    SELECT g.day, CAST(g.hour AS INT) AS hour, CAST(g.quarter AS INT) AS quarter, g.namespace FROM g WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.day = g.day AND s.hour = g.hour AND s.quarter = g.quarter AND s.namespace = g.namespace)""")
def missing_slots(spark, d):
    """Slots of five days without a stored row."""
    rows = Q.dense(spark, d).filter("error_count > 0").select(F.floor(F.unix_seconds("window_start") / 86400).cast("long").alias("day"), *V.slot(F.col("window_start"))[1:], "namespace")
    days = F.sequence(F.lit(19725).cast("long"), F.lit(19729).cast("long"))
    return L.missing_slots(days, Q.monitored(spark), rows)


@query(S.ctes("caps") + """ SELECT 's2' AS snapshot_id, kind, namespace, coalesce(dow, -1) AS dow, value FROM (SELECT 'p93' AS kind, namespace, CAST(dow AS BIGINT) AS dow, round(p93, 2) AS value FROM p93 UNION ALL SELECT 'cap', namespace, NULL, round(cap, 2) FROM caps)""")
def latest_thresholds(spark, d):
    """Values of the last complete snapshot."""
    thr, cap = Q.trained(spark, d)
    snaps = [peaks.snapshot(thr, cap, i, at, status) for i, at, status in (("s1", "2024-01-01", "complete"), ("s2", "2024-01-08", "complete"), ("s3", "2024-01-15", "failed"))]
    heads, values = (snaps[0][k].unionByName(snaps[1][k]).unionByName(snaps[2][k]) for k in (0, 1))
    return peaks.latest_values(heads, values).select("snapshot_id", "kind", "namespace", F.coalesce("dow", F.lit(-1)).cast("long").alias("dow"), "value")


_LINES = "SELECT user_id % 7 AS dow, user_id % 24 AS hour, event_id % 4 AS quarter, 'ns-' || user_id % 3 AS namespace, CAST(event_id % 50 AS DOUBLE) AS mean, CAST(user_id % 9 AS DOUBLE) AS sd, event_id % 20 + 1 AS samples FROM events"


@query(f"WITH l AS ({_LINES}) SELECT CAST(dow AS INT) AS dow, CAST(hour AS INT) AS hour, CAST(quarter AS INT) AS quarter, namespace, round(sum(mean * samples) / sum(samples), 6) AS mean, max(sd) AS stddev, CAST(sum(samples) AS BIGINT) AS samples FROM l GROUP BY ALL")
def slot_lines(spark, d):
    """Slot statistics from text lines, duplicates merged."""
    e = table(spark, d, "events")
    i, u = F.col("event_id"), F.col("user_id")
    line = F.concat_ws("|", F.lit("DATA"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), u % 7, u % 24, i % 4, F.concat(F.lit("ns-"), u % 3), (i % 50).cast("double"), (u % 9).cast("double"), i % 20 + 1)
    m = LS.merge_slots(LS.parse_slot_lines(e.select(line.alias("value")).unionByName(spark.createDataFrame([("DATA|broken",), ("comment",)], "value string"))))
    return m.select("dow", "hour", "quarter", "namespace", R("mean").alias("mean"), "stddev", "samples")


@query("SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE -o_custkey END AS v FROM orders")
def upserted_rows(spark, d):
    """New rows take the place of old ones with equal keys. Finished and open orders are stored; open ones come again, and pending ones are new."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"), "o_orderstatus")
    old, new = o.filter("o_orderstatus != 'P'").select("k", "v"), o.filter("o_orderstatus != 'F'").select("k", (-F.col("v")).alias("v"))
    return L.upserted(old, new, ["k"])


@query("SELECT CAST(d AS VARCHAR) AS day FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events) WHERE day(d) <= 20")
def processed_days(spark, d):
    """Days that have an authoritative window."""
    days = table(spark, d, "events").select(F.to_date("ts").alias("day")).distinct()
    held = days.filter(F.dayofmonth("day") <= 20).select(F.col("day").cast("timestamp").alias("window_start"))
    return L.is_processed(days, held).select(F.col("day").cast("string").alias("day"))


# --- trends over occurrences of fingerprints ---

_NOW, _NOW_SEC = "2024-01-25 12:00:00", 1706184000
_IN = lambda a, b, now=_NOW_SEC: f"coalesce(sum(n) FILTER ({now} - w >= {a} AND {now} - w < {b}), 0)"
S.TABLES["occ"] = "SELECT fingerprint, w, CAST(sum(n) AS BIGINT) AS n FROM facts GROUP BY ALL"
S.NEEDS["occ"] = ["facts"]


def _occurrences(spark: SparkSession, d: str) -> DataFrame:
    n = Q.facts(spark, d).groupBy("fingerprint", F.col("window_start").alias("ts")).agg(F.sum("error_count").alias("n"))
    return n.groupBy("fingerprint").agg(F.array_sort(F.collect_list(F.struct("ts", "n"))).alias("times"), F.max("ts").alias("last_seen"))


@query(S.ctes("occ") + f""", v AS (SELECT fingerprint, {_IN(0, 7200)} AS c2, {_IN(0, 86400)} AS c24, list_filter([{', '.join(_IN(i * 86400, (i + 1) * 86400) for i in range(1, 7))}], lambda x: x > 0) AS b,
    list_filter([{', '.join(_IN(i * 7200, (i + 1) * 7200) for i in range(1, 6))}], lambda x: x > 0) AS b2 FROM occ GROUP BY fingerprint), t AS (SELECT *, coalesce(list_avg(b), 0) AS base, (c24 - list_avg(b)) / list_avg(b) * 100 AS pct FROM v)
    SELECT fingerprint, CAST(c2 AS BIGINT) AS current_2h, CAST(c24 AS BIGINT) AS current_24h, round(coalesce(list_avg(b2), 0), 6) AS base_2h, round(base, 6) AS base_24h, CASE WHEN base = 0 AND c24 = 0 THEN '24h: → 0' WHEN base = 0 THEN '24h: ↑ ' || CAST(c24 AS BIGINT)
    WHEN abs(pct) >= 200 THEN '24h: ↑ +200%' || CASE WHEN pct > 200 THEN '+' ELSE '' END ELSE '24h: → ' || CASE WHEN pct >= 0 THEN '+' ELSE '-' END || CASE WHEN round_even(pct, 0) = 0 AND pct < 0 THEN '0' ELSE CAST(CAST(abs(round_even(pct, 0)) AS BIGINT) AS VARCHAR) END || '%' END AS trend_24h FROM t""")
def error_trends(spark, d):
    """W11, M14, M24."""
    t = G.error_trends(_occurrences(spark, d), _NOW)
    return t.select("fingerprint", "current_2h", "current_24h", R("base_2h").alias("base_2h"), R("base_24h").alias("base_24h"), "trend_24h")


def _activity_sql(occ: str, key: str, now: int) -> str:
    """``key, activity, periodicity`` of a table (key, w, n) of occurrences, after its CTEs."""
    return f""", v AS (SELECT {key}, {_IN(0, 604800, now)} AS a, {_IN(604800, 1209600, now)} AS b, max(w) AS last FROM {occ} GROUP BY 1),
    g AS (SELECT {key}, w, w - lag(w) OVER (PARTITION BY {key} ORDER BY w) AS gap FROM {occ}),
    p AS (SELECT {key}, count(*) AS n, (max(w) - min(w)) / 86400.0 AS span, coalesce(bool_or(gap > 900), false) AS apart, count(DISTINCT w // 86400) AS days FROM g GROUP BY 1),
    k AS (SELECT {key}, count(*) FILTER (c >= 2) AS busy FROM (SELECT {key}, (w // 86400 + 3) % 7 AS dow, count(*) AS c FROM {occ} GROUP BY ALL) GROUP BY 1)
    SELECT {key}, CASE WHEN last < {now} - 604800 THEN 'inactive' WHEN b <= 0 THEN 'active / new' WHEN a / b >= 1.2 THEN 'active / rising' WHEN a / b <= 0.8 THEN 'active / falling' ELSE 'active / stable' END AS activity,
    CASE WHEN n = 1 THEN 'one-time' WHEN n = 2 THEN CASE WHEN span * 24 < 1 THEN 'one-time' ELSE 'sporadic' END WHEN NOT apart THEN 'one-time' WHEN span < 1 THEN 'sporadic' WHEN span >= 3 AND days / greatest(span, 1) >= 0.6 THEN 'periodic-daily'
    WHEN span >= 14 AND busy <= 2 AND n >= 4 THEN 'periodic-weekly' ELSE 'sporadic' END AS periodicity FROM v JOIN p USING ({key}) JOIN k USING ({key})"""


@query(S.ctes("occ") + _activity_sql("occ", "fingerprint", _NOW_SEC))
def peak_activity(spark, d):
    """W12, W13."""
    o = _occurrences(spark, d)
    return o.select("fingerprint", G.activity(F.col("times"), F.col("last_seen"), F.lit(_NOW).cast("timestamp")).alias("activity"), G.periodicity(F.col("times")).alias("periodicity"))


@query(S.ctes("occ") + ", m AS (SELECT fingerprint, max(w) AS last FROM occ GROUP BY 1) SELECT fingerprint FROM m WHERE last >= (SELECT max(last) FROM m) - 10 * 86400")
def retained_rows(spark, d):
    """Seen within ten days of the newest row."""
    return G.retained(_occurrences(spark, d), 10).select("fingerprint")


# --- registry ---

S.TABLES["rkeyed"] = "SELECT *, upper(category) || ':' || rflow || ':' || rclass AS registry_key FROM (SELECT *, " + S.case(
    ((f"contains(lower(array_to_string(apps_ranked, ' ')), {S.quoted(p)})", S.quoted(f)) for p, f in rules.REGISTRY_FLOWS),
    Q.RFLOW_SQL[Q.RFLOW_SQL.rindex("ELSE coalesce") + 5 : -4].replace("lower(app_name)", "lower(app_name)"),
) + f" AS rflow, {Q.RCLASS_SQL} AS rclass FROM incx)"
S.NEEDS["rkeyed"] = ["incx"]


def registry(spark: SparkSession, d: str) -> DataFrame:
    """The registry after two runs, one with each half of the incidents."""
    found = D.incidents(spark, d)
    half = F.substring("fingerprint", 2, 1).between("0", "7")
    empty = spark.createDataFrame([], G.problem_updates(found).schema)
    return G.upsert(G.upsert(empty, G.problem_updates(found.filter(half))), G.problem_updates(found.filter(~half)))


@query(S.ctes("rkeyed") + """ SELECT registry_key, min(category) AS category, min(first_us) AS first_us, max(last_us) AS last_us, array_to_string(list_sort(list_distinct(flatten(list(apps)))), ',') AS apps,
    CAST(len(list_distinct(flatten(list(namespaces)))) AS INT) AS namespaces, CAST(count(DISTINCT fingerprint) AS INT) AS fingerprints FROM rkeyed GROUP BY registry_key""")
def problem_registry(spark, d):
    """Registry state after two runs."""
    return registry(spark, d).select("registry_key", "category", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), F.array_join("apps", ",").alias("apps"), F.size("namespaces").alias("namespaces"), F.size("fingerprints").alias("fingerprints"))


@query(S.ctes("rkeyed") + """, p AS (SELECT 'PEAK:' || category || ':' || rflow || ':' || CASE WHEN is_spike THEN 'spike' ELSE 'burst' END AS peak_key, * FROM rkeyed WHERE is_spike OR is_burst)
    SELECT peak_key, CAST(sum(total) AS BIGINT) AS raw_count, min(first_us) AS first_us, count(DISTINCT registry_key) AS problems FROM p GROUP BY peak_key""")
def peak_registry(spark, d):
    """X34."""
    p = G.peak_updates(D.incidents(spark, d))
    return p.select("peak_key", "raw_count", F.unix_micros("first_seen").alias("first_us"), F.size("contributing").cast("long").alias("problems"))


@query(S.ctes("rkeyed") + """, p AS (SELECT 'PEAK:' || category || ':' || rflow || ':' || CASE WHEN is_spike THEN 'spike' ELSE 'burst' END AS peak_key, registry_key, CAST(sum(total) AS BIGINT) AS n FROM rkeyed WHERE is_spike OR is_burst GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY peak_key ORDER BY n DESC, registry_key) AS rank FROM p) SELECT peak_key, registry_key, n, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3""")
def contributing_problems(spark, d):
    """J25."""
    found = D.incidents(spark, d)
    return G.contributing_problems(G.peak_updates(found), G.problem_updates(found)).select("peak_key", "registry_key", "n", "rank")


@query(S.ctes("rkeyed") + """, q AS (SELECT registry_key, min(rflow) AS flow, list_distinct(flatten(list(namespaces))) AS ns, list_distinct(flatten(list(apps))) AS ap, sum(total) AS occ, max(last_us) AS last FROM rkeyed GROUP BY 1),
    p AS (SELECT 'PEAK:' || category || ':' || rflow || ':' || CASE WHEN is_spike THEN 'spike' ELSE 'burst' END AS peak_key, min(rflow) AS flow, list_distinct(flatten(list(namespaces))) AS ns, list_distinct(flatten(list(apps))) AS ap FROM rkeyed WHERE is_spike OR is_burst GROUP BY 1)
    SELECT peak_key, arg_max(registry_key, (len(list_intersect(p.ns, q.ns)), len(list_intersect(p.ap, q.ap)), occ, last, registry_key)) AS registry_key FROM p JOIN q USING (flow) WHERE len(list_intersect(p.ns, q.ns)) > 0 GROUP BY peak_key""")
def related_problems(spark, d):
    """J20."""
    found = D.incidents(spark, d)
    flow = F.split("registry_key", ":")[1].alias("flow")
    total = F.aggregate("times", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("occurrences")
    problems = G.problem_updates(found).select("registry_key", flow, "namespaces", "apps", total, "last_seen")
    peak_rows = G.peak_updates(found).withColumn("flow", F.split("peak_key", ":")[2])
    return G.related_problem(peak_rows, problems)


@query(S.ctes("rkeyed") + """, r AS (SELECT registry_key, count(DISTINCT fingerprint) AS f, max(last_us) AS last FROM rkeyed GROUP BY 1) SELECT count(*) AS problems, CAST(sum(f) AS BIGINT) AS fingerprints, CAST(min(f) AS INT) AS min_fingerprints,
    CAST(max(f) AS INT) AS max_fingerprints, round(avg(f), 6) AS avg_fingerprints, count(*) FILTER (last >= 1706486400000000) AS active_day FROM r""")
def registry_health(spark, d):
    """A51, A52."""
    return G.health(registry(spark, d), "2024-01-30").select("problems", "fingerprints", "min_fingerprints", "max_fingerprints", R("avg_fingerprints").alias("avg_fingerprints"), "active_day")


_LATE, _LATE_SEC = "2024-01-30", 1706572800


def _trend_sql(c: str, base: str, label: str) -> str:
    pct = f"(({c} - {base}) / {base} * 100)"
    whole = f"CAST(CAST(abs(round_even({pct}, 0)) AS BIGINT) AS VARCHAR)"
    return f"""CASE WHEN {base} = 0 AND {c} = 0 THEN '{label}: → 0' WHEN {base} = 0 THEN '{label}: ↑ ' || CAST({c} AS BIGINT) WHEN abs({pct}) >= 200 THEN '{label}: ' || CASE WHEN {pct} > 0 THEN '↑ +' ELSE '↓ -' END || '200%' || CASE WHEN abs({pct}) > 200 THEN '+' ELSE '' END
        ELSE '{label}: → ' || CASE WHEN {pct} >= 0 THEN '+' ELSE '-' END || {whole} || '%' END"""


_MEAN = lambda length, slots: "coalesce(list_avg(list_filter([" + ", ".join(_IN(i * length, (i + 1) * length, _LATE_SEC) for i in range(1, slots + 1)) + "], lambda x: x > 0)), 0)"
_LOWER = {"critical": "high", "high": "medium", "medium": "low", "low": "low"}
# A minute that both runs have keeps the count of the second one
S.TABLES["ktimes"] = """SELECT registry_key, m AS w, arg_max(n, run) AS n FROM (SELECT registry_key, last_us // 60000000 * 60 AS m, fingerprint[2] NOT BETWEEN '0' AND '7' AS run, CAST(sum(total) AS BIGINT) AS n FROM rkeyed GROUP BY ALL) GROUP BY ALL"""
S.NEEDS["ktimes"] = ["rkeyed"]


@query(S.ctes("ktimes") + f""", t AS (SELECT registry_key, sum(n) AS occ, {_IN(0, 7200, _LATE_SEC)} AS c2, {_IN(0, 86400, _LATE_SEC)} AS c24, {_MEAN(7200, 5)} AS b2, {_MEAN(86400, 6)} AS b24 FROM ktimes GROUP BY 1),
    k AS (SELECT registry_key, min(category) AS category, min(first_us) AS first_us, max(last_us) AS last_us, list_distinct(flatten(list(namespaces))) AS ns, len(list_distinct(flatten(list(apps)))) AS apps FROM rkeyed GROUP BY 1),
    s AS (SELECT *, CASE WHEN len(ns) >= 4 OR apps >= 8 THEN 'SYSTEMIC' WHEN len(ns) >= 2 THEN 'CROSS_NS' ELSE 'LOCAL' END AS scope FROM k WHERE last_us >= (SELECT max(last_us) FROM k) - 30 * 86400000000),
    l AS (SELECT *, {S.case(((f"scope = {S.quoted(a)}", S.quoted(b)) for a, b in rules.SCOPE_SEVERITY.items()), f"CASE WHEN lower(category) IN ({', '.join(map(S.quoted, rules.BOOSTED_CATEGORIES))}) THEN 'medium' ELSE 'low' END")} AS level,
    len(ns) > 0 AND len(list_filter(ns, lambda x: NOT {S.has_any('x', rules.NON_PROD)})) = 0 AS inner_only FROM s)
    SELECT registry_key, category, CAST(occ AS BIGINT) AS occurrence_total, CAST(c2 AS BIGINT) AS current_2h, CAST(c24 AS BIGINT) AS current_24h, {_trend_sql('c2', 'b2', '2h')} AS trend_2h, {_trend_sql('c24', 'b24', '24h')} AS trend_24h, scope,
    CASE WHEN inner_only THEN {S.case(((f"level = {S.quoted(a)}", S.quoted(b)) for a, b in _LOWER.items()), "level")} ELSE level END AS severity,
    CASE WHEN c24 <= 0 THEN 0 ELSE round_even(least(100.0::DOUBLE, log10(c24::DOUBLE) / 3 * 100), 1) END AS score, first_us, last_us FROM l JOIN t USING (registry_key)""")
def errors_table(spark, d):
    """K4, M15, M27, S26."""
    t = G.errors_table(registry(spark, d), _LATE)
    return t.withColumns({"first_us": F.unix_micros("first_seen"), "last_us": F.unix_micros("last_seen")}).drop("first_seen", "last_seen")


S.TABLES["pkeyed"] = """SELECT 'PEAK:' || category || ':' || rflow || ':' || CASE WHEN is_spike THEN 'spike' ELSE 'burst' END AS peak_key, r.*, o.value AS peak_value FROM rkeyed r LEFT JOIN owned o ON o.owner = r.fingerprint WHERE is_spike OR is_burst"""
S.TABLES["pocc"] = "SELECT peak_key, last_us // 900000000 * 900 AS w, CAST(sum(total) AS BIGINT) AS n FROM pkeyed GROUP BY ALL"
S.NEEDS.update({"pkeyed": ["rkeyed", "owned"], "pocc": ["pkeyed"]})


@query(S.ctes("pocc") + ", act AS (SELECT * FROM (" + S.ctes("pocc") + _activity_sql("pocc", "peak_key", _LATE_SEC) + """)), q AS (SELECT peak_key, CAST(sum(total) AS BIGINT) AS raw_count, CAST(max(coalesce(peak_value, total)) AS BIGINT) AS max_value, round(max(ratio), 2) AS max_ratio,
    min(first_us) AS first_us, max(last_us) AS last_us FROM pkeyed GROUP BY 1)
    SELECT peak_key, raw_count, max_value, max_ratio, CASE WHEN last_us < (1706572800 - 604800) * 1000000::BIGINT THEN 'inactive' ELSE activity END AS activity, periodicity, first_us, last_us FROM q JOIN act USING (peak_key) WHERE last_us >= (SELECT max(last_us) FROM q) - 30 * 86400000000""")
def peaks_table(spark, d):
    """K5."""
    t = G.peaks_table(G.peak_updates(D.incidents(spark, d)), _LATE)
    return t.withColumns({"first_us": F.unix_micros("first_seen"), "last_us": F.unix_micros("last_seen")}).drop("first_seen", "last_seen")


@query(S.ctes("rec") + """, c AS (SELECT fingerprint, coalesce(originator, '') AS k, count(*) AS n FROM rec GROUP BY ALL), t AS (SELECT fingerprint, sum(n) AS total FROM c GROUP BY 1), o AS (SELECT * FROM c WHERE k <> ''),
    d AS (SELECT fingerprint, arg_max(k, (n, k)) AS top, max(n) AS n, string_agg(k || ' (' || n || ')', ', ' ORDER BY n DESC, k) AS shown FROM o GROUP BY 1)
    SELECT fingerprint, top, shown, lower(top) = 'mochaxtestapp' AND d.n / total >= 0.5 AS is_test FROM d JOIN t USING (fingerprint)""")
def originators(spark, d):
    """Dominant originators and test traffic."""
    r = Q.records(spark, d)
    total = r.groupBy("fingerprint").agg(F.count("*").alias("total"))
    c = measure.ranked_counter(r, "originator").select("fingerprint", F.map_from_entries("originator").alias("m")).join(total, "fingerprint")
    return c.select("fingerprint", V.dominant(F.col("m"))["key"].alias("top"), V.counts_text(F.col("m"), 5).alias("shown"), V.is_test_traffic(F.col("m"), F.col("total")).alias("is_test"))


# --- alerts ---

_ALERT = """SELECT event_id AS id, 'p' || event_id AS peak_key, event_id % 13 = 0 AS is_test, event_id % 5 <> 0 AS is_known, 'w' || event_id % 9 AS window_key, CASE event_id % 4 WHEN 0 THEN 'rising' WHEN 1 THEN 'stable' ELSE '' END AS trend, event_id % 40 AS error_count,
    event_id % 17 = 0 AS wider, event_id % 3 <> 0 AS has_state, 'w' || user_id % 9 AS s_window, CASE user_id % 6 WHEN 0 THEN 'falling' WHEN 1 THEN 'stable' ELSE '' END AS s_trend, CASE WHEN user_id % 2 = 0 THEN event_id % 40 ELSE user_id % 40 END AS s_count, user_id % 200 AS minutes FROM events"""


@query(f"""WITH a AS ({_ALERT}), b AS (SELECT *, abs(error_count - s_count) / greatest(s_count, 1) * 100.0 AS delta FROM a), r AS (SELECT id, CASE WHEN is_test THEN 'test_peak_suppressed:load' WHEN NOT has_state THEN 'first_seen_in_state' WHEN NOT is_known THEN 'new_peak'
    WHEN s_window = window_key THEN 'same_window_duplicate' WHEN trend <> '' AND s_trend <> '' AND trend <> s_trend THEN 'trend_changed' WHEN error_count > 0 AND s_count > 0 AND delta >= 30 THEN 'count_delta_pct'
    WHEN wider THEN 'scope_changed' WHEN minutes < 45 THEN 'cooldown_active' WHEN minutes >= 120 THEN 'heartbeat' ELSE 'no_material_change' END AS reason FROM b)
    SELECT id, reason, reason IN ('first_seen_in_state', 'new_peak', 'trend_changed', 'count_delta_pct', 'scope_changed', 'heartbeat') AS send FROM r""")
def alert_decisions(spark, d):
    """X30, R8."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumnRenamed("ts", "event_ts")
    i, u = F.col("event_id"), F.col("user_id")
    now = "2024-02-01 00:00:00"
    key = F.concat(F.lit("p"), i)
    some = F.when(i % 17 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    pay = e.select(i.alias("id"), key.alias("peak_key"), (i % 13 == 0).alias("is_test"), F.lit("load").alias("test_originator"), (i % 5 != 0).alias("is_known"), F.concat(F.lit("w"), i % 9).alias("window_key"),
                   F.when(i % 4 == 0, "rising").when(i % 4 == 1, "stable").otherwise("").alias("trend"), (i % 40).alias("error_count"), some.alias("new_apps"), F.array().cast("array<string>").alias("new_namespaces"))
    sent = F.timestamp_seconds(F.unix_seconds(F.lit(now).cast("timestamp")) - u % 200 * 60)
    state = e.filter(i % 3 != 0).select(key.alias("peak_key"), sent.alias("s_sent_at"), F.concat(F.lit("w"), u % 9).alias("s_window"), F.when(u % 6 == 0, "falling").when(u % 6 == 1, "stable").otherwise("").alias("s_trend"),
                                        F.when(u % 2 == 0, i % 40).otherwise(u % 40).alias("s_count"), (sent + F.expr("INTERVAL 45 MINUTES")).alias("s_cooldown_until"))
    return A.decided(pay, state, now).select("id", F.regexp_replace("reason", r"delta_[\d.]+_", "delta_").alias("reason"), "send")


def alert_problems(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = P.peaks_of(B.rolled(spark, d))
    traces = B.keyed(spark, d).select("problem_key", "fingerprint").join(B.traces_of(spark, d), "fingerprint")
    return rows, traces.join(rows.select("problem_key"), "problem_key", "left_semi")


_TOKENS = f"list_filter(regexp_extract_all(lower({B._TRACE}), '[a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains([{', '.join(map(S.quoted, rules.CAUSE_STOP_WORDS))}], w))"
S.TABLES.update({
    "ap": "SELECT * FROM prob WHERE has_spike OR has_burst", "ap_traces": "SELECT DISTINCT problem_key, trace_id FROM ptr SEMI JOIN ap USING (problem_key)", "ap_sizes": "SELECT problem_key, count(*) AS n FROM ap_traces GROUP BY problem_key",
    "ap_overlaps": """SELECT x.problem_key AS a, y.problem_key AS b FROM ap_traces x JOIN ap_traces y ON x.trace_id = y.trace_id AND x.problem_key < y.problem_key JOIN ap_sizes p ON p.problem_key = x.problem_key JOIN ap_sizes q ON q.problem_key = y.problem_key
        GROUP BY ALL HAVING count(*) / least(min(p.n), min(q.n)) >= 0.5""",
    "ap_said": f"""SELECT *, {Q.useful_sql('message')} AS u FROM (SELECT problem_key, message FROM ap UNION SELECT problem_key, sample_message FROM
        (SELECT problem_key, sample_message, row_number() OVER (PARTITION BY problem_key ORDER BY first_seq, sample_message) AS r FROM keyed SEMI JOIN ap USING (problem_key)) WHERE r <= 5) WHERE message IS NOT NULL""",
    "ap_tokens": f"SELECT problem_key, {_TOKENS} AS t FROM (SELECT problem_key, CASE WHEN u <> '' THEN u ELSE message END AS x FROM ap_said)",
    "ap_runs": "SELECT DISTINCT problem_key, array_to_string(t[i : i + 4], ' ') AS run FROM (SELECT problem_key, t, unnest(range(1, len(t) - 3)) AS i FROM ap_tokens WHERE len(t) >= 5)",
    "ap_same": """SELECT DISTINCT x.problem_key AS a, y.problem_key AS b FROM ap_runs x JOIN ap_runs y ON x.run = y.run AND x.problem_key < y.problem_key JOIN ap p ON p.problem_key = x.problem_key JOIN ap q ON q.problem_key = y.problem_key
        WHERE p.total_occurrences = q.total_occurrences AND list_has_any(p.apps, q.apps) AND list_has_any(p.namespaces, q.namespaces)""",
    "ap_links": "SELECT a, b FROM ap_overlaps UNION SELECT b, a FROM ap_overlaps UNION SELECT a, b FROM ap_same UNION SELECT b, a FROM ap_same",
    "ap_reached": "SELECT problem_key AS n, problem_key AS m FROM ap UNION SELECT r.n, l.b FROM ap_reached r JOIN ap_links l ON l.a = r.m", "ap_clusters": "SELECT n AS problem_key, min(m) AS cluster FROM ap_reached GROUP BY n",
    "ap_ranked": "SELECT problem_key, cluster, row_number() OVER (PARTITION BY cluster ORDER BY max_score DESC, total_occurrences DESC, problem_key) AS rank FROM ap_clusters JOIN ap USING (problem_key)",
    "ap_named": """SELECT r.problem_key, r.cluster, f.problem_key AS "primary", CAST(r.rank AS INT) AS rank, r.rank = 1 OR l.a IS NOT NULL AS same FROM ap_ranked r JOIN ap_ranked f ON f.cluster = r.cluster AND f.rank = 1
        LEFT JOIN ap_links l ON l.a = f.problem_key AND l.b = r.problem_key""",
})
S.NEEDS.update({
    "ap": ["prob"], "ap_traces": ["ptr", "ap"], "ap_sizes": ["ap_traces"], "ap_overlaps": ["ap_sizes"], "ap_said": ["ap"], "ap_tokens": ["ap_said"], "ap_runs": ["ap_tokens"], "ap_same": ["ap_runs"], "ap_links": ["ap_overlaps", "ap_same"],
    "ap_reached": ["ap_links"], "ap_clusters": ["ap_reached"], "ap_ranked": ["ap_clusters"], "ap_named": ["ap_ranked"],
})


@query(S.ctes("ap_named").replace("WITH", "WITH RECURSIVE", 1) + " SELECT * FROM ap_named")
def alert_clusters(spark, d):
    """Clusters of problems; checked against union-find in the tests as well."""
    return A.clusters(*alert_problems(spark, d))


_PAYLOAD_SEC = 1706616000  # 2024-01-30 12:00:00
_SET = lambda c: f"list_sort(list_distinct(flatten(list({c}))))"
_NOT_IN = lambda c, k: f"array_to_string(list_filter({c}, lambda x: NOT list_contains(coalesce({k}, []), x)), ',')"


@query(
    S.ctes("ap_named", "rkeyed").replace("WITH", "WITH RECURSIVE", 1) + f""", pl AS (SELECT cluster, min("primary") AS "primary", count(*) AS cluster_size, CAST(coalesce(max(total_occurrences) FILTER (same), 0) + coalesce(sum(total_occurrences) FILTER (NOT same), 0) AS BIGINT) AS error_count,
    {_SET('apps')} AS apps, {_SET('namespaces')} AS namespaces, bool_or(has_spike) AS has_spike FROM ap_named JOIN ap USING (problem_key) GROUP BY cluster),
    pk AS (SELECT pl.*, f.category, f.flow, f.error_class, 'PEAK:' || f.category || ':' || f.flow || ':' || CASE WHEN pl.has_spike THEN 'spike' ELSE 'burst' END AS peak_key FROM pl JOIN ap f ON f.problem_key = pl."primary"),
    k AS (SELECT 'PEAK:' || category || ':' || rflow || ':' || CASE WHEN is_spike THEN 'spike' ELSE 'burst' END AS peak_key, {_SET('apps')} AS k_apps, {_SET('namespaces')} AS k_ns, sum(total) / 2.0 AS k_mean, max(last_us) >= {(_PAYLOAD_SEC - 3600) * 1_000_000} AS goes_on
        FROM rkeyed WHERE is_spike OR is_burst GROUP BY 1), j AS (SELECT pk.*, k_apps, k_ns, coalesce(goes_on, false) AS continues, error_count / k_mean AS r FROM pk LEFT JOIN k ON k.peak_key = pk.peak_key)
    SELECT cluster, "primary", cluster_size, error_count, has_spike, category, flow, error_class, peak_key, array_to_string(apps, ',') AS apps, array_to_string(namespaces, ',') AS namespaces, k_apps IS NOT NULL AS is_known, continues,
    {_NOT_IN('apps', 'k_apps')} AS new_apps, {_NOT_IN('namespaces', 'k_ns')} AS new_namespaces, CASE WHEN NOT continues OR r IS NULL OR r >= 1.2 THEN 'rising' WHEN r <= 0.8 THEN 'falling' ELSE 'stable' END AS trend FROM j"""
)
def alert_payloads(spark, d):
    """Payloads of clusters against known peaks."""
    rows, traces = alert_problems(spark, d)
    known = G.peak_updates(D.incidents(spark, d)).select("peak_key", "apps", "namespaces", (F.col("raw_count") / 2).alias("mean_count"), "last_seen")
    out = A.with_known(A.payloads(rows, A.clusters(rows, traces)), known, "2024-01-30 12:00:00")
    joined = lambda c: F.array_join(c, ",").alias(c)
    return out.select("cluster", "primary", "cluster_size", "error_count", "has_spike", "category", "flow", "error_class", "peak_key", joined("apps"), joined("namespaces"), "is_known", "continues", joined("new_apps"), joined("new_namespaces"), "trend")


@query(S.ctes("facts") + """, n AS (SELECT fingerprint AS key, namespace, CAST(sum(n) AS BIGINT) AS n FROM facts GROUP BY ALL), t AS (SELECT *, greatest(5, sum(n) OVER (PARTITION BY key) * 0.01) AS l, row_number() OVER (PARTITION BY key ORDER BY n DESC, namespace) AS r FROM n),
    u AS (SELECT *, bool_or(n >= l) OVER (PARTITION BY key) AS any_big FROM t) SELECT key, namespace, n FROM u WHERE n >= l OR (NOT any_big AND r = 1)""")
def shown_namespaces(spark, d):
    """P10."""
    n = Q.facts(spark, d).groupBy(F.col("fingerprint").alias("key"), "namespace").agg(F.sum("error_count").alias("n"))
    return A.shown_namespaces(n, 5)
