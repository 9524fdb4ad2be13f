"""Operators that SQL does not express, against loops; and semantics on hand-made rows."""

from __future__ import annotations

from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberlog import rules
from emberlog.functions import text as X
from emberlog.functions import values as V
from emberlog.operators import alerts, analysis, incidents, ledger, measure, peaks, problems, registry, traces
from emberlog.operators.parse import parse
from emberlog.plans import logs as Q
from emberlog.plans import problems as B
from emberlog.plans import reports as Z
from emberlog.plans import state as ST
from emberlog.sources import logs as L
from emberlog.sources import tables

T0 = datetime(2026, 1, 20, 8)


def log_rows(spark, rows):
    """Log rows from (seconds, namespace, app, message, version) tuples."""
    data = [(T0 + timedelta(seconds=s), i, "ERROR", ns, app, v, f"t{i % 3}", f"s{i}", None, None, None, None, None, m) for i, (s, ns, app, m, v) in enumerate(rows)]
    return spark.createDataFrame(data, "ts timestamp, seq long, level string, namespace string, app_name string, app_version string, trace_id string, span_id string, parent_span_id string, originator string, exception_type string, http_status int, stack_trace string, message string")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_namespace_total_is_one_peak(spark):
    rows = parse(log_rows(spark, [(i, "ns-a", "app", f"Fail number {chr(65 + i % 10)}{chr(75 + i % 10)}x happened", "1.0.0") for i in range(100)]))
    thr = spark.createDataFrame([("ns-a", d, 50.0, 100) for d in range(7)], "namespace string, dow int, p93 double, samples long")
    cap = spark.createDataFrame([("ns-a", 250.0)], "namespace string, cap double")
    found = peaks.namespace_peaks(measure.facts(rows), thr, cap).collect()
    assert [(r["value"], r["triggered_by"], r["contributors"]) for r in found] == [(100, "p93", 10)]


def test_regression_uses_highest_version(spark):
    rows = parse(log_rows(spark, [(0, "n", "a", "Boom happened", "2.8.0"), (5, "n", "a", "Boom happened", "2.10.0")]))
    fixes = rows.select("fingerprint").distinct().withColumn("fixed_in", F.lit("2.9.0"))
    r = incidents.detect(rows, fixes=fixes).first()
    assert r["is_regression"] and r["latest_version"] == "2.10.0"
    assert any("2.10.0" in e["message"] for e in r["evidence"] if e["rule"] == "regression")


def test_burst_counts_equal_a_loop(spark):
    secs = [0, 0, 0, 1, 30, 59, 60, 60, 61, 119, 120, 121, 400, 400, 459, 460, 461, 3000]
    rows = parse(log_rows(spark, [(s, "n", "a", "Same thing", "1.0.0") for s in secs]))
    counts, start = [], 0
    for i, s in enumerate(secs):
        while secs[start] < s - 60:
            start += 1
        counts.append(i - start + 1)
    got = [r["in_window"] for r in measure.trailing_counts(rows, 60).orderBy("seq").collect()]
    assert got == counts
    b = measure.bursts(rows).first()
    assert (b["max_count"], round(b["avg_count"], 9)) == (max(counts), round(sum(counts) / len(counts), 9))


def test_measure_with_history(spark):
    rows = parse(log_rows(spark, [(0, "n", "a", "Same thing", "1.0.0"), (1000, "n", "a", "Same thing", "1.0.0"), (1001, "n", "a", "Same thing", "1.0.0"), (4000, "n", "a", "Other thing", "1.0.0")]))
    fp = rows.filter("normalized_message = 'Same thing'").first()["fingerprint"]
    hist = spark.createDataFrame([(fp, [4.0, 0.0, 6.0])], "fingerprint string, rates array<double>")
    r = measure.measure(rows, hist).filter(F.col("fingerprint") == fp).first()
    values = [4.0, 0.0, 6.0, 1.0, 2.0, 0.0, 0.0]
    e = values[0]
    for v in values[1:]:
        e = 0.3 * v + 0.7 * e
    assert r["baseline_ewma"] == pytest.approx(e) and r["sample_count"] == 7
    m = sorted(values)[3]
    assert r["baseline_median"] == m and r["baseline_mad"] == sorted(abs(v - m) for v in values)[3]


def test_silence_needs_a_baseline(spark):
    rows = parse(log_rows(spark, [(i * 5, "n", "a", "Often", "1.0.0") for i in range(170)] + [(2000, "n", "a", "Rare", "1.0.0")]))
    r = {x["normalized_message"]: x["is_silence"] for x in incidents.detect(rows).collect()}
    assert r == {"Often": True, "Rare": False}


def test_replaced_series_equals_a_loop(spark, data):
    got = {(r["namespace"], r["window_start"]): (r["is_peak"], r["replacement"]) for r in Q.replaced_series(spark, data).collect()}
    series = defaultdict(dict)
    for r in Q.dense(spark, data).collect():
        series[r["namespace"], r["window_start"].date()][int(r["window_start"].timestamp())] = float(r["error_count"])
    for (ns, _), values in series.items():
        done = {}
        for t in sorted(values):
            v, refs = values[t], [done[t - 900 * k] for k in range(1, 6) if t - 900 * k in done]
            if not refs:
                peak, new = v > 6, v
            else:
                ref = sum(refs) / len(refs)
                peak = v > 6 or ref <= 0 or v / ref >= 3
                new = ref if peak else v
            done[t] = new
            assert got[ns, t] == (peak, pytest.approx(new, abs=1e-5))


def test_incident_groups_equal_a_loop(spark, data):
    ev = Z.events(spark, data).drop("group_id")
    got = {r["event_id"]: r["group_id"] for r in Z.incident_groups(spark, data).collect()}
    rows = sorted((r.asDict() for r in ev.collect()), key=lambda r: (r["ts"], r["event_id"]))
    base = lambda r: r["fingerprint"].rsplit("-", 1)[0]
    used, expected = set(), {}
    for i, e in enumerate(rows):
        if i in used:
            continue
        used.add(i)
        group = [e]
        for j, o in enumerate(rows):
            gap = abs((e["ts"] - o["ts"]).total_seconds())
            if j in used or gap > 900:
                continue
            if base(e) == base(o) or e["app"] == o["app"] or (gap <= 300 and (e["category"] == o["category"] or e["is_cross_namespace"] or o["is_cross_namespace"])):
                used.add(j)
                group.append(o)
        important = e["is_spike"] or e["is_burst"] or e["is_cross_namespace"] or e["severity"] in ("critical", "high") or e["ratio"] >= 5
        if len(group) >= 2 or important:
            expected.update({o["event_id"]: e["event_id"] for o in group})
    assert got == expected


def test_overlaps_of_whole_tables(spark, data):
    """All orders in both roles, against a loop; no key of the join holds more than a day of a namespace."""
    o = spark.read.parquet(f"{data}/orders.parquet").select((F.col("o_custkey") % 50).alias("namespace"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("start"), F.col("o_orderkey").alias("id"))
    a, b = (o.withColumn("end", F.col("start") + 86400 * d).withColumnRenamed("id", f"{n}_id") for n, d in (("a", 3), ("b", 2)))
    spaces = defaultdict(list)
    for r in o.collect():
        spaces[r["namespace"]].append((r["start"], r["id"]))
    expected = sorted((i, j) for rows in spaces.values() for s, i in rows for t, j in rows if s < t + 86400 * 2 and t < s + 86400 * 3)
    found = analysis.overlapping(a, b)
    assert set(found.columns) == {"namespace", "a_start", "a_end", "a_id", "b_start", "b_end", "b_id"}
    assert sorted((r["a_id"], r["b_id"]) for r in found.collect()) == expected
    keys = [x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in x]
    assert keys and all("_cell" in k for k in keys)


def test_overlaps_are_dealt_by_windows(spark, monkeypatch):
    """As many tasks as windows ask for, however few bytes they have; windows of all lengths, empty ones and ends on a cell's edge, against a loop."""
    monkeypatch.setattr(analysis, "PAIR_ROWS", 20, raising=False)
    a = [(i % 3, 10 * (i * 37 % 50), 10 * (i * 37 % 50) + (i * 7 % 9) * 10 - 10, i) for i in range(300)]
    b = [(i % 3, 10 * (i * 53 % 50), 10 * (i * 53 % 50) + (i * 5 % 7) * 20, i) for i in range(200)]
    frames = [spark.createDataFrame(rows, f"namespace long, start long, end long, {n}_id long") for rows, n in ((a, "a"), (b, "b"))]
    found = analysis.overlapping(*frames, cell_sec=50)
    expected = sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    assert sorted((r["a_id"], r["b_id"]) for r in found.collect()) == expected
    assert found.rdd.getNumPartitions() >= 25


def _stages(spark):
    """(id, rows shuffled) of the stages that have run."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()
    store = context._jsc.sc().statusStore()
    found = store.stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), getattr(store, "stageList$default$5")())
    return [(found.apply(i).stageId(), found.apply(i).shuffleWriteRecords()) for i in range(found.size())]


def test_overlaps_shuffle_a_window_once_for_both_roles(spark, data):
    """Orders last two and three days here; they met five cells of a day, in a shuffle for each role."""
    before = max((i for i, _ in _stages(spark)), default=-1)
    Z.overlapping_windows(spark, data).write.format("noop").mode("overwrite").save()
    moved = sum(n for i, n in _stages(spark) if i > before)
    orders = spark.read.parquet(f"{data}/orders.parquet").count()
    assert orders < moved <= 2 * orders + 100


def test_overlaps_of_windows_in_two_roles(spark):
    """Windows of all lengths, empty ones, ends before starts and on a cell's edge, missing values, against a loop."""
    rows = [(i % 3 if i % 41 else None, 10 * (i * 37 % 50) if i % 43 else None, i, (i * 7 % 9) * 10 - 10 if i % 47 else None, (i * 5 % 7) * 20 - 20) for i in range(300)]
    frame = spark.createDataFrame(rows, "namespace long, start long, id long, x long, y long")
    found = analysis.overlapping_roles(frame, F.col("start") + F.col("x"), F.col("start") + F.col("y"), cell_sec=50)
    assert set(found.columns) == {"namespace", "a_start", "a_end", "a_id", "a_x", "a_y", "b_start", "b_end", "b_id", "b_x", "b_y"}
    a = [(n, s, s + x, i) for n, s, i, x, _ in rows if None not in (n, s, x)]
    b = [(n, s, s + y, i) for n, s, i, _, y in rows if None not in (n, s)]
    expected = sorted((*v, *w[1:]) for v in a for w in b if v[0] == w[0] and v[1] < w[2] and w[1] < v[2])
    assert sorted(tuple(r[c] for c in ("namespace", "a_start", "a_end", "a_id", "b_start", "b_end", "b_id")) for r in found.collect()) == expected


def test_events_are_dealt_out_as_stored(spark, data, monkeypatch):
    """The scan shuffles the table's own columns; the log view's texts are made by the tasks that parse them."""
    seen, spread = [], Q.spread
    monkeypatch.setattr(Q, "spread", lambda df: seen.append(df.columns) or spread(df))
    monkeypatch.setattr(tables, "_made", {})
    n = Q.records(spark, data).count()
    assert seen == [spark.read.parquet(f"{data}/events.parquet").columns]
    assert n == Q.errors(spark, data).count()


def test_sets_of_a_problem_are_made_of_distinct_values(spark, data):
    """No row holds the arrays of all incidents; arrays that are missing or empty add nothing."""
    rows = [("p", ["b", "a"], ["n"], ["2"]), ("p", ["c", "a"], None, []), ("p", None, ["m"], []), ("q", [], [], None)]
    found = spark.createDataFrame(rows, "problem_key string, apps array<string>, namespaces array<string>, versions array<string>")
    got = {r[0]: tuple(r[1:]) for r in problems._unions(found, ("apps", "namespaces", "versions")).collect()}
    assert got == {"p": (["a", "b", "c"], ["m", "n"], ["2"])}
    made = problems.problems(B.keyed(spark, data))
    assert "flatten" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert made.filter("apps is null or namespaces is null or versions is null").isEmpty()


@pytest.mark.parametrize(("step", "kinds"), [(7, (3, 5, 4)), (20, (40, 30, 1000)), (0.5, (6, 1000, 1000))])
def test_groups_of_a_steady_log(spark, monkeypatch, step, kinds):
    """No silence ends a run here: the log must still be folded in parts of bounded size, with the same groups as in one loop."""
    monkeypatch.setattr(analysis, "CHUNK_ROWS", 100)
    apps, bases, categories = kinds
    rows = [(i, T0 + timedelta(seconds=i * step), f"a{i * 7919 % 1009 % apps}", f"f{i * 104729 % 2003 % bases}-x", f"c{i * 1299709 % 3001 % categories}", "low", 1.0, False, False, i % 211 == 0) for i in range(3000)]
    ev = spark.createDataFrame(rows, "event_id long, ts timestamp, app string, fingerprint string, category string, severity string, ratio double, is_spike boolean, is_burst boolean, is_cross_namespace boolean")
    first, expected = [], {}
    for i, t, app, f, c, *_, wide in rows:
        near = lambda o: (t - o[1]).total_seconds() <= 900 and (o[2] == app or o[3] == f or ((t - o[1]).total_seconds() <= 300 and (o[4] == c or wide or o[-1])))
        lead = next((o for o in first if near(o)), None)
        if lead is None:
            lead = rows[i]
            first.append(lead)
        expected[i] = lead[0]
    sizes = defaultdict(int)
    for g in expected.values():
        sizes[g] += 1
    expected = {i: g for i, g in expected.items() if sizes[g] > 1 or rows[g][-1]}
    assert {r["event_id"]: r["group_id"] for r in analysis.group_events(ev).collect()} == expected
    keyed = analysis._keyed(ev)
    largest = keyed.groupBy("chunk").count().agg(F.max("count")).first()[0]
    assert largest < 300 and analysis._starts(keyed)[1] <= 6


@pytest.mark.parametrize("gap", [0, 2000])
def test_groups_are_folded_in_spans_of_bounded_size(spark, monkeypatch, gap):
    """What one task puts in order is a row per chunk, and no more chunks than its share of events: with the same starts as in spans that grow to the whole log."""
    rows = [(i, T0 + timedelta(seconds=i * 0.5 + gap * (i // 900)), f"a{i * 7919 % 1009 % 6}", f"f{i * 104729 % 2003 % 500}-x", f"c{i * 1299709 % 3001 % 300}", "low", 1.0, False, False, i % 211 == 0) for i in range(4000)]
    ev = spark.createDataFrame(rows, "event_id long, ts timestamp, app string, fingerprint string, category string, severity string, ratio double, is_spike boolean, is_burst boolean, is_cross_namespace boolean")
    monkeypatch.setattr(analysis, "CHUNK_ROWS", 100)
    keyed = analysis._keyed(ev)
    sizes = [r["n"] for r in keyed.select("n").collect()]
    assert sum(sizes) == 4000 and len(sizes) > 20 and max(sizes) < 300
    whole = analysis._starts(keyed)[0]
    spans, folded = [], analysis._folded
    monkeypatch.setattr(analysis, "_folded", lambda rows, starts, span, members: spans.append((span, len({c // span for c in starts}))) or folded(rows, starts, span, members))
    monkeypatch.setattr(analysis, "SPAN_ROWS", 1000)
    monkeypatch.setattr(analysis, "AHEAD", 2)
    assert analysis._starts(keyed)[0] == whole
    assert max(s for s, _ in spans) * max(sizes) <= 1000
    assert all(n <= 2 for s, n in spans[2:])


def test_merged_timeline_equals_a_loop(spark):
    secs = [0, 10, 50, 60, 61, 100, 121, 122, 300]
    ev = spark.createDataFrame([(i, T0 + timedelta(seconds=s), "a" if i % 2 else "b", "fp", "spike", float(i), 1, "m", 1) for i, s in enumerate(secs)], "event_id long, ts timestamp, app string, fingerprint string, event_type string, ratio double, error_count long, message string, group_id long")
    start, windows = secs[0], defaultdict(list)
    for i, s in enumerate(secs):
        if s - start > 60:
            start = s
        windows[start, "a" if i % 2 else "b"].append(i)
    got = {(r["event_id"], r["events"], r["ratio"]) for r in analysis.merged_timeline(ev).collect()}
    assert got == {(v[0], len(v), float(max(v))) for v in windows.values()}


def test_merged_timeline_of_one_long_group(spark):
    """Windows of a group of dense and sparse stretches, ties and gaps of just a minute, against a loop."""
    import random

    rnd = random.Random(3)
    times, t = [], 0
    for _ in range(3000):
        t += rnd.choice([0, 1, 5, 20, 60, 61, 119, 120, 121, 600])
        times.append(t)
    ev = spark.createDataFrame([(i, T0 + timedelta(seconds=s), "a", "fp", "error", 1.0, 1, "m", i % 2) for i, s in enumerate(times)], "event_id long, ts timestamp, app string, fingerprint string, event_type string, ratio double, error_count long, message string, group_id long")
    expected = {}
    for g in (0, 1):
        start, rows = None, []
        for i, s in enumerate(times):
            if i % 2 != g:
                continue
            if start is None or s - start > 60:
                start = s
                rows.append([i, 0])
            rows[-1][1] += 1
        expected.update({i: n for i, n in rows})
    assert {r["event_id"]: r["events"] for r in analysis.merged_timeline(ev).collect()} == expected


@pytest.mark.parametrize("pattern, text", [
    ("not\\s+found", "found"), ("Connection refused", "connection refused"), ("a|b", ""), ("(?i)abc", ""), ("ab?cd", "cd"), ("abc+d", "abc"), ("a\\.b\\-c", "a.b-c"), ("x{2}yz", "yz"), ("[abc]def(ghi)?jklm", "jklm"),
    ("^start.*end$", "start"), ("\\Qabc\\E", ""), ("(a(b)c)long", "long"), ("[a[bc]]def", "def"), (None, ""), ("", ""), ("\\d+ items", " items"), ("abc*?de", "ab"), ("[\\]x]abc", "abc"), ("ab\\", ""), ("*a", ""),
])
def test_required_text(pattern, text):
    assert analysis.required_text(pattern) == text


def test_many_patterns(spark):
    """10,000 patterns against all messages as by a loop, and only equi-joins in the plan, whatever is broadcast."""
    import random
    import re

    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdeXY") for _ in range(rnd.randint(1, 7)))
    kinds = [lambda: f"{word()} {word()}", lambda: f"{word()}\\s+{word()}", lambda: f"{word()}.*{word()}", lambda: f"{word()}|{word()}{word()}", lambda: f"[xy]{word()}?", lambda: f"({word()})+ {word()}$", lambda: f"^{word()}"]
    patterns = [(f"K{i:05d}", kinds[0 if i % 10 else i // 10 % len(kinds)]()) for i in range(10_000)] + [("none", None)]
    messages = [" ".join(word() for _ in range(rnd.randint(0, 8))) for _ in range(60)] + [None]
    found = analysis.pattern_matches(spark.createDataFrame([(m,) for m in messages], "message string"), spark.createDataFrame(patterns, "error_id string, pattern string"))
    assert {(r["message"], r["error_id"]) for r in found.collect()} == {(m, k) for m in messages if m is not None for k, p in patterns if p and re.search(p, m, re.I)}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = found._sc._jvm.PythonSQLUtils.explainString(found.select("*")._jdf.queryExecution(), "simple")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_trace_links_connect_what_all_pairs_connect(spark):
    """Sets of traces of all sizes, with one trace in every problem: components of all pairs that share half of the smaller set."""
    import random

    rnd = random.Random(8)
    for common in (False, True):
        sets = {f"p{i:03d}": {f"t{rnd.randrange(90)}" for _ in range(rnd.choice([1, 2, 3, 4, 5, 8, 12]))} | ({"everywhere"} if common and i % 7 else set()) for i in range(60)}
        df = spark.createDataFrame([(k, t) for k, ts in sets.items() for t in ts for _ in (0, 1)], "problem_key string, trace_id string")
        nodes = spark.createDataFrame([(k,) for k in sets], "problem_key string")
        links = alerts.trace_links(df)
        got = {r["problem_key"]: r["cluster"] for r in alerts.components(nodes, links).collect()}
        parent = {k: k for k in sets}
        find = lambda k: k if parent[k] == k else find(parent[k])  # noqa: E731, B023
        for a in sets:
            for b in sets:
                if a < b and len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b])) >= 0.5:
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
        assert got == {k: find(k) for k in sets}


def test_alert_clusters_equal_union_find(spark, data):
    rows, tr = ST.alert_problems(spark, data)
    got = {r["problem_key"]: r["cluster"] for r in ST.alert_clusters(spark, data).collect()}
    traces_of, info = defaultdict(set), {r["problem_key"]: r for r in rows.collect()}
    for r in tr.collect():
        traces_of[r["problem_key"]].add(r["trace_id"])
    said = rows.select("problem_key", F.explode(F.concat(F.array("normalized_message"), F.col("sample_messages"))).alias("m")).select("problem_key", X.cause_tokens(F.col("m")).alias("t"))
    tokens = defaultdict(list)
    for r in said.filter("m is not null").collect():
        tokens[r["problem_key"]].append(r["t"])

    def run(a, b):
        best, prev = 0, [0] * (len(b) + 1)
        for x in a:
            cur = [0] * (len(b) + 1)
            for j, y in enumerate(b, 1):
                if x == y:
                    cur[j] = prev[j - 1] + 1
                    best = max(best, cur[j])
            prev = cur
        return best

    parent = {k: k for k in info}
    find = lambda k: k if parent[k] == k else find(parent[k])
    keys = sorted(info)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = traces_of[a], traces_of[b]
            linked = bool(x and y) and len(x & y) / min(len(x), len(y)) >= 0.5
            p, q = info[a], info[b]
            same = p["total_occurrences"] == q["total_occurrences"] and set(p["apps"]) & set(q["apps"]) and set(p["namespaces"]) & set(q["namespaces"]) and any(run(s, t) >= 5 for s in tokens[a] for t in tokens[b])
            if linked or same:
                ra, rb = sorted((find(a), find(b)))
                parent[rb] = ra
    assert {k: find(k) for k in keys} == got


def test_patterns_equal_a_loop(spark, data):
    got = defaultdict(list)
    for r in problems.patterns(B.keyed(spark, data)).orderBy("problem_key", "rank").collect():
        got[r["problem_key"]].append((r["message"], r["count"], r["signal"]))
    rows = B.keyed(spark, data).select("problem_key", "total_count", X.useful_content(F.col("sample_message")).alias("u"), X.useful_content(F.col("normalized_message")).alias("n")).collect()
    said = defaultdict(lambda: defaultdict(int))
    for r in rows:
        if text := r["u"] or r["n"]:
            said[r["problem_key"]][text] += r["total_count"]
    for key, texts in said.items():
        assert sum(c for _, c, _ in got[key]) <= sum(texts.values())
        assert [s for _, _, s in got[key]] == sorted((s for _, _, s in got[key]), reverse=True)
    assert set(got) == {r["problem_key"] for r in rows}


@pytest.mark.parametrize("message, expected", [
    ("ValidationException error handled.", ""), ("Handle fault. Error: X[code=1, message=Bad amount, detail=d]", "Bad amount"), ("Handle fault. Error: X[message=null, detail=row 7]", "null / row 7"),
    ("SPEED-101#a#b#c#d#CardsServiceImpl#getCard#404#gone#", "CardsServiceImpl#getCard → 404 (gone)"), ("SPEED-1#a#b#c#d#n/a#n/a#n/a#", "SPEED-1"), ("first line \n at second", "first line"), (None, ""),
])
def test_useful_content(spark, message, expected):
    assert one(spark, X.useful_content(F.lit(message).cast("string"))) == expected


def test_texts(spark):
    assert one(spark, X.normalised_message(F.lit("Connection to 192.168.1.1:5432 failed for user 12345"))) == "Connection to <IP>:<PORT> failed for user <ID>"
    assert one(spark, X.collapsed_ids(F.lit("data=[<ID>, <ID>, <ID>, <ID>] and <TS>"))) == "data=[<ID>×4] and <TS>"
    assert one(spark, X.operator_text(F.lit("UnknownError: org.acme.FooException: no luck at org.acme.Foo.bar(Foo.java:1)"))) == "FooException: no luck"
    assert one(spark, X.smart_trim(F.lit("word " * 80))) == ("word " * 80)[:244] + "..."
    assert one(spark, X.latest_version(F.array(F.lit("2.9.0"), F.lit("2.10.0"), F.lit("x")))) == "2.10.0"
    assert one(spark, X.sorted_versions(F.array(F.lit("2.10.0"), F.lit("2.9.0"), F.lit("2.10.0-rc1")))) == ["2.9.0", "2.10.0-rc1", "2.10.0"]
    assert one(spark, X.registry_flow(F.array(F.lit("bff-pcb-ch-card-servicing-v1")))) == "card_servicing"
    assert one(spark, X.registry_flow(F.array().cast("array<string>"), F.array(F.lit("pcb-dev-01")))) == "pcb"
    assert [one(spark, f(F.array(F.lit("feapi-pca-v1"), F.lit("shop-cart-v3")))) for f in (X.registry_flow, X.flow)] == ["unknown", "unknown"]
    assert one(spark, X.registry_flow(F.array(F.lit("feapi-pca-v1"), F.lit("bl-pcb-billing-v1")))) == "billing"
    assert one(spark, X.longest_shared_run(F.array(*map(F.lit, "abcdef")), F.array(*map(F.lit, "xbcdey")))) == 4
    assert [one(spark, X.duration_text(F.lit(s))) for s in (45, 1385, 18723)] == ["45s", "23m 5s", "5h 12m 3s"]
    assert one(spark, X.without_stack(F.lit("bad\n\tat com.acme.A.b(A.java:1)"))) == "bad"


def test_values(spark):
    a = F.array(*map(F.lit, [5.0, 1.0, 3.0, 2.0]))
    assert (one(spark, V.array_median(a)), one(spark, V.array_mad(a)), one(spark, V.upper_median(a))) == (2.5, 1.0, 3.0)
    hundred = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda x: x.cast("double"))
    assert one(spark, V.floor_percentile(hundred, 0.93)) == 93.0
    assert one(spark, V.ewma(a)) == pytest.approx(0.3 * 2 + 0.7 * (0.3 * 3 + 0.7 * (0.3 * 1 + 0.7 * 5)))
    assert one(spark, V.derived_severity(F.lit(None).cast("string"), F.lit("SYSTEMIC"), F.lit("x"), F.array(F.lit("a-dev-1")))) == "high"
    assert one(spark, V.trend_text(F.lit(40), F.lit(10.0), "2h")) == "2h: ↑ +200%+"


@pytest.mark.parametrize("current, base, text", [(269, 270.0, "24h: → -0%"), (271, 270.0, "24h: → +0%"), (135, 270.0, "24h: → -50%"), (0, 270.0, "24h: → -100%"), (270, 270.0, "24h: → +0%")])
def test_small_trends_keep_their_sign(spark, current, base, text):
    assert one(spark, V.trend_text(F.lit(current), F.lit(base), "24h")) == text


def test_registry_keeps_every_fingerprint(spark):
    """Two runs of 600 fingerprints of one key, 200 of them in both."""
    run = lambda a: spark.range(a, a + 600).select(
        F.lit("timeout").alias("category"), F.array(F.lit("shop-cart-v3")).alias("apps"), F.lit("TimeoutException").alias("error_type"), F.lit("slow").alias("normalized_message"), F.array(F.lit("n")).alias("namespaces"),
        F.timestamp_seconds(F.col("id")).alias("first_seen"), F.timestamp_seconds(F.col("id")).alias("last_seen"), F.col("id").cast("string").alias("fingerprint"), F.lit("slow").alias("sample_message"), F.lit(1).cast("long").alias("total_count"))
    a, b = registry.problem_updates(run(0)), registry.problem_updates(run(400))
    h = registry.health(registry.upsert(a, b), "2026-01-20").first()
    assert (h["problems"], h["fingerprints"], h["max_fingerprints"]) == (1, 1000, 1000)


def test_plain_texts_choose_what_is_replaced(spark):
    """Normalisation and error types are those of all patterns in order, without a look at what a message must have."""
    said = ["", "Account 12345", "account 12345 of card 99999", "Card  123456", "case 12345", "RequestId 123456 request 1234", "TxId 12345 transaction 99999", "OrderId 12345", "DocId 99999 Document 12345", "1.2.3.4:8080 up",
            "2024-01-02T03:04:05.6Z late", "0xFF at @abcdef", "a:1234 b:123", "/12/x/7/", "99999", "id: 7 ID=8 Id 9", "x?a=b c", "3f2b8c1e-aaaa-4bbb-8ccc-0123456789ab", "java.io.IOException: disk", "MyError SomeFault aFailure", "Error Exception"]
    df = spark.createDataFrame([(m,) for m in said], "m string")
    plain = F.coalesce(*(X.found(F.col("m"), p) for p in rules.ERROR_TYPE_PATTERNS), F.lit("UnknownError"))
    got = df.select(X.normalised_message(F.col("m")).alias("a"), X.replaced(F.col("m"), rules.NORMALISATION).alias("b"), X.error_type_of_message(F.col("m")).alias("c"), plain.alias("d")).collect()
    assert [(r["a"], r["c"]) for r in got] == [(r["b"], r["d"]) for r in got]
    assert len({r["a"] for r in got}) > 15


def test_spread_bounds_the_rows_of_a_task(spark, tmp_path):
    spark.range(10_000).coalesce(1).write.parquet(str(tmp_path / "one"))
    parts = tables.spread(spark.read.parquet(str(tmp_path / "one")), 500).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 20 and max(r["count"] for r in parts) <= 600


def test_dense_zeros_and_reconciliation(spark):
    rows = parse(log_rows(spark, [(0, "ns-a", "x", "m", None), (1, "ns-a", "x", "m", None), (2, "ns-a", "x", "n", None)]))
    f = measure.facts(rows)
    names = spark.createDataFrame([("ns-a",), ("ns-b",)], "namespace string")
    dense = measure.dense_namespace_counts(f, names, "2026-01-20 08:00:00", "2026-01-20 08:30:00")
    assert [r["error_count"] for r in dense.orderBy("namespace", "window_start").collect()] == [3, 0, 0, 0]
    incidents.reconcile(3, 3, rows, f, dense)
    with pytest.raises(ValueError, match="counts differ"):
        incidents.reconcile(4, 3, rows, f, dense)


def test_retention_rejects_partial_replay(spark):
    kinds = "run_id string, window_start timestamp, namespace string, application string, fingerprint string, error_type string, category string, subcategory string, error_count long, first_event_at timestamp, last_event_at timestamp"
    f = spark.createDataFrame([("r", T0, "n", "a", "f", "t", None, None, 5, T0, T0)], kinds)
    n = spark.createDataFrame([("r", T0, "n", 5)], "run_id string, window_start timestamp, namespace string, error_count long")
    legacy = spark.createDataFrame([(T0 + timedelta(days=1), "n", 7)], "ts timestamp, namespace string, error_count long")
    none_k, none_n = ledger.kind_rollup(f, "2000-01-01"), ledger.namespace_rollup(ledger.namespace_windows(n, legacy, "2000-01-01"))
    out = ledger.maintain(f, n, legacy, none_k, none_n, "2026-02-01")
    got = {(r["error_count"], r["complete_window_count"], r["source_kind"]) for r in out["namespace_rollups"].collect()}
    assert got == {(5, 1, "authoritative_facts"), (7, 1, "legacy_peak_raw_data")} and out["facts"].count() == 0
    with pytest.raises(ValueError, match="full day"):
        ledger.maintain(f, n, legacy, none_k, tables.staged(out["namespace_rollups"], "t"), "2026-02-01")


def test_superseded_run(spark):
    runs = spark.createDataFrame([("a", "complete", T0, T0 + timedelta(minutes=15), None), ("b", "complete", T0, T0 + timedelta(minutes=15), None)], "run_id string, status string, window_start timestamp, window_end timestamp, superseded_by_run_id string")
    got = {r["run_id"]: r["status"] for r in ledger.superseded(runs, "b", str(T0), str(T0 + timedelta(minutes=15))).collect()}
    assert got == {"a": "superseded", "b": "complete"}


def test_flat_records_read_dotted_and_nested(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"message": "m", "application": {"name": "nested"}, "@timestamp": "2026-01-20T08:00:00Z"}\n{broken\n{"message": "k", "application.name": "dotted", "timestamp": "bad"}\n')
    got = {r["message"]: (r["app_name"], r["ts"]) for r in L.flat_records(L.read_documents(spark, str(tmp_path))).collect() if r["message"]}
    assert got == {"m": ("nested", T0), "k": ("dotted", None)}


def test_batches(spark, tmp_path):
    (tmp_path / "batch_1.json").write_text('[{"message": "a"}, {"message": "b"}]')
    (tmp_path / "batch_2.json").write_text('{"errors": [{"message": "c"}]}')
    (tmp_path / "batch_summary.json").write_text('[{"message": "x"}]')
    assert sorted(r["message"] for r in L.read_batches(spark, str(tmp_path)).collect()) == ["a", "b", "c"]


def test_trace_rules(spark):
    rows = parse(log_rows(spark, [(0, "n", "a", "plain", None), (1, "n", "b", "plain", None), (2, "n", "c", "plain", None), (3, "n", "a", "Database timeout while called service answered", None)]))
    line = traces.timelines(rows.withColumn("trace_id", F.lit("t"))).select(traces.root_cause(F.col("events")).alias("r"), traces.apps_in_order(F.col("events")).alias("a"), F.size(traces.signature(F.col("events"))).alias("n")).first()
    assert (line["r"]["service"], line["r"]["confidence"], line["a"], line["n"]) == ("a", "medium", ["a", "b", "c"], 4)


def test_alert_state(spark):
    state = spark.createDataFrame([("p", T0, "w1", "stable", 10, T0)], "peak_key string, s_sent_at timestamp, s_window string, s_trend string, s_count long, s_cooldown_until timestamp")
    sent = spark.createDataFrame([("p", "w2", "rising", 20), ("", "w", "", 1)], "peak_key string, window_key string, trend string, error_count long")
    got = alerts.recorded(state, sent, str(T0 + timedelta(hours=1))).collect()
    assert [(r["peak_key"], r["s_window"], r["s_count"]) for r in got] == [("p", "w2", 20)]


def test_empty_tables(spark):
    rows = parse(log_rows(spark, [(0, "n", "a", "m", None)]).limit(0))
    assert measure.facts(rows).count() == 0 and measure.measure(rows).count() == 0 and incidents.detect(rows).count() == 0
