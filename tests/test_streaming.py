"""Streams give what the batch operators give, whatever the order of events within the watermark."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from compare import connect, spark_rows, sql_rows
from pyspark.sql import Row
from pyspark.sql import functions as F

from emberlog.operators import alerts, measure
from emberlog.operators.parse import parse
from emberlog.plans.catalog import load
from emberlog.sources.logs import errors, log_events
from emberlog.streaming import detections as DS
from emberlog.streaming import facts as S
from emberlog.streaming import keyed as K

T0 = datetime(2026, 1, 20, 8, tzinfo=timezone.utc)


def _pages(spark, data, tmp_path, pages=3):
    e = spark.read.parquet(f"{data}/events.parquet")
    for i in range(pages):
        e.filter(F.floor(F.col("event_id") / 400) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return e, S.read_events(spark, str(tmp_path / "in"), e.schema, 1)


def _key(r):
    return r["window_start"], r["namespace"], r["app_name"], r["fingerprint"], r["error_count"]


def test_batches_of_pages_equal_batch(spark, data, tmp_path):
    e, stream = _pages(spark, data, tmp_path)
    S.write_facts(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("window_start", "namespace", "app_name", "fingerprint").agg(F.sum("error_count").alias("error_count"))
    assert sorted(map(_key, got.collect())) == sorted(map(_key, measure.facts(parse(errors(log_events(e)))).collect()))


def test_watermarked_windows_are_facts(spark, data, tmp_path):
    e, stream = _pages(spark, data, tmp_path)
    q = S.windowed_facts(stream, "60 days").writeStream.format("memory").queryName("facts").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.table("facts").groupBy("window_start", "namespace", "app_name", "fingerprint").agg(F.max("error_count").alias("error_count"))
    assert sorted(map(_key, last.collect())) == sorted(map(_key, measure.facts(parse(errors(log_events(e)))).collect()))


@pytest.fixture(scope="module")
def two_months(spark, data, tmp_path_factory):
    """The events, and a copy of them 31 days later."""
    folder = tmp_path_factory.mktemp("months")
    e = spark.read.parquet(f"{data}/events.parquet")
    later = e.withColumn("event_id", F.col("event_id") + 1_000_000).withColumn("ts", F.col("ts") + F.expr("INTERVAL 31 DAYS"))
    e.unionByName(later).write.parquet(str(folder / "events.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", ["streamed_facts", "watermarked_facts", "streamed_bursts", "streamed_alerts", "streamed_detections"])
def test_two_months(spark, two_months, name):
    queries, sql = load()
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{two_months}/events.parquet/*.parquet'")
    names, expected = sql_rows(con, sql[name])
    assert spark_rows(queries[name](spark, two_months)) == expected


def test_context_of_a_page_is_not_counted_again(spark, data):
    """Events that the tail of the page before holds are seen by a page's trailing counts, but they are not the page's events."""
    none = spark.createDataFrame([], "namespace string, dow int, p93 double, samples long"), spark.createDataFrame([], "namespace string, cap double")
    r = parse(errors(log_events(spark.read.parquet(f"{data}/events.parquet"))))
    cut = r.agg(F.percentile_approx("ts", 0.5)).first()[0]
    rules, old, new = DS.Rules(*none, 86_400), r.filter(F.col("ts") <= cut), r.filter(F.col("ts") > cut)
    first = DS.part(old, None, rules)
    found = [first["measures"], DS.part(new, first["tail"], rules)["measures"]]
    assert [m.agg(F.sum("events")).first()[0] for m in found] == [old.count(), new.count()]
    whole = measure.bursts(r, 86_400).agg(F.sum(F.col("avg_count") * F.col("events"))).first()[0]
    assert sum(m.agg(F.sum("counted")).first()[0] for m in found) == pytest.approx(whole)


def _run(spark, tmp_path, pages, schema, transform, mode):
    """What a keyed stream emits over pages of rows, with the number of each page."""
    out = []
    for i, rows in enumerate(pages):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = transform(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        put = lambda df, _, i=i: out.extend((i, r) for r in df.collect())
        stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    return out


def _trail(times, seconds):
    counts = [sum(t - seconds <= o for o in times[: i + 1]) for i, t in enumerate(times)]
    return len(times), max(counts), sum(counts)


def test_bursts_out_of_order_and_expiry(spark, tmp_path):
    """Events shuffled within the watermark give the batch's counts; late ones don't count; silent keys are closed, and a later event opens a new life."""
    rnd = random.Random(5)
    times = {k: sorted(rnd.randrange(0, 7200) for _ in range(40)) for k in "abc"}
    times["a"] += [40_000, 40_010]
    events = [(k, t) for k, ts in times.items() for t in ts]
    pages = [sorted((e for e in events if lo <= e[1] < hi), key=lambda e: rnd.random()) for lo, hi in ((0, 2000), (2000, 4500), (4500, 7300), (7300, 90_000))]
    # neighbours of pages swap some events that lie within the 15 minutes of the watermark
    early, late = [e for e in pages[1] if e[1] < 2400][:3], [e for e in pages[0] if e[1] > 1800][:3]
    pages[0] = [e for e in pages[0] if e not in late] + early
    pages[1] = [e for e in pages[1] if e not in early] + late
    pages[2].append(("b", 100))  # late
    rows = [[(k, T0 + timedelta(seconds=t)) for k, t in page] for page in pages] + [[("z", T0 + timedelta(days=3))], [("z", T0 + timedelta(days=6))]]
    out = _run(spark, tmp_path, rows, "fingerprint string, ts timestamp", lambda r: K.stream_bursts(r, 300, "15 minutes", 3600), "update")
    emitted = spark.createDataFrame([r for _, r in out], K.BurstCounts.OUT)
    got = {r["fingerprint"]: (r["events"], r["max_count"], r["sum_count"]) for r in K.burst_totals(emitted).collect()}
    assert got == {k: _trail(ts, 300) for k, ts in times.items()} | {"z": (2, 1, 2)}
    closed = defaultdict(list)
    for _, r in out:
        if r["closed"]:
            closed[r["fingerprint"]].append(r["events"])
    assert closed == {"a": [40, 2], "b": [40], "c": [40], "z": [1]}


def test_bursts_need_their_window():
    with pytest.raises(ValueError, match="forgotten"):
        K.BurstCounts(60, 59)


PAYLOAD = "peak_key string, at timestamp, window_key string, error_count long, trend string, is_test boolean, test_originator string, is_known boolean, new_apps array<string>, new_namespaces array<string>"


def _payloads(n, seed=2):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        at = T0 + timedelta(minutes=15 * i)
        for key in ("p", "q"):
            if rnd.random() < 0.8:
                rows.append((key, at, f"w{i - (rnd.random() < 0.1)}", rnd.choice([0, 10, 10, 10, 11, 12]), rnd.choice(["", "stable", "stable", "stable", "rising"]), rnd.random() < 0.1, "load", rnd.random() < 0.95, ["x"] if rnd.random() < 0.05 else [], []))
    return rows


def test_row_rules_equal_column_rules(spark):
    """``keyed.decide`` and ``alerts.decision`` are one rule set: all payloads against many states."""
    rows, rnd = _payloads(150), random.Random(7)
    now = T0 + timedelta(days=1)
    states = [None if rnd.random() < 0.1 else K.Sent(int((now - timedelta(minutes=rnd.choice([0, 30, 45, 60, 119, 120, 300]))).timestamp() * 1e6), f"w{rnd.randrange(150)}" if rnd.random() < 0.8 else None, rnd.choice([None, "", "stable", "rising"]), rnd.choice([0, 9, 10, 13, 20]), 0) for _ in rows]
    states = [s and s._replace(cooldown_until=s.at + 45 * K.MINUTE) for s in states]
    df = spark.createDataFrame([(i, *r, *((s.at, s.window_key, s.trend, s.error_count, s.cooldown_until) if s else (None,) * 5)) for i, (r, s) in enumerate(zip(rows, states))], "i long, " + PAYLOAD + ", a long, s_window string, s_trend string, s_count long, c long")
    df = df.withColumn("s_sent_at", F.timestamp_micros("a")).withColumn("s_cooldown_until", F.timestamp_micros("c"))
    got = {r["i"]: (r["d"]["send"], r["d"]["reason"]) for r in df.select("i", alerts.decision(F.lit(now)).alias("d")).collect()}
    names = [x.split()[0] for x in PAYLOAD.split(", ")]
    for i, (r, s) in enumerate(zip(rows, states)):
        p = Row(*names, "us")(*r, int(now.timestamp() * 1e6))
        assert got[i] == K.decide(p, s, 120 * K.MINUTE, 45 * K.MINUTE, 30.0)
    assert len({r for _, r in got.values()}) >= 8


def test_alerts_equal_the_batch_state_machine(spark, tmp_path):
    rows = _payloads(60)
    expected, state = [], {}
    names = [x.split()[0] for x in PAYLOAD.split(", ")]
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        us = int(r[1].timestamp() * 1e6)
        p = Row(*names, "us")(*r, us)
        send, reason = K.decide(p, state.get(r[0]), 120 * K.MINUTE, 45 * K.MINUTE, 30.0)
        expected.append((r[0], us, r[2], r[3], send, reason))
        if send:
            state[r[0]] = K.Sent(us, r[2], r[4], r[3], us + 45 * K.MINUTE)
    rnd = random.Random(1)
    pages = [sorted(rows[i : i + 30], key=lambda _: rnd.random()) for i in range(0, len(rows), 30)] + [[("end", T0 + timedelta(days=9), "w", 1, "", False, "", True, [], [])]]
    out = _run(spark, tmp_path, pages, PAYLOAD, lambda r: K.stream_decisions(r), "append")
    decided = [tuple(r) for _, r in out if r["reason"] not in ("cooldown_over", "heartbeat_due")]
    assert sorted(decided) == sorted(expected)


def test_timers_speak_without_a_payload(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    p = lambda key, m, n=10: (key, at(m), f"w{m}", n, "stable", False, "", True, [], [])
    pages = [[p("a", 0), p("b", 0)], [p("a", 15), p("clock", 40)], [p("clock", 400)]]
    out = _run(spark, tmp_path, pages, PAYLOAD, lambda r: K.stream_decisions(r), "append")
    said = [(page, r["peak_key"], round((r["us"] - T0.timestamp() * 1e6) / K.MINUTE), r["reason"]) for page, r in out if r["peak_key"] in "ab"]
    # b had nothing held back; a's reminders come with the page that moves the clock, which holds no payload of a
    assert sorted(said) == [(1, "a", 0, "first_seen_in_state"), (1, "a", 15, "cooldown_active"), (1, "b", 0, "first_seen_in_state"), (2, "a", 45, "cooldown_over"), (2, "a", 120, "heartbeat_due")]


def test_duplicates_within_the_delay(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet").limit(200)
    for _ in range(2):
        e.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    logs = S.read_events(spark, str(tmp_path / "in"), e.schema)
    S.distinct_events(logs, "60 days").writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("once").count() == 200
