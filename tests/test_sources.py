"""Sinks, readers and SQL functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from emberlog.functions import sql, text
from emberlog.operators import analysis
from emberlog.plans import detection
from emberlog.sources import exports, logs, tables


def test_snapshot_round_trip(spark, data, tmp_path):
    found = detection.incidents(spark, data)
    exports.snapshot(found, str(tmp_path))
    back = exports.read_snapshot(spark, str(tmp_path), found.schema)
    pick = lambda df: sorted((r["fingerprint"], r["score"], tuple(r["apps"]), len(r["evidence"])) for r in df.collect())
    assert pick(back) == pick(found) and spark.read.json(f"{tmp_path}/summary").count() == 10


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"], {"k": 2})], "id int, xs array<string>, m map<string,int>")
    exports.export_table(df, str(tmp_path), "t", files=1)
    assert spark.read.option("header", "true").csv(f"{tmp_path}/t/csv").first()["m"] == '{"k":2}'
    assert exports.export_daily(df, str(tmp_path), "d", "2026-01-01") and not exports.export_daily(df, str(tmp_path), "d", "2026-01-01")
    exports.append_csv(df, f"{tmp_path}/log")
    exports.append_csv(df, f"{tmp_path}/log")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/log").count() == 2


def test_deliveries(spark, tmp_path):
    ok = spark.createDataFrame([("k", "mail", "Delivered ")], "dedup_key string, destination string, status string")
    assert exports.append_deliveries(ok, f"{tmp_path}/a") == 1 and spark.read.parquet(f"{tmp_path}/a").first()["status"] == "delivered"
    with pytest.raises(ValueError):
        exports.append_deliveries(ok.withColumn("status", F.lit("lost")), f"{tmp_path}/a")


def test_report_texts(spark):
    lines = spark.createDataFrame([("1. Bad thing (42 events)",), ("#2 Other: 7",), ("noise",)], "value string")
    assert [tuple(r) for r in exports.top_issues(lines).orderBy("rank").collect()] == [(1, "Bad thing", 42), (2, "Other", 7)]
    texts = spark.createDataFrame([("Report\n- Total errors: 12\nTop app : web\n",)], "value string")
    assert tuple(exports.report_fields(texts, ["Total errors", "Top app"]).first()) == ("12", "web")


def test_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "p")
    tables.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, day string"), path, "day")
    tables.replace_partitions(spark.createDataFrame([(3, "b")], "v int, day string"), path, "day")
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1, 3]


def test_sql_functions(spark):
    sql.register(spark)
    r = spark.sql("SELECT normalize_error_message('at 10.0.0.1 id 12345678901 0xFF') a, calculate_health_score(20D, 10D, 1, 1) b, effective_threshold(NULL, 7D) c").first()
    assert tuple(r) == ("at <IP> id <ID> <HEX>", 55.0, 7.0)


def test_hypotheses_and_peak_ids(spark):
    known = spark.createDataFrame([(0, "database/pool", "Pool"), (1, "database/lock", "Lock")], "pos int, rule string, hypothesis string")
    rows = spark.createDataFrame([("database", "lock"), ("database", "x"), ("auth", "y")], "category string, subcategory string")
    assert [r["hypothesis"] for r in analysis.hypotheses(rows, known).orderBy("category", "subcategory").collect()] == ["Unknown root cause for auth/y", "Lock", "Pool"]
    e = spark.range(1).select(text.peak_id(F.lit("total exceeds, peak_id=SPIKE:NS:a:1)")).alias("x")).first()["x"]
    assert e == "SPIKE:NS:a:1"


def test_namespace_scope(spark):
    assert [r["namespace"] for r in logs.namespace_scope(spark, ["x"], "b, a,b,").orderBy("pos").collect()] == ["b", "a"]
    with pytest.raises(ValueError):
        logs.namespace_scope(spark, [])


def test_pattern_blocks(spark, tmp_path):
    (tmp_path / "r.txt").write_text("Pattern (0, 13, 2, 'ns-a'): mean=4.5, std=1.0, samples=3\nPattern (1, 0, 0, 'ns-b'): mean=1, std=0, samples=9\n")
    got = logs.merge_slots(logs.pattern_block_slots(spark, str(tmp_path / "r.txt"))).orderBy("dow").collect()
    assert [(r["namespace"], r["mean"], r["samples"]) for r in got] == [("ns-a", 4.5, 3), ("ns-b", 1.0, 9)]
