"""Versions of tables under two writers and crashes, the paged source, and YAML registries over any split."""

from __future__ import annotations

import json
import os
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from emberlog.operators import ledger
from emberlog.sources import paged, yamls
from emberlog.sources.store import Conflict, Store, create_if_absent

T0 = datetime(2026, 1, 20, 8, tzinfo=timezone.utc)
KV = "k int, v string"


def rows(store, name="t"):
    return sorted(tuple(r) for r in store.tables()[name].collect())


def test_two_writers_lose_nothing(spark, tmp_path):
    a, b = Store(spark, f"file://{tmp_path}"), Store(spark, f"file://{tmp_path}")
    assert a.version() == 0 and a.tables() == {}
    assert a.upsert("t", spark.createDataFrame([(1, "a"), (2, "a")], KV), ["k"]) == 1
    tried = []

    def change(tables):
        tried.append(a.version())
        if len(tried) == 1:
            b.upsert("t", spark.createDataFrame([(2, "b"), (3, "b")], KV), ["k"])
        return {"t": ledger.upserted(tables["t"], spark.createDataFrame([(1, "c"), (4, "c")], KV), ["k"])}

    assert a.commit(change) == 3 and tried == [1, 2]
    assert rows(a) == [(1, "c"), (2, "b"), (3, "b"), (4, "c")]
    assert sorted(tuple(r) for r in a.tables(1)["t"].collect()) == [(1, "a"), (2, "a")]


def test_a_writer_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}")
    store.commit(lambda t: {"t": spark.createDataFrame([(1, "a")], KV), "u": spark.createDataFrame([(9, "z")], KV)})
    import emberlog.sources.store as module

    with monkeypatch.context() as m:
        m.setattr(module, "create_if_absent", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError, match="gone"):  # after the data, before the version
            store.upsert("t", spark.createDataFrame([(2, "b")], KV), ["k"])
    assert store.version() == 1 and rows(store) == [(1, "a")]
    assert store.vacuum() == 1  # what the dead writer left
    store.upsert("t", spark.createDataFrame([(2, "b")], KV), ["k"])
    assert rows(store) == [(1, "a"), (2, "b")] and rows(store, "u") == [(9, "z")]
    assert store.vacuum(keep=1) == 1 and rows(store) == [(1, "a"), (2, "b")] and store.version() == 2


def test_always_too_late(spark, tmp_path):
    store, other = Store(spark, f"file://{tmp_path}"), Store(spark, f"file://{tmp_path}")

    def change(_):
        other.commit(lambda t: {"u": spark.createDataFrame([(1, "x")], KV)})
        return {"t": spark.createDataFrame([(1, "y")], KV)}

    with pytest.raises(Conflict):
        store.commit(change, attempts=2)
    assert "t" not in store.tables()


def test_a_file_is_created_once(spark, tmp_path):
    path = f"file://{tmp_path}/versions/v1"
    assert create_if_absent(spark, path, "one") and not create_if_absent(spark, path, "two")
    assert (tmp_path / "versions/v1").read_text() == "one" and os.listdir(tmp_path / "versions") == ["v1"]


def test_runs_and_retention_in_one_version(spark, tmp_path):
    from datetime import timedelta

    store = Store(spark, f"file://{tmp_path}")
    runs = spark.createDataFrame([(r, "complete", T0, T0 + timedelta(minutes=15), None) for r in "ab"], "run_id string, status string, window_start timestamp, window_end timestamp, superseded_by_run_id string")
    facts = spark.createDataFrame([("r", T0, "n", "a", "f", "t", None, None, 5, T0, T0)], "run_id string, window_start timestamp, namespace string, application string, fingerprint string, error_type string, category string, subcategory string, error_count long, first_event_at timestamp, last_event_at timestamp")
    names = spark.createDataFrame([("r", T0, "n", 5)], "run_id string, window_start timestamp, namespace string, error_count long")
    legacy = spark.createDataFrame([(T0 + timedelta(days=1), "n", 7)], "ts timestamp, namespace string, error_count long")
    none_k, none_n = ledger.kind_rollup(facts, "2000-01-01"), ledger.namespace_rollup(ledger.namespace_windows(names, legacy, "2000-01-01"))
    store.commit(lambda t: {"runs": runs, "facts": facts, "namespaces": names, "legacy": legacy, "kind_rollups": none_k, "namespace_rollups": none_n})
    store.supersede("b", str(T0), str(T0 + timedelta(minutes=15)))
    assert {r["run_id"]: r["status"] for r in store.tables()["runs"].collect()} == {"a": "superseded", "b": "complete"}
    assert store.maintain("2026-02-01") == 3
    now = store.tables()
    assert now["facts"].count() == now["namespaces"].count() == 0 and {(r["error_count"], r["source_kind"]) for r in now["namespace_rollups"].collect()} == {(5, "authoritative_facts"), (7, "legacy_peak_raw_data")}
    with pytest.raises(ValueError, match="full day"):
        store.commit(lambda t: ledger.maintain(facts, names, t["legacy"], t["kind_rollups"], t["namespace_rollups"], "2026-02-01"))
    assert store.version() == 3


# --- pages ---


@pytest.fixture
def snapshot(spark, tmp_path):
    paged.register(spark)
    docs = spark.range(1000).select((F.floor(F.col("id") / 3) * 1000).alias("us"), F.col("id").alias("n"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("m"), "id")).alias("text"))
    paged.write_snapshot(docs, str(tmp_path / "s"), page_rows=100)
    return docs, str(tmp_path / "s")


def pages_of(spark, folder):
    return spark.read.format("paged_logs").schema("us long, n long, text string").load(folder)


def test_pages_are_the_table(spark, snapshot):
    docs, folder = snapshot
    read = pages_of(spark, folder)
    assert sorted(map(tuple, read.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    some = read.filter((F.col("us") >= 100_000) & (F.col("us") < 150_000))
    assert some.count() == 150 and some.rdd.getNumPartitions() < read.rdd.getNumPartitions() >= 8


def test_a_missing_or_short_page_raises(spark, snapshot, tmp_path):
    import shutil

    _, folder = snapshot
    page = sorted((tmp_path / "s/pages").glob("page=*"))[2]
    part = next(page.glob("*.json"))
    lines = part.read_text().splitlines(keepends=True)
    part.write_text("".join(lines[:-1]))
    with pytest.raises(Exception, match="rows fetched of"):
        pages_of(spark, folder).count()
    shutil.rmtree(page)
    with pytest.raises(Exception, match="is missing"):
        pages_of(spark, folder).count()


def test_many_pages_are_few_tasks(spark, tmp_path):
    """Tasks go by rows, not by pages; pages follow each other in time and hold all rows."""
    paged.register(spark)
    docs = spark.range(3000).select((F.col("id") * 7919 % 3000).alias("us"), F.col("id").alias("n"), F.lit("x").alias("text"))
    paged.write_snapshot(docs, str(tmp_path / "s"), page_rows=10)
    index = sorted((json.loads(x) for p in (tmp_path / "s/index").glob("*.json") for x in p.read_text().splitlines()), key=lambda p: p["page"])
    assert 300 <= len(index) <= 310 and max(p["rows"] for p in index) <= 10 and all(a["last"] < b["first"] for a, b in zip(index, index[1:]))
    read = pages_of(spark, str(tmp_path / "s"))
    assert read.rdd.getNumPartitions() < 30 and [r["us"] for r in read.collect()] == list(range(3000))


def test_fetching_is_tried_again():
    calls = []

    def fetch(folder, number):
        calls.append(number)
        if len(calls) < 3:
            raise OSError("busy")
        return iter([json.dumps({"us": 1})])

    from pyspark.sql.types import LongType, StructField, StructType

    reader = paged.PagedReader(StructType([StructField("us", LongType())]), {"path": "x"}, fetch)
    assert list(reader.read(paged.Page(4, 1))) == [(1,)] and calls == [4, 4, 4]


def test_pages_as_a_stream_go_on_where_they_stopped(spark, snapshot, tmp_path):
    _, folder = snapshot
    index = next((tmp_path / "s/index").glob("*.json"))
    lines = index.read_text().splitlines(keepends=True)
    pages = sorted(lines, key=lambda x: json.loads(x)["page"])
    got = []
    for known in (4, len(pages), len(pages)):  # pages come in between; the last run finds nothing new
        index.write_text("".join(pages[:known]))
        (tmp_path / f"s/index/.{index.name}.crc").unlink(missing_ok=True)
        stream = spark.readStream.format("paged_logs").schema("us long, n long, text string").load(folder)
        put = lambda df, i: got.append([r["n"] for r in df.collect()])
        stream.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    read = [batch for batch in got if batch]
    assert len(read) == 2 and sorted(n for batch in read for n in batch) == list(range(1000))


# --- YAML ---


def test_entries_across_splits(spark, tmp_path):
    """Entries of many lines in few small splits, read with other split sizes, equal what a YAML library reads."""
    rnd = random.Random(2)
    texts = ["plain", "with: colon", "# no comment", "it's", 'say "x"', "ünï", "", "  spaced ", "null", "7", "- dash", "line\nbreak", None]
    data = [(i, rnd.choice(texts), [rnd.choice(texts[:-1]) for _ in range(rnd.randint(0, 6))]) for i in range(400)]
    df = spark.createDataFrame(data, "id long, name string, tags array<string>")
    yamls.write_entries(df.coalesce(2), str(tmp_path / "y"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("300", "5000", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            back = yamls.read_entries(spark, str(tmp_path / "y"), df.schema)
            assert sorted(map(tuple, back.collect())) == data
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    yaml = pytest.importorskip("yaml")
    theirs = [e for f in sorted((tmp_path / "y").glob("part-*")) for e in yaml.safe_load(f.read_text())]
    assert sorted((e["id"], e["name"], e["tags"]) for e in theirs) == data


def test_entries_of_another_hand(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("# registry\nversion: 3\n- id: 1  # first\n  name: plain text\n  other: {x: 1}\n  tags:\n  - a\n  - 'b''s'\n\n- name: \"q: \\\"x\\\"\"\n  id: 2\n  tags:\n    - c\n  nested:\n    name: not this\n- id: none\n  name: ~\n  tags: []\n")
    got = yamls.read_entries(spark, str(tmp_path / "a.yaml"), spark.createDataFrame([], "id long, name string, tags array<string>").schema).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "plain text", ["a", "b's"]), (2, 'q: "x"', ["c"]), (None, None, [])], key=str)
