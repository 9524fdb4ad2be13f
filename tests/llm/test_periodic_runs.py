"""Periodic runs against a loop over all periods, and the cases that the operator defines."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from test_llm import odd_docs, words

from emberlog.llm import periodic_runs, queries


def by_loop(w, min_length=24, min_periods=3):
    n, best = len(w), {}
    for q in range(1, n // min_periods + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + 1 + q < n and w[j + 1] == w[j + 1 + q]:
                j += 1
            if j - i + 1 + q >= max(min_length, min_periods * q):
                best.setdefault((i, j - i + 1 + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in best.items())


def kept(w, runs):
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in drop)


def made(rnd):
    w = [str(rnd.randrange(rnd.choice([1, 2, 3, 50]))) for _ in range(rnd.randint(0, 150))]
    for _ in range(rnd.randint(0, 3) if w else 0):
        a, p = rnd.randrange(len(w)), rnd.randint(1, 12)
        for i in range(a, min(len(w), a + p * rnd.randint(3, 9))):
            w[i] = w[a + (i - a) % p]
    return w


def test_made_sequences():
    rnd, total = random.Random(3), 0
    rows = [made(rnd) for _ in range(1500)]
    for w, (n, runs) in zip(rows, periodic_runs.runs_of_texts([" ".join(w) for w in rows])):
        assert (n, runs) == (len(w), by_loop(w))
        assert periodic_runs.collapsed(" ".join(w), n, runs) == kept(w, runs)
        total += len(runs)
    assert total > 500


@pytest.mark.parametrize("n, period", [(20000, 1), (20000, 7), (9000, 3000), (9001, 3000)])
def test_long_runs(n, period):
    (found,) = periodic_runs.runs_of_texts([" ".join(str(i % period) for i in range(n))])
    assert found == (n, [(0, n, period)])


def test_small_slices_and_chunks(monkeypatch):
    monkeypatch.setattr(periodic_runs, "_CHUNK", 4)
    monkeypatch.setattr(periodic_runs, "word_slices", lambda t: periodic_runs_slices(t, 40))
    from emberlog.llm.words import word_slices as periodic_runs_slices

    rnd = random.Random(4)
    for _ in range(200):
        w = made(rnd)
        ((n, runs),) = periodic_runs.runs_of_texts([" ".join(w)])
        assert runs == by_loop(w) and periodic_runs.collapsed(" ".join(w), n, runs) == kept(w, runs)


def test_whole_documents(spark, data):
    docs = queries.with_made_repeats(spark.read.parquet(f"{data}/documents.parquet"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = periodic_runs.find_runs(docs, with_text=True).collect()
    assert len(found) == len(texts) and any(r["runs"] for r in found)
    for r in found:
        w = words(texts[r["doc_id"]])
        runs = by_loop(w)
        assert [tuple(x) for x in r["runs"]] == runs and r["n_words"] == len(w) and r["collapsed"] == kept(w, runs)


def test_collapse_keeps_rows_and_columns(spark):
    docs = odd_docs(spark)
    repeated = docs.withColumn("text", F.when(F.col("doc_id") == 1, F.expr("repeat('a b\\t', 40)")).otherwise(F.col("text"))).withColumn("emberlog_runs", F.lit("taken"))
    out = periodic_runs.collapse(repeated)
    assert out.columns == repeated.columns and out.count() == docs.count()
    before, after = ({(r["doc_id"], r["source"]): r for r in df.collect()} for df in (repeated, out))
    assert after[1, "a"]["text"] == "a b" and after[9, "c"]["text"] == "ÄÖ üß" and after[6, "a"]["text"].startswith("x one two")
    assert all(after[k] == before[k] for k in before if k[0] not in (1, 6, 9))
    assert periodic_runs.collapse(docs.limit(0)).count() == 0


def test_odd_rows(spark):
    rows = {(r["doc_id"], r["n_words"]): r["runs"] for r in periodic_runs.find_runs(odd_docs(spark)).collect()}
    assert rows[2, 0] == rows[3, 0] == rows[7, 0] == rows[None, 0] == [] and [tuple(x) for x in rows[6, 30014]] == [(0, 30000, 1)] and [tuple(x) for x in rows[9, 40]] == [(0, 40, 2)]
    assert periodic_runs.find_runs(odd_docs(spark).limit(0)).count() == 0


def test_strongest(spark):
    runs = [[(0, 30, 10), (5, 24, 8), (9, 48, 12), (70, 24, 6)], [], [(1, 33, 11)]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(runs)], "i int, runs array<struct<start:long,length:long,period:long>>")
    got = {r["i"]: r["b"] and tuple(r["b"]) for r in df.select("i", periodic_runs.strongest(F.col("runs")).alias("b")).collect()}
    assert got == {0: (9, 48, 12), 1: None, 2: (1, 33, 11)}
