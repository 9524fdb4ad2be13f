"""Spelling variants against all pairs of a small vocabulary, and the cases that the operator defines."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_llm import odd_docs

from emberlog.llm import spelling


def one_edit(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def by_pairs(counts):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        form = min(near, key=lambda v: (-counts[v], v), default=None)
        form = form if form is not None and counts[form] >= 2 * n else None
        out[w] = [form, w, n, len(near), form and counts[form]]
    for w, row in out.items():
        while out[row[1]][0] is not None:
            row[1] = out[row[1]][0]
    return {w: tuple(row) for w, row in out.items()}


def found(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def made(seed, letters, n, sizes):
    rnd = random.Random(seed)
    words = {"".join(rnd.choice(letters) for _ in range(rnd.choice(sizes))) for _ in range(n)}
    return {w: rnd.choice([3, 4, 6, 9, 20, 50, 200]) for w in words}


@pytest.mark.parametrize("letters, n, sizes, max_group", [("ab", 300, (5, 6, 7), 20_000), ("abé", 350, (5, 6, 7, 8), 8), ("aÿ", 120, (1, 2, 3, 4, 5, 6), 1), ("a", 60, range(1, 40), 20_000), ("abcdefgh€𝄞", 400, (2, 3), 30)])
def test_made_vocabularies(spark, letters, n, sizes, max_group):
    counts = made(n, letters, n, sizes)
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found(spelling.spelling_variants(df, max_group)) == by_pairs(counts)


def test_small_chunks(spark, monkeypatch):
    counts = made(9, "abc", 500, (5, 6))
    rows = [(longer, m, a, b, "", "", w, n, point) for longer, m in ((False, 5), (False, 6), (True, 6)) for a, b in ((0, 3), (3, m)) for w, n in sorted(counts.items()) for point in [len(w) == m] if point or (longer and len(w) == 5)]
    rows = [r[:4] + (r[6][: r[2]] if r[2] else "", "" if r[2] else r[6][r[3] - (r[0] and not r[8]) :]) + r[6:] for r in rows]
    import pandas as pd
    import pyarrow as pa

    frame = pd.DataFrame(rows, columns=["longer", "points", "a", "b", "head", "tail", "word", "n", "point"]).sort_values(["longer", "points", "a", "b", "head", "tail"])
    for chars, size in ((1, 7), (60, 50), (10**6, 10**6), (10**6, 3)):
        monkeypatch.setattr(spelling, "CHUNK_CHARS", chars)
        near = Counter()
        for batch in spelling._near(iter(pa.Table.from_pandas(frame, preserve_index=False).to_batches(size))):
            for r in batch.to_pylist():
                near[r["word"]] += r["near"]
        assert {w: near[w] for w in counts} == {w: r[3] for w, r in by_pairs(counts).items()}


def test_wavelet_tree():
    import numpy as np

    rnd = np.random.default_rng(1)
    for n in (1, 2, 5, 64, 100):
        values = rnd.permutation(n)
        tree = spelling.WaveletTree(values)
        box = rnd.integers(0, n + 1, (200, 4))
        asked, got = tree.report(*box.T)
        for i, (first, last, low, high) in enumerate(box):
            assert sorted(got[asked == i]) == sorted(v for v in values[first:last] if low <= v < high)


def test_long_words(spark):
    words = ["x" * 5000 + "y", "x" * 5001, "x" * 5000, "x" * 2500 + "z" + "x" * 2500, "x" * 4998]
    df = spark.createDataFrame([(w, 3 + 4 * i) for i, w in enumerate(words)], "word string, n long")
    assert {w: r[3] for w, r in found(spelling.spelling_variants(df)).items()} == dict(zip(words, (3 - 1, 3, 3, 2, 0)))


def test_odd_documents(spark):
    docs = odd_docs(spark)
    texts = [r["text"] or "" for r in docs.select("text").collect()]
    counts = Counter(w for t in texts for w in spelling_runs(t) if len(w) >= 5)
    vocabulary = spelling.vocabulary(spelling.letter_runs(docs), "run", min_count=1)
    assert {r["word"]: r["n"] for r in vocabulary.collect()} == dict(counts)
    assert found(spelling.spelling_variants(vocabulary)) == by_pairs(counts)
    assert spelling.spelling_variants(spelling.vocabulary(spelling.letter_runs(docs.limit(0)), "run")).count() == 0


def spelling_runs(text):
    import re

    return re.findall(spelling.RUN, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def test_slips(spark):
    rows = [(i, w) for i in range(300) for w in ("straße", "a", "word", "Éa")] + [(None, "word")]
    df = spark.createDataFrame(rows, "doc_id long, run string")
    got = df.select("doc_id", "run", spelling.slip(F.col("run"), F.col("doc_id")).alias("w")).collect()
    changed = 0
    for i, w, s in got:
        h = zlib.crc32(f"{i}:{w}".encode()) if i is not None else 1
        k = h % len(w)
        assert s == (w[:k] + w[k + 1 :] if h % 97 == 0 else w)
        changed += s != w
    assert changed > 3


def test_corrected(spark):
    words = spark.createDataFrame([("hauss", 1), ("haus", 2), (None, 3), ("new", 4)], "w string, n int")
    variants = spelling.spelling_variants(spark.createDataFrame([("haus", 100), ("hauss", 3), ("maus", 2)], "word string, n long"))
    assert {(r["w"], r["root"]) for r in spelling.corrected(words, variants, "w").collect()} == {("hauss", "haus"), ("haus", "haus"), (None, None), ("new", "new")}
