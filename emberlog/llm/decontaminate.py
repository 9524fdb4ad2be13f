"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds all substrings of the normalised test items, over words. Training words stream
through it; after each word its state and the length matched so far say the longest end of the text so far that
is in an item. Where that length reaches the window, or a whole short item ends, the words are hit.

A Spark job deals the items out to shards of about ``shard_words`` words (an item that is longer is cut into pieces that
overlap by a window less one word, which loses no window), and a task builds the automaton of each shard as
arrays. The driver holds one shard's arrays at a time, to broadcast them: 100,000 words took 6 MB there,
51 MB in each Python worker and 122 MB in the task that built them, whatever the benchmark's size. A benchmark of one shard, as is usual, is one pass over the documents in which
nothing but the result moves. A larger one takes a pass per shard: each writes the few rows that have hits, its broadcast is
released before the next pass, and the hits of all passes are united by a row number. Stretches of text in which no two neighbouring words
are neighbours in an item too are passed over by array comparisons, without a step of the automaton.

Defined results: null and wordless texts and items have no words and no hit; a null item id matches
as any other, and is left out of the list of ids; rows that repeat an item id count once; repeated documents are judged each;
columns are carried along whatever their names are; of a very long text the word numbers are kept (8 bytes each) and its words a slice at a time.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.llm.shared import drop, materialise, running

WINDOW = 13
#: Words of items in one automaton; this bounds what the driver holds and what is broadcast.
SHARD_WORDS = 100_000
#: Bytes of a text whose words are looked up at a time.
SLICE = 3_000_000
FOUND = ["emberlog_n", "emberlog_spans", "emberlog_items"]
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def normalised(text: str | None) -> list[bytes]:
    """Words of the text in UTF-8: A-Z lower-cased, runs of letters, digits and all that is not ASCII."""
    return text.encode().translate(_BYTES).split() if text else []


class Arrays(NamedTuple):
    """A finished automaton: what tasks build, and what is broadcast."""

    window: int
    shortest: int  # words of the shortest item
    items: list[str | None]
    vocabulary: list[bytes]
    pairs: np.ndarray  # neighbouring words, as one number each, sorted
    keys: np.ndarray  # steps: state x words + word, sorted
    to: np.ndarray  # and the state that each leads to
    link: np.ndarray
    length: np.ndarray
    top: np.ndarray  # of states of a window's length or more: the state on the chain of links that the last ``window`` words are in; else -1
    ends: dict[int, list[int]]  # top state -> long items with a window that ends in it
    shorts: dict[int, dict[int, list[int]]]  # state -> length -> short items that are this state's last words


def build(items: list[tuple[str | None, list[bytes]]], window: int = WINDOW) -> Arrays:
    """Generalised suffix automaton of items, as word numbers; ``window`` is the length from which a match counts."""
    vocabulary: dict[bytes, int] = {}
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]

    def state(n: int, to: int, steps: dict[int, int]) -> int:
        step.append(steps)
        link.append(to)
        length.append(n)
        return len(length) - 1

    def clone(p: int, w: int, q: int) -> int:
        c = state(length[p] + 1, link[q], dict(step[q]))
        link[q] = c
        while p >= 0 and step[p].get(w) == q:
            step[p][w] = c
            p = link[p]
        return c

    def extend(last: int, w: int) -> int:
        q = step[last].get(w)
        if q is not None:
            return q if length[q] == length[last] + 1 else clone(last, w, q)
        new, p = state(length[last] + 1, 0, {}), last
        while p >= 0 and w not in step[p]:
            step[p][w] = new
            p = link[p]
        if p >= 0:
            q = step[p][w]
            link[new] = q if length[q] == length[p] + 1 else clone(p, w, q)
        return new

    sequences, pairs = [], set()
    for _, words in items:
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words]
        sequences.append(ids)
        pairs.update(zip(ids, ids[1:], strict=False))
        last = 0
        for w in ids:
            last = extend(last, w)
    v = max(1, len(vocabulary))
    top = np.full(len(length), -1, np.int64)
    for s in sorted(range(1, len(length)), key=length.__getitem__):
        if length[s] >= window:
            top[s] = s if length[link[s]] < window else top[link[s]]
    # Every window of an item ends in one state; its items are kept at that state's top, and nowhere else
    ends: dict[int, set[int]] = {}
    shorts: dict[int, dict[int, set[int]]] = {}
    for number, ids in enumerate(sequences):
        s = 0
        for n, w in enumerate(ids, 1):
            s = step[s][w]
            if n >= window and len(ids) >= window:
                ends.setdefault(int(top[s]), set()).add(number)
        if 0 < len(ids) < window:
            shorts.setdefault(s, {}).setdefault(len(ids), set()).add(number)
    flat = sorted((s * v + w, to) for s, steps in enumerate(step) for w, to in steps.items())
    keys, to = (np.array([x[k] for x in flat], np.int64) for k in (0, 1))
    return Arrays(
        window, min((len(x) for x in sequences if x), default=0), [i for i, _ in items], list(vocabulary), np.array(sorted(a * v + b for a, b in pairs), np.int64), keys, to.astype(np.int32),
        np.array(link, np.int32), np.array(length, np.int32), top.astype(np.int32), {s: sorted(x) for s, x in ends.items()}, {s: {n: sorted(x) for n, x in y.items()} for s, y in shorts.items()},
    )


class Matcher:
    """Streams words through an automaton."""

    def __init__(self, arrays: Arrays):
        self.a = arrays
        self.vocabulary = {w: i for i, w in enumerate(arrays.vocabulary)}
        self.size = max(1, len(arrays.vocabulary))
        self.step = dict(zip(arrays.keys.tolist(), arrays.to.tolist(), strict=True))
        self._chain: dict[int, list[int]] = {}

    def numbers(self, text: str | None) -> np.ndarray:
        """The text's words as numbers; -1 for words that are in no item."""
        raw = text.encode().translate(_BYTES) if text else b""
        parts, start, get = [], 0, self.vocabulary.get
        while start < len(raw):
            end = raw.find(b" ", start + SLICE)
            end = len(raw) if end < 0 else end
            words = raw[start:end].split()
            parts.append(np.fromiter((get(w, -1) for w in words), np.int64, len(words)))
            start = end
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def _shorts(self, state: int) -> list[int]:
        """States on the chain of links from here (this one first) in which a short item ends."""
        found = self._chain.get(state)
        if found is None:
            found, s = [], state
            while s > 0:
                if s in self.a.shorts:
                    found.append(s)
                s = int(self.a.link[s])
            if len(self._chain) < 100_000:
                self._chain[state] = found
        return found

    def _stretches(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches [a, b) of the text that can hold a match of the shortest item's length."""
        shortest, pairs = self.a.shortest, self.a.pairs
        if not shortest or not len(ids):
            return
        if shortest == 1:
            ok, extra = ids >= 0, 0
        else:
            code = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] * self.size + ids[1:], -1)
            at = np.minimum(np.searchsorted(pairs, code), max(0, len(pairs) - 1))
            ok, extra = (pairs[at] == code) if len(pairs) else np.zeros(len(code), bool), 1
        edge = np.diff(np.concatenate(([0], ok.astype(np.int8), [0])))
        least = min(shortest, self.a.window)
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            if b - a + extra >= least:
                yield int(a), int(b) + extra

    def hits(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans (may overlap) and numbers of the items with an occurring window."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        link, length, top, ends, shorts, window = self.a.link, self.a.length, self.a.top, self.a.ends, self.a.shorts, self.a.window
        for a, b in self._stretches(ids):
            state = matched = 0
            for i, w in enumerate(ids[a:b].tolist(), a):
                if w < 0:
                    state = matched = 0
                    continue
                follow = self.step.get(state * self.size + w)
                while follow is None and state:
                    state = int(link[state])
                    matched = int(length[state])
                    follow = self.step.get(state * self.size + w)
                if follow is None:
                    continue
                state, matched = follow, matched + 1
                if matched >= window and (found := ends.get(int(top[state]))):
                    spans.append((i + 1 - window, i + 1))
                    items.update(found)
                for s in self._shorts(state) if shorts else ():
                    for n, found in shorts[s].items():
                        if n <= matched:
                            spans.append((i + 1 - n, i + 1))
                            items.update(found)
        return spans, items


def _pieces(window: int, shard_words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items as (item, piece, words, n): one piece, or several that overlap by a window less one word."""
    for batch in batches:
        rows = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = normalised(text)
            most = max(shard_words, 2 * window)
            for k, start in enumerate(range(0, max(1, len(words) - window + 1), most - window + 1)):
                if part := words[start : start + most]:
                    rows.append((item, k, b" ".join(part), len(part)))
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        kinds = (pa.string(), pa.int64(), pa.binary(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["item", "piece", "words", "n"])


def automata(benchmark: DataFrame, *, window: int = WINDOW, item_id: str = "item_id", text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """A row per shard: ``shard`` and ``arrays`` (pickled). Items go to shards in the order of (id, hash of the words), repeated ones once."""
    items = benchmark.select(F.col(item_id).cast("string"), F.col(text)).filter(F.col(text).isNotNull())
    pieces = items.mapInArrow(lambda it: _pieces(window, shard_words, it), "item string, piece long, words binary, n long").distinct()
    pieces = running(pieces.withColumn("hash", F.xxhash64("words")), ["item", "hash", "piece", "words"], {"n": "before"})
    pieces = pieces.withColumn("shard", F.floor(F.col("before") / shard_words))

    def made(group: pd.DataFrame) -> pd.DataFrame:
        rows = [(i, w.split()) for i, w in zip(group["item"], group["words"], strict=True)]
        return pd.DataFrame({"shard": group["shard"].iloc[:1], "arrays": [pickle.dumps(build(rows, window), 5)]})

    return materialise(pieces.groupBy("shard").applyInPandas(made, "shard long, arrays binary"), "automata")


def _scan(broadcast, keep: int, only_hits: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text is the first column; the last ``keep`` columns are carried along."""
    found = Matcher(pickle.loads(broadcast.value)) if broadcast else None
    for batch in batches:
        rows, n, spans, items = [], [], [], []
        for i in range(batch.num_rows):
            ids = found.numbers(batch.column(0)[i].as_py()) if found else np.zeros(len(normalised(batch.column(0)[i].as_py())))
            s, which = found.hits(ids) if found else ([], set())
            if s or not only_hits:
                rows.append(i)
                n.append(len(ids))
                spans.append([{"a": a, "b": b} for a, b in _united(s)])
                items.append(sorted({found.a.items[k] for k in which} - {None}) if which else [])
        arrays = [pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(items, pa.list_(pa.string()))]
        kept = batch.select(range(batch.num_columns - keep, batch.num_columns))
        kept = kept if len(rows) == batch.num_rows else kept.take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([*kept.columns, *arrays], names=[*kept.schema.names, *FOUND])


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
_FOUND = [T.StructField("emberlog_n", T.LongType()), T.StructField("emberlog_spans", _SPANS), T.StructField("emberlog_items", T.ArrayType(T.StringType()))]


@F.pandas_udf(_SPANS)
def _unite(spans: pd.Series) -> pd.Series:
    return pd.Series([[{"a": a, "b": b} for a, b in _united([(s["a"], s["b"]) for s in row])] for row in spans], dtype=object)


def _pass(docs: DataFrame, arrays: bytes | None, keep: list[str], only_hits: bool):
    """One pass over ``emberlog_text`` and the columns ``keep``, and its broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(arrays) if arrays else None
    schema = T.StructType([*(docs.schema[c] for c in keep), *_FOUND])
    n = len(keep)
    return docs.select("emberlog_text", *keep).mapInArrow(lambda it: _scan(sent, n, only_hits, it), schema), sent


def scan(docs: DataFrame, benchmark: DataFrame, *, keep: list[str] | None = None, window: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default), and ``emberlog_n`` (words), ``emberlog_spans`` (hit word spans a..b,
    apart and in order) and ``emberlog_items`` (ids of items with an occurring window)."""
    keep = docs.columns if keep is None else keep
    rows = docs.select(F.col(text).alias("emberlog_text"), *keep)
    shards = automata(benchmark, window=window, item_id=item_id, text=item_text, shard_words=shard_words)
    numbers = [r["shard"] for r in shards.select("shard").orderBy("shard").collect()]  # one number a shard
    arrays = lambda k: bytes(shards.filter(F.col("shard") == k).first()["arrays"])
    if len(numbers) < 2:
        return _pass(rows, arrays(numbers[0]) if numbers else None, keep, False)[0]
    rows = materialise(rows.withColumn("emberlog_row", F.monotonically_increasing_id()), "rows")
    passes = []
    for k in numbers:
        found, sent = _pass(rows, arrays(k), ["emberlog_row"], True)
        passes.append(materialise(found, "hits"))
        sent.destroy()
    hits = passes[0]
    for p in passes[1:]:
        hits = hits.unionByName(p)
    hits = hits.groupBy("emberlog_row").agg(F.flatten(F.collect_list("emberlog_spans")).alias("s"), F.array_distinct(F.flatten(F.collect_list("emberlog_items"))).alias("emberlog_items"))
    hits = materialise(hits.select("emberlog_row", _unite("s").alias("emberlog_spans"), "emberlog_items"), "hits")
    drop(shards, *passes)
    counted = _pass(rows, None, ["emberlog_row", *keep], False)[0].select("emberlog_row", *keep, "emberlog_n")
    found = counted.join(hits, "emberlog_row", "left")
    none = F.array().cast(_SPANS), F.array().cast("array<string>")
    return found.select(*keep, "emberlog_n", F.coalesce("emberlog_spans", none[0]).alias("emberlog_spans"), F.coalesce("emberlog_items", none[1]).alias("emberlog_items"))


def n_hit():
    return F.aggregate("emberlog_spans", F.lit(0).cast("long"), lambda acc, s: acc + s["b"] - s["a"])


def is_contaminated(percent: int = 5):
    return (n_hit() > 0) & (100 * n_hit() >= percent * F.col("emberlog_n"))


def report(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``, one row per document."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = scan(rows, benchmark, keep=["doc_id"], **options).select("doc_id", "emberlog_n", "emberlog_spans", F.array_sort("emberlog_items").alias("items"))
    return found.select(
        "doc_id", F.col("emberlog_n").alias("n_words"), n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )


@F.pandas_udf(T.StringType())
def _cut(rows: pd.DataFrame) -> pd.Series:
    """Texts without the hit words; what is between words stays."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    out = []
    for text, spans in zip(rows["text"], rows["spans"], strict=True):
        if text and len(spans):
            at = [m.span() for m in word.finditer(text)]
            pieces, done = [], 0
            for s in spans:
                pieces.append(text[done : at[s["a"]][0]])
                done = at[s["b"] - 1][1]
            text = "".join([*pieces, text[done:]])
        out.append(text)
    return pd.Series(out)


def clean(docs: DataFrame, benchmark: DataFrame, *, cut_spans: bool = False, percent: int = 5, text: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated documents (hits cover ``percent`` or more of the words). With ``cut_spans`` the
    hit spans of the other documents are cut out of their texts; else those documents stay as they are."""
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col(text).alias("text"))  # their names are then no matter
    found = scan(rows, benchmark, keep=["doc"], **options).filter(~is_contaminated(percent))
    if not cut_spans:
        return found.select("doc.*")
    cut = _cut(F.struct(F.col("doc")[text].alias("text"), F.col("emberlog_spans").alias("spans")))
    return found.select(*(cut.alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns))
