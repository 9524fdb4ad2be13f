"""Substring dedup by recompression.

Every text is a sequence of words. Recompression rewrites it in rounds: first each run of one word
becomes a symbol, then, three times, each pair of a "left" and a "right" symbol (a bit of the
symbol's name says which it is) becomes a symbol. Names are hashes of what a symbol stands for, so
equal runs and pairs get equal names in all documents at once, without a shuffle per round, and equal passages
get equal symbols except at their ends. Each symbol keeps the span of words that its shape depends
on; wherever that span recurs, the symbol recurs.

1. Each window of ``window`` words is filed under the least-named symbol whose span lies inside it
   (a window without one: under itself). Equal windows are filed alike, and neighbours mostly share a symbol,
   so about one key per five words is shuffled. Keys that texts of two or more kinds share are found by
   an aggregate (least and greatest text hash, combined before the shuffle).
2. Only windows under shared keys are hashed (128 bits), and for each the least doc_id is found.
3. Words in a window that starts in a document of smaller id as well are removed.

Texts of equal words are one text here: their least document stands for all, so a group of copies
of any size costs its keys once. A text goes by a 64-bit name where only its own keys or windows are told apart
from others'; between documents texts travel packed (zstandard).

Defined results: null and wordless texts have no windows; a null id is larger than any other;
rows that repeat an id never take words from each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.llm.shared import brief_shuffles, drop, materialise
from emberlog.llm.words import WordHashes, sequences, slices

PAIR_ROUNDS = 3
LAST_ID = (1 << 63) - 1
#: Characters worked on at a time, and words whose hashes are remembered; both bound a worker's memory.
SLICE, REMEMBERED = 1_000_000, 150_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


@F.pandas_udf(T.BinaryType())
def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Texts as zstandard frames; null stays null."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for texts in batches:
        yield pd.Series([None if t is None else pack(t.encode()) for t in texts], dtype=object)


def _unpacked(column: pa.Array) -> list[str | None]:
    unpack = zstandard.ZstdDecompressor().decompressobj
    return [None if x is None else unpack().decompress(x).decode() for x in column.to_pylist()]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def span_hashes(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the word spans [lo, hi)."""
    n = len(h)
    inverse = _U(pow(int(_BASE), -1, 1 << 64))
    powers, back = np.empty(n + 1, np.uint64), np.empty(n + 1, np.uint64)
    powers[0] = back[0] = 1
    powers[1:], back[1:] = np.multiply.accumulate(np.full(n, _BASE)), np.multiply.accumulate(np.full(n, inverse))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * powers[:-1], out=sums[1:])
    return mixed((sums[hi] - sums[lo]) * back[lo] + (hi - lo).astype(np.uint64))


def recompress(h: np.ndarray, bounds: np.ndarray, rounds: int = PAIR_ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts after the rounds: name, and the span of words [lo, hi) that decides it.

    A span that needs what is beyond a text's end reaches one word outside of it. Spans rise from symbol to symbol.
    """
    n = len(h)
    text_start = np.zeros(n + 1, bool)
    text_start[bounds] = True
    head = np.flatnonzero(text_start[:n] | np.concatenate(([True], h[1:] != h[:-1])))
    ends = np.append(head[1:], n)
    names = mixed(h[head] + (ends - head).astype(np.uint64) * _BASE)
    lo, hi = head - 1, ends + 1  # a run ends where other words, or none, stand beside it
    first = text_start[head]
    for r in range(rounds):
        last = np.append(first[1:], True)
        right = (mixed(names + _U(r + 1)) & _U(1)).astype(bool)
        joins = ~right[:-1] & right[1:] & ~last[:-1]
        lo_at, hi_at = lo, hi
        before = np.where(first, lo - 1, np.concatenate((lo[:1], lo[:-1])))
        after = np.where(last, hi + 1, np.append(hi[1:], hi[-1:]))
        lo_at = np.where(right, np.minimum(lo, before), lo)
        hi_at = np.where(right, hi, np.maximum(hi, after))
        second = np.concatenate(([False], joins))
        begin = ~second
        opens = np.append(joins, False)[begin]
        at = np.flatnonzero(begin)
        nxt = np.minimum(at + 1, len(names) - 1)
        names = np.where(opens, mixed(names[at] * _U(3) + mixed(names[nxt])), names[at])
        lo, hi = np.where(opens, lo[at], lo_at[at]), np.where(opens, hi[nxt], hi_at[at])
        first = first[at]
    return names, lo, hi


def window_keys(h: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows and the key that each is filed under."""
    lengths = np.diff(bounds)
    counts = np.maximum(lengths - window + 1, 0)
    if not counts.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = np.repeat(bounds[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    _, lo, hi = recompress(h, bounds)
    ok = (hi - lo <= window) & (lo >= 0) & (hi <= len(h))
    lo, hi = lo[ok], hi[ok]
    keys = span_hashes(h, starts, starts + window)
    if len(lo):
        names = span_hashes(h, lo, hi)
        a, b = np.searchsorted(lo, starts, "left"), np.searchsorted(hi, starts + window, "right")
        has = b > a
        a, b = a[has], b[has]
        least, table, width = np.empty(len(a), np.uint64), names, 1
        span = b - a
        while True:
            now = (span >= width) & (span < 2 * width)
            least[now] = np.minimum(table[a[now]], table[b[now] - width])
            if span.max() < 2 * width:
                break
            table = np.minimum(table[:-width], table[width:]) if len(table) > width else table
            width *= 2
        keys[has] = least
    return starts, keys


def _survey(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = WordHashes(0, REMEMBERED)
    for batch in batches:
        for part in slices(batch, 2, limit=SLICE):
            words, bounds = sequences(part.column(2).to_pylist())
            h = seen.of(words)
            starts, keys = window_keys(h, bounds, window)
            cuts = np.searchsorted(starts, bounds)
            distinct = [np.unique(keys[a:b]).view(np.int64) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in distinct]))).astype(np.int32)
            values = np.concatenate(distinct) if distinct else np.zeros(0, np.int64)
            seqs = [hashlib.md5(b" ".join(words[a:b])).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(seqs, pa.string()), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                names=["id", "tie", "seq", "n_words", "keys"],
            )


def _windows(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, kind, packed text, wanted keys -> id, kind, the windows' 128 bits and their places."""
    seen, other = WordHashes(0, REMEMBERED), WordHashes(1, REMEMBERED)
    for batch in batches:
        for part in slices(batch, 2, zstandard.frame_content_size, SLICE):
            words, bounds = sequences(_unpacked(part.column(2)))
            h = seen.of(words)
            starts, keys = window_keys(h, bounds, window)
            text = np.searchsorted(bounds, starts, "right") - 1
            shared = part.column(3)
            sizes = np.diff(shared.offsets.to_numpy())
            wanted_text, wanted = np.repeat(np.arange(len(part)), sizes), shared.flatten().to_numpy().view(np.uint64)
            marked = np.isin(mixed(keys + mixed(text.astype(np.uint64))), mixed(wanted + mixed(wanted_text.astype(np.uint64))))
            at, rows = starts[marked], text[marked]
            h2 = other.of(words)
            a, b = span_hashes(h, at, at + window), span_hashes(h2, at, at + window)
            ids, kinds = (part.column(k).to_numpy(zero_copy_only=False)[rows] for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(kinds, pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array((at - bounds[rows]).astype(np.int32))],
                names=["id", "kind", "a", "b", "at"],
            )


def _kept(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1, zstandard.frame_content_size, SLICE):
            out: list[tuple] = []
            for text, everything, at in zip(_unpacked(part.column(1)), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                words = text.encode().split() if text else []
                n = len(words)
                if everything and n >= window:
                    kept = []
                elif at:
                    cover = np.zeros(n + 1, np.int64)
                    at = np.unique(np.array(at))
                    cover[at] += 1
                    cover[at + window] -= 1
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(cover[:n]) == 0)]
                else:
                    kept = words
                out.append((n, n - len(kept), b" ".join(kept).decode()))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])


def _removed(rows: DataFrame, window: int) -> DataFrame:
    """What to remove from texts (id, tie): all of it, or windows at these places. A text that loses nothing has no row.

    Each step is a table of its own: a join with a finished aggregate can be split where a key is hot, and what a step read goes.
    """
    survey = rows.select("id", "tie", "text").mapInArrow(lambda it: _survey(window, it), "id long, tie long, seq string, n_words long, keys array<long>")
    survey = materialise(survey.withColumn("kind", F.xxhash64("seq")), "survey")
    least = materialise(survey.groupBy("seq").agg(F.min(F.struct("id", "tie")).alias("least")), "least")
    names = survey.select("id", "tie", "kind", "seq").join(least, "seq").select("id", "tie", "kind", "seq", F.col("least.id").alias("least_id"), F.col("least.tie").alias("least_tie")).distinct()
    names = materialise(names, "names")
    first_of = (F.col("id") == F.col("least_id")) & (F.col("tie") == F.col("least_tie"))
    speakers = names.filter(first_of).select("id", "tie", "kind")

    own_keys = survey.filter(F.size("keys") > 0).select("id", "tie", "keys").join(speakers, ["id", "tie"]).select("kind", "keys").dropDuplicates(["kind"])
    own_keys = materialise(own_keys, "keys")
    drop(survey, least)
    keys = own_keys.select("kind", F.explode("keys").alias("key"))
    shared = materialise(keys.groupBy("key").agg(F.min("kind").alias("x"), F.max("kind").alias("y")).filter("x != y").select("key"), "shared")
    wanted = materialise(keys.join(shared, "key").groupBy("kind").agg(F.collect_set("key").alias("wanted")).join(speakers, "kind"), "wanted")
    drop(own_keys, shared)

    texts = rows.select("id", "tie", packed("text").alias("text"))
    candidates = texts.join(wanted.withColumnsRenamed({"id": "w_id", "tie": "w_tie"}), F.col("id").eqNullSafe(F.col("w_id")) & F.col("tie").eqNullSafe(F.col("w_tie")))
    windows = candidates.select("id", "kind", "text", "wanted").mapInArrow(lambda it: _windows(window, it), "id long, kind long, a long, b long, at int")
    windows = materialise(windows, "windows")
    drop(wanted)
    first = windows.groupBy("a", "b").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("a", "b", "first")
    first = materialise(first, "first")
    hits = windows.join(first, ["a", "b"]).filter("id > first").groupBy("id", "kind").agg(F.collect_list("at").alias("at"))
    partly = names.filter(F.col("id") == F.col("least_id")).select("id", "tie", "kind").join(hits, ["id", "kind"]).select("id", "tie", F.lit(False).alias("everything"), "at")
    copies = names.filter(F.col("id") > F.col("least_id")).select("id", "tie", F.lit(True).alias("everything"), F.lit(None).cast("array<int>").alias("at"))
    removed = materialise(copies.unionByName(partly), "removed")
    drop(windows, first, names)
    return removed


def remove_repeats(docs: DataFrame, *, window: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` (the words that stay, joined by a space), one row per document. ``doc_id`` is a whole number."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(F.col(text)).alias("tie"), F.col(text).alias("text"))
    with brief_shuffles(docs.sparkSession):
        removed = _removed(rows, window).withColumnsRenamed({"id": "r_id", "tie": "r_tie"})
    texts = rows.select("doc_id", "id", "tie", packed("text").alias("text"))
    judged = texts.join(removed, F.col("id").eqNullSafe(F.col("r_id")) & F.col("tie").eqNullSafe(F.col("r_tie")), "left")
    return judged.select("doc_id", "text", "everything", "at").mapInArrow(lambda it: _kept(window, it), "doc_id long, n_words long, n_removed long, kept_text string")
