"""Periodic runs: stretches of words that repeat with a small period, found, reported and collapsed to their first period.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least ``min_length`` words and
``min_periods`` periods long, that no neighbouring word extends with the period kept.

Method, for each document on its own: a suffix automaton is built over the words. Its states are visited from the longest to the
shortest; the ordered sets of end positions of the states that link to a state are merged, the smaller into the larger. Each position that
goes in gets neighbours, and a distance to one that is not above the state's length seeds a square: the state's words end at both
places and overlap or touch. A seed is extended to both sides while words one distance apart agree, which gives the run; what a run's multiple periods give too
is the same stretch, so the smallest period of a stretch stays.

An exact sieve goes first. In a run of L >= 24 and L >= 3q, any eight consecutive words occur again q words further or before, so
windows of eight words that occur once in their document are in no run. Automata are built only over maximal stretches of words in repeated
windows; a run, with the words that might extend it, lies within one such stretch. (Windows go by 64-bit sums; a collision costs time, never a result.)

Documents are independent of each other: one pass over the texts in Arrow batches, no shuffle, no state between tasks.

Defined results: null and empty texts have no words and no runs; repeated rows are each answered alike; ties between runs do not arise,
as start and period tell them apart; other columns stay as they are, whatever their names (``collapse``), or are left out (``find_runs``). A long text costs
8 bytes a word, its distinct words once, and about 100 bytes for each word of its longest repeated stretch.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.llm.words import slices, word_slices

MIN_LENGTH, MIN_PERIODS = 24, 3
#: Words in the sieve's windows. A third of the least length: see above.
SIEVE = 8
_WEIGHTS = np.random.default_rng(13).integers(1, 1 << 62, SIEVE, dtype=np.int64) * 2 + 1
_CHUNK = 1024

RUN = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])
ARROW_RUNS = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))


class Places:
    """An ordered set of positions, in sorted chunks so that an insertion moves little however many there are."""

    __slots__ = ("chunks", "firsts", "size")

    def __init__(self, place: int):
        self.chunks, self.firsts, self.size = [[place]], [place], 1

    def __iter__(self) -> Iterator[int]:
        for chunk in self.chunks:
            yield from chunk

    def add(self, x: int) -> tuple[int | None, int | None]:
        """Insert ``x``, which is not in the set, and return its neighbours."""
        c = max(bisect_right(self.firsts, x) - 1, 0)
        chunk = self.chunks[c]
        at = bisect_left(chunk, x)
        before = chunk[at - 1] if at else (self.chunks[c - 1][-1] if c else None)
        after = chunk[at] if at < len(chunk) else (self.firsts[c + 1] if c + 1 < len(self.firsts) else None)
        chunk.insert(at, x)
        self.firsts[c] = chunk[0]
        self.size += 1
        if len(chunk) > 2 * _CHUNK:
            self.chunks[c : c + 1] = [chunk[:_CHUNK], chunk[_CHUNK:]]
            self.firsts.insert(c + 1, chunk[_CHUNK])
        return before, after


def suffix_automaton(words: Sequence[int]) -> tuple[array, array, array]:
    """Length, suffix link and end position (-1 for a split state) of each state; state 0 is the root.

    Most states have one transition, which lies in arrays; further ones are in a dictionary of those states alone.
    """
    most = 2 * len(words) + 1
    length, link, end = array("q", bytes(8 * most)), array("q", bytes(8 * most)), array("q", [-1]) * most
    word, target = array("q", [-1]) * most, array("q", bytes(8 * most))
    more: dict[int, dict[int, int]] = {}
    link[0] = -1
    size, last = 1, 0
    for i, w in enumerate(words):
        cur, size = size, size + 1
        length[cur], end[cur] = i + 1, i
        p, q = last, -1
        while p >= 0:
            if word[p] == w:
                q = target[p]
                break
            if word[p] < 0:
                word[p], target[p] = w, cur
            else:
                others = more.setdefault(p, {})
                if w in others:
                    q = others[w]
                    break
                others[w] = cur
            p = link[p]
        if q < 0:
            link[cur] = 0
        elif length[q] == length[p] + 1:
            link[cur] = q
        else:
            split, size = size, size + 1
            length[split], link[split] = length[p] + 1, link[q]
            word[split], target[split] = word[q], target[q]
            if q in more:
                more[split] = dict(more[q])
            while p >= 0:
                if word[p] == w:
                    if target[p] != q:
                        break
                    target[p] = split
                elif p in more and more[p].get(w) == q:
                    more[p][w] = split
                else:
                    break
                p = link[p]
            link[q] = link[cur] = split
        last = cur
    return length[:size], link[:size], end[:size]


def squares(words: Sequence[int]) -> Iterator[tuple[int, int]]:
    """``(place, distance)`` of seeds: the same words, at least ``distance`` of them, end at ``place`` and at ``place + distance``."""
    length, link, end = suffix_automaton(words)
    sets: dict[int, Places] = {}
    for v in np.argsort(-np.frombuffer(length, np.int64), kind="stable").tolist():
        if not v:
            continue
        if end[v] >= 0:  # a prefix of the text: its own end position goes in as one more child's set
            own = sets.get(v)
            if own is None:
                sets[v] = Places(end[v])
            else:
                yield from _seeds(own, (end[v],), length[v])
        p, mine = link[v], sets.pop(v)
        if not p:
            continue  # the root's words are none, so that it seeds nothing
        theirs = sets.get(p)
        if theirs is None:
            sets[p] = mine
            continue
        if theirs.size < mine.size:
            sets[p], mine, theirs = mine, theirs, mine
        yield from _seeds(theirs, mine, length[p])


def _seeds(into: Places, places: Sequence[int] | Places, most: int) -> Iterator[tuple[int, int]]:
    for x in places:
        before, after = into.add(x)
        if before is not None and x - before <= most:
            yield before, x - before
        if after is not None and after - x <= most:
            yield x, after - x


def runs_of(words: Sequence[int], min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of a sequence, by start and period."""
    n, found, best = len(words), {}, {}
    for place, d in squares(words):
        known = found.setdefault(d, [])
        at = bisect_right(known, (place, n)) - 1
        if at >= 0 and place <= known[at][1]:
            continue
        first = last = place  # words d apart agree from first to last
        while first and words[first - 1] == words[first - 1 + d]:
            first -= 1
        while last + 1 + d < n and words[last + 1] == words[last + 1 + d]:
            last += 1
        insort(known, (first, last))
        size = last - first + 1 + d
        if size >= max(min_length, min_periods * d):
            best[first, size] = min(d, best.get((first, size), d))
    return sorted((start, size, d) for (start, size), d in best.items())


def stretches(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the maximal stretches of words that lie in windows of SIEVE words found twice or more in their document.

    ``ids``: the words of documents in a row; ``starts``: where each document starts, and the end of the last.
    """
    n = len(ids) - SIEVE + 1
    none = np.empty(0, np.int64)
    if n <= 1:
        return none, none
    sizes = np.diff(starts)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    windows = doc[:n] * np.int64(0x9E3779B97F4A7C1 * 2 + 1)
    for k, weight in enumerate(_WEIGHTS):
        windows += (ids[k : n + k] + 1) * weight
    inside = doc[:n] == doc[SIEVE - 1 :]
    order = np.argsort(windows, kind="stable")
    order = order[inside[order]]
    equal = windows[order[1:]] == windows[order[:-1]]
    again = np.zeros(n, bool)
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    if not again.any():
        return none, none
    cover = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + SIEVE, -1)
    covered = np.cumsum(cover[:-1]) > 0
    fresh = np.zeros(len(ids), bool)
    fresh[starts[:-1][starts[:-1] < len(ids)]] = True
    begins = covered & (np.r_[True, ~covered[:-1]] | fresh)
    stops = covered & np.r_[~covered[1:] | fresh[1:], True]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


class _Ids(dict):
    """Numbers of words, in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = len(self)
        return value


def runs_of_texts(texts: Sequence[str | None]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Number of words and runs of each text."""
    ids, parts, starts = _Ids(), [], [0]
    for text in texts:
        n = 0
        for words in word_slices(text):
            parts.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
            n += len(words)
        starts.append(starts[-1] + n)
    bounds = np.array(starts, np.int64)
    out: list[tuple[int, list]] = [(int(n), []) for n in np.diff(bounds)]
    if not parts:
        return out
    row = np.concatenate(parts)
    begins, ends = stretches(row, bounds)
    docs = np.searchsorted(bounds, begins, "right") - 1
    for b, e, d in zip(begins.tolist(), ends.tolist(), docs.tolist()):
        if e - b >= MIN_LENGTH:
            shift = b - starts[d]
            out[d][1].extend((s + shift, n, q) for s, n, q in runs_of(row[b:e].tolist()))
    return out


def collapsed(text: str | None, n_words: int, runs: list[tuple[int, int, int]]) -> str:
    """The text's words, joined by one space, without what a run has after its first period."""
    kept = np.ones(n_words, bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    at, parts = 0, []
    for words in word_slices(text):
        part = b" ".join(compress(words, kept[at : at + len(words)].tolist()) if runs else words)
        parts += [part] if part else []
        at += len(words)
    return b" ".join(parts).decode()


def _found(with_text: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches without their last column, a text, and with what was found in it."""
    for batch in batches:
        for part in slices(batch, batch.num_columns - 1):
            texts = part.column(batch.num_columns - 1).to_pylist()
            found = runs_of_texts(texts)
            columns = {"emberlog_n_words": pa.array([n for n, _ in found], pa.int64()), "emberlog_runs": pa.array([[dict(zip(("start", "length", "period"), r)) for r in runs] for _, runs in found], ARROW_RUNS)}
            if with_text:
                columns["emberlog_collapsed"] = pa.array([collapsed(t, *f) for t, f in zip(texts, found)], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns.values()], names=[*part.schema.names[:-1], *columns])


def _apply(rows: DataFrame, with_text: bool) -> DataFrame:
    fields = [*rows.schema.fields[:-1], T.StructField("emberlog_n_words", T.LongType()), T.StructField("emberlog_runs", T.ArrayType(RUN))]
    return rows.mapInArrow(partial(_found, with_text), T.StructType([*fields, *([T.StructField("emberlog_collapsed", T.StringType())] if with_text else [])]))


def find_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, runs`` (array of start, length, period, by start and period), one row per document; ``with_text`` adds ``collapsed``."""
    found = _apply(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), with_text)
    return found.select("doc_id", F.col("emberlog_n_words").alias("n_words"), F.col("emberlog_runs").alias("runs"), *([F.col("emberlog_collapsed").alias("collapsed")] if with_text else []))


def collapse(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The documents with all their columns; texts with runs become their kept words joined by one space, others stay as they are."""
    found = _apply(docs.select(F.struct(*docs.columns).alias("emberlog_row"), F.col(text).alias("emberlog_text")), True)
    new = F.when(F.size("emberlog_runs") > 0, F.col("emberlog_collapsed")).otherwise(F.col("emberlog_row")[text])
    return found.select(*(new.alias(c) if c == text else F.col("emberlog_row")[c].alias(c) for c in docs.columns))


def strongest(runs: Column) -> Column:
    """The run of greatest exact length / period; ties go to the smallest start, then period. Null without runs. ``runs`` come by start and period."""
    better = lambda best, run: best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, run: F.when(better(best, run), run).otherwise(best))
