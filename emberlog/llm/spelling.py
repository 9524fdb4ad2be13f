"""Spelling variants: words one edit apart, the commoner form of each, and the root that its forms lead to.

Two words are near if one inserted, deleted or replaced character makes one the other. An edit at position j leaves the j characters before it
and all behind it as they are. So the near words of a word at j are the points of a rectangle: in the vocabulary sorted forwards, words with the same
first j characters are an interval; sorted by reversed words, those with the same end are one; and the words in both are found by
two-dimensional range reporting with a wavelet tree over the reverse ranks in forward order. Each length has its own trees: a replaced
character is looked for among words of a word's length, an inserted one among words one longer (a deleted one is that link from its other end).

Spark partitions the trees. All positions of a word form two windows, of its first and its second half; an edit in one leaves the other half whole,
so words are grouped by (length, window, what is outside of the window), and only words of one group can be near. A group of more than
``MAX_GROUP`` words is split by halving its window, at worst to one position, where a group is no larger than the alphabet: no word
is dropped and no group grows with the vocabulary. Groups are range-partitioned by their keys, so that a task's trees each cover many groups of one length and window. Tasks
give one row a word (links, commonest near word), not the links. Rows are written to the shared folder before they are refined.

The form of a word is its near word of largest count (ties: first in code-point order) if that has at least twice the word's count. Counts
double at each step to a form, so chains are short; pointer doubling over tables finds their ends.

Defined results: null and empty texts have no words; a null id is no part of a name (see ``with_made_slips``); repeated rows count as often as they occur;
words and texts may be of any length (a tree takes the words of a group at least, so a chunk has ``CHUNK_CHARS`` characters or one group); an empty table gives none;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.shared import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A maximal run of letters, after A-Z are lower-cased.
RUN = r"[a-zÀ-ÿ]+"
MIN_CHARS, MIN_COUNT = 5, 3
#: A form has at least so many times the word's count.
RATIO = 2
#: Groups above this size are split. A chunk of groups that one tree covers has about so many characters.
MAX_GROUP, CHUNK_CHARS = 20_000, 400_000
_KEY = ("longer", "points", "a", "b", "head", "tail")


def letter_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, run``: each run of letters of each whole text, with A-Z lower-cased."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"))


def vocabulary(words: DataFrame, word: str = "word", *, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n``: the distinct words of enough characters and occurrences."""
    counts = words.select(F.col(word).alias("word")).filter(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= min_count)


# Wavelet trees


class WaveletTree:
    """Reports the values of a range of places that lie in a range of values. ``values``: a permutation of 0 .. n - 1."""

    def __init__(self, values: np.ndarray):
        self.bits = max(int(len(values) - 1).bit_length(), 1)
        self.before: list[np.ndarray] = []
        for bit in range(self.bits - 1, -1, -1):
            ones = (values >> bit & 1).astype(bool)
            self.before.append(np.r_[0, np.cumsum(~ones)])  # zeros before each place
            values = np.concatenate([values[~ones], values[ones]])

    def report(self, first: np.ndarray, last: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For all rectangles [first, last) x [low, high) at once: the numbers of the rectangles, and a value in each."""
        asked = np.flatnonzero((first < last) & (low < high))
        l, r, value = first[asked], last[asked], np.zeros(len(asked), np.int64)  # noqa: E741
        for level, before in enumerate(self.before):
            half, zeros = 1 << (self.bits - 1 - level), before[-1]
            l0, r0 = before[l], before[r]
            l1, r1 = l - l0 + zeros, r - r0 + zeros
            left = (l0 < r0) & (low[asked] < value + half)
            right = (l1 < r1) & (high[asked] > value + half)
            # a node's values below ``low`` or from ``high`` on are cut as soon as all of them are
            left &= high[asked] > value
            right &= low[asked] < value + 2 * half
            asked = np.concatenate([asked[left], asked[right]])
            value = np.concatenate([value[left], value[right] + half])
            l, r = np.concatenate([l0[left], l1[right]]), np.concatenate([r0[left], r1[right]])  # noqa: E741
        inside = (low[asked] <= value) & (value < high[asked])
        return asked[inside], value[inside]


def _letters(words: list[str], size: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), size).astype(np.int64)


def _classes(letters: tuple[np.ndarray, ...], columns: tuple[Iterator[int], ...], steps: int) -> list[tuple[np.ndarray, ...]]:
    """After each of 0 .. ``steps`` characters, taken from the given columns, the class of each word of each matrix: equal if those characters are, and in their order."""
    cuts = np.cumsum([len(x) for x in letters])[:-1]
    ids = np.zeros(sum(map(len, letters)), np.int64)
    out = [tuple(np.split(ids, cuts))]
    for _, *at in zip(range(steps), *columns):
        joined = ids << 21 | np.concatenate([x[:, c] for x, c in zip(letters, at)])
        ids = np.unique(joined, return_inverse=True)[1].reshape(-1)
        out.append(tuple(np.split(ids, cuts)))
    return out


def links(asking: list[str], points: list[str], longer: bool, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (number in ``asking``, number in ``points``) of near words whose edit is at a position from a to b - 1, each pair once.

    All words of ``asking`` have one length, all of ``points`` that length too, or with ``longer`` one more. Not ``longer``: both lists are one.
    """
    none = np.empty(0, np.int64)
    if not asking or not points:
        return none, none
    m = len(points[0])
    q, p = _letters(asking, m - longer), _letters(points, m)
    heads = _classes((q, p), (iter(range(m)), iter(range(m))), b - 1)
    tails = _classes((q, p), (iter(range(m - longer - 1, -1, -1)), iter(range(m - 1, -1, -1))), m - 1 - a)
    forward = np.lexsort(p.T[::-1])
    backward = np.lexsort(p.T)
    rank = np.empty(len(p), np.int64)
    rank[backward] = np.arange(len(p))
    tree = WaveletTree(rank[forward])
    found = []
    for j in range(a, b):
        (q_head, p_head), (q_tail, p_tail) = heads[j], tails[m - 1 - j]
        p_head, p_tail = p_head[forward], p_tail[backward]
        first, last = np.searchsorted(p_head, q_head), np.searchsorted(p_head, q_head, "right")
        low, high = np.searchsorted(p_tail, q_tail), np.searchsorted(p_tail, q_tail, "right")
        if not longer:  # an interval of one word is the word itself
            last = np.where((last - first == 1) | (high - low == 1), first, last)
        one, value = tree.report(first, last, low, high)
        other = backward[value]
        # one word longer: of equal characters in a row, any may be the inserted one; the first stands for all
        good = one != other if not longer else (p[other, j] != p[other, j - 1]) if j else np.ones(len(one), bool)
        found.append((one[good], other[good]))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _summary(words: list[str], counts: np.ndarray, one: np.ndarray, other_words: list[str], other_counts: np.ndarray, other: np.ndarray) -> pd.DataFrame:
    """For each word with links: their number, and the linked word of largest count (ties: first in order)."""
    order = np.argsort(np.array(other_words, dtype=object), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    by = np.lexsort((place[other], -other_counts[other], one))
    one, other = one[by], other[by]
    heads = np.flatnonzero(np.r_[True, one[1:] != one[:-1]]) if len(one) else np.empty(0, np.int64)
    return pd.DataFrame({"word": [words[i] for i in one[heads]], "near": np.diff(np.r_[heads, len(one)]), "best_n": other_counts[other[heads]], "best": [other_words[i] for i in other[heads]]})


def _near_of_chunk(chunk: pd.DataFrame, longer: bool, a: int, b: int) -> list[pd.DataFrame]:
    point = chunk["point"].to_numpy(bool) if longer else np.ones(len(chunk), bool)
    words, counts = chunk["word"].to_numpy(object), chunk["n"].to_numpy(np.int64)
    points, point_n = words[point].tolist(), counts[point]
    asking, asking_n = (words[~point].tolist(), counts[~point]) if longer else (points, point_n)
    one, other = links(asking, points, longer, a, b)
    out = [_summary(asking, asking_n, one, points, point_n, other)]
    return out + ([_summary(points, point_n, other, asking, asking_n, one)] if longer else [])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group. A chunk ends where length or window change, and where a group does once the chunk has CHUNK_CHARS."""
    schema = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
    held: list[pd.DataFrame] = []
    last = None

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            first = held[0].iloc[0]
            for found in _near_of_chunk(pd.concat(held, ignore_index=True), bool(first["longer"]), int(first["a"]), int(first["b"])):
                if len(found):
                    yield pa.RecordBatch.from_pandas(found, schema, preserve_index=False)
            held.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch.to_pandas()
        keys = [rows[c].to_numpy(object) for c in _KEY]
        fresh = [np.r_[last is None or k[0] != last[i], k[1:] != k[:-1]].astype(bool) for i, k in enumerate(keys)]
        tree, group = np.logical_or.reduce(fresh[:4]), np.logical_or.reduce(fresh)
        last = [k[-1] for k in keys]
        groups = np.flatnonzero(group)
        ends = [*np.flatnonzero(tree).tolist(), len(rows)]
        for start, end in zip([0, *ends[:-1]] if ends[0] else ends[:-1], ends if ends[0] else ends[1:]):
            if tree[start]:
                yield from flush()
            while start < end:
                missing = CHUNK_CHARS - sum(map(len, held)) * int(keys[1][start])
                if missing <= 0 and group[start]:
                    yield from flush()
                    continue
                at = np.searchsorted(groups, max(start + 1, start - (-missing // int(keys[1][start]))))
                cut = min(int(groups[at]), end) if at < len(groups) else end
                held.append(rows.iloc[start:cut])
                start = cut
    yield from flush()


# Groups of words in Spark


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds what of a word is outside of its window. In a word that is one shorter than the points, positions behind the edit are one less."""
    short = F.col("longer") & ~F.col("point")
    tail = F.col("b") + F.when(short, 0).otherwise(1)
    return rows.withColumn("head", F.expr("substring(word, 1, a)")).withColumn("tail", F.substring("word", tail, F.length("word")))


def _windows(vocabulary: DataFrame) -> DataFrame:
    """Six rows a word: both halves, as a word among those of its length, as the shorter and as the longer of two."""
    size = F.length("word")
    roles = [(False, True, size), (True, False, size + 1), (True, True, size)]
    role = F.explode(F.array(*(F.struct(F.lit(longer).alias("longer"), F.lit(point).alias("point"), points.alias("points")) for longer, point, points in roles)))
    rows = vocabulary.select("word", "n", role.alias("r")).select("word", "n", "r.*", F.lit(0).alias("a"), F.col("r.points").alias("b"))
    return _halved(rows)


def _halved(rows: DataFrame) -> DataFrame:
    """Each row as two rows with the halves of its window [a, b)."""
    middle = F.expr("(a + b) div 2").cast("int")
    halves = F.explode(F.array(F.struct(F.col("a").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b").alias("b"))))
    return _keyed(rows.withColumn("half", halves).select("word", "n", "longer", "point", "points", "half.a", "half.b").filter("a < b"))


def grouped(vocabulary: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """Words with group keys; the groups have ``max_group`` words at most, or one position to edit."""
    rows, parts = materialise(_windows(vocabulary), "windows"), []
    while True:
        large = materialise(rows.groupBy(*_KEY).agg(F.count("*").alias("size")).filter((F.col("size") > max_group) & (F.col("b") - F.col("a") > 1)).select(*_KEY), "large")
        if large.isEmpty():
            break
        parts.append(rows.join(large, list(_KEY), "left_anti"))
        rows = materialise(_halved(rows.join(large, list(_KEY), "left_semi")), "windows")
    for part in parts:
        rows = rows.unionByName(part)
    return rows


def near_words(vocabulary: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """``word, n, n_near, form, form_n`` of each word of a vocabulary (``word``, each once, and ``n``)."""
    rows = grouped(vocabulary, max_group).repartitionByRange(*_KEY).sortWithinPartitions(*_KEY)
    found = rows.mapInArrow(_near, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("word"))).alias("best")
    found = found.groupBy("word").agg(F.sum("near").alias("n_near"), best)
    enough = -F.col("best.minus") >= RATIO * F.col("n")
    return vocabulary.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n"))


def with_roots(words: DataFrame) -> DataFrame:
    """Adds ``root``: from a word, follow forms to the last; the word itself if it has none. Pointer doubling over the words that have a form."""
    ways = materialise(words.filter("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "roots")
    while not ways.filter("open").isEmpty():
        jumps = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = ways.filter("open").join(jumps, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("open"))
        ways = materialise(ways.filter("not open").unionByName(moved), "roots")
    return words.join(ways.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(vocabulary: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each word of a vocabulary."""
    words = materialise(vocabulary, "vocabulary")
    return with_roots(materialise(near_words(words, max_group), "near")).select("word", "form", "root", "n", "n_near", "form_n")


def corrected(words: DataFrame, variants: DataFrame, word: str = "word") -> DataFrame:
    """``words`` with ``root`` beside each word: the root of a word of the vocabulary, other words as they are."""
    roots = variants.filter("root <> word").select(F.col("word").alias("_emberlog_word"), F.col("root").alias("_emberlog_root"))
    return words.join(roots, F.col(word) == F.col("_emberlog_word"), "left").withColumn("root", F.coalesce("_emberlog_root", word)).drop("_emberlog_word", "_emberlog_root")


def slip(run: Column, doc_id: Column, one_in: int = 97) -> Column:
    """The run with one character deleted if ``one_in`` divides h, the unsigned CRC-32 of ``<doc_id>:<run>``: that at place h % length. A null id deletes nothing."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)
