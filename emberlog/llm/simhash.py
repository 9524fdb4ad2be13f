"""SimHash near-dedup by anchor-point covering.

A fingerprint has 64 bits. Of two that differ in ``max_bits`` t of them or fewer, each half of 32 bits takes a
share. There are two cases for each half.

- The half differs in one bit at most. 31 of its bits are covered by the Hamming code [31, 26], whose words are
  the anchors (covering radius 1), and its last bit stands for itself. A fingerprint's home is the anchor
  nearest to it; it is copied to every anchor within covering radius plus threshold, 1 + 1 = 2 (about 17 of the 2^27
  anchors). The nearest anchor of one is within radius + threshold of the other. The other half then differs in
  t - 1 bits at most, so that one of t blocks of it is equal in both: the block's bits are part of the anchor.
- The half is equal in both (radius and threshold 0: it is its own anchor). The other half differs in t bits at
  most, and one of t + 1 blocks of it, again part of the anchor, is equal.

For t = 2 one bit in either half is one case, so anchors of one half are enough: 42 rows a fingerprint, and an anchor
says 43 bits or more, so that two fingerprints that are not close hardly ever meet. The
comparison of homes with copies, anchor by anchor, finds every pair; only pairs within the threshold leave the
join. Homes and copies are read from a table, and a hot anchor is a skewed join, which adaptive execution splits. Linked
fingerprints become groups by distributed connected components over distinct fingerprints; exact
copies of a fingerprint are one node, so groups of copies of any size add no pairs.

Parameters: ``shingle`` words to a shingle, ``max_bits`` (0 to 3; more would need a third case and is refused).
Defined results: texts without words (null, too) have fingerprint zero and link
like any other; a null id is passed over when the least id of a group is taken, and a group without
any id has a null component; rows that repeat an id are links of one group if their texts are; a very long text is
worked on in slices, which hold its words and shingles a few million characters at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.llm.components import connected_components
from emberlog.llm.shared import materialise
from emberlog.llm.words import SLICE_CHARS, word_slices

SEED = 42
CODE_BITS = 31


def fingerprint(text: str | None, shingle: int = 3, limit: int = SLICE_CHARS) -> int:
    """SimHash of a whole text, as a signed 64-bit integer: a bit is set if it is in over half of the shingles' XXH64."""
    digest, ones, total, carry = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64), 0, []

    def count(hashes: list[int]) -> None:
        nonlocal ones, total
        h = np.array(hashes, dtype="<u8")
        for i in range(0, len(h), 1 << 16):
            ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(h)

    for part in word_slices(text, limit):
        words = carry + [w.lower() for w in part] if carry else b" ".join(part).lower().split()
        carry = words[max(0, len(words) - shingle + 1) :] if shingle > 1 else []
        if len(words) >= shingle:
            joined = memoryview(b" ".join(words))
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = np.concatenate(([0], ends[:-1]))
            last = len(words) - shingle + 1
            count([digest(joined[a:b], SEED) for a, b in zip(starts[:last].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)])
    if not total and carry:  # fewer words than a shingle has
        count([digest(b" ".join(carry), SEED)])
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def _syndromes(values: np.ndarray) -> np.ndarray:
    """Syndromes of 31-bit words under the Hamming code whose column at bit i is i + 1: zero for a code word, else the wrong bit + 1."""
    s = np.zeros(len(values), dtype=np.int64)
    for i in range(CODE_BITS):
        s ^= np.where((values >> i) & 1, i + 1, 0)
    return s


def home_anchors(half: np.ndarray) -> np.ndarray:
    """The nearest anchor of each half (31 coded bits and one that stands for itself)."""
    s = _syndromes(half & ((1 << CODE_BITS) - 1))
    return half ^ np.where(s > 0, np.int64(1) << np.maximum(s - 1, 0), 0)


def near_anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, anchor) of all anchors within covering radius + 1: the code word at most 2 bits away in the coded part
    with the last bit as it is, or the nearest code word with the last bit turned."""
    n, low = len(half), half & ((1 << CODE_BITS) - 1)
    s, home = _syndromes(low), home_anchors(half)
    index, anchors = [np.arange(n), np.arange(n)], [home, home ^ (np.int64(1) << CODE_BITS)]
    for i in range(CODE_BITS):  # the code words at distance 2: bits i and j with columns that sum to the syndrome
        j = ((i + 1) ^ s) - 1
        ok = (s > 0) & (j > i)
        index.append(np.flatnonzero(ok))
        anchors.append(half[ok] ^ (np.int64(1) << i) ^ (np.int64(1) << j[ok]))
    return np.concatenate(index), np.concatenate(anchors)


def _block(half: np.ndarray, k: int, n: int) -> np.ndarray:
    """Bits of the k-th of n blocks of a half, with the block's number."""
    low, high = 32 * k // n, 32 * (k + 1) // n
    return ((half >> low) & ((1 << (high - low)) - 1)) | (k << 32)


#: What a row is at its anchor: its home, a copy, or both (equal halves).
HOME, COPY, BOTH = 1, 2, 3


def _copies(max_bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchor as two numbers: the half's anchor with the case's number, and the other half's block with the block's number."""

    def rows(case: int, anchor: np.ndarray, block: np.ndarray, fp: np.ndarray, role: int) -> pa.RecordBatch:
        columns = [anchor | np.int64(case << 32), block, fp, np.full(len(fp), role, np.int8)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "block", "fp", "role"])

    for batch in batches:
        f = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        bits = f.view(np.uint64)
        halves = [((bits >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF)).astype(np.int64) for side in (0, 1)]
        for side in (0, 1):
            half, other = halves[side], halves[1 - side]
            for k in range(max_bits + 1):
                yield rows(2 + side, half, _block(other, k, max_bits + 1), f, BOTH)
            if max_bits > 1 and (side == 0 or max_bits > 2):
                index, anchors = near_anchors(half)
                homes = home_anchors(half)
                for k in range(max_bits):
                    block = _block(other, k, max_bits)
                    yield rows(side, homes, block, f, HOME)
                    yield rows(side, anchors, block[index], f[index], COPY)


def linked_pairs(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Pairs (a > b) of the distinct values of ``fp`` that differ in ``max_bits`` bits or fewer."""
    if not 0 <= max_bits <= 3:
        raise ValueError("max_bits must be 0 to 3")
    copies = materialise(fps.mapInArrow(lambda it: _copies(max_bits, it), "anchor long, block long, fp long, role byte"), "anchors")
    homes = copies.filter(F.col("role") != COPY).select("anchor", "block", F.col("fp").alias("a"))
    near = copies.filter(F.col("role") != HOME).select("anchor", "block", F.col("fp").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    met = homes.join(near, ["anchor", "block"]).filter(close & (F.col("a") != F.col("b")))
    return met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def groups(rows: DataFrame, max_bits: int = 2) -> DataFrame:
    """Adds ``component_id`` to ``rows`` (with ``doc_id``, ``fp``): the least doc_id that links reach."""
    fps = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    parts = connected_components(linked_pairs(fps.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    named = fps.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = materialise(named, "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.join(named.select("fp", "component").join(least, "component").select("fp", "component_id", "component"), "fp")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, *, max_bits: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id``, one row per document."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text)).alias("fp"))
    out = groups(materialise(rows, "fingerprints"), max_bits)
    return out.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, max_bits: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, with all its columns: the one with the least id (null last; ties by the text's hash)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("tie"), fingerprints(F.col(text)).alias("fp"))
    named = groups(materialise(rows, "fingerprints"), max_bits)
    first = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("first"))
    first = first.select(F.col("first.doc_id").alias("_emberlog_id"), F.col("first.tie").alias("_emberlog_tie"))
    marked = docs.withColumn("_emberlog_text_tie", F.xxhash64(F.col(text)))
    alike = marked[doc_id].eqNullSafe(first["_emberlog_id"]) & (marked["_emberlog_text_tie"] == first["_emberlog_tie"])
    return marked.join(first, alike, "left_semi").dropDuplicates([doc_id, "_emberlog_text_tie"]).select(*docs.columns)
