"""Quality rules with host verdicts.

Each document is held against base rules. Per host (source) the failures are counted, and the
rate is shrunk towards all hosts by an empirical beta prior: its mean is the overall rate, its
strength comes from how much the hosts' rates differ (method of moments). A host whose shrunk
rate is above ``max_host_rate`` is rejected, and with it all its documents.

Text figures come from an Arrow UDF over whole texts; the host table is one small aggregate
(combined before the shuffle) that is written out, so the join back broadcasts it only when its
measured size is under Spark's broadcast threshold.

Defined results: a null text has no words and so fails; a null source is no host and gets no
host verdict; repeated rows count as often as they occur; a very long text costs 8 bytes a word and its lines.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.llm.shared import materialise
from emberlog.llm.words import SLICE_CHARS, word_slices

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS = 10
REPEAT_WINDOW = 5
_WEIGHTS = np.random.default_rng(5).integers(1, 1 << 63, REPEAT_WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MAX_REPEAT_PERCENT = 20

FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(hashes: np.ndarray) -> int:
    """Words in windows of REPEAT_WINDOW words that occur twice or more, all occurrences counted. ``hashes``: 64 bits a word.

    A window goes by a sum of its words' hashes with odd weights, so two that differ are one with a chance of 2^-64.
    """
    n, k = len(hashes), REPEAT_WINDOW
    if n <= k:
        return 0
    windows = np.zeros(n - k + 1, np.uint64)
    for i, weight in enumerate(_WEIGHTS):
        windows += hashes[i : n - k + 1 + i] * weight
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    marked = np.isin(windows, twice)
    covered = np.zeros(n, bool)
    for i in range(k):
        covered[i : n - k + 1 + i] |= marked
    return int(covered.sum())


def figures(text: str | None, limit: int = SLICE_CHARS) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text. Of a very long text the hashes of words are kept (8 bytes each), not the words."""
    if not text:
        return 0, 0, 0, 0, 0
    parts = [np.fromiter(map(hash, words), np.int64, len(words)) for words in word_slices(text, limit)]
    hashes = (np.concatenate(parts) if len(parts) > 1 else parts[0]).view(np.uint64)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.encode().split(None, 1)] if "\n" in text else []
    return len(hashes), chars, symbols, len(lines) - len(set(lines)), repeat_words(hashes)


@F.pandas_udf(T.StructType([T.StructField(x, T.LongType()) for x in FIGURES]))
def text_figures(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([figures(t) for t in texts], columns=list(FIGURES), dtype="int64")


def with_figures(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    rows = docs.select(*keep, text_figures(F.col(text)).alias("_emberlog_f"))
    failed = (F.col("_emberlog_f.n_words") < MIN_WORDS) | (100 * F.col("_emberlog_f.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_emberlog_f.n_words"))
    return rows.withColumn("_emberlog_failed", failed)


def host_rates(failures: DataFrame, host: str, failed: str) -> DataFrame:
    """``host, n, k, rate``: documents, failures and shrunk failure rate of every host that has a name."""
    hosts = failures.filter(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.sum(F.col(failed).cast("long")).alias("k"))
    hosts = materialise(hosts, "hosts")
    fails, total, inverse = hosts.agg(F.sum("k"), F.sum("n"), F.avg(F.lit(1.0) / F.col("n"))).first()
    mean = (fails or 0) / total if total else 0.0
    spread = hosts.agg(F.avg(F.pow(F.col("k") / F.col("n") - F.lit(mean), 2))).first()[0] or 0.0
    noise = mean * (1 - mean)
    between = max(spread - noise * (inverse or 0.0), noise * 1e-6)
    strength = max(noise / between - 1, 1.0) if between > 0 else 1.0
    return hosts.select("host", "n", "k", ((F.col("k") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))).alias("rate"))


def rejected_hosts(failures: DataFrame, host: str, failed: str, max_host_rate: float) -> DataFrame:
    return materialise(host_rates(failures, host, failed).filter(F.col("rate") > max_host_rate).select("host"), "rejected")


def judge(docs: DataFrame, *, max_host_rate: float = 0.8, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """``doc_id``, the figures, ``base_failed`` and ``kept``, one row per document."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("source"), F.col(text).alias("text"))
    rows = materialise(with_figures(rows, "text", ["doc_id", "source"]), "figures")
    bad = rejected_hosts(rows, "source", "_emberlog_failed", max_host_rate).withColumn("bad", F.lit(True))
    rows = rows.join(bad, rows["source"] == bad["host"], "left")
    kept = ~F.col("_emberlog_failed") & F.col("bad").isNull()
    return rows.select("doc_id", *(F.col(f"_emberlog_f.{x}") for x in FIGURES), F.col("_emberlog_failed").alias("base_failed"), kept.alias("kept"))


def keep_good(docs: DataFrame, *, max_host_rate: float = 0.8, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns. Two passes over the texts, and no shuffle of them."""
    failures = with_figures(docs.select(F.col(host).alias("host"), F.col(text).alias("text")), "text", ["host"]).select("host", "_emberlog_failed")
    bad = rejected_hosts(failures, "host", "_emberlog_failed", max_host_rate).withColumnRenamed("host", "_emberlog_host")
    good = with_figures(docs, text, docs.columns).filter("not _emberlog_failed").select(*docs.columns)
    return good.join(bad, good[host] == bad["_emberlog_host"], "left_anti")
