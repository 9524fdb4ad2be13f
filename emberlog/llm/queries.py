"""The queries of this subpackage, each over its whole tables, and the same results in SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import classifier, decontaminate, line_dedup, main_text, mixing, periodic_runs, pii, quality_rules, simhash, spelling, substring_dedup, url_filter, warc
from emberlog.llm.shared import WORD


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1_mix_sources that SQL can say too."""
    return mixing.targets(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.without_repeated_lines(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("_emberlog_n_lines").alias("n_lines"), F.col("_emberlog_n_removed").alias("n_removed"), F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_pages(_table(spark, sf_dir, "pages"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = main_text.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), name="text")
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.letter_runs(_table(spark, sf_dir, "documents"))
    return spelling.spelling_variants(spelling.vocabulary(runs.select(spelling.slip(F.col("run"), F.col("doc_id")).alias("word"))))


def with_made_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of documents; in those with h % 10 = 0 (h: crc32 of the id) the words from one place on repeat what stands there.

    Word i >= a becomes word a + (i - a) % p; a = g % n, p = 1 + floor((n - a) / (3 + g % 8)), g = floor(h / 10).
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w")).withColumn("n", F.size("w"))
    rows = rows.withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.expr("cast(g % n as int)")).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    tail = "slice(flatten(array_repeat(slice(w, a + 1, p), cast(1 + (n - a) div p as int))), 1, n - a)"
    return rows.select("doc_id", F.when(F.col("n") > 0, F.expr(f"array_join(concat(slice(w, 1, a), {tail}), ' ')")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs.find_runs(with_made_repeats(_table(spark, sf_dir, "documents")), with_text=True)
    rows = rows.withColumn("best", periodic_runs.strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    milli = F.expr("(1000 * best.length) div best.period")
    report = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"), F.sha2(report, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_mix_sources, op2_line_dedup, op3_quality_rules, op4_simhash, op5_pii, op6_url_filter, op7_substring_dedup, op8_warc, op9_decontaminate, op10_quality_classifier, op11_main_text, op12_spelling_variants, op13_periodic_runs, mix_targets)
    return {f.__name__: f for f in own}
