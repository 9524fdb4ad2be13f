"""Log rows to normalised records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions import text as X


def parse(logs: DataFrame) -> DataFrame:
    """Rows of the log view as records: normalised message, error type, fingerprint, environment, version.

    A null namespace is 'unknown'; a row without a time stays (facts leave it out). One projection, no shuffle.
    """
    # As the output of a generator the two costly texts are computed once per row; filters on what is made of them later
    # are not pushed through and do not repeat them.
    kind = X.error_type(F.col("message"), F.col("exception_type"), F.col("stack_trace"), F.col("http_status"))
    made = F.inline(F.array(F.struct(X.normalised_message(F.col("message")).alias("normalized_message"), kind.alias("error_type"))))
    rows = logs.select(
        "seq", "ts", F.coalesce(F.nullif("namespace", F.lit("")), F.lit("unknown")).alias("namespace"), F.coalesce(F.nullif("app_name", F.lit("")), F.lit("unknown")).alias("app_name"),
        X.semantic_version(F.col("app_version")).alias("app_version"), F.nullif("trace_id", F.lit("")).alias("trace_id"), "span_id", "parent_span_id", X.environment(F.col("namespace")).alias("environment"),
        F.nullif("originator", F.lit("")).alias("originator"), F.substring(X.full(F.col("message")), 1, 1000).alias("raw_message"), made,
    )
    return rows.withColumn("fingerprint", X.fingerprint(F.col("error_type"), F.col("normalized_message")))


def by_fingerprint(records: DataFrame) -> DataFrame:
    """One row per fingerprint in order of first arrival, with what all its records share."""
    return records.groupBy("fingerprint").agg(
        F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.first("error_type").alias("error_type"), F.min_by("normalized_message", "seq").alias("normalized_message")
    )
