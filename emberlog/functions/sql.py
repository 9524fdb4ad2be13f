"""Functions for SQL users: the library's own expressions, as temporary SQL functions that the optimizer inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from emberlog import rules


def _stored_message(column: str) -> str:
    """SQL of :func:`emberlog.functions.text.stored_message`, made from the same list of patterns."""
    out = column
    for pattern, mark in rules.STORED_MESSAGE:
        out = f"regexp_replace({out}, r'{pattern}', '{mark}')"
    return f"substring({out}, 1, {rules.STORED_LENGTH})"


_EXCESS = "CASE WHEN baseline > 0 THEN 30 * (errors / baseline - 1) ELSE errors / 2 END"

#: Name, arguments, type, and body.
FUNCTIONS = (
    ("normalize_error_message", "msg STRING", "STRING", _stored_message("msg")),
    ("calculate_health_score", "errors DOUBLE, baseline DOUBLE, critical INT, high INT", "DOUBLE", f"round(greatest(100 - (least({_EXCESS}, 50) + 10 * critical + 5 * high), 0), 2)"),
    ("effective_threshold", "p93 DOUBLE, cap DOUBLE", "DOUBLE", "coalesce(p93, cap, 100)"),
)


def register(spark: SparkSession) -> None:
    for name, arguments, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
