"""Registries as YAML: lists of entries with scalar and list fields, written and read line by line on the executors.

An entry begins with ``- `` in the first column; its other lines are indented. A file may be split anywhere between lines: lines are numbered within their split, splits are
put in order by file and place, and an entry's number is that of the entries that began before. Counts of entries per split (a row a split) give where each split's numbers start, so
no task sees a whole file. Each entry is parsed once, from its own lines.

Read are ``key: value`` with plain, quoted or JSON values, block lists (``- item`` under a key) and comments; keys of no column are passed over. What the parser cannot
read as its column's type is null.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.sources.tables import staged

_KEY = re.compile(r"([^\s:#'\"\[{][^:]*?|\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*')\s*:(?:\s+(.*)|$)")
_NULLS = ("", "~", "null", "Null", "NULL")


def scalar(text: str) -> str | None:
    """The text of a YAML scalar, or null."""
    text = text.strip()
    if text[:1] == '"':
        try:
            return json.loads(re.match(r'"(?:[^"\\]|\\.)*"', text)[0])
        except (TypeError, ValueError):
            return None
    if text[:1] == "'":
        found = re.match(r"'((?:[^']|'')*)'", text)
        return found[1].replace("''", "'") if found else None
    plain = re.sub(r"(^|\s)#.*$", "", text).strip()
    return None if plain in _NULLS else plain


def parse_entry(lines: list[str]) -> dict[str, object]:
    """The fields of an entry; a list field is a list of texts."""
    out: dict[str, object] = {}
    key, place = None, None
    for i, line in enumerate(lines):
        body = ("  " + line[2:]) if i == 0 else line
        stripped = body.strip()
        if not stripped or stripped.startswith("#"):
            continue
        indent = len(body) - len(body.lstrip())
        place = indent if place is None else place
        if stripped.startswith("- ") or stripped == "-":
            if key is not None and indent >= place:
                out[key] = [*(out.get(key) or []), scalar(stripped[1:])] if not isinstance(out.get(key), str) else out[key]
            continue
        found = _KEY.match(stripped)
        if not found or indent != place:
            continue
        key, value = scalar(found[1]), (found[2] or "").strip()
        if value[:1] == "[":
            try:
                out[key] = [None if x is None else x if isinstance(x, str) else json.dumps(x) for x in json.loads(value)]
            except ValueError:
                out[key] = [scalar(x) for x in value.strip("[]").split(",")] if value.endswith("]") else None
        else:
            out[key] = scalar(value)
    return out


def write_entries(rows: DataFrame, folder: str) -> None:
    """An entry a row: texts as JSON texts (which YAML reads), nulls as ``null``."""

    def value(f: T.StructField):
        if isinstance(f.dataType, T.StringType):
            # a JSON text: that of a list of one, without its brackets
            return F.expr(f"substring(to_json(array(`{f.name}`)), 2, length(to_json(array(`{f.name}`))) - 2)")
        return F.to_json(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name).cast("string")

    lines = [F.concat(F.lit(("- " if i == 0 else "  ") + f"{f.name}: "), F.coalesce(F.when(F.col(f.name).isNotNull(), value(f)), F.lit("null"))) for i, f in enumerate(rows.schema.fields)]
    rows.select(F.concat_ws("\n", *lines).alias("value")).write.text(folder)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``entry, at, value``: lines of entries with the number of their entry. Lines before a file's first entry have none and are left out."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = staged(lines.withColumn("begins", F.col("value").startswith("- ").cast("long")), "yaml-lines")
    splits = lines.groupBy("file", "block").agg(F.sum("begins").alias("n"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    splits = splits.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.row_number().over(Window.orderBy("file", "block")).alias("split"))
    within = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.join(splits, ["file", "block"]).withColumn("entry", F.col("before") + F.sum("begins").over(within))
    return rows.filter("entry > 0").select("entry", "split", "at", "value")


def read_entries(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Entries as rows of a schema of scalars and lists of scalars."""
    lists = [f.name for f in schema.fields if isinstance(f.dataType, T.ArrayType)]
    raw = T.StructType([T.StructField(f.name, T.ArrayType(T.StringType()) if f.name in lists else T.StringType()) for f in schema.fields])

    @F.pandas_udf(raw)
    def parsed(entries: pd.Series) -> pd.DataFrame:
        found = [parse_entry(list(e)) for e in entries]
        one = lambda v, many: v if isinstance(v, list) == many else None
        return pd.DataFrame({f.name: [one(e.get(f.name), f.name in lists) for e in found] for f in raw.fields}, columns=raw.names, dtype=object)

    ordered = F.transform(F.array_sort(F.collect_list(F.struct("split", "at", "value"))), lambda x: x["value"])
    entries = numbered_lines(spark, path).groupBy("entry").agg(ordered.alias("lines")).select(parsed("lines").alias("e"))
    return entries.select(*(F.col(f"e.{f.name}").try_cast(f.dataType).alias(f.name) for f in schema.fields))
