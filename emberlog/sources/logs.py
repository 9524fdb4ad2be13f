"""Log events: a view of error logs over the ``events`` table, and adapters from raw documents.

The view's expressions are plain SQL that Spark and other engines read alike, so that one definition
feeds the queries and what they are checked against.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of the log view over ``events``.
LOG_VIEW = {
    "seq": "event_id",
    "level": "CASE event_type WHEN 'view' THEN 'INFO' ELSE 'ERROR' END",
    "namespace": "CASE WHEN event_id % 97 = 0 THEN NULL ELSE CASE user_id % 5 WHEN 0 THEN 'shop-prod-01' WHEN 1 THEN 'shop-prod-02' WHEN 2 THEN 'cards-uat-01' WHEN 3 THEN 'cards-dev-04' ELSE 'core-sit' END END",
    "app_name": "CASE user_id % 7 WHEN 0 THEN 'bl-pcb-billing-v1' WHEN 1 THEN 'bff-pcb-ch-card-opening-v2' WHEN 2 THEN 'feapi-event-processor-v1' WHEN 3 THEN 'shop-cart-v3' WHEN 4 THEN 'bff-pcb-ch-card-servicing-v1' WHEN 5 THEN 'payment-gateway-v1' ELSE 'feapi-pca-v1' END",
    "app_version": "CASE WHEN event_id % 13 = 0 THEN 'v3' WHEN event_id % 17 = 0 THEN NULL ELSE '2.' || CAST(event_id % 12 AS VARCHAR(20)) || '.0' END",
    "trace_id": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'tr-' || CAST(user_id AS VARCHAR(20)) || '-' || CAST(day(ts) AS VARCHAR(20)) END",
    "span_id": "'sp-' || CAST(event_id AS VARCHAR(20))",
    "parent_span_id": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'sp-' || CAST(event_id - 1 AS VARCHAR(20)) END",
    "originator": "CASE user_id % 4 WHEN 0 THEN 'web' WHEN 1 THEN 'mobile' WHEN 2 THEN NULL ELSE 'MochaXTestApp' END",
    "exception_type": "CASE event_id % 6 WHEN 0 THEN 'com.acme.errors.TimeoutException' WHEN 1 THEN 'org.db.SQLException' ELSE NULL END",
    "http_status": "CASE event_id % 8 WHEN 0 THEN 404 WHEN 1 THEN 503 WHEN 2 THEN 200 ELSE NULL END",
    "stack_trace": "CASE event_id % 15 WHEN 4 THEN 'java.lang.IllegalStateException: pool closed at com.acme.Pool.get(Pool.java:10)' ELSE NULL END",
    "message": """CASE event_id % 20
        WHEN 0 THEN 'Connection refused to host 10.0.' || CAST(user_id % 250 AS VARCHAR(20)) || '.' || CAST(event_id % 250 AS VARCHAR(20)) || ':5432'
        WHEN 1 THEN 'ServiceBusinessException: Account ' || CAST(100000 + event_id AS VARCHAR(20)) || ' could not be updated'
        WHEN 2 THEN 'Read timeout after 30000 ms for request ' || CAST(70000 + user_id AS VARCHAR(20))
        WHEN 3 THEN 'Processing of case ' || CAST(50000 + event_id AS VARCHAR(20)) || ' rejected, FlowResult(status=REJECTED)'
        WHEN 4 THEN 'NullPointerException: total is null' || chr(10) || ' at com.acme.shop.Cart.total(Cart.java:42)'
        WHEN 5 THEN 'User token expired for id=' || CAST(user_id AS VARCHAR(20))
        WHEN 6 THEN 'SPEED-' || CAST(100 + event_id % 3 AS VARCHAR(20)) || '#core#svc#app#grp#CardsServiceImpl#getCard#404#card of client not found'
        WHEN 7 THEN 'HTTP 503 service unavailable from upstream /api/' || CAST(event_id AS VARCHAR(20)) || '/items?page=' || CAST(user_id AS VARCHAR(20))
        WHEN 8 THEN 'ValidationException error handled.'
        WHEN 9 THEN 'Handle fault. Error: ErrorModel[code=7, message=Amount is not filled, detail=field amount]'
        WHEN 10 THEN 'java.lang.IllegalStateException: pool ' || CAST(event_id % 4 AS VARCHAR(20)) || ' closed'
        WHEN 11 THEN 'An unexpected error occurred during step processing, case ' || CAST(event_id AS VARCHAR(20))
        WHEN 12 THEN 'access denied for user ' || CAST(user_id AS VARCHAR(20)) || ' on resource 3f2b8c1e-aaaa-4bbb-8ccc-0123456789ab'
        WHEN 13 THEN 'syntax error in SQL query at 2024-01-0' || CAST(1 + event_id % 9 AS VARCHAR(20)) || 'T10:00:00Z'
        WHEN 14 THEN 'certificate of peer @deadbeef0 is not valid, code 0x1f' || CAST(event_id % 10 AS VARCHAR(20))
        WHEN 15 THEN 'Order ' || CAST(20000 + event_id % 7 AS VARCHAR(20)) || ' does not exist'
        WHEN 16 THEN 'heap space of worker ' || CAST(event_id % 3 AS VARCHAR(20)) || ' is used up: OutOfMemoryError'
        WHEN 17 THEN 'Step processing failed, context StepContext(id=' || CAST(event_id AS VARCHAR(20)) || ')'
        WHEN 18 THEN 'Getting card offer for user ' || CAST(user_id AS VARCHAR(20)) || ' failed'
        ELSE 'plain warning of kind ' || event_type END""",
}


def log_events(events: DataFrame) -> DataFrame:
    """The log view: one row per event, with ``ts`` as a timestamp and ``seq`` as the order of arrival."""
    return events.select(F.col("ts").cast("timestamp").alias("ts"), *(F.expr(v).alias(k) for k, v in LOG_VIEW.items()))


def between(rows: DataFrame, start: str | None = None, end: str | None = None, column: str = "ts") -> DataFrame:
    """Rows with ``start <= column < end``. Bounds take the column's own type, so that a columnar scan gets them as filters."""
    kind = rows.schema[column].dataType
    rows = rows.filter(F.col(column) >= F.lit(start).cast(kind)) if start is not None else rows
    return rows.filter(F.col(column) < F.lit(end).cast(kind)) if end is not None else rows


def errors(logs: DataFrame, start: str | None = None, end: str | None = None, namespaces: list[str] | None = None) -> DataFrame:
    """The source query: error level, ``[start, end)``, namespaces in scope."""
    out = between(logs.filter(F.col("level") == "ERROR"), start, end)
    return out.filter(F.col("namespace").isin(namespaces)) if namespaces else out


def check_complete(read: DataFrame, expected: int) -> DataFrame:
    """``read``, or an error if it hasn't the number of rows that the source reports."""
    found = read.count()
    if found != expected:
        raise ValueError(f"the source reports {expected} rows, {found} were read")
    return read


def namespace_scope(spark: SparkSession, configured: list[str], override: str | None = None) -> DataFrame:
    """Monitored namespaces in order, each once; a comma-separated override goes before the configured list."""
    names = [x.strip() for x in override.split(",")] if override else configured
    names = list(dict.fromkeys(x for x in names if x))
    if not names:
        raise ValueError("no namespace is monitored")
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "pos int, namespace string")


# --- raw documents ---

DOCUMENT = T.StructType([
    T.StructField("message", T.StringType()),
    T.StructField("application", T.StructType([T.StructField("name", T.StringType()), T.StructField("version", T.StringType())])),
    T.StructField("application.name", T.StringType()), T.StructField("application.version", T.StringType()),
    T.StructField("@timestamp", T.StringType()), T.StructField("timestamp", T.StringType()),
    T.StructField("kubernetes", T.StructType([T.StructField("namespace", T.StringType())])),
    T.StructField("kubernetes.namespace", T.StringType()), T.StructField("namespace", T.StringType()),
    T.StructField("traceId", T.StringType()), T.StructField("trace_id", T.StringType()), T.StructField("spanId", T.StringType()), T.StructField("span_id", T.StringType()),
    T.StructField("parentId", T.StringType()), T.StructField("parent_id", T.StringType()),
    T.StructField("exception", T.StructType([T.StructField("type", T.StringType()), T.StructField("message", T.StringType())])),
    T.StructField("error", T.StructType([T.StructField("type", T.StringType())])),
    T.StructField("http", T.StructType([T.StructField("status_code", T.StringType())])),
    T.StructField("http.status_code", T.StringType()), T.StructField("stack_trace", T.StringType()),
    T.StructField("context", T.StructType([T.StructField("originatorApplication", T.StringType())])),
    T.StructField("originatorApplication", T.StringType()), T.StructField("level", T.StringType()),
])


def first_of(df: DataFrame, *paths: str, default: str | None = None) -> Column:
    """The first path with a value, read as a dotted field name or as nested fields, whichever the schema has."""
    found = []
    for p in paths:
        if p in df.columns:
            found.append(F.col(f"`{p}`"))
        parts = p.split(".")
        kind: T.DataType = df.schema
        for part in parts:
            kind = kind[part].dataType if isinstance(kind, T.StructType) and part in kind.names else None
        if len(parts) > 1 and kind is not None:
            found.append(F.col(".".join(f"`{x}`" for x in parts)))
    return F.coalesce(*found, F.lit(default)) if found or default is not None else F.lit(None).cast("string")


def flat_records(docs: DataFrame, message_limit: int = 500) -> DataFrame:
    """Raw documents as rows of the log view. A document's place within the read is not known, so ``seq`` is its time's order."""
    ts = F.try_to_timestamp(first_of(docs, "@timestamp", "timestamp"))
    return docs.select(
        ts.alias("ts"), F.coalesce(F.unix_micros(ts), F.lit(0)).alias("seq"), first_of(docs, "level", default="ERROR").alias("level"), first_of(docs, "kubernetes.namespace", "namespace").alias("namespace"),
        first_of(docs, "application.name", "application", default="unknown").cast("string").alias("app_name") if "application" not in docs.columns or not isinstance(docs.schema["application"].dataType, T.StructType)
        else first_of(docs, "application.name", default="unknown").alias("app_name"),
        first_of(docs, "application.version").alias("app_version"), first_of(docs, "traceId", "trace_id").alias("trace_id"), first_of(docs, "spanId", "span_id").alias("span_id"),
        first_of(docs, "parentId", "parent_id").alias("parent_span_id"), first_of(docs, "originatorApplication", "context.originatorApplication").alias("originator"),
        first_of(docs, "exception.type").alias("exception_type"), first_of(docs, "http.status_code").cast("int").alias("http_status"), first_of(docs, "stack_trace").alias("stack_trace"),
        F.substring(F.coalesce(first_of(docs, "message"), F.lit("")), 1, message_limit).alias("message"),
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Line-delimited JSON documents under an explicit schema; broken lines are dropped."""
    return spark.read.schema(DOCUMENT).option("mode", "DROPMALFORMED").json(path)


def read_batches(spark: SparkSession, folder: str, schema: T.StructType = DOCUMENT) -> DataFrame:
    """A folder of ``batch_*.json`` files, each a list of documents or an object with them under ``errors``. Summaries are left out."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "batch_*.json").text(folder, wholetext=True)
    files = files.filter(~F.lower(F.col("_metadata.file_name")).contains("summary"))
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", T.ArrayType(schema))).otherwise(F.from_json("value", T.StructType([T.StructField("errors", T.ArrayType(schema))]))["errors"])
    return files.select(F.inline(listed))


def write_batches(batches: DataFrame, folder: str, number: str, prefix: str = "batch") -> None:
    """Batches (``number``, ``value``: a batch's JSON text) as files ``<prefix>_<number>.json``, each written by the task that holds it, through Spark's own writer and a rename."""
    spark = batches.sparkSession
    draft = f"{folder}/.draft-{prefix}"
    batches.write.partitionBy(number).text(draft)
    path = spark._jvm.org.apache.hadoop.fs.Path(draft)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for part in fs.listStatus(path):
        if "=" in part.getPath().getName():
            named = part.getPath().getName().split("=")[1]
            files = [f.getPath() for f in fs.listStatus(part.getPath()) if f.getPath().getName().startswith("part-")]
            for i, f in enumerate(files):
                fs.rename(f, spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{prefix}_{named}{f'_{i}' if i else ''}.json"))
    fs.delete(path, True)


# --- slot statistics in text lines: DATA|time|weekday|hour|quarter|namespace|mean|stddev|samples ---


def parse_slot_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    p = F.split(F.col(value), r"\|")
    part = lambda i: F.trim(F.get(p, F.lit(i)))
    rows = lines.filter(F.col(value).startswith("DATA|") & (F.size(p) >= 9))
    return rows.select(
        F.try_to_timestamp(part(1)).alias("ts"), F.try_to_number(part(2), F.lit("999999999")).cast("int").alias("dow"), part(3).try_cast("int").alias("hour"), part(4).try_cast("int").alias("quarter"), part(5).alias("namespace"),
        part(6).try_cast("double").alias("mean"), part(7).try_cast("double").alias("stddev"), part(8).try_cast("long").alias("samples"),
    ).filter("mean is not null and samples is not null")


def merge_slots(rows: DataFrame) -> DataFrame:
    """Lines of one slot made one: mean weighted by samples, largest deviation, all samples, last time."""
    weighted = F.sum(F.col("mean") * F.col("samples")) / F.nullif(F.sum("samples"), F.lit(0))
    return rows.groupBy("dow", "hour", "quarter", "namespace").agg(
        F.coalesce(weighted, F.avg("mean")).alias("mean"), F.max("stddev").alias("stddev"), F.sum("samples").alias("samples"), F.max("ts").alias("ts")
    )


def pattern_block_slots(spark: SparkSession, path: str) -> DataFrame:
    """Older reports, one ``Pattern (weekday, hour, quarter, namespace): mean=.., std=.., samples=..`` after the other, as slot rows."""
    block = r"\((\d+),\s*(\d+),\s*(\d+),\s*'?([\w-]+)'?\)[^\n]*?mean[=:]\s*([\d.]+)[^\n]*?std\w*[=:]\s*([\d.]+)[^\n]*?samples[=:]\s*(\d+)"
    text = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(block), F.lit(0))).alias("b"))
    g = lambda i: F.regexp_extract("b", block, i)
    return text.select(
        F.lit(None).cast("timestamp").alias("ts"), g(1).cast("int").alias("dow"), g(2).cast("int").alias("hour"), g(3).cast("int").alias("quarter"), g(4).alias("namespace"),
        g(5).cast("double").alias("mean"), g(6).cast("double").alias("stddev"), g(7).cast("long").alias("samples"),
    )
