"""Queries over sources and sinks that hold state: paged snapshots, tables committed in versions, batches, registries in text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import registry as G
from emberlog.operators import reports as Z
from emberlog.plans import detection as D
from emberlog.plans import inputs as N
from emberlog.plans import logs as Q
from emberlog.plans import sql as S
from emberlog.plans import state as T
from emberlog.plans.catalog import load_sql, query, table
from emberlog.sources import exports as E
from emberlog.sources import logs as LS
from emberlog.sources import paged as P
from emberlog.sources import yamls as Y
from emberlog.sources.store import Store

_COLUMNS = "us long, event_id long, user_id long, event_type string, value double, props string"
_SCOPE = ["shop-prod-01", "cards-uat-01"]


def _snapshot(spark: SparkSession, d: str) -> str:
    """The events as a paged snapshot."""
    folder = N._folder(spark, "snapshot-pages")
    P.register(spark)
    e = table(spark, d, "events")
    P.write_snapshot(e.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", "user_id", "event_type", "value", "props"), folder, page_rows=1000)
    return folder


def _scanned(pages: DataFrame) -> DataFrame:
    """The days and namespaces of the scan from pages of documents; the bounds are numbers, which a source can take."""
    inside = (F.col("us") >= 1704412800000000) & (F.col("us") < 1705276800000000)
    rows = LS.log_events(pages.filter(inside).withColumn("ts", F.timestamp_micros("us")))
    return LS.errors(rows, namespaces=_SCOPE).select("seq", "namespace", "app_name", "message")


@query(load_sql("log_scan"))
def paged_scan(spark, d):
    """A scan of a paged snapshot; pages outside of the days asked for are not fetched, and a page that is not whole fails."""
    return _scanned(spark.read.format("paged_logs").schema(_COLUMNS).load(_snapshot(spark, d)))


@query(load_sql("log_scan"))
def paged_stream(spark, d):
    """The same snapshot as a stream, whose offset is the number of pages read."""
    folder, out = _snapshot(spark, d), N._folder(spark, "paged")
    stream = spark.readStream.format("paged_logs").schema(_COLUMNS).load(folder)
    put = lambda rows, number: rows.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
    _scanned(stream).writeStream.foreachBatch(put).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").drop("batch")


@query("SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE -o_custkey END AS v FROM orders")
def committed_rows(spark, d):
    """Upserts published as versions of a table; a second writer comes in between, and neither loses a row."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"), "o_orderstatus")
    store = Store(spark, N._folder(spark, "store"))
    store.upsert("orders", o.filter("o_orderstatus = 'F'").select("k", "v"), ["k"])
    met = []

    def change(tables):
        if not met:  # another writer publishes first
            met.append(store.upsert("orders", o.filter("o_orderstatus = 'P'").select("k", (-F.col("v")).alias("v")), ["k"]))
        return {"orders": N.L.upserted(tables["orders"], o.filter("o_orderstatus = 'O'").select("k", (-F.col("v")).alias("v")), ["k"])}

    store.commit(change)
    return store.tables()["orders"].select("k", "v")


@query("SELECT event_id, user_id, event_type || ' failed' AS message FROM events")
def batch_documents(spark, d):
    """A folder of JSON batches, lists of documents and objects with them under ``errors``, beside a summary that is left out."""
    e = table(spark, d, "events").select("event_id", "user_id", F.concat("event_type", F.lit(" failed")).alias("message"))
    folder = N._folder(spark, "batches")
    docs = e.groupBy(F.floor(F.col("event_id") / 500).alias("b")).agg(F.collect_list(F.struct(*e.columns)).alias("docs"))
    text = F.when(F.col("b") % 2 == 0, F.to_json("docs")).otherwise(F.to_json(F.struct(F.col("docs").alias("errors"))))
    LS.write_batches(docs.select("b", text.alias("value")), folder, "b")
    LS.write_batches(spark.createDataFrame([(0, '[{"event_id": -1}]')], "b int, value string"), folder, "b", "batch_summary")
    return LS.read_batches(spark, folder, e.schema)


@query(S.ctes("rkeyed") + """, k AS (SELECT registry_key, len(list_distinct(list(fingerprint))) AS n FROM rkeyed GROUP BY 1), h AS (SELECT count(*) AS problems, CAST(sum(n) AS BIGINT) AS fingerprints, CAST(max(n) AS INT) AS max_fingerprints FROM k)
    SELECT day, problems, fingerprints, max_fingerprints FROM h, (VALUES ('2024-01-30'), ('2024-01-31')) t(day)""")
def health_log(spark, d):
    """A row of registry health added to a CSV log by each of two runs."""
    path = N._folder(spark, "health")
    rows = T.registry(spark, d)
    for day in ("2024-01-30", "2024-01-31"):
        E.append_csv(G.health(rows, f"{day} 00:00:00").select(F.lit(day).alias("day"), "problems", "fingerprints", "max_fingerprints"), path)
    return spark.read.schema("day string, problems long, fingerprints long, max_fingerprints int").option("header", "true").csv(path)


@query(S.ctes("rec") + """, v AS (SELECT app_name, app_version, count(*) AS n, min(us) AS first_us FROM rec WHERE app_version IS NOT NULL GROUP BY ALL) SELECT app_name, app_version, CAST(n AS BIGINT) AS events, first_us FROM v""")
def exported_versions(spark, d):
    """The version table exported as CSV and as JSON; both read back alike."""
    folder = N._folder(spark, "versions")
    rows = Z.version_table(Q.records(spark, d))
    E.export_table(rows, folder, "versions", ("csv", "json"))
    schema = "app_name string, app_version string, events long, first_us long"
    csv, js = spark.read.schema(schema).option("header", "true").csv(f"{folder}/versions/csv"), spark.read.schema(schema).json(f"{folder}/versions/json")
    return csv.join(js, csv.columns, "left_semi")


@query(S.ctes("rkeyed") + """, f AS (SELECT registry_key, min(first_us) AS us, namespace FROM (SELECT registry_key, first_us, unnest(namespaces) AS namespace FROM rkeyed) GROUP BY registry_key, namespace)
    SELECT registry_key, CAST(count(*) AS INT) AS namespaces, arg_min(namespace, (us, namespace)) AS first_namespace, max(us) - min(us) AS spread_us FROM f GROUP BY registry_key""")
def exported_propagation(spark, d):
    """How problems spread over namespaces, exported and read back."""
    found = D.incidents(spark, d).withColumn("registry_key", G.X.registry_key(F.col("category"), F.col("apps"), F.col("error_type"), F.col("normalized_message"), F.col("namespaces")))
    folder = N._folder(spark, "propagation")
    E.export_table(Z.propagation_table(found), folder, "propagation", ("csv",))
    return spark.read.schema("registry_key string, namespaces int, first_namespace string, spread_us long").option("header", "true").csv(f"{folder}/propagation/csv")


_ENTRY = "SELECT event_id AS id, event_type || ': ' || user_id AS title, props AS note, list_sort(list_distinct([event_type, 'ns-' || user_id % 3])) AS tags FROM events"


@query(f"SELECT id, title, coalesce(note, '-') AS note, array_to_string(tags, ',') AS tags FROM ({_ENTRY})")
def yaml_registry(spark, d):
    """A registry of an entry for each event, written as YAML and read back, its entries put together across lines and splits."""
    e = table(spark, d, "events")
    u = F.col("user_id")
    rows = e.select(F.col("event_id").alias("id"), F.concat_ws(": ", "event_type", u).alias("title"), F.col("props").alias("note"), F.array_sort(F.array_distinct(F.array(F.col("event_type"), F.concat(F.lit("ns-"), u % 3)))).alias("tags"))
    folder = N._folder(spark, "yaml")
    Y.write_entries(rows, folder)
    back = Y.read_entries(spark, folder, rows.schema)
    return back.select("id", "title", F.coalesce("note", F.lit("-")).alias("note"), F.array_join("tags", ",").alias("tags"))
