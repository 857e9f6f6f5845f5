"""Queries that write and read back: files, sources, views, caches, transactions and streams."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.operators.snapshots import SnapshotTable
from tessera.operators.views import Views
from tessera.plans.cache import ResultCache
from tessera.plans.registry import query, table, views
from tessera.sources import federation, files
from tessera.streaming import ingest


def workspace(spark: SparkSession) -> str:
    """A new folder that the whole cluster reads: below spark.checkpoint.dir, or, where that is unset and all runs on this machine, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    return f"{shared}/work-{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def codec_roundtrip(spark, d):
    path, rows = workspace(spark), table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    for codec in ("Uncompressed", "Snappy", "Gzip", "Lz4", "Zstd"):
        files.write_parquet(rows, f"{path}/{codec}", codec)
        rows = files.read_parquet(spark, f"{path}/{codec}", ["c_custkey", "c_name", "c_acctbal"])
    return rows


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders")
def codec_delta_roundtrip(spark, d):
    path, rows = workspace(spark), table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    files.write_parquet(rows, path, "DeltaBinaryPacked", partition_by=None, bloom={"o_custkey": 1000})
    return files.read_parquet(spark, path)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def export_csv_json_roundtrip(spark, d):
    path, rows = workspace(spark), table(spark, d, "nation")
    files.export(rows, f"{path}/a", "csv")
    back = spark.read.option("header", True).option("escape", '"').schema(rows.schema).csv(f"{path}/a")
    files.export(back, f"{path}/b", "json")
    return spark.read.schema(rows.schema).json(f"{path}/b")


@query("SELECT r_name, n_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def federated_join(spark, d):
    path = workspace(spark)
    files.write_parquet(table(spark, d, "supplier"), f"{path}/one/supplier.parquet")
    files.export(table(spark, d, "nation"), f"{path}/two/nation.csv", "csv")
    files.export(table(spark, d, "region"), f"{path}/two/region.json", "json")
    registry = federation.Registry()
    registry.register(federation.FileSource("s3", "one", {"path": f"{path}/one"}))
    registry.register(federation.FileSource("s3", "two", {"path": f"{path}/two"}))
    registry.create_views(spark)
    return spark.sql("SELECT r_name, n_name, s_name FROM s3_one__supplier JOIN s3_two__nation ON s_nationkey = n_nationkey JOIN s3_two__region ON n_regionkey = r_regionkey")


_DAILY = "SELECT CAST(ts AS DATE) AS day, event_type, COUNT(*) AS n, MAX(value) AS top FROM events GROUP BY CAST(ts AS DATE), event_type"


@query(_DAILY)
def mv_refresh_full(spark, d):
    views(spark, d, "events")
    store = Views(spark, workspace(spark))
    store.create("daily", _DAILY, partition_columns=("event_type",))
    store.refresh("daily", "2024-02-01")
    return store.read("daily").select("day", "event_type", "n", "top")


@query(_DAILY)
def mv_refresh_incremental(spark, d):
    store, events = Views(spark, workspace(spark)), table(spark, d, "events")
    events.createOrReplaceTempView("events")
    store.create("daily", _DAILY, mode="incremental", merge=(("n", "sum"), ("top", "max")))
    for k, part in enumerate((events.where("event_id % 3 = 0"), events.where("event_id % 3 <> 0"))):
        part.createOrReplaceTempView("new_events")
        store.refresh_incrementally("daily", f"2024-02-0{k + 1}", spark.sql(_DAILY.replace("FROM events", "FROM new_events")))
    return store.read("daily")


@query(_DAILY)
def mv_rewrite(spark, d):
    views(spark, d, "events")
    store = Views(spark, workspace(spark))
    store.create("daily", _DAILY)
    store.refresh("daily", "2024-02-01")
    asked = spark.sql(_DAILY)
    answered = store.rewrite(asked)
    if answered is asked:
        raise AssertionError("the view was not used")
    return answered


@query("SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_orderpriority <> 'A' GROUP BY o_orderstatus")
def cache_hit_result(spark, d):
    views(spark, d, "orders")
    cache = ResultCache(spark, workspace(spark))
    cache.get("SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_orderpriority <> 'A' GROUP BY o_orderstatus")
    out = cache.get("select  o_orderstatus, count(*) AS n  -- again\nFROM orders WHERE o_orderpriority <> 'A' group by o_orderstatus")
    if (cache.hits, cache.misses) != (1, 1):
        raise AssertionError("the second call should hit")
    return out


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 1")
def transaction_commit(spark, d):
    t, rows = SnapshotTable(spark, workspace(spark)), table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    first = t.begin()
    first.append(rows)
    first.commit("2024-01-01 00:00:00")
    second = t.begin()
    kept = second.read().where("n_regionkey <> 2")
    second.overwrite(kept)
    second.append(rows.where("n_regionkey = 1").withColumn("n_nationkey", F.col("n_nationkey") + 100))
    second.commit("2024-01-02 00:00:00")
    if t.read(ts="2024-01-01 12:00:00").count() != rows.count():
        raise AssertionError("the first snapshot has changed")
    return t.read().select("n_nationkey", "n_name")


# --- streams

_EVENT = "event_id bigint, user_id bigint, event_type string, value double, ts string"


def _messages(spark, d, twice: bool = False, broken: bool = False) -> str:
    """The events as messages in files, some twice or broken, for a stream to read."""
    path = workspace(spark)
    rows = table(spark, d, "events").select(F.to_json(F.struct("event_id", "user_id", "event_type", "value", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))).alias("value"))
    if twice:
        rows = rows.unionAll(rows.where("value LIKE '%click%'"))
    if broken:
        rows = rows.unionAll(rows.where("value LIKE '%signup%'").select(F.substring("value", 1, 20).alias("value")))
    rows.repartition(4).write.text(f"{path}/in")
    return path


def _stream(spark, path: str):
    return spark.readStream.schema("value string").option("maxFilesPerTrigger", 2).text(f"{path}/in")


@query("SELECT event_id, user_id, event_type, value FROM events")
def stream_ingest_events(spark, d):
    path = _messages(spark, d)
    rows = ingest.decoded(_stream(spark, path).withColumnRenamed("value", "raw"), _EVENT, "raw")
    target = ingest.Target(f"{path}/out")
    ingest.ingest(rows.drop("raw"), target, f"{path}/checkpoint").awaitTermination()
    return ingest.stored(spark, target.path, _EVENT).drop("ts")


@query("SELECT event_id, event_type FROM events")
def stream_dedupe(spark, d):
    path = _messages(spark, d, twice=True)
    rows = ingest.decoded(_stream(spark, path).withColumnRenamed("value", "raw"), _EVENT, "raw").withColumn("at", F.col("ts").cast("timestamp"))
    rows = ingest.deduplicated(rows.drop("raw", "error"), ["event_id"], "at", "60 days").drop("at")
    target = ingest.Target(f"{path}/out")
    ingest.ingest(rows, target, f"{path}/checkpoint").awaitTermination()
    return ingest.stored(spark, target.path, _EVENT).select("event_id", "event_type")


@query("SELECT 'good' AS kind, COUNT(*) AS n FROM events UNION ALL SELECT 'dead', COUNT(*) FILTER (WHERE event_type = 'signup') FROM events")
def stream_dlq(spark, d):
    path = _messages(spark, d, broken=True)
    rows = ingest.decoded(_stream(spark, path).withColumnRenamed("value", "raw"), _EVENT, "raw")
    target = ingest.Target(f"{path}/out")
    ingest.ingest(rows, target, f"{path}/checkpoint", f"{path}/dead").awaitTermination()
    good = ingest.stored(spark, target.path, _EVENT).agg(F.lit("good").alias("kind"), F.count(F.lit(1)).alias("n"))
    return good.union(spark.read.option("recursiveFileLookup", True).schema("value string, error string, batch bigint").parquet(f"{path}/dead").agg(F.lit("dead"), F.count(F.lit(1))))


@query("SELECT event_id AS id, 'u' || user_id AS who, CAST(value AS BIGINT) AS whole, COALESCE(event_type, 'none') AS event_type FROM (SELECT event_id, user_id, TRUNC(value) AS value, event_type FROM events)")
def stream_mapping(spark, d):
    path = _messages(spark, d)
    rows = ingest.decoded(_stream(spark, path).withColumnRenamed("value", "raw"), _EVENT, "raw")
    m = ingest.Mapping
    rows = ingest.mapped(rows, [m("event_id", "RENAME", "id"), m("user_id", "DERIVE", "who", "concat('u', cast(user_id as string))"), m("value", "CAST", "whole", "BIGINT"), m("event_type", "DEFAULT", argument="none"), m("raw", "EXCLUDE")])
    target = ingest.Target(f"{path}/out")
    ingest.ingest(rows, target, f"{path}/checkpoint").awaitTermination()
    return ingest.stored(spark, target.path, "id bigint, who string, whole bigint, event_type string")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2")
def stream_window_counts(spark, d):
    path = _messages(spark, d)
    rows = ingest.decoded(_stream(spark, path).withColumnRenamed("value", "raw"), _EVENT, "raw").withColumn("at", F.col("ts").cast("timestamp"))
    counts = ingest.windowed_counts(rows, "at", "1 day", ["event_type"], late="60 days")
    q = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/checkpoint").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{path}/out/v={n:010d}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return ingest.view_of(spark, f"{path}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT event_type, COUNT(*) AS n, MAX(value) AS top FROM events GROUP BY event_type")
def stream_continuous_view(spark, d):
    path = _messages(spark, d)
    rows = ingest.decoded(_stream(spark, path).withColumnRenamed("value", "raw"), _EVENT, "raw")
    ingest.continuous_view(rows, ["event_type"], [F.count(F.lit(1)).alias("n"), F.max("value").alias("top")], f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return ingest.view_of(spark, f"{path}/out")
