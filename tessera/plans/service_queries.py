"""Queries for sources, joins over time and ranges, streams, scans, catalog, statistics and workflows."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import anonymize, evolution, fulltext, gdpr, lineage, pii, profiling, relational, sampling, tiering
from tessera.operators.views import Views, next_run
from tessera.operators.workflow import AccessWorkflow
from tessera.plans import engine
from tessera.plans.builder import CPU_WEIGHT, IO_WEIGHT, MEMORY_WEIGHT, QuerySpec, TableStats, recommend_join
from tessera.plans.cache import ResultCache
from tessera.plans.catalog import Catalog, column_statistics
from tessera.plans.registry import query, table, views
from tessera.plans.storage_queries import _EVENT, _messages, _stream, workspace
from tessera.sources import federation, files
from tessera.streaming import ingest


def _values(rows: list[tuple], *names: str) -> str:
    """Rows as SQL."""
    one = lambda x: "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    columns = ", ".join(f'"{n}"' for n in names)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) v({columns})"


# --- sources and sinks


@query("SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders")
def batch_pipeline(spark, d):
    def double(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("o_orderkey"), pc.multiply(batch.column("o_totalprice"), 2.0)], ["o_orderkey", "twice"])

    return files.batches(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), double, "o_orderkey bigint, twice double")


def _database(url: str, name: str, **options: str) -> federation.JdbcSource:
    """A database of _stored()."""
    own = {"url": url, "driver": "org.apache.derby.jdbc.EmbeddedDriver", "tables_query": "SELECT tablename FROM sys.systables WHERE tabletype = 'T'"}
    return federation.JdbcSource("jdbc", name, own | options)


def _stored(spark, d, name: str) -> str:
    """The URL of a database, of the kind that Spark brings along, with the tables supplier and nation, which all executors read at once."""
    return federation.packed(spark, workspace(spark), name, {"SUPPLIER": table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), "NATION": table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")})


@query("SELECT n_name, COUNT(*) AS suppliers, MAX(s_acctbal) AS top FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 1000 GROUP BY n_name")
def jdbc_federated_join(spark, d):
    """Tables of a database as views, one read in parallel by key; the filter and the columns go to the database."""
    url = _stored(spark, d, "federated")
    registry = federation.Registry()
    registry.register(_database(url, "federated"))
    registry.create_views(spark)
    low, high = spark.table("jdbc_federated__SUPPLIER").agg(F.coalesce(F.min("s_suppkey"), F.lit(0)), F.coalesce(F.max("s_suppkey"), F.lit(0))).first()
    whole = _database(url, "federated", partitionColumn="s_suppkey", lowerBound=str(low), upperBound=str(max(high, low + 4)), numPartitions="4").read(spark, "SUPPLIER")
    asked = whole.where("s_acctbal > 1000").select("s_nationkey", "s_acctbal")
    plan = asked._jdf.queryExecution().executedPlan().toString()
    if "PushedFilters: [*" not in plan and "PushedPredicates: [" not in plan or asked.rdd.getNumPartitions() != 4:
        raise AssertionError(f"not pushed to the database: {plan}")
    return asked.join(spark.table("jdbc_federated__NATION"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("suppliers"), F.max("s_acctbal").alias("top"))


@query("SELECT s_nationkey, COUNT(*) AS n, MIN(s_acctbal) AS low FROM supplier GROUP BY s_nationkey")
def jdbc_pushed_aggregate(spark, d):
    """An aggregate that the database computes."""
    url = _stored(spark, d, "aggregated")
    out = spark.table(f"{_database(url, 'aggregated').catalog(spark)}.APP.SUPPLIER").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.min("s_acctbal").alias("low"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    if "PushedAggregates: [COUNT" not in plan:
        raise AssertionError(f"not pushed to the database: {plan}")
    return out


_COLUMNS = [("NATION", "n_name", "Utf8"), ("NATION", "n_nationkey", "Int32"), ("NATION", "n_regionkey", "Int32"), ("SUPPLIER", "s_acctbal", "Float64"), ("SUPPLIER", "s_name", "Utf8"), ("SUPPLIER", "s_nationkey", "Int32"), ("SUPPLIER", "s_suppkey", "Int64")]


@query(_values(_COLUMNS, "table", "column", "type"))
def schema_discovery(spark, d):
    """The columns of a database's tables; a source that is down does not hide them."""
    url = _stored(spark, d, "discovered")
    rows, errors = federation.discover(spark, [_database(url, "discovered"), federation.FileSource("s3", "gone", {"path": f"{workspace(spark)}/nowhere"})])
    if list(errors) != ["s3_gone"]:
        raise AssertionError(errors)
    return spark.createDataFrame([(t, c, k) for _, t, c, k, _, _ in rows], "table string, column string, type string")


_TYPES = [("postgresql", "_int4", "List<Int32>"), ("postgresql", "money", "Decimal(19,2)"), ("postgresql", "uuid", "Utf8"), ("postgresql", "unheard", "Utf8"), ("mysql", "tinyint(1)", "Boolean"), ("mysql", "INT(11) UNSIGNED", "UInt32"), ("mysql", "varchar(20)", "Utf8"), ("mysql", "year", "Int16")]


@query(_values(_TYPES, "source", "name", "type"))
def source_types(spark, d):
    own = {"postgresql": federation.postgresql_type, "mysql": federation.mysql_type}
    return spark.createDataFrame([(s, n, own[s](n)) for s, n, _ in _TYPES], "source string, name string, type string")


_MATRIX = [("elasticsearch", "es", True, True, True, False, False), ("jdbc", "jdbc", True, True, True, True, False), ("kafka", "kafka", False, False, True, False, False), ("mongodb", "mongo", True, True, True, False, False), ("mysql", "mysql", True, True, True, True, False), ("postgresql", "pg", True, True, True, True, False), ("s3", "s3", True, True, False, False, False)]


@query(_values(_MATRIX, "kind", "prefix", "predicates", "projections", "limits", "aggregations", "joins"))
def pushdown_matrix(spark, d):
    rows = [(k, f.prefix.removesuffix("_x"), f.pushdown.predicates, f.pushdown.projections, f.pushdown.limits, f.pushdown.aggregations, f.pushdown.joins) for k in federation.KINDS for f in [federation.Source(k, "x")]]
    return spark.createDataFrame(rows, "kind string, prefix string, predicates boolean, projections boolean, limits boolean, aggregations boolean, joins boolean")


@query("SELECT event_id, user_id, event_type, value FROM events WHERE user_id = 7")
def gdpr_export_roundtrip(spark, d):
    path, events = workspace(spark), table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    gdpr.export({"events": (events, "user_id")}, 7, path)
    return spark.read.schema(events.schema).json(f"{path}/events")


@query("SELECT n_nationkey, n_name, 'cold' AS tier FROM nation WHERE n_regionkey < 3 UNION ALL SELECT n_nationkey, n_name, 'hot' FROM nation WHERE n_regionkey >= 3")
def tier_move(spark, d):
    """Files that the policy sends to another tier are moved, and all can still be read."""
    path, rows = workspace(spark), table(spark, d, "nation")
    for r in range(5):
        rows.where(F.col("n_regionkey") == r).coalesce(1).write.parquet(f"{path}/in/{r}")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{path}/in").where("path LIKE '%.parquet'")
    region = F.regexp_extract("path", "/in/([0-9])/", 1).cast("int")
    listed = listed.select("path", F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"), F.when(region < 3, 1).otherwise(50).alias("access_count_last_month"), F.col("length").alias("size_bytes"), F.lit("Hot").alias("tier"))
    names = {r["path"].rpartition("/")[2] for r in listed.select("path").collect()}
    moved = tiering.move(spark, tiering.evaluate(listed, "2024-01-03 00:00:00"), f"{path}/tiers")
    if len(moved) != 3 or not {t.rpartition("/")[2] for _, t in moved} <= names:
        raise AssertionError(moved)
    cold = spark.read.parquet(f"{path}/tiers/cold").select("n_nationkey", "n_name", F.lit("cold").alias("tier"))
    return cold.union(spark.read.option("recursiveFileLookup", True).schema(rows.schema).parquet(f"{path}/in").select("n_nationkey", "n_name", F.lit("hot")))


# --- joins


@query("""SELECT l.event_id, l.user_id, r.event_id AS bought FROM (SELECT * FROM events WHERE event_type = 'click') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def join_asof(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    bought = events.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("bought"))
    return relational.as_of_join(events.where("event_type = 'click'"), bought, ["user_id"], "ts", ["bought"]).select("event_id", "user_id", "bought")


@query("SELECT o_orderkey, band FROM orders JOIN (SELECT i AS band, i * 10000.0 AS low, i * 10000.0 + 15000.0 AS high FROM range(60) t(i)) ON o_totalprice >= low AND o_totalprice < high")
def join_range(spark, d):
    bands = spark.range(60).select(F.col("id").alias("band"), (F.col("id") * 10000.0).alias("low"), (F.col("id") * 10000.0 + 15000.0).alias("high"))
    return relational.range_join(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), bands, "o_totalprice", "low", "high", 5000.0).select("o_orderkey", "band")


@query("SELECT c_custkey, t.n, t.top FROM customer, LATERAL (SELECT COUNT(*) AS n, MAX(o_totalprice) AS top FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 10 * c_acctbal) t")
def join_lateral(spark, d):
    customers, orders = table(spark, d, "customer").select("c_custkey", "c_acctbal"), table(spark, d, "orders").select("o_custkey", "o_totalprice")
    return relational.lateral_aggregate(customers, orders, [("c_custkey", "o_custkey")], F.col("o_totalprice") > 10 * F.col("c_acctbal"), {"n": ("count", "*"), "top": ("max", "o_totalprice")}).select("c_custkey", "n", "top")


@query("SELECT c_custkey AS k, c_acctbal AS v FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def union_merge(spark, d):
    a, b = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")), table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return relational.union_merge([a, b], ["k", "v"])


_SIZES = [(1, 1_000_000), (5, 100), (50, 60), (1_000, 1_000_000), (1_000_000, 1_000_000), (3, 3), (11, 500)]
_IO, _SMALL, _LARGE = f"{IO_WEIGHT} * (l + r)", "LEAST(l, r)", "GREATEST(l, r)"


@query(f"""SELECT l, r, CASE WHEN loops <= hashed AND loops <= merged THEN 'BROADCAST' WHEN merged < hashed THEN 'MERGE' ELSE 'SHUFFLE_HASH' END AS hint FROM (SELECT l, r, {_IO} + {CPU_WEIGHT} * l * r AS loops,
{_IO} + {CPU_WEIGHT} * (l + r) + {MEMORY_WEIGHT} * {_SMALL} AS hashed, {_IO} + {CPU_WEIGHT} * ({_SMALL} * log2({_SMALL} + 1) + {_LARGE} * log2({_LARGE} + 1)) AS merged FROM ({_values(_SIZES, 'l', 'r')}))""")
def join_recommendations(spark, d):
    return spark.createDataFrame([(a, b, recommend_join(a, b)) for a, b in _SIZES], "l int, r int, hint string")


@query("SELECT event_type, true AS near FROM events GROUP BY event_type")
def agg_approx_distinct(spark, d):
    """A sketch's count of distinct values is within 10% of the true one.

    Beside count_distinct, Spark would keep a sketch for each pair of type and id. Repeated values leave a sketch as it is, so
    it is fed the pairs that the exact count needs anyway, and there is one a type and task.
    """
    pairs = table(spark, d, "events").select("event_type", "event_id").distinct()
    rows = pairs.groupBy("event_type").agg(F.approx_count_distinct("event_id", 0.02).alias("about"), F.count("event_id").alias("exact"))
    return rows.select("event_type", (F.abs(F.col("about") - F.col("exact")) <= 0.1 * F.col("exact")).alias("near"))


# --- texts

_JSON = [('{"a": 1, "b": [true]}', "Struct<a:Int64,b:List<Boolean>>"), ("[]", "List<Utf8>"), ("1.5", "Float64"), ("null", "Utf8"), ('"x"', "Utf8"), ("7", "Int64"), ("[[1.0]]", "List<List<Float64>>")]


@query(_values(_JSON, "document", "type"))
def json_types(spark, d):
    return spark.createDataFrame([(t, text.json_type(t)) for t, _ in _JSON], "document string, type string")


_STEMS = [("english", "walking", "walk"), ("english", "nations", "n"), ("english", "berries", "berr"), ("german", "freiheiten", "frei"), ("french", "rapidement", "rapid"), ("spanish", "rapidamente", "rapid"), ("dutch", "woningen", "won"), ("english", "is", "is")]


@query(_values([(k, w, s if len(s) >= fulltext.STEM_LENGTH else w) for k, w, s in _STEMS], "language", "word", "term"))
def fts_stems(spark, d):
    rows = spark.createDataFrame([(k, w) for k, w, _ in _STEMS], "language string, word string")
    term = F.lit(None).cast("string")
    for k in dict.fromkeys(k for k, *_ in _STEMS):
        term = F.when(F.col("language") == k, F.element_at(fulltext.analyzed(F.col("word"), k), 1)).otherwise(term)
    return rows.select("language", "word", term.alias("term"))


_SOUNDS = [("Philip", "FLP"), ("Filip", "FLP"), ("knot", "NT"), ("not", "NT"), ("write", "RT"), ("rite", "RT")]


@query(_values(_SOUNDS, "word", "code"))
def phonetic_codes(spark, d):
    """Words that sound alike have one code."""
    return spark.createDataFrame([(w, text.metaphone(w)) for w, _ in _SOUNDS], "word string, code string")


# --- streams


@query("SELECT COUNT(*) AS rows_in, true AS several FROM events")
def stream_metrics(spark, d):
    path = _messages(spark, d)
    rows = ingest.decoded(_stream(spark, path).withColumnRenamed("value", "raw"), _EVENT, "raw")
    running = ingest.ingest(rows.drop("raw"), ingest.Target(f"{path}/out"), f"{path}/checkpoint")
    running.awaitTermination()
    found = ingest.metrics(running)
    return spark.createDataFrame([(found["rows"], found["batches"] > 1)], "rows_in bigint, several boolean")


def _counted(spark, d, **options):
    path = _messages(spark, d)
    rows = ingest.decoded(_stream(spark, path).withColumnRenamed("value", "raw"), _EVENT, "raw").withColumn("at", F.col("ts").cast("timestamp"))
    counts = ingest.windowed_counts(rows, "at", keys=["user_id"], late="60 days", **options)
    counts.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/checkpoint").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{path}/out/v={n:010d}")).trigger(availableNow=True).start().awaitTermination()
    return ingest.view_of(spark, f"{path}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "user_id", "n")


@query('SELECT start, start + INTERVAL 2 DAYS AS "end", user_id, COUNT(*) AS n FROM (SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY * i AS start FROM events, range(2) t(i)) GROUP BY start, user_id')
def stream_sliding_counts(spark, d):
    return _counted(spark, d, width="2 days", slide="1 day")


@query("""SELECT MIN(ts) AS start, MAX(ts) + INTERVAL 6 HOURS AS "end", user_id, COUNT(*) AS n FROM (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session
FROM (SELECT *, CASE WHEN ts < LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, session""")
def stream_session_counts(spark, d):
    return _counted(spark, d, width="", session_gap="6 hours")


@query("SELECT event_id FROM events WHERE ts >= (SELECT MAX(ts) FROM events WHERE event_id % 2 = 0) - INTERVAL 5 DAYS AND event_id % 2 = 1 OR event_id % 2 = 0")
def stream_late_rows(spark, d):
    """What comes later than the watermark allows is dropped: odd events come after the even ones, 5 days of them in time."""
    path, events = workspace(spark), table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"))
    target, state = f"{path}/out", f"{path}/checkpoint"
    for k in range(2):
        events.where(F.col("event_id") % 2 == k).coalesce(1).write.mode("append").parquet(f"{path}/in")
        rows = spark.readStream.schema(events.schema).parquet(f"{path}/in")
        ingest.ingest(ingest.deduplicated(rows, ["event_id"], "at", "5 days"), ingest.Target(target), state).awaitTermination()
    return ingest.stored(spark, target, "event_id bigint")


_MODES = [(m, a, b) for m in ("BACKWARD", "FORWARD", "FULL", "NONE") for a in (evolution.FULL, evolution.INCOMPATIBLE) for b in (evolution.BACKWARD, evolution.INCOMPATIBLE)]


@query(f"SELECT mode, there, back, CASE mode WHEN 'NONE' THEN true WHEN 'BACKWARD' THEN there <> 'Incompatible' WHEN 'FORWARD' THEN back <> 'Incompatible' ELSE there <> 'Incompatible' AND back <> 'Incompatible' END AS allowed FROM ({_values(_MODES, 'mode', 'there', 'back')})")
def schema_compatibility(spark, d):
    return spark.createDataFrame([(m, a, b, evolution.compatible(m, a, b)) for m, a, b in _MODES], "mode string, there string, back string, allowed boolean")


# --- views, cache

_RUNS = [("*/15 * * * *", "2024-02-01 00:15:00"), ("30 6 * * 1-5", "2024-02-01 06:30:00"), ("0 0 1 * *", "2024-03-01 00:00:00"), ("5,35 */6 29 2 *", "2024-02-29 00:05:00"), ("0 12 * * 7", "2024-02-04 12:00:00"), ("0 1 13 * 5", "2024-02-02 01:00:00")]


@query(_values(_RUNS, "cron", "next_run"))
def schedule_runs(spark, d):
    return spark.createDataFrame([(c, str(next_run(c, datetime(2024, 2, 1, 0, 3, 20)))) for c, _ in _RUNS], "cron string, next_run string")


@query("SELECT 'hourly' AS refreshed, COUNT(*) AS n FROM region")
def scheduled_refresh(spark, d):
    views(spark, d, "region")
    store, schedules = Views(spark, workspace(spark)), {"hourly": "0 * * * *", "daily": "0 0 * * *"}
    for name in schedules:
        store.create(name, "SELECT r_regionkey FROM region", mode="scheduled")
        store.refresh(name, "2024-02-01 00:30:00")
    due = store.due(schedules, datetime(2024, 2, 1, 1, 0))
    for name in due:
        store.refresh(name, "2024-02-01 01:00:00")
    return store.read(due[0]).agg(F.lit(",".join(due)).alias("refreshed"), F.count(F.lit(1)).alias("n"))


@query("SELECT 1 AS hits, 3 AS misses, COUNT(*) + 1 AS n FROM region")
def cache_invalidation(spark, d):
    """A table that is written drops the results that read it, others stay."""
    views(spark, d, "region", "nation")
    cache = ResultCache(spark, workspace(spark))
    asked = "SELECT COUNT(*) AS n FROM region"
    cache.get(asked)
    cache.get("SELECT COUNT(*) AS n FROM nation")
    table(spark, d, "region").unionByName(spark.createDataFrame([(99, "NEW")], "r_regionkey int, r_name string")).createOrReplaceTempView("region")
    cache.table_written("region")
    n = cache.get(asked).first()["n"]
    cache.get("SELECT COUNT(*) AS n FROM nation")
    return spark.createDataFrame([(cache.hits, cache.misses, n)], "hits int, misses int, n bigint")


# --- samples, profiles, scans, lineage


@query("SELECT 'random' AS type, COUNT(*) AS source_rows, 100 AS sample_rows, 42 AS seed FROM orders")
def sample_describe(spark, d):
    rows = table(spark, d, "orders")
    told = json.loads(sampling.describe("random", rows.count(), sampling.random_sample(rows, 100, 42, ["o_orderkey"]).count(), 42))
    return spark.createDataFrame([(told["type"], told["source_rows"], told["sample_rows"], told["seed"])], "type string, source_rows bigint, sample_rows int, seed int")


_PROFILED = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", COUNT(DISTINCT {c}) AS distinct_count, COUNT(*) - COUNT({c}) AS null_count FROM customer" for c in _PROFILED))
def profile_dispatch(spark, d):
    found = profiling.profile_table(table(spark, d, "customer"), list(_PROFILED))
    return spark.createDataFrame([(c, p["distinct_count"], p["null_count"]) for c, p in found.items()], "column string, distinct_count bigint, null_count bigint")


@query(_values([("first", "*", "table_added", None), ("second", "a", "type_changed", "BackwardCompatible"), ("second", "b", "column_added", "FullyCompatible")], "look", "column", "change", "level"))
def incremental_scan(spark, d):
    """The changes between looks at a source, of which the last is kept."""
    import tempfile

    seen = lambda rows: spark.createDataFrame(rows, evolution.SCHEMA)
    with tempfile.TemporaryDirectory() as folder:  # the driver's own notes
        scan, out = evolution.IncrementalScan(spark, f"{folder}/seen.json"), []
        for look, rows in (("first", [("t", "a", "Int32", True)]), ("second", [("t", "a", "Int64", True), ("t", "b", "Utf8", True)]), ("third", [("t", "a", "Int64", True), ("t", "b", "Utf8", True)])):
            out += [(look, c["column"], c["change"], c["level"]) for c in scan.run(seen(rows))[0]]
    return spark.createDataFrame(out, "look string, column string, change string, level string")


_GRAPH = [("raw", "stage"), ("stage", "mart"), ("ref", "mart"), ("mart", "report")]


@query(_values(_GRAPH, "source", "target"))
def lineage_export(spark, d):
    told = json.loads(lineage.export(_GRAPH, "json"))
    if len(told["nodes"]) != 5 or lineage.export(_GRAPH, "mermaid").count("-->") != 4 or lineage.export(_GRAPH, "graphml").count("<edge ") != 4:
        raise AssertionError("the formats differ")
    return spark.createDataFrame([(e["source"], e["target"]) for e in told["edges"]], "source string, target string")


# --- builder, catalog, plans, statistics


@query("SELECT CAST(FLOOR(n * 0.3 * 0.3) AS BIGINT) AS rows, CAST(FLOOR(n * 0.3 * 0.3) AS BIGINT) * 64 AS bytes, 'LOW' AS complexity FROM (SELECT COUNT(*) AS n FROM orders)")
def builder_estimate(spark, d):
    spec = QuerySpec().from_("orders").select("o_orderkey").where("o_custkey", "GT", "1").where("o_orderstatus", "EQ", "O")
    found = spec.estimate({"orders": TableStats(table(spark, d, "orders").count(), 64)})
    return spark.createDataFrame([(found["rows"], found["bytes"], found["complexity"])], "rows bigint, bytes bigint, complexity string")


@query("SELECT 'sales.public.orders' AS name, COUNT(*) AS n, 6 AS columns FROM orders")
def catalog_tables(spark, d):
    catalog = Catalog(spark)
    for name in ("sales", "gone"):
        catalog.create_database(name)
        catalog.create_schema(name, "public")
        catalog.create_table(name, "public", "orders" if name == "sales" else "old", frame=table(spark, d, "orders"))
    catalog.drop_database("gone")
    catalog.update_table("sales", "public", "orders", row_count=table(spark, d, "orders").count())
    names = [f"{a}.{b}.{c}" for a in catalog.list() for b in catalog.list(a) for c in catalog.list(a, b)]
    own = catalog.table("sales", "public", "orders")
    return spark.createDataFrame([(n, own.row_count, len(own.schema.columns)) for n in names], "name string, n bigint, columns int")


@query(_values([("scan", "LOW"), ("aggregate", "MEDIUM"), ("joins", "HIGH")], "plan", "complexity"))
def explain_complexity(spark, d):
    views(spark, d, "orders", "customer", "nation", "region")
    plans = {"scan": "SELECT o_orderkey FROM orders WHERE o_custkey > 5", "aggregate": "SELECT o_custkey, COUNT(*) FROM orders GROUP BY o_custkey", "joins": "SELECT r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"}
    return spark.createDataFrame([(k, engine.explain(spark.sql(q))["complexity"]) for k, q in plans.items()], "plan string, complexity string")


@query("SELECT COUNT(*) AS scanned, COUNT(*) FILTER (WHERE o_totalprice > 100000) AS left_over, ROUND(COUNT(*) FILTER (WHERE o_totalprice > 100000) / COUNT(*), 9) AS selectivity FROM orders")
def runtime_selectivity(spark, d):
    seen = engine.RuntimeStatistics()
    rows = seen.watch(seen.watch(table(spark, d, "orders"), "scanned").where("o_totalprice > 100000"), "left_over")
    rows.write.format("noop").mode("overwrite").save()
    found = seen.snapshot()
    return spark.createDataFrame([(found["scanned"], found["left_over"], round(seen.selectivity("scanned", "left_over"), 9))], "scanned bigint, left_over bigint, selectivity double")


@query("SELECT 'o_orderkey' AS \"column\", COUNT(*) FILTER (WHERE o_orderkey IS NULL) AS null_count, CAST(MIN(o_orderkey) AS VARCHAR) AS min, CAST(MAX(o_orderkey) AS VARCHAR) AS max FROM orders UNION ALL SELECT 'o_orderstatus', COUNT(*) FILTER (WHERE o_orderstatus IS NULL), MIN(o_orderstatus), MAX(o_orderstatus) FROM orders")
def table_statistics(spark, d):
    return column_statistics(table(spark, d, "orders").select("o_orderkey", "o_orderstatus")).select("column", "null_count", "min", "max")


# --- governance


@query("SELECT c_custkey, sha256('s' || c_name) AS c_name, '' AS c_mktsegment FROM customer")
def anon_policies(spark, d):
    policies = anonymize.from_json(anonymize.to_json([anonymize.Policy("c_name", "hashing", {"salt": "s"}), anonymize.Policy("c_mktsegment", "suppression")]))
    return anonymize.apply(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), policies)


@query("SELECT 'text' AS \"column\", 'License' AS category, COUNT(*) FILTER (WHERE contains(text, 'icense')) AS matches FROM documents")
def pii_custom_rules(spark, d):
    rules = (pii.CustomRule("broken", "License", "("), pii.CustomRule("license", "License", "icense"))
    return pii.classify(table(spark, d, "documents").select("text"), custom=rules, least=0.0, categories=("License",)).select("column", "category", "matches")


_STATES = [("approved", "Expired"), ("rejected", "Rejected"), ("revoked", "Revoked"), ("waiting", "PendingApproval")]


@query(_values(_STATES, "request", "state"))
def access_workflow(spark, d):
    flow, now = AccessWorkflow(), datetime(2024, 1, 1)
    ids = {name: flow.submit("ann", "orders", "read", "report", now).id for name, _ in _STATES}
    flow.approve(ids["approved"], "bob", now, timedelta(days=1))
    flow.reject(ids["rejected"], "bob", now)
    flow.approve(ids["revoked"], "bob", now)
    flow.revoke(ids["revoked"], now)
    flow.expire(now + timedelta(days=2))
    return spark.createDataFrame([(n, flow.requests[i].state) for n, i in ids.items()], "request string, state string")
