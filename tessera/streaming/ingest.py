"""Streams into tables: micro-batches, deduplication, dead letters, mappings, windows and continuous views."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.text import json_type  # noqa: F401  (the type of a topic's last message)
from tessera.sources.files import CODECS


@dataclass(frozen=True)
class Target:
    """Where and how a stream is stored."""

    path: str
    codec: str = "Zstd"
    partition_by: tuple[str, ...] = ()
    bucket: str | None = None  # DATE or HOUR of a time column
    time_column: str | None = None
    tier: str = "Hot"
    retention_days: int | None = None
    options: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Mapping:
    """One field: DIRECT, RENAME, CAST (type), DERIVE (expression), DEFAULT (value where NULL), EXCLUDE."""

    source: str
    kind: str = "DIRECT"
    target: str | None = None
    argument: str | None = None


def mapped(df: DataFrame, mappings: list[Mapping]) -> DataFrame:
    out = []
    for m in mappings:
        name = m.target or m.source
        match m.kind:
            case "DIRECT" | "RENAME":
                out.append(F.col(m.source).alias(name))
            case "CAST":
                out.append(F.expr(f"try_cast(`{m.source}` AS {m.argument})").alias(name))
            case "DERIVE":
                out.append(F.expr(m.argument).alias(name))
            case "DEFAULT":
                out.append(F.coalesce(F.col(m.source), F.lit(m.argument).cast(df.schema[m.source].dataType)).alias(name))
            case "EXCLUDE":
                pass
            case _:
                raise ValueError(m.kind)
    return df.select(*out)


def decoded(raw: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Messages as columns beside the raw ones; error says why a message has none."""
    parsed = F.from_json(F.col(column), f"{schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    rows = raw.withColumn("__x", parsed)
    bad = F.col("__x.__bad").isNotNull() | F.col("__x").isNull()
    names = [f.name for f in rows.schema["__x"].dataType.fields if f.name != "__bad"]
    return rows.select("*", *[F.col(f"__x.{n}").alias(n) for n in names], F.when(bad, "cannot be parsed").alias("error")).drop("__x")


def split_errors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows without error, dead letters)."""
    return rows.where("error IS NULL").drop("error"), rows.where("error IS NOT NULL")


def _bucketed(df: DataFrame, target: Target) -> tuple[DataFrame, list[str]]:
    by = list(target.partition_by)
    if target.bucket:
        df = df.withColumn("bucket", F.date_format(target.time_column, {"DATE": "yyyy-MM-dd", "HOUR": "yyyy-MM-dd-HH"}[target.bucket]))
        by.append("bucket")
    return df, by


def ingest(stream: DataFrame, target: Target, checkpoint: str, dead_letters: str | None = None, process: Callable[[DataFrame], DataFrame] | None = None, interval: str | None = None) -> StreamingQuery:
    """Writes every micro-batch to <path>/batch=<id>, which a batch that is run again replaces: each row is stored once.

    With dead_letters, rows with an error go there, and so does a batch whose processing fails, with the
    error, after which the stream goes on; without, a failing batch stops the stream. Without an interval, all there is now is read.
    """

    def store(batch: DataFrame, number: int) -> None:
        good, bad = split_errors(batch) if "error" in batch.columns else (batch, None)

        def put(df: DataFrame) -> None:
            df, by = _bucketed(df, target)
            writer = df.write.mode("overwrite").options(**CODECS[target.codec], **target.options)
            (writer.partitionBy(*by) if by else writer).parquet(f"{target.path}/batch={number}")

        def bury(df: DataFrame, kind: str) -> None:
            letters = df.select(F.to_json(F.struct(*[c for c in df.columns if c != "error"])).alias("value"), F.col("error") if "error" in df.columns else F.lit(kind).alias("error"), F.lit(number).cast("bigint").alias("batch"))
            letters.write.mode("overwrite").parquet(f"{dead_letters}/batch={number}-{'rows' if 'error' in df.columns else 'all'}")

        if dead_letters is None:
            put(process(good) if process else good)
            return
        batch.persist()  # read once for good rows and letters
        try:
            put(process(good) if process else good)
        except Exception as e:  # a batch that cannot be processed is kept aside
            bury(good, f"{type(e).__name__}: {str(e).splitlines()[0][:200]}")
        if bad is not None:
            bury(bad, "")
        batch.unpersist()

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """What ingest() has written."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


def deduplicated(stream: DataFrame, ids: list[str], time_column: str, ttl: str) -> DataFrame:
    """The first row of each id within the time that state is kept. The time column must be a timestamp with zone."""
    return stream.withWatermark(time_column, ttl).dropDuplicatesWithinWatermark(ids)


def windowed_counts(stream: DataFrame, time_column: str, width: str, keys: list[str], late: str = "0 seconds", slide: str | None = None, session_gap: str | None = None) -> DataFrame:
    """Rows by window and keys: tumbling, sliding, or by session."""
    w = F.session_window(time_column, session_gap) if session_gap else F.window(time_column, width, slide) if slide else F.window(time_column, width)
    return stream.withWatermark(time_column, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def continuous_view(stream: DataFrame, keys: list[str], calls: list[Column], path: str, checkpoint: str) -> StreamingQuery:
    """An aggregating view that follows a stream: each batch rewrites <path>/<batch>; view_of() reads the newest."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/v={number:010d}")

    return stream.groupBy(*keys).agg(*calls).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(store).trigger(availableNow=True).start()


def view_of(spark: SparkSession, path: str) -> DataFrame:
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    newest = max(s.getPath().getName() for s in store.listStatus(root) if s.getPath().getName().startswith("v="))
    return spark.read.parquet(f"{path}/{newest}")


def metrics(query: StreamingQuery) -> dict:
    """Rows taken in, batches, and the last batch's rates and duration."""
    progress = [json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress]
    last = progress[-1] if progress else {}
    return {"rows": sum(p.get("numInputRows", 0) for p in progress), "batches": len(progress), "rows_per_second": last.get("processedRowsPerSecond"), "duration_ms": (last.get("durationMs") or {}).get("triggerExecution")}


#: Fixed value: bytes before the message proper in the schema registry's framing (a zero and the schema's number).
FRAME_BYTES = 5


def unframed(value: Column) -> tuple[Column, Column]:
    """(schema number, message) of a framed binary message; NULL for what is too short or begins otherwise. Avro itself needs Spark's Avro package."""
    good = (F.octet_length(value) >= FRAME_BYTES) & (F.hex(F.substring(value, 1, 1)) == "00")
    return F.when(good, F.conv(F.hex(F.substring(value, 2, 4)), 16, 10).cast("int")), F.when(good, F.substring(value, FRAME_BYTES + 1, 1 << 30))
