"""Reading and writing files: Parquet with codecs and metadata, CSV and JSON."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.types import Column, Schema, TableInfo

_DELTA = {"compression": "none", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"}
#: Codec names and writer options. The delta encodings are Parquet's second page version without compression. Brotli needs a codec that Spark does not bring.
CODECS = {
    "Uncompressed": {"compression": "none"},
    "Snappy": {"compression": "snappy"},
    "Gzip": {"compression": "gzip"},
    "Lz4": {"compression": "lz4"},
    "Zstd": {"compression": "zstd"},
    "Brotli": {"compression": "brotli"},
    "DeltaBinaryPacked": _DELTA,
    "DeltaLengthByteArray": _DELTA,
}
ROW_GROUP_BYTES, PAGE_BYTES = 128 << 20, 1 << 20
_SIDECAR = "_tessera.json"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file by any store's own file system, in place at once: it is written beside and renamed."""
    p, store = _fs(spark, path)
    beside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.new")
    out = store.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    store.delete(p, False)
    if not store.rename(beside, p):
        raise OSError(f"cannot write {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    p, store = _fs(spark, path)
    if not store.exists(p):
        return None
    size = store.getFileStatus(p).getLen()
    stream = store.open(p)
    data = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)
    stream.close()
    return bytes(data).decode()


def write_parquet(df: DataFrame, path: str, codec: str = "Zstd", info: TableInfo | None = None, partition_by: list[str] | None = None, mode: str = "overwrite", bloom: dict[str, int] | None = None, allow_text: bool = False) -> None:
    """Writes the table; its metadata goes to a JSON file beside the data. bloom: expected values by column, for Parquet's own filters."""
    writer = df.write.mode(mode).options(**CODECS[codec]).option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES)
    if codec.startswith("Delta") and not allow_text and any(k in ("string", "binary") for _, k in df.dtypes):
        raise ValueError("Spark 4.1's vectorized reader misreads texts in delta encoding; allow_text writes them for readers without it")
    for column, n in (bloom or {}).items():
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", n)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    if info:
        write_text(df.sparkSession, f"{path}/{_SIDECAR}", json.dumps(asdict(info)))


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, schema: T.StructType | None = None, merge: bool = False) -> DataFrame:
    """The table, or the columns it has of those named; with a schema, columns that files lack are NULL."""
    reader = spark.read.option("mergeSchema", merge)
    df = (reader.schema(schema) if schema else reader).parquet(path)
    keep = [c for c in columns or [] if c in df.columns]
    return df.select(*keep) if keep else df


def read_info(spark: SparkSession, path: str) -> TableInfo | None:
    text = read_text(spark, f"{path}/{_SIDECAR}")
    if text is None:
        return None
    raw = json.loads(text)
    schema = raw.pop("schema")
    columns = tuple(Column(**(c | {"tags": tuple(c["tags"])})) for c in schema.pop("columns"))
    return TableInfo(schema=Schema(columns, tuple(schema["primary_key"]), tuple(schema["partition_keys"]), schema["version"]), **raw)


def export(df: DataFrame, path: str, kind: str) -> None:
    """csv (quoted as in RFC 4180, with a header) or json lines."""
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).option("escape", '"').option("emptyValue", '""').csv(path)
    elif kind == "json":
        writer.option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(kind)


def batches(df: DataFrame, transform, schema: str) -> DataFrame:
    """A transform of Arrow batches, for what has no expression; it sees a batch, not the table."""

    def run(many):
        for batch in many:
            yield transform(batch)

    return df.mapInArrow(run, schema)
