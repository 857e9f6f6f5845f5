"""Tables of other systems, each source with a name space of its own, so that joins across sources are plain SQL."""

from __future__ import annotations

import re
import shutil
import zipfile
import zlib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.util import inheritable_thread_target

from tessera.types import schema_of


@dataclass(frozen=True)
class Pushdown:
    """What a source does itself."""

    predicates: bool
    projections: bool
    limits: bool
    aggregations: bool
    joins: bool = False


#: Name space prefix and push-down by kind of source.
KINDS = {
    "postgresql": ("pg", Pushdown(True, True, True, True)),
    "mysql": ("mysql", Pushdown(True, True, True, True)),
    "jdbc": ("jdbc", Pushdown(True, True, True, True)),
    "mongodb": ("mongo", Pushdown(True, True, True, False)),
    "elasticsearch": ("es", Pushdown(True, True, True, False)),
    "s3": ("s3", Pushdown(True, True, False, False)),
    "kafka": ("kafka", Pushdown(False, False, True, False)),
}
#: A PostgreSQL or MySQL column type and the engine's.
POSTGRESQL_TYPES = {"int2": "Int16", "int4": "Int32", "int8": "Int64", "serial": "Int32", "bigserial": "Int64", "float4": "Float32", "float8": "Float64", "bool": "Boolean", "text": "Utf8", "varchar": "Utf8", "bpchar": "Utf8", "bytea": "Binary", "date": "Date32", "timestamp": "TimestampMicros", "timestamptz": "TimestampMicros", "money": "Decimal(19,2)", "json": "Utf8", "jsonb": "Utf8", "uuid": "Utf8", "interval": "Utf8"}
MYSQL_TYPES = {"tinyint(1)": "Boolean", "tinyint": "Int8", "smallint": "Int16", "int": "Int32", "mediumint": "Int32", "bigint": "Int64", "tinyint unsigned": "UInt8", "smallint unsigned": "UInt16", "int unsigned": "UInt32", "bigint unsigned": "UInt64", "year": "Int16", "float": "Float32", "double": "Float64", "char": "Utf8", "varchar": "Utf8", "text": "Utf8", "json": "Utf8", "blob": "Binary", "geometry": "Binary", "date": "Date32", "datetime": "TimestampMicros", "timestamp": "TimestampMicros"}


def postgresql_type(name: str) -> str:
    return f"List<{POSTGRESQL_TYPES.get(name[1:], 'Utf8')}>" if name.startswith("_") else POSTGRESQL_TYPES.get(name, "Utf8")


def mysql_type(name: str) -> str:
    low = name.lower()
    return MYSQL_TYPES.get(low) or MYSQL_TYPES.get(re.sub(r"\([^)]*\)", "", low).strip(), "Utf8")


@dataclass
class Source:
    """A source of tables: kind, the name of its database, and what its reader needs."""

    kind: str
    database: str
    options: dict[str, str] = field(default_factory=dict)

    @property
    def prefix(self) -> str:
        return f"{KINDS[self.kind][0]}_{self.database}"

    @property
    def pushdown(self) -> Pushdown:
        return KINDS[self.kind][1]

    def url(self) -> str:
        port = self.options.get("port", {"postgresql": "5432", "mysql": "3306"}.get(self.kind, ""))
        return self.options.get("url") or f"jdbc:{self.kind}://{self.options.get('host', 'localhost')}:{port}/{self.database}"

    def tables(self, spark: SparkSession) -> list[str]:
        raise NotImplementedError

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        raise NotImplementedError


class JdbcSource(Source):
    """Spark's JDBC reader, which pushes filters and columns to the database, and, by catalog(), limits and aggregates. Reads in parallel if options have partitionColumn, lowerBound, upperBound and numPartitions."""

    def _reader(self, spark: SparkSession):
        own = {k: v for k, v in self.options.items() if k not in ("host", "port", "url", "tables_query")}
        return spark.read.format("jdbc").options(url=self.url(), pushDownPredicate="true", pushDownAggregate="true", pushDownLimit="true", **own)

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return self._reader(spark).option("dbtable", table).load()

    def catalog(self, spark: SparkSession) -> str:
        """The name of the database as a catalog of the session: what is read as <name>.<schema>.<table> has limits and aggregates pushed too."""
        name = f"{self.prefix}_{zlib.crc32(self.url().encode()):08x}"  # a session keeps a catalog as it was first named
        own = {k: v for k, v in self.options.items() if k not in ("host", "port", "url", "tables_query")}
        for k, v in {"": "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog", "url": self.url(), "pushDownPredicate": "true", "pushDownAggregate": "true", "pushDownLimit": "true", **own}.items():
            spark.conf.set(f"spark.sql.catalog.{name}" + (f".{k}" if k else ""), v)
        return name

    def tables(self, spark: SparkSession) -> list[str]:
        own = self.options.get("tables_query")  # where the catalog is not the standard's
        return [r[0] for r in self._reader(spark).option("query", own or "SELECT table_name FROM information_schema.tables WHERE table_schema NOT IN ('pg_catalog', 'information_schema')").load().collect()]


#: Derby's type of a column, by Spark's.
DERBY_TYPES = {"boolean": "BOOLEAN", "tinyint": "SMALLINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT", "float": "REAL", "double": "DOUBLE", "string": "VARCHAR(32672)", "date": "DATE"}


def packed(spark: SparkSession, folder: str, name: str, tables: dict[str, DataFrame]) -> str:
    """Writes tables to an embedded Derby database in a new folder that all machines see under one path, and returns its URL, for reading only.

    An open Derby database belongs to one process, so one in a driver's memory or folder is not there for executors. Packed
    into an archive it can't be written, and any number of processes may open it. Tasks write the rows as text, and the driver's
    database imports them file by file, so no process holds a table.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(path)
    place = store.resolvePath(path).toUri()
    if place.getScheme() != "file":
        raise RuntimeError(f"an embedded database needs a folder of the machines' file system, not {place}")
    root, built = place.getPath(), f"{place.getPath()}/{name}"
    connection = jvm.org.apache.derby.jdbc.EmbeddedDriver().connect(f"jdbc:derby:{built};create=true", jvm.java.util.Properties())
    try:
        statement = connection.createStatement()
        for t, df in tables.items():
            statement.execute(f'CREATE TABLE "{t}" ({", ".join(f'"{c}" {DERBY_TYPES[k]}' for c, k in df.dtypes)})')
            df.write.option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"file://{root}/rows/{t}")
            for part in sorted(Path(f"{root}/rows/{t}").glob("part-*.csv")):
                statement.execute(f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, '{t}', '{part}', ',', '\"', 'UTF-8', 0)")
        statement.close()
    finally:
        connection.close()
        try:
            jvm.org.apache.derby.jdbc.EmbeddedDriver().connect(f"jdbc:derby:{built};shutdown=true", jvm.java.util.Properties())
        except Py4JJavaError as e:  # a shutdown that works is told as an error
            if e.java_exception.getSQLState() != "08006":
                raise
    with zipfile.ZipFile(f"{root}/{name}.jar", "w", zipfile.ZIP_STORED) as archive:  # stored as they are, pages are found without reading what stands before them
        for file in sorted(Path(built).rglob("*")):
            if file.is_file() and file.suffix != ".lck":
                archive.write(file, f"{name}/{file.relative_to(built)}")
    shutil.rmtree(built)
    shutil.rmtree(f"{root}/rows")
    return f"jdbc:derby:jar:({root}/{name}.jar){name}"


class FileSource(Source):
    """A bucket or folder of Parquet, CSV or JSON: a table is a folder or a file, and options["path"] the root."""

    def _entries(self, spark: SparkSession) -> dict[str, tuple[str, str]]:
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.options["path"])
        store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        out = {}
        for s in store.listStatus(root):
            path = s.getPath()
            inner = [x.getPath().getName() for x in store.listStatus(path)] if s.isDirectory() else []
            for name in [path.getName(), *inner]:
                if m := re.fullmatch(r"([^_.].*)\.(parquet|csv|json)", name):
                    out.setdefault(path.getName().rpartition(f".{m[2]}")[0] or path.getName(), (str(path.toString()), m[2]))
                    break
        return out

    def tables(self, spark: SparkSession) -> list[str]:
        return sorted(self._entries(spark))

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        path, kind = self._entries(spark)[table]
        reader = spark.read
        return reader.option("header", True).option("inferSchema", True).csv(path) if kind == "csv" else reader.format(kind).load(path)


class KafkaSource(Source):
    """A topic as a bounded table of key, value, partition, offset and timestamp, from the earliest offset to the last one there is now. Needs Spark's Kafka package."""

    def tables(self, spark: SparkSession) -> list[str]:
        return [t for t in self.options.get("topics", "").split(",") if t]

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        own = {k: v for k, v in self.options.items() if k.startswith("kafka.")}
        rows = spark.read.format("kafka").options(subscribe=table, startingOffsets="earliest", endingOffsets="latest", **own).load()
        rows = rows.selectExpr("CAST(key AS STRING) AS key", "CAST(value AS STRING) AS value", "partition", "offset", "timestamp")
        return rows.limit(int(self.options["max.messages"])) if "max.messages" in self.options else rows


class ConnectorSource(Source):
    """MongoDB or Elasticsearch by their Spark connectors, where installed. options["collection_key"] names the connector's option for a table."""

    FORMATS = {"mongodb": ("mongodb", "collection"), "elasticsearch": ("org.elasticsearch.spark.sql", "es.resource")}

    def tables(self, spark: SparkSession) -> list[str]:
        return [t for t in self.options.get("tables", "").split(",") if t]

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        kind, key = self.FORMATS[self.kind]
        return spark.read.format(kind).options(**{k: v for k, v in self.options.items() if k != "tables"}).option(key, table).load()


class Registry:
    """The known sources; as views, tables are <prefix>__<table>."""

    def __init__(self):
        self.sources: dict[str, Source] = {}

    def register(self, source: Source) -> None:
        self.sources[source.prefix] = source

    def unregister(self, prefix: str) -> None:
        self.sources.pop(prefix, None)

    def create_views(self, spark: SparkSession, prefixes: list[str] | None = None) -> list[str]:
        out = []
        for prefix in prefixes or sorted(self.sources):
            for t in self.sources[prefix].tables(spark):
                name = f"{prefix}__{re.sub(r'[^A-Za-z0-9_]', '_', t)}"
                self.sources[prefix].read(spark, t).createOrReplaceTempView(name)
                out.append(name)
        return out


def _as_caller(spark: SparkSession, f: Callable) -> Callable:
    """f for one run in another thread, whose jobs have the local properties (group, pool, description) and tags that this thread's have."""
    wrap = inheritable_thread_target(spark)
    return f if wrap is spark else wrap(f)  # without pinned threads, the session itself comes back


def discover(spark: SparkSession, sources: list[Source], parallel: int = 4) -> tuple[list[tuple[str, str, str, str, bool, int]], dict[str, str]]:
    """((source, table, column, type, nullable, place) of all sources' columns, errors by source)."""

    def one(s: Source):
        return [(s.prefix, t, c.name, c.type, c.nullable, i) for t in s.tables(spark) for i, c in enumerate(schema_of(s.read(spark, t).schema).columns)]

    rows, errors = [], {}
    with ThreadPoolExecutor(parallel) as pool:
        for s, job in [(s, pool.submit(_as_caller(spark, one), s)) for s in sources]:
            try:
                rows += job.result()
            except Exception as e:  # a source that is down does not hide the others
                errors[s.prefix] = (str(e) or type(e).__name__).splitlines()[0]
    return rows, errors
