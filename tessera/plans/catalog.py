"""Databases, schemas, tables and columns as metadata, and the statistics of tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.types import Schema, TableInfo, schema_of


class Catalog:
    """Names in three levels. Tables may have a frame, which is then a view of Spark's catalog as well."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.databases: dict[str, dict[str, dict[str, TableInfo]]] = {}

    def create_database(self, name: str) -> None:
        if name in self.databases:
            raise ValueError(f"{name} exists")
        self.databases[name] = {}

    def create_schema(self, database: str, name: str) -> None:
        if name in self.databases[database]:
            raise ValueError(f"{name} exists")
        self.databases[database][name] = {}

    def create_table(self, database: str, schema: str, name: str, info: Schema | None = None, frame: DataFrame | None = None) -> TableInfo:
        own = TableInfo(name, f"{database}.{schema}", info or schema_of(frame.schema))
        self.databases[database][schema][name] = own
        if frame is not None:
            frame.createOrReplaceTempView(name)
        return own

    def table(self, database: str, schema: str, name: str) -> TableInfo:
        return self.databases[database][schema][name]

    def update_table(self, database: str, schema: str, name: str, **changes) -> TableInfo:
        own = replace(self.table(database, schema, name), **changes)
        self.databases[database][schema][name] = own
        return own

    def drop_table(self, database: str, schema: str, name: str) -> None:
        del self.databases[database][schema][name]
        self.spark.catalog.dropTempView(name)

    def drop_schema(self, database: str, name: str) -> None:
        for t in list(self.databases[database][name]):
            self.drop_table(database, name, t)
        del self.databases[database][name]

    def drop_database(self, name: str) -> None:
        for s in list(self.databases[name]):
            self.drop_schema(name, s)
        del self.databases[name]

    def list(self, database: str | None = None, schema: str | None = None) -> list[str]:
        at = self.databases if database is None else self.databases[database] if schema is None else self.databases[database][schema]
        return sorted(at)


def column_statistics(df: DataFrame) -> DataFrame:
    """(column, null_count, distinct_count, min, max, avg_size) of simple columns in one pass; counts of distinct values are HyperLogLog's."""
    simple = [f.name for f in df.schema.fields if f.dataType.simpleString() not in ("binary", "void") and not f.dataType.simpleString().startswith(("array", "struct", "map"))]
    parts = []
    for c in simple:
        text = F.col(c).cast("string")
        parts.append(F.struct(F.count_if(F.col(c).isNull()).alias("null_count"), F.approx_count_distinct(c).alias("distinct_count"), F.min(c).cast("string").alias("min"), F.max(c).cast("string").alias("max"), F.avg(F.octet_length(text)).alias("avg_size")).alias(c))
    row = df.agg(*parts)
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}.null_count").alias("null_count"), F.col(f"{c}.distinct_count").alias("distinct_count"), F.col(f"{c}.min").alias("min"), F.col(f"{c}.max").alias("max"), F.col(f"{c}.avg_size").alias("avg_size")) for c in simple])).alias("x")).select("x.*")


class Statistics:
    """Row counts and column statistics by table, kept until they are removed."""

    def __init__(self):
        self.known: dict[str, tuple[int, list[dict]]] = {}

    def put(self, table: str, df: DataFrame) -> tuple[int, list[dict]]:
        self.known[table] = df.count(), [r.asDict() for r in column_statistics(df).collect()]
        return self.known[table]

    def get(self, table: str) -> tuple[int, list[dict]] | None:
        return self.known.get(table)

    def remove(self, table: str) -> None:
        self.known.pop(table, None)

    def clear(self) -> None:
        self.known.clear()


def is_key(df: DataFrame, columns: list[str]) -> bool:
    """Whether the columns tell all rows apart."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
