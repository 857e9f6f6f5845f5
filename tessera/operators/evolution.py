"""Schema changes between two looks at a source, and how compatible they are."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "table string, column string, type string, nullable boolean"
FULL, BACKWARD, INCOMPATIBLE = "FullyCompatible", "BackwardCompatible", "Incompatible"
#: Families of types in widening order.
FAMILIES = (("Int8", "Int16", "Int32", "Int64"), ("UInt8", "UInt16", "UInt32", "UInt64"), ("Float32", "Float64"), ("Date32", "Date64"), ("TimestampSec", "TimestampMillis", "TimestampMicros", "TimestampNanos"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(table, column, change, old, new): table_added, table_removed (column *), column_added (new: nullable or required), column_removed, type_changed, nullability_changed; by a full outer join of two schema tables."""
    o, n = old.select(*[F.col(c).alias(f"o_{c}") for c in ("table", "column", "type", "nullable")]), new.select(*[F.col(c).alias(f"n_{c}") for c in ("table", "column", "type", "nullable")])
    tables = o.select("o_table").distinct().join(n.select("n_table").distinct(), F.col("o_table") == F.col("n_table"), "full")
    whole = tables.where("o_table IS NULL OR n_table IS NULL").select(F.coalesce("o_table", "n_table").alias("table"), F.lit("*").alias("column"), F.when(F.col("o_table").isNull(), "table_added").otherwise("table_removed").alias("change"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new"))
    both = tables.where("o_table IS NOT NULL AND n_table IS NOT NULL").select(F.col("o_table").alias("table"))
    columns = o.join(n, (F.col("o_table") == F.col("n_table")) & (F.col("o_column") == F.col("n_column")), "full").withColumn("table", F.coalesce("o_table", "n_table")).join(both, "table", "left_semi")
    name = F.coalesce("o_column", "n_column").alias("column")
    word = lambda c: F.when(F.col(c), "nullable").otherwise("required")
    none = F.lit(None).cast("string")

    def change(test, kind, a, b):
        return columns.where(test).select("table", name, F.lit(kind).alias("change"), a.alias("old"), b.alias("new"))

    return (
        whole.union(change("o_column IS NULL", "column_added", none, word("n_nullable")))
        .union(change("n_column IS NULL", "column_removed", word("o_nullable"), none))
        .union(change("o_type <> n_type", "type_changed", F.col("o_type"), F.col("n_type")))
        .union(change("o_nullable <> n_nullable", "nullability_changed", word("o_nullable"), word("n_nullable")))
    )


def widens(old: str, new: str) -> bool:
    """Whether every old value fits the new type: within a family, or a decimal of which neither precision nor scale shrinks."""
    if old == new:
        return True
    if old.startswith("Decimal(") and new.startswith("Decimal("):
        (p, s), (q, t) = (map(int, x[8:-1].split(",")) for x in (old, new))
        return q >= p and t >= s
    return any(old in f and new in f and f.index(new) >= f.index(old) for f in FAMILIES)


def grade(change: str, old: str | None, new: str | None) -> str | None:
    """The level of one change; None if it is no issue."""
    match change:
        case "table_added":
            return None
        case "column_added":
            return FULL if new == "nullable" else INCOMPATIBLE
        case "type_changed":
            return BACKWARD if widens(old, new) else INCOMPATIBLE
        case "nullability_changed":
            return BACKWARD if new == "nullable" else INCOMPATIBLE
    return INCOMPATIBLE


def graded(found: DataFrame) -> DataFrame:
    """The changes with their level, on the driver's plan only: decimals and families as expressions."""
    family = F.lit(False)
    for f in FAMILIES:
        names = F.array(*map(F.lit, f))
        family = family | ((F.array_position(names, F.col("old")) > 0) & (F.array_position(names, F.col("new")) >= F.array_position(names, F.col("old"))))
    part = lambda c, i: F.regexp_extract(c, r"^Decimal\((\d+),\s*(\d+)\)$", i).try_cast("int")
    decimal = F.coalesce((part("new", 1) >= part("old", 1)) & (part("new", 2) >= part("old", 2)), F.lit(False))
    c = F.col("change")
    level = (
        F.when(c == "table_added", F.lit(None).cast("string"))
        .when(c == "column_added", F.when(F.col("new") == "nullable", FULL).otherwise(INCOMPATIBLE))
        .when(c == "type_changed", F.when(F.coalesce(family, F.lit(False)) | decimal, BACKWARD).otherwise(INCOMPATIBLE))
        .when(c == "nullability_changed", F.when(F.col("new") == "nullable", BACKWARD).otherwise(INCOMPATIBLE))
        .otherwise(INCOMPATIBLE)
    )
    return found.withColumn("level", level)


def overall(levels: list[str | None]) -> str:
    """No issue: fully compatible. Any issue, even a harmless one, makes it backward compatible at best."""
    issues = [x for x in levels if x]
    return FULL if not issues else INCOMPATIBLE if INCOMPATIBLE in issues else BACKWARD


def compatible(mode: str, old_to_new: str, new_to_old: str) -> bool:
    """Whether a change is allowed under BACKWARD, FORWARD, FULL or NONE, from its level in both directions."""
    return {"NONE": True, "BACKWARD": old_to_new != INCOMPATIBLE, "FORWARD": new_to_old != INCOMPATIBLE, "FULL": INCOMPATIBLE not in (old_to_new, new_to_old)}[mode]


@dataclass
class IncrementalScan:
    """Finds a source's changes since the last look, of which a JSON checkpoint is kept."""

    spark: SparkSession
    path: str

    def run(self, now: DataFrame) -> tuple[list[dict], str]:
        rows = [r.asDict() for r in now.select("table", "column", "type", "nullable").collect()]
        before = []
        if os.path.exists(self.path):
            with open(self.path) as f:
                before = json.load(f)
        found = [r.asDict() for r in graded(changes(self.spark.createDataFrame(before, SCHEMA), self.spark.createDataFrame(rows, SCHEMA))).orderBy("table", "column", "change").collect()]
        with open(f"{self.path}.new", "w") as f:
            json.dump(rows, f)
        os.replace(f"{self.path}.new", self.path)
        return found, overall([r["level"] for r in found])


def discovered(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """The schema table of some frames, in the engine's type names."""
    from tessera.types import schema_of

    rows = [(t, c.name, c.type, c.nullable) for t, df in frames.items() for c in schema_of(df.schema).columns]
    return spark.createDataFrame(rows, SCHEMA)


