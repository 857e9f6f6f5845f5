"""The engine's column types, and Spark's for them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

#: Type names and Spark's types. Unsigned integers take the next wider signed type; Spark keeps microseconds, so nanoseconds lose three digits.
SIMPLE: dict[str, T.DataType] = {
    "Boolean": T.BooleanType(),
    "Int8": T.ByteType(),
    "Int16": T.ShortType(),
    "Int32": T.IntegerType(),
    "Int64": T.LongType(),
    "UInt8": T.ShortType(),
    "UInt16": T.IntegerType(),
    "UInt32": T.LongType(),
    "UInt64": T.DecimalType(20, 0),
    "Float16": T.FloatType(),
    "Float32": T.FloatType(),
    "Float64": T.DoubleType(),
    "Utf8": T.StringType(),
    "Binary": T.BinaryType(),
    "Date32": T.DateType(),
    "Date64": T.DateType(),
    "TimestampSec": T.TimestampNTZType(),
    "TimestampMillis": T.TimestampNTZType(),
    "TimestampMicros": T.TimestampNTZType(),
    "TimestampNanos": T.TimestampNTZType(),
    "Null": T.NullType(),
}
_BACK = {"boolean": "Boolean", "tinyint": "Int8", "smallint": "Int16", "int": "Int32", "bigint": "Int64", "float": "Float32", "double": "Float64", "string": "Utf8", "binary": "Binary", "date": "Date32", "timestamp": "TimestampMicros", "timestamp_ntz": "TimestampMicros", "void": "Null"}


def _split(text: str) -> list[str]:
    """Parts between the commas that no bracket holds."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += c in "<(" and 1 or c in ">)" and -1 or 0
        if c == "," and not depth:
            out.append(text[last:i])
            last = i + 1
    return [x.strip() for x in [*out, text[last:]] if x.strip()]


def to_spark(name: str) -> T.DataType:
    """Spark's type for a name: one of SIMPLE, Decimal(p,s), List<t>, Struct<a:t,...> or Map<k,v>."""
    name = name.strip()
    if name in SIMPLE:
        return SIMPLE[name]
    if m := re.fullmatch(r"Decimal\((\d+),\s*(\d+)\)", name):
        return T.DecimalType(int(m[1]), int(m[2]))
    if m := re.fullmatch(r"List<(.*)>", name):
        return T.ArrayType(to_spark(m[1]), True)
    if m := re.fullmatch(r"Map<(.*)>", name):
        key, value = _split(m[1])
        return T.MapType(to_spark(key), to_spark(value), True)
    if m := re.fullmatch(r"Struct<(.*)>", name):
        return T.StructType([T.StructField(k.strip(), to_spark(v)) for k, v in (x.split(":", 1) for x in _split(m[1]))])
    raise ValueError(f"no such type: {name}")


def from_spark(kind: T.DataType) -> str:
    if isinstance(kind, T.DecimalType):
        return f"Decimal({kind.precision},{kind.scale})"
    if isinstance(kind, T.ArrayType):
        return f"List<{from_spark(kind.elementType)}>"
    if isinstance(kind, T.MapType):
        return f"Map<{from_spark(kind.keyType)},{from_spark(kind.valueType)}>"
    if isinstance(kind, T.StructType):
        return "Struct<" + ",".join(f"{f.name}:{from_spark(f.dataType)}" for f in kind.fields) + ">"
    try:
        return _BACK[kind.simpleString()]
    except KeyError:
        raise ValueError(f"no name for {kind.simpleString()}") from None


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    nullable: bool = True
    description: str = ""
    tags: tuple[str, ...] = ()


@dataclass(frozen=True)
class Schema:
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...] = ()
    partition_keys: tuple[str, ...] = ()
    version: int = 1

    def spark(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, to_spark(c.type), c.nullable, {"description": c.description, "tags": list(c.tags)}) for c in self.columns])


@dataclass(frozen=True)
class TableInfo:
    """A table's metadata; kept as JSON beside the data (see sources.files)."""

    name: str
    namespace: str
    schema: Schema
    tier: str = "Hot"
    compression: str = "zstd"
    row_count: int | None = None
    size_bytes: int | None = None
    properties: dict[str, str] = field(default_factory=dict)


def schema_of(frame_schema: T.StructType) -> Schema:
    return Schema(tuple(Column(f.name, from_spark(f.dataType), f.nullable, f.metadata.get("description", ""), tuple(f.metadata.get("tags", ()))) for f in frame_schema.fields))
