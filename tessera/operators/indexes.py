"""Indexes as tables: zone maps, Bloom filters, bitmaps and sorted ranges, over rows in chunks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.expressions import may_match
from tessera.operators.sampling import with_position

CHUNK, EVERY, FALSE_POSITIVES = 1000, 1000, 0.01
#: Bits of one of Spark's bitmaps.
_BITS = 32_768


def chunked(df: DataFrame, keys: list[str], size: int = CHUNK) -> DataFrame:
    """The rows with their place in the order of the keys and the chunk it lies in."""
    return with_position(df, keys).withColumn("chunk", F.floor(F.col("position") / size))


def zone_map(df: DataFrame, columns: list[str], chunk: str = "chunk") -> DataFrame:
    """(chunk, <column>: struct<min, max, nulls, rows>...), typed as the columns are, so that comparisons are theirs too."""
    return df.groupBy(chunk).agg(*[F.struct(F.min(c).alias("min"), F.max(c).alias("max"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count(F.lit(1)).alias("rows")).alias(c) for c in columns])


def merged_zones(a: DataFrame, b: DataFrame, columns: list[str], chunk: str = "chunk") -> DataFrame:
    """One zone map of two."""
    return a.unionByName(b).groupBy(chunk).agg(*[F.struct(F.min(f"{c}.min").alias("min"), F.max(f"{c}.max").alias("max"), F.sum(f"{c}.nulls").alias("nulls"), F.sum(f"{c}.rows").alias("rows")).alias(c) for c in columns])


def chunks_to_read(zones: DataFrame, predicate) -> DataFrame:
    """The chunks that may hold a row for which the predicate (operators.expressions) is true."""
    return zones.where(may_match(predicate)).select("chunk")


def bloom_size(n: int, rate: float = FALSE_POSITIVES) -> tuple[int, int]:
    """Bits and hashes that keep false positives at the rate for n values."""
    m = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    return m, max(1, round(m / max(1, n) * math.log(2)))


def _places(value: Column, bits: int, hashes: int) -> Column:
    """The bits of a value, by two hashes."""
    a, b = F.xxhash64(value, F.lit(1)), F.xxhash64(value, F.lit(2))
    mod = lambda x: F.pmod(x, F.lit(bits))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: mod(mod(a) + i * mod(b)))


def bloom_index(df: DataFrame, column: str, values: int = CHUNK, rate: float = FALSE_POSITIVES, chunk: str = "chunk") -> DataFrame:
    """(chunk, part, bits): a filter for each chunk, in bitmaps of 32,768 bits; built by Spark's own bitmap aggregate."""
    m, k = bloom_size(values, rate)
    places = df.where(F.col(column).isNotNull()).select(chunk, F.explode(_places(F.col(column), m, k)).alias("bit"))
    return places.groupBy(F.col(chunk).alias("chunk"), F.floor(F.col("bit") / _BITS).alias("part")).agg(F.bitmap_construct_agg(F.col("bit") % _BITS).alias("bits"))


def _bit(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1


def bloom_chunks(index: DataFrame, value: Column, values: int = CHUNK, rate: float = FALSE_POSITIVES) -> DataFrame:
    """The chunks that may hold the value."""
    m, k = bloom_size(values, rate)
    asked = index.sparkSession.range(1).select(F.explode(F.array_distinct(_places(value, m, k))).alias("bit"))
    asked = asked.select(F.floor(F.col("bit") / _BITS).alias("part"), (F.col("bit") % _BITS).alias("place"))
    wanted = asked.count()  # a few bits
    hit = index.join(F.broadcast(asked), "part").where(_bit(F.col("bits"), F.col("place")))
    return hit.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == wanted).select("chunk")


def bitmap_index(df: DataFrame, column: str, position: str = "position") -> DataFrame:
    """(value, part, bits): which rows hold each value; rows with NULL are in no bitmap."""
    rows = df.where(F.col(column).isNotNull())
    return rows.groupBy(F.col(column).alias("value"), F.floor(F.col(position) / _BITS).alias("part")).agg(F.bitmap_construct_agg(F.col(position) % _BITS).alias("bits"))


def bitmap_rows(index: DataFrame, *values) -> DataFrame:
    """Positions of the rows that hold one of the values (OR)."""
    merged = index.where(F.col("value").isin(*values)).groupBy("part").agg(F.bitmap_or_agg("bits").alias("bits"))
    places = merged.select("part", "bits", F.explode(F.sequence(F.lit(0), F.lit(_BITS - 1))).alias("place"))
    return places.where(_bit(F.col("bits"), F.col("place"))).select((F.col("part") * _BITS + F.col("place")).alias("position"))


def bitmap_and(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "position", "left_semi")


def bitmap_or(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def bitmap_not(a: DataFrame, everything: DataFrame) -> DataFrame:
    """The other rows; those with NULL are among them."""
    return everything.select("position").join(a, "position", "left_anti")


def sorted_ranges(df: DataFrame, column: str, every: int = EVERY, chunk_size: int = CHUNK) -> DataFrame:
    """(value, position, chunk) of every so many-th value in the order of the column, and of the last."""
    rows = chunked(df.where(F.col(column).isNotNull()).select(column), [column], chunk_size)
    last = rows.agg(F.max("position").alias("last"))
    return rows.crossJoin(F.broadcast(last)).where((F.col("position") % every == 0) | (F.col("position") == F.col("last"))).select(F.col(column).alias("value"), "position", "chunk")


def range_chunks(entries: DataFrame, low, high) -> DataFrame:
    """First and last chunk that may hold values from low to high."""
    before = F.max(F.when(F.col("value") < low, F.col("chunk")))
    after = F.min(F.when(F.col("value") > high, F.col("chunk")))
    return entries.agg(F.coalesce(before, F.min("chunk")).alias("first_chunk"), F.coalesce(after, F.max("chunk")).alias("last_chunk"))
