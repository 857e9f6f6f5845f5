"""Samples that depend on the seed and the rows' keys alone: rows are ordered by the MD5 of both."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that are numbered in one task, about; ranges at most; rows of the sample that sets their bounds, by range.
PART_ROWS, MAX_PARTS, SAMPLED = 250_000, 4096, 64


def draw(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def random_sample(df: DataFrame, n: int, seed: int, keys: list[str]) -> DataFrame:
    """min(n, rows) rows: those with the least draws. A top-n, so no full sort."""
    return df.orderBy(draw(seed, *keys), *keys).limit(n)


def stratified_sample(df: DataFrame, n: int, seed: int, stratum: str, keys: list[str]) -> DataFrame:
    """max(1, n / strata) rows of every stratum, or all it has; NULL is a stratum. Spark limits each group before it is shuffled."""
    name = F.coalesce(F.col(stratum).cast("string"), F.lit("__null__"))
    strata = df.select(name.alias("s")).distinct().count()
    each = max(1, n // max(1, strata))
    w = Window.partitionBy("__stratum").orderBy("__draw", *keys)
    return df.withColumn("__stratum", name).withColumn("__draw", draw(seed, *keys)).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= each).drop("__stratum", "__draw", "__n")


def _order(df: DataFrame, keys: list[str]) -> Column:
    """What rows are numbered by: the keys, then a hash of the row, which parts equal keys."""
    hashed = [c for c, k in df.dtypes if "map<" not in k and "variant" not in k]
    return F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.xxhash64(*hashed).alias("h"))


def _part(order: Column, bounds: Column, parts: int) -> Column:
    """How many of the sorted bounds are at most the row's place, by bisection."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, parts.bit_length())))])
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.coalesce(F.get(bounds, low + step - 1) <= order, F.lit(False)), low + step).otherwise(low))


def with_position(df: DataFrame, keys: list[str], name: str = "position", part_rows: int = PART_ROWS) -> DataFrame:
    """Adds each row's place (from 0) in the order of the keys (null first); equal keys come in the order of a hash of their rows.

    Rows are dealt to ranges of about part_rows, numbered there, and shifted by what lies before. A
    row's range follows from the row and literal bounds alone (a sample's quantiles), not from where Spark
    has put it, so every branch of the plan agrees on it, however adaptive execution deals the rows. df has to give
    the same rows whenever it is read.
    """
    rows = df.count()
    parts = min(MAX_PARTS, -(-rows // part_rows))
    inner = Window.partitionBy("__part").orderBy("__order")
    own = df.withColumn("__order", _order(df, keys))
    if parts <= 1:
        return own.withColumn("__part", F.lit(0)).withColumn(name, F.row_number().over(inner) - 1).drop("__part", "__order")
    sample = own.select("__order").sample(min(1.0, SAMPLED * parts / rows), seed=1)
    # the sample is bounded: SAMPLED rows a part, of which one a part stays
    tile = sample.withColumn("n", F.ntile(parts).over(Window.orderBy("__order")))
    bounds = tile.groupBy("n").agg(F.min("__order").alias("low")).where("n > 1").agg(F.array_sort(F.collect_list("low")).alias("__bounds"))
    kept = df.sparkSession.createDataFrame(bounds.collect(), bounds.schema)  # literal, so that it can't change between the branches
    dealt = own.join(F.broadcast(kept)).withColumn("__part", _part(F.col("__order"), F.col("__bounds"), parts)).drop("__bounds")
    numbered = dealt.withColumn(name, F.row_number().over(inner) - 1)
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"))
    shift = sizes.select("__part", F.coalesce(F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__shift"))
    # a row a part: MAX_PARTS at most
    return numbered.join(F.broadcast(shift), "__part").withColumn(name, F.col(name) + F.col("__shift")).drop("__part", "__shift", "__order")


def systematic_sample(df: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """Rows 0, k, 2k, ... in the order of the keys; none for k below 1."""
    if k <= 0:
        return df.limit(0)
    return with_position(df, keys, "__position").where(F.col("__position") % k == 0).drop("__position")


def cluster_sample(df: DataFrame, m: int, seed: int, cluster: str) -> DataFrame:
    """All rows of min(m, clusters) clusters; NULL is none."""
    chosen = df.select(F.col(cluster).alias("__cluster")).where("__cluster IS NOT NULL").distinct()
    chosen = chosen.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("__cluster").cast("string"))), "__cluster").limit(m)
    return df.join(chosen, F.col(cluster) == F.col("__cluster"), "left_semi")


def time_sample(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """start <= time <= end. Numbers are milliseconds since 1970; texts that are no times are dropped."""
    kind = dict(df.dtypes)[column]
    c = F.col(column)
    at = F.timestamp_millis(c).cast("timestamp_ntz") if kind in ("int", "bigint") else F.expr(f"try_cast(`{column}` AS timestamp_ntz)") if kind == "string" else c.cast("timestamp_ntz")
    return df.where(at.between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def describe(strategy: str, source_rows: int, sample_rows: int, seed: int | None = None, **options) -> str:
    """A sample's metadata as JSON, tagged by type."""
    return json.dumps({"type": strategy, "source_rows": source_rows, "sample_rows": sample_rows, "seed": seed, **options})
