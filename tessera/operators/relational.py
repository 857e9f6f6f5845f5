"""Relational operators where the engine's rules go beyond DataFrame methods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast on request.
BROADCAST_ROWS = 100_000


def project(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns in the frame's own order; names it does not have are left out."""
    return df.select(*[c for c in df.columns if c in set(names)])


def divide(a: Column, b: Column) -> Column:
    """a / b as double; NULL for a zero divisor."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def divide_integers(a: Column, b: Column) -> Column:
    """Integer division, cut towards zero; NULL for a zero divisor."""
    return F.when(b != 0, F.call_function("div", a, b))


def modulo(a: Column, b: Column) -> Column:
    """The remainder with the sign of a; NULL for a zero divisor."""
    return F.try_mod(a, b)


def substring(s: Column, start: int, length: int) -> Column:
    """1-based; a start below 1 counts as 1."""
    return F.substring(s, max(1, start), length)


def concat(*parts: Column) -> Column:
    """NULL if any part is."""
    return F.concat(*[p.cast("string") for p in parts])


def every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], how: str = "inner", residual: Column | None = None, small_right: bool = False) -> DataFrame:
    """An equi-join on pairs of columns, with further conditions inside the join (so outer rows stay). NULL keys meet nothing.

    small_right asks for a broadcast of the right side; it is given if the side has BROADCAST_ROWS rows at most.
    """
    condition = every([left[a] == right[b] for a, b in on] + ([residual] if residual is not None else []))
    if small_right and right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        right = F.broadcast(right)
    return left.join(right, condition, how)


def theta_join(left: DataFrame, right: DataFrame, condition: Column | None, how: str = "inner") -> DataFrame:
    """A join on any condition; none: the cross product."""
    return left.crossJoin(right) if condition is None else left.join(right, condition, how)


def lateral_aggregate(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], residual: Column, calls: dict[str, tuple[str, str]]) -> DataFrame:
    """The left rows, each with aggregates by name, (function, column), over the right rows that meet it; * counts rows.

    One equi-join on the pairs of columns, by sorting, as the size of well compressed files says little of the rows that a
    broadcast would hold. Spark's own plan of a LATERAL aggregate whose condition has more than equalities meets each
    different left value with every right row.
    """
    each = left.groupBy(*left.columns).agg(F.count(F.lit(1)).alias("__copies"))
    met = join(each, right.withColumn("__met", F.lit(1)).hint("merge"), on, "left", residual)
    makers = {"sum": F.sum, "count": F.count, "avg": F.avg, "min": F.min, "max": F.max}
    found = met.groupBy(*each.columns).agg(*[makers[f]("__met" if c == "*" else c).alias(name) for name, (f, c) in calls.items()])
    return found.withColumn("__copies", F.explode(F.sequence(F.lit(1).cast("bigint"), "__copies"))).drop("__copies")


def sort(df: DataFrame, keys: list[tuple[str, bool] | tuple[str, bool, bool]]) -> DataFrame:
    """By (column, ascending, nulls first); left out, nulls are last going up and first going down."""
    order = []
    for name, up, *first in keys:
        nulls_first = first[0] if first else not up
        c = F.col(name)
        order.append((c.asc_nulls_first() if nulls_first else c.asc_nulls_last()) if up else (c.desc_nulls_first() if nulls_first else c.desc_nulls_last()))
    return df.orderBy(*order)


def page(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows from offset on, `limit` at most."""
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def aggregate(df: DataFrame, keys: list[str], calls: list[tuple[str, str]]) -> DataFrame:
    """(function, column) calls named function_column; * counts rows. Functions: sum, count, count_distinct, avg, min, max."""
    makers = {"sum": F.sum, "count": F.count, "count_distinct": F.count_distinct, "avg": F.avg, "min": F.min, "max": F.max}
    return df.groupBy(*keys).agg(*[(F.count(F.lit(1)) if c == "*" else makers[f](c)).alias("count_star" if c == "*" else f"{f}_{c}") for f, c in calls])


def union(frames: list[DataFrame], all_rows: bool = True) -> DataFrame:
    """By position; all_rows=False drops repeated rows."""
    out = reduce(DataFrame.union, frames)
    return out if all_rows else out.distinct()


def union_merge(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """All rows of frames by position, sorted by the keys: one range partitioning that all share, and sorted parts."""
    return union(frames).repartitionByRange(*keys).sortWithinPartitions(*keys)


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, columns: list[str]) -> DataFrame:
    """The left rows with the columns of the last right row of their keys whose time is not later; NULL where there is none.

    Both sides are sorted once by key and time, and the last right row is carried along; no pairs are made. NULL keys and times meet nothing. Of
    right rows at one time any may be taken.
    """
    own = F.struct(*[F.col(c) for c in left.columns])
    a = left.select(*keys, F.col(time).alias("__time"), F.lit(1).alias("__side"), own.alias("__row"), F.lit(None).cast(right.select(F.struct(*columns).alias("x")).schema["x"].dataType).alias("__last"))
    b = right.where(every([F.col(c).isNotNull() for c in (*keys, time)])).select(*keys, F.col(time).alias("__time"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.struct(*columns).alias("__last"))
    up_to = Window.partitionBy(*keys).orderBy("__time", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn("__last", F.last("__last", ignorenulls=True).over(up_to)).where("__side = 1")
    known = F.when(every([F.col(c).isNotNull() for c in (*keys, "__time")]), F.col("__last"))
    return found.select("__row.*", *[known[c].alias(c) for c in columns])


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Points and the ranges with low <= at < high, as an equi-join: ranges are filed under all cells of that width that they touch."""
    cell = lambda c: F.floor(F.col(c) / width)
    filed = ranges.where(F.col(low) < F.col(high)).withColumn("__cell", F.explode(F.sequence(cell(low), cell(high))))
    return points.withColumn("__cell", cell(at)).join(filed, "__cell").where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("__cell")


def exchange(df: DataFrame, kind: str, n: int, keys: list[str] | None = None) -> DataFrame:
    """Hash, range, round_robin or single partitioning."""
    if kind == "hash":
        return df.repartition(n, *(keys or []))
    if kind == "range":
        return df.repartitionByRange(n, *(keys or []))
    if kind == "round_robin":
        return df.repartition(n)
    if kind == "single":
        return df.coalesce(1)
    raise ValueError(kind)
