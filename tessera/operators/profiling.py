"""Column profiles: numbers, text, dates and booleans, each from one or two passes of aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.dates import parse_date

#: Buckets of the histogram, values that the top list holds, the outlier fence, and rows from which a table is sampled, with the sample's seed.
BUCKETS, TOP, FENCE, SAMPLE_ROWS, SEED = 10, 10, 1.5, 100_000, 42
#: The patterns that texts are tried against.
PATTERNS = {
    "email": r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$",
    "phone": r"^\+?[0-9\s\-().]{7,20}$",
    "url": r"^https?://[^\s]+$",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "numeric_only": r"^[0-9]+(\.[0-9]+)?$",
    "alpha_only": r"^[a-zA-Z]+$",
}
TRUE_WORDS = ("true", "yes", "1", "t", "y")


def profile_numeric(df: DataFrame, name: str) -> DataFrame:
    """One row: min, max, mean, median, stddev (of a sample; 0 for one row), quartiles, distinct and null counts, outliers beyond the fence, histogram. Zeros for no values."""
    x = F.col(name).cast("double")
    first = df.agg(F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("stddev"), F.count_distinct(x).alias("distinct_count"), F.count_if(x.isNull()).alias("null_count"), F.count(x).alias("n"))
    zero = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0))
    stats = first.select(zero("min").alias("min"), zero("max").alias("max"), zero("mean").alias("mean"), zero(F.col("q")[1]).alias("median"), "stddev", zero(F.col("q")[0]).alias("q1"), zero(F.col("q")[2]).alias("q3"), "distinct_count", "null_count", "n")
    # the second pass needs one row of the first, so this is a broadcast of a row
    rows = df.select(x.alias("x")).where("x IS NOT NULL").crossJoin(F.broadcast(stats))
    low, high = F.col("q1") - FENCE * (F.col("q3") - F.col("q1")), F.col("q3") + FENCE * (F.col("q3") - F.col("q1"))
    bucket = F.when(F.col("max") == F.col("min"), 1).otherwise(F.least(F.lit(BUCKETS), (F.floor((F.col("x") - F.col("min")) / ((F.col("max") - F.col("min")) / BUCKETS)) + 1).cast("int")))
    counts = rows.withColumn("b", bucket).agg(F.count_if((F.col("x") < low) | (F.col("x") > high)).alias("outlier_count"), *[F.count_if(F.col("b") == i).alias(f"bucket_{i}") for i in range(1, BUCKETS + 1)])
    return stats.crossJoin(counts)


def profile_string(df: DataFrame, name: str) -> DataFrame:
    """One row: lengths, distinct and null counts, how many values match each pattern, and the top values (most frequent first, then by value)."""
    s = F.col(name).cast("string")
    size = F.char_length(s)
    stats = df.agg(F.coalesce(F.min(size), F.lit(0)).cast("bigint").alias("min_length"), F.coalesce(F.max(size), F.lit(0)).cast("bigint").alias("max_length"), F.coalesce(F.avg(size), F.lit(0.0)).alias("avg_length"), F.count_distinct(s).alias("distinct_count"), F.count_if(s.isNull()).alias("null_count"), *[F.count_if(s.rlike(p)).alias(f"n_{k}") for k, p in PATTERNS.items()])
    return stats.crossJoin(top_values(df, name).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "value"))), lambda x: F.concat(x["value"], F.lit("="), (-x["m"]).cast("string"))), ",").alias("top_values")))


def top_values(df: DataFrame, name: str, n: int = TOP) -> DataFrame:
    return df.where(F.col(name).isNotNull()).groupBy(F.col(name).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(n)


def profile_date(df: DataFrame, name: str) -> DataFrame:
    """One row: first and last date as text ('' for none), days between, and values that are null or no date."""
    kind = dict(df.dtypes)[name]
    x = F.col(name).cast("date") if kind in ("date", "timestamp", "timestamp_ntz") else parse_date(F.col(name).cast("string"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return df.agg(text(F.min(x)).alias("min_date"), text(F.max(x)).alias("max_date"), F.coalesce(F.datediff(F.max(x), F.min(x)), F.lit(0)).cast("bigint").alias("range_days"), F.count_if(x.isNull()).alias("null_count"))


def truth(c: Column, kind: str) -> Column:
    if kind == "boolean":
        return c
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return c != 0
    return F.lower(F.trim(c)).isin(*TRUE_WORDS)


def profile_boolean(df: DataFrame, name: str) -> DataFrame:
    """One row: true, false and null counts; words such as yes and numbers other than 0 are true."""
    x = truth(F.col(name), dict(df.dtypes)[name])
    return df.agg(F.count_if(x).alias("true_count"), F.count_if(~x).alias("false_count"), F.count_if(F.col(name).isNull()).alias("null_count"))


def profiler_of(kind: str):
    if kind == "boolean":
        return profile_boolean
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return profile_date
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return profile_numeric
    return profile_string


def profile_table(df: DataFrame, columns: list[str] | None = None, sample_rows: int | None = None) -> dict[str, dict]:
    """A profile for each column by its type. The whole table is read; sample_rows asks for about as many rows instead, by a seeded draw."""
    if sample_rows and (n := df.count()) > sample_rows:
        df = df.sample(fraction=sample_rows / n, seed=SEED)
    kinds = dict(df.dtypes)
    return {c: profiler_of(kinds[c])(df, c).first().asDict() for c in columns or df.columns}


def null_rates(df: DataFrame) -> DataFrame:
    """(column, nulls, rows) of all columns from one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return reduce(DataFrame.union, [counts.select(F.lit(c).alias("column"), F.col(c).alias("nulls"), "rows") for c in df.columns])
