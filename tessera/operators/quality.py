"""Data quality rules, counted exactly in one pass for each table."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.profiling import PATTERNS

#: Fixed value: rate of violations from which a rule raises an alert.
ALERT_RATE = 0.1


@dataclass(frozen=True)
class Rule:
    """kind: completeness (minimum: least percentage of values), range (minimum, maximum), regex (pattern: text or a name of PATTERNS), in_set (values), unique, or consistency (column's values are in other_column of another table)."""

    name: str
    column: str
    kind: str
    minimum: float | None = None
    maximum: float | None = None
    pattern: str | None = None
    values: tuple[str, ...] = ()
    other_table: str | None = None
    other_column: str | None = None


def to_json(rules: list[Rule]) -> str:
    return json.dumps([{k: v for k, v in asdict(r).items() if v not in (None, ())} for r in rules])


def from_json(text: str) -> list[Rule]:
    return [Rule(**{k: tuple(v) if k == "values" else v for k, v in r.items()}) for r in json.loads(text)]


def _violations(r: Rule) -> Column:
    c = F.col(r.column)
    match r.kind:
        case "completeness":
            nulls, rows = F.count_if(c.isNull()), F.count(F.lit(1))
            return F.when((rows - nulls) * 100.0 < r.minimum * rows, nulls).otherwise(0)
        case "range":
            return F.count_if((c < r.minimum) | (c > r.maximum))
        case "regex":
            return F.count_if(~c.cast("string").rlike(PATTERNS.get(r.pattern, r.pattern)))
        case "in_set":
            return F.count_if(~c.cast("string").isin(*r.values))
        case "unique":
            return F.count(c) - F.count_distinct(c)
    raise ValueError(r.kind)


def evaluate(df: DataFrame, rules: list[Rule], tables=None, alert_rate: float = ALERT_RATE) -> DataFrame:
    """(rule, column, violations, rate, alert) of each rule; rate: violations by rows. tables(name) gives the tables that consistency rules name."""
    counted = [r for r in rules if r.kind != "consistency"]
    spark = df.sparkSession
    parts = []
    if counted:
        row = df.agg(F.count(F.lit(1)).alias("rows"), *[_violations(r).alias(f"v{i}") for i, r in enumerate(counted)])
        parts.append(row.select("rows", F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.column).alias("column"), F.col(f"v{i}").cast("bigint").alias("violations")) for i, r in enumerate(counted)])).alias("x")).select("x.rule", "x.column", "x.violations", "rows"))
    for r in (r for r in rules if r.kind == "consistency"):
        other = tables(r.other_table).select(F.col(r.other_column).alias("__there")).distinct()
        lost = df.where(F.col(r.column).isNotNull()).join(other, F.col(r.column) == F.col("__there"), "left_anti").agg(F.count(F.lit(1)).alias("violations"))
        parts.append(lost.crossJoin(df.agg(F.count(F.lit(1)).alias("rows"))).select(F.lit(r.name).alias("rule"), F.lit(r.column).alias("column"), "violations", "rows"))
    if not parts:
        return spark.createDataFrame([], "rule string, column string, violations bigint, rate double, alert boolean")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    rate = F.when(F.col("rows") > 0, F.col("violations") / F.col("rows")).otherwise(0.0)
    return out.select("rule", "column", "violations", rate.alias("rate"), (rate > alert_rate).alias("alert"))


def suggestions(r: Rule) -> list[str]:
    """What to do about a rule that is broken."""
    return {
        "completeness": [f"Consider adding a NOT NULL constraint on column '{r.column}'", f"Investigate data source for missing values in '{r.column}'"],
        "range": [f"Add a CHECK constraint on '{r.column}' to enforce range [{r.minimum}, {r.maximum}]", f"Review data pipeline for out-of-range values in '{r.column}'"],
        "regex": [f"Add validation for pattern '{r.pattern}' in data ingestion for '{r.column}'"],
        "in_set": [f"Map or reject the values of '{r.column}' outside the set at ingestion"],
        "unique": [f"Consider adding a UNIQUE constraint on column '{r.column}'"],
        "consistency": [f"Load '{r.other_table}' before the table that refers to it, or reject orphans of '{r.column}'"],
    }[r.kind]
