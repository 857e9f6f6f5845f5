"""Running SQL and tables: row caps, pages, explain and analyze."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MAX_ROWS = 10_000


def run(spark: SparkSession, sql: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """The statement's rows, max_rows at most."""
    return spark.sql(sql).limit(max_rows)


def read_page(df: DataFrame, columns: list[str], limit: int, offset: int = 0, order_by: list[str] | None = None) -> tuple[DataFrame, int]:
    """A page of some columns, and how many rows the table has."""
    rows = df.orderBy(*order_by) if order_by else df
    return rows.select(*columns).offset(offset).limit(limit), df.count()


def explain(df: DataFrame) -> dict:
    """The plans as text, the operators' tree, the optimizer's size estimate, and how complex the plan is."""
    executed = df._jdf.queryExecution()
    tree = json.loads(executed.optimizedPlan().toJSON())
    nodes = [n["class"].rpartition(".")[2] for n in tree]
    joins = sum("Join" in n for n in nodes)
    size = int(str(executed.optimizedPlan().stats().sizeInBytes()))
    return {"logical": executed.optimizedPlan().toString(), "physical": executed.executedPlan().toString(), "operators": nodes, "estimated_bytes": size, "complexity": "HIGH" if joins > 2 else "MEDIUM" if joins or "Aggregate" in nodes else "LOW"}


def analyze(df: DataFrame) -> dict:
    """Runs the query and reports its rows, seconds and plan."""
    seen, began = Observation("analyze"), time.perf_counter()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    return {"rows": seen.get["rows"], "seconds": time.perf_counter() - began, **explain(df)}


class RuntimeStatistics:
    """Rows that pass named points of a plan, with selectivities; snapshot() and reset()."""

    def __init__(self):
        self.points: dict[str, Observation] = {}

    def watch(self, df: DataFrame, name: str) -> DataFrame:
        self.points[name] = Observation(name)
        return df.observe(self.points[name], F.count(F.lit(1)).alias("rows"))

    def snapshot(self) -> dict[str, int]:
        return {k: o.get["rows"] for k, o in self.points.items()}

    def selectivity(self, before: str, after: str) -> float:
        s = self.snapshot()
        return s[after] / s[before] if s[before] else 0.0

    def reset(self) -> None:
        self.points.clear()
