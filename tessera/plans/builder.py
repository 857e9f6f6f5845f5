"""A query as an immutable value: built step by step, run as a DataFrame, or written as SQL."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGGREGATES = {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}
JOINS = {"INNER": "inner", "LEFT": "left", "RIGHT": "right", "FULL OUTER": "full", "CROSS": "cross"}
OPERATORS = {"EQ": "=", "NOT_EQ": "<>", "LT": "<", "GT": ">", "LTE": "<=", "GTE": ">=", "IN": "IN", "LIKE": "LIKE", "IS_NULL": "IS NULL", "IS_NOT_NULL": "IS NOT NULL"}
#: Fixed values of the cost estimate: share of rows that pass a filter, growth by a join, bytes of a row of unknown size, rows from which a query is MEDIUM and HIGH.
FILTER_SHARE, JOIN_GROWTH, ROW_BYTES, MEDIUM_ROWS, HIGH_ROWS = 0.3, 2.0, 256, 10_000, 1_000_000


@dataclass(frozen=True)
class Select:
    column: str
    alias: str | None = None
    aggregate: str | None = None


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: str = ""


@dataclass(frozen=True)
class Join:
    table: str
    left: str = ""
    right: str = ""
    kind: str = "INNER"


@dataclass(frozen=True)
class TableStats:
    rows: int
    row_bytes: int = ROW_BYTES


def _name(x: str) -> str:
    return '"' + x.replace('"', '""') + '"'


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


@dataclass(frozen=True)
class QuerySpec:
    """Tables, columns, filters (all must hold), joins on a column pair, groups, order and limit. Filter values are text, and take the column's type."""

    tables: tuple[str, ...] = ()
    columns: tuple[Select, ...] = ()
    filters: tuple[Filter, ...] = ()
    joins: tuple[Join, ...] = ()
    groups: tuple[str, ...] = ()
    orders: tuple[tuple[str, bool], ...] = ()
    rows: int | None = None

    def from_(self, *tables: str) -> "QuerySpec":
        return replace(self, tables=self.tables + tables)

    def select(self, *columns: str) -> "QuerySpec":
        return replace(self, columns=self.columns + tuple(map(Select, columns)))

    def select_agg(self, aggregate: str, column: str, alias: str | None = None) -> "QuerySpec":
        if aggregate not in AGGREGATES:
            raise ValueError(aggregate)
        return replace(self, columns=(*self.columns, Select(column, alias, aggregate)))

    def where(self, column: str, op: str, value: str = "") -> "QuerySpec":
        if op not in OPERATORS:
            raise ValueError(op)
        return replace(self, filters=(*self.filters, Filter(column, op, str(value))))

    def join(self, table: str, left: str = "", right: str = "", kind: str = "INNER") -> "QuerySpec":
        if kind not in JOINS:
            raise ValueError(kind)
        return replace(self, joins=(*self.joins, Join(table, left, right, kind)))

    def group_by(self, *columns: str) -> "QuerySpec":
        return replace(self, groups=self.groups + columns)

    def order_by(self, column: str, ascending: bool = True) -> "QuerySpec":
        return replace(self, orders=(*self.orders, (column, ascending)))

    def limit(self, rows: int) -> "QuerySpec":
        return replace(self, rows=rows)

    def sql(self) -> str:
        """With quoted names and text values, as in PostgreSQL and DuckDB."""
        shown = []
        for c in self.columns:
            x = f"{c.aggregate}({_name(c.column)})" if c.aggregate else _name(c.column)
            shown.append(f"{x} AS {_name(c.alias)}" if c.alias else x)
        out = [f"SELECT {', '.join(shown) or '*'} FROM {', '.join(map(_name, self.tables))}"]
        out += [f"{j.kind} JOIN {_name(j.table)}" + (f" ON {_name(j.left)} = {_name(j.right)}" if j.kind != "CROSS" else "") for j in self.joins]
        if self.filters:
            out.append("WHERE " + " AND ".join(map(self._filter_sql, self.filters)))
        if self.groups:
            out.append("GROUP BY " + ", ".join(map(_name, self.groups)))
        if self.orders:
            out.append("ORDER BY " + ", ".join(f"{_name(c)} {'ASC' if up else 'DESC'}" for c, up in self.orders))
        if self.rows is not None:
            out.append(f"LIMIT {self.rows}")
        return " ".join(out)

    @staticmethod
    def _filter_sql(f: Filter) -> str:
        c, op = _name(f.column), OPERATORS[f.op]
        if f.op == "IN":
            return f"{c} IN ({', '.join(_text(v.strip()) for v in f.value.split(','))})"
        return f"{c} {op}" + ("" if f.op.startswith("IS_") else f" {_text(f.value)}")

    def frame(self, source) -> DataFrame:
        """The query over the tables that source(name) gives."""
        df = reduce(lambda a, b: a.crossJoin(b), map(source, self.tables))
        for j in self.joins:
            other = source(j.table)
            df = df.crossJoin(other) if j.kind == "CROSS" else df.join(other, df[j.left] == other[j.right], JOINS[j.kind])
        types = dict(df.dtypes)
        for f in self.filters:
            df = df.where(self._condition(f, types[f.column]))
        calls = [(AGGREGATES[c.aggregate](c.column)).alias(c.alias or f"{c.aggregate.lower()}({c.column})") for c in self.columns if c.aggregate]
        if calls or self.groups:
            df = df.groupBy(*self.groups).agg(*calls) if calls else df.select(*self.groups).distinct()
        if self.columns:
            df = df.select(*[F.col((c.alias or f"{c.aggregate.lower()}({c.column})") if c.aggregate else c.column).alias(c.alias or c.column if not c.aggregate else c.alias or f"{c.aggregate.lower()}({c.column})") for c in self.columns])
        if self.orders:
            # the SQL that this stands for puts NULL last going up and first going down
            df = df.orderBy(*[F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_first() for c, up in self.orders])
        return df if self.rows is None else df.limit(self.rows)

    @staticmethod
    def _condition(f: Filter, kind: str) -> Column:
        c = F.col(f.column)
        v = lambda x: F.lit(x).cast(kind)
        match f.op:
            case "EQ":
                return c == v(f.value)
            case "NOT_EQ":
                return c != v(f.value)
            case "LT":
                return c < v(f.value)
            case "GT":
                return c > v(f.value)
            case "LTE":
                return c <= v(f.value)
            case "GTE":
                return c >= v(f.value)
            case "IN":
                return c.isin(*[v(x.strip()) for x in f.value.split(",")])
            case "LIKE":
                return c.cast("string").like(f.value)
            case "IS_NULL":
                return c.isNull()
        return c.isNotNull()

    def estimate(self, stats: dict[str, TableStats]) -> dict:
        """Rows, bytes and complexity by rules of thumb, from what is known of the tables."""
        known = [stats[t] for t in self.tables if t in stats]
        rows = max((s.rows for s in known), default=0)
        rows = max(1, int(rows * FILTER_SHARE ** len(self.filters)))
        for j in self.joins:
            rows = rows * max(1, stats[j.table].rows if j.table in stats else 0) if j.kind == "CROSS" else int(rows * JOIN_GROWTH)
        rows = rows if self.rows is None else min(rows, self.rows)
        size = sum(s.row_bytes for s in known) // len(known) if known else ROW_BYTES
        if any(j.kind == "CROSS" for j in self.joins) or rows > HIGH_ROWS:
            level = "HIGH"
        elif len(self.joins) > 1 or any(c.aggregate for c in self.columns) or rows > MEDIUM_ROWS:
            level = "MEDIUM"
        else:
            level = "LOW"
        return {"rows": rows, "bytes": rows * size, "complexity": level}


#: Weights of reading, computing and memory in a join's cost.
IO_WEIGHT, CPU_WEIGHT, MEMORY_WEIGHT = 1.0, 0.1, 0.5


def recommend_join(left_rows: float, right_rows: float) -> str:
    """The hint for Spark with the least cost: BROADCAST while one side is tiny, else SHUFFLE_HASH or MERGE."""
    small, large = sorted((max(1.0, left_rows), max(1.0, right_rows)))
    loops = IO_WEIGHT * (small + large) + CPU_WEIGHT * small * large
    hashed = IO_WEIGHT * (small + large) + CPU_WEIGHT * (small + large) + MEMORY_WEIGHT * small
    merged = IO_WEIGHT * (small + large) + CPU_WEIGHT * (small * math.log2(small + 1) + large * math.log2(large + 1))
    return min((loops, "BROADCAST"), (hashed, "SHUFFLE_HASH"), (merged, "MERGE"))[1]
