"""What has been run: a table of queries, and reports on it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "id string, sql_text string, user_id string, start_time timestamp_ntz, end_time timestamp_ntz, duration_ms bigint, rows_returned bigint, bytes_scanned bigint, status string, error_message string"
#: From where a query counts as slow, its result as large, its scan as large, and days that records are kept.
SLOW_MS, MANY_ROWS, MANY_BYTES, KEEP_DAYS = 5000, 100_000, 1 << 30, 90


def slowest(history: DataFrame, n: int = 10) -> DataFrame:
    return history.where("duration_ms IS NOT NULL AND status = 'COMPLETED'").orderBy(F.desc("duration_ms"), "id").limit(n)


def most_frequent(history: DataFrame, n: int = 10) -> DataFrame:
    return history.groupBy(F.md5("sql_text").alias("query_hash")).agg(F.count(F.lit(1)).alias("exec_count")).orderBy(F.desc("exec_count"), "query_hash").limit(n)


def by_user(history: DataFrame, user: str, n: int = 100) -> DataFrame:
    return history.where(F.col("user_id") == user).orderBy(F.desc("start_time"), "id").limit(n)


def by_table(history: DataFrame, table: str, n: int = 100) -> DataFrame:
    return history.where(F.contains("sql_text", F.lit(table))).orderBy(F.desc("start_time"), "id").limit(n)


def retained(history: DataFrame, now, days: int = KEEP_DAYS) -> DataFrame:
    return history.where(F.col("start_time") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"))


#: Words that end a WHERE clause, and what follows a column that a predicate tests.
_AFTER_WHERE, _TESTS = {"GROUP", "HAVING", "ORDER", "LIMIT", "UNION", "WINDOW"}, {"=", "<>", "!=", "<", ">", "<=", ">=", "LIKE", "IN", "IS", "BETWEEN", "NOT"}
_TOKEN = re.compile(r"'(?:[^']|'')*'|<>|!=|<=|>=|[A-Za-z_][\w.]*|\d[\w.]*|\S")


def tested_columns(sql: str) -> list[str]:
    """The columns that the WHERE clauses compare, each once."""
    tokens, inside, out = _TOKEN.findall(sql), False, []
    for word, after in zip(tokens, [*tokens[1:], ""], strict=True):
        inside = (inside or word.upper() == "WHERE") and word.upper() not in _AFTER_WHERE
        if inside and (word[0].isalpha() or word[0] == "_") and word.upper() not in _TESTS and after.upper() in _TESTS:
            out.append(word)
    return list(dict.fromkeys(out))


#: (kind, whether it applies, what to do) by a record's words and figures.
ADVICE = (
    ("slow", lambda words, r: r["duration_ms"] > SLOW_MS, "ran for {duration_ms} ms, more than " + str(SLOW_MS) + ": look at its plan"),
    ("scan", lambda words, r: r["scanned"] > MANY_BYTES, "read {scanned} bytes: partition or cluster its tables by what it filters on"),
    ("result", lambda words, r: r["rows"] > MANY_ROWS, "gave {rows} rows: page through them, or filter more"),
    ("columns", lambda words, r: "SELECT *" in words, "reads all columns: name those that are needed"),
    ("filter", lambda words, r: bool(r["tested"]), "filters on {tested}: an index or zone map on them lets it skip rows"),
    ("sort", lambda words, r: "ORDER BY" in words and "LIMIT" not in words, "sorts all it finds: a limit makes that a top-n"),
    ("limit", lambda words, r: "LIMIT" not in words, "has no limit: one bounds what comes back"),
)


def recommendations(sql: str, duration_ms: int | None = None, rows: int | None = None, scanned: int | None = None) -> list[str]:
    """What may make a recorded query cheaper, the dearest first, as "kind: advice"; empty if nothing stands out."""
    words = " ".join(sql.upper().split())
    record = {"duration_ms": duration_ms or 0, "rows": rows or 0, "scanned": scanned or 0, "tested": ", ".join(tested_columns(sql))}
    return [f"{kind}: the query {advice.format(**record)}" for kind, applies, advice in ADVICE if applies(words, record)]
