"""Rights of data subjects, retention, consent and the audit trail."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import hmac_sha256

AUDIT_SCHEMA = "id string, user_id string, action string, resource string, ts timestamp_ntz, status string, details string, hmac string"
#: Fixed value: years that the audit trail is kept.
AUDIT_YEARS = 7


def access(tables: dict[str, tuple[DataFrame, str]], subject) -> dict[str, DataFrame]:
    """What each table (frame, subject column) holds of a subject."""
    return {name: df.where(F.col(c) == subject) for name, (df, c) in tables.items()}


def erase(df: DataFrame, column: str, subject) -> DataFrame:
    """The table without the subject's rows; rows without a subject stay."""
    return df.where(~F.col(column).eqNullSafe(F.lit(subject)))


def rectify(df: DataFrame, column: str, subject, changes: dict[str, object]) -> DataFrame:
    """The table with new values in the subject's rows."""
    return df.withColumns({k: F.when(F.col(column) == subject, F.lit(v).cast(df.schema[k].dataType)).otherwise(F.col(k)) for k, v in changes.items()})


def export(tables: dict[str, tuple[DataFrame, str]], subject, folder: str, kind: str = "json") -> None:
    """The subject's rows of every table as JSON or CSV files."""
    for name, rows in access(tables, subject).items():
        rows.write.mode("overwrite").option("header", kind == "csv").format(kind).save(f"{folder}/{name}")


@dataclass(frozen=True)
class RetentionRule:
    table: str
    days: int
    date_column: str
    enabled: bool = True


def retained(df: DataFrame, rule: RetentionRule, now: str) -> DataFrame:
    """The rows that are not older than the rule's days; rows without a date stay."""
    if not rule.enabled:
        return df
    old = F.col(rule.date_column) < F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {rule.days} DAYS")
    return df.where(~F.coalesce(old, F.lit(False)))


def apply_retention(tables: dict[str, DataFrame], rules: list[RetentionRule], now: str) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Each rule's table with what it keeps, and the errors by table."""
    out, errors = {}, {}
    for r in rules:
        try:
            out[r.table] = retained(out.get(r.table, tables[r.table]), r, now)
        except Exception as e:  # one rule's error must not keep the others from being applied
            errors[r.table] = str(e).splitlines()[0]
    return out, errors


def current_consents(consents: DataFrame, now: str) -> DataFrame:
    """The latest record of each subject and purpose, with active: granted and not expired."""
    w = Window.partitionBy("subject_id", "purpose").orderBy(F.desc("granted_at"), F.desc("id"))
    latest = consents.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return latest.withColumn("active", F.col("granted") & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp_ntz"))))


def signature(key: str) -> Column:
    """The HMAC of an audit entry's fields."""
    fields = ["id", "user_id", "action", "resource", "ts", "status", "details"]
    return hmac_sha256(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]), key)


def signed(entries: DataFrame, key: str) -> DataFrame:
    return entries.withColumn("hmac", signature(key))


def verify(entries: DataFrame, key: str) -> DataFrame:
    return entries.withColumn("valid", F.col("hmac") == signature(key))


def search(entries: DataFrame, user: str | None = None, action: str | None = None, resource: str | None = None, start: str | None = None, end: str | None = None, status: str | None = None) -> DataFrame:
    for c, v in (("user_id", user), ("action", action), ("status", status)):
        entries = entries.where(F.col(c) == v) if v is not None else entries
    if resource is not None:
        entries = entries.where(F.contains("resource", F.lit(resource)))
    if start is not None:
        entries = entries.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        entries = entries.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return entries.orderBy(F.desc("ts"), "id")


def count_by_action(entries: DataFrame) -> DataFrame:
    return entries.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def kept(entries: DataFrame, now: str, years: int = AUDIT_YEARS) -> DataFrame:
    return entries.where(F.col("ts") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {years} YEARS"))
