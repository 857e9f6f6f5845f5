"""Column security: who may see a column, masked or not, by default no one."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: From the least to the most that a policy allows.
LEVELS = ("NoAccess", "MaskedAccess", "FullAccess")


@dataclass(frozen=True)
class ColumnPolicy:
    table: str
    column: str
    role_or_user: str
    access: str
    technique: str | None = None


def masked(c: Column, technique: str = "mask") -> Column:
    """mask (two characters at each end stay), hash, null, redact, partial (four stay); others count as mask."""
    c, n = c.cast("string"), F.char_length(c.cast("string"))
    stars = lambda k: F.repeat(F.lit("*"), k)
    match technique.lower():
        case "hash":
            return F.base64(F.unhex(F.sha2(c, 256)))
        case "null":
            return F.when(c.isNotNull(), F.lit("NULL"))
        case "redact":
            return F.when(c.isNotNull(), F.lit("[REDACTED]"))
        case "partial":
            return F.when(n <= 4, stars(n)).otherwise(F.concat(F.left(c, F.lit(4)), stars(n - 4)))
    return F.when(n <= 4, stars(n)).otherwise(F.concat(F.left(c, F.lit(2)), stars(n - 4), F.right(c, F.lit(2))))


def access(policies: list[ColumnPolicy], table: str, columns: list[str], user: str, roles: list[str]) -> dict[str, tuple[str, str | None]]:
    """(level, technique) of each column: the most that a policy of the user or a role allows."""
    who = {user, *roles}
    out = {}
    for c in columns:
        own = [p for p in policies if p.table == table and p.column == c and p.role_or_user in who]
        best = max(own, key=lambda p: LEVELS.index(p.access), default=None)
        out[c] = (best.access, (best.technique or "mask") if best.access == "MaskedAccess" else None) if best else ("NoAccess", None)
    return out


def secured(df: DataFrame, policies: list[ColumnPolicy], table: str, user: str, roles: list[str]) -> DataFrame:
    """The table as the user may see it: columns raw, masked, or NULL."""
    out = []
    for c, (level, technique) in access(policies, table, df.columns, user, roles).items():
        kind = df.schema[c].dataType
        out.append(F.col(c) if level == "FullAccess" else masked(F.col(c), technique).alias(c) if level == "MaskedAccess" else F.lit(None).cast(kind).alias(c))
    return df.select(*out)


def secured_views(spark: SparkSession, tables: dict[str, DataFrame], policies: list[ColumnPolicy], user: str, roles: list[str]) -> None:
    """Puts secured views in the place of the tables, so that any SQL sees only what the user may."""
    for name, df in tables.items():
        secured(df, policies, name, user, roles).createOrReplaceTempView(name)


def rewrite(sql: str, policies: list[ColumnPolicy], table: str, columns: list[str], user: str, roles: list[str]) -> str:
    """The statement with masked and denied columns of its select list replaced; the functions are those of functions.text.register()."""
    m = re.match(r"(?is)(\s*SELECT\s+)(.*?)(\s+FROM\s.*)", sql)
    if not m:
        return sql
    levels = access(policies, table, columns, user, roles)

    def one(item: str) -> str:
        level, technique = levels.get(item.strip(), ("FullAccess", None))
        own = item.strip()
        return f"NULL AS {own}" if level == "NoAccess" else f"mask_{technique}({own}) AS {own}" if level == "MaskedAccess" else own

    return m[1] + ", ".join(map(one, m[2].split(","))) + m[3]
