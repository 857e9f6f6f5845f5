"""Materialized views: kept as Parquet, refreshed in full or by what is new, and used in the place of an equal query."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.cache import tables_in
from tessera.sources.files import _fs, read_text, write_text

MODES = ("on_demand", "scheduled", "incremental", "continuous")
#: Aggregates that can be merged: function of the parts.
MERGED = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class View:
    name: str
    namespace: str
    sql: str
    mode: str = "on_demand"
    base_tables: tuple[str, ...] = ()
    partition_columns: tuple[str, ...] = ()
    valid: bool = False
    refreshed_at: str | None = None
    version: str | None = None
    merge: tuple[tuple[str, str], ...] = ()  # (column, function of MERGED) of an aggregating view; the others are its keys


class Views:
    """The views below a path that the whole cluster reads; each refresh writes a new version and then names it in the registry."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        text = read_text(spark, f"{self.path}/views.json")
        self.views = {v["name"]: View(**{k: tuple(map(tuple, x)) if k == "merge" else tuple(x) if isinstance(x, list) else x for k, x in v.items()}) for v in json.loads(text or "[]")}

    def _save(self) -> None:
        write_text(self.spark, f"{self.path}/views.json", json.dumps([asdict(v) for v in self.views.values()]))

    def create(self, name: str, sql: str, namespace: str = "default", mode: str = "on_demand", partition_columns: tuple[str, ...] = (), merge: tuple[tuple[str, str], ...] = ()) -> View:
        if name in self.views or mode not in MODES:
            raise ValueError(name if name in self.views else mode)
        self.views[name] = View(name, namespace, sql, mode, tuple(sorted(tables_in(sql))), partition_columns, merge=merge)
        self._save()
        return self.views[name]

    def drop(self, name: str) -> None:
        path, store = _fs(self.spark, f"{self.path}/{name}")
        store.delete(path, True)
        del self.views[name]
        self._save()

    def list(self, namespace: str | None = None) -> list[View]:
        return [v for v in self.views.values() if namespace in (None, v.namespace)]

    def invalidate(self, table: str) -> list[str]:
        """Views that read the table are not used until they are refreshed."""
        hit = [n for n, v in self.views.items() if table.lower() in v.base_tables]
        for n in hit:
            self.views[n] = replace(self.views[n], valid=False)
        self._save()
        return hit

    def read(self, name: str) -> DataFrame:
        v = self.views[name]
        return self.spark.read.parquet(f"{self.path}/{name}/{v.version}")

    def _publish(self, name: str, df: DataFrame, now: str) -> View:
        version, old = uuid.uuid4().hex, self.views[name].version
        writer = df.write
        if self.views[name].partition_columns:
            writer = writer.partitionBy(*self.views[name].partition_columns)
        writer.parquet(f"{self.path}/{name}/{version}")
        self.views[name] = replace(self.views[name], version=version, valid=True, refreshed_at=now)
        self._save()
        if old:
            path, store = _fs(self.spark, f"{self.path}/{name}/{old}")
            store.delete(path, True)
        return self.views[name]

    def refresh(self, name: str, now: str) -> View:
        return self._publish(name, self.spark.sql(self.views[name].sql), now)

    def due(self, schedules: dict[str, str], now: datetime) -> list[str]:
        """Scheduled views whose cron line has named a minute since their last refresh, up to now."""
        late = lambda v: v.refreshed_at is None or next_run(schedules[v.name], datetime.fromisoformat(v.refreshed_at)) <= now
        return sorted(v.name for v in self.views.values() if v.mode == "scheduled" and v.name in schedules and late(v))

    def refresh_incrementally(self, name: str, now: str, new_rows: DataFrame) -> View:
        """Adds the view of the new rows: appended, or merged by key where the view aggregates. Without an earlier version, the new rows are the view."""
        v = self.views[name]
        if v.version is None:
            return self._publish(name, new_rows, now)
        both = self.read(name).unionByName(new_rows)
        if v.merge:
            calls = dict(v.merge)
            both = both.groupBy(*[c for c in both.columns if c not in calls]).agg(*[MERGED[f](c).alias(c) for c, f in v.merge]).select(*new_rows.columns)
        return self._publish(name, both, now)

    def rewrite(self, df: DataFrame) -> DataFrame:
        """The view that answers the query, if a valid one has the same plan; else the query itself. Views over fewer tables are tried first."""
        for v in sorted(self.views.values(), key=lambda v: (len(v.base_tables), v.name)):
            if v.valid and v.version and df.sameSemantics(self.spark.sql(v.sql)):
                return self.read(v.name).select(*df.columns)
        return df


def _field(text: str, low: int, high: int) -> set[int]:
    """What a field of a cron line stands for: *, numbers, a-b, each with /step, and lists of them."""
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        first, _, last = span.partition("-")
        a = low if span == "*" else int(first)
        b = high if span == "*" or step and not last else int(last or first)
        out |= set(range(a, b + 1, int(step or 1)))
    if not out or min(out) < low or max(out) > high:
        raise ValueError(text)
    return out


def next_run(cron: str, after: datetime) -> datetime:
    """The first minute after `after` that a cron line of five fields names (Sunday is 0 or 7; with a day of the month and one of the week, either)."""
    minute, hour, day, month, week = cron.split()
    minutes, hours, months = sorted(_field(minute, 0, 59)), sorted(_field(hour, 0, 23)), _field(month, 1, 12)
    days, weekdays = _field(day, 1, 31), {d % 7 for d in _field(week, 0, 7)}
    at = after.replace(second=0, microsecond=0) + timedelta(minutes=1)
    for _ in range(366 * 8):
        by_day, by_week = at.day in days, at.isoweekday() % 7 in weekdays
        if at.month in months and (by_day or by_week if "*" not in (day, week) else by_day and by_week):
            for h in hours:
                for m in minutes:
                    if (h, m) >= (at.hour, at.minute):
                        return at.replace(hour=h, minute=m)
        at = at.replace(hour=0, minute=0) + timedelta(days=1)
    raise ValueError(f"{cron} names no day")


def interval_of(cron: str) -> str:
    """A trigger's interval for a cron line: */n in the minutes or hours, else a minute."""
    parts = cron.split()
    for part, unit in zip(parts, ("minutes", "hours"), strict=False):
        if part.startswith("*/") and part[2:].isdigit():
            return f"{int(part[2:])} {unit}"
    return "60 seconds"
