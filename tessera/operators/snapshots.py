"""Tables as snapshots: time travel, optimistic commits and garbage collection.

A table's state is one JSON manifest. A commit writes new Parquet files, then the
manifest of the next number under a name that may not exist yet, so of two
writers that began from one snapshot, the second fails and can try again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.files import _fs, read_text

SCHEMA = "snapshot_id bigint, txn_id string, table string, ts timestamp_ntz, data_files array<string>, parent_id bigint, is_active boolean"
RETENTION_DAYS = 30


class ConflictError(RuntimeError):
    """Someone else has committed first."""


@dataclass(frozen=True)
class Snapshot:
    snapshot_id: int
    txn_id: str
    ts: str
    data_files: tuple[str, ...]
    parent_id: int | None


class SnapshotTable:
    """A table below a path that the whole cluster reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def snapshots(self) -> list[Snapshot]:
        folder, store = _fs(self.spark, f"{self.path}/_manifests")
        if not store.exists(folder):
            return []
        names = sorted(s.getPath().getName() for s in store.listStatus(folder) if s.getPath().getName().endswith(".json"))
        out = []
        for n in names:
            raw = json.loads(read_text(self.spark, f"{self.path}/_manifests/{n}"))
            out.append(Snapshot(**(raw | {"data_files": tuple(raw["data_files"])})))
        return out

    def current(self) -> Snapshot | None:
        return max(self.snapshots(), key=lambda s: s.snapshot_id, default=None)

    def as_of(self, ts: str) -> Snapshot | None:
        """The latest snapshot that is not after the time."""
        return max((s for s in self.snapshots() if s.ts <= ts), key=lambda s: s.snapshot_id, default=None)

    def read(self, snapshot_id: int | None = None, ts: str | None = None) -> DataFrame:
        own = self.as_of(ts) if ts else self.current() if snapshot_id is None else next((s for s in self.snapshots() if s.snapshot_id == snapshot_id), None)
        if own is None:
            raise LookupError("no such snapshot")
        return self.spark.read.parquet(*[f"{self.path}/{f}" for f in own.data_files])

    def begin(self) -> "Transaction":
        return Transaction(self)

    def _publish(self, s: Snapshot) -> None:
        path, store = _fs(self.spark, f"{self.path}/_manifests/{s.snapshot_id:020d}.json")
        try:
            out = store.create(path, False)  # fails if another writer has it
        except Exception as e:
            raise ConflictError(f"snapshot {s.snapshot_id} exists") from e
        out.write(bytearray(json.dumps(asdict(s)).encode()))
        out.close()

    def collect_garbage(self, now: str, days: int = RETENTION_DAYS, dry_run: bool = False) -> tuple[list[int], list[str]]:
        """Snapshots older than the days and the files that only they use; the newest snapshot always stays."""
        from datetime import datetime, timedelta

        every = sorted(self.snapshots(), key=lambda s: s.snapshot_id)
        limit = (datetime.fromisoformat(now) - timedelta(days=days)).isoformat(sep=" ")
        old = [s for s in every[:-1] if s.ts < limit]
        kept = {f for s in every if s not in old for f in s.data_files}
        files = sorted({f for s in old for f in s.data_files} - kept)
        if not dry_run:
            for f in [*files, *[f"_manifests/{s.snapshot_id:020d}.json" for s in old]]:
                path, store = _fs(self.spark, f"{self.path}/{f}")
                store.delete(path, True)
        return [s.snapshot_id for s in old], files


class Transaction:
    """Writes that become visible together. Reads see the snapshot from which it began."""

    def __init__(self, table: SnapshotTable):
        self.table, self.base, self.id = table, table.current(), uuid.uuid4().hex
        self.added: list[str] = []
        self.replaced = False

    def read(self) -> DataFrame:
        if self.base is None:
            raise LookupError("the table is empty")
        return self.table.read(self.base.snapshot_id)

    def append(self, df: DataFrame) -> None:
        name = f"data/{self.id}-{len(self.added)}"
        df.write.parquet(f"{self.table.path}/{name}")
        self.added.append(name)

    def overwrite(self, df: DataFrame) -> None:
        self.rollback()
        self.append(df)
        self.replaced = True

    def rollback(self) -> None:
        for name in self.added:
            path, store = _fs(self.table.spark, f"{self.table.path}/{name}")
            store.delete(path, True)
        self.added, self.replaced = [], False

    def commit(self, ts: str) -> Snapshot:
        files = (() if self.replaced or self.base is None else self.base.data_files) + tuple(self.added)
        s = Snapshot((self.base.snapshot_id if self.base else 0) + 1, self.id, ts, files, self.base.snapshot_id if self.base else None)
        try:
            self.table._publish(s)
        except ConflictError:
            self.rollback()
            raise
        return s


def as_of(snapshots: DataFrame, ts: str) -> DataFrame:
    """Each table's latest active snapshot that is not after the time."""
    w = Window.partitionBy("table").orderBy(F.desc("ts"), F.desc("snapshot_id"))
    rows = snapshots.where(F.col("is_active") & (F.col("ts") <= F.lit(ts).cast("timestamp_ntz")))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def garbage_plan(snapshots: DataFrame, now: str, days: int = RETENTION_DAYS) -> DataFrame:
    """(table, file) that only expired snapshots use; each table's newest snapshot never expires."""
    newest = Window.partitionBy("table").orderBy(F.desc("snapshot_id"))
    rows = snapshots.where("is_active").withColumn("__n", F.row_number().over(newest))
    old = (F.col("ts") < F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")) & (F.col("__n") > 1)
    files = rows.select("table", old.alias("old"), F.explode("data_files").alias("file"))
    return files.groupBy("table", "file").agg(F.min("old").alias("all_old")).where("all_old").select("table", "file")
