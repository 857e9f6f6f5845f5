"""Which storage tier a file belongs to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """kind: manual, age (older than `limit` days), access (fewer than `limit` a month) or size (more than `limit` bytes)."""

    kind: str
    limit: int
    tier: str


#: The rules where none are given.
DEFAULT = (Rule("age", 90, "Archive"), Rule("age", 30, "Cold"), Rule("age", 7, "Warm"), Rule("access", 10, "Cold"), Rule("size", 10 << 30, "Archive"))


def tier_of(now: str, rules: tuple[Rule, ...] = DEFAULT) -> Column:
    """Manual rules win over age, age over access, access over size; of ages and sizes the largest limit passed, of accesses the smallest; else the file stays where it is."""
    age = F.floor((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 86_400_000_000)
    out: Column | None = None

    def add(test: Column, tier: str) -> None:
        nonlocal out
        out = F.when(test, tier) if out is None else out.when(test, tier)

    for r in [r for r in rules if r.kind == "manual"][:1]:
        add(F.lit(True), r.tier)
    for r in sorted((r for r in rules if r.kind == "age"), key=lambda r: -r.limit):
        add(age > r.limit, r.tier)
    for r in sorted((r for r in rules if r.kind == "access"), key=lambda r: r.limit):
        add(F.col("access_count_last_month") < r.limit, r.tier)
    for r in sorted((r for r in rules if r.kind == "size"), key=lambda r: -r.limit):
        add(F.col("size_bytes") > r.limit, r.tier)
    return F.col("tier") if out is None else out.otherwise(F.col("tier"))


def evaluate(files: DataFrame, now: str, rules: tuple[Rule, ...] = DEFAULT) -> DataFrame:
    """The files with target_tier and whether they move."""
    return files.withColumn("target_tier", tier_of(now, rules)).withColumn("moves", F.col("target_tier") != F.col("tier"))


def _store(path: str):
    """A path's file system and its place there; paths without scheme are local."""
    from pyarrow import fs

    path = path.replace("s3a://", "s3://", 1)
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def _moved(batches):
    """Moves each file of (path, target); one that an earlier try of the task has moved is left alone."""
    import pyarrow as pa
    from pyarrow import fs

    for batch in batches:
        for path, target in zip(batch.column("path").to_pylist(), batch.column("target").to_pylist(), strict=True):
            (a, source), (b, end) = _store(path), _store(target)
            if a.get_file_info(source).type == fs.FileType.NotFound and b.get_file_info(end).type != fs.FileType.NotFound:
                continue
            b.create_dir(end.rpartition("/")[0], recursive=True)
            if a.equals(b):
                a.move(source, end)
            else:
                part = f"{end}.part"
                with a.open_input_stream(source) as x, b.open_output_stream(part) as y:
                    while data := x.read(8 << 20):
                        y.write(data)
                b.move(part, end)
                a.delete_file(source)
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("target")], ["path", "target"])


def move(spark, files: DataFrame, root: str) -> list[tuple[str, str]]:
    """Moves the files whose tier changes to <root>/<tier>/<name>, in tasks: a rename within a store, else copied in parts. files is the manifest's listing of them; the driver gets the moved paths."""
    todo = files.where("moves").select("path", F.concat(F.lit(f"{root}/"), F.lower("target_tier"), F.lit("/"), F.element_at(F.split("path", "/"), -1)).alias("target"))
    return [tuple(r) for r in todo.mapInArrow(_moved, "path string, target string").collect()]
