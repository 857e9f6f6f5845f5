"""A corpus pipeline: quality rules, near-duplicates, secrets, source weights, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns
of documents, whatever other columns docs has.

Null and empty texts have no words, so the first stage drops them; given to a later stage they pass it (the second
keeps each, as they are near nothing; packing gives each its one end token). Null ids are no group of
copies; null languages and sources stay, and a null source is a source of its own. Repeated rows are judged
one by one, the second stage keeps one of them, and copies that the fourth adds are packed as often as they
occur. Ties are settled by id. Long texts are worked on whole. An empty table passes as one.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import public_tokenizers
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, near_dedup, packing, quality, secret_scan

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a base rule or score below the threshold go. Null text breaks one."""
    return quality.judge(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the smallest id; of rows with one id, one. Null ids and texts stay."""
    return near_dedup.deduplicated(docs.select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars is counted again. All rows stay; null text stays null."""
    found = secret_scan.scan(docs.select(*COLUMNS))
    text = secret_scan.redact(F.col("text"), F.col("secrets"))
    return found.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated towards the sources' targets. Texts without words weigh nothing."""
    return mixing.repeated(mixing.mix(docs.select(*COLUMNS))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed windows, with their ids' checksums; at least one of every row."""
    out = packing.pack(docs.select(*COLUMNS), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_duplicates), ("secrets", secrets), ("source weights", source_weights), ("packing", packed)]

#: Signatures, hashed n-grams and the tokenizer have no SQL; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What they hand on is kept in the folder of spark.checkpoint.dir (where unset and all runs on this machine, as in tests: a temporary one); the last result is deleted when the program ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="tessera-pipeline-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    folder, docs = f"{shared}/pipeline-{uuid.uuid4().hex}", spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    atexit.register(_delete, files, path(folder))
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            files.delete(path(f"{folder}/{k - 1}"), True)
    return docs


def _delete(files, folder) -> None:
    try:
        files.delete(folder, True)
    except (Py4JError, OSError):  # the JVM has ended before
        pass
