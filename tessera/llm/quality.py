"""Quality rules: log-likelihood ratio of hashed n-grams between trusted target and raw corpus.

Words and word pairs are hashed to BUCKETS buckets. The raw corpus multinomial
counts every text; the trusted one counts a bounded sample of rows labelled as
good and is smoothed, bucket by bucket, towards the raw one. A document's score is the mean over
its n-grams of log(trusted / raw), so length does not matter; it is kept if its
base rules hold and the score reaches a fixed threshold.

The counts are added up in each task before they are shuffled; the driver gets
two counts a bucket, whatever the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import slices, window_hashes, word_hashes, words_of

BUCKETS = 1 << 16
#: Rows of the trusted sample at most: those whose ids have the lowest hashes.
TRUSTED_ROWS = 20_000
#: Added to what the sample holds of a bucket and to what it should hold, so that rare n-grams say little.
EVIDENCE = 10.0
#: Mean log ratio from which a document is kept.
THRESHOLD = -0.15
#: Fixed values of the base rules.
SYMBOLS, MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = b"#*$%&|<>", 10, 5, 20
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
STATS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def ngram_buckets(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs, and the text of each."""
    of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    pairs, of_pairs = window_hashes(words, starts, 2)
    return np.concatenate((words, pairs)).astype(np.uint64) % np.uint64(BUCKETS), np.concatenate((of, of_pairs))


def repeat_words(words: np.ndarray, starts: np.ndarray, n: int = REPEAT_WINDOW) -> np.ndarray:
    """By text: words in n-word windows that the text holds twice or more."""
    texts = len(starts) - 1
    hashes, of = window_hashes(words, starts, n)
    if not len(hashes):
        return np.zeros(texts, np.int64)
    # windows are numbered text by text, so a window's first word is its number plus n - 1 for each earlier text that has windows
    size = np.maximum(0, np.diff(starts) - n + 1)
    first = np.arange(len(hashes)) - np.repeat(np.cumsum(size) - size, size) + starts[of]
    order = np.lexsort((hashes, of))
    same = (hashes[order][1:] == hashes[order][:-1]) & (of[order][1:] == of[order][:-1])
    twice = np.zeros(len(hashes), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, first[twice], 1)
    np.add.at(edge, first[twice] + n, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(edge[:-1]) > 0)))
    return np.diff(covered[starts])


def duplicate_lines(text: str | None) -> int:
    """Lines with a word that are equal to an earlier line."""
    if not text or "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def base_stats(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The columns of STATS, and the texts' word hashes with where each text's begin."""
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    flat, starts = words_of(texts)
    words = word_hashes(flat)
    chars = np.concatenate(([0], np.cumsum(pc.utf8_length(flat).to_numpy(zero_copy_only=False))))[starts]
    ends, data = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1], np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data[ends[0] : ends[-1]]])))[ends - ends[0]]
    lines = np.fromiter(map(duplicate_lines, texts.to_pylist()), np.int64, len(texts))
    return {"n_words": np.diff(starts), "word_chars": np.diff(chars), "n_symbols": np.diff(symbols), "n_dup_lines": lines, "n_repeat_words": repeat_words(words, starts)}, words, starts


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS, id_column: str = "doc_id") -> list:
    """Ids of the trusted sample: quality 1 and not toxic, `rows` at most."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col(id_column).isNotNull())
    return [r[0] for r in good.select(F.col(id_column).alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(rows).collect()]


def log_ratios(docs: DataFrame, trusted: list) -> np.ndarray:
    """log(trusted / raw) by bucket. docs: doc_id and text."""
    good = set(trusted)

    def count(batches):
        sums = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for b in slices(batch):
                flat, starts = words_of(b.column("text"))
                buckets, of = ngram_buckets(word_hashes(flat), starts)
                own = np.fromiter((i in good for i in b.column("doc_id").to_pylist()), bool, b.num_rows)
                sums[0] += np.bincount(buckets.astype(np.int64), minlength=BUCKETS)
                sums[1] += np.bincount(buckets[own[of]].astype(np.int64), minlength=BUCKETS)
        used = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sums[0][used]), pa.array(sums[1][used])], ["bucket", "raw", "good"])

    rows = docs.mapInArrow(count, "bucket int, raw bigint, good bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[rows["bucket"]], target[rows["bucket"]] = rows["raw"], rows["good"]
    share = (raw + 1) / (raw.sum() + BUCKETS)
    return np.log((target + EVIDENCE) / (target.sum() * share + EVIDENCE))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept.

    Every document is judged by its whole text. Null text: no words, so
    base_failed. Empty labels: all scores are 0, and the base rules decide.
    Repeated rows each count and stay; an empty table gives no rows.
    Columns of docs stay, whatever their names; those named like the added ones are replaced.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    slim = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(slim, trusted_ids(labels)))  # BUCKETS numbers
    columns = [c for c in docs.columns if c not in added]

    def score(batches):
        for batch in batches:
            for b in slices(batch):
                stats, words, starts = base_stats(b.column("text"))
                buckets, of = ngram_buckets(words, starts)
                sums = np.bincount(of, weights=ratios.value[buckets.astype(np.int64)], minlength=b.num_rows) if len(of) else np.zeros(b.num_rows)
                stats["score"] = np.round(sums / np.maximum(1, np.bincount(of, minlength=b.num_rows)), 6)
                yield pa.RecordBatch.from_arrays([b.column("row"), *map(pa.array, stats.values())], ["row", *stats])

    # the row is one column here, so that its names can't clash
    rows = docs.select(F.struct(*columns).alias("row"), F.col(text_column).cast("string").alias("text"))
    schema = rows.select("row").schema
    for field in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
        schema = schema.add(field, "long")
    out = rows.mapInArrow(score, schema.add("score", "double"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold)).select("row.*", *added)
