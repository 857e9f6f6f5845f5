"""Full-text search: analyzers, an inverted index as a table, queries and ranking.

Terms of queries are lower-cased but not analysed. Document lengths are exact. A fuzzy
match counts a swap of two letters as two edits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import ngrams, phonetic

#: BM25's parameters, and results at most.
K1, B, MAX_RESULTS = 1.2, 0.75, 100
#: Endings that the light stemmers of languages take off, longest first, and how much of a word must stay.
ENDINGS = {
    "english": ("ations", "ingly", "ation", "edly", "ies", "ing", "ed", "es", "ly", "s"),
    "spanish": ("aciones", "amente", "acion", "mente", "iendo", "ando", "os", "as", "es", "o", "a", "e", "s"),
    "french": ("issements", "issement", "ements", "ement", "ations", "ation", "euses", "euse", "eux", "ées", "ée", "er", "es", "e", "s"),
    "german": ("ungen", "heiten", "keiten", "ung", "heit", "keit", "ern", "em", "en", "er", "es", "e", "s"),
    "italian": ("azioni", "amente", "azione", "mente", "ando", "endo", "i", "e", "a", "o"),
    "dutch": ("heden", "ingen", "heid", "ing", "en", "e", "s"),
    "portuguese": ("amente", "ações", "mente", "ação", "ando", "os", "as", "o", "a", "e", "s"),
    "russian": ("остями", "ениями", "ость", "ение", "ами", "ями", "ого", "ему", "ые", "ая", "ой", "ый", "ы", "и", "а", "е", "о", "у", "ь"),
}
STEM_LENGTH = 3


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)


def analyzed(text: Column, analyzer: str = "standard", stop_words: tuple[str, ...] = (), low: int = 2, high: int = 3) -> Column:
    """The terms of a text: standard, ngram (low to high characters of the whole text), phonetic (see index()), or a language of ENDINGS."""
    if analyzer == "ngram":
        return ngrams(F.lower(F.coalesce(text, F.lit(""))), low, high)
    words = tokens(text)
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(*stop_words))
    if analyzer in ("standard", "phonetic"):
        return words
    if analyzer not in ENDINGS:
        raise ValueError(f"no analyzer {analyzer}; there are standard, ngram, phonetic, {', '.join(ENDINGS)}")
    ending = "(?:" + "|".join(ENDINGS[analyzer]) + ")$"
    return F.transform(words, lambda w: F.when(F.char_length(F.regexp_replace(w, ending, "")) >= STEM_LENGTH, F.regexp_replace(w, ending, "")).otherwise(w))


def index(docs: DataFrame, id_column: str, text_column: str, analyzer: str = "standard", **options) -> DataFrame:
    """(id, column, term, tf, positions, length): the inverted index. Partitioned writes by term make its queries read little."""
    words = docs.select(F.col(id_column).alias("id"), F.posexplode(analyzed(F.col(text_column), analyzer, **options)).alias("position", "term"))
    if analyzer == "phonetic":
        words = words.withColumn("term", phonetic(F.col("term"))).where("term <> ''")
    sizes = docs.select(F.col(id_column).alias("id"), F.size(analyzed(F.col(text_column), analyzer, **options)).alias("length"))
    terms = words.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("position")).alias("positions"))
    return terms.join(sizes, "id").select("id", F.lit(text_column).alias("column"), "term", "tf", "positions", "length")


def _ids(idx: DataFrame, test: Column) -> DataFrame:
    return idx.where(test).select("id").distinct()


def boolean(idx: DataFrame, must: tuple[str, ...] = (), should: tuple[str, ...] = (), must_not: tuple[str, ...] = ()) -> DataFrame:
    """Ids with all of must, none of must_not, and, where must is empty, one of should. One pass over the query's terms."""
    low = lambda ts: sorted({t.lower() for t in ts})
    must_, should_, not_ = low(must), low(should), low(must_not)
    if not must_ and not should_:
        return idx.select("id").limit(0)
    hits = idx.where(F.col("term").isin(*must_, *should_, *not_)).groupBy("id").agg(*[F.count_distinct(F.when(F.col("term").isin(*ts), F.col("term"))).alias(n) if ts else F.lit(0).alias(n) for ts, n in ((must_, "m"), (should_, "s"), (not_, "n"))])
    return hits.where((F.col("m") == len(must_)) & (F.col("n") == 0) & (F.lit(bool(must_)) | (F.col("s") > 0))).select("id")


def prefix(idx: DataFrame, start: str) -> DataFrame:
    return _ids(idx, F.startswith("term", F.lit(start.lower())))


def wildcard(idx: DataFrame, pattern: str) -> DataFrame:
    """* stands for any characters, ? for one."""
    escaped = reduce(lambda p, c: p.replace(c, "\\" + c), ("\\", "%", "_"), pattern.lower())
    return _ids(idx, F.col("term").like(escaped.replace("*", "%").replace("?", "_")))


def fuzzy(idx: DataFrame, term: str, edits: int = 2) -> DataFrame:
    most = min(max(edits, 0), 2)
    return _ids(idx, F.levenshtein("term", F.lit(term.lower()), most).between(0, most))


def phrase(idx: DataFrame, text: str, slop: int = 0) -> DataFrame:
    """Ids that hold the words in a row, or with slop, each at most so far from its place."""
    words = text.lower().split()
    if not words:
        return idx.select("id").limit(0)
    # every word's positions, less its place in the phrase, must meet within slop
    hits = idx.where(F.col("term").isin(*words)).groupBy("id").agg(*[F.flatten(F.collect_list(F.when(F.col("term") == w, F.transform("positions", _less(i))))).alias(f"p{i}") for i, w in enumerate(words)])
    starts = F.flatten(F.array(*[F.col(f"p{i}") for i in range(len(words))]))
    near = F.exists(starts, lambda v: reduce(lambda a, b: a & b, [_within(f"p{i}", v, slop) for i in range(len(words))]))
    return hits.where(near).select("id")


def _less(i: int):
    return lambda p: p - i


def _within(name: str, v: Column, slop: int) -> Column:
    return F.exists(name, lambda s: s.between(v, v + slop))


def ranked(idx: DataFrame, terms: list[str], model: str = "bm25", n: int = MAX_RESULTS, column: str | None = None) -> DataFrame:
    """(id, score): the n best by bm25 or tfidf. Statistics are those of the whole index; a column only filters."""
    words = sorted({t.lower() for t in terms})
    stats = idx.select("id", "length").distinct().agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))
    found = idx.where(F.col("term").isin(*words))
    frequency = found.groupBy("term").agg(F.count_distinct("id").alias("df"))
    found = found.where(F.col("column") == column) if column else found
    # a row of statistics, and a row for each of the query's terms
    scored = found.join(F.broadcast(frequency), "term").crossJoin(F.broadcast(stats))
    if model == "bm25":
        part = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    else:
        part = F.sqrt("tf") * F.pow(1 + F.log((F.col("n") + 1) / (F.col("df") + 1)), F.lit(2.0)) / F.sqrt("length")
    return scored.groupBy("id").agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.desc("score"), "id").limit(n)


def count(idx: DataFrame, terms: list[str]) -> int:
    return boolean(idx, should=tuple(terms)).count()
