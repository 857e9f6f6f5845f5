"""Text functions that Spark does not have, and the names under which SQL finds them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def digits(s: Column) -> Column:
    return F.regexp_replace(s, r"[^0-9]", "")


def luhn_valid(s: Column) -> Column:
    """Luhn's check over all digits of a text; two digits at least."""
    own = digits(s)
    return F.when(F.char_length(own) >= 2, F.call_function("luhn_check", own)).otherwise(F.lit(False))


def sha256_base64(s: Column) -> Column:
    return F.base64(F.unhex(F.sha2(s, 256)))


def hmac_sha256(s: Column, key: str) -> Column:
    """Base64 of the HMAC, from two rounds of SHA-256 on padded keys."""
    import hashlib

    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(s, "UTF-8")), 256))
    return F.base64(F.unhex(F.sha2(F.concat(F.lit(outer), first), 256)))


def ngrams(s: Column, low: int, high: int) -> Column:
    """All substrings of `low` to `high` characters, by place and then length."""
    size = F.char_length(s)
    return F.filter(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.transform(F.sequence(F.lit(low), F.lit(high)), lambda n: F.when(i + n - 1 <= size, F.substring(s, i, n))))), lambda x: x.isNotNull())


def edit_distance(a: Column, b: Column, most: int = 2) -> Column:
    """Levenshtein's distance, -1 beyond `most`."""
    return F.levenshtein(a, b, most)


def shortened(s: Column, most: int = 2) -> Column:
    """The texts that s becomes by leaving out up to `most` characters: any two texts within that many edits share one."""
    less = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(x), F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.char_length(x))))
    out = level = F.array(s)
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, less)))
        out = F.array_union(out, level)
    return out


def near_pairs(left: DataFrame, right: DataFrame, a: str, b: str, most: int = 2) -> DataFrame:
    """All pairs of rows whose texts a and b are within `most` edits, by an equi-join of shortened texts instead of comparing all with all."""
    x = left.select(F.col(a).alias("__a")).distinct().select("__a", F.explode(shortened(F.col("__a"), most)).alias("__key"))
    y = right.select(F.col(b).alias("__b")).distinct().select("__b", F.explode(shortened(F.col("__b"), most)).alias("__key"))
    near = x.join(y, "__key").select("__a", "__b").distinct().where(F.levenshtein("__a", "__b", most) >= 0)
    return left.join(near, F.col(a) == F.col("__a")).join(right, F.col("__b") == F.col(b)).drop("__a", "__b")


def json_type(text: str) -> str:
    """The engine's type of a JSON document: Boolean, Int64, Float64, Utf8, List<...> or Struct<...>."""

    def kind(x) -> str:
        if isinstance(x, bool):
            return "Boolean"
        if isinstance(x, int):
            return "Int64"
        if isinstance(x, float):
            return "Float64"
        if isinstance(x, list):
            return f"List<{kind(x[0]) if x else 'Utf8'}>"
        if isinstance(x, dict):
            return "Struct<" + ",".join(f"{k}:{kind(v)}" for k, v in x.items()) + ">"
        return "Utf8"

    return kind(json.loads(text))


_VOWELS = frozenset("AEIOU")


def metaphone(word: str, most: int = 4) -> str:
    """A phonetic code of an English word, after Lawrence Philips' published rules."""
    w = "".join(c for c in word.upper() if "A" <= c <= "Z")
    if not w:
        return ""
    for start, instead in (("AE", "E"), ("GN", "N"), ("KN", "N"), ("PN", "N"), ("WR", "R"), ("X", "S"), ("WH", "W")):
        if w.startswith(start):
            w = instead + w[len(start) :]
            break
    out: list[str] = []
    at = lambda i: w[i] if 0 <= i < len(w) else ""
    i = 0
    while i < len(w) and len(out) < most:
        c, n = w[i], at(i + 1)
        skip = 1
        if c == at(i - 1) and c != "C":
            i += 1
            continue
        if c in _VOWELS:
            code = c if i == 0 else ""
        elif c == "B":
            code = "" if at(i - 1) == "M" and not n else "B"
        elif c == "C":
            if n == "I" and at(i + 2) == "A" or n == "H":
                code, skip = "X", 2 if n == "H" else 1
            elif n in ("I", "E", "Y"):
                code = "" if at(i - 1) == "S" else "S"
            else:
                code = "K"
        elif c == "D":
            code, skip = ("J", 2) if n == "G" and at(i + 2) in ("E", "Y", "I") else ("T", 1)
        elif c == "G":
            if n == "H" and at(i + 2) not in _VOWELS or n == "N" and i + 2 >= len(w) or n == "N" and w[i:] == "GNED":
                code = ""
            else:
                code = "J" if n in ("I", "E", "Y") and at(i - 1) != "G" else "K"
        elif c == "H":
            code = "H" if n in _VOWELS and at(i - 1) not in ("C", "S", "P", "T", "G") else ""
        elif c in "FJLMNR":
            code = c
        elif c == "K":
            code = "" if at(i - 1) == "C" else "K"
        elif c == "P":
            code, skip = ("F", 2) if n == "H" else ("P", 1)
        elif c == "Q":
            code = "K"
        elif c == "S":
            if n == "H":
                code, skip = "X", 2
            else:
                code = "X" if n == "I" and at(i + 2) in ("O", "A") else "S"
        elif c == "T":
            if n == "H":
                code, skip = "0", 2
            elif n == "I" and at(i + 2) in ("O", "A"):
                code = "X"
            else:
                code = "" if n == "C" and at(i + 2) == "H" else "T"
        elif c == "V":
            code = "F"
        elif c in "WY":
            code = c if n in _VOWELS else ""
        elif c == "X":
            code = "KS"
        else:
            code = "S"
        out.extend(code)
        i += skip
    return "".join(out)[:most]


def phonetic(s: Column) -> Column:
    """metaphone() of a column, in Arrow batches."""

    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        return words.map(metaphone, na_action="ignore")

    return run(s)


def register(spark: SparkSession) -> None:
    """The masking functions that rewritten queries call, as SQL functions."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION mask_mask(s STRING) RETURNS STRING RETURN CASE WHEN char_length(s) <= 4 THEN repeat('*', char_length(s)) ELSE concat(left(s, 2), repeat('*', char_length(s) - 4), right(s, 2)) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION mask_hash(s STRING) RETURNS STRING RETURN base64(unhex(sha2(s, 256)))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION mask_null(s STRING) RETURNS STRING RETURN 'NULL'")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION mask_redact(s STRING) RETURNS STRING RETURN '[REDACTED]'")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION mask_partial(s STRING) RETURNS STRING RETURN CASE WHEN char_length(s) <= 4 THEN repeat('*', char_length(s)) ELSE concat(left(s, 4), repeat('*', char_length(s) - 4)) END")
