"""Anonymization of columns, technique by technique.

All but three are Spark expressions. Pseudonyms, perturbation and differential privacy
reproduce the draws of Java's seeded generator from a value's hash, which runs
as Arrow-batched vectors of unsigned integers.

Perturbation and differential privacy draw the same noise for the same value, so
repeated releases do not average out, but the noise can be recomputed by whoever
knows the value: it is no differential privacy in the strict sense.
"""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HEX_DIGESTS = {"SHA-256": lambda c: F.sha2(c, 256), "SHA-512": lambda c: F.sha2(c, 512), "SHA-384": lambda c: F.sha2(c, 384), "SHA-1": F.sha1, "MD5": F.md5}


def mask(c: Column, char: str = "*", preserve_length: bool = True) -> Column:
    """First and last character stay; texts of two or fewer are all masked. Without preserve_length the mask is three characters."""
    n = F.char_length(c)
    fill = lambda k: F.repeat(F.lit(char), k if preserve_length else F.lit(3))
    return F.when(n <= 2, fill(n)).otherwise(F.concat(F.left(c, F.lit(1)), fill(n - 2), F.right(c, F.lit(1))))


def hashed(c: Column, algorithm: str = "SHA-256", salt: str | None = None) -> Column:
    return _HEX_DIGESTS[algorithm](F.concat(F.lit(salt), c) if salt is not None else c)


def token(c: Column, prefix: str = "tok") -> Column:
    """prefix_ and the name UUID (version 3) of the value's SHA-256 in hex."""
    h = F.md5(F.sha2(c, 256))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.lit(f"{prefix}_"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def number(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("double")


def generalize(c: Column, ranges: list[tuple[float, float, str]]) -> Column:
    """The label of the first range with low <= x < high; other values stay."""
    x, text = number(c), c.cast("string")
    out = F.when(F.lit(False), text)
    for low, high, label in ranges:
        out = out.when((x >= low) & (x < high), F.lit(label))
    return out.otherwise(text)


def suppress(c: Column) -> Column:
    return F.when(c.isNotNull(), F.lit(""))


def _bucket(x: Column, width: Column) -> Column:
    low = (F.floor(x / width) * width).cast("bigint")
    return F.concat(low.cast("string"), F.lit("-"), (low + width.cast("bigint")).cast("string"))


def _starred(text: Column) -> Column:
    n = F.char_length(text)
    return F.when(n > 2, F.concat(F.left(text, F.lit(1)), F.repeat(F.lit("*"), n - 1))).otherwise(F.repeat(F.lit("*"), F.greatest(n, F.lit(1))))


def k_anonymous(c: Column, k: int) -> Column:
    """Numbers become low-high of buckets k wide; texts keep their first character."""
    return F.coalesce(_bucket(number(c), F.lit(float(max(k, 1)))), _starred(c.cast("string")))


def k_anonymous_column(df: DataFrame, name: str, k: int) -> DataFrame:
    """As k_anonymous, with buckets of a round width such that about k values share one."""
    x = number(F.col(name))
    stats = df.agg(F.count(x).alias("n"), (F.max(x) - F.min(x)).alias("range"))
    raw = F.col("range") / F.greatest(F.floor(F.col("n") / max(k, 1)), F.lit(1))
    magnitude = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(raw, F.lit(1.0)))))
    width = F.when(F.col("n") > 0, F.greatest(F.ceil(raw / magnitude) * magnitude, F.lit(1.0))).otherwise(F.lit(float(max(k, 1))))
    # one row of statistics
    return df.crossJoin(F.broadcast(stats.select(width.alias("__width")))).withColumn(name, F.coalesce(_bucket(x, F.col("__width")), _starred(F.col(name).cast("string")))).drop("__width")


def format_preserving(c: Column, key: str) -> Column:
    """Digits and ASCII letters are shifted within their kind by the key's bytes, place by place; others stay."""
    shifts = F.array(*[F.lit(b) for b in hashlib.sha256(key.encode()).hexdigest().encode()])

    def one(ch: Column, i: Column) -> Column:
        code, by = F.ascii(ch), F.element_at(shifts, i % 64 + 1)
        turn = lambda first, n: F.char(((code - first + by % n) % n + first).cast("bigint"))
        return F.when(ch.between("0", "9") & (F.octet_length(ch) == 1), turn(48, 10)).when(ch.rlike("^[a-z]$"), turn(97, 26)).when(ch.rlike("^[A-Z]$"), turn(65, 26)).otherwise(ch)

    return F.when(F.char_length(c) > 0, F.array_join(F.transform(F.split(c, ""), one), "")).otherwise(c)


class JavaRandom:
    """The public 48-bit linear congruential generator of java.util.Random, one generator for each seed of a vector."""

    def __init__(self, seeds: np.ndarray):
        self.state = (seeds.astype(np.int64).astype(np.uint64) ^ np.uint64(0x5DEECE66D)) & np.uint64((1 << 48) - 1)

    def next(self, bits: int, live: np.ndarray | slice = slice(None)) -> np.ndarray:
        self.state[live] = (self.state[live] * np.uint64(0x5DEECE66D) + np.uint64(0xB)) & np.uint64((1 << 48) - 1)
        out = (self.state[live] >> np.uint64(48 - bits)).astype(np.int64)
        return out - (1 << 32) * (out >> 31 & 1) if bits == 32 else out

    def integers(self, n: int) -> np.ndarray:
        out = self.next(31)
        if n & (n - 1) == 0:
            return n * out >> 31
        value = out % n
        redo = np.flatnonzero(out - value + (n - 1) >= 1 << 31)
        while len(redo):
            again = self.next(31, redo)
            value[redo] = again % n
            redo = redo[again - again % n + (n - 1) >= 1 << 31]
        return value

    def doubles(self, live: np.ndarray | slice = slice(None)) -> np.ndarray:
        high = self.next(26, live)
        return ((high << 27) + self.next(27, live)) * 2.0**-53

    def gaussians(self) -> np.ndarray:
        out, live = np.empty(len(self.state)), np.arange(len(self.state))
        while len(live):
            a, b = 2 * self.doubles(live) - 1, 2 * self.doubles(live) - 1
            s = a * a + b * b
            good = (s < 1) & (s != 0)
            out[live[good]] = a[good] * np.sqrt(-2 * np.log(s[good]) / s[good])
            live = live[~good]
        return out


def java_hash(s: str) -> int:
    """Java's String.hashCode."""
    h = 0
    units = s.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(units), 2):
        h = (31 * h + (units[i] | units[i + 1] << 8)) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def pseudonyms(values: pd.Series, seed: int) -> pd.Series:
    """Eight letters for each text."""
    keys = np.array([seed ^ java_hash(hashlib.sha256(v.encode()).hexdigest()) for v in values], np.int64)
    random = JavaRandom(keys)
    letters = np.stack([random.integers(26) for _ in range(8)], axis=1) + 97 if len(keys) else np.empty((0, 8), np.int64)
    return pd.Series([bytes(x.astype(np.uint8)).decode() for x in letters], index=values.index, dtype=object)


def _noisy(values: pd.Series, noise) -> pd.Series:
    x = pd.to_numeric(values.str.strip(), errors="coerce")
    some = x.notna()
    out = values.astype(object).copy()
    if some.any():
        moved = x[some].to_numpy(float) + noise(JavaRandom(np.array([java_hash(v) for v in values[some]], np.int64)))
        out[some] = [f"{m:.2f}" if "." in v else str(math.floor(m + 0.5)) for v, m in zip(values[some], moved, strict=True)]
    return out


def perturbed(values: pd.Series, scale: float) -> pd.Series:
    """Numbers with Gaussian noise; two decimals where the text has a point, else rounded."""
    return _noisy(values, lambda random: random.gaussians() * scale)


def laplace(values: pd.Series, epsilon: float) -> pd.Series:
    """Numbers with Laplace noise of scale 1 / epsilon."""

    def noise(random: JavaRandom) -> np.ndarray:
        u = random.doubles() - 0.5
        return -np.where(u < 0, -1.0, 1.0) / max(epsilon, 1e-10) * np.log(1 - 2 * np.abs(u))

    return _noisy(values, noise)


def _udf(f, *args):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(s), index=s.index, dtype=object)
        some = s.notna()
        if some.any():
            out[some] = f(s[some], *args)
        return out

    return run


def pseudonymize(c: Column, seed: int) -> Column:
    return _udf(pseudonyms, seed)(c.cast("string"))


def perturb(c: Column, scale: float) -> Column:
    return _udf(perturbed, scale)(c.cast("string"))


def differentially_private(c: Column, epsilon: float) -> Column:
    return _udf(laplace, epsilon)(c.cast("string"))


TECHNIQUES = {"masking": mask, "hashing": hashed, "tokenization": token, "generalization": generalize, "pseudonymization": pseudonymize, "perturbation": perturb, "suppression": suppress, "k_anonymity": k_anonymous, "differential_privacy": differentially_private, "format_preserving": format_preserving}


@dataclass(frozen=True)
class Policy:
    """A technique for a column, with its arguments."""

    column: str
    technique: str
    options: dict = field(default_factory=dict)


def apply(df: DataFrame, policies: list[Policy]) -> DataFrame:
    """Policies in order; several of one column follow each other."""
    for p in policies:
        if p.technique == "k_anonymity_column":
            df = k_anonymous_column(df, p.column, **p.options)
        else:
            df = df.withColumn(p.column, TECHNIQUES[p.technique](F.col(p.column), **p.options))
    return df


def to_json(policies: list[Policy]) -> str:
    return json.dumps([asdict(p) for p in policies])


def from_json(text: str) -> list[Policy]:
    return [Policy(p["column"], p["technique"], {k: [tuple(x) for x in v] if k == "ranges" else v for k, v in p["options"].items()}) for p in json.loads(text)]
