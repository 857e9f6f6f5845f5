"""Secret scan: sliding-window Shannon entropy by character class, beside patterns.

Candidate strings are runs of token characters of 20 or more that hold a digit
and a letter. A window slides over each; counts of its characters, the sum of
c log2 c over them and the characters of each sort are kept by adding the one that enters
and taking off the one that leaves. A window's class (hexadecimal, base 32, letters of
one case with digits, or base 64) sets the entropy it needs. Windows above it are joined to spans; those that a
pattern's span or an allowed string touches are not looked at.
Only DataFrame functions are used; every row is worked on by itself, in time in proportion to its text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of the contract, kind by kind in the order of the kinds, and what a match needs.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # runs are maximal, so those of 24 and more are what [0-9a-f]+ leaves
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
#: Runs of token characters with a digit; then a letter is asked for.
CANDIDATE = r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/=_-]*[0-9])[A-Za-z0-9+/=_-]{20,}"
#: Strings that look random and are no secrets. Whole candidates: UUIDs, dates and times.
ALLOW = (r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T_]?[0-9:-]*$")
#: Paths of words, each with four digits at most at its end: what all hold, and what none does. (One pattern would repeat a group, which Java matches by recursion.)
PATH, NO_PATH = r"[A-Za-z0-9][/_-][A-Za-z]", r"[^A-Za-z0-9/_-]|[/_-]{2}|(?:^|[/_-])[0-9]|[0-9][A-Za-z]|[0-9]{5}"
#: Placeholders: windows that come within a window's length of one are not looked at.
PLACEHOLDER = r"(?i)example|placeholder|xxxx|0000000|1234567"
WINDOW, HEX_BITS, BASE64_BITS = 20, 3.0, 3.8
#: Windows over smaller alphabets, and what they need: two standard deviations below the mean entropy of random ones (3.79 - 2 x 0.18 and 3.85 - 2 x 0.17).
BASE32_BITS, ONE_CASE_BITS = 3.44, 3.5
#: Windows that are counted in one go, and matches whose places are added up in one go.
CHUNK = 256
#: Code of the first token character ("+"); counters of 5 bits in a long, longs for all of them ("+" to "z").
_FIRST, _IN_LONG, _LONGS = 43, 12, 7
#: What c log2 c is counted in, so that sums are exact.
_UNIT = 1 << 40
_BITS = [round(_UNIT * c * math.log2(c)) if c else 0 for c in range(WINDOW + 2)]
#: Sorts of characters, each counted in 5 bits of a long.
_SORTS = ("upper", "lower", "digit27", "digit", "sign", "not_hex")
_SPANS = "array<struct<s:int,e:int,m:string>>"


def let(value: Column, f) -> Column:
    """f(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def running(values: Column) -> Column:
    """The sum before each of the values (an array of at least one), in chunks, as an array grows by copying."""
    grow = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
    start = lambda: F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    chunks = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda j: F.aggregate(F.slice(v, j * CHUNK + 1, F.lit(CHUNK)), start(), grow))
    shifted = lambda own: F.zip_with(own, F.aggregate(F.transform(own, lambda c: c["at"]), start(), grow, lambda a: a["out"]), lambda c, o: F.transform(c["out"], lambda x: x + o))
    return let(values, lambda v: F.flatten(let(chunks(v), shifted)))


def matches(text: Column, regex: str, keep=None) -> Column:
    """array<struct<s, e, m>> of the leftmost non-overlapping matches, in code points; keep: which of them (a function of the match)."""
    found, gaps = F.regexp_extract_all(text, F.lit(regex), F.lit(0)), F.split(text, regex, -1)

    def placed(steps: Column) -> Column:
        before = running(F.transform(steps, lambda x: F.char_length(x["g"]) + F.char_length(x["m"])))
        out = F.zip_with(steps, before, lambda x, at: F.struct((at + F.char_length(x["g"])).alias("s"), (at + F.char_length(x["g"]) + F.char_length(x["m"])).alias("e"), x["m"].alias("m")))
        return F.filter(out, lambda x: keep(x["m"])) if keep else out

    steps = let(found, lambda m: F.arrays_zip(m.alias("m"), F.slice(gaps, F.lit(1), F.size(m)).alias("g")))
    return F.when(F.regexp_like(text, F.lit(regex)), let(steps, placed)).otherwise(F.array().cast(_SPANS))


def allowed(m: Column) -> Column:
    """Whether a candidate as a whole is on the allow list."""
    whole = F.reduce(F.array(*map(F.lit, ALLOW)), F.lit(False), lambda a, r: a | F.regexp_like(m, r))
    return whole | (F.regexp_like(m, F.lit(PATH)) & ~F.regexp_like(m, F.lit(NO_PATH)))


def _letters(m: Column) -> Column:
    """By character: the place of its counter (long, bits to shift), one in that place, and one in the places of its sorts."""
    one = lambda sort: 1 << 5 * _SORTS.index(sort)

    def sorts(c: Column) -> Column:
        is_hex = c.between(48, 57) | c.between(65, 70) | c.between(97, 102)
        sort = F.when(c.between(65, 90), one("upper")).when(c.between(97, 122), one("lower")).when(c.between(50, 55), one("digit27")).when(c.between(48, 57), one("digit")).otherwise(one("sign"))
        return (sort + F.when(is_hex, 0).otherwise(one("not_hex"))).cast("bigint")

    def letter(c: Column) -> Column:
        shift = (c - _FIRST) % _IN_LONG * 5
        return F.struct(F.floor((c - _FIRST) / _IN_LONG).cast("int").alias("at"), shift.alias("shift"), F.element_at(F.array(*[F.lit(1 << 5 * i).cast("bigint") for i in range(_IN_LONG)]), (c - _FIRST) % _IN_LONG + 1).alias("one"), sorts(c).alias("sorts"))

    return F.transform(F.transform(F.split(m, ""), F.ascii), letter)


def _enough(total: Column, sorts: Column) -> Column:
    """The kind of a window with that sum and these sorts of characters if its entropy is enough for its class: 3 hexadecimal, 4 others; else null."""
    n = {s: F.shiftright(sorts, 5 * i).bitwiseAND(F.lit(31)) for i, s in enumerate(_SORTS)}
    most = lambda bits: F.lit(int(_UNIT * WINDOW * (math.log2(WINDOW) - bits)))
    small = (n["sign"] == 0) & ((n["upper"] == 0) | (n["lower"] == 0))
    limit = F.when(n["not_hex"] == 0, most(HEX_BITS)).when(small & (n["digit"] == 0) & (n["digit27"] > 0), most(BASE32_BITS)).when(small & (n["digit"] + n["digit27"] > 0), most(ONE_CASE_BITS)).otherwise(most(BASE64_BITS))
    return F.when(total <= limit, F.when(n["not_hex"] == 0, 3).otherwise(4))


def _chunk_hits(letters: Column, first: Column, blocked: Column) -> Column:
    """array<struct<s, k>> of the windows with enough entropy that begin in a chunk and touch nothing blocked."""
    own = F.slice(letters, first + 1, F.lit(CHUNK + WINDOW - 1))
    none = F.lit(None).cast("struct<at:int,shift:int,one:bigint,sorts:bigint>")
    steps = let(own, lambda x: F.arrays_zip(x.alias("enters"), F.concat(F.array_repeat(none, WINDOW), F.slice(x, F.lit(1), F.greatest(F.size(x) - WINDOW, F.lit(0)))).alias("leaves")))
    count = lambda a, x: F.call_function("shiftright", F.get(a["counts"], x["at"]), x["shift"]).bitwiseAND(F.lit(31)).cast("int")
    bits = lambda c: F.get(F.lit(_BITS).cast("array<bigint>"), c)

    def judged(a: Column) -> Column:
        """The hits with the window that has just been completed."""
        kind = _enough(a["sum"], a["sorts"])
        return F.when((a["n"] >= WINDOW) & kind.isNotNull(), F.concat(a["out"], F.array(F.struct((first + a["n"] - WINDOW).cast("int").alias("s"), kind.alias("k"))))).otherwise(a["out"])

    def step(a: Column, x: Column) -> Column:
        new, old = x["enters"], x["leaves"]
        more = count(a, new)
        # one count grows, then another falls; the same letter's falls back
        fewer = count(a, old) + F.when((old["at"] == new["at"]) & (old["shift"] == new["shift"]), 1).otherwise(0)
        total = a["sum"] + bits(more + 1) - bits(more) - F.when(old.isNotNull(), bits(fewer) - bits(fewer - 1)).otherwise(0)
        counts = F.transform(a["counts"], lambda c, j: c + F.when(j == new["at"], new["one"]).otherwise(0) - F.when(j == old["at"], old["one"]).otherwise(0))
        return F.struct((a["n"] + 1).alias("n"), counts.alias("counts"), total.alias("sum"), (a["sorts"] + new["sorts"] - F.coalesce(old["sorts"], F.lit(0))).alias("sorts"), judged(a).alias("out"))

    start = F.struct(F.lit(0).alias("n"), F.array_repeat(F.lit(0).cast("bigint"), _LONGS).alias("counts"), F.lit(0).cast("bigint").alias("sum"), F.lit(0).cast("bigint").alias("sorts"), F.array().cast("array<struct<s:int,k:int>>").alias("out"))
    hits = F.aggregate(steps, start, step, judged)
    near = F.filter(blocked, lambda b: (b["s"] < first + (CHUNK + WINDOW)) & (b["e"] > first))
    return let(near, lambda bs: F.filter(hits, lambda h: ~F.exists(bs, lambda b: (b["s"] < h["s"] + WINDOW) & (b["e"] > h["s"]))))


def joined(hits: Column) -> Column:
    """array<struct<s, e, k>>: sorted windows that meet as one span, of the highest kind."""

    def spans(h: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(h)), lambda i: F.when(i == 1, True).otherwise(F.get(h, i - 1)["s"] - F.get(h, i - 2)["s"] > WINDOW))
        until = lambda b, j: F.coalesce(F.get(b, j + 1), F.size(h) + 1)
        return let(starts, lambda b: F.transform(b, lambda i, j: F.struct(F.get(h, i - 1)["s"].alias("s"), (F.get(h, until(b, j) - 2)["s"] + WINDOW).alias("e"), F.array_max(F.transform(F.slice(h, i, until(b, j) - i), lambda x: x["k"])).alias("k"))))

    return let(hits, lambda h: F.when(F.size(h) > 0, spans(h)).otherwise(F.array().cast("array<struct<s:int,e:int,k:int>>")))


def merged(spans: Column) -> Column:
    """Sorted array<struct<s, e>>, whose ends are sorted too, with those that meet as one."""

    def one(x: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.coalesce(F.get(x, i)["s"] > F.get(x, i - 1)["e"], F.lit(True)))
        return let(starts, lambda b: F.transform(b, lambda i, j: F.struct(F.get(x, i)["s"].alias("s"), F.get(x, F.coalesce(F.get(b, j + 1), F.size(x)) - 1)["e"].alias("e"))))

    return let(spans, lambda x: F.when(F.size(x) > 0, one(x)).otherwise(x))


def entropy_spans(m: Column, blocked: Column) -> Column:
    """array<struct<s, e, k>>: joined windows of the string m whose entropy is enough for their class; k: 3 if all are hexadecimal, else 4 (base 32 and one case too). blocked: array<struct<s, e>> that no window may touch."""
    chunks = F.sequence(F.lit(0), F.floor((F.char_length(m) - WINDOW) / CHUNK).cast("int"))
    return joined(let(_letters(m), lambda letters: F.flatten(F.transform(chunks, lambda j: _chunk_hits(letters, j * CHUNK, blocked)))))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents with secrets: array<struct<kind, start, end>> by start, then kind as in KINDS; code points, end exclusive.

    Pattern spans are all there; entropy spans are added beside them. Null text
    counts as empty: no spans. Repeated rows stay, an empty table gives no rows,
    and columns of docs stay, whatever their names (one named secrets is replaced).
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    columns = [c for c in docs.columns if c != "secrets"]
    # the row is one column here, so that its names can't clash
    rows = docs.select(F.struct(*columns).alias("row"), matches(text, ASSIGN, lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= 6).alias("k0"), matches(text, ACCESS, lambda m: F.char_length(m) >= 20).alias("k1"), matches(text, HEX).alias("k2"), matches(text, CANDIDATE, lambda m: F.regexp_like(m, F.lit("[A-Za-z]"))).alias("runs"))
    of_kind = lambda k: F.transform(f"k{k}", lambda x: F.struct(x["s"].alias("start"), F.lit(k).alias("k"), x["e"].alias("end")))
    rows = rows.withColumn("base", F.flatten(F.array(*[of_kind(k) for k in range(3)])))

    def blocked(x: Column) -> Column:
        """What no window of a candidate may touch, from its start on: base spans, and placeholders with their surroundings."""
        base = F.transform(F.filter("base", lambda b: (b["start"] < x["e"]) & (x["s"] < b["end"])), lambda b: F.struct((b["start"] - x["s"]).alias("s"), (b["end"] - x["s"]).alias("e")))
        return F.concat(base, merged(F.transform(matches(x["m"], PLACEHOLDER), lambda b: F.struct((b["s"] - WINDOW).alias("s"), (b["e"] + WINDOW).alias("e")))))

    found = lambda x: let(blocked(x), lambda bs: F.transform(entropy_spans(x["m"], bs), lambda w: F.struct((x["s"] + w["s"]).alias("start"), w["k"].alias("k"), (x["s"] + w["e"]).alias("end"))))
    extra = F.when(F.size("runs") > 0, F.flatten(F.transform(F.filter("runs", lambda x: ~allowed(x["m"])), found))).otherwise(F.array().cast("array<struct<start:int,k:int,end:int>>"))
    spans = F.transform(F.array_sort(F.concat("base", extra)), lambda x: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return rows.select("row", spans.alias("found")).select("row.*", F.col("found").alias("secrets"))


def redact(text: Column, secrets: Column, mark: str = "[SECRET]") -> Column:
    """The text with its secrets replaced; spans that overlap are replaced once."""
    walk = F.aggregate(
        secrets,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.when(x["end"] <= a["at"], a).otherwise(F.struct(x["end"].alias("at"), F.concat(a["out"], F.when(x["start"] >= a["at"], F.concat(F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit(mark))).otherwise(F.lit(""))).alias("out"))),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text))),
    )
    return F.when(F.size(secrets) > 0, walk).otherwise(text)
