"""URL filter: pattern rules, indexed by their rarest literal token.

Every rule is a regular expression with literal tokens that any URL it matches
must hold whole. The index files each rule under that one of its tokens which
the fewest URLs hold; the tokens of a URL then fetch the candidate rules, and
only those run their expressions. Rules are rows of a table, of any number, and
are compiled by DataFrame functions too, as is all else here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import ascii_lower

#: Fixed value: the host rules of the contract (verdict, host and path).
HOST_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Patterns for URLs that no host rule fits. "||": start of a host label; "^": a character that is none of a-z 0-9 _ . % -, or the end; "*": anything.
PATTERN_RULES = (
    ("block", "||casino-"), ("block", "||casino."), ("block", "-casino."), ("block", "||poker-"), ("block", "||free-bets."), ("block", "||bet-"), ("block", "||cheap-pills."), ("block", "||pills-"),
    ("block", "||viagra."), ("block", "||viagra-"), ("block", "||adult-"), ("block", "||adult."), ("block", "||porn."), ("block", "||porn-"), ("block", "||xxx."), ("block", "||spam-"), ("block", "||malware."), ("block", "||phishing."), ("block", "||warez."), ("block", "||torrent."),
    ("block", "^phishing^"), ("block", "^doubleclick^"),
)


#: What a rule's row holds: host or pattern, its verdict (allow or block) and its text.
RULE = "kind string, verdict string, text string"


def rules_frame(spark: SparkSession, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """A few rules as a table (RULE); long lists are read from one."""
    rows = [F.struct(F.lit(kind).alias("kind"), F.lit(verdict).alias("verdict"), F.lit(text).alias("text")) for kind, rules in (("host", host_rules), ("pattern", pattern_rules)) for verdict, text in rules]
    return spark.range(1).select(F.inline(F.array(*rows) if rows else F.array().cast(f"array<struct<{RULE.replace(' ', ':')}>>".replace(",:", ","))))


def compiled(rules: DataFrame) -> DataFrame:
    """The rules (RULE), each once, with the regular expression and the tokens of each.

    A host rule's expression is over host and path, a pattern's over what follows ://, A-Z
    lower-cased. A token is sure to stand whole in a URL that fits only between characters that are no
    part of tokens. Rules without text or of another kind are left out.
    """
    text, at_label = F.col("text"), F.startswith("text", F.lit("||"))
    body = ascii_lower(F.when(at_label, F.substring("text", 3, 1 << 30)).otherwise(text))
    host = F.concat(F.lit(r"^(?:[^/]*\.)?"), F.regexp_replace(text, r"([^A-Za-z0-9/])", r"\\$1"))
    escaped = F.regexp_replace(body, r"([^a-z0-9*^])", r"\\$1")
    pattern = F.concat(F.when(at_label, r"(?s)^(?:[^/?#]*\.)?").otherwise("(?s)"), F.replace(F.replace(escaped, F.lit("*"), F.lit(".*")), F.lit("^"), F.lit("(?:[^a-z0-9_.%-]|$)")))
    edged = F.concat(F.when(at_label, ".").otherwise("*"), F.replace(body, F.lit("^"), F.lit("/")), F.lit("*"))
    of_host = ascii_lower(F.regexp_replace(text, "[A-Za-z0-9]+$", ""))  # the last token may go on in the URL
    words = lambda c, regex: F.regexp_extract_all(c, F.lit(regex), F.lit(0))
    is_host = F.col("kind") == "host"
    out = rules.where("text IS NOT NULL AND kind IN ('host', 'pattern')").select("kind", F.col("verdict").alias("rule_verdict"), "text").distinct()
    return out.select("*", F.when(is_host, host).otherwise(pattern).alias("regex"), F.when(is_host, words(of_host, "[a-z0-9]+")).otherwise(words(edged, r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])")).alias("rule_tokens"))


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))


def tokens_of(url: Column) -> Column:
    after = ascii_lower(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1))
    return F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(after, F.lit("[a-z0-9]+"), 0)))


def rule_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The compiled rules with the token each is filed under: its rarest in the urls; "" for rules without tokens, which any URL fetches."""
    rule = ["kind", "text", "rule_verdict", "regex"]
    filed = rules.select(*rule, F.explode_outer("rule_tokens").alias("token"))
    wanted = filed.select("token").where("token IS NOT NULL").distinct()
    counts = urls.select(F.explode(tokens_of(F.col("url"))).alias("token")).join(wanted, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("urls"))
    rarest = filed.join(counts, "token", "left").groupBy(*rule).agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token")).alias("rarest"))
    return rarest.select(F.coalesce("rarest.token", F.lit("")).alias("token"), *rule)


def judge(pages: DataFrame, rules: DataFrame | None = None, default: str = "allow", id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """A verdict on every URL: page_id, url, host, path, rule, verdict, pattern.

    rules: a table (RULE) of any number of rules; without one, those of this module.
    Of the host rules that fit, the longest text wins (of equal ones the later
    in code point order). If none fits, an allowing pattern that matches wins
    over a blocking one, and without either the verdict is `default`.
    Null URLs and those without :// have an empty host and path, fit no rule
    and get the default. Repeated rows stay; an empty table gives no rows; other
    columns are ignored.
    """
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).cast("string").alias("url"))
    known = rows.select("url").where(F.col("url").contains("://"))
    index = rule_index(known, compiled(rules if rules is not None else rules_frame(rows.sparkSession)))
    candidates = known.select("url", F.explode(tokens_of(F.col("url"))).alias("token")).join(index, "token")
    subject = F.when(F.col("kind") == "host", F.concat(url_host(F.col("url")), url_path(F.col("url")))).otherwise(ascii_lower(F.regexp_extract("url", r"(?s)^.*?://(.*)$", 1)))
    hits = candidates.where(F.regexp_like(subject, F.col("regex")))
    best = lambda kind, verdict=None: F.max(F.when((F.col("kind") == kind) & (F.lit(True) if verdict is None else F.col("rule_verdict") == verdict), F.struct(F.char_length("text").alias("length"), "text", "rule_verdict")))
    found = hits.groupBy("url").agg(best("host").alias("rule"), best("pattern", "allow").alias("allowed"), best("pattern", "block").alias("blocked"))
    # no groups to gather: only URLs that some rule matched are joined, and Spark splits a hot one
    out = rows.join(found, "url", "left")
    by_pattern = F.coalesce("allowed", "blocked")
    return out.select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), F.col("rule.text").alias("rule"), F.coalesce("rule.rule_verdict", by_pattern["rule_verdict"], F.lit(default)).alias("verdict"), F.when(F.col("rule").isNull(), by_pattern["text"]).alias("pattern"))
