"""Queries for data preparation, governance, search, indexes, views and history."""

from __future__ import annotations


from pyspark.sql import functions as F

from tessera.operators import anonymize as A
from tessera.operators import evolution, fulltext, gdpr, indexes, lineage, pii, profiling, quality, sampling, security, snapshots, tiering
from tessera.operators.expressions import And, Compare, IsNotNull
from tessera.plans import history
from tessera.plans.builder import QuerySpec
from tessera.plans.registry import query, table
from tessera.functions import dates, text

# --- builder

ORDERS_SPEC = QuerySpec().from_("orders").select("o_orderstatus").select_agg("COUNT", "o_orderkey", "n").select_agg("MAX", "o_totalprice", "top").where("o_totalprice", "GT", "1000").where("o_orderstatus", "IN", "O, F, P").where("o_orderpriority", "LIKE", "%-%").where("o_custkey", "IS_NOT_NULL").group_by("o_orderstatus").order_by("o_orderstatus").limit(5)
JOIN_SPEC = QuerySpec().from_("supplier").join("nation", "s_nationkey", "n_nationkey").join("region", "n_regionkey", "r_regionkey", "LEFT").select("r_name").select_agg("COUNT", "s_suppkey", "suppliers").select_agg("MIN", "s_name", "first_name").where("s_acctbal", "GTE", "0").where("n_name", "NOT_EQ", "x").group_by("r_name").order_by("r_name", False)


@query(ORDERS_SPEC.sql())
def builder_query(spark, d):
    return ORDERS_SPEC.frame(lambda t: table(spark, d, t))


@query(JOIN_SPEC.sql())
def builder_join_query(spark, d):
    return JOIN_SPEC.frame(lambda t: table(spark, d, t))


# --- scalar functions

_THREE = "CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE strftime(o_orderdate, '%Y%m%d') END"


@query(f"SELECT o_orderkey, {_THREE} AS shown, CAST(o_orderdate AS DATE) AS parsed, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days FROM orders")
def date_parse(spark, d):
    k, at = F.col("o_orderkey") % 3, F.col("o_orderdate").cast("timestamp")
    shown = F.when(k == 0, F.date_format(at, "yyyy-MM-dd")).when(k == 1, F.date_format(at, "yyyy/MM/dd")).otherwise(F.date_format(at, "yyyyMMdd"))
    rows = table(spark, d, "orders").select("o_orderkey", shown.alias("shown"))
    return rows.withColumn("parsed", dates.parse_date(F.col("shown"))).withColumn("days", dates.days_between(F.lit("1995-01-01").cast("date"), F.col("parsed")).cast("bigint"))


@query(f"SELECT CAST(MIN(d) AS VARCHAR) AS min_date, CAST(MAX(d) AS VARCHAR) AS max_date, date_diff('day', MIN(d), MAX(d)) AS range_days, COUNT(*) FILTER (WHERE d IS NULL) AS null_count FROM (SELECT CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS d FROM orders)")
def profile_date(spark, d):
    shown = F.when(F.col("o_orderkey") % 7 == 0, "no date").otherwise(F.date_format(F.col("o_orderdate").cast("timestamp"), "MM/dd/yyyy"))
    shown = F.when((F.col("o_orderkey") % 7 != 0), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")).otherwise(shown)
    return profiling.profile_date(table(spark, d, "orders").select(shown.alias("x")), "x")


@query("SELECT c_custkey, sha256(c_name) AS sha, md5(c_name) AS md, to_base64(unhex(sha256(c_name))) AS b64 FROM customer")
def hash_functions(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.sha2("c_name", 256).alias("sha"), F.md5("c_name").alias("md"), text.sha256_base64(F.col("c_name")).alias("b64"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


_CARD = r"(^|[^0-9])([0-9]{16})([^0-9]|$)"


@query(f"""SELECT doc_id, card, (list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN CASE WHEN 2 * CAST(card[i] AS INT) > 9 THEN 2 * CAST(card[i] AS INT) - 9 ELSE 2 * CAST(card[i] AS INT) END ELSE CAST(card[i] AS INT) END)) % 10) = 0 AS valid
FROM (SELECT doc_id, regexp_extract(text, '{_CARD}', 2) AS card FROM documents) WHERE card <> ''""")
def luhn_cards(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_extract("text", _CARD, 2).alias("card")).where("card <> ''").withColumn("valid", text.luhn_valid(F.col("card")))


@query("SELECT a.n_name AS name, b.n_name AS other FROM nation a JOIN nation b ON levenshtein(a.n_name, b.n_name) <= 2")
def levenshtein_match(spark, d):
    n = table(spark, d, "nation")
    return text.near_pairs(n.select(F.col("n_name").alias("name")), n.select(F.col("n_name").alias("other")), "name", "other")


# --- profiles


def _numeric_sql(t: str, c: str) -> str:
    b = ", ".join(f"COUNT(*) FILTER (WHERE b = {i}) AS bucket_{i}" for i in range(1, 11))
    return f"""WITH s AS (SELECT MIN({c}) AS min, MAX({c}) AS max, ROUND(AVG({c}), 6) AS mean, quantile_cont({c}, 0.5) AS median, ROUND(STDDEV_SAMP({c}), 6) AS stddev, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, COUNT(DISTINCT {c}) AS distinct_count, COUNT(*) FILTER (WHERE {c} IS NULL) AS null_count, COUNT({c}) AS n FROM {t}),
r AS (SELECT COUNT(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outlier_count, {b} FROM (SELECT x, q1, q3, LEAST(10, CAST(FLOOR((x - min) / ((max - min) / 10)) AS INT) + 1) AS b FROM (SELECT {c} AS x FROM {t} WHERE {c} IS NOT NULL), s))
SELECT s.* EXCLUDE (median, q1, q3), ROUND(median, 6) AS median, ROUND(q1, 6) AS q1, ROUND(q3, 6) AS q3, r.* FROM s, r"""


@query(_numeric_sql("customer", "c_acctbal"))
def profile_numeric(spark, d):
    out = profiling.profile_numeric(table(spark, d, "customer"), "c_acctbal")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "median", "stddev", "q1", "q3")})


def _patterns_sql(c: str) -> str:
    return ", ".join(f"COUNT(*) FILTER (WHERE regexp_matches({c}, '{p}')) AS n_{k}" for k, p in profiling.PATTERNS.items())


@query(f"""SELECT MIN(length(p_brand)) AS min_length, MAX(length(p_brand)) AS max_length, AVG(length(p_brand)) AS avg_length, COUNT(DISTINCT p_brand) AS distinct_count, COUNT(*) FILTER (WHERE p_brand IS NULL) AS null_count, {_patterns_sql('p_brand')},
(SELECT string_agg(v || '=' || n, ',' ORDER BY n DESC, v) FROM (SELECT p_brand AS v, COUNT(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, v LIMIT 10)) AS top_values FROM part""")
def profile_string(spark, d):
    return profiling.profile_string(table(spark, d, "part"), "p_brand")


@query("SELECT COUNT(*) FILTER (WHERE toxic <> 0) AS true_count, COUNT(*) FILTER (WHERE toxic = 0) AS false_count, COUNT(*) FILTER (WHERE toxic IS NULL) AS null_count FROM labels")
def profile_boolean(spark, d):
    return profiling.profile_boolean(table(spark, d, "labels"), "toxic")


# --- quality

_RULES = [
    quality.Rule("status set", "o_orderstatus", "in_set", values=("O", "F")),
    quality.Rule("price range", "o_totalprice", "range", minimum=0.0, maximum=200000.0),
    quality.Rule("priority pattern", "o_orderpriority", "regex", pattern="^[1-3]-"),
    quality.Rule("customer unique", "o_custkey", "unique"),
    quality.Rule("partial complete", "partial", "completeness", minimum=99.0),
    quality.Rule("customer exists", "o_custkey", "consistency", other_table="rich", other_column="c_custkey"),
]
_COUNTS = {"status set": "COUNT(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F'))", "price range": "COUNT(*) FILTER (WHERE o_totalprice < 0 OR o_totalprice > 200000)", "priority pattern": "COUNT(*) FILTER (WHERE NOT regexp_matches(o_orderpriority, '^[1-3]-'))", "customer unique": "COUNT(o_custkey) - COUNT(DISTINCT o_custkey)", "partial complete": "COUNT(*) FILTER (WHERE o_orderstatus = 'P')", "customer exists": "COUNT(*) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))"}


@query(" UNION ALL ".join(f"SELECT '{r.name}' AS rule, '{r.column}' AS \"column\", v AS violations, ROUND(v / n, 9) AS rate, v / n > 0.1 AS alert FROM (SELECT {_COUNTS[r.name]} AS v, COUNT(*) AS n FROM orders)" for r in _RULES))
def quality_report(spark, d):
    rows = table(spark, d, "orders").withColumn("partial", F.nullif("o_orderstatus", F.lit("P")))
    return quality.evaluate(rows, _RULES, lambda name: table(spark, d, "customer").where("c_acctbal > 0")).withColumn("rate", F.round("rate", 9))


# --- samples


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 100")
def sample_random(spark, d):
    return sampling.random_sample(table(spark, d, "orders"), 100, 42, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("""SELECT event_id, event_type FROM (SELECT event_id, event_type, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY md5('7|' || event_id), event_id) AS r FROM events)
WHERE r <= GREATEST(1, 60 // (SELECT COUNT(DISTINCT event_type) FROM events))""")
def sample_stratified(spark, d):
    return sampling.stratified_sample(table(spark, d, "events"), 60, 7, "event_type", ["event_id"]).select("event_id", "event_type")


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id, ROW_NUMBER() OVER (ORDER BY event_id) - 1 AS p FROM events) WHERE p % 25 = 0")
def sample_systematic(spark, d):
    return sampling.systematic_sample(table(spark, d, "events"), 25, ["event_id"]).select("event_id", "user_id")


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY md5('3|' || user_id), user_id LIMIT 5)")
def sample_cluster(spark, d):
    return sampling.cluster_sample(table(spark, d, "events"), 5, 3, "user_id").select("event_id", "user_id")


@query("SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 12:00:00'")
def sample_time(spark, d):
    return sampling.time_sample(table(spark, d, "events"), "ts", "2024-01-05 00:00:00", "2024-01-06 12:00:00").select("event_id", "ts")


# --- schemas

_V1 = [("t", "a", "Int32", False), ("t", "b", "Utf8", True), ("t", "c", "Decimal(10,2)", True), ("t", "gone", "Utf8", True), ("t", "e", "Int64", True), ("old", "x", "Int32", True)]
_V2 = [("t", "a", "Int64", True), ("t", "b", "Utf8", False), ("t", "c", "Decimal(12,2)", True), ("t", "new_null", "Utf8", True), ("t", "new_must", "Utf8", False), ("t", "e", "Int32", True), ("fresh", "x", "Int32", True)]
_CHANGES = """(VALUES ('fresh', '*', 'table_added', NULL, NULL, NULL), ('old', '*', 'table_removed', NULL, NULL, 'Incompatible'), ('t', 'a', 'type_changed', 'Int32', 'Int64', 'BackwardCompatible'),
('t', 'a', 'nullability_changed', 'required', 'nullable', 'BackwardCompatible'), ('t', 'b', 'nullability_changed', 'nullable', 'required', 'Incompatible'), ('t', 'c', 'type_changed', 'Decimal(10,2)', 'Decimal(12,2)', 'BackwardCompatible'),
('t', 'gone', 'column_removed', 'nullable', NULL, 'Incompatible'), ('t', 'new_null', 'column_added', NULL, 'nullable', 'FullyCompatible'), ('t', 'new_must', 'column_added', NULL, 'required', 'Incompatible'),
('t', 'e', 'type_changed', 'Int64', 'Int32', 'Incompatible')) v("table", "column", change, old, new, level)"""


@query(f'SELECT "table", "column", change, old, new FROM {_CHANGES}')
def schema_diff(spark, d):
    return evolution.changes(spark.createDataFrame(_V1, evolution.SCHEMA), spark.createDataFrame(_V2, evolution.SCHEMA))


@query(f'SELECT * FROM {_CHANGES}')
def schema_evolution(spark, d):
    return evolution.graded(evolution.changes(spark.createDataFrame(_V1, evolution.SCHEMA), spark.createDataFrame(_V2, evolution.SCHEMA)))


# --- lineage and history

_EDGES = [("raw_a", "stage_a"), ("raw_b", "stage_a"), ("stage_a", "mart"), ("raw_c", "stage_c"), ("stage_c", "mart"), ("mart", "report"), ("report", "raw_c"), ("lone", "island")]
_WALK = "WITH RECURSIVE e(a, b) AS (VALUES {}), w(t, level) AS (SELECT '{}', 0 UNION ALL SELECT b, level + 1 FROM w JOIN e ON a = t WHERE level < 10) SELECT t AS \"table\", MIN(level) AS level FROM w WHERE t <> '{}' GROUP BY t"


def _edges(spark):
    return spark.createDataFrame(_EDGES, "source_table string, target_table string")


@query(_WALK.format(", ".join(f"('{a}', '{b}')" for a, b in _EDGES), "raw_a", "raw_a"))
def lineage_impact(spark, d):
    return lineage.impact(_edges(spark), "raw_a")


@query(_WALK.format(", ".join(f"('{b}', '{a}')" for a, b in _EDGES), "mart", "mart"))
def lineage_upstream(spark, d):
    return lineage.upstream(_edges(spark), "mart")


@query("SELECT * FROM (VALUES ('customer', 'mart.top'), ('orders', 'mart.top')) v(source_table, target_table)")
def lineage_extract(spark, d):
    sql = "INSERT INTO mart.top SELECT c.c_name AS name, SUM(o.o_totalprice) AS total FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_name"
    return lineage.edges_of(spark, sql, "q1", "2024-01-01 00:00:00").select("source_table", "target_table")


_HISTORY_SQL = """(SELECT CAST(event_id AS VARCHAR) AS id, 'SELECT * FROM ' || event_type || ' WHERE user_id = ' || (user_id % 10) AS sql_text, 'u' || user_id AS user_id, ts AS start_time,
CAST(ROUND(value * 100) AS BIGINT) AS duration_ms, CASE WHEN event_id % 5 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status FROM events)"""


def _history(spark, d):
    c = F.col
    return table(spark, d, "events").select(c("event_id").cast("string").alias("id"), F.concat(F.lit("SELECT * FROM "), c("event_type"), F.lit(" WHERE user_id = "), (c("user_id") % 10).cast("string")).alias("sql_text"), F.concat(F.lit("u"), c("user_id").cast("string")).alias("user_id"), c("ts").alias("start_time"), F.round(c("value") * 100).cast("bigint").alias("duration_ms"), F.when(c("event_id") % 5 == 0, "FAILED").otherwise("COMPLETED").alias("status"))


@query(f"SELECT id, duration_ms FROM {_HISTORY_SQL} WHERE duration_ms IS NOT NULL AND status = 'COMPLETED' ORDER BY duration_ms DESC, id LIMIT 10")
def history_slowest(spark, d):
    return history.slowest(_history(spark, d)).select("id", "duration_ms")


@query(f"SELECT md5(sql_text) AS query_hash, COUNT(*) AS exec_count FROM {_HISTORY_SQL} GROUP BY 1 ORDER BY exec_count DESC, query_hash LIMIT 10")
def history_frequent(spark, d):
    return history.most_frequent(_history(spark, d))


@query(f"SELECT id, user_id, start_time FROM {_HISTORY_SQL} WHERE user_id = 'u5' ORDER BY start_time DESC, id LIMIT 100")
def history_by_user(spark, d):
    return history.by_user(_history(spark, d), "u5").select("id", "user_id", "start_time")


@query(f"SELECT id, start_time FROM {_HISTORY_SQL} WHERE contains(sql_text, 'purchase') ORDER BY start_time DESC, id LIMIT 100")
def history_by_table(spark, d):
    return history.by_table(_history(spark, d), "purchase").select("id", "start_time")


# --- anonymization

_N = "length(c_name)"


@query(f"SELECT c_custkey, CASE WHEN {_N} <= 2 THEN repeat('*', {_N}) ELSE c_name[1] || repeat('*', {_N} - 2) || c_name[-1] END AS masked, c_name[1] || '***' || c_name[-1] AS short FROM customer")
def anon_mask(spark, d):
    return table(spark, d, "customer").select("c_custkey", A.mask(F.col("c_name")).alias("masked"), A.mask(F.col("c_name"), preserve_length=False).alias("short"))


@query("SELECT c_custkey, sha256('salt' || c_name) AS hashed, md5(c_name) AS md FROM customer")
def anon_hash(spark, d):
    return table(spark, d, "customer").select("c_custkey", A.hashed(F.col("c_name"), salt="salt").alias("hashed"), A.hashed(F.col("c_name"), "MD5").alias("md"))


@query("""SELECT c_custkey, 'tok_' || h[1:8] || '-' || h[9:12] || '-3' || h[14:16] || '-' || substr('89ab89ab89ab89ab', 1 + CAST('0x' || h[17] AS INTEGER), 1) || h[18:20] || '-' || h[21:32] AS token
FROM (SELECT c_custkey, md5(sha256(c_name)) AS h FROM customer)""")
def anon_token(spark, d):
    return table(spark, d, "customer").select("c_custkey", A.token(F.col("c_name")).alias("token"))


@query("SELECT c_custkey, CASE WHEN c_custkey >= 0 AND c_custkey < 100 THEN 'low' WHEN c_custkey >= 100 AND c_custkey < 500 THEN 'mid' ELSE CAST(c_custkey AS VARCHAR) END AS label, '' AS gone FROM customer")
def anon_generalize_suppress(spark, d):
    return table(spark, d, "customer").select("c_custkey", A.generalize(F.col("c_custkey"), [(0, 100, "low"), (100, 500, "mid")]).alias("label"), A.suppress(F.col("c_name")).alias("gone"))


@query("SELECT c_custkey, (CAST(FLOOR(c_acctbal / 10) * 10 AS BIGINT)) || '-' || (CAST(FLOOR(c_acctbal / 10) * 10 AS BIGINT) + 10) AS balance, c_mktsegment[1] || repeat('*', length(c_mktsegment) - 1) AS segment FROM customer")
def anon_kanon_single(spark, d):
    return table(spark, d, "customer").select("c_custkey", A.k_anonymous(F.col("c_acctbal"), 10).alias("balance"), A.k_anonymous(F.col("c_mktsegment"), 10).alias("segment"))


@query("""WITH s AS (SELECT (MAX(c_acctbal) - MIN(c_acctbal)) / GREATEST(COUNT(*) // 50, 1) AS raw FROM customer), m AS (SELECT raw, POW(10, FLOOR(LOG10(GREATEST(raw, 1.0)))) AS mag FROM s),
w AS (SELECT GREATEST(CEIL(raw / mag) * mag, 1.0) AS width FROM m)
SELECT c_custkey, CAST(FLOOR(c_acctbal / width) * width AS BIGINT) || '-' || (CAST(FLOOR(c_acctbal / width) * width AS BIGINT) + CAST(width AS BIGINT)) AS c_acctbal FROM customer, w""")
def anon_kanon_column(spark, d):
    return A.k_anonymous_column(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 50)


@query("""SELECT c_custkey, list_aggregate(list_transform(range(1, length(c_name) + 1), lambda i: CASE
WHEN c_name[i] BETWEEN '0' AND '9' THEN chr(CAST((ascii(c_name[i]) - 48 + ascii(k[(i - 1) % 64 + 1]) % 10) % 10 + 48 AS INT))
WHEN c_name[i] BETWEEN 'a' AND 'z' THEN chr(CAST((ascii(c_name[i]) - 97 + ascii(k[(i - 1) % 64 + 1]) % 26) % 26 + 97 AS INT))
WHEN c_name[i] BETWEEN 'A' AND 'Z' THEN chr(CAST((ascii(c_name[i]) - 65 + ascii(k[(i - 1) % 64 + 1]) % 26) % 26 + 65 AS INT)) ELSE c_name[i] END), 'string_agg', '') AS hidden
FROM (SELECT c_custkey, c_name, sha256('key') AS k FROM customer)""")
def anon_fpe(spark, d):
    return table(spark, d, "customer").select("c_custkey", A.format_preserving(F.col("c_name"), "key").alias("hidden"))


def _pseudonym_sql(seed: int) -> str:
    """Java's String.hashCode of the SHA-256 seeds its generator, whose first eight numbers below 26 are letters."""
    low = 1 << 48
    h = "list_reduce(list_prepend(0::HUGEINT, list_transform(range(1, 65), lambda i: ascii(sha256(c_name)[i])::HUGEINT)), lambda a, c: (31 * a + c) % 4294967296)"
    sql = f"SELECT c_custkey, CASE WHEN h >= 2147483648 THEN h - 4294967296 + {low} ELSE h END AS h FROM (SELECT c_custkey, {h} AS h FROM customer)"
    sql = f"SELECT c_custkey, xor(xor(h, {seed}::HUGEINT), 25214903917::HUGEINT) AS s0 FROM ({sql})"
    for i in range(8):
        sql = f"SELECT *, (s{i} * 25214903917 + 11) % {low} AS s{i + 1} FROM ({sql})"
    return f"SELECT c_custkey, {' || '.join(f'chr(CAST(97 + (s{i + 1} // 131072) % 26 AS INTEGER))' for i in range(8))} AS pseudonym FROM ({sql})"


@query(_pseudonym_sql(42))
def anon_pseudonym(spark, d):
    return table(spark, d, "customer").select("c_custkey", A.pseudonymize(F.col("c_name"), 42).alias("pseudonym"))


@query()
def anon_perturb(spark, d):
    return table(spark, d, "customer").select("c_custkey", A.perturb(F.col("c_acctbal"), 5.0).alias("balance"))


@query()
def anon_dp(spark, d):
    return table(spark, d, "customer").select("c_custkey", A.differentially_private(F.col("c_acctbal"), 0.5).alias("balance"))


# --- personal data

_D = r"(^|[^0-9])"
_E = r"([^0-9]|$)"


@query(rf"""SELECT category, matches FROM (
SELECT 'Email' AS category, COUNT(*) FILTER (WHERE regexp_matches(text, '(?i)[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{{2,}}')) AS matches FROM documents UNION ALL
SELECT 'IPAddress', COUNT(*) FILTER (WHERE regexp_matches(text, '{_D}((25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){{3}}(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?){_E}')) FROM documents UNION ALL
SELECT 'Password', COUNT(*) FILTER (WHERE regexp_matches(text, '(?i)(password|passwd|pwd|secret)[:\s=]+\S+')) FROM documents UNION ALL
SELECT 'FinancialAccount', COUNT(*) FILTER (WHERE regexp_matches(text, '{_D}[0-9]{{8,17}}{_E}') AND length(regexp_replace(text, '[^0-9]', '', 'g')) BETWEEN 8 AND 17) FROM documents)""")
def pii_pattern_counts(spark, d):
    names = ("Email", "IPAddress", "Password", "FinancialAccount")
    hit = lambda k: F.col("text").rlike(pii.CATEGORIES[k][1]) & (pii.CATEGORIES[k][2](F.col("text")) if pii.CATEGORIES[k][2] else F.lit(True))
    row = table(spark, d, "documents").agg(*[F.count_if(hit(k)).alias(k) for k in names])
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("category"), F.col(k).alias("matches")) for k in names])).alias("x")).select("x.*")


@query()
def pii_classify_columns(spark, d):
    rows = table(spark, d, "documents").select(F.col("text").alias("email_text"), "source", "lang")
    return pii.classify(rows)


@query("""SELECT AVG(length(c_name)) AS avg_length, MAX(length(c_name)) AS max_length, ROUND(SUM(length(regexp_replace(c_name, '[^0-9]', '', 'g'))) / SUM(length(c_name)), 9) AS digit_ratio, ROUND(SUM(length(regexp_replace(c_name, '[^A-Za-z]', '', 'g'))) / SUM(length(c_name)), 9) AS alpha_ratio,
ROUND(SUM(length(regexp_replace(c_name, '[A-Za-z0-9]', '', 'g'))) / SUM(length(c_name)), 9) AS special_ratio, bool_or(regexp_matches(c_name, '[-/. _]')) AS has_delimiters, COUNT(DISTINCT c_name) / COUNT(*) AS unique_ratio FROM customer""")
def pii_ml_features(spark, d):
    return pii.features(table(spark, d, "customer"), "c_name").withColumns({c: F.round(c, 9) for c in ("digit_ratio", "alpha_ratio", "special_ratio")})


_POLICIES = [security.ColumnPolicy("customer", c, who, level, how) for c, who, level, how in (("c_custkey", "analyst", "FullAccess", None), ("c_name", "analyst", "MaskedAccess", "partial"), ("c_name", "admin", "FullAccess", None), ("c_mktsegment", "analyst", "MaskedAccess", "hash"), ("c_nationkey", "ann", "MaskedAccess", "redact"))]


@query("SELECT c_custkey, CASE WHEN length(c_name) <= 4 THEN repeat('*', length(c_name)) ELSE left(c_name, 4) || repeat('*', length(c_name) - 4) END AS c_name, '[REDACTED]' AS c_nationkey, CAST(NULL AS DOUBLE) AS c_acctbal, to_base64(unhex(sha256(c_mktsegment))) AS c_mktsegment FROM customer")
def column_security_view(spark, d):
    return security.secured(table(spark, d, "customer"), _POLICIES, "customer", "ann", ["analyst"])


@query("SELECT c_custkey, CASE WHEN length(c_name) <= 4 THEN repeat('*', length(c_name)) ELSE left(c_name, 4) || repeat('*', length(c_name) - 4) END AS c_name, CAST(NULL AS DOUBLE) AS c_acctbal FROM customer")
def column_security_rewrite(spark, d):
    text.register(spark)
    table(spark, d, "customer").createOrReplaceTempView("customer")
    sql = security.rewrite("SELECT c_custkey, c_name, c_acctbal FROM customer", _POLICIES, "customer", ["c_custkey", "c_name", "c_acctbal"], "ann", ["analyst"])
    return spark.sql(sql).withColumn("c_acctbal", F.col("c_acctbal").cast("double"))


# --- subjects, retention, consent, audit


@query("SELECT * FROM events WHERE user_id = 7")
def gdpr_access(spark, d):
    return gdpr.access({"events": (table(spark, d, "events"), "user_id")}, 7)["events"]


@query("SELECT event_id, user_id FROM events WHERE user_id <> 7")
def gdpr_erasure(spark, d):
    return gdpr.erase(table(spark, d, "events"), "user_id", 7).select("event_id", "user_id")


@query("SELECT event_id, user_id, CASE WHEN user_id = 7 THEN 'hidden' ELSE event_type END AS event_type FROM events")
def gdpr_rectification(spark, d):
    return gdpr.rectify(table(spark, d, "events"), "user_id", 7, {"event_type": "hidden"}).select("event_id", "user_id", "event_type")


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 10 DAYS")
def retention_delete(spark, d):
    return gdpr.retained(table(spark, d, "events"), gdpr.RetentionRule("events", 10, "ts"), "2024-01-30 00:00:00").select("event_id", "ts")


@query("""SELECT subject_id, purpose, granted AND expires_at > TIMESTAMP '2024-01-30 00:00:00' AS active FROM (SELECT user_id AS subject_id, event_type AS purpose, event_id % 4 <> 0 AS granted, ts + INTERVAL 20 DAYS AS expires_at,
ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def consent_check(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("subject_id"), F.col("event_type").alias("purpose"), (F.col("event_id") % 4 != 0).alias("granted"), F.col("ts").alias("granted_at"), (F.col("ts") + F.expr("INTERVAL 20 DAYS")).alias("expires_at"))
    return gdpr.current_consents(rows, "2024-01-30 00:00:00").select("subject_id", "purpose", "active")


def _audit(spark, d):
    c = F.col
    rows = table(spark, d, "events").select(c("event_id").cast("string").alias("id"), F.concat(F.lit("u"), c("user_id").cast("string")).alias("user_id"), c("event_type").alias("action"), F.lit("events").alias("resource"), "ts", F.lit("OK").alias("status"), c("props").alias("details"))
    return gdpr.signed(rows, "key")


@query("SELECT event_type AS action, COUNT(*) AS n, COUNT(*) AS valid FROM events GROUP BY 1")
def audit_count_by_action(spark, d):
    rows = gdpr.verify(_audit(spark, d), "key")
    return gdpr.count_by_action(rows).join(rows.groupBy("action").agg(F.count_if("valid").alias("valid")), "action")


@query("SELECT CAST(event_id AS VARCHAR) AS id, event_type AS action FROM events WHERE user_id = 3 AND event_type = 'click' AND ts >= TIMESTAMP '2024-01-05 00:00:00'")
def audit_search(spark, d):
    return gdpr.search(_audit(spark, d), user="u3", action="click", start="2024-01-05 00:00:00").select("id", "action")


# --- full text

_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_HAS = f"(SELECT doc_id, {_TOKENS} AS w FROM documents)"


def _index(spark, d):
    return fulltext.index(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


@query(f"SELECT doc_id FROM {_HAS} WHERE list_contains(w, 'the') AND list_contains(w, 'and') AND NOT list_contains(w, 'of')")
def fts_boolean(spark, d):
    return fulltext.boolean(_index(spark, d), must=("The", "and"), must_not=("of",)).select(F.col("id").alias("doc_id"))


@query(f"SELECT doc_id FROM {_HAS} WHERE list_contains(w, 'licensed') OR list_contains(w, 'worthless')")
def fts_should(spark, d):
    return fulltext.boolean(_index(spark, d), should=("licensed", "worthless")).select(F.col("id").alias("doc_id"))


@query(f"SELECT doc_id FROM {_HAS} WHERE len(list_filter(w, lambda x: starts_with(x, 'licen'))) > 0")
def fts_prefix(spark, d):
    return fulltext.prefix(_index(spark, d), "Licen").select(F.col("id").alias("doc_id"))


@query(f"SELECT doc_id FROM {_HAS} WHERE len(list_filter(w, lambda x: x LIKE 'ap_che%')) > 0")
def fts_wildcard(spark, d):
    return fulltext.wildcard(_index(spark, d), "ap?che*").select(F.col("id").alias("doc_id"))


@query(f"SELECT doc_id FROM {_HAS} WHERE len(list_filter(range(1, len(w)), lambda i: w[i] = 'apache' AND w[i + 1] = 'license')) > 0")
def fts_phrase(spark, d):
    return fulltext.phrase(_index(spark, d), "Apache License").select(F.col("id").alias("doc_id"))


@query(f"SELECT doc_id FROM {_HAS} WHERE len(list_filter(w, lambda x: levenshtein(x, 'licence') <= 2)) > 0")
def fts_fuzzy(spark, d):
    return fulltext.fuzzy(_index(spark, d), "licence").select(F.col("id").alias("doc_id"))


_STATS = f"""WITH d AS {_HAS}, t AS (SELECT doc_id, len(w) AS length, term, len(list_filter(w, lambda x: x = term)) AS tf FROM d, (VALUES ('the'), ('licensed')) q(term)),
h AS (SELECT * FROM t WHERE tf > 0), f AS (SELECT term, COUNT(*) AS df FROM h GROUP BY term), s AS (SELECT COUNT(*) AS n, AVG(len(w)) AS mean FROM d WHERE len(w) > 0)"""


@query(f"{_STATS} SELECT doc_id AS id, ROUND(SUM(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean))), 6) AS score FROM h JOIN f USING (term), s GROUP BY doc_id ORDER BY score DESC, id LIMIT 100")
def fts_bm25(spark, d):
    return fulltext.ranked(_index(spark, d), ["the", "Licensed"])


@query(f"{_STATS} SELECT doc_id AS id, ROUND(SUM(sqrt(tf) * POW(1 + ln((n + 1) / (df + 1)), 2) / sqrt(length)), 6) AS score FROM h JOIN f USING (term), s GROUP BY doc_id ORDER BY score DESC, id LIMIT 100")
def fts_tfidf(spark, d):
    return fulltext.ranked(_index(spark, d), ["the", "Licensed"], "tfidf")


@query("SELECT 'SPLR' AS term, COUNT(*) AS n FROM supplier")
def fts_phonetic(spark, d):
    idx = fulltext.index(table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey", "s_name", "phonetic")
    return idx.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT term, COUNT(DISTINCT n_nationkey) AS n FROM (SELECT n_nationkey, unnest(list_transform(range(1, length(n_name)), lambda i: substr(lower(n_name), i, 2)) || list_transform(range(1, length(n_name) - 1), lambda i: substr(lower(n_name), i, 3))) AS term FROM nation) GROUP BY term""")
def fts_ngram_index(spark, d):
    return fulltext.index(table(spark, d, "nation"), "n_nationkey", "n_name", "ngram").groupBy("term").agg(F.count_distinct("id").alias("n"))


# --- indexes

_CHUNKED = "(SELECT *, CAST(FLOOR((ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1) / 1000) AS BIGINT) AS chunk FROM orders)"


def _chunks(spark, d):
    return indexes.chunked(table(spark, d, "orders"), ["o_orderkey"])


@query(f"SELECT chunk, MIN(o_totalprice) AS low, MAX(o_totalprice) AS high, MIN(o_orderdate) AS first_date, MAX(o_orderpriority) AS last_priority, COUNT(*) AS n FROM {_CHUNKED} GROUP BY chunk")
def zonemap_build(spark, d):
    zones = indexes.zone_map(_chunks(spark, d), ["o_totalprice", "o_orderdate", "o_orderpriority"])
    return zones.select("chunk", F.col("o_totalprice.min").alias("low"), F.col("o_totalprice.max").alias("high"), F.col("o_orderdate.min").alias("first_date"), F.col("o_orderpriority.max").alias("last_priority"), F.col("o_totalprice.rows").alias("n"))


@query(f"SELECT chunk FROM {_CHUNKED} GROUP BY chunk HAVING MAX(o_orderkey) >= 2500 AND MIN(o_orderkey) < 7000 AND MIN(o_custkey) <= 3 AND COUNT(o_totalprice) > 0")
def zonemap_skip(spark, d):
    zones = indexes.zone_map(_chunks(spark, d), ["o_orderkey", "o_custkey", "o_totalprice"])
    return indexes.chunks_to_read(zones, And(And(Compare("o_orderkey", ">=", 2500), Compare("o_orderkey", "<", 7000)), And(Compare("o_custkey", "<=", 3), IsNotNull("o_totalprice"))))


_BITS = "(SELECT ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 AS position, o_orderstatus AS s, o_orderpriority AS p FROM orders)"


@query(f"SELECT position FROM {_BITS} WHERE s IN ('F', 'P') AND p = '1-URGENT' AND NOT (s = 'P')")
def bitmap_and_or_not(spark, d):
    rows = sampling.with_position(table(spark, d, "orders"), ["o_orderkey"])
    by_status, by_priority = indexes.bitmap_index(rows, "o_orderstatus"), indexes.bitmap_index(rows, "o_orderpriority")
    either = indexes.bitmap_or(indexes.bitmap_rows(by_status, "F"), indexes.bitmap_rows(by_status, "P"))
    return indexes.bitmap_and(indexes.bitmap_and(either, indexes.bitmap_rows(by_priority, "1-URGENT")), indexes.bitmap_not(indexes.bitmap_rows(by_status, "P"), rows))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 5")
def bloom_skip(spark, d):
    """The rows of a key, read from the chunks that the filters leave: none may be missed."""
    rows, key = _chunks(spark, d), F.lit(5).cast("bigint")
    found = indexes.bloom_chunks(indexes.bloom_index(rows, "o_custkey"), key)
    return rows.join(found, "chunk", "left_semi").where(F.col("o_custkey") == key).select("o_orderkey", "o_custkey")


@query("""WITH r AS (SELECT o_custkey AS v, ROW_NUMBER() OVER (ORDER BY o_custkey) - 1 AS p FROM orders), e AS (SELECT v, p, CAST(FLOOR(p / 1000) AS BIGINT) AS chunk FROM r WHERE p % 1000 = 0 OR p = (SELECT MAX(p) FROM r))
SELECT COALESCE(MAX(chunk) FILTER (WHERE v < 40), MIN(chunk)) AS first_chunk, COALESCE(MIN(chunk) FILTER (WHERE v > 60), MAX(chunk)) AS last_chunk FROM e""")
def sorted_range_lookup(spark, d):
    return indexes.range_chunks(indexes.sorted_ranges(table(spark, d, "orders"), "o_custkey"), 40, 60)


# --- tiers and snapshots

_FILES_SQL = "(SELECT CAST(o_orderkey AS VARCHAR) AS path, o_orderdate AS created_at, CAST(o_custkey % 40 AS INT) AS access_count_last_month, CAST(o_totalprice * 100000 AS BIGINT) AS size_bytes, 'Hot' AS tier FROM orders)"


@query(f"""SELECT path, CASE WHEN age > 90 THEN 'Archive' WHEN age > 30 THEN 'Cold' WHEN age > 7 THEN 'Warm' WHEN access_count_last_month < 10 THEN 'Cold' WHEN size_bytes > 10737418240 THEN 'Archive' ELSE tier END AS target_tier
FROM (SELECT *, FLOOR((epoch(TIMESTAMP '2001-08-02 00:00:00') - epoch(created_at)) / 86400) AS age FROM {_FILES_SQL})""")
def tier_policy(spark, d):
    c = F.col
    files = table(spark, d, "orders").select(c("o_orderkey").cast("string").alias("path"), c("o_orderdate").alias("created_at"), (c("o_custkey") % 40).cast("int").alias("access_count_last_month"), (c("o_totalprice") * 100000).cast("bigint").alias("size_bytes"), F.lit("Hot").alias("tier"))
    return tiering.evaluate(files, "2001-08-02 00:00:00").select("path", "target_tier")


_SNAPS = [(1, "a", "t", "2024-01-01 00:00:00", ["f1", "f2"], None, True), (2, "b", "t", "2024-02-01 00:00:00", ["f2", "f3"], 1, True), (3, "c", "t", "2024-03-01 00:00:00", ["f3", "f4"], 2, True), (1, "d", "u", "2023-01-01 00:00:00", ["g1"], None, True)]
_SNAPS_SQL = "(VALUES " + ", ".join(f"({i}, '{t}', TIMESTAMP '{ts}', {files})" for i, _, t, ts, files, *_ in _SNAPS) + ') s(snapshot_id, "table", ts, data_files)'


def _snaps(spark):
    return spark.createDataFrame(_SNAPS, snapshots.SCHEMA.replace("ts timestamp_ntz", "ts string")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"""SELECT "table", MAX(CAST(snapshot_id AS BIGINT)) AS snapshot_id FROM {_SNAPS_SQL} WHERE ts <= TIMESTAMP '2024-02-15 00:00:00' GROUP BY 1""")
def time_travel_as_of(spark, d):
    return snapshots.as_of(_snaps(spark), "2024-02-15 00:00:00").select("table", "snapshot_id")


@query("""SELECT * FROM (VALUES ('t', 'f1'), ('t', 'f2')) v("table", file)""")
def snapshot_gc_plan(spark, d):
    return snapshots.garbage_plan(_snaps(spark), "2024-03-20 00:00:00")


@query("SELECT user_id, COUNT(*) AS n, MIN(ts) AS first_ts FROM events GROUP BY user_id", "catalog_key_check")
def catalog_key_check(spark, d):
    from tessera.plans.catalog import is_key

    rows = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"))
    if not is_key(rows, ["user_id"]):
        raise AssertionError("user_id repeats")
    return rows


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders")
def global_position(spark, d):
    return sampling.with_position(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "position")


