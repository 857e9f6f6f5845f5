"""Scans, projections, filters, joins, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import relational as R
from tessera.plans.registry import query, table, views

FLAGSHIP = """
SELECT n_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, COUNT(*) AS lines
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_quantity BETWEEN 10 AND 45
GROUP BY n_name HAVING COUNT(*) > 2
ORDER BY revenue DESC, n_name LIMIT 10
"""


@query(FLAGSHIP)
def flagship_revenue_by_nation(spark, d):
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    joined = R.join(R.join(R.join(lines, orders, [("l_orderkey", "o_orderkey")]), table(spark, d, "customer"), [("o_custkey", "c_custkey")]), table(spark, d, "nation"), [("c_nationkey", "n_nationkey")])
    rows = joined.where((F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & F.col("l_quantity").between(10, 45))
    out = rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("lines")).where("lines > 2")
    return R.page(out.orderBy(F.desc("revenue"), "n_name"), 10)


@query(FLAGSHIP)
def flagship_sql(spark, d):
    views(spark, d, "lineitem", "orders", "customer", "nation")
    return spark.sql(FLAGSHIP.replace("TIMESTAMP '", "TIMESTAMP_NTZ '"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 10")
def scan_project_limit(spark, d):
    return R.page(R.project(table(spark, d, "orders"), ["o_totalprice", "o_orderkey", "o_custkey", "no_such"]).orderBy("o_orderkey"), 50, 10)


@query("SELECT c_custkey, c_name, CAST((SELECT COUNT(*) FROM customer) AS BIGINT) AS total_rows FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 25")
def read_table_page(spark, d):
    from tessera.plans.engine import read_page

    rows, total = read_page(table(spark, d, "customer"), ["c_custkey", "c_name"], limit=25, offset=25, order_by=["c_custkey"])
    return rows.withColumn("total_rows", F.lit(total).cast("bigint"))


@query("SELECT * FROM (VALUES (1, 'a', CAST(1.5 AS DOUBLE)), (2, 'b', NULL), (NULL, NULL, CAST(0 AS DOUBLE))) v(k, s, x)")
def values_rows(spark, d):
    return spark.createDataFrame([(1, "a", 1.5), (2, "b", None), (None, None, 0.0)], "k int, s string, x double")


@query("""SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_discount FROM lineitem
WHERE l_quantity >= 10 AND l_quantity < 20 AND l_discount <> 0.05 AND l_tax > 0.01 AND l_linenumber <= 3 AND l_returnflag = 'R'""")
def filter_comparisons(spark, d):
    c = F.col
    return table(spark, d, "lineitem").where((c("l_quantity") >= 10) & (c("l_quantity") < 20) & (c("l_discount") != 0.05) & (c("l_tax") > 0.01) & (c("l_linenumber") <= 3) & (c("l_returnflag") == "R")).select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount")


@query("""SELECT o_orderkey, NULLIF(o_orderstatus, 'P') AS status FROM orders
WHERE NOT (NULLIF(o_orderstatus, 'P') = 'F') AND (o_totalprice > 1000 OR o_custkey < 100)""")
def filter_logic(spark, d):
    status = F.nullif("o_orderstatus", F.lit("P"))
    return table(spark, d, "orders").where(~(status == "F") & ((F.col("o_totalprice") > 1000) | (F.col("o_custkey") < 100))).select("o_orderkey", status.alias("status"))


@query("""SELECT CASE WHEN s IS NULL THEN 'null' ELSE 'set' END AS kind, COUNT(*) AS n, COUNT(s) AS n_set FROM (SELECT NULLIF(o_orderstatus, 'P') AS s FROM orders) GROUP BY 1""")
def filter_null(spark, d):
    rows = table(spark, d, "orders").select(F.nullif("o_orderstatus", F.lit("P")).alias("s"))
    empty, full = rows.where(F.col("s").isNull()).withColumn("kind", F.lit("null")), rows.where(F.col("s").isNotNull()).withColumn("kind", F.lit("set"))
    return empty.union(full).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("s").alias("n_set"))


@query("SELECT p_partkey, p_brand, p_size FROM part WHERE p_size IN (1, 5, 9) AND NULLIF(p_brand, 'Brand#11') NOT IN ('Brand#12', 'Brand#13')")
def filter_in(spark, d):
    return table(spark, d, "part").where(F.col("p_size").isin(1, 5, 9) & ~F.nullif("p_brand", F.lit("Brand#11")).isin("Brand#12", "Brand#13")).select("p_partkey", "p_brand", "p_size")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderdate BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1997-12-31 00:00:00'")
def filter_between(spark, d):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return table(spark, d, "orders").where(F.col("o_totalprice").between(1000, 50000) & F.col("o_orderdate").between(at("1996-01-01"), at("1997-12-31"))).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_name, p_type FROM part WHERE p_name LIKE '%ll %g%' AND p_type LIKE '_C%Y' AND p_brand NOT LIKE 'Brand#1_'")
def filter_like(spark, d):
    return table(spark, d, "part").where(F.col("p_name").like("%ll %g%") & F.col("p_type").like("_C%Y") & ~F.col("p_brand").like("Brand#1_")).select("p_partkey", "p_name", "p_type")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_custkey > 10 AND o_custkey < 200) OR (o_custkey >= 500 AND o_custkey <= 600) OR o_custkey = 999")
def filter_search_ranges(spark, d):
    from tessera.operators.expressions import ranges

    return table(spark, d, "orders").where(ranges("o_custkey", [(10, False, 200, False), (500, True, 600, True), (999, True, 999, True)])).select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_quantity > 45 OR l_shipdate IS NULL) AND NOT (l_linenumber = 1) AND l_returnflag IN ('A', 'N')")
def filter_pushable(spark, d):
    from tessera.operators.expressions import And, Compare, In, IsNull, Not, Or, column

    predicate = And(Or(Compare("l_quantity", ">", 45.0), IsNull("l_shipdate")), And(Not(Compare("l_linenumber", "=", 1)), In("l_returnflag", ("A", "N"))))
    return table(spark, d, "lineitem").where(column(predicate)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity + l_tax AS added, l_quantity - l_discount AS taken, ROUND(l_extendedprice * l_discount, 4) AS times,
CASE WHEN l_discount <> 0 THEN ROUND(l_extendedprice / l_discount, 4) END AS divided, CASE WHEN l_linenumber - 1 <> 0 THEN l_orderkey // (l_linenumber - 1) END AS whole,
CASE WHEN l_linenumber - 1 <> 0 THEN l_orderkey % (l_linenumber - 1) END AS rest, -l_quantity AS minus FROM lineitem""")
def project_arith(spark, d):
    c = F.col
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (c("l_quantity") + c("l_tax")).alias("added"), (c("l_quantity") - c("l_discount")).alias("taken"), F.round(c("l_extendedprice") * c("l_discount"), 4).alias("times"), F.round(R.divide(c("l_extendedprice"), c("l_discount")), 4).alias("divided"), R.divide_integers(c("l_orderkey"), c("l_linenumber") - 1).alias("whole"), R.modulo(c("l_orderkey"), (c("l_linenumber") - 1).cast("bigint")).alias("rest"), (-c("l_quantity")).alias("minus"))


@query("""SELECT c_custkey, CAST(TRUNC(c_acctbal) AS INTEGER) AS as_int, CAST(TRUNC(c_acctbal) AS BIGINT) AS as_long, CAST(c_custkey AS DOUBLE) AS as_double, CAST(c_custkey AS VARCHAR) AS as_text,
CAST(TRIM(' ' || CAST(c_custkey AS VARCHAR) || ' ') AS INTEGER) AS back, TRY_CAST(c_name AS INTEGER) AS tried FROM customer""")
def project_cast(spark, d):
    c = F.col
    return table(spark, d, "customer").select("c_custkey", c("c_acctbal").cast("int").alias("as_int"), c("c_acctbal").cast("bigint").alias("as_long"), c("c_custkey").cast("double").alias("as_double"), c("c_custkey").cast("string").alias("as_text"), F.trim(F.concat(F.lit(" "), c("c_custkey").cast("string"), F.lit(" "))).cast("int").alias("back"), c("c_name").try_cast("int").alias("tried"))


@query("SELECT p_partkey, UPPER(p_name) AS up, LOWER(p_brand) AS low, SUBSTRING(p_name, 1, 2) AS start0, SUBSTRING(p_name, 3, 4) AS mid, SUBSTRING(p_name, 999, 4) AS beyond, p_brand || CAST(p_size AS VARCHAR) AS joined, p_brand || NULLIF(p_type, p_type) AS none FROM part")
def project_string(spark, d):
    c = F.col
    return table(spark, d, "part").select("p_partkey", F.upper("p_name").alias("up"), F.lower("p_brand").alias("low"), R.substring(c("p_name"), 0, 2).alias("start0"), R.substring(c("p_name"), 3, 4).alias("mid"), R.substring(c("p_name"), 999, 4).alias("beyond"), R.concat(c("p_brand"), c("p_size")).alias("joined"), R.concat(c("p_brand"), F.nullif("p_type", c("p_type"))).alias("none"))


def _customers(spark, d):
    return table(spark, d, "customer").where("c_acctbal > 5000").select("c_custkey", "c_name")


def _orders(spark, d):
    return table(spark, d, "orders").where("o_totalprice > 200").select("o_orderkey", "o_custkey", "o_totalprice")


def _join_sql(how: str, extra: str = "") -> str:
    return f"""SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM (SELECT * FROM customer WHERE c_acctbal > 5000) c {how} JOIN
(SELECT * FROM orders WHERE o_totalprice > 200) o ON c_custkey = o_custkey {extra}"""


for _how, _word in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL")):

    def _run(spark, d, how=_how):
        return R.join(_customers(spark, d), _orders(spark, d), [("c_custkey", "o_custkey")], how).drop("o_custkey")

    query(_join_sql(_word), f"join_{_how}")(_run)


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(spark, d):
    return R.theta_join(table(spark, d, "nation").select("n_name"), table(spark, d, "region").select("r_name"), None)


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey AND n_nationkey > 3")
def join_theta(spark, d):
    return R.theta_join(table(spark, d, "nation"), table(spark, d, "region"), F.expr("n_regionkey < r_regionkey AND n_nationkey > 3")).select("n_nationkey", "n_name", "r_name")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_semi(spark, d):
    return R.join(table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 300000"), [("c_custkey", "o_custkey")], "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def join_anti(spark, d):
    return R.join(table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 100000"), [("c_custkey", "o_custkey")], "left_anti").select("c_custkey", "c_name")


@query(_join_sql("LEFT", "AND o_totalprice > 100000"))
def join_residual_outer(spark, d):
    left, right = _customers(spark, d), _orders(spark, d)
    return R.join(left, right, [("c_custkey", "o_custkey")], "left", residual=right["o_totalprice"] > 100000).drop("o_custkey")


@query("SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_broadcast(spark, d):
    return R.join(table(spark, d, "supplier"), table(spark, d, "nation"), [("s_nationkey", "n_nationkey")], small_right=True).select("s_suppkey", "s_name", "n_name")


@query("""SELECT a.o_orderkey, b.s FROM (SELECT o_orderkey, NULLIF(o_orderstatus, 'P') AS s FROM orders) a
JOIN (SELECT NULLIF(o_orderstatus, 'P') AS s, COUNT(*) AS n FROM orders GROUP BY 1) b ON a.s = b.s""")
def join_null_keys(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("s"))
    keys = rows.groupBy("s").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("s", "t")
    return R.join(rows, keys, [("s", "t")]).select("o_orderkey", F.col("t").alias("s"))


@query("""SELECT r_name, n_name, COUNT(*) AS orders, ROUND(SUM(o_totalprice), 2) AS total FROM region JOIN nation ON n_regionkey = r_regionkey
JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name, n_name""")
def join_four_way_snowflake(spark, d):
    out = R.join(R.join(R.join(table(spark, d, "orders"), table(spark, d, "customer"), [("o_custkey", "c_custkey")]), table(spark, d, "nation"), [("c_nationkey", "n_nationkey")]), table(spark, d, "region"), [("n_regionkey", "r_regionkey")])
    return out.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT l_partkey, COUNT(*) AS lines, SUM(l_quantity) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 1 GROUP BY l_partkey")
def dpp_filtered_join(spark, d):
    parts = table(spark, d, "part").where("p_size = 1").select("p_partkey")
    return R.join(table(spark, d, "lineitem"), parts, [("l_partkey", "p_partkey")]).groupBy("l_partkey").agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"))


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'""")
def join_strategy_hints(spark, d):
    customers = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return table(spark, d, "orders").join(customers.hint("shuffle_hash"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT COUNT(*) AS n, COUNT(NULLIF(l_returnflag, 'N')) AS flagged, SUM(l_quantity) AS quantity, ROUND(AVG(l_extendedprice), 4) AS price, MIN(l_shipdate) AS first_ship, MAX(l_shipdate) AS last_ship FROM lineitem")
def agg_global(spark, d):
    return table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.count(F.nullif("l_returnflag", F.lit("N"))).alias("flagged"), F.sum("l_quantity").alias("quantity"), F.round(F.avg("l_extendedprice"), 4).alias("price"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))


@query("""SELECT NULLIF(l_returnflag, 'N') AS flag, l_linestatus, SUM(l_quantity) AS sum_l_quantity, COUNT(l_tax) AS count_l_tax, COUNT(DISTINCT l_suppkey) AS count_distinct_l_suppkey, MIN(l_shipdate) AS min_l_shipdate, MAX(l_extendedprice) AS max_l_extendedprice, COUNT(*) AS count_star
FROM lineitem GROUP BY 1, 2""")
def agg_grouped(spark, d):
    rows = table(spark, d, "lineitem").withColumn("flag", F.nullif("l_returnflag", F.lit("N")))
    return R.aggregate(rows, ["flag", "l_linestatus"], [("sum", "l_quantity"), ("count", "l_tax"), ("count_distinct", "l_suppkey"), ("min", "l_shipdate"), ("max", "l_extendedprice"), ("count", "*")])


@query("SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus")
def agg_count_distinct(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("customers"))


@query("SELECT o_custkey, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING COUNT(*) >= 12")
def agg_having(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).where("n >= 12")


@query("SELECT COUNT(*) AS n, SUM(o_totalprice) AS total, AVG(o_totalprice) AS mean, MIN(o_orderstatus) AS low, MAX(o_orderkey) AS high FROM orders WHERE o_orderkey < 0")
def agg_empty_input(spark, d):
    return table(spark, d, "orders").where("o_orderkey < 0").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"), F.avg("o_totalprice").alias("mean"), F.min("o_orderstatus").alias("low"), F.max("o_orderkey").alias("high"))


@query("SELECT p_brand, MIN(p_name) AS first_name, MAX(p_type) AS last_type FROM part GROUP BY p_brand")
def agg_min_max_string(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.min("p_name").alias("first_name"), F.max("p_type").alias("last_type"))


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def agg_distinct(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


_SETS = "SELECT l_returnflag, l_linestatus, GROUPING(l_returnflag) * 2 + GROUPING(l_linestatus) AS level, SUM(l_quantity) AS quantity, COUNT(*) AS n FROM lineitem GROUP BY "


def _sets(grouped):
    return grouped.agg(F.grouping_id().cast("bigint").alias("level"), F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n"))


@query(_SETS.replace("AS level", "AS level") + "ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(spark, d):
    return _sets(table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus"))


@query(_SETS + "CUBE (l_returnflag, l_linestatus)")
def agg_cube(spark, d):
    return _sets(table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus"))


@query(_SETS + "GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def agg_grouping_sets(spark, d):
    sets = [[F.col("l_returnflag")], [F.col("l_linestatus")], []]
    return _sets(table(spark, d, "lineitem").groupingSets(sets, F.col("l_returnflag"), F.col("l_linestatus")))


@query("SELECT event_type, COUNT(*) FILTER (WHERE value > 50) AS high, ROUND(SUM(value) FILTER (WHERE user_id % 2 = 0), 4) AS even_sum, CAST(SUM(DISTINCT user_id) AS BIGINT) AS users FROM events GROUP BY event_type")
def agg_filter_clause(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("high"), F.round(F.sum(F.when(F.col("user_id") % 2 == 0, F.col("value"))), 4).alias("even_sum"), F.sum_distinct("user_id").alias("users"))


@query("SELECT event_type, ROUND(STDDEV_SAMP(value), 6) AS sd, ROUND(VAR_POP(value), 6) AS var FROM events GROUP BY event_type")
def agg_stddev(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.stddev_samp("value"), 6).alias("sd"), F.round(F.var_pop("value"), 6).alias("var"))


_ORDERED = "OVER (PARTITION BY user_id ORDER BY ts, event_id"


@query(f"SELECT event_id, CAST(ROW_NUMBER() {_ORDERED}) AS INTEGER) AS n FROM events")
def window_row_number(spark, d):
    return table(spark, d, "events").select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("n"))


@query("SELECT p_partkey, CAST(RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS INTEGER) AS r, CAST(DENSE_RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS INTEGER) AS dr FROM part")
def window_rank(spark, d):
    w = Window.partitionBy("p_brand").orderBy("p_size")
    return table(spark, d, "part").select("p_partkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("dr"))


@query(f"SELECT event_id, LAG(value) {_ORDERED}) AS before, LEAD(event_type, 2, 'none') {_ORDERED}) AS later FROM events")
def window_lag(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.lag("value").over(w).alias("before"), F.lead("event_type", 2, "none").over(w).alias("later"))


@query(f"SELECT event_id, ROUND(SUM(value) {_ORDERED} ROWS UNBOUNDED PRECEDING), 4) AS so_far FROM events")
def window_running_sum(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", F.round(F.sum("value").over(w), 4).alias("so_far"))


@query(f"SELECT event_id, ROUND(AVG(value) {_ORDERED} ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING), 6) AS mean FROM events")
def window_frame_avg(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, 1)
    return table(spark, d, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("mean"))


@query("SELECT c_custkey, NULLIF(c_mktsegment, 'BUILDING') AS segment FROM customer ORDER BY segment DESC NULLS FIRST, c_custkey LIMIT 40")
def sort_nulls(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))
    return R.page(R.sort(rows, [("segment", False), ("c_custkey", True)]), 40)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk_orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation")
def set_union_all(spark, d):
    return R.union([table(spark, d, t).select(F.col(c).alias("k")) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey"))])


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, d):
    return R.union([table(spark, d, t).select(F.col(c).alias("k")) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"))], all_rows=False)


@query("SELECT o_custkey AS k FROM orders WHERE o_totalprice > 100000 INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def set_intersect(spark, d):
    return table(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("k")).intersect(table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 100000")
def set_except(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").where("o_totalprice > 100000").select("o_custkey"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def set_except_all(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).exceptAll(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def set_intersect_all(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersectAll(table(spark, d, "supplier").select("s_nationkey"))


_IN = "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"
_EXISTS = "SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 50 AND l_discount = 0)"
_SCALAR = "SELECT c_custkey, c_acctbal FROM customer c WHERE c_acctbal > (SELECT AVG(c2.c_acctbal) FROM customer c2 WHERE c2.c_nationkey = c.c_nationkey)"


@query(_IN)
def subquery_in(spark, d):
    views(spark, d, "orders", "customer")
    return spark.sql(_IN)


@query(_EXISTS)
def subquery_exists(spark, d):
    views(spark, d, "supplier", "lineitem")
    return spark.sql(_EXISTS)


@query(_SCALAR)
def subquery_scalar(spark, d):
    views(spark, d, "customer")
    return spark.sql(_SCALAR)


@query("SELECT l_returnflag, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag", "exchange_partitionings")
def exchange_partitionings(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag")
    rows = R.exchange(R.exchange(R.exchange(rows, "round_robin", 4), "range", 4, ["l_orderkey"]), "hash", 4, ["l_returnflag"])
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


_SCALARS = """SELECT event_id, EXTRACT(YEAR FROM ts) AS y, EXTRACT(MONTH FROM ts) AS m, ROUND(ABS(value), 2) AS v, CASE WHEN value > 50 THEN 'high' WHEN value > 20 THEN 'mid' ELSE 'low' END AS level,
COALESCE(NULLIF(event_type, 'view'), 'seen') AS kind FROM events"""


@query(_SCALARS)
def scalar_sql_surface(spark, d):
    views(spark, d, "events")
    return spark.sql(_SCALARS).withColumns({"y": F.col("y").cast("bigint"), "m": F.col("m").cast("bigint")})
