"""Parts of the library that no query shows."""

import json
from datetime import datetime, timedelta

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import types
from tessera.functions import dates, text
from tessera.operators import anonymize, evolution, fulltext, gdpr, lineage, pii, profiling, quality, relational, sampling, security, tiering
from tessera.operators.snapshots import ConflictError, SnapshotTable
from tessera.operators.views import Views, interval_of
from tessera.operators.workflow import AccessWorkflow
from tessera.plans import cache, engine, history
from tessera.plans.builder import QuerySpec, TableStats, recommend_join
from tessera.plans.catalog import Catalog, Statistics
from tessera.sources import federation, files
from tessera.streaming import ingest

NULLS = [(1, 1, 1.5, "a"), (1, None, None, None), (None, None, None, None), (2, 3, -0.5, "b"), (2, 3, 0.0, "")]


@pytest.fixture(scope="module")
def nulls(spark):
    return spark.createDataFrame(NULLS, "k int, i int, d double, s string")


@pytest.fixture(scope="module")
def empty(nulls):
    return nulls.limit(0)


def test_types_round_trip():
    for name in ["Boolean", "Int8", "Int64", "Float64", "Utf8", "Binary", "Date32", "Decimal(12,3)", "List<Int32>", "Map<Utf8,List<Int64>>", "Struct<a:Int32,b:List<Utf8>>"]:
        assert types.from_spark(types.to_spark(name)) == name
    assert types.to_spark("UInt64") == T.DecimalType(20, 0)
    with pytest.raises(ValueError):
        types.to_spark("Nope")


def test_three_valued_logic_and_empty_sum(nulls, empty):
    assert nulls.where(~(F.col("i") == 1)).count() == 2
    assert empty.agg(F.sum("i")).first()[0] is None
    assert relational.aggregate(empty, [], [("count", "*"), ("sum", "i")]).first().asDict() == {"count_star": 0, "sum_i": None}


def test_null_keys_never_meet_and_residual_stays_inside(nulls):
    a, b = nulls.select("k", "s"), nulls.select(F.col("k").alias("j"), F.col("i").alias("x"))
    assert relational.join(a, b, [("k", "j")]).count() == 8
    rows = relational.join(a, b, [("k", "j")], "left", residual=F.col("x") == 3)
    assert rows.count() == 3 + 4


def test_lateral_aggregates(spark):
    left = spark.createDataFrame([(1, 0.0), (1, 0.0), (1, 2.0), (2, 9.0), (3, 0.0), (4, None), (None, 0.0)], "k int, low double")
    right = spark.createDataFrame([(1, 1.0), (1, 3.0), (1, None), (2, 3.0), (4, 1.0), (None, 1.0)], "j int, x double")
    found = relational.lateral_aggregate(left, right, [("k", "j")], F.col("x") > F.col("low"), {"n": ("count", "*"), "top": ("max", "x")})
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [(1, 0.0, 2, 3.0), (1, 0.0, 2, 3.0), (1, 2.0, 1, 3.0), (2, 9.0, 0, None), (3, 0.0, 0, None), (4, None, 0, None), (None, 0.0, 0, None)]))
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_sort_page_project(nulls):
    assert [r.i for r in relational.sort(nulls, [("i", True)]).collect()] == [1, 3, 3, None, None]
    assert [r.i for r in relational.sort(nulls, [("i", False)]).collect()][:2] == [None, None]
    assert relational.page(nulls, offset=3).count() == 2
    assert relational.project(nulls, ["s", "k", "zz"]).columns == ["k", "s"]


def test_division(spark):
    row = spark.createDataFrame([(-7, 0), (-7, 2)], "a bigint, b bigint").select(relational.divide(F.col("a"), F.col("b")), relational.divide_integers(F.col("a"), F.col("b")), relational.modulo(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in row] == [(None, None, None), (-3.5, -3, -1)]


def test_builder_and_estimate(spark):
    spec = QuerySpec().from_("t").select("a").where("a", "EQ", "o'x").join("u", "a", "b", "LEFT").join("v", kind="CROSS").order_by("a").limit(3)
    assert spec.sql() == "SELECT \"a\" FROM \"t\" LEFT JOIN \"u\" ON \"a\" = \"b\" CROSS JOIN \"v\" WHERE \"a\" = 'o''x' ORDER BY \"a\" ASC LIMIT 3"
    assert spec.estimate({"t": TableStats(1000, 100), "v": TableStats(10)}) == {"rows": 3, "bytes": 300, "complexity": "HIGH"}
    assert QuerySpec().from_("t").where("a", "GT", "1").estimate({"t": TableStats(1000)}) == {"rows": 300, "bytes": 76800, "complexity": "LOW"}
    assert recommend_join(1, 1e6) == "BROADCAST" and recommend_join(1e6, 1e6) == "SHUFFLE_HASH"


def test_cache_keys_and_invalidation(spark, tmp_path):
    assert cache.key_of("SELECT 'A'  FROM t -- x") == cache.key_of("select 'A' from T")
    assert cache.key_of("SELECT 'A'") != cache.key_of("SELECT 'a'")
    assert cache.tables_in("SELECT 1 FROM a JOIN b.c ON x = 'from z'") == {"a", "c"}
    now = [0.0]
    spark.range(3).createOrReplaceTempView("cached")
    c = cache.ResultCache(spark, str(tmp_path), ttl=10, clock=lambda: now[0])
    assert c.get("SELECT COUNT(*) AS n FROM cached").first()[0] == 3
    spark.range(5).createOrReplaceTempView("cached")
    assert c.get("SELECT COUNT(*) AS n FROM cached").first()[0] == 3 and c.hit_ratio == 0.5
    c.table_written("cached")
    assert c.get("SELECT COUNT(*) AS n FROM cached").first()[0] == 5
    now[0] = 11
    c.get("SELECT COUNT(*) AS n FROM cached")
    assert c.misses == 3


def test_explain_analyze_and_statistics(spark, data):
    df = spark.read.parquet(f"{data}/orders.parquet").join(spark.read.parquet(f"{data}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey"))
    assert engine.explain(df)["complexity"] == "MEDIUM"
    assert engine.analyze(df)["rows"] == df.count()
    stats = engine.RuntimeStatistics()
    out = stats.watch(stats.watch(spark.range(100), "in").where("id < 25"), "out")
    out.count()
    assert stats.selectivity("in", "out") == 0.25


def test_recommendations():
    found = history.recommendations("SELECT * FROM t WHERE a = 1 AND b.c IN ('x = 2') ORDER BY b", 6000, 200_000, 2 << 30)
    assert [x.split(":")[0] for x in found] == ["slow", "scan", "result", "columns", "filter", "sort", "limit"]
    assert "a, b.c" in found[4] and "6000" in found[0]
    assert history.recommendations("SELECT a FROM t LIMIT 1") == []


@pytest.mark.parametrize("aqe", ["true", "false"])
def test_positions_over_many_parts(spark, aqe):
    """Every row has its place, however many ranges there are and however Spark deals them; ties and nulls too."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", aqe)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200000")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        n = 120_000
        wide = F.repeat(F.md5(F.col("id").cast("string")), 4)
        rows = spark.range(n).select(F.when(F.col("id") % 1000 != 0, F.xxhash64("id") % 50_000).alias("k"), "id", wide.alias("wide")).repartition(24)
        got = sampling.with_position(rows, ["k", "id"], part_rows=10_000).select("k", "id", "position", "wide").collect()
        order = sorted(got, key=lambda r: (r.k is not None, r.k or 0, r.id))
        assert [r.position for r in order] == list(range(n)) and len({r.id for r in got}) == n
        # a third of all rows has one key: their places are one run
        hot = spark.range(n).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 100).alias("k"), "id")
        got = sampling.with_position(hot, ["k"], part_rows=10_000).collect()
        assert sorted(r.position for r in got) == list(range(n))
        assert [r.k for r in sorted(got, key=lambda r: r.position)] == sorted(r.k for r in got)
        assert sampling.systematic_sample(rows, 1000, ["k", "id"]).count() == n // 1000
        assert sampling.with_position(rows.limit(0), ["k"]).count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_profiles_of_edges(spark, nulls, empty):
    row = profiling.profile_numeric(empty, "d").first()
    assert (row["min"], row.stddev, row.n, row.outlier_count) == (0.0, 0.0, 0, 0)
    one = profiling.profile_numeric(spark.createDataFrame([(4.0,)], "d double"), "d").first()
    assert (one.stddev, one.bucket_1, one["median"]) == (0.0, 1, 4.0)
    assert profiling.profile_string(nulls, "s").first().null_count == 2
    assert profiling.profile_boolean(spark.createDataFrame([("Yes",), ("0",), (None,)], "s string"), "s").first().asDict() == {"true_count": 1, "false_count": 1, "null_count": 1}
    assert set(profiling.profile_table(nulls)) == {"k", "i", "d", "s"}
    assert {r["column"]: r["nulls"] for r in profiling.null_rates(nulls).collect()} == {"k": 1, "i": 2, "d": 2, "s": 2}


def test_dates(spark):
    rows = [("2024-02-29", "2024-02-29"), ("2024-02-29T10:00:00", "2024-02-29"), ("2024/02/29", "2024-02-29"), ("29-02-2024", "2024-02-29"), ("29/02/2024", "2024-02-29"), ("02-29-2024", "2024-02-29"), ("20240229", "2024-02-29"), (" 2024-02-29 ", "2024-02-29"), ("2023-02-29", None), ("junk", None), ("", None), (None, None)]
    got = spark.createDataFrame(rows, "s string, want string").select(dates.parse_date(F.col("s")).cast("string"), "want").collect()
    assert all(a == b for a, b in got)


def test_text_functions(spark):
    row = spark.createDataFrame([("4111 1111 1111 1111", "abc")], "card string, s string").select(text.luhn_valid(F.col("card")), text.hmac_sha256(F.col("s"), "key"), text.ngrams(F.col("s"), 2, 3)).first()
    import base64
    import hashlib
    import hmac

    assert row[0] and row[1] == base64.b64encode(hmac.new(b"key", b"abc", hashlib.sha256).digest()).decode() and row[2] == ["ab", "abc", "bc"]
    assert text.metaphone("Smith") == "SM0" and text.metaphone("Knight")[0] == "N" and text.metaphone("") == ""
    assert text.json_type('{"a": 1, "b": [1.5], "c": {"d": true}}') == "Struct<a:Int64,b:List<Float64>,c:Struct<d:Boolean>>"


def test_quality_json_and_suggestions(nulls):
    rules = [quality.Rule("c", "i", "completeness", minimum=90.0), quality.Rule("s", "s", "in_set", values=("a", "b"))]
    assert quality.from_json(quality.to_json(rules)) == rules
    got = {r.rule: (r.violations, r.alert) for r in quality.evaluate(nulls, rules).collect()}
    assert got == {"c": (2, True), "s": (1, True)}
    assert all(quality.suggestions(r) for r in rules)


def test_samples_of_edges(spark, nulls, empty):
    rows = spark.range(50).withColumn("g", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 3))
    assert sampling.random_sample(rows, 80, 1, ["id"]).count() == 50
    assert sampling.systematic_sample(rows, 0, ["id"]).count() == 0
    assert [r.id for r in sampling.systematic_sample(rows, 20, ["id"]).orderBy("id").collect()] == [0, 20, 40]
    assert sampling.stratified_sample(rows, 8, 1, "g", ["id"]).groupBy("g").count().collect().__len__() == 4
    assert sampling.cluster_sample(rows, 9, 1, "g").count() == rows.where("g IS NOT NULL").count()
    assert sampling.random_sample(empty, 3, 1, ["k"]).count() == 0
    assert json.loads(sampling.describe("random", 5, 2, 1))["type"] == "random"


def test_java_random_matches_published_values():
    import numpy as np

    # new java.util.Random(42): nextInt(10) gives 0, 3, 8, 4, nextGaussian 1.1419053154730547, nextDouble 0.7275636800328681
    r = anonymize.JavaRandom(np.array([42]))
    assert [int(r.integers(10)[0]) for _ in range(4)] == [0, 3, 8, 4]
    assert abs(anonymize.JavaRandom(np.array([42])).gaussians()[0] - 1.1419053154730547) < 1e-15
    assert anonymize.JavaRandom(np.array([42])).doubles()[0] == 0.7275636800328681
    assert anonymize.java_hash("hello") == 99162322 and anonymize.java_hash("") == 0
    assert list(anonymize.perturbed(pd.Series(["x", "1.50"]), 0.0)) == ["x", "1.50"]


def test_tokens_are_name_uuids(spark):
    import hashlib
    import uuid

    value = spark.createDataFrame([("ann",)], "s string").select(anonymize.token(F.col("s"))).first()[0]
    digest = bytearray(hashlib.md5(hashlib.sha256(b"ann").hexdigest().encode()).digest())
    digest[6], digest[8] = digest[6] & 0x0F | 0x30, digest[8] & 0x3F | 0x80
    assert value == f"tok_{uuid.UUID(bytes=bytes(digest))}"


def test_policies(spark, nulls):
    policies = [anonymize.Policy("s", "masking"), anonymize.Policy("d", "generalization", {"ranges": [(0, 2, "small")]})]
    assert anonymize.from_json(anonymize.to_json(policies)) == policies
    assert [r.d for r in anonymize.apply(nulls, policies).collect()] == ["small", None, None, "-0.5", "small"]


@settings(max_examples=20, deadline=None)
@given(st.text(alphabet="abcXYZ019-é", max_size=12))
def test_format_preserving_keeps_the_format(spark, s):
    out = spark.createDataFrame([(s,)], "s string").select(anonymize.format_preserving(F.col("s"), "k")).first()[0]
    kind = lambda c: "d" if c in "0123456789" else "l" if "a" <= c <= "z" else "u" if "A" <= c <= "Z" else c
    assert list(map(kind, out)) == list(map(kind, s))


def test_pii(spark):
    rows = spark.createDataFrame([("123-45-6789", "a@b.co"), ("000-12-3456", "x"), (None, "")], "ssn string, note string")
    got = {(r["column"], r.category): (round(r.confidence, 3), r.matches) for r in pii.classify(rows).collect()}
    assert got["ssn", "SSN"] == (0.7, 0) and got["note", "Email"] == (0.5, 1)
    assert pii.classify(rows, ["note"], (pii.CustomRule("bad", "Own", "("), pii.CustomRule("x", "Own", "^x$"))).where("category = 'Own'").first().matches == 1
    cards = spark.createDataFrame([("4111111111111111",)], "credit_card string")
    assert pii.predict(cards, "credit_card") is None
    assert 0 < pii.score("CreditCard", pii.features(cards, "credit_card").first().asDict(), "credit_card") < 1


def test_pii_of_some_categories_only(spark):
    """Those asked for are as among all others, whose patterns are not run."""
    texts = ["123-45-6789", "000-12-3456", "x 4111 1111 1111 1111", "4111111111111111", "555-123-4567", "12345678", "a@b.co", "@", "-", "eyJa.eyJb.c", "eyJ", "", None]
    rows, custom = spark.createDataFrame([(t, t) for t in texts], "card_number string, s string"), (pii.CustomRule("x", "Own", "^x"), pii.CustomRule("y", "SSN", "^a@"))
    every = {tuple(r) for r in pii.classify(rows, custom=custom, least=0.0).collect()}
    counts = {k: rows.where(F.col("s").rlike(p) & (v(F.col("s")) if v else F.lit(True))).count() for k, (_, p, v) in pii.CATEGORIES.items()}
    counts["SSN"] = max(counts["SSN"], 1)
    assert {r[1]: r[4] for r in every if r[0] == "s"} == counts | {"Own": 1}
    for asked in (("Own",), ("SSN", "JWTToken"), ("CreditCard", "Own"), ()):
        found = pii.classify(rows, custom=custom, least=0.0, categories=asked)
        assert {tuple(r) for r in found.collect()} == {r for r in every if r[1] in asked}
    plan = pii.classify(rows, custom=custom, categories=("Own",))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 2, plan


def test_pii_on_long_texts(spark):
    """Runs without end neither overflow Java's stack nor take time beyond proportion."""
    words, at = "12 " + "word " * 100_000, "a" * 300_000
    rows = spark.createDataFrame([(words + "street",), (words,), (at + "@b.co",), (at,), ("12 main street",), ("x12  old mill rd. y",), ("12street",), ("no 5 elm tree",)], "s string")
    hit = lambda k: F.col("s").rlike(pii.CATEGORIES[k][1])
    assert [r[0] for r in rows.select(hit("HomeAddress")).collect()] == [True, False, False, False, True, True, False, False]
    assert [r[0] for r in rows.select(hit("Email")).collect()] == [False, False, True, False, False, False, False, False]
    assert pii.classify(rows).count() > 0


def test_security(spark, nulls):
    rules = [security.ColumnPolicy("t", "s", "r", "MaskedAccess"), security.ColumnPolicy("t", "s", "u", "FullAccess")]
    assert security.access(rules, "t", ["s", "k"], "u", ["r"]) == {"s": ("FullAccess", None), "k": ("NoAccess", None)}
    assert [r.s for r in security.secured(nulls, rules, "t", "x", ["r"]).collect()] == ["*", None, None, "*", ""]
    security.secured_views(spark, {"t": nulls}, rules, "x", ["r"])
    assert spark.sql("SELECT COUNT(k) FROM t").first()[0] == 0


def test_gdpr(spark, nulls, tmp_path):
    assert gdpr.erase(nulls, "k", 1).count() == 3
    out, errors = gdpr.apply_retention({"t": nulls}, [gdpr.RetentionRule("t", 1, "no_such")], "2024-01-01")
    assert "t" not in out and "t" in errors
    gdpr.export({"t": (nulls, "k")}, 2, str(tmp_path / "x"))
    assert spark.read.json(str(tmp_path / "x/t")).count() == 2
    entry = spark.createDataFrame([("1", "u", "a", "r", "s", "d")], "id string, user_id string, action string, resource string, status string, details string").withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    signed = gdpr.signed(entry, "k")
    assert gdpr.verify(signed, "k").first().valid and not gdpr.verify(signed.withColumn("user_id", F.lit("v")), "k").first().valid
    assert gdpr.kept(signed, "2032-01-01 00:00:00").count() == 0


def test_workflow():
    now, w = datetime(2024, 1, 1), AccessWorkflow()
    r = w.submit("ann", "t", "read", "why", now)
    with pytest.raises(ValueError):
        w.approve(r.id, "ann", now)
    w.approve(r.id, "bob", now, timedelta(days=1))
    assert [x.id for x in w.expire(now + timedelta(days=2))] == [r.id]
    with pytest.raises(ValueError):
        w.revoke(r.id, now)


def test_lineage(spark):
    own = lineage.extract(spark, "WITH x AS (SELECT * FROM base) SELECT x.a AS b, count(y.c) FROM x JOIN other y ON x.a = y.a")
    assert own.sources == {"base", "other"} and own.target is None
    made = lineage.extract(spark, "CREATE TABLE m.t AS SELECT o.k FROM o, p WHERE o.k IN (SELECT q.k FROM q)")
    assert made.target == "m.t" and made.sources == {"o", "p", "q"} and ("o", "k", "k") in made.columns
    edges = [("a", "b"), ("b", "c"), ("b", "<d>")]
    assert json.loads(lineage.export(edges, "json"))["edges"][0] == {"source": "a", "target": "b"}
    assert "&lt;d&gt;" in lineage.export(edges, "graphml") and "-->" in lineage.export(edges, "mermaid", {"a", "b"})


def test_large_lineage_graphs(spark, monkeypatch):
    """Walked by joins, level by level, with the same result as in the driver; cycles end."""
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "e"), ("x", "y"), (None, "a"), ("e", None)], "source_table string, target_table string")
    walked = lambda *args: sorted(tuple(r) for r in lineage.reachable(edges, *args).collect())
    small = [walked("a"), walked("e", False), walked("a", True, 1), walked("none")]
    assert small[0] == [("b", 1), ("c", 2), ("d", 1), ("e", 2)] and small[2] == [("b", 1), ("d", 1)] and small[3] == []
    monkeypatch.setattr(lineage, "SMALL_GRAPH", 2)
    assert [walked("a"), walked("e", False), walked("a", True, 1), walked("none")] == small


def test_evolution(spark, tmp_path):
    assert evolution.overall([]) == evolution.FULL and evolution.overall([evolution.FULL]) == evolution.BACKWARD
    assert evolution.grade("type_changed", "Int32", "Int64") == evolution.BACKWARD and evolution.grade("type_changed", "Int32", "UInt64") == evolution.INCOMPATIBLE
    assert not evolution.compatible("FULL", evolution.FULL, evolution.INCOMPATIBLE) and evolution.compatible("HOLLOW", evolution.INCOMPATIBLE, evolution.INCOMPATIBLE)
    scan = evolution.IncrementalScan(spark, str(tmp_path / "seen.json"))
    first = evolution.discovered(spark, {"t": spark.range(1)})
    assert [c["change"] for c in scan.run(first)[0]] == ["table_added"]
    assert scan.run(first) == ([], evolution.FULL)
    assert scan.run(evolution.discovered(spark, {"t": spark.range(1).withColumn("x", F.lit(1))}))[1] == evolution.INCOMPATIBLE


def test_fulltext_edges(spark):
    docs = spark.createDataFrame([(1, "The quick brown fox"), (2, "quick the fox"), (3, None), (4, "running runs")], "id int, body string")
    idx = fulltext.index(docs, "id", "body")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(fulltext.phrase(idx, "quick fox", 1)) == [1, 2] and ids(fulltext.phrase(idx, "quick fox")) == []
    assert ids(fulltext.wildcard(idx, "f?x")) == [1, 2] and ids(fulltext.fuzzy(idx, "quack", 1)) == [1, 2]
    assert ids(fulltext.boolean(idx)) == [] and fulltext.count(idx, ["fox"]) == 2
    assert ids(fulltext.prefix(fulltext.index(docs, "id", "body", "english"), "runn")) == [4]
    with pytest.raises(ValueError):
        fulltext.index(docs, "id", "body", "klingon")


def test_tiers(spark, tmp_path):
    (tmp_path / "f").write_text("x")
    now = "2024-01-31 00:00:00"
    rows = spark.createDataFrame([(f"file:{tmp_path}/f", "2024-01-30 12:00:00", 50, 1, "Hot"), ("b", "2024-01-20 00:00:00", 50, 1, "Hot"), ("c", "2024-01-30 00:00:00", 1, 1, "Warm"), ("d", "2024-01-30 00:00:00", 50, 11 << 30, "Hot")], "path string, created_at string, access_count_last_month int, size_bytes bigint, tier string").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    assert [r.target_tier for r in tiering.evaluate(rows, now).collect()] == ["Hot", "Warm", "Cold", "Archive"]
    moved = tiering.move(spark, tiering.evaluate(rows.limit(1), now, (tiering.Rule("manual", 0, "Cold"),)), f"file:{tmp_path}/tiers")
    assert len(moved) == 1 and (tmp_path / "tiers/cold/f").exists()


def test_snapshots_conflict_and_garbage(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path))
    first, second = t.begin(), t.begin()
    first.append(spark.range(3))
    second.append(spark.range(4))
    first.commit("2024-01-01 00:00:00")
    with pytest.raises(ConflictError):
        second.commit("2024-01-01 00:00:01")
    assert t.read().count() == 3
    third = t.begin()
    third.overwrite(third.read().where("id > 0"))
    third.commit("2024-03-01 00:00:00")
    assert t.read(snapshot_id=1).count() == 3 and t.read().count() == 2
    assert t.collect_garbage("2024-03-02 00:00:00", dry_run=True)[0] == [1]
    t.collect_garbage("2024-03-02 00:00:00")
    assert t.read().count() == 2 and len(t.snapshots()) == 1
    assert t.collect_garbage("2030-01-01 00:00:00") == ([], [])


def test_views(spark, tmp_path):
    spark.range(6).withColumn("g", F.col("id") % 2).createOrReplaceTempView("base")
    v = Views(spark, str(tmp_path))
    v.create("sums", "SELECT g, SUM(id) AS s FROM base GROUP BY g", merge=(("s", "sum"),))
    asked = spark.sql("SELECT g, SUM(id) AS s FROM base GROUP BY g")
    assert v.rewrite(asked) is asked
    v.refresh("sums", "now")
    assert v.rewrite(asked) is not asked and v.rewrite(spark.sql("SELECT g FROM base")).columns == ["g"]
    assert Views(spark, str(tmp_path)).views["sums"].merge == (("s", "sum"),)
    assert v.invalidate("base") == ["sums"] and v.rewrite(asked) is asked
    v.drop("sums")
    assert v.list() == [] and interval_of("*/5 * * * *") == "5 minutes" and interval_of("0 0 * * *") == "60 seconds"


def test_catalog(spark):
    c = Catalog(spark)
    c.create_database("d")
    c.create_schema("d", "s")
    c.create_table("d", "s", "t", frame=spark.range(2))
    assert c.update_table("d", "s", "t", row_count=2).row_count == 2 and c.list("d", "s") == ["t"]
    c.drop_database("d")
    assert c.list() == []
    s = Statistics()
    assert s.put("x", spark.range(4))[0] == 4 and s.get("x")[1][0]["distinct_count"] == 4
    s.clear()
    assert s.get("x") is None


def test_files_and_sources(spark, tmp_path, nulls):
    info = types.TableInfo("t", "n", types.schema_of(nulls.schema))
    files.write_parquet(nulls, str(tmp_path / "t"), "Gzip", info, bloom={"k": 10})
    assert files.read_info(spark, str(tmp_path / "t")) == info and files.read_info(spark, str(tmp_path)) is None
    assert files.read_parquet(spark, str(tmp_path / "t"), ["s", "zz", "k"]).columns == ["s", "k"]
    with pytest.raises(ValueError):
        files.write_parquet(nulls, str(tmp_path / "u"), "DeltaBinaryPacked")
    assert federation.postgresql_type("_int4") == "List<Int32>" and federation.mysql_type("TINYINT(1)") == "Boolean" and federation.mysql_type("varchar(9)") == "Utf8"
    good, bad = federation.FileSource("s3", "a", {"path": str(tmp_path)}), federation.FileSource("s3", "b", {"path": str(tmp_path / "none")})
    rows, errors = federation.discover(spark, [good, bad])
    assert {r[1] for r in rows} == {"t"} and list(errors) == ["s3_b"]
    assert not federation.KafkaSource("kafka", "k").pushdown.predicates
    assert federation.JdbcSource("postgresql", "sales", {"host": "h"}).url() == "jdbc:postgresql://h:5432/sales"


def test_discovery_runs_as_its_caller(spark, tmp_path):
    """Jobs of the scans are in the caller's group, and an error without a text hides no source either."""

    class Listed(federation.Source):
        def tables(self, spark):
            return [f"t{r[0]}" for r in spark.range(2).collect()]

        def read(self, spark, table):
            return spark.range(1)

    sources = [Listed("jdbc", "a"), federation.Source("kafka", "b"), Listed("jdbc", "c")]
    spark.sparkContext.setJobGroup("discovery", "the caller's")
    try:
        rows, errors = federation.discover(spark, sources)
    finally:
        for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            spark.sparkContext.setLocalProperty(k, None)
    assert [r[:2] for r in rows] == [(s, t) for s in ("jdbc_a", "jdbc_c") for t in ("t0", "t1")] and errors == {"kafka_b": "NotImplementedError"}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("discovery")) == 2


def test_stream_failure_modes(spark, tmp_path):
    spark.createDataFrame([('{"a": 1}',), ("nope",)], "value string").write.text(str(tmp_path / "in"))
    source = lambda: ingest.decoded(spark.readStream.schema("value string").text(str(tmp_path / "in")).withColumnRenamed("value", "raw"), "a int", "raw")

    def fail(df):
        raise RuntimeError("no")

    q = ingest.ingest(source(), ingest.Target(str(tmp_path / "o1")), str(tmp_path / "c1"), str(tmp_path / "dead"), fail)
    q.awaitTermination()
    dead = spark.read.option("recursiveFileLookup", True).schema("value string, error string, batch bigint").parquet(str(tmp_path / "dead"))
    assert dead.count() == 2 and ingest.metrics(q)["rows"] == 2
    with pytest.raises(Exception, match="no"):
        ingest.ingest(source(), ingest.Target(str(tmp_path / "o2")), str(tmp_path / "c2"), None, fail).awaitTermination()
    row = spark.sql("SELECT X'000000000741' AS v, X'01' AS w").select(*ingest.unframed(F.col("v")), *ingest.unframed(F.col("w"))).first()
    assert row[0] == 7 and bytes(row[1]) == b"A" and row[2] is None


def test_packed_databases(spark, tmp_path):
    """Any text comes back as it was, tables without rows too, and what is packed can't be written."""
    rows = [(1, 'a "b", \\ c', -0.1), (2, "", None), (None, " x\ny ", 1e300), (4, None, 0.0), (5, "é\u4e2d\U0001f600", 5e-324)]
    given = spark.createDataFrame(rows, "k bigint, s string, d double")
    url = federation.packed(spark, str(tmp_path / "db"), "own", {"T": given.repartition(3), "HOLLOW": given.limit(0)})
    source = federation.JdbcSource("jdbc", "own", {"url": url, "driver": "org.apache.derby.jdbc.EmbeddedDriver", "tables_query": "SELECT tablename FROM sys.systables WHERE tabletype = 'T'"})
    assert sorted(source.tables(spark)) == ["HOLLOW", "T"]
    assert set(map(tuple, source.read(spark, "T").collect())) == set(rows) and source.read(spark, "HOLLOW").count() == 0
    with pytest.raises(Exception, match="(?i)read.?only"):
        given.write.mode("append").option("driver", "org.apache.derby.jdbc.EmbeddedDriver").jdbc(url, "T")
    counted = spark.table(f"{source.catalog(spark)}.APP.T").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert "PushedAggregates: [COUNT" in counted._jdf.queryExecution().executedPlan().toString() and counted.count() == 5
