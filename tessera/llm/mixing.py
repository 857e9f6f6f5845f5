"""Mixing sources to target weights by Pareto order sampling.

A source whose target is r times its size gives floor(r) certain copies of every
document. For what is left, documents draw a uniform u (a hash of the id) and are
ranked by odds(u) / odds(inclusion probability); the first ones in this order
are taken as one more copy, up to the words still wanted, so the sample's size is
fixed. Where the next document is too long for what is left, the following TAIL
ranks fill the gap in order, each if it fits. No source is ever sorted: words
by rank bucket are added up, which shows the buckets in which the sample ends,
and only those are ranked one by one.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import WORD, checkpointed

#: Fixed value: the weights of the contract, repeated over the sources in order.
WEIGHTS = (3, 1, 2)
#: Rank buckets by source.
BUCKETS = 1 << 14
#: Ranks behind the first document that is too long that may fill the gap.
TAIL = 256
#: Sources up to here are broadcast to the documents; more are joined.
BROADCAST_SOURCES = 10_000


def targets(totals: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds target to a row per source (source, source_size): weighted parts of share x all words, at most `most` times the source's size.

    The level to which all sources not stopped rise follows from prefix sums over the
    sources in the order in which they stop.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))).withColumn("cap", most * F.col("source_size"))
    stops = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(share)
    rows = rows.withColumn("level", F.greatest(F.lit(0.0), total - F.coalesce(F.sum("cap").over(stops.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(stops.rowsBetween(0, Window.unboundedFollowing)))
    # of the levels that do not stop their own source, the highest leaves no one else stopped too early
    rows = rows.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything))
    return rows.withColumn("target", F.least("cap", F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight"))).drop("cap", "level", "weight")


def uniform(id_column: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the id and the seed alone."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(id_column.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 8, score_column: str | None = None, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The documents, with size, source_size, target and copies.

    Sources in code point order, null last, take the weights in turn. Inclusion
    odds are those of the share of the source that is wanted beyond whole copies;
    score_column (numbers of 0 or more, null: 0), if named, makes probabilities proportional to it within
    a source. Reruns agree whatever the partitions: draws hash the id.
    Null text has size 0, null ids draw alike. Rows with one id share a draw but are
    counted one by one. A source's words stay below its target by less than the
    shortest of the TAIL documents that were too long. An empty table gives no rows. Columns of docs stay, whatever their names; those named
    like the four added are replaced.
    """
    added = ["size", "source_size", "target", "copies"]
    columns = [c for c in docs.columns if c not in added]
    score = F.coalesce(F.col(score_column).cast("double"), F.lit(0.0)) if score_column else F.lit(1.0)
    # the row is one column here, so that its names can't clash
    rows = docs.select(F.struct(*columns).alias("row"), F.coalesce(F.regexp_count(F.col(text_column), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), F.col(source_column).alias("source"), F.col(id_column).alias("id"), uniform(F.col(id_column), seed).alias("u"), score.alias("score"))
    slim = checkpointed(rows.select("source", "id", "u", "score", "size"))
    totals = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("score")).alias("scored"))
    aims = targets(totals, weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    aims = checkpointed(aims.withColumn("whole", whole).withColumn("part", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") - F.col("whole")).otherwise(0.0)).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")))

    few = aims.count() <= BROADCAST_SOURCES  # else Spark joins by source and splits hot ones

    def ranked(df: DataFrame, of: DataFrame) -> DataFrame:
        """With what the documents' source aims at, and odds(u) / odds(probability) as __rank, its bucket as __bucket."""
        of = of.withColumnRenamed("source", "__of")
        out = df.join(F.broadcast(of) if few else of, F.col("source").eqNullSafe(F.col("__of"))).drop("__of")
        p = F.col("part") * F.col("score") * F.when(F.col("scored") > 0, F.col("source_size") / F.col("scored")).otherwise(0.0) if score_column else F.col("part")
        rank = F.when(p >= 1, 0.0).when(p > 0, (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))).otherwise(F.lit(float("inf")))
        out = out.withColumn("__rank", rank)
        return out.withColumn("__bucket", F.when(F.col("__rank") == float("inf"), BUCKETS).otherwise(F.floor(F.col("__rank") / (1 + F.col("__rank")) * BUCKETS)).cast("int"))

    words = ranked(slim, aims).where("part > 0").groupBy("source", "__bucket").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
    up_to = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    words = words.select("*", F.coalesce(F.sum("words").over(up_to), F.lit(0)).alias("before"), F.coalesce(F.sum("rows").over(up_to), F.lit(0)).alias("rows_before"))
    # the sample ends in the first bucket that holds more than what is left, or soon after it
    words = words.join(aims.select(F.col("source").alias("__of"), "left"), F.col("source").eqNullSafe(F.col("__of"))).drop("__of").where(F.col("before") + F.col("words") > F.col("left"))
    first = Window.partitionBy("source").orderBy("__bucket")
    words = words.withColumn("ranks", F.col("rows_before") - F.min(F.col("rows_before") + F.col("rows")).over(first))
    ends = words.where(F.col("ranks") <= TAIL).groupBy("source").agg(F.min_by("before", "__bucket").alias("before"), F.min("__bucket").alias("first"), F.max("__bucket").alias("last"))
    aims = checkpointed(aims.join(ends.withColumnRenamed("source", "__of"), F.col("source").eqNullSafe(F.col("__of")), "left").drop("__of"))
    none = F.lit(BUCKETS + 1)
    bounds = aims.select("source", "source_size", "target", "scored", F.col("whole").alias("__whole"), "part", F.col("left").alias("__left"), F.col("before").alias("__before"), F.coalesce("first", none).alias("__first"), F.coalesce("last", none).alias("__last"))

    parted = ranked(rows, bounds)
    at_end = F.col("__bucket").between(F.col("__first"), F.col("__last"))
    sure = parted.where(~at_end).withColumn("copies", F.col("__whole") + F.when((F.col("part") > 0) & (F.col("__bucket") < F.col("__first")), 1).otherwise(0))
    order = Window.partitionBy("source").orderBy("__rank", "id", "size")
    # the few documents about where the samples end
    edge = checkpointed(parted.where(at_end)).select("*", F.row_number().over(order).alias("__n"), (F.col("__before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("__with"))
    fits = F.col("__with") <= F.col("__left")
    behind = edge.groupBy("source").agg((F.first("__left") - F.first("__before") - F.coalesce(F.sum(F.when(fits, F.col("size"))), F.lit(0))).alias("gap"), F.count_if(fits).alias("fit"), F.min(F.when(~fits, F.col("__n"))).alias("from"))
    rest = edge.select("source", "__n", "size", fits.alias("fits")).join(behind.withColumnRenamed("source", "__of"), F.col("source").eqNullSafe(F.col("__of"))).where(~F.col("fits") & (F.col("__n") < F.col("from") + TAIL))
    fill = rest.groupBy("source").agg(F.first("gap").alias("gap"), F.array_sort(F.collect_list(F.struct("__n", "size"))).alias("ranks"))  # TAIL ranks a source at most
    fill = fill.select(F.col("source").alias("__of"), F.aggregate("ranks", F.struct(F.col("gap").alias("gap"), F.array().cast("array<int>").alias("taken")), lambda a, x: F.when(x["size"] <= a["gap"], F.struct((a["gap"] - x["size"]).alias("gap"), F.concat(a["taken"], F.array(x["__n"])).alias("taken"))).otherwise(a), lambda a: a["taken"]).alias("__taken"))
    edge = edge.join(fill, F.col("source").eqNullSafe(F.col("__of")), "left")
    edge = edge.withColumn("copies", F.col("__whole") + F.when(fits | F.coalesce(F.array_contains("__taken", F.col("__n")), F.lit(False)), 1).otherwise(0))
    out = ["row", "size", "source_size", "target", F.col("copies").cast("bigint").alias("copies")]
    return sure.select(*out).union(edge.select(*out)).select("row.*", *added)


def repeated(mixed: DataFrame) -> DataFrame:
    """A row for each copy that the mix takes, without the columns that mix() adds."""
    columns = [c for c in mixed.columns if c not in ("size", "source_size", "target", "copies")]
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return mixed.where("copies > 0").select(F.struct(*columns).alias("row"), copies.alias("copy")).select("row.*")
