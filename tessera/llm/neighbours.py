"""Approximate nearest neighbours: a hash-prefix forest.

Every tree gives a vector a string of symbols, each the nearest of 32 random directions (16 and their opposites); a
tree's array of vectors, sorted by these strings, is known by how many lie below each prefix of
`depth` bits, SYMBOL to a symbol. A query descends to its own longest prefix in all trees and then
ascends in all of them at once, a symbol at a time, until the ranges that share the
prefix hold `candidates` vectors together, or all if that is less work. These ranges are read off the sorted
counts. Vectors go to the block of the array that holds them, queries to all
blocks of their ranges, and every block multiplies each query with the rows of its range alone.

How many trees to use and how far to ascend is measured: a bounded sample of queries is answered by brute force, and
for each number of trees `candidates` grows until the sample's neighbours lie in the ranges as often as asked; the
number that costs least (copies of vectors, products of queries) is taken, of those that leave enough vectors out.

For the largest inner product, vectors get one more coordinate, which makes
all as long as the longest one of their band; a query has 0 there. Bands are of lengths between two powers of
two, and each has its own part of every array, so that a few long vectors don't make all others alike; every query meets all of a band of a few.

The driver gets the counts of trees x bands x 2^depth prefixes and of visits by block, and the sampled queries with their neighbours, nothing else. A prefix that
alone holds more than a block (copies) is split over blocks by the id's hash, all of
which its queries visit, so that nothing is dropped; a block that very many queries visit is given to several tasks, each with a share of the queries.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Trees at most, vectors that the ascent must reach at least, vectors in a block; bits of a symbol, and symbols of a prefix at most.
TREES, CANDIDATES, BLOCK, SYMBOL, SYMBOLS = 24, 200, 8192, 5, 3
#: Queries that one task multiplies with a block, about; bands of lengths; vectors of a band up to which every query meets them all.
QUERIES, BANDS, FEW = 8192, 8, 256
#: Recall that the ascent must reach on the sampled queries, how many these are, and the factor by which the ascent grows until then.
RECALL, SAMPLE, GROWTH = 0.94, 256, 1.1
#: What a copy of a vector costs, in products; share of the vectors that queries meet at most, if any number of trees can do it.
COPY, PRUNED = 100, 0.85


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def planes(size: int, trees: int, depth: int) -> np.ndarray:
    """The directions that the symbols of the strings stand for, tree by tree."""
    return np.random.RandomState(7).standard_normal((trees * (depth // SYMBOL) << SYMBOL - 1, size + 1))


def prefixes(vectors: np.ndarray, longest: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """[vector, tree]: the first symbols of its string, as a number. longest: the squared length that each vector is brought to; a query's is its own."""
    more = np.sqrt(np.maximum(0, longest - (vectors**2).sum(axis=1)))
    along, out = planes(vectors.shape[1], trees, depth).T, np.empty((len(vectors), trees), np.int64)
    for i in range(0, len(vectors), 2048):
        near = (np.column_stack((vectors[i : i + 2048], more[i : i + 2048])) @ along).reshape(-1, trees, depth // SYMBOL, 1 << SYMBOL - 1)
        axis = np.abs(near).argmax(axis=3)
        symbol = 2 * axis + (np.take_along_axis(near, axis[..., None], axis=3)[..., 0] > 0)
        out[i : i + 2048] = symbol @ (1 << np.arange(depth - SYMBOL, -1, -SYMBOL))
    return out


def asked_prefixes(vectors: np.ndarray, trees: int, depth: int) -> np.ndarray:
    return prefixes(vectors, (vectors**2).sum(axis=1), trees, depth)


def large_bands(below: np.ndarray, depth: int) -> np.ndarray:
    """The first prefix of each band of more than a few vectors."""
    ends = below[0, :: 1 << depth]
    return np.flatnonzero(np.diff(ends) > FEW) << depth


def ranges(cells: np.ndarray, below: np.ndarray, depth: int, candidates: int) -> tuple[np.ndarray, np.ndarray]:
    """[query, tree]: how many bits of depth the query's range leaves open (below 0: the tree is not read), and by query the vectors that its ranges hold. below: [tree, band x 2^depth + prefix] sorted counts.

    All trees open a symbol, one after the other, before any opens the next.
    """
    trees = np.arange(cells.shape[1])
    bands = large_bands(below, depth)
    n = below[0, -1]
    everything = np.where(trees == 0, depth, -1)  # one tree's root holds all for n
    open_bits, holds = np.tile(everything, (len(cells), 1)), np.full(len(cells), n)
    waiting, before = np.ones(len(cells), bool), np.zeros(cells.shape, np.int64)
    for b in range(0, depth + 1, SYMBOL):
        first = (cells >> b) << b
        held = np.zeros(cells.shape, np.int64) + sum(below[trees, band + first + (1 << b)] - below[trees, band + first] for band in bands)
        total = before.sum(axis=1)[:, None] + np.cumsum(held - before, axis=1)
        enough = total >= candidates
        last = enough.argmax(axis=1)
        total = total[np.arange(len(cells)), last]
        hit = waiting & enough.any(axis=1)
        less = np.flatnonzero(hit & (total < n))
        open_bits[less], holds[less] = np.where(trees <= last[less, None], b, b - SYMBOL), total[less]
        waiting &= ~hit
        before = held
    return open_bits, holds


def reach(found: np.ndarray, levels: np.ndarray, cells: np.ndarray, below: np.ndarray, depth: int, candidates: int) -> tuple[int, float]:
    """The least ascent from `candidates` on that finds enough, and the products it costs a query. found: the sampled query of each true neighbour; levels: [neighbour, tree] bits that must be open for it; cells: the queries' prefixes."""
    n = below[0, -1]
    while True:
        open_bits, holds = ranges(cells, below, depth, candidates)
        if not len(found) or np.mean((levels <= open_bits[found]).any(axis=1)) >= RECALL or holds.min() >= n:
            return candidates, holds.mean()
        candidates = math.ceil(candidates * GROWTH)


def dense(batch: pa.RecordBatch, column: str = "vector") -> np.ndarray:
    return batch.column(column).flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1)


def as_binary(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sums of a x b by row, the products added up without rounding on the way (in two doubles)."""
    total, rest = np.zeros(len(a)), np.zeros(len(a))
    for x in (a * b).T:
        new = total + x
        part = new - total
        rest += (total - (new - part)) + (x - part)
        total = new
    return total + rest


def nearest(vectors: DataFrame, queries: Column, k: int = 20, trees: int = TREES, candidates: int = CANDIDATES, block: int = BLOCK, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k nearest by inner product, among all rows but its own.

    queries: which rows are queries. score: the products' exact sum, rounded once. Ties go to the smaller vec_id. Vectors that are null, zero,
    or hold null or non-finite components take no part, nor do null ids and vectors of
    another length than most. Rows with one id are one vector id: the best of
    them counts. Fewer than k others: all of them. An empty table gives no rows.
    """
    rows = vectors.select(F.col(id_column).alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("query")).where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    square = F.least(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), F.lit(1e308))
    power = F.coalesce(F.floor(F.log2(square) / 2), F.lit(-600)).cast("int")
    lengths = rows.groupBy(F.size("vector").alias("size"), power.alias("power")).agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("longest"), F.count_if("query").alias("asks")).toPandas()  # some thousand rows at most
    kind = rows.schema["vec_id"].dataType.simpleString()
    stored = np.dtype("<f4") if vectors.schema[vector_column].dataType.simpleString() == "array<float>" else np.dtype("<f8")
    if not len(lengths):
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    sizes = lengths.groupby("size")["n"].sum()
    size = int(sizes[sizes == sizes.max()].index.min())
    lengths = lengths[lengths["size"] == size].sort_values("power", ascending=False)
    n, asks_in_all = int(lengths["n"].sum()), int(lengths["asks"].sum())
    # the longest are a band, and the most frequent lengths are; the others join the next longer band
    heads = {lengths["power"].iloc[0], *lengths.sort_values(["n", "power"], ascending=False)["power"].iloc[: BANDS - 1]}
    longest, bands = [], []
    band = F.lit(0)
    for x in lengths.itertuples():
        if x.power in heads:
            longest.append(x.longest)
        bands.append((x.power, len(longest) - 1))
    for at, number in bands:
        band = F.when(power == int(at), number).otherwise(band)
    longest = np.array(longest)
    rows = rows.where(F.size("vector") == size).withColumn("band", band)
    depth = SYMBOL * int(np.clip(math.ceil(math.log2(max(1, n) / 64) / SYMBOL), 1, SYMBOLS))
    width = len(longest) << depth

    def cells_of(batch: pa.RecordBatch, own: np.ndarray, trees: int) -> np.ndarray:
        """[vector, tree]: its prefix, behind those of the bands before."""
        band = batch.column("band").to_numpy()
        return prefixes(own, longest[band], trees, depth) + (band.astype(np.int64) << depth)[:, None]

    def count(batches):
        seen = np.zeros((trees, width), np.int64)
        for batch in batches:
            if batch.num_rows:
                cells = cells_of(batch, dense(batch), trees)
                for t in range(trees):
                    seen[t] += np.bincount(cells[:, t], minlength=width)
        tree, cell = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(seen[tree, cell])], ["tree", "cell", "n"])

    counts = rows.select("vector", "band").mapInArrow(count, "tree int, cell int, n bigint").groupBy("tree", "cell").agg(F.sum("n").alias("n")).toPandas()
    held = np.zeros((trees, width), np.int64)
    held[counts["tree"], counts["cell"]] = counts["n"]
    below = np.concatenate((np.zeros((trees, 1), np.int64), np.cumsum(held, axis=1)), axis=1)
    few = ~np.isin(np.arange(len(longest)) << depth, large_bands(below, depth))
    if sample := rows.where("query").select("vec_id", "vector").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect():
        asked, asked_ids = np.array([r["vector"] for r in sample]), np.array([r["vec_id"] for r in sample])
        asked_cells = asked_prefixes(asked, trees, depth)

        def brute(batches):
            """The sampled queries' nearest among a task's vectors, and the bits that must be open for each tree to hold both."""
            best = np.full((len(asked), k), -np.inf)
            best_ids = np.empty((len(asked), k), object)
            best_levels = np.zeros((len(asked), k, trees), np.int8)
            for whole in batches:
                for at in range(0, whole.num_rows, 4096):
                    batch = whole.slice(at, 4096)
                    own, ids = dense(batch), np.array(batch.column("vec_id").to_pylist())
                    cells = cells_of(batch, own, trees) & ((1 << depth) - 1)
                    scores = asked @ own.T
                    scores[asked_ids[:, None] == ids] = -np.inf
                    some = np.argpartition(-scores, min(k, len(ids)) - 1, axis=1)[:, :k]
                    levels = np.frexp((asked_cells[:, None, :] ^ cells[some]).astype(np.float64))[1].astype(np.int8)
                    levels[few[batch.column("band").to_numpy()][some]] = 0
                    best, best_ids = (np.concatenate(x, axis=1) for x in ((best, np.take_along_axis(scores, some, axis=1)), (best_ids, ids.astype(object)[some])))
                    best_levels = np.concatenate((best_levels, levels), axis=1)
                    order = np.argsort(-best, axis=1, kind="stable")[:, :k]
                    best, best_ids = (np.take_along_axis(x, order, axis=1) for x in (best, best_ids))
                    best_levels = np.take_along_axis(best_levels, order[:, :, None], axis=1)
            query, place = np.nonzero(np.isfinite(best))
            yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array(best_ids[query, place].tolist(), pa_kind), pa.array(best[query, place]), as_binary(best_levels[query, place])], ["query", "vec_id", "score", "levels"])

        pa_kind = to_arrow_type(rows.schema["vec_id"].dataType)
        met = rows.select("vec_id", "vector", "band").mapInArrow(brute, f"query int, vec_id {kind}, score double, levels binary").groupBy("query", "vec_id").agg(F.max("score").alias("score"), F.max_by("levels", "score").alias("levels"))
        nearest_first = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        true = met.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k).select("query", "levels").toPandas()
        levels = np.frombuffer(b"".join(map(bytes, true["levels"])), np.int8).reshape(-1, trees)
        plans = []
        for some in sorted({1, *range(2, trees + 1, 2), trees}):  # the first ones of the forest
            reached, products = reach(true["query"].to_numpy(), levels[:, :some], asked_cells[:, :some], below[:some], depth, candidates)
            plans.append((products > PRUNED * n, some * n * COPY + asks_in_all * products, some, reached))
        _, _, trees, candidates = min(plans)  # all of one tree only if no number of trees leaves enough out
    below, held = below[:trees], held[:trees]
    # a block is where its first vector lies in the tree's array; a prefix that is larger than a block alone has parts
    starts = below[:, :-1] // block
    parts = np.maximum(1, -(-held // block))
    context = vectors.sparkSession.sparkContext
    known = context.broadcast((below, starts, parts))
    heads_of = np.arange(0, width, 1 << depth)

    def visits_of(own: np.ndarray):
        """(query, tree, block, part, first prefix, last) of every block that each query's ranges lie in."""
        below, starts, parts = known.value
        asked = asked_prefixes(own, trees, depth)
        open_bits, _ = ranges(asked, below, depth, candidates)
        for t in range(trees):
            for q, b in enumerate(open_bits[:, t].tolist()):
                low = int(asked[q, t]) >> b << b if b >= 0 else 0
                for head, all_of_it in zip(heads_of, few, strict=True):
                    if t if all_of_it else b < 0:
                        continue
                    low_, high = (head, head + (1 << depth)) if all_of_it else (head + low, head + low + (1 << b))
                    inside = low_ + np.flatnonzero(below[t, low_ + 1 : high + 1] > below[t, low_:high])
                    if len(inside):
                        several = parts[t, inside]
                        part = np.arange(several.sum()) - np.repeat(np.cumsum(several) - several, several)
                        visits = np.unique(np.repeat(starts[t, inside], several) * (1 << 32) + part)
                        yield q, t, visits >> 32, visits & 0xFFFFFFFF, low_, high

    def count_visits(batches):
        seen = np.zeros((trees, n // block + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                for _, t, blocks, _, _, _ in visits_of(dense(batch)):
                    np.add.at(seen[t], blocks, 1)
        tree, at = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), pa.array(at.astype(np.int64)), pa.array(seen[tree, at])], ["tree", "block", "n"])

    asks_at = rows.where("query").select("vector").mapInArrow(count_visits, "tree int, block bigint, n bigint").groupBy("tree", "block").agg(F.sum("n").alias("n")).toPandas()
    tasks = np.ones((trees, n // block + 1), np.int64)
    tasks[asks_at["tree"], asks_at["block"]] = -(-asks_at["n"].to_numpy() // QUERIES)
    shares = context.broadcast(tasks)

    def deal(batches):
        """Vectors to their blocks, queries to all blocks of their ranges; a block of several tasks gets its vectors for each, and each query once."""
        below, starts, parts = known.value
        tasks = shares.value
        for batch in batches:
            if not batch.num_rows:
                continue
            own, ids = dense(batch), batch.column("vec_id")
            cells = cells_of(batch, own, trees)
            salt = batch.column("salt").to_numpy()
            out: dict[str, list] = {c: [] for c in ("row", "tree", "block", "part", "task", "cell", "last", "query")}

            def put(row, tree, blocks, part, task, cell, last, query, out=out):
                for c, x in zip(out, (row, tree, blocks, part, task, cell, last, query), strict=True):
                    out[c].append(np.broadcast_to(x, np.shape(row)))

            for t in range(trees):
                at = starts[t, cells[:, t]]
                several = tasks[t, at]
                everyone = np.repeat(np.arange(batch.num_rows), several)
                task = np.arange(len(everyone)) - np.repeat(np.cumsum(several) - several, several)
                put(everyone, t, at[everyone], (salt % parts[t, cells[:, t]])[everyone], task, cells[everyone, t], -1, False)
            asks = np.flatnonzero(batch.column("query").to_numpy(zero_copy_only=False))
            for q, t, blocks, part, low, high in visits_of(own[asks]) if len(asks) else ():
                put(np.full(len(blocks), asks[q]), t, blocks, part, salt[asks[q]] // 7 % tasks[t, blocks], low, high, True)
            row, tree, blocks, part, task, cell, last, query = (np.concatenate(x) for x in out.values())
            for i in range(0, len(row), 16384):
                s = slice(i, i + 16384)
                yield pa.RecordBatch.from_arrays([pa.array(tree[s].astype(np.int32)), pa.array(blocks[s].astype(np.int64)), pa.array(part[s].astype(np.int32)), pa.array(task[s].astype(np.int32)), pa.array(cell[s].astype(np.int32)), pa.array(last[s].astype(np.int32)), pa.array(query[s]), ids.take(pa.array(row[s])), as_binary(own[row[s]].astype(stored))], ["tree", "block", "part", "task", "cell", "last", "query", "vec_id", "vector"])

    def rank(block_rows: pa.Table) -> pa.Table:
        block_rows = block_rows.combine_chunks()
        query = block_rows["query"].to_numpy(zero_copy_only=False).astype(bool)
        data = np.frombuffer(b"".join(block_rows["vector"].to_pylist()), stored).astype(np.float64).reshape(len(query), -1)
        ids = np.array(block_rows["vec_id"].to_pylist())
        cell, last = block_rows["cell"].to_numpy(), block_rows["last"].to_numpy()
        have = np.flatnonzero(~query)
        have = have[np.argsort(cell[have], kind="stable")]
        asks = np.flatnonzero(query)
        asks = asks[np.lexsort((last[asks], cell[asks]))]
        found = []
        cuts = np.flatnonzero((np.diff(cell[asks]) != 0) | (np.diff(last[asks]) != 0)) + 1 if len(asks) else []
        for a, b in zip([0, *cuts], [*cuts, len(asks)], strict=True):
            if b == a:
                continue
            # queries of one range are multiplied with its rows, which lie together
            low, high = np.searchsorted(cell[have], (cell[asks[a]], last[asks[a]]))
            inside = have[low:high]
            for i in range(a, b if len(inside) else a, 256):
                some = asks[i : min(b, i + 256)]
                scores = data[some] @ data[inside].T
                scores[ids[some][:, None] == ids[inside]] = -np.inf
                take = min(k, len(inside))
                edge = -np.partition(-scores, take - 1, axis=1)[:, take - 1]
                # ties with the last one taken are decided by id, on exact products
                rough = 1e-12 * np.sqrt((data[some] ** 2).sum(axis=1) * (data[inside] ** 2).sum(axis=1).max())
                q, v = np.nonzero((scores >= (edge - rough)[:, None]) & np.isfinite(scores))
                for j in range(0, len(q), 1 << 16):  # whole queries need not be together: the best k of a part hold the best k of all
                    qq, vv = some[q[j : j + (1 << 16)]], inside[v[j : j + (1 << 16)]]
                    exact = exact_products(data[qq], data[vv])
                    order = np.lexsort((ids[vv], -exact, qq))
                    qq, vv, exact = qq[order], vv[order], exact[order]
                    new = np.flatnonzero(np.concatenate(([True], qq[1:] != qq[:-1])))
                    best = np.arange(len(qq)) - np.repeat(new, np.diff([*new, len(qq)])) < k
                    found.append((ids[qq[best]], ids[vv[best]], exact[best]))
        own = block_rows.schema.field("vec_id").type
        columns = [np.concatenate(c).tolist() for c in zip(*found, strict=True)] if found else [[], [], []]
        return pa.Table.from_arrays([pa.array(columns[0], own), pa.array(columns[1], own), pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "score"])

    dealt = rows.select("vec_id", "vector", "band", "query", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)).alias("salt")).mapInArrow(deal, f"tree int, block bigint, part int, task int, cell int, last int, query boolean, vec_id {kind}, vector binary")
    met = dealt.groupBy("tree", "block", "part", "task").applyInArrow(rank, f"query_id {kind}, vec_id {kind}, score double")
    once = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
