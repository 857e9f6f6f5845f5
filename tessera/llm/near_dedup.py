"""Near-duplicate groups: signature-coordinate inverted join of MinHash signatures.

1. Each text gives its set of word shingles, SIGNATURE minimum hashes and a
   digest of the set. Texts with one set are one class, kept by its smallest id.
2. Every class posts under its (coordinate, value) pairs. Two classes match if
   they share enough pairs (matches()). Pairs of one class alone match nothing, so
   a class with fewer others is done; of the rest it is
   enough to post the rarest (its pairs that count less the matches less 1): two that match
   must meet there (prefix merging).
3. Postings are merged star by star: members meet one pivot, pairs that a
   longer signature says are far apart go, and the others are confirmed on the full sets. After
   each merging, postings whose members are all one component are skipped, and
   so are pairs of one component. The last merging compares all members still in
   different components, block by block in the tasks' memory, and hands on the closest pair
   of each member and component, so no link between components is lost and no group's pairs are written.
4. Components of the confirmed links, by stars, in checkpointed rounds.

The tasks see postings by key and pairs by id; nothing is gathered by
group, and the driver gets a bitmap of fixed size and row counts only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import checkpointed, lowered, mix64, release, slices, tidy, window_hashes, word_hashes, words_of
from tessera.llm.components import connected

SHINGLE, SIMILARITY = 3, 0.85
#: Coordinates of a signature, and one-byte coordinates of the longer one.
SIGNATURE, LONG = 64, 256
#: Standard deviations below the similarity asked for at which a count of equal coordinates still is a match. At 0.85 that is 40 of 64, which 1 in 200,000 pairs misses; see README.
DEVIATIONS = 5
#: Mergings with pivots before the last one.
PIVOT_ROUNDS = 2
#: Members of a posting that are compared with each other in one task.
BLOCK = 2048
#: Bits of the bitmap of ids whose sets are needed; ids beyond what it can tell apart only cost time.
BITMAP = 1 << 23
_SEED = np.uint64(0x9E3779B97F4A7C15)


def matches(percent: int, coordinates: int) -> int:
    """How many coordinates two classes must share."""
    p = percent / 100
    return max(1, math.floor(coordinates * p - DEVIATIONS * math.sqrt(coordinates * p * (1 - p))))


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in order, and where each text's begin. Texts of fewer words have one shingle: all of them."""
    flat, starts = words_of(lowered(texts))
    words, size = word_hashes(flat), np.diff(starts)
    hashes, of = window_hashes(words, starts, n)
    for k in range(1, n):
        own, text = window_hashes(words, starts, k)
        short = size[text] == k
        hashes, of = np.concatenate((hashes, own[short])), np.concatenate((of, text[short]))
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    return hashes[new], np.concatenate(([0], np.cumsum(np.bincount(of[new], minlength=len(starts) - 1))))


def minima(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """n minimum hashes (unsigned 32-bit) of each set that isn't empty."""
    out = np.empty((int((np.diff(starts) > 0).sum()), n), np.uint32)
    begin = starts[:-1][np.diff(starts) > 0]
    if not len(begin):
        return out
    rng = np.random.RandomState(9)
    a, b = rng.randint(0, 1 << 62, n).astype(np.uint64) | np.uint64(1), rng.randint(0, 1 << 62, n).astype(np.uint64)
    # sets in blocks that stay in the cache
    cuts = np.flatnonzero(np.diff(begin // 16384, prepend=-1))
    for i, k in zip(cuts, [*cuts[1:], len(begin)], strict=True):
        x = hashes[begin[i] : begin[k] if k < len(begin) else len(hashes)]
        at = begin[i:k] - begin[i]
        for c in range(n):
            out[i:k, c] = np.minimum.reduceat(((x * a[c] + b[c]) >> np.uint64(32)).astype(np.uint32), at)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (the set's digest) and keys (coordinate and value in one long; empty without shingles)."""

    def sign(batches):
        coordinate = np.arange(SIGNATURE, dtype=np.int64) << 32
        for batch in batches:
            for b in slices(batch):
                hashes, starts = shingle_sets(b.column("text"))
                n = np.diff(starts)
                sums = [np.concatenate(([np.uint64(0)], np.cumsum(mix64(hashes ^ s), dtype=np.uint64))) for s in (_SEED, ~_SEED)]
                digests = [(x[starts[1:]] - x[starts[:-1]]).astype(np.int64) for x in sums]
                keys = (minima(hashes, starts, SIGNATURE).astype(np.int64) + coordinate).reshape(-1)
                ends = np.concatenate(([0], np.cumsum(np.where(n > 0, SIGNATURE, 0)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), *map(pa.array, digests), pa.ListArray.from_arrays(ends, keys)], ["doc_id", "n_shingles", "d1", "d2", "keys"])

    return docs.mapInArrow(sign, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles bigint, d1 bigint, d2 bigint, keys array<bigint>")


def postings(classes: DataFrame, least: int) -> DataFrame:
    """(key, id, n) of the prefixes of classes (id, n, keys), where two or more classes meet; least: pairs that a match shares."""
    posted = classes.select(F.explode("keys").alias("key"), "id", "n")
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1")
    own = posted.join(shared, "key").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("classes", "key"))).alias("keys"))  # SIGNATURE keys an id at most
    prefix = own.where(F.size("keys") >= least).select("id", "n", F.explode(F.slice("keys", F.lit(1), F.size("keys") - (least - 1))).alias("x")).select("x.key", "id", "n")
    meet = prefix.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return checkpointed(prefix.join(meet, "key").select("key", "id", "n"))


def sets_of(docs: DataFrame, ids: DataFrame, repeated: bool) -> DataFrame:
    """(id, long, set) of the documents with those ids: the longer signature as bytes, and the sorted shingle hashes. repeated: an id may have several rows."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(BITMAP))
    bits = ids.select(slot("id").alias("s")).distinct().select(F.shiftright("s", 15).alias("bucket"), (F.col("s") % 32768).alias("bit"))
    bitmap = np.zeros((BITMAP >> 15, 4096), np.uint8)
    for r in bits.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():  # BITMAP / 8 bytes
        bitmap[r["bucket"]] = np.frombuffer(r["bits"], np.uint8)
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap.reshape(-1))

    def sets(batches):
        for batch in batches:
            s = batch.column("slot").to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((wanted.value[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1))
            for b in slices(batch) if batch.num_rows else ():
                hashes, starts = shingle_sets(b.column("text"))
                some = np.flatnonzero(np.diff(starts))
                long = minima(hashes, starts, LONG).astype(np.uint8)
                ends = np.concatenate((starts[:-1][some], starts[-1:])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(some)), pa.array([x.tobytes() for x in long], pa.binary()), pa.ListArray.from_arrays(ends, hashes.view(np.int64))], ["id", "long", "set"])

    found = docs.select("doc_id", "text", slot("doc_id").alias("slot")).mapInArrow(sets, f"id {docs.schema['doc_id'].dataType.simpleString()}, long binary, set array<bigint>").join(ids, "id", "left_semi")
    return checkpointed(found.dropDuplicates(["id", "long"]) if repeated else found)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    long_matches = matches(percent, LONG)

    def alike(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, LONG) for c in ("long_a", "long_b"))
                batch = batch.filter(pa.array((a == b).sum(axis=1) >= long_matches))
            yield batch.select(["a", "b"])

    def same(batches):
        for batch in batches:
            keep = []
            (a, i), (b, k) = ((c.flatten().to_numpy(), c.offsets.to_numpy() - c.offsets[0].as_py()) for c in (batch.column("set_a"), batch.column("set_b")))
            for r in range(batch.num_rows):
                x, y = a[i[r] : i[r + 1]], b[k[r] : k[r + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    for column, keep in (("long", alike), ("set", same)):
        left, right = (sets.select(F.col("id").alias(c), F.col(column).alias(f"{column}_{c}")) for c in "ab")
        pairs = pairs.join(left, "a").join(right, "b").mapInArrow(keep, f"a {kind}, b {kind}").distinct()
    return pairs


def with_pivots(rows: DataFrame, merging: int, percent: int) -> DataFrame:
    """Pairs (a, b) of the members of each key with one of them, if they are in different components and no set is too large for the other."""
    others = F.struct(F.col("id").alias("other"), F.col("component").alias("of"), F.col("n").alias("n_other"))
    pivots = rows.groupBy("key").agg(F.min_by(others, F.xxhash64("id", "key", F.lit(merging))).alias("p")).select("key", "p.*")
    met = rows.join(pivots, "key").where("component <> of").where(F.least("n", "n_other") * 100 >= F.greatest("n", "n_other") * percent)
    return met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def across(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the components that share a key: for each member the closest one of every other component, if close enough.

    In every key one component is the largest; its members need not meet each
    other. All other pairs are compared, each in the first key that they share. A key with
    more than BLOCK members is dealt out as pairs of blocks. Pairs live in the tasks' memory only.
    """
    long_matches = matches(percent, LONG)
    sizes = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("members"))
    largest = sizes.groupBy("key").agg(F.max_by("component", F.struct("members", "component")).alias("largest"), F.ceil(F.sum("members") / BLOCK).alias("blocks"))
    own = rows.groupBy("id").agg(F.array_sort(F.collect_set("key")).alias("keys"))  # a prefix at most
    # half of the hashes' bits will do: links that are found are confirmed on the sets
    half = sets.select("id", F.size("set").alias("size"), "long", F.transform("set", lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("half"))
    members = rows.join(largest, "key").join(half.join(own, "id"), "id")
    block = F.pmod(F.xxhash64("id"), F.col("blocks"))
    units = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "component", (F.col("component") != F.col("largest")).alias("lone"), "size", "long", "half", "keys")
    dealt = units.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    kind = rows.schema["id"].dataType.simpleString()

    def compare(unit: pa.Table) -> list[tuple]:
        key, apart = unit["key"][0].as_py(), unit["i"][0].as_py() != unit["j"][0].as_py()
        ids, keys = unit["id"].to_pylist(), unit["keys"].to_pylist()
        block, lone, size = (unit[c].to_numpy() for c in ("block", "lone", "size"))
        component = np.unique(np.array(unit["component"].to_pylist(), object).astype(str), return_inverse=True)[1]
        long = np.frombuffer(b"".join(unit["long"].to_pylist()), np.uint8).reshape(-1, LONG)
        half, ends = pa.concat_arrays([c.flatten() for c in unit["half"].chunks]).to_numpy(), np.concatenate(([0], np.cumsum(size)))
        with_key: dict[int, list[int]] = {}
        for r, own in enumerate(keys):
            for k in own:
                if k < key:
                    with_key.setdefault(k, []).append(r)
        out = []
        for y in np.flatnonzero(lone):
            fit = (component != component[y]) & (100 * np.minimum(size, size[y]) >= percent * np.maximum(size, size[y]))
            fit &= ~lone | (np.arange(len(ids)) > y)  # two lone ones meet once
            if apart:
                fit &= block != block[y]
            for k in keys[y]:
                if k < key:  # they have met there
                    fit[with_key[k]] = False
            near = np.flatnonzero(fit)
            if not len(near):
                continue
            same = (long[near] == long[y]).sum(axis=1)
            seen: set[int] = set()
            mine = half[ends[y] : ends[y + 1]]
            for o in np.argsort(-same, kind="stable"):
                if same[o] < long_matches:
                    break
                x = near[o]
                if component[x] in seen:
                    continue
                both = np.isin(half[ends[x] : ends[x + 1]], mine).sum()
                if (100 + percent) * both >= percent * (size[x] + size[y]):
                    seen.add(component[x])
                    out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
        return out

    def run(batches):
        rest, arrow = None, None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            arrow = batch.schema.field("id").type
            now = pa.concat_tables([rest, now]) if rest is not None else now
            marks = np.stack([now[c].to_numpy() for c in ("key", "i", "j")], axis=1)
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            found = []
            for a, b in zip([0, *cuts], cuts, strict=False):
                if b - a > 1:
                    found += compare(now.slice(a, b - a).combine_chunks())
            rest = now.slice(cuts[-1] if len(cuts) else 0).combine_chunks()
            del now
            tidy()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, arrow) for x in zip(*found, strict=True)], ["a", "b"])
        if rest is not None and rest.num_rows > 1 and (found := compare(rest.combine_chunks())):
            yield pa.RecordBatch.from_arrays([pa.array(x, arrow) for x in zip(*found, strict=True)], ["a", "b"])

    return dealt.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def links(posted: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(id, component) of the ids with confirmed links."""
    known = None
    for merging in range(PIVOT_ROUNDS + 1):
        rows = posted.withColumn("component", F.col("id"))
        if known is not None:
            rows = posted.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
            mixed = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
            rows = checkpointed(rows.join(mixed, "key"))
        pairs = with_pivots(rows, merging, percent) if merging < PIVOT_ROUNDS else across(rows, sets, percent)
        edges = confirmed(pairs, sets, percent)
        if known is not None:
            edges = edges.union(known.where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b")))
        known = connected(edges)
        del rows, pairs, edges
        release(posted.sparkSession)
    return known


def groups(docs: DataFrame, percent: int = round(100 * SIMILARITY), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the component's smallest id) of every document.

    Documents are linked if 100 x intersection >= percent x union of their sets
    of shingles of three words, A-Z lower-cased. Null and empty texts have no
    shingles and are alone. Rows with one id are one document: each has its own
    n_shingles, all have one component. Null ids are alone, without a component,
    and kept. An empty table gives no rows; other columns are ignored.
    """
    slim = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    signed = checkpointed(signatures(slim))
    some = signed.where("n_shingles > 0 and doc_id is not null")
    digest = ["d1", "d2", "n_shingles"]
    firsts = some.groupBy(*digest).agg(F.min("doc_id").alias("first"))
    members = checkpointed(some.select("doc_id", *digest).join(firsts, digest).select("doc_id", "first"))
    classes = signed.join(firsts, digest).where("doc_id = first").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "keys").dropDuplicates(["id", "n"])
    posted = postings(classes, matches(percent, SIGNATURE))
    del classes
    release(docs.sparkSession)
    repeated = not members.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    sets = sets_of(slim, posted.select("id").distinct(), repeated)
    release(docs.sparkSession)
    near = links(posted, sets, percent)
    del posted, sets
    # an id with several texts is in several classes, so classes link through it as well
    several = members.groupBy("doc_id").agg(F.min("first").alias("low"), F.max("first").alias("high")).where("low <> high").select("doc_id")
    bridges = members.join(several, "doc_id").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    if not bridges.isEmpty():
        near = connected(near.select(F.col("id").alias("a"), F.col("component").alias("b")).union(bridges))
    of = members.join(near.withColumnRenamed("id", "first"), "first", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "first")).alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(of, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = round(100 * SIMILARITY), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents, one of each group of near-duplicates; of several rows with the id that stays, one. Columns stay."""
    found = groups(docs, percent, id_column, text_column)
    # the row is one column here, so that its names can't clash
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_column).alias("id"))
    rows = rows.join(found.where("not kept").select(F.col("doc_id").alias("id")).distinct(), "id", "left_anti")
    twice = checkpointed(found.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"))
    if not twice.isEmpty():
        rows = rows.join(twice, "id", "left_anti").unionByName(rows.join(twice, "id", "left_semi").dropDuplicates(["id"]))
    return rows.select("row.*")
