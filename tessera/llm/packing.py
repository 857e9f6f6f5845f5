"""Mixture-controlled packing: deficit round-robin over source queues.

Documents queue up by source. Every window gives each queue a quantum of tokens
(window x weight / weights of the queues not yet empty); what a queue was owed
beyond whole tokens is its deficit and is carried on. The queues are the leaves
of a balanced tree: of the first n tokens that reach a node, floor(n x left
weights / its weights) go left and the others right. So every window is filled
exactly, what a queue has been served only grows, and its deficit stays within the
tree's depth. As this needs only totals, the carried state of any
window on any partition is computed, not handed on: a token's place in its source
gives its window. With very many sources, a queue holds several, and is a tree of its own with
these as leaves, which divides the queue's tokens in the same way.

Three passes: tokenize once (ids go to a checkpoint with each document's place
in its partition's part of the source), add up tokens by partition and source, and
place the pieces. Only totals are shuffled; no source is gathered in a task.
"""

from __future__ import annotations

import os
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import checkpointed, mix64, slices, small_batches, words_of

#: More sources than this are leaves of so many queues' own trees, dealt by hash; so the plan of windows is small whatever the data.
MAX_QUEUES = 1024
#: Words whose ids a Python worker remembers, in arrays (about 45 bytes a word), bytes of text and new words encoded at once, bytes of ids placed at once.
#: An executor holds a worker for each core beside a full heap, and a slice takes about 20 times its bytes while it is encoded.
CACHE_WORDS, ENCODE_BYTES, ENCODE_WORDS, PLACE_BYTES = 1_500_000, 4 << 20, 4096, 2 << 20
_loaded: dict[str, "WordTokenizer"] = {}


def spelled(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word from its bytes and their places. No word is empty."""
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    starts = ends[:-1] - ends[0]
    place = np.arange(len(data)) - np.repeat(starts, np.diff(ends))
    return np.add.reduceat(mix64(place.astype(np.uint64) << np.uint64(8) | data), starts)


class WordTokenizer:
    """Ids of texts by a tokenizers file whose normalizer and pre-tokenizer never look across white space.

    Each distinct word is encoded once and remembered, under a hash in a sorted array; when there are too many, all are forgotten.
    Words that share a hash are told apart by their characters.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.forget()

    def forget(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.hashes, self.place = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.begin, self.ids = np.zeros(1, np.int64), np.empty(0, self.dtype)

    def places(self, words: pa.Array) -> np.ndarray:
        """Where self.begin has the words, of which new ones are encoded."""
        hashes = spelled(words)
        out, new = np.zeros(len(words), np.int64), np.ones(len(words), bool)
        if len(self.words):
            near = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            out = self.place[near].astype(np.int64)
            new = ~((self.hashes[near] == hashes) & pc.equal(self.words.take(pa.array(out)), words).to_numpy(zero_copy_only=False))
        if not new.any():
            return out
        added = words.filter(pa.array(new))
        if len(self.words) + len(added) > CACHE_WORDS and len(self.words):
            self.forget()
            return self.places(words)
        known, sizes, ids = len(self.words), [], []
        for i in range(0, len(added), ENCODE_WORDS):
            own = [e.ids for e in self.tokenizer.encode_batch_fast(added.slice(i, ENCODE_WORDS).to_pylist(), add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, own), np.int64, len(own)))
            ids.append(np.fromiter(chain.from_iterable(own), self.dtype))
        self.begin = np.concatenate((self.begin, self.begin[-1] + np.cumsum(np.concatenate(sizes))))
        self.ids = np.concatenate((self.ids, *ids))
        self.words = pa.concat_arrays([self.words, added])
        out[new] = known + np.arange(len(added))
        order = np.argsort(hashes[new], kind="stable")
        at = np.searchsorted(self.hashes, hashes[new][order])
        self.hashes, self.place = np.insert(self.hashes, at, hashes[new][order]), np.insert(self.place, at, out[new][order].astype(np.int32))
        return out

    @classmethod
    def load(cls, path: str) -> "WordTokenizer":
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and where each text's ids begin (one more entry than texts)."""
        flat, starts = words_of(texts)
        if not len(flat):
            return np.empty(0, self.dtype), np.zeros(len(starts), np.int64)
        coded = flat.dictionary_encode()
        place = self.places(coded.dictionary)[coded.indices.to_numpy()]
        n = np.diff(self.begin)[place]
        ends = np.concatenate(([0], np.cumsum(n)))
        ids = self.ids[np.repeat(self.begin[place] - ends[:-1], n) + np.arange(ends[-1])]
        return ids, ends[starts]


def token_counts(texts: pa.Array, path: str) -> np.ndarray:
    return np.diff(WordTokenizer.load(path).encode(texts)[1])


def served(phase: tuple, queue: int, windows: int) -> tuple[int, int]:
    """Tokens of the queues before this one, and of this one, in a phase's first windows."""
    _, _, size, _, prefix, _ = phase
    n, before, low, high = size * windows, 0, 0, len(prefix) - 1
    while high - low > 1:
        middle = (low + high) // 2
        total = prefix[high] - prefix[low]
        left = n * (prefix[middle] - prefix[low]) // total if total else 0
        if queue < middle:
            n, high = left, middle
        else:
            n, before, low = n - left, before + left, middle
    return before, n


def plan(totals: list[int], weights: list[float] | None, window: int) -> list[tuple[int, int, int, int, list[int], list[int]]]:
    """Phases (first window, windows, tokens a window, weights' sum, their prefix sums, tokens served before), each with one set of waiting queues.

    Without weights, queues are served in proportion to their totals and end together.
    """
    left, share = list(totals), [round(w * (1 << 20)) for w in weights] if weights else list(totals)
    at, out, depth = 0, [], len(totals).bit_length() + 1
    while (rest := sum(left)) > 0:
        live = [w if n else 0 for w, n in zip(share, left, strict=True)]
        if not sum(live):  # only queues without weight are left
            live = list(left)
        # in proportion to what they have, no queue runs out early; else up to where one could, its deficit included
        whole = rest // window if live == left else min([rest // window, *((n - depth) * sum(live) // (window * w) for n, w in zip(left, live, strict=True) if w)])
        if whole > 0:
            size, windows = window, whole
        else:  # a queue runs out in this window: the others divide what it leaves
            size, windows, live = min(window, rest), 1, shares(min(window, rest), left, live)
        prefix = np.cumsum([0, *live], dtype=object).tolist()
        out.append((at, windows, size, prefix[-1], prefix, [a - b for a, b in zip(totals, left, strict=True)]))
        left, at = [n - served(out[-1], k, windows)[1] for k, n in enumerate(left)], at + windows
    return out


def shares(size: int, left: list[int], weights: list[int]) -> list[int]:
    """One window's tokens by weight, at most what each queue has left; size is at most their sum."""
    out = [0] * len(left)
    while size:
        live = [w if n > o else 0 for w, n, o in zip(weights, left, out, strict=True)]
        if not any(live):
            live = [n - o for n, o in zip(left, out, strict=True)]
        total, seen, given, more = sum(live), 0, 0, list(out)
        for k, w in enumerate(live):
            seen += w
            cut = size * seen // total
            more[k] = min(left[k], out[k] + cut - given)
            given = cut
        size -= sum(more) - sum(out)
        out = more
    return out


def leaf_paths(totals: list[int]) -> list[list[tuple[int, int, bool]]]:
    """For each source of a queue: the nodes down to it, as (left total, total, whether it is on the left)."""
    prefix, out = np.cumsum([0, *totals], dtype=object).tolist(), []
    for k in range(len(totals)):
        low, high, path = 0, len(totals), []
        while high - low > 1:
            middle = (low + high) // 2
            path.append((prefix[middle] - prefix[low], prefix[high] - prefix[low], k < middle))
            low, high = (low, middle) if k < middle else (middle, high)
        out.append(path)
    return out


def inner(path: list[tuple[int, int, bool]], n: int) -> tuple[int, int]:
    """Of a queue's first n tokens: those of the sources before this one, and its own."""
    before = 0
    for left_total, total, is_left in path:
        left = n * left_total // total if total else 0
        if is_left:
            n = left
        else:
            before, n = before + left, n - left
    return before, n


def pieces(phases: list, queue: int, start: int, n: int, path: list = (), total: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(place in the document, length, window, offset in it) of n tokens from place `start` of a source; path and total: its place in its queue's tree, and its tokens, if the queue holds others."""

    def at(windows: int) -> tuple[int, int]:
        """Tokens before the source's, and its own, in a phase's first windows; its own from the very start."""
        before, own = served(phase, queue, windows)
        before_inner, own = inner(path, phase[5][queue] + own)
        return before + before_inner, own

    firsts = [inner(path, p[5][queue])[1] for p in phases]
    done, phase, w = 0, None, 0
    while done < n:
        y = start + done
        # of phases with the same start the last one serves it
        now = phases[bisect_right(firsts, y) - 1]
        if now is not phase:
            phase, low, high = now, 0, now[1] - 1
            # windows are near to where the queue's share puts them
            share = now[4][queue + 1] - now[4][queue]
            place = y * path[0][1] // total if path else y
            near, step = max(0, min(high, (place - now[5][queue]) * now[3] // (now[2] * share))), 1
            while low < (to := max(low, near - step)) and at(to)[1] > y:
                step *= 4
            low, step = to, 1
            while (to := min(high, near + step)) < high and at(to + 1)[1] <= y:
                step *= 4
            high = to
            while low < high:
                middle = (low + high) // 2
                low, high = (low, middle) if at(middle + 1)[1] > y else (middle + 1, high)
            w, (before, begin) = low, at(low)
            after, end = at(w + 1)
        while end <= y:
            w, before, begin = w + 1, after, end
            after, end = at(w + 1)
        take = min(n - done, end - y)
        # a window holds the sources in order
        yield done, take, now[0] + w, after - before + y - begin
        done += take


def pack(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2, weights: dict[str | None, float] | None = None, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """Pack all documents into windows of `window` tokens, filled in the sources' target proportions.

    Returns a row per piece: doc_id, start, length, doc_tokens,
    sequence_id, offset, source, ids (binary, little-endian unsigned 32-bit).
    All windows but the last are full, so only that one is padded.

    weights: target proportion by source (sources not named: 0, served once the
    others are empty); None: in proportion to the sources' tokens. At most MAX_QUEUES sources can be named where there are more.
    Null text counts as empty: its one id is end_id. Null sources are a queue of
    their own. Repeated rows are packed as often as they occur. An empty table
    gives no rows. Columns other than the three named are ignored. Order within
    a queue follows the input's partitions.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).cast("string").alias("source"), F.col(text_column).cast("string").alias("text"))
    names = [r[0] for r in rows.groupBy("source").agg(F.lit(1)).limit(MAX_QUEUES + 1).collect()]
    many = len(names) > MAX_QUEUES
    if many:
        names = list(weights or ())  # these have queues of their own
        if len(names) > MAX_QUEUES:
            raise ValueError(f"at most {MAX_QUEUES} sources can have weights where there are more sources")
    names.sort(key=lambda s: (s is None, s or ""))
    queues = len(names) + MAX_QUEUES if many else max(1, len(names))
    number = F.when(F.lit(False), 0)  # one flat CASE, however many sources
    for i, s in enumerate(names):
        number = number.when(F.col("source").eqNullSafe(F.lit(s).cast("string")), i)
    if many:
        number = number.otherwise(F.pmod(F.xxhash64("source"), F.lit(MAX_QUEUES)) + len(names))
    rows = rows.withColumn("queue", number.cast("int"))

    def tokenize(batches):
        own, part, served = WordTokenizer.load(tokenizer_path), TaskContext.get().partitionId(), {}
        for batch in batches:
            for b in slices(batch, most=ENCODE_BYTES):
                ids, at = own.encode(b.column("text"))
                n = np.diff(at) + 1
                places = np.empty(b.num_rows, np.int64)
                for i, q in enumerate(b.column("source").to_pylist()):
                    places[i] = served.get(q, 0)
                    served[q] = places[i] + n[i]
                data = np.insert(ids, at[1:], end_id).tobytes()
                ends = np.concatenate(([0], np.cumsum(n))) * own.dtype().itemsize
                stored = pa.Array.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([part] * b.num_rows, pa.int32()), b.column("queue"), b.column("doc_id"), b.column("source"), pa.array(places), pa.array(n), stored], ["part", "queue", "doc_id", "source", "place", "n", "ids"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    with small_batches(spark):
        tokens = checkpointed(rows.select("doc_id", "source", "queue", "text").mapInArrow(tokenize, f"part int, queue int, doc_id {kind}, source string, place bigint, n bigint, ids binary"))
    by_part = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = tokens.groupBy("part", "queue", "source").agg(F.sum("n").alias("n"))
    parts = checkpointed(parts.select("part", "queue", "source", "n", F.coalesce(F.sum("n").over(by_part), F.lit(0)).alias("before")))
    totals = [0] * queues
    for r in parts.groupBy("queue").agg(F.sum("n").alias("n")).collect():  # twice MAX_QUEUES rows at most
        totals[r["queue"]] = r["n"]
    phases = plan(totals, [weights.get(s, 0) for s in names] + [0] * (queues - len(names)) if weights and names else None, window)
    narrow = WordTokenizer.load(tokenizer_path).dtype

    path_kind = "path array<struct<left_total:bigint,total:bigint,is_left:boolean>>, total bigint"

    def paths(own: pa.Table) -> pa.Table:
        """Each source's path in its queue; a queue holds one of MAX_QUEUES sources."""
        own = own.sort_by("source")
        found = [[{"left_total": a, "total": b, "is_left": c} for a, b, c in path] for path in leaf_paths(own["n"].to_pylist())]
        kind = pa.list_(pa.struct([("left_total", pa.int64()), ("total", pa.int64()), ("is_left", pa.bool_())]))
        return pa.table({"source": own["source"], "path": pa.array(found, kind), "total": own["n"]})

    def place(batches):
        for batch in batches:
            for b in slices(batch, "ids", PLACE_BYTES):
                out: list[list] = [[] for _ in range(8)]
                for queue, doc, source, at, before, n, ids, path, total in zip(*(b.column(c).to_pylist() for c in ("queue", "doc_id", "source", "place", "before", "n", "ids", "path", "total")), strict=True):
                    wide = np.frombuffer(ids, narrow).astype("<u4").tobytes()
                    for start, length, sequence, offset in pieces(phases, queue, at + before, n, [tuple(x.values()) for x in path or ()], total):
                        own = wide[4 * start : 4 * (start + length)]
                        for column, x in zip(out, (doc, start, length, n, sequence, offset, source, own), strict=True):
                            column.append(x)
                schema = [b.schema.field("doc_id").type, *[pa.int64()] * 5, pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, schema, strict=True)], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "source", "ids"])

    known = parts.select(F.col("part").alias("of_part"), F.col("source").alias("of"), "before")
    if many:
        inner_paths = parts.groupBy("queue", "source").agg(F.sum("n").alias("n")).groupBy("queue").applyInArrow(paths, f"source string, {path_kind}")
        known = known.join(inner_paths, F.col("of").eqNullSafe(F.col("source"))).drop("source")
    else:
        known = known.select("*", F.lit(None).cast("array<struct<left_total:bigint,total:bigint,is_left:boolean>>").alias("path"), F.lit(0).cast("bigint").alias("total"))
    # a row per partition and source: Spark broadcasts it while it is small
    joined = tokens.join(known, (F.col("part") == F.col("of_part")) & F.col("source").eqNullSafe(F.col("of")))
    return joined.mapInArrow(place, f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, source string, ids binary")
