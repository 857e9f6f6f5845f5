"""Language ID by cross-parsing entropy.

A bounded sample of labelled text per language becomes a suffix automaton. A
text is parsed, language by language, into the longest phrases that the
language's sample holds; the language that needs the fewest phrases, times
the bits that name a place in its sample and divided by the text's length, wins.

A text is parsed whole. So that many steps are taken at once, it is read in blocks of BLOCK characters, each
from its own start at first; the phrase that reaches into a block then goes on there, phrase by phrase, until one begins
where one of the block's own did, from where on both parses are the same. That gives the parse of the whole text.
Texts in which the two parses do not meet (short passages repeated over and over) are finished block after block,
so that time is in proportion to the text there as well. An automaton is a table of next states by state and letter,
hashed where the languages' whole tables would be large, built once in every Python worker from the sample, which
alone is sent to the executors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import slices

#: The sample of each language: rows (about), characters of a row, characters of all.
SAMPLE_ROWS, ROW_CHARS, SAMPLE_CHARS = 400, 300, 30_000
BLOCK = 512
#: Rounds in which all blocks whose first phrase has changed are parsed again at once, while there are no fewer than FEW.
ROUNDS, FEW = 3, 16
#: Classes: all that is no letter, letters that no sample holds, and from 2 on each letter of the samples.
_SPACE, _OTHER = 0, 1
_CODES = 0x30000
#: Bits of an entry of the hash table: the next state's (2 x SAMPLE_CHARS states at most), the letter's.
_STATE_BITS, _CLASS_BITS = 20, 18
_EMPTY = np.uint64(2**64 - 1)
#: Entries, of four bytes, that the whole tables of all languages may have; larger ones are hashed, which takes longer.
WHOLE = 1 << 24
_built: dict[tuple, tuple] = {}


def folded() -> np.ndarray:
    """By code point: that of its lower case if it is a letter, else 0."""
    out = np.zeros(_CODES, np.uint32)
    for c in range(_CODES):
        s = chr(c)
        if s.isalpha():
            out[c] = ord(s.lower()[0])
    return out


class Automaton:
    """The suffix automaton of a text.

    own: by letter, its class here (SPACE, OTHER: not in the text, and from 2 on those of the text). root: by class, the
    state that follows the first one. whole: by state and class, the next state or 0; or, if that is
    None, slots: state, class and next state, hashed by the first two.
    """

    def __init__(self, nexts: list[dict[int, int]], own: np.ndarray, whole: int):
        self.states, self.own, self.classes = len(nexts), own, int(own.max()) + 1
        self.root = np.zeros(self.classes, np.int64)
        for c, s in nexts[0].items():
            self.root[c] = s
        state = np.array([s for s, next_ in enumerate(nexts) for _ in next_], np.uint64)
        letter = np.array([c for next_ in nexts for c in next_], np.uint64)
        to = np.array([t for next_ in nexts for t in next_.values()], np.uint64)
        self.whole = None
        if self.states * self.classes <= whole:
            self.whole = np.zeros(self.states * self.classes, np.int32)
            self.whole[state * np.uint64(self.classes) + letter] = to
            return
        keys = state << _CLASS_BITS | letter
        self.bits = max(4, int(3 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, _EMPTY)
        place, waiting = self.place(keys), np.arange(len(keys))
        while len(waiting):  # the first of those that want a free slot has it, the others go on to the next
            free = waiting[self.slots[place[waiting]] == _EMPTY]
            _, first = np.unique(place[free], return_index=True)
            put = free[first]
            self.slots[place[put]] = keys[put] << _STATE_BITS | to[put]
            waiting = np.setdiff1d(waiting, put, assume_unique=True)
            place[waiting] = place[waiting] + 1 & (1 << self.bits) - 1

    def __len__(self) -> int:
        return self.states

    def place(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def next(self, state: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """The next states, 0 where there is none."""
        if self.whole is not None:
            return self.whole[state * self.classes + classes].astype(np.int64)
        keys = state.astype(np.uint64) << _CLASS_BITS | classes.astype(np.uint64)
        place = self.place(keys)
        found = self.slots[place]
        to = np.where(found >> _STATE_BITS == keys, (found & np.uint64((1 << _STATE_BITS) - 1)).astype(np.int64), 0)
        on = np.flatnonzero((to == 0) & (found != _EMPTY))
        while len(on):  # another key's slot: the next one
            place[on] = place[on] + 1 & (1 << self.bits) - 1
            found = self.slots[place[on]]
            same = found >> _STATE_BITS == keys[on]
            to[on[same]] = (found[same] & np.uint64((1 << _STATE_BITS) - 1)).astype(np.int64)
            on = on[~same & (found != _EMPTY)]
        return to

    def step(self, state: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and whether the characters begin phrases: those at state 0 do, and those without a next state; a character that is not in the text is a phrase of its own."""
        to = self.next(state, classes)
        return np.where(to > 0, to, self.root[classes]), (to == 0) | (state == 0)

    def step_one(self, state: int, c: int) -> tuple[int, bool]:
        """step() of one state and one class, without arrays."""
        to = 0
        if self.whole is not None:
            to = self.whole.item(state * self.classes + c)
        else:
            key = state << _CLASS_BITS | c
            place = (key * 0x9E3779B97F4A7C15 & 2**64 - 1) >> 64 - self.bits
            while (found := self.slots.item(place)) != 2**64 - 1 and not to:
                if found >> _STATE_BITS == key:
                    to = found & (1 << _STATE_BITS) - 1
                place = place + 1 & (1 << self.bits) - 1
        return to or self.root.item(c), not (to and state)


def automaton(classes: np.ndarray, n: int, whole: int) -> Automaton:
    """The suffix automaton of a text; n: letters that are told apart in all texts; whole: entries that a whole table may have."""
    own, letters = np.full(n, _OTHER, np.int32), np.unique(classes[classes > _OTHER])
    own[_SPACE], own[letters] = _SPACE, np.arange(len(letters)) + 2
    classes = own[classes]
    nexts, link, length, last = [{}], [-1], [0], 0
    for c in classes.tolist():
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return Automaton(nexts, own, whole)


def classes_of(texts: list[str], fold: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character classes of all texts, runs of spaces as one, and where each text's begin."""
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    classes = number[fold[np.minimum(data, _CODES - 1)]]
    keep = classes != _SPACE
    keep[1:] |= classes[:-1] != _SPACE
    return classes[keep], np.concatenate(([0], np.cumsum(keep)))[ends]


def model(samples: tuple[tuple[str, str], ...]) -> tuple:
    """(fold, number, [(language, table, bits)]) of (language, text), built once a process."""
    if samples not in _built:
        fold = folded()
        every = fold[np.minimum(np.frombuffer("".join(t for _, t in samples).encode("utf-32-le", "surrogatepass"), np.uint32), _CODES - 1)]
        letters = np.unique(every[every > 0])
        number = np.full(_CODES, _OTHER, np.int32)
        number[0] = _SPACE
        number[letters] = np.arange(len(letters)) + 2
        tables = []
        for language, text in samples:
            classes, _ = classes_of([text], fold, number)
            tables.append((language, automaton(classes, len(letters) + 2, WHOLE // len(samples)), np.log2(max(2, len(classes)))))
        _built.clear()
        _built[samples] = fold, number, tables
    return _built[samples]


class Blocks:
    """Where the blocks of all texts begin and end, where their texts end, and which are the first of theirs."""

    def __init__(self, starts: np.ndarray):
        n = -(-np.diff(starts) // BLOCK)
        self.of = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(self.of)) - np.repeat(np.cumsum(n) - n, n)
        self.begin, self.stop, self.first = starts[:-1][self.of] + BLOCK * place, starts[1:][self.of], place == 0
        self.end = np.minimum(self.begin + BLOCK, self.stop)


def parse_blocks(classes: np.ndarray, blocks: Blocks, table: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """Whether a phrase begins at each character if every block is parsed from its start, and where each block's last phrase ends."""
    begins, ends = np.zeros(len(classes), bool), blocks.stop.copy()
    lengths = blocks.end - blocks.begin
    order = np.argsort(-lengths, kind="stable")
    begin, state = blocks.begin[order], np.zeros(len(order), np.int64)
    live = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")  # blocks longer than the place
    for t, n in enumerate(live):
        state[:n], new = table.step(state[:n], classes[begin[:n] + t])
        begins[begin[:n] + t] = new
    # the last phrases of blocks within texts go on behind them
    rest = np.flatnonzero((blocks.end < blocks.stop)[order])
    rest, state, at = order[rest], state[rest], blocks.end[order[rest]]
    while len(rest):
        state, new = table.step(state, classes[at])
        ends[rest[new]] = at[new]
        on = ~new & (at + 1 < blocks.stop[rest])
        rest, state, at = rest[on], state[on], at[on] + 1
    return begins, ends


def phrases(classes: np.ndarray, starts: np.ndarray, table: Automaton) -> np.ndarray:
    """Phrases of each text, all parsed from their starts."""
    blocks = Blocks(starts)
    if not len(blocks.of):
        return np.zeros(len(starts) - 1)
    classes = table.own[classes]
    begins, own_ends = parse_blocks(classes, blocks, table)
    before = np.concatenate(([0], np.cumsum(begins)))  # own phrases that begin before each character
    count, ends = before[blocks.end] - before[blocks.begin], own_ends.copy()
    entry = np.where(blocks.first, blocks.begin, -1)  # where the first phrase of the text's parse begins in or behind each block
    for _ in range(ROUNDS):
        now = np.where(blocks.first, blocks.begin, np.concatenate(([0], ends[:-1])))
        todo = np.flatnonzero(now != entry)
        entry = now
        ends[todo] = np.maximum(entry[todo], blocks.end[todo])
        count[todo] = 0
        lanes = todo[entry[todo] < blocks.end[todo]]
        at, state = entry[lanes], np.zeros(len(lanes), np.int64)
        while len(lanes) >= FEW:
            state, new = table.step(state, classes[at])
            behind, met = new & (at >= blocks.end[lanes]), new & (at < blocks.end[lanes]) & begins[at]
            count[lanes[met]] += before[blocks.end[lanes[met]]] - before[at[met]]
            ends[lanes[met]] = own_ends[lanes[met]]
            ends[lanes[behind]] = at[behind]
            count[lanes[new & ~met & ~behind]] += 1
            last = ~met & ~behind & (at + 1 >= blocks.stop[lanes])
            ends[lanes[last]] = blocks.stop[lanes[last]]
            on = ~met & ~behind & ~last
            lanes, state, at = lanes[on], state[on], at[on] + 1
        entry[lanes] = -1  # not done
    for k in np.flatnonzero(~blocks.first & (np.concatenate(([0], ends[:-1])) != entry)).tolist():
        while k < len(entry) and not blocks.first[k] and entry[k] != ends[k - 1]:
            entry[k] = ends[k - 1]
            count[k], ends[k] = parse_on(classes, int(entry[k]), int(blocks.end[k]), int(blocks.stop[k]), begins, before, int(own_ends[k]), table)
            k += 1
    return np.bincount(blocks.of, weights=count, minlength=len(starts) - 1)


def parse_on(classes: np.ndarray, at: int, end: int, stop: int, begins: np.ndarray, before: np.ndarray, own_end: int, table: Automaton) -> tuple[int, int]:
    """Phrases that begin from at to the block's end, and where the last of them ends; from a place where a phrase of the block's own parse begins, that parse tells."""
    count, state = 0, 0
    while at < stop:
        state, new = table.step_one(state, classes.item(at))
        if new and at >= end:
            break
        if new and begins.item(at):
            return count + before.item(end) - before.item(at), own_end
        count, at = count + new, at + 1
    return count, at


def rates(texts: list[str], parts: tuple) -> np.ndarray:
    """[text, language]: phrases x bits / characters."""
    fold, number, tables = parts
    classes, starts = classes_of(texts, fold, number)
    size = np.maximum(1, np.diff(starts))
    return np.stack([phrases(classes, starts, table) * bits / size for _, table, bits in tables], axis=1)


def training_sample(rows: DataFrame) -> tuple[tuple[str, str], ...]:
    """(language, text) of a bounded sample of rows with key, text and lang; rows are chosen by the hash of their key and text, null keys too; rows without text or lang are not to be among them."""
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()
    if not counts:
        return ()
    shares = rows.sparkSession.createDataFrame([(r["lang"], min(1 << 20, -(-(SAMPLE_ROWS << 20) // r["n"]))) for r in counts], "lang string, share long")
    draw = F.xxhash64("key", "text", F.lit(5))
    # a passage from anywhere in the row, as long texts often begin alike
    passage = F.substring(F.col("text"), (F.pmod(draw, F.greatest(F.char_length("text") - ROW_CHARS, F.lit(0)) + 1) + 1).cast("int"), F.lit(ROW_CHARS))
    chosen = rows.join(F.broadcast(shares), "lang").where(F.pmod(draw, F.lit(1 << 20)) < F.col("share")).select("lang", draw.alias("draw"), passage.alias("text"))
    # repeated rows are drawn alike; Spark limits each language before it is shuffled
    first = Window.partitionBy("lang").orderBy("draw", "text")
    chosen = chosen.withColumn("n", F.row_number().over(first)).where(F.col("n") <= 4 * SAMPLE_ROWS).collect()
    own: dict[str, list[str]] = {r["lang"]: [] for r in counts}
    for r in sorted(chosen, key=lambda r: (r["draw"], r["text"])):
        own[r["lang"]].append(r["text"])
    texts = sorted((k, " ".join(v)[:SAMPLE_CHARS]) for k, v in own.items())
    return tuple((k, t) for k, t in texts if any(map(str.isalpha, t)))


def identify(docs: DataFrame, learn: Column, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred and score of every document; and the columns of docs named in keep, whatever their names.

    learn: which rows may be learnt from (null: no). lang_pred is und, with score 0, where the
    text is null or has no letter, and if nothing could be learnt. score: how much
    worse the second best language does, as a share of its rate (1 with one language).
    Ties go to the first language in code point order. Repeated rows stay; an empty table gives no
    rows.
    """
    known = docs.where(learn & F.col(lang_column).isNotNull() & F.col(text_column).isNotNull()).select(F.col(id_column).alias("key"), F.col(text_column).alias("text"), F.col(lang_column).cast("string").alias("lang"))
    samples = training_sample(known)
    columns = list(keep or [])
    text = "text"
    while text in columns:
        text += "_"
    rows = docs.select(F.col(id_column).alias("doc_id"), *columns, F.col(text_column).cast("string").alias(text))

    def guess(batches):
        parts = model(samples) if samples else None
        names = np.array([k for k, _ in samples] or ["und"])
        for batch in batches:
            for b in slices(batch, text, 2 << 20):
                texts = [t or "" for t in b.column(text).to_pylist()]
                best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
                letters = np.fromiter((any(map(str.isalpha, t)) for t in texts), bool, len(texts))
                if parts and len(texts):
                    rate = rates(texts, parts)
                    best = rate.argmin(axis=1)
                    if rate.shape[1] > 1:
                        two = np.partition(rate, 1, axis=1)
                        score = np.where(two[:, 1] > 0, 1 - two[:, 0] / np.where(two[:, 1] > 0, two[:, 1], 1), 0.0)
                    else:
                        score = np.ones(len(texts))
                real = letters & bool(parts)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", *columns)], pa.array(np.where(real, names[best], "und").tolist(), pa.string()), pa.array(np.where(real, score, 0.0))], ["doc_id", *columns, "lang_pred", "score"])

    schema = rows.drop(text).schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(guess, schema)
