"""Chat formatting in budgeted windows.

A conversation's turns, in order, are cut into windows of at most `budget`
tokens of formatted text (longer only where one turn, with the system turn, is). A window repeats the last system turn
before it and as many whole turns as `history` tokens hold; prefix sums of the turns'
tokens, searched by bisection, say where it and its history begin and end. The loss mask covers the texts of assistant turns
that the window is the first to hold, so every one is learnt from once.

Rows are sorted by conversation and turn, and each task reads its conversations
as a stream: it holds one window and its history, never a conversation.

Template: a turn is `### role:`, a line break, the text, a line break, `</turn>`
and a line break. In roles and texts a backslash goes before every backslash,
`###` and `</turn>`, and in roles before colons and line breaks.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import slices
from tessera.llm.packing import token_counts

BUDGET, HISTORY = 1024, 256
_ESCAPE, _ESCAPE_ROLE = re.compile(r"\\|###|</turn>"), re.compile(r"\\|###|</turn>|:|\n")
_UNESCAPE = re.compile(r"\\(\\|###|</turn>|:|\n)")
_TURN = re.compile(r"### ((?:[^\\:\n]|\\.)*):\n(.*?)\n</turn>\n", re.S)
_NO = object()


def escape(text: str, role: bool = False) -> str:
    return (_ESCAPE_ROLE if role else _ESCAPE).sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text begins and ends."""
    head, body = f"### {escape(role, True)}:\n", escape(text)
    return f"{head}{body}\n</turn>\n", len(head), len(head) + len(body)


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of a window's turns."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


class _Windows:
    """The windows of one conversation, whose turns are added one by one.

    A turn has a number; turns from `base` on are held, and sums[i] are the tokens before turn base + i. The
    window under way has the turns from `first` on, and repeats those from `start` on and, if it lies before them, the system turn.
    """

    def __init__(self, conv, budget: int, history: int, put):
        self.conv, self.budget, self.history, self.put = conv, budget, history, put
        self.base, self.turns, self.sums = 0, [], [0]
        self.first = self.start = self.window = 0
        self.system: tuple | None = None  # (number, tokens, turn) of the last system turn before the window

    def before(self, turn: int) -> int:
        """Tokens before a turn that is held."""
        return self.sums[turn - self.base]

    def holds(self, until: int) -> int:
        """Tokens of the window if it ended before a turn."""
        apart = self.system is not None and self.system[0] < self.start
        return self.before(until) - self.before(self.start) + (self.system[1] if apart else 0)

    def add(self, role: str, text: str, tokens: int) -> None:
        number = self.base + len(self.turns)
        self.turns.append((role, *turn_text(role, text)))
        self.sums.append(self.sums[-1] + tokens)
        if number > self.first and self.holds(number + 1) > self.budget:
            self.close(number)
        if number == self.first:
            self.begin()

    def begin(self) -> None:
        """Where the history of the window that begins with the last turn begins: what `history` holds, less what that turn leaves no room for."""
        kept = self.system[1] if self.system else 0
        by_history = bisect_left(self.sums, self.before(self.first) - self.history)
        by_room = bisect_left(self.sums, self.before(self.first + 1) + kept - self.budget)
        self.start = min(self.first, self.base + max(by_history, by_room))
        del self.turns[: self.start - self.base], self.sums[: self.start - self.base]
        self.base = self.start

    def close(self, until: int) -> None:
        """Puts the window that ends before a turn, if it has any of its own; the next one begins there."""
        if until == self.first:
            return
        tokens = self.holds(until)
        shown = [t for _, _, t in (self.system,) if self.system[0] < self.start] if self.system else []
        shown += self.turns[self.start - self.base : until - self.base]
        repeated, at, loss = len(shown) - (until - self.first), 0, []
        for i, (role, text, begin, end) in enumerate(shown):
            if i >= repeated and role == "assistant":
                loss.append({"start": at + begin, "end": at + end})
            at += len(text)
        self.put((self.conv, self.window, "".join(t[1] for t in shown), repeated, self.first, until - self.first, loss, tokens))
        for number in range(self.first, until):
            turn = self.turns[number - self.base]
            if turn[0] == "system":
                self.system = (number, self.before(number + 1) - self.before(number), turn)
        self.first, self.window = until, self.window + 1

    def done(self) -> None:
        self.close(self.base + len(self.turns))


def windows(conversations: DataFrame, tokenizer_path: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, text, repeated (turns that earlier windows hold, first), first_turn, new_turns, loss: array<struct<start, end>> in code points, tokens.

    conversations: conv_id, turn, role, text; other columns are ignored. Turns with
    one number come in order of role and text (null first). Null roles and texts count as
    empty; null turns come first; rows with null conv_id are one conversation. Repeated
    rows are turns of their own. An empty table gives no rows. The windows of a
    conversation are in one partition, in order.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    names = ["conv_id", "window", "text", "repeated", "first_turn", "new_turns", "loss", "tokens"]

    def cut(batches):
        own, out = None, []
        arrow = None

        def flush():
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            types = [arrow, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
            out.clear()
            return batch

        for batch in batches:
            arrow = batch.schema.field("conv_id").type
            for b in slices(batch):
                convs, roles, texts = (b.column(c).to_pylist() for c in ("conv_id", "role", "text"))
                # turns end in white space, so a window has the tokens of its turns
                tokens = token_counts(pa.array([turn_text(r, t)[0] for r, t in zip(roles, texts, strict=True)], pa.large_string()), tokenizer_path)
                for conv, role, text, n in zip(convs, roles, texts, tokens.tolist(), strict=True):
                    if own is None or own.conv != conv:
                        if own:
                            own.done()
                        own = _Windows(conv, budget, history, out.append)
                    own.add(role, text, n)
                    if len(out) >= 256:
                        yield flush()
        if own:
            own.done()
            yield flush()

    return rows.mapInArrow(cut, f"conv_id {kind}, window bigint, text string, repeated bigint, first_turn bigint, new_turns bigint, loss array<struct<start:bigint,end:bigint>>, tokens bigint")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from windows() alone, whose partitions and order must be kept."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def read(batches):
        conv, state, arrow = _NO, None, None
        out: list[tuple] = []

        def done():
            out.append((conv, state["turns"], state["all"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"]))

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [arrow, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            out.clear()
            return batch

        for batch in batches:
            arrow = batch.schema.field("conv_id").type
            for own, text, repeated, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "repeated", "loss")), strict=True):
                if conv is _NO or own != conv:
                    if conv is not _NO:
                        done()
                    conv, state = own, {"turns": 0, "all": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0}
                state["chars"] += len(text)
                for role, said in turns_of(text)[repeated:]:
                    state["turns"] += 1
                    state["all"].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = unescape(text[span["start"] : span["end"]])
                    state["loss_chars"] += len(said)
                    state["loss"].update(said.encode())
            if len(out) >= 4096:
                yield flush()
        if conv is not _NO:
            done()
            yield flush()

    return formatted.mapInArrow(read, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
