"""Chat formatting with a grammar round trip.

A conversation is rendered as ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. A deterministic parser reads the rendered text back; where the
recovered turns differ from the source, the conflicting content is escaped and rendered again until they are identical.
The escape puts one backslash into a control string (``<|im_end|>`` becomes ``<|\\im_end|>``, which itself becomes ``<|\\\\im_end|>``), and
the parser takes one out, so every text can be carried. The loss mask covers the texts of assistant turns.

Turns are dealt by ranges of (conversation, turn), so one conversation may fill many tasks; each task streams its sorted rows
into rendered blocks of about ``BLOCK_CHARS``. Only reading a whole conversation back is sequential, because a digest of
all its text is: it takes the finished blocks in order, in constant memory.

Defined results: null text and null role are empty; turns are ordered by turn (null first), then role and text, so ties have one order and
repeated rows are turns of their own; null conv_id is one conversation; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
BLOCK_CHARS = 1 << 18
_MARK = re.compile(r"<\|(im_start|im_end)\|>")
_CONTROL = re.compile(r"<\|(\\*)(im_start|im_end)\|>")
_ESCAPED = re.compile(r"<\|\\(\\*)(im_start|im_end)\|>")

Turn = tuple[str, str]


def escape(content: str) -> str:
    return _CONTROL.sub(r"<|\\\1\2|>", content)


def unescape(content: str) -> str:
    return _ESCAPED.sub(r"<|\1\2|>", content) if "<|\\" in content else content


def escape_role(role: str) -> str:
    """A role is one line: its backslashes are doubled and its line ends written as backslash n."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role)) if "\\" in role else role


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"{START}{role}\n{text}{END}\n" for role, text in turns)


def parse(rendered: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, start, end of the text in ``rendered``) of each turn; None if the text is not a sequence of turns."""
    turns, at = [], 0
    while at < len(rendered):
        close = _MARK.search(rendered, at + len(START)) if rendered.startswith(START, at) else None
        if close is None or close[0] != END or not rendered.startswith("\n", close.end()):
            return None
        role, line, _ = rendered[at + len(START) : close.start()].partition("\n")
        if not line:
            return None
        begin = at + len(START) + len(role) + 1
        turns.append((unescape_role(role), unescape(rendered[begin : close.start()]), begin, close.start()))
        at = close.end() + 1
    return turns


def formatted(turns: list[Turn]) -> str:
    """The rendering of ``turns`` that parses back to them."""
    shown = list(turns)
    while True:
        out = render(shown)
        found = parse(out)
        if found is not None and [t[:2] for t in found] == turns:
            return out
        conflicts = [i for i, (turn, now) in enumerate(zip(turns, shown)) if now == turn and [t[:2] for t in parse(render([turn])) or []] != [turn]]
        if not conflicts:
            raise AssertionError("an escaped turn does not parse back")
        for i in conflicts:
            shown[i] = escape_role(turns[i][0]), escape(turns[i][1])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rendered blocks of rows sorted by conversation and turn."""
    conv, turns, size, part = None, [], 0, 0
    task = TaskContext.get().partitionId()  # ranges follow each other in the order of the partitions

    def out() -> pa.RecordBatch:
        text = formatted(turns)
        mask = [{"start": a, "end": b} for role, _, a, b in parse(text) if role == LOSS_ROLE]
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        cells = [([conv], pa.int64()), ([task], pa.int64()), ([part], pa.int64()), ([text], pa.string()), ([mask], span)]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in cells], ["conv_id", "task", "part", "formatted", "loss"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if turns and (row[0] != conv or size >= BLOCK_CHARS):
                yield out()
                part += 1
                turns, size = [], 0
            conv = row[0]
            turns.append((row[2], row[3]))
            size += len(row[2]) + len(row[3])
    if turns:
        yield out()


def format_conversations(turns: DataFrame, conv_id: Column, turn: Column, role: Column, text: Column) -> DataFrame:
    """Rendered blocks: conv_id, their order (task, part), formatted, loss array<struct<start,end>> of code points."""
    rows = turns.select(conv_id.cast("long").alias("conv_id"), turn.cast("long").alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    order = ("conv_id", "turn", "role", "text")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _blocks, "conv_id long, task long, part long, formatted string, loss array<struct<start:long,end:long>>"
    )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of each conversation from its blocks in order."""
    conv, state = None, None

    def out() -> pa.RecordBatch:
        n, turns, loss_chars, loss, chars = state
        cells = [([conv], pa.int64()), ([n], pa.int64()), ([turns.hexdigest()], pa.string()), ([loss_chars], pa.int64()), ([loss.hexdigest()], pa.string()), ([chars], pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in cells], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for batch in batches:
        for this, rendered, mask in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if state is None or this != conv:
                if state:
                    yield out()
                conv, state = this, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text, _, _ in parse(rendered):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            for span in mask:
                text = unescape(rendered[span["start"] : span["end"]])
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(rendered)
    if state:
        yield out()


def read_back(blocks: DataFrame) -> DataFrame:
    """One row per conversation: counts and digests of what the rendered text and its mask say."""
    dealt = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "task", "part")
    return dealt.select("conv_id", "formatted", "loss").mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
