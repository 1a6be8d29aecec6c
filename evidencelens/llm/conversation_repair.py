"""Cheapest repair of a conversation's turn structure by the auction algorithm for shortest paths.

A conversation is a lattice of nodes (rows consumed, what was said last). Arcs keep a row (0), give it the other role (1), delete it (2) or
insert an empty turn (5); a truncated row that stays costs 5 more, blank and repeated rows can only be deleted. The auction keeps a price
a node and one path from its origin: where the path's end is cheaper than its best arc, its price rises to that arc and the path
contracts, else the path extends along it. Prices never exceed arc cost plus next price, so once the goal is reached the origin's price is
its distance, and the tight arcs (price equal to cost plus next price) hold every cheapest path; the least audit is read off them
letter by letter, among nodes from which tight arcs reach the goal.

At scale: rows are dealt by ranges of (conversation, turn, role, text) and cut into segments of bounded rows and bytes. A segment that is
no whole conversation has a 4 x 4 table of distances between what was said last before and after it; these tables, a few numbers
for each segment, are folded from the end of the conversation, which gives every segment the exact prices behind it. All segments are
then solved in parallel, in blocks of BLOCK rows from the end, for every state they may be entered in. Only digesting the repaired rows
goes through a conversation in order, in constant memory.

Defined results: null conversations are one conversation; nulls in role and text are one space, null turns come first; rows of one turn
are ordered by role, then text; a role whose first letter is not s, u or a (an empty one, too) cannot be kept; repeated rows are duplicates
of the first; a conversation named by absent rows only has zeros, an empty audit and the digest of nothing; an empty table gives
an empty table; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

RE_ROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SEGMENT_ROWS, SEGMENT_BYTES, BLOCK = 512, 1 << 20, 32
BLANKS = " \t\n\x0b\x0c\r"
#: What was said last: nothing, system, user, assistant. After each, which role an inserted or changed turn has, and where it leads.
STATES = 4
_NEXT = (2, 2, 3, 2)
_ROLE = ("user", "user", "assistant", "user")
_KEEP = ((None, 1, 2, None), (None, None, 2, None), (None, None, None, 3), (None, None, 2, None))  # state, initial (other, s, u, a)
_ENDS = (0, 3)
_MUST_DELETE, _TRUNCATED = 1, 2
#: Prices behind the last row: a user turn lacks an answer, a system turn a user and an answer.
END_PRICES = (0, 2 * INSERT, INSERT, 0)
Code = tuple[int, int]  # (initial: 0 other, 1 s, 2 u, 3 a; fault: 0 none, 1 must be deleted, 2 truncated)


class Block:
    """The lattice of a few rows; its goal is reached from the last column, at the price of each state there, or, when ``closing``, from the ends."""

    def __init__(self, codes: list[Code], prices: tuple | None):
        self.n, closing = len(codes), prices is None
        self.arcs: list[list[tuple[int, str, int]]] = []  # of node STATES * column + state: (cost, letter, node); the goal is node -1
        for i in range(self.n + 1):
            for state in range(STATES):
                arcs = []
                if i < self.n:
                    initial, fault = codes[i]
                    more = TRUNCATED if fault == _TRUNCATED else 0
                    arcs.append((DELETE, "D", STATES * (i + 1) + state))
                    if fault != _MUST_DELETE:
                        if _KEEP[state][initial] is not None:
                            arcs.append((more, "K", STATES * (i + 1) + _KEEP[state][initial]))
                        arcs.append((RE_ROLE + more, "R", STATES * (i + 1) + _NEXT[state]))
                elif closing:
                    if state in _ENDS:
                        arcs.append((0, "", -1))
                elif prices[state] is not None:
                    arcs.append((prices[state], "", -1))
                if i < self.n or closing:
                    arcs.append((INSERT, "I", STATES * i + _NEXT[state]))
                self.arcs.append(arcs)
        useful = self._reaching(lambda node, cost, to: True)
        self.arcs = [[a for a in arcs if a[2] < 0 or useful[a[2]]] for arcs in self.arcs]
        self.price = [0] * (len(self.arcs) + 1)  # the goal's price, at -1, stays 0

    def _reaching(self, use) -> list[bool]:
        """Nodes from which arcs that may be used lead to the goal."""
        good = [False] * len(self.arcs)
        for i in range(self.n, -1, -1):
            nodes = range(STATES * i, STATES * i + STATES)
            for _ in range(3):  # a way through a column has two insertions at most
                for node in nodes:
                    if not good[node]:
                        good[node] = any((to < 0 or good[to]) and use(node, cost, to) for cost, _, to in self.arcs[node])
        return good

    def auction(self, origin: int) -> int | None:
        """The distance from state ``origin`` of the first column to the goal; prices stay for the next origin."""
        arcs, price = self.arcs, self.price
        if not arcs[origin]:
            return None
        path = [origin]
        while True:
            end = path[-1]
            cost, to = min((cost + price[to], to) for cost, _, to in arcs[end])
            if price[end] < cost:
                price[end] = cost
                if len(path) > 1:
                    path.pop()
            elif to < 0:
                return price[origin]
            else:
                path.append(to)

    def trace(self, state: int) -> tuple[str, int]:
        """The least of the cheapest edits from ``state`` of the first column, and the state behind the last row."""
        price = self.price
        tight = lambda node, cost, to: price[node] == cost + price[to]
        good = self._reaching(tight)
        node, letters = state, []
        while True:
            letter, node_next = min((letter, to) for cost, letter, to in self.arcs[node] if tight(node, cost, to) and (to < 0 or good[to]))
            if node_next < 0:
                return "".join(letters), node % STATES
            letters.append(letter)
            node = node_next


def _priced(codes: list[Code], prices: tuple | None, first: tuple[int, ...]) -> tuple[list[Block], list[int | None], int]:
    """Blocks of ``codes`` from the last to the first, the prices before them by state, and what was left out of the first block's prices."""
    cuts = list(range(0, len(codes), BLOCK)) or [0]
    blocks = []
    before: list[int | None] = []
    for at in reversed(cuts):
        base = 0 if prices is None else min(p for p in prices if p is not None)
        block = Block(codes[at : at + BLOCK], None if prices is None else tuple(None if p is None else p - base for p in prices))
        distances = [block.auction(s) if at or s in first else None for s in range(STATES)]
        before = [None if d is None else d + base for d in distances]
        blocks.append(block)
        if all(p is None for p in before):
            break
        prices = tuple(before)
    return blocks, before, len(cuts) - len(blocks)


def distances(codes: list[Code]) -> list[int]:
    """Cheapest costs from each state before the rows to each state behind them; -1 where there is no way."""
    out = [[-1] * STATES for _ in range(STATES)]
    for goal in range(STATES):
        _, before, cut = _priced(codes, tuple(0 if s == goal else None for s in range(STATES)), tuple(range(STATES))) if codes else (None, [0 if s == goal else None for s in range(STATES)], 0)
        for state in range(STATES):
            if not cut and before[state] is not None:
                out[state][goal] = before[state]
    return [x for row in out for x in row]


def cheapest(codes: list[Code], prices: tuple | None, first: tuple[int, ...]) -> dict[int, tuple[str, int]]:
    """By the state before: the least of the cheapest audits, and the state behind the rows."""
    blocks, _, _ = _priced(codes, prices, first)
    traced = [{} for _ in blocks]

    def of(k: int, state: int) -> tuple[str, int]:
        if state not in traced[k]:
            traced[k][state] = blocks[k].trace(state)
        return traced[k][state]

    out = {}
    for start in first:
        state, parts = start, []
        for k in range(len(blocks) - 1, -1, -1):
            letters, state = of(k, state)
            parts.append(letters)
        out[start] = "".join(parts), state
    return out


def edit_cost(audit: str, codes: list[Code]) -> int:
    total, row = 0, 0
    for letter in audit:
        if letter == "I":
            total += INSERT
            continue
        fault = codes[row][1]
        row += 1
        total += DELETE if letter == "D" else (RE_ROLE if letter == "R" else 0) + (TRUNCATED if fault == _TRUNCATED else 0)
    return total


def damage(turns: DataFrame, conv_id: Column, turn: Column, role: Column, text: Column) -> DataFrame:
    """Rows with faults planted by a hash of conversation and turn: dropped (present is false), emptied, without stops, repeated, of role user."""
    say = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(say(conv_id), F.lit(":"), say(turn))) % 20
    body = say(text)
    rows = turns.select(
        conv_id.cast("long").alias("conv_id"),
        turn.cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(say(role)).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(body, "[.!?]", "")).otherwise(body).alias("text"),
        (kind != 0).alias("present"),
        F.when(kind == 3, 2).otherwise(1).alias("copies"),
    )
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy")


_SEGMENT = (
    "conv_id long, task int, seq long, whole boolean, roles array<string>, texts array<string>, codes binary, blank long, duplicate long, truncated long, illegal long, "
    "first string, last string, turns array<long>, distances array<long>"
)


def _segments(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Segments of rows sorted by conversation, turn, role and text: (conv_id, turn, role, text, present, blank, cut, later)."""
    task = TaskContext.get().partitionId()
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()), pa.binary(), *[pa.int64()] * 4, pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = [x.split()[0] for x in _SEGMENT.split(", ")]
    conv, rows, size, seq, convs, single, previous = None, [], 0, 0, 0, True, None

    def out(ended: bool, last_conv: bool) -> pa.RecordBatch:
        whole = single and ended and convs > 1 and not last_conv
        codes = [r[2] for r in rows]
        turns = [r[4] for r in rows if r[4] is not None]
        initials = [r[0][:1] for r in rows]
        cells = [
            conv, task, seq, whole, [r[0] for r in rows], [r[1] for r in rows], bytes(c[0] | c[1] << 2 for c in codes),
            *(sum(r[3] == k for r in rows) for k in (1, 2, 3)), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            initials[0] if rows else None, initials[-1] if rows else None,
            [min(turns), max(turns), len(set(turns))] if turns else None, None if whole else distances(codes),
        ]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds)], names)

    for batch in batches:
        for cells in zip(*batch.columns):
            this, turn, role, text, present, blank, cut, later = (c.as_py() for c in cells)
            if not convs or this != conv:
                if convs:
                    yield out(True, False)
                    seq += 1
                conv, rows, size, single, previous = this, [], 0, True, None
                convs += 1
            elif len(rows) >= most or size >= SEGMENT_BYTES:
                single = False
                yield out(False, False)
                seq += 1
                rows, size = [], 0
            if present:
                row = (turn, role, text)
                fault = 1 if blank else 2 if later or row == previous else 3 if cut else 0
                previous = row
                rows.append((role, text, ("sua".find(role[:1] or "?") + 1, 0 if not fault else _TRUNCATED if fault == 3 else _MUST_DELETE), fault, turn))
                size += len(role) + len(text)
    if convs:
        yield out(True, True)


def _codes(packed: bytes) -> list[Code]:
    return [(b & 3, b >> 2) for b in packed]


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From open segments, the last of a conversation first: the prices behind each (null: it closes the conversation)."""
    conv, prices = None, None
    for batch in batches:
        behind = []
        for this, table in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
            if prices is None or this != conv:
                conv, prices = this, list(END_PRICES)
                behind.append(None)
            else:
                behind.append(list(prices))
            prices = [min(d + p for d, p in zip(table[STATES * s : STATES * s + STATES], prices) if d >= 0) for s in range(STATES)]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(behind, pa.list_(pa.int64()))], ["task", "seq", "prices"])


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, task, seq, audits, costs) by the state before the segment."""
    for batch in batches:
        audits, costs = [], []
        for whole, packed, prices in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5))):
            codes = _codes(packed)
            found = cheapest(codes, None if prices is None else tuple(prices), (0,) if whole else tuple(range(STATES)))
            audits.append([found.get(s, (None,))[0] for s in range(STATES)])
            costs.append([None if a is None else edit_cost(a, codes) for a in audits[-1]])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(audits, pa.list_(pa.string())), pa.array(costs, pa.list_(pa.int64()))], ["conv_id", "task", "seq", "audits", "costs"])


_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its segments in order, each led by its solution."""
    names = [x.split()[0] for x in _REPORT.split(", ")]
    kinds = [*[pa.int64()] * 7, pa.string(), pa.string()]
    conv = now = None

    def out() -> pa.RecordBatch:
        low, high, distinct = now["turns"] or (0, -1, 0)
        cells = [conv, high - low + 1 - distinct, *now["counts"], now["cost"], "".join(now["audit"]), now["digest"].hexdigest()]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds)], names)

    for batch in batches:
        for row in zip(*batch.columns):
            this, audits, costs, roles, texts, counts, first, last, turns = (c.as_py() for c in row)
            if now is None or this != conv:
                if now:
                    yield out()
                conv, now = this, {"turns": None, "counts": [0, 0, 0, 0], "cost": 0, "audit": [], "digest": hashlib.sha256(), "state": 0, "last": None, "lines": 0}
            if audits is not None:
                now["audit"].append(audits[now["state"]])
                now["cost"] += costs[now["state"]]
                continue
            now["counts"] = [a + b for a, b in zip(now["counts"], counts)]
            if first is not None:
                now["counts"][3] += now["last"] is not None and now["last"] + first not in ("su", "ua", "au")
                now["last"] = last
            if turns:
                old = now["turns"]
                now["turns"] = [old[0], turns[1], old[2] + turns[2] - (old[1] == turns[0])] if old else turns
            state, at = now["state"], 0
            for letter in now["audit"][-1]:
                role, text = _ROLE[state], ""
                if letter != "I":
                    role, text = roles[at] if letter == "K" else role, texts[at]
                    at += 1
                if letter == "D":
                    continue
                state = _KEEP[state]["sua".find(role[:1]) + 1]
                now["digest"].update(f"{chr(10) if now['lines'] else ''}{role}:{text}".encode())
                now["lines"] += 1
            now["state"] = state
    if now:
        yield out()


def repair(rows: DataFrame, conv_id: Column, turn: Column, role: Column, text: Column, present: Column | None = None, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """One row per conversation: its faults, the cheapest edits and the digest of the repaired turns. Rows that are not ``present`` only name theirs."""
    body = F.coalesce(text.cast("string"), F.lit(" "))
    rows = rows.select(conv_id.cast("long").alias("conv_id"), turn.cast("long").alias("turn"), F.coalesce(role.cast("string"), F.lit(" ")).alias("role"), body.alias("text"), (F.lit(True) if present is None else present).alias("present"))
    trimmed = F.rtrim("text", F.lit(BLANKS))
    rows = rows.withColumns({"blank": trimmed == "", "cut": ~F.substring(trimmed, -1, 1).isin(".", "!", "?")})
    said = F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.withColumn("said", F.when(F.col("present") & ~F.col("blank"), F.unhex(F.substring(said, 1, 32))))
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    seen = rows.filter("said IS NOT NULL").groupBy("said").agg(F.min(when).alias("earliest"), F.max(when).alias("latest")).filter("earliest <> latest").select("said", "earliest")
    rows = rows.join(seen, "said", "left").withColumn("later", F.coalesce(when > F.col("earliest"), F.lit(False)))
    order = ("conv_id", "turn", "role", "text")
    dealt = rows.select(*order, "present", "blank", "cut", "later").repartitionByRange(*order).sortWithinPartitions(*order)
    segments = materialise(dealt.mapInArrow(lambda batches: _segments(batches, segment_rows), _SEGMENT), "segments")

    open_ = segments.filter("NOT whole").select("conv_id", "task", "seq", "distances")
    folded = open_.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("task"), F.desc("seq")).mapInArrow(_folded, "task int, seq long, prices array<long>")
    shown = segments.select("conv_id", "task", "seq", "whole", "codes").join(folded, ["task", "seq"], "left").select("conv_id", "task", "seq", "whole", "codes", "prices")
    solved = shown.mapInArrow(_solved, "conv_id long, task int, seq long, audits array<string>, costs array<long>")
    counts = F.array("blank", "duplicate", "truncated", "illegal")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    bodies = segments.select("conv_id", "task", "seq", none("array<string>", "audits"), none("array<long>", "costs"), "roles", "texts", counts.alias("counts"), "first", "last", "turns")
    solved = solved.select("*", none("array<string>", "roles"), none("array<string>", "texts"), none("array<long>", "counts"), none("string", "first"), none("string", "last"), none("array<long>", "turns"))
    both = solved.unionByName(bodies).repartition("conv_id").sortWithinPartitions("conv_id", "task", "seq", F.col("audits").isNull())
    return both.drop("task", "seq").mapInArrow(_reported, _REPORT)
