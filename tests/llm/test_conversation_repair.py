"""Repairs against a search over all edits, and the query against a plain-Python twin over the whole table."""

import hashlib
import re
import sys
import zlib
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidencelens.llm import catalog, conversation_repair
from evidencelens.llm.text import ship
from tests.conftest import SMALL

sys.setrecursionlimit(50_000)
WORD = re.compile(r"[^\x20\x09-\x0D]")


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def plain(rows, dropped=False):
    """The report of one conversation's rows (turn, role, text), by dynamic programming from the end over whole audits."""
    rows = sorted(((t is not None, t or 0, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows))
    faults, seen = [], set()
    for _, _, role, text in rows:
        marks = WORD.findall(text)
        faults.append(1 if not marks else 2 if (role, text) in seen else 3 if marks[-1] not in ".!?" else 0)
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]
    turns = [t for known, t, _, _ in rows if known]
    moves = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @lru_cache(None)
    def best(i, last, inserted):
        ways = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        if inserted < 3:
            for role in ("user", "assistant"):
                if role[0] in moves[last]:
                    c, a, out = best(i, role[0], inserted + 1)
                    ways.append((c + 5, "I" + a, (f"{role}:", *out)))
        if i < len(rows):
            role, text = rows[i][2:]
            c, a, out = best(i + 1, last, 0)
            ways.append((c + 2, "D" + a, out))
            if faults[i] not in (1, 2):
                more = 5 if faults[i] == 3 else 0
                for name, letter, cost in ((role, "K", 0), ("user", "R", 1), ("assistant", "R", 1)):
                    if name[:1] and name[:1] in moves[last]:
                        c, a, out = best(i + 1, moves[last][name[:1]], 0)
                        ways.append((c + cost + more, letter + a, (f"{name}:{text}", *out)))
        return min(ways, default=(10**9, "", ()))

    cost, audit, out = best(0, "", 0)
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def report(df):
    found = {r.conv_id: tuple(r)[1:] for r in df.select(*(x.split()[0] for x in conversation_repair._REPORT.split(", "))).collect()}
    assert df.count() == len(found)
    return found


ROWS = st.lists(st.tuples(st.sampled_from("xsua"), st.integers(0, 2)).map(lambda c: ("xsua".index(c[0]), c[1])), max_size=9)


@settings(max_examples=300, deadline=None)
@given(ROWS, st.integers(1, 4))
def test_auction_finds_the_least_of_the_cheapest_audits(codes, block):
    old, conversation_repair.BLOCK = conversation_repair.BLOCK, block
    audit, end = conversation_repair.cheapest(codes, None, (0,))[0]
    table = conversation_repair.distances(codes)
    conversation_repair.BLOCK = old
    names = ["x", "system", "user", "assistant"]
    rows = [(i, names[c], "" if f == 1 else f"t{i}" + ("" if f == 2 else ".")) for i, (c, f) in enumerate(codes)]
    want = plain(rows)
    assert (conversation_repair.edit_cost(audit, codes), audit) == want[5:7] and end in (0, 3)
    through = [d + p for d, p in zip(table[:4], conversation_repair.END_PRICES) if d >= 0]
    assert min(through) == want[5]


@settings(max_examples=100, deadline=None)
@given(ROWS, ROWS)
def test_segment_tables_give_the_prices_behind(left, right):
    whole, _ = conversation_repair.cheapest(left + right, None, (0,))[0]
    table = conversation_repair.distances(right)
    prices = tuple(min(d + p for d, p in zip(table[4 * s : 4 * s + 4], conversation_repair.END_PRICES) if d >= 0) for s in range(4))
    head, state = conversation_repair.cheapest(left, prices, (0, 1, 2, 3))[0]
    tail, _ = conversation_repair.cheapest(right, None, (0, 1, 2, 3))[state]
    assert head + tail == whole


def test_prices_never_exceed_arcs():
    block = conversation_repair.Block([(2, 0), (2, 2), (3, 1), (1, 0)] * 5, None)
    for s in range(4):
        block.auction(s)
    assert all(block.price[n] <= c + block.price[t] for n, arcs in enumerate(block.arcs) for c, _, t in arcs)


def table(spark, convs):
    rows = [(c, *r, "x", True, 1) for c, rs in convs.items() for r in rs]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, said string, whole boolean, seq int").repartition(3)


def conversations():
    long = [(i // 2, ("user", "assistant", "tool", "user")[i * 7 % 4], f"word {i % 50}" + ".!? x"[i % 5]) for i in range(300)]
    return {
        1: [(0, "user", "Hi."), (1, "assistant", "Yes.")],
        2: [(0, "system", "S."), (1, "user", "Q?"), (2, "user", "Q?"), (5, "assistant", "cut")],
        3: [(None, None, None), (None, "user", "a."), (3, "", "b."), (3, "user", "b."), (3, "user", "b.")],
        4: [(0, "assistant", "A."), (1, "system", "S."), (9, "sys", "é" * 100_000)],
        5: long,
        6: [(0, "user", "same.")] * 40,
        None: [(0, "user", ""), (1, "assistant", " \t\n")],
        7: [(i, "user" if i % 2 else "assistant", "x" * 40 + "!") for i in range(200)],
    }


@pytest.mark.parametrize("most", [3, 512])
def test_repair_equals_search(spark, most):
    convs = conversations()
    columns = [F.col(c) for c in ("conv_id", "turn", "role", "text")]
    found = report(conversation_repair.repair(table(spark, convs), *columns, segment_rows=most))
    assert found == {c: plain(rows) for c, rows in convs.items()}


def test_absent_rows_and_empty_table(spark):
    columns = [F.col(c) for c in ("conv_id", "turn", "role", "text")]
    df = table(spark, {1: [(0, "user", "a.")], 2: [(0, "user", "a.")]})
    found = report(conversation_repair.repair(df, *columns, present=F.col("conv_id") == 1))
    assert found == {1: plain([(0, "user", "a.")]), 2: plain([])} and plain([]) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert conversation_repair.repair(df.limit(0), *columns).count() == 0


def test_query_over_whole_table(spark):
    convs: dict = {}
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect():
        say = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{say(r.conv_id)}:{say(r.turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", say(r.text)) if kind == 2 else say(r.text)
        convs.setdefault(r.conv_id, []).extend([(r.turn, "user" if kind == 4 else say(r.role), text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    assert report(catalog.QUERIES["op13_conversation_repair"](spark, SMALL)) == {c: plain(rows) for c, rows in convs.items()}
