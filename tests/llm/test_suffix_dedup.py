"""Repeated byte strings against brute force over every window."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidencelens.llm import catalog, suffix_dedup
from evidencelens.llm.text import ship
from tests.conftest import SMALL


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def expected(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = Counter()
    for (doc_id, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        kept = bytes(b for i, b in enumerate(t) if not gone[i + 1])
        out[doc_id, len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


def got(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def cases(seed):
    rng = np.random.default_rng(seed)
    word = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 6, n))
    shared = [word(n) for n in (15, 20, 21, 33, 60, 90)]
    rows = [(None, None), (1, ""), (2, "x"), (3, "a" * 19), (4, "a" * 20), (5, "a" * 70), (6, "ab" * 40), (7, shared[4]), (7, shared[4]), (8, "é" * 30), (9, word(200) + "a" * 30)]
    for i in range(60):
        parts = [word(int(rng.integers(0, 40)))]
        for _ in range(int(rng.integers(0, 5))):
            s = shared[int(rng.integers(0, len(shared)))]
            cut = int(rng.integers(0, len(s)))
            parts += [s[: len(s) - cut // 4], word(int(rng.integers(0, 9)))]
        rows.append((100 + i, "".join(parts)))
    near = word(300)
    for i in range(30):
        at = int(rng.integers(0, 300))
        rows.append((200 + i, near[:at] + "Z" + near[at + 1 :]))
    return rows + [(300 + i, near) for i in range(20)]


@pytest.mark.parametrize("length", [1, 2, 20, 50])
def test_removed_bytes_equal_brute_force(spark, length, monkeypatch):
    rows = cases(length)
    df = spark.createDataFrame([(*r, 7, "k", 3) for r in rows], "doc_id long, text string, k1 long, ext string, copies long").repartition(5)
    assert got(suffix_dedup.without_repeats(df, F.col("doc_id"), F.col("text"), length)) == expected(rows, length)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, a long")
    assert suffix_dedup.without_repeats(df, F.col("doc_id"), F.col("text")).count() == 0


def test_production_length_over_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert got(catalog.QUERIES["op11_suffix_dedup"](spark, SMALL)) == expected(rows, 400)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=60), min_size=1, max_size=5), st.sampled_from([4, 12, 16]), st.sampled_from([5, 17, 1000]))
def test_windows_and_anchors(texts, length, piece):
    width = suffix_dedup.widths(length)[0]
    old, suffix_dedup.PIECE = suffix_dedup.PIECE, piece
    joined, ends = "".join(texts).encode(), np.cumsum([len(t) for t in texts])
    found = [(p, a) for a, p0, p1 in suffix_dedup.runs(joined, ends, length, width) for p in range(p0, p1 + 1)]
    suffix_dedup.PIECE = old
    starts = [0, *ends[:-1].tolist()]
    assert [p for p, _ in found] == [p for s, t in zip(starts, texts) for p in range(s, s + len(t) - length + 1)]
    distance: dict = {}
    for p, a in found:  # equal windows hang on their anchors at the same distance
        assert distance.setdefault(joined[p : p + length], a - p) == a - p and 0 <= a - p < width


def test_bound_on_anchors():
    data = np.random.default_rng(3).integers(0, 256, 1 << 16).astype(np.uint8)
    assert len(np.unique(suffix_dedup.anchors(data, 400, 256))) < 3 * len(data) / 256
