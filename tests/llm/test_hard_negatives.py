"""Hard negatives against brute force in Python integers."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evidencelens.compare import TABLES, compare_query
from evidencelens.llm import catalog, hard_negatives
from evidencelens.llm.text import ship
from tests.conftest import SMALL


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def expected(rows, anchors, positives=5, negatives=5):
    use = [(i if i is not None else 1 << 64, lab, [math.floor(256 * x) for x in v], n) for n, (i, lab, v) in enumerate(rows) if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2]))
    shown = lambda i: None if i == 1 << 64 else i
    out = Counter()
    for a in use:
        if a[0] == 1 << 64 or a[0] % anchors:
            continue
        order = sorted(((-score(a, b), b[0], b[3], b[1] == a[1]) for b in use if b is not a))
        for s, i, _, _ in [o for o in order if o[3]][:positives]:
            fits = [o for o in order if not o[3] and 80 * -s <= 100 * -o[0] <= 100 * -s][:negatives]
            for rank, o in enumerate(fits, 1):
                out[shown(a[0]), shown(i), rank, shown(o[1]), -s, -o[0]] += 1
    return out


def got(df):
    return Counter(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def run(spark, rows, anchors):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, label int, embedding array<double>, tree string, rank int, uid long").repartition(3)
    return got(hard_negatives.mine(df, F.col("vec_id"), F.col("label"), F.col("embedding"), F.col("vec_id") % anchors == 0))


def test_nulls_ties_repeats_and_hot_vectors(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "TREE", 16)
    monkeypatch.setattr(hard_negatives, "BLOCK", 8)
    monkeypatch.setattr(hard_negatives, "LANES", 3)
    monkeypatch.setattr(hard_negatives, "CELLS", 4)
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(0, 4)), rng.normal(0, 1, 6).round(1).tolist()) for i in range(150)]
    rows += [(1000 + i, i % 3, [0.5, 0.5, 0.0, 0.0, 0.0, 0.1]) for i in range(90)]  # one common vector
    rows += [(10, 1, [1.0] * 6), (10, 1, [1.0] * 6), (20, 2, [0.1, 0.2]), (None, 1, [1.0] * 6), (None, 2, [1.0] * 6)]
    rows += [(30, None, [1.0]), (40, 1, None), (50, 1, [1.0, None]), (60, 1, [float("nan")]), (70, 1, [float("inf")]), (80, 1, []), (90, 3, [0.0] * 6), (-10, 1, [-1.0] * 6)]
    assert run(spark, rows, 10) == expected(rows, 10)


def test_clusters_use_the_bounds(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 3, (20, 8))
    rows = [(i, i % 2, (centres[i % 20] + rng.normal(0, 0.05, 8)).tolist()) for i in range(1200)]
    assert run(spark, rows, 100) == expected(rows, 100)


def test_cover_tree_invariants_and_pruning():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 900, (30, 8))
    vectors = np.floor(centres[rng.integers(0, 30, 1000)] + rng.normal(0, 5, (1000, 8))).astype(np.int64)
    top = float((vectors.astype(float) ** 2).sum(axis=1).max())
    n = np.arange(1000)
    tree = hard_negatives.CoverTree(vectors, n, n, n % 2, top)
    points = hard_negatives.augmented(vectors, top)
    assert np.allclose((points**2).sum(axis=1), top)

    def below(node):
        return tree.leaves[node].tolist() + [p for c in tree.children[node] for p in below(c)]

    assert sorted(below(0)) == n.tolist()
    for node in range(len(tree.centre)):
        away = np.linalg.norm(points[below(node)] - points[tree.centre[node]], axis=1)
        assert away.max() <= tree.radius[node] + 1e-6
        for c in tree.children[node]:
            assert tree.radius[c] < tree.radius[node]
        own = [tree.centre[c] for c in tree.children[node]] + tree.leaves[node].tolist()
        if tree.radius[node] and len(own) > 1:  # separated at half the scale
            scale = 2.0 ** np.floor(np.log2(tree.radius[node])) / (2 if np.log2(tree.radius[node]) % 1 == 0 else 1)
            gaps = np.linalg.norm(points[own][:, None] - points[own][None, :], axis=2) + 1e9 * np.eye(len(own))
            assert gaps.min() > scale - 1e-6
    asked = hard_negatives.Queries(vectors[:4], n[:4], n[:4] % 2, np.arange(4), np.full(4, -(1 << 62)), np.full(4, 1 << 62), True, 5, top)
    scored = []
    asked.score = lambda t, points, q, old=asked.score: (scored.append(len(points) * len(q)), old(t, points, q))
    asked.descend(tree)
    assert sum(scored) < 0.5 * 4 * 1000
    score = (vectors[:4] @ vectors.T).astype(float)
    for q in range(4):
        order = [i for i in np.lexsort((n, -score[q])) if i % 2 == q % 2 and i != q][:5]
        assert asked.found[3][asked.found[0] == q].tolist() == order


def test_huge_components_stay_exact(spark):
    rows = [(0, 1, [1e10, 1.0]), (1, 1, [1e3, 2.0]), (2, 2, [1e3, 1.5]), (3, 2, [900.0, 1.0]), (4, 2, [-1e10, 0.0])]
    assert run(spark, rows, 100) == expected(rows, 100)


def test_empty_and_without_anchors(spark):
    rows = [(1, 1, [1.0]), (2, 2, [1.0])]
    assert run(spark, rows, 100) == Counter() == run(spark, [(0, None, [1.0])], 100)


def test_query_over_whole_table(spark):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    assert compare_query(spark, duck, catalog.QUERIES["op12_hard_negatives"], catalog.SQL["op12_hard_negatives"], SMALL).startswith("ok")
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert got(catalog.QUERIES["op12_hard_negatives"](spark, SMALL)) == expected(rows, 100)
