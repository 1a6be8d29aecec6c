"""Segmented windows equal plain windows, also when one key holds most rows and times tie."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidencelens.operators.quantiles import exact_quantiles
from evidencelens.operators.segments import adjacent_summary, gap_summary, hash_ranked, previous_row, running, segment_of, with_neighbours


def hot_rows(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows = [(("hot" if rng.random() < 0.7 else rng.choice("abc")), rng.randrange(400), i, rng.randrange(100) if rng.random() < 0.8 else None) for i in range(n)]
    return spark.createDataFrame(rows, "k string, t long, id long, v long")


def test_running_equals_plain_window(spark):
    df = hot_rows(spark)
    order = ["t", "id"]
    for inclusive, end in ((True, 0), (False, -1)):
        w = Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        want = df.select("id", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"), F.max("v").over(w).alias("m"), F.last("v", True).over(w).alias("l"))
        for width in (1, 7, 1000):
            got = running(df, ["k"], segment_of("t", width), order, sums={"s": F.col("v")}, maxes={"m": F.col("v")}, lasts={"l": F.col("v")}, inclusive=inclusive).select("id", "s", "m", "l")
            assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_previous_row_and_hash_rank(spark):
    df = hot_rows(spark)
    w = Window.partitionBy("k").orderBy("t", "id")
    want = df.select("id", F.lag("t").over(w).alias("p"))
    got = previous_row(df, ["k"], segment_of("t", 13), ["t", "id"], F.col("t"), "p").select("id", "p")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    digest = F.sha2(F.col("id").cast("string"), 256)
    want = df.select("id", F.row_number().over(Window.partitionBy("k").orderBy(digest)).cast("long").alias("r"))
    got = hash_ranked(df, ["k"], digest, ["id"], "r").select("id", "r")
    assert got.exceptAll(want).isEmpty()


def test_neighbours_cross_block_edges(spark):
    df = spark.createDataFrame([(1, f, float(f)) for f in range(40) if f not in (7, 16, 17)], "s long, f long, x double")
    got = with_neighbours(df, ["s"], "f", ["x"], block=8).orderBy("f").collect()
    have = {r["f"] for r in got}
    assert len(got) == 37
    for r in got:
        assert (r["prev"] is not None) == (r["f"] - 1 in have)
        assert (r["next"] is not None) == (r["f"] + 1 in have)


def test_adjacent_and_gap_summary(spark):
    rng = random.Random(3)
    frames = sorted(rng.sample(range(500), 200))
    df = spark.createDataFrame([("s", f, rng.randrange(5)) for f in frames], "s string, f long, v long")
    vals = [r["v"] for r in df.orderBy("f").collect()]
    gaps = [b - a - 1 for a, b in zip(frames, frames[1:])]
    for block in (4, 64, 4096):
        g = gap_summary(df, ["s"], "f", block).first()
        assert (g["bounded_gaps"], g["max_gap"], g["bounded_frames"]) == (sum(x > 0 for x in gaps), max(gaps), sum(gaps))
        a = adjacent_summary(df, ["s"], "f", ["v"], pair_sums={"c": lambda p, c: (p["v"] != c["v"]).cast("long")}, block=block).first()
        assert a["c"] == sum(x != y for x, y in zip(vals, vals[1:]))


def test_exact_quantiles_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [("hot", float(x)) for x in rng.exponential(size=4000)] + [("ties", float(x)) for x in rng.integers(0, 3, 999)] + [("one", 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"med": (0.5, "linear"), "lo": (0.025, "linear"), "p95": (0.95, "nearest"), "min": (0.0, "linear"), "max": (1.0, "linear")}
    for accuracy in (100, 10_000):
        got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", probs, accuracy).collect()}
        for k in ("hot", "ties", "one"):
            v = np.array(sorted(x for kk, x in rows if kk == k))
            assert np.isclose(got[k]["med"], np.quantile(v, 0.5)) and np.isclose(got[k]["lo"], np.quantile(v, 0.025))
            assert got[k]["p95"] == v[int(np.ceil(0.95 * len(v))) - 1]
            assert got[k]["min"] == v[0] and got[k]["max"] == v[-1]
