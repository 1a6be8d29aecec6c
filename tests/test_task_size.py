"""Tables that are rows x folds x repeats are dealt over tasks that do not grow with them."""

import hashlib

from pyspark.sql import functions as F

from evidencelens.operators import metrics, segments
from evidencelens.plans import logistic as lg


def test_lanes_are_dealt_over_tasks_by_rows(spark, monkeypatch):
    monkeypatch.setattr(segments, "TASK_ROWS", 50)
    monkeypatch.setattr(lg, "LANE_ROWS", 10)
    rows = spark.range(2000).select((F.col("id") % 3).cast("string").alias("gs"), F.lit(0).alias("y"), F.col("id").alias("uid"))
    for mixed in (True, False):
        lanes, _ = lg._dealt(rows, mixed)
        sizes = [r["n"] for r in lanes.groupBy(F.spark_partition_id().alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert lanes.rdd.getNumPartitions() == 40 and sum(sizes) == 2000 and max(sizes) <= 200
        assert lanes.select("lane", F.spark_partition_id().alias("t")).distinct().groupBy("lane").count().agg(F.max("count")).first()[0] == 1


def test_pseudo_groups_with_tasks_are_the_permutation(spark):
    """Groups from one row to several blocks of slots, the features of a row stay with it."""
    rows = [(i, "a" if i < 3 else "b" if i < 900 else "c" if i < 901 else "d", i % 2, i * 0.5) for i in range(1500)]
    df = spark.createDataFrame(rows, "path long, g string, fold long, f1 double")
    got = metrics.pseudo_groups(df, 9, ["fold"], F.explode(F.array(F.lit(0), F.lit(1))), "g", "path", ["f1"], 30, 1)
    seen = {(r["fold"], r["repeat"], r["path"]): r for r in got.collect()}
    assert len(seen) == 3000 and all(r["f1"] == p * 0.5 for (_, _, p), r in seen.items())
    for fold in (0, 1):
        for repeat in (0, 1):
            own = [r for r in rows if r[2] == fold]
            by_hash = sorted(own, key=lambda r: hashlib.sha256(f"9|{fold}|{repeat}|{r[0]}".encode()).hexdigest())
            for r, label in zip(by_hash, sorted(r[1] for r in own)):
                assert seen[fold, repeat, r[0]]["pseudo_group"] == label and seen[fold, repeat, r[0]]["true_group"] == r[1]


def test_digits_keep_segments_small():
    assert [segments.digits_for(n) for n in (0, 131_072, 131_073, 615_000, 10**9)] == [1, 1, 2, 2, 5]


def test_stable_order_is_the_same_over_any_tasks(spark):
    df = spark.createDataFrame([(i, "g" + str(i % 3), i % 2) for i in range(400)], "path long, g string, session long")
    repeat = F.explode(F.array(F.lit(0), F.lit(1)))
    plain, dealt = (metrics.stable_order(df, 4, repeat, ["g"], "session", "path", *more) for more in ((), (25, 1)))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, dealt.select(plain.columns).collect()))
