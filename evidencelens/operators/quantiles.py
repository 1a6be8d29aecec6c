"""Exact quantiles without collecting a group.

Pass 1 keeps one small sketch per group whose rank error is bounded by 1/accuracy, which brackets each
quantile. Pass 2 counts what lies below the bracket (partially aggregated to one row) and keeps
distinct values inside it, about 4/accuracy of the rows, where the exact rank is read off.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, tuple[float, str]],
    accuracy: int = ACCURACY,
    small_keys: bool = False,
) -> DataFrame:
    """``probs`` maps an output name to ``(p, 'linear' | 'nearest')``.

    'linear' interpolates like NumPy; 'nearest' returns the ``ceil(p * n)``-th value. ``small_keys`` states
    that the caller bounds the number of keys, so the bracket table is broadcast.
    """
    keys = list(keys)
    names = list(probs)
    margin = 2.0 / accuracy
    data = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    edges = []
    for name in names:
        p = probs[name][0]
        edges += [max(0.0, p - margin), min(1.0, p + margin)]
    stats = data.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        F.percentile_approx("__v", edges, accuracy).alias("__b"),
        F.min("__v").alias("__lo"),
        F.max("__v").alias("__hi"),
    )
    low = lambda i: F.col("__lo") if edges[2 * i] <= 0.0 else F.col("__b")[2 * i]
    high = lambda i: F.col("__hi") if edges[2 * i + 1] >= 1.0 else F.col("__b")[2 * i + 1]
    if keys:
        joined = data.join(F.broadcast(stats) if small_keys else stats, keys)
    else:
        joined = data.crossJoin(F.broadcast(stats))
    marks = F.array(*[
        F.struct(
            F.lit(i).alias("q"),
            F.when(F.col("__v") < low(i), F.lit(float("-inf"))).when(F.col("__v") <= high(i), F.col("__v")).alias("v"),
        )
        for i in range(len(names))
    ])
    # One row per (key, quantile) for everything below the bracket, one per distinct value inside it.
    counts = (
        joined.select(*keys, "__n", F.explode(F.filter(marks, lambda m: m["v"].isNotNull())).alias("m"))
        .groupBy(*keys, F.col("m.q").alias("q"), F.col("m.v").alias("v"))
        .agg(F.count(F.lit(1)).alias("c"), F.max("__n").alias("n"))
    )
    pos = F.lit(None).cast("double")
    for i, name in enumerate(names):
        p, mode = probs[name]
        at = (F.col("n") - 1) * F.lit(float(p)) if mode == "linear" else F.greatest(
            F.lit(0.0), F.ceil(F.col("n") * F.lit(float(p))).cast("double") - 1.0
        )
        pos = F.when(F.col("q") == i, at).otherwise(pos)
    w = Window.partitionBy(*keys, "q").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    cum = counts.withColumn("e", F.sum("c").over(w)).withColumn("pos", pos)
    start = F.col("e") - F.col("c")
    at_rank = lambda r: F.max(F.when((start <= r) & (r < F.col("e")), F.col("v")))
    picked = (
        cum.groupBy(*keys, "q")
        .agg(
            at_rank(F.floor("pos")).alias("a"),
            at_rank(F.ceil("pos")).alias("b"),
            F.max(F.col("pos") - F.floor("pos")).alias("f"),
        )
        .withColumn(
            "x",
            F.when(
                F.col("a").isNull() | F.col("b").isNull() | (F.col("a") == float("-inf")),
                F.raise_error(F.lit("quantile fell outside its bracket")).cast("double"),
            ).otherwise(F.when(F.col("f") == 0, F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("f"))),
        )
    )
    outs = [F.max(F.when(F.col("q") == i, F.col("x"))).alias(name) for i, name in enumerate(names)]
    return picked.groupBy(*keys).agg(*outs)
