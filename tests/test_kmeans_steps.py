"""What a pass of the k-means fits costs: rows dealt over all cores, one step in slices."""

import numpy as np
from pyspark.sql import functions as F

from evidencelens.plans import kmeans as km


def test_rows_of_one_file_meet_all_cores(spark):
    df = spark.range(0, 4000, 1, 1).select("id", (F.col("id") * 0.5).alias("f1"))
    x = km.packed(df, "id", ["f1"])
    sizes = [r["n"] for r in x.groupBy(F.spark_partition_id().alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()]
    cores = spark.sparkContext.defaultParallelism
    assert len(sizes) == cores and sum(sizes) == 4000 and max(sizes) < 2 * 4000 / cores


def test_nearest_is_the_first_of_the_least_distances():
    rng = np.random.default_rng(3)
    z, centres = rng.normal(size=(2500, 5)), rng.normal(size=(3, 4, 5))
    centres[1, 2] = centres[1, 0]  # equal centres: the first takes all
    cost, counts, sums = km.nearest(z, centres)
    for f in range(3):
        d = ((z[:, None] - centres[f][None]) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        assert np.isclose(cost[f], d.min(axis=1).sum())
        assert counts[f].tolist() == np.bincount(own, minlength=4).tolist()
        assert np.allclose(sums[f], [z[own == c].sum(axis=0) for c in range(4)])
    assert counts[1, 2] == 0
