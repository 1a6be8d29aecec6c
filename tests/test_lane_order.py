"""A pass over kept lanes of rows sorts none of them again."""

import pyarrow as pa
from pyspark.sql import functions as F

from evidencelens.plans import logistic as lg


def test_lanes_stay_sorted(spark):
    rows = spark.range(3000).select((F.col("id") % 3).cast("string").alias("gs"), F.lit(0).alias("y"), F.array(F.col("id").cast("double")).alias("x"), F.col("id").alias("uid"))
    fits = spark.createDataFrame([(str(i),) for i in range(3)], "gs string")
    for mixed in (False, True):
        lanes, index = lg._dealt(rows, mixed)
        lanes = lanes.persist()
        assert lanes.count() == 3000 and ("gs" in lanes.columns) == mixed and "uid" not in lanes.columns
        at = fits.withColumn("lane", F.explode(F.transform(F.sequence(F.lit(0), F.lit(index - 1)), lambda i: i.cast("string")))) if mixed else fits.join(index, "gs")
        out = lanes.groupBy("lane").cogroup(at.groupBy("lane")).applyInArrow(lambda a, b: pa.table({"n": pa.array([a.num_rows], pa.int64())}), "n long")
        step = out._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
        assert "Sort [lane" not in step
        assert sum(r["n"] for r in out.collect()) == 3000
        lanes.unpersist()
