"""Id sets are compared in tasks of bounded size."""

from pyspark.sql import functions as F

from evidencelens.operators import cohorts as co


def test_tasks_grow_with_the_ids(spark):
    """Before, the number of tasks followed the session, whatever the number of ids."""
    ids = spark.range(4000).select((F.col("id") % 3).alias("k"), F.col("id").alias("i"))
    out = co.cohort_equality(ids.union(ids), ids.where("i <> 7").union(spark.sql("SELECT 2L, CAST(NULL AS long)")), ["k"], "i", rows=500)
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().toString() and ", 24)" in out._jdf.queryExecution().toString()
    got = {(r["k"], r["only_a"], r["only_b"], r["equal"]) for r in out.collect()}
    assert got == {(0, 0, 0, True), (1, 1, 0, False), (2, 0, 1, False)}
