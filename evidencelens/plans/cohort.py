"""Cohort manifest and tracker result packets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelens.operators import cohorts, contracts
from evidencelens.operators.contracts import COUNT_METRICS, merge, rule, rules
from evidencelens.session import cut_lineage


def cohort_manifest(docs: DataFrame) -> DataFrame:
    """One row per ablation row: support counts, duplicate ids and the one shared primary cohort digest."""
    # Counts and cohort both read the support flags; written once, the contract rules run once.
    s = cut_lineage(cohorts.event_support(docs).select("episode_id", "b0", "v1", "a1", "target", "conflict", "eligible"))
    counts = cohorts.cohort_support(s)
    dup = lambda c: docs.groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias(f"duplicate_{c}s"))
    primary = cohorts.complete_case(s)
    digest = cohorts.id_set_digest(primary, [], "episode_id").agg(
        F.coalesce(F.max("n_ids"), F.lit(0)).alias("primary_ids"), F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256)).alias("primary_episode_sha256"))
    # Every side below is a single aggregate row.
    one = counts
    for side in (dup("event_id"), dup("episode_id"), digest):
        one = one.crossJoin(F.broadcast(side))
    rows = F.array(*[F.lit(r) for r in cohorts.ABLATION_ROWS])
    return one.select("*", F.explode(rows).alias("row_id"))


def read_single_summary(summary: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Exactly one aggregate row per key; blank is NULL, anything else must be a number."""
    value = lambda c: F.try_cast(F.nullif(F.trim(F.col(c)), F.lit("")), "double") if hasattr(F, "try_cast") else F.expr(f"try_cast(nullif(trim({c}), '') AS double)")
    bad = F.lit(False)
    for m in metrics:
        bad = bad | ((F.trim(F.coalesce(m, F.lit(""))) != "") & value(m).isNull())
    g = summary.withColumn("__bad", bad).groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.bool_or("__bad").alias("__bad"), *[F.max(value(m)).alias(m) for m in metrics])
    # Integral values of count metrics become integers; others stay doubles.
    typed = {m: F.when(F.col(m) == F.floor(m), F.col(m).cast("long")) for m in metrics if m in COUNT_METRICS}
    return g.withColumns(typed) if typed else g


def result_packets(summary: DataFrame, manifests: DataFrame, key: str, metrics: Sequence[str], **frozen) -> DataFrame:
    """Typed metrics with the manifest's and the summary's errors per run."""
    s = read_single_summary(summary, key, metrics)
    entries = F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))])
    j = manifests.join(s, key, "left").withColumn("metrics", entries)
    checked = contracts.validate_run_manifests(j, frozen["system"], frozen["commit"], frozen["strata"], metrics)
    extra = rules(rule("summary_rows_not_one", F.coalesce("__n", F.lit(0)) != 1), rule("metric_not_numeric", F.col("__bad")))
    return checked.withColumn("errors", merge(F.col("errors"), extra)).drop("__n", "__bad", "metrics")
