"""Repeated ids of a set are found by the sort that makes its digest."""

import hashlib

from pyspark.sql import functions as F

from evidencelens.catalog import cohorts as catalog
from evidencelens.operators import cohorts
from tests.conftest import SMALL


def test_repeated_ids_count_once_and_are_told(spark):
    sets = {"x": [f"id{i}" for i in range(25_000)], "y": ["a"] * 30_000 + ["b"], "z": ["", "q"], None: ["", ""]}
    df = spark.createDataFrame([(k, i) for k, ids in sets.items() for i in ids] + [("x", None), ("w", None)], "k string, id string").repartition(7)
    got = {r["k"]: (r["n_ids"], r["digest"], r["repeated"]) for r in cohorts.id_set_digest(df, ["k"], "id", unique=True).collect()}
    assert got == {k: (len(set(ids)), hashlib.sha256("\n".join(sorted(set(ids))).encode()).hexdigest(), len(set(ids)) < len(ids)) for k, ids in sets.items()}


def test_reports_sort_their_episodes_once(spark):
    """No grouping by episode beside the sort, and declared digests from one set a report."""
    plan = catalog.validate_ablation_reports(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [report_id") + plan.count("RepartitionByExpression [of") == 4
    assert not [x for x in plan.splitlines() if "Aggregate [report_id" in x and "episode_id" in x.split("], [")[0]]


def test_rows_without_an_id_only_count(spark):
    reports, rows, metrics, episodes, *rest = catalog.ablation(spark, SMALL)
    extra = spark.createDataFrame([(5, "BA", None), (6, "V", None), (6, "V", None)], "report_id long, row_id string, episode_id string")
    found = dict(cohorts.validate_ablation_reports(reports, rows, metrics, episodes.unionByName(extra), *rest).where("report_id IN (5, 6)").select("report_id", F.array_join("errors", ";")).collect())
    assert "episodes_empty:BA" not in found[5] and "episodes_repeated:V" in found[6] and "episode_digest_differs:V" not in found[6]
