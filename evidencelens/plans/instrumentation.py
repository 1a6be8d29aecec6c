"""Instrumentation audit over episode documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelens.operators import clusters, context, contracts
from evidencelens.session import materialise


def audit_rows(docs: DataFrame, household: str = "household_id") -> DataFrame:
    """Five short columns per document: ids, start, validity, outcome."""
    value, _, _ = context.termination_before()
    checked = contracts.with_capture_errors(docs.select("*", value.alias("y")))
    return checked.select("event_id", household, "start_us", (F.size("errors") == 0).alias("ok"), "y")


def instrumentation_report(docs: DataFrame, household: str = "household_id") -> DataFrame:
    """One row per household. The short rows feed several passes and are written once, so the contract rules run once."""
    return clusters.instrumentation_audit(materialise(audit_rows(docs, household), "audit"), household, "start_us", "event_id", "y", "ok")
