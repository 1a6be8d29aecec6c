"""Leakage-audited feature row per episode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelens.functions import cyclic_hour, keyword_category, local_hour
from evidencelens.operators import context, history
from evidencelens.session import materialise


def history_feature_rows(docs: DataFrame, household: str = "household_id") -> DataFrame:
    """Context snapshot, cyclic hour and as-of history for every episode document.

    The outcome and action arrays of the current episode only feed the timeline (where they become
    visible to later episodes) and the target; they never reach the feature columns.
    """
    value, observed, _ = context.termination_before()
    actions = F.transform(
        "human_actions",
        lambda a: F.struct(keyword_category(a["action_type"]).alias("category"),
                           (F.col("start_us") + a["offset_ms"].cast("long") * 1000).alias("action_us")),
    )
    sine, cosine = cyclic_hour(local_hour("start_time"))
    features = {**context.context_features(), "local_hour_sin": sine, "local_hour_cos": cosine}
    # The documents are read and their expressions evaluated once; the timeline and the rows each scan their columns of the result.
    rows = materialise(docs.select(
        "event_id", household, "start_us", F.coalesce("location", F.lit("__missing__")).alias("location"), value.alias("target_terminated"),
        observed.alias("outcome_us"), actions.alias("actions"), *[c.alias(k) for k, c in features.items()]), "history-rows")
    slim = rows.withColumnRenamed("target_terminated", "terminated").select("event_id", household, "start_us", "location", "terminated", "outcome_us", "actions")
    timeline = history.history_provenance(history.timeline(slim, household=household))
    past = timeline.select(
        "event_id", *history.action_columns(), "episodes_last_1h", "episodes_last_24h",
        *[c for c in history.previous_columns()][1:], "source_event_ids", "max_source_us", "excluded_fields",
    )
    now = rows.select("event_id", household, "start_us", "target_terminated", *features)
    return now.join(past, "event_id")
