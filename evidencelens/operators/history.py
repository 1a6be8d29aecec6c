"""What was knowable at prediction time: as-of history of episodes within a household.

One timeline per household carries four row kinds, sorted so that ties fall on the right side of
"strictly before" and "at or before": actions (0), probes (1), episodes (2). A single segmented running
pass then answers the previous episode, the latest action per category and the rolling counts, the latter
as the difference of two running counts, so no sliding frame is rescanned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelens.functions import ACTION_KEYWORDS, MISSING_LABEL, SENTINEL
from evidencelens.operators.segments import HOUR_US, running, segment_of

CATEGORIES = tuple(ACTION_KEYWORDS)
# Fields of the current episode that feature rows leave out, and those that every row must name.
EXCLUDED_FIELDS = ("observations", "human_actions", "interventions", "outcomes", "hypotheses", "context.routine")
REQUIRED_EXCLUSIONS = ("human_actions", "interventions", "outcomes", "hypotheses", "context.routine")
WINDOWS_US = {"1h": HOUR_US, "24h": 24 * HOUR_US}


def timeline(
    episodes: DataFrame,
    *,
    household: str = "household_id",
    categories: Sequence[str] = CATEGORIES,
    windows: dict[str, int] = WINDOWS_US,
    segment_us: int = HOUR_US,
) -> DataFrame:
    """Per episode: previous episode struct, latest action struct per category, running counts.

    ``episodes`` has ``event_id, start_us, location, terminated, outcome_us`` and
    ``actions array<struct<category, action_us>>``.
    """
    long = lambda v: F.lit(v).cast("long")
    payload = F.struct("event_id", "start_us", "location", "terminated", "outcome_us")

    def row(t: Column, kind: int, tag: str, with_payload: bool = False, action: Column | None = None) -> Column:
        kind_of = F.lit(kind)
        return F.struct(
            t.cast("long").alias("t"), kind_of.alias("kind"), F.lit(tag).alias("tag"),
            (payload if with_payload else F.when(F.lit(False), payload)).alias("episode"),
            (action["category"] if action is not None else F.lit(None).cast("string")).alias("category"),
            (action["action_us"] if action is not None else F.lit(None).cast("long")).alias("action_us"),
        )

    start = F.col("start_us")
    rows = [row(start, 2, "", with_payload=True), row(start, 1, "now")]
    rows += [row(start - long(width), 1, name) for name, width in windows.items()]
    marks = F.array(*rows)
    if categories:
        marks = F.concat(
            marks,
            F.coalesce(
                F.transform(
                    F.filter("actions", lambda a: a["category"].isin(*categories)),
                    lambda a: row(F.greatest(a["action_us"], start + long(1)), 0, "", action=a),
                ),
                F.slice(marks, 1, 0),  # an absent array has no actions; the episode itself stays
            ),
        )
    events = episodes.select(
        F.col(household).alias("household"), F.col("event_id"), start.alias("at"), F.explode(marks).alias("m")
    ).select("household", "event_id", "at", "m.*")
    lasts = {"previous": F.when(F.col("kind") == 2, F.col("episode"))}
    maxes = {
        f"action_{c}": F.when(
            F.col("category") == c,
            F.struct(F.col("action_us").alias("us"), (-F.col("at")).alias("neg_start"), F.col("event_id").alias("source")),
        )
        for c in categories
    }
    sums = {"earlier": F.when(F.col("kind") == 2, long(1)).otherwise(long(0))} if windows else {}
    ran = running(
        events, ["household"], segment_of("t", segment_us), ["t", "kind", "event_id"],
        sums=sums, maxes=maxes, lasts=lasts,
    )
    probes = ran.where("kind = 1")
    # The few probes of one episode meet again by event; signed running counts give the look-backs.
    own = Window.partitionBy("event_id")
    counts = {
        f"episodes_last_{name}": F.sum(
            F.when(F.col("tag") == "now", F.col("earlier")).when(F.col("tag") == name, -F.col("earlier")).otherwise(long(0))
        ).over(own)
        for name in windows
    }
    probes = probes.withColumns(counts) if counts else probes
    return probes.where("tag = 'now'").select("household", "event_id", F.col("at").alias("start_us"), "previous", *maxes, *counts)


def previous_episode(episodes: DataFrame, household: str = "household_id") -> DataFrame:
    """Latest strictly earlier episode; its termination only if observed by the prediction time."""
    base = episodes.withColumn("actions", F.expr("CAST(NULL AS array<struct<category: string, action_us: bigint>>)"))
    t = timeline(base, household=household, categories=(), windows={})
    return t.select("event_id", *previous_columns())


def previous_columns() -> list[Column]:
    prev = F.col("previous")
    known = F.when(prev["outcome_us"] <= F.col("start_us"), prev["terminated"])
    seconds = (F.col("start_us") - prev["start_us"]) / F.lit(1e6)
    return [
        prev["event_id"].alias("previous_event_id"),
        F.coalesce(prev["location"], F.lit(MISSING_LABEL)).alias("previous_location"),
        F.coalesce(seconds, F.lit(SENTINEL)).alias("seconds_since_previous"),
        prev.isNull().cast("double").alias("seconds_since_previous_missing"),
        F.coalesce(known.cast("double"), F.lit(SENTINEL)).alias("previous_terminated"),
        known.isNull().cast("double").alias("previous_terminated_missing"),
    ]


def action_columns(categories: Sequence[str] = CATEGORIES) -> list[Column]:
    out = []
    for c in categories:
        us = F.col(f"action_{c}")["us"]
        out.append(F.coalesce((F.col("start_us") - us) / F.lit(1e6), F.lit(SENTINEL)).alias(f"seconds_since_{c}"))
        out.append(us.isNull().cast("double").alias(f"seconds_since_{c}_missing"))
    return out


def time_since_action(
    episodes: DataFrame, household: str = "household_id", categories: Sequence[str] = CATEGORIES
) -> DataFrame:
    """Seconds since the latest visible action of each category, with its source episode."""
    t = timeline(episodes, household=household, categories=categories, windows={})
    sources = [F.col(f"action_{c}")["source"].alias(f"{c}_source_event_id") for c in categories]
    return t.select("event_id", *action_columns(categories), *sources)


def rolling_counts(episodes: DataFrame, household: str = "household_id", windows: dict[str, int] = WINDOWS_US) -> DataFrame:
    """Strictly earlier episodes within each look-back (bounds inclusive)."""
    base = episodes.withColumn("actions", F.expr("CAST(NULL AS array<struct<category: string, action_us: bigint>>)"))
    t = timeline(base, household=household, categories=(), windows=windows)
    return t.select("event_id", *[f"episodes_last_{w}" for w in windows])


def history_provenance(t: DataFrame, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """Sorted distinct source ids and the latest source time, from ``timeline`` output."""
    prev = F.col("previous")
    known_us = F.when((prev["outcome_us"] <= F.col("start_us")) & prev["terminated"].isNotNull(), prev["outcome_us"])
    acts = [F.col(f"action_{c}") for c in categories]
    ids = F.array_compact(F.array(prev["event_id"], *[a["source"] for a in acts]))
    latest = F.greatest(prev["start_us"], known_us, *[a["us"] for a in acts])
    return t.withColumns({"source_event_ids": F.array_sort(F.array_distinct(ids)), "max_source_us": latest, "excluded_fields": F.array(*map(F.lit, EXCLUDED_FIELDS))})


def validate_history(df: DataFrame) -> DataFrame:
    """Rows plus ``errors``: no source later than the prediction time, and every lifecycle field named as excluded."""
    late = F.when(F.col("max_source_us") > F.col("start_us"), F.lit("history_after_prediction_time"))
    named = F.coalesce("excluded_fields", F.array().cast("array<string>"))
    unnamed = F.when(F.size(F.array_except(F.array(*map(F.lit, REQUIRED_EXCLUSIONS)), named)) > 0, F.lit("excluded_fields_missing"))
    return df.withColumn("errors", F.array_compact(F.array(unnamed, late)))
