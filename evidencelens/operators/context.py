"""Context, outcome and evidence-window expressions over nested episode documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelens.functions import MISSING_LABEL, SENTINEL, is_sha256, keyword_flags

# The outcome horizon and the evidence cutoff of the contracts.
HORIZON_MS = 60_000
CUTOFF_MS = 5_000
# Columns of the current episode that may never become predictors.
EXCLUDED = ("observations", "human_actions", "interventions", "outcomes", "hypotheses", "routine")


def predictors_only(df: DataFrame) -> DataFrame:
    """Drops the lifecycle columns before any feature is assembled."""
    return df.drop(*[c for c in df.columns if c in EXCLUDED])


def context_features(objects: str = "objects", social: str = "social", location: str = "location",
                     peer_type: str = "peer") -> dict[str, Column]:
    flags = lambda o: keyword_flags(F.concat_ws(" ", o["object_type"], o["object_id"]))
    any_object = lambda test: F.coalesce(F.exists(objects, test), F.lit(False)).cast("double")
    sized = lambda items: F.coalesce(F.size(items), F.lit(0)).cast("double")  # noqa: E731 an absent array has no elements
    count = lambda kind: sized(F.filter(social, lambda s: s["entity_type"] == kind))
    nearest = F.array_min(F.transform(
        F.filter(social, lambda s: (s["entity_type"] == "human") & s["distance_m"].isNotNull()),
        lambda s: s["distance_m"],
    ))
    return {
        "location_value": F.coalesce(F.nullif(F.col(location), F.lit("")), F.lit(MISSING_LABEL)),
        "n_objects": sized(F.col(objects)),
        "n_humans": count("human"),
        "n_peers": count(peer_type),
        "nearest_human_m": F.coalesce(nearest, F.lit(SENTINEL)),
        "nearest_human_m_missing": nearest.isNull().cast("double"),
        "door_present": any_object(lambda o: flags(o)["door"]),
        "door_open": any_object(lambda o: flags(o)["door"] & o["open"]),
        "door_closed": any_object(lambda o: flags(o)["door"] & ~o["open"]),
        "toy_present": any_object(lambda o: flags(o)["toy"]),
        "food_area_present": any_object(lambda o: flags(o)["food_area"]),
    }


def _boolean_outcomes(outcomes: str, kind: str) -> Column:
    return F.filter(outcomes, lambda o: (o["outcome_type"] == kind) & o["signalling_terminated"].isNotNull())


def termination_label(outcomes: str = "outcomes", horizon_ms: int = HORIZON_MS,
                      kind: str = "signalling_termination") -> tuple[Column, Column]:
    """(label, errors): end offset decides, late outcomes are errors, early ``false`` is refused."""
    stamped = F.transform(
        _boolean_outcomes(outcomes, kind),
        lambda o: F.struct(o["signalling_terminated"].alias("v"), F.coalesce(o["end_offset_ms"], o["start_offset_ms"]).alias("t")),
    )
    kept = F.filter(stamped, lambda s: s["t"] <= horizon_ms)
    values = F.array_distinct(F.transform(kept, lambda s: s["v"]))
    early = (F.size(values) == 1) & ~values[0] & (F.array_max(F.transform(kept, lambda s: s["t"])) < horizon_ms)
    label = F.when((F.size(values) == 1) & ~early, F.get(values, F.lit(0)))
    errors = F.array_compact(F.array(
        F.when(F.exists(stamped, lambda s: s["t"] > horizon_ms), F.lit("outcome_after_horizon")),
        F.when(F.size(values) > 1, F.lit("contradictory_outcomes")),
        F.when(early, F.lit("false_before_horizon")),
    ))
    return label, errors


def termination_before(start_us: str = "start_us", outcomes: str = "outcomes", cutoff: Column | None = None,
                       kind: str = "signalling_termination") -> tuple[Column, Column, Column]:
    """(value, latest observation time, contradictory flag): start offset decides, cutoff optional."""
    stamped = F.transform(
        _boolean_outcomes(outcomes, kind),
        lambda o: F.struct(o["signalling_terminated"].alias("v"),
                           (F.col(start_us) + o["start_offset_ms"].cast("long") * 1000).alias("t")),
    )
    if cutoff is not None:
        stamped = F.filter(stamped, lambda s: s["t"] <= cutoff)
    values = F.array_distinct(F.transform(stamped, lambda s: s["v"]))
    latest = F.when(F.size(values) == 1, F.array_max(F.transform(stamped, lambda s: s["t"])))
    return F.when(F.size(values) == 1, F.get(values, F.lit(0))), latest, F.coalesce(F.size(values) > 1, F.lit(False))


def outcome_state(finalized: Column, outcomes: str = "outcomes") -> Column:
    first = F.get(F.col(outcomes), F.lit(0))
    return (
        F.when(~finalized | first.isNull(), F.lit("open"))
        .when(first["outcome_type"] == "signalling_termination",
              F.when(F.coalesce(first["signalling_terminated"], F.lit(False)), F.lit("terminated")).otherwise(F.lit("continued")))
        .when(first["outcome_type"] == "unknown", F.lit("unknown"))
        .otherwise(F.lit("other"))
    )


def provenance_valid(o: Column, schema_ref: str = "pose-package-v1", sidecar_version: str = "v0", package_version: str = "v0",
                     kind: str = "pose_features_json") -> Column:
    """All-of predicate on one observation: markers, digests, identity with the event, window and counts.

    Event columns: event_id, episode_id, subject_id.
    """
    digests = [is_sha256(o[c]) for c in ("artifact_sha256", "reservation_sha256", "sealed_record_sha256", "producer_sha256")]
    ok = (
        (o["schema_ref"] == schema_ref) & (o["sidecar_version"] == sidecar_version) & (o["artifact_kind"] == kind) & ~o["local_path_included"]
        & digests[0] & digests[1] & digests[2] & digests[3]
        & (o["package_version"] == package_version) & (o["package_event"] == F.col("event_id")) & (o["package_episode"] == F.col("episode_id"))
        & (o["package_subject"] == F.col("subject_id")) & (o["package_sequence"] != "")
        & (o["window_start_ms"] == o["start_offset_ms"]) & (o["window_end_ms"] == o["end_offset_ms"])
        & (o["observation_count"] >= 1) & (o["sample_count"] >= 1) & (o["source_media_count"] >= 1)
    )
    return F.coalesce(ok, F.lit(False))


def evidence_window(modality: str, *, observations: str = "observations", cutoff_ms: int = CUTOFF_MS,
                    checked: bool = False) -> dict[str, Column]:
    """Sorted observation refs split into eligible, late and invalid-provenance."""
    own = F.filter(observations, lambda o: o["modality"] == modality)
    none = F.array().cast("array<string>")
    refs = lambda test: F.coalesce(F.array_sort(F.transform(F.filter(own, test), lambda o: o["observation_ref"])), none)
    late = lambda o: o["end_offset_ms"] > cutoff_ms
    good = (lambda o: provenance_valid(o)) if checked else (lambda o: F.lit(True))
    return {
        "eligible": refs(lambda o: ~late(o) & good(o)),
        "late": refs(late),
        "invalid": refs(lambda o: ~late(o) & ~good(o)),
    }


def snapshot_context(df: DataFrame, fields: Sequence[str] = ("location",), *, modality: str = "object_environment") -> DataFrame:
    """Top-level context fields replaced by the one time-zero snapshot observation; routine dropped.

    Without exactly one snapshot at offset 0 the fields are NULL and ``errors`` says so.
    """
    staged = df.withColumn("__shots", F.filter("observations", lambda o: o["modality"] == modality))
    one = F.when(F.size("__shots") == 1, F.col("__shots")[0])
    staged = staged.withColumn("__shot", F.when((one["start_offset_ms"] == 0) & (one["end_offset_ms"] >= 0), one))
    shot = F.col("__shot")
    errors = F.array_compact(F.array(F.when(shot.isNull(), F.lit("no_single_snapshot_at_zero"))))
    out = staged.withColumns({**{f: shot[f] for f in fields}, "snapshot_ref": shot["observation_ref"], "errors": errors})
    return out.drop("routine", "__shots", "__shot")


def redistribution_gate(kind: Column, redistribution: Column) -> tuple[Column, Column]:
    """(admitted, reason)."""
    bad_kind = ~F.coalesce(kind.isin("owned", "redistributable", "synthetic"), F.lit(False))
    bad_terms = ~F.coalesce(redistribution.isin("allowed", "not_applicable"), F.lit(False))
    reason = F.when(bad_kind, F.lit("source_kind_not_admitted")).when(bad_terms, F.lit("redistribution_not_allowed"))
    return reason.isNull(), reason
