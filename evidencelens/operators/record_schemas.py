"""The declared records: episodes and prospective plans. Field names, enumerations and bounds of the contracts."""

from __future__ import annotations

from evidencelens.functions import iso_micros
from evidencelens.operators.contracts import MODALITIES
from evidencelens.operators.schemas import Flag, Free, Items, Number, Record, Text, When

NAME = Text(min_length=1)
ANY = Text()
OFFSET = Number(low=0, integer=True)
NAMES = Items(NAME)
UNIQUE_NAMES = Items(NAME, unique=True)
MODALITY = Text(enum=MODALITIES)
STAMP = Text(bad=lambda v: iso_micros(v).isNull(), keyword="format")

EPISODE = Record(
    {
        "schema_version": Text(const="0.1.0"), "event_id": NAME, "episode_id": NAME, "subject_id": NAME, "household_id": NAME, "session_id": NAME,
        "time": Record(
            {"start_time": STAMP, "end_time": STAMP, "start_offset_ms": OFFSET, "end_offset_ms": OFFSET, "clock_source": NAME, "uncertainty_ms": Number(low=0)},
            ("start_time", "end_time", "start_offset_ms", "end_offset_ms")),
        "observations": Items(Record(
            {"observation_ref": NAME, "modality": MODALITY, "schema_ref": NAME, "record_ids": Items(NAME, min_items=1), "source_uri": ANY, "start_offset_ms": OFFSET, "end_offset_ms": OFFSET,
             "features": Free(), "uncertainty": Free()},
            ("observation_ref", "modality", "schema_ref", "record_ids", "start_offset_ms", "end_offset_ms")), min_items=1),
        "hypotheses": Items(Record(
            {"hypothesis_id": NAME, "kind": Text(enum=("human_label", "latent_state", "unknown")), "label": NAME, "state_ref": NAME, "probability": Number(0, 1),
             "source": Text(enum=("prior", "model", "human", "derived")), "calibration_model": ANY, "evidence_refs": UNIQUE_NAMES},
            ("hypothesis_id", "kind", "probability", "source"),
            (When("kind", "human_label", require=("label",)), When("kind", "latent_state", require=("state_ref",)), When("kind", "unknown", forbid=("label", "state_ref")))), min_items=1),
        "human_actions": Items(Record(
            {"action_id": NAME, "action_type": NAME, "offset_ms": OFFSET, "actor_id": ANY, "target_id": ANY, "parameters": Free()}, ("action_id", "action_type", "offset_ms"))),
        "interventions": Items(Record(
            {"intervention_id": NAME, "action_ref": NAME, "candidate_hypotheses": Items(NAME, min_items=2, unique=True),
             "predictions": Items(Record({"hypothesis_ref": NAME, "expected_response": NAME, "response_window_ms": OFFSET}, ("hypothesis_ref", "expected_response")), min_items=2),
             "selection_policy": ANY, "safety_class": Text(const="ordinary_low_risk_household_action")},
            ("intervention_id", "action_ref", "candidate_hypotheses", "predictions", "safety_class"))),
        "outcomes": Items(Record(
            {"outcome_id": NAME, "outcome_type": Text(enum=("immediate_response", "signalling_termination", "delayed_outcome", "no_observable_change", "contradictory", "unknown")),
             "start_offset_ms": OFFSET, "end_offset_ms": OFFSET, "observation_source": Text(enum=("direct_observation", "sensor", "human_annotation", "derived")), "description": ANY,
             "supports_hypotheses": UNIQUE_NAMES, "contradicts_hypotheses": UNIQUE_NAMES, "signalling_terminated": Flag()},
            ("outcome_id", "outcome_type", "start_offset_ms", "observation_source"))),
        "context": Record(
            {"location": ANY,
             "objects": Items(Record({"object_id": NAME, "object_type": NAME, "state": Free(), "relation_to_subject": ANY}, ("object_id", "object_type"))),
             "social": Items(Record(
                 {"entity_id": NAME, "entity_type": Text(enum=("human", "cat", "other_animal", "unknown")), "relationship": ANY, "distance_m": Number(low=0), "orientation": ANY},
                 ("entity_id", "entity_type"))),
             "environment": Free(), "routine": Free()},
            ("objects", "social")),
        "missing_modalities": Items(MODALITY, unique=True),
        "uncertainty": Record({"episode_confidence": Number(0, 1), "notes": ANY}),
        "provenance": Record(
            {"source_ids": Items(NAME, min_items=1, unique=True), "lineage": Items(NAME, min_items=1),
             "annotation_source": Text(enum=("observed", "human_annotated", "model_inferred", "synthetic", "derived", "mixed")), "annotator_ids": UNIQUE_NAMES, "software_versions": Free()},
            ("source_ids", "lineage", "annotation_source")),
        "privacy": Record(
            {"data_class": Text(enum=("synthetic", "public", "consented_research", "private_household")), "consent_status": Text(enum=("not_applicable", "recorded", "pending", "restricted")),
             "consent_record_id": ANY, "retention_policy": ANY, "contains_human_audio": Flag(), "contains_human_image": Flag()},
            ("data_class", "consent_status")),
        "notes": ANY,
    },
    ("schema_version", "event_id", "subject_id", "household_id", "session_id", "episode_id", "time", "observations", "context", "hypotheses", "human_actions", "interventions", "outcomes",
     "missing_modalities", "provenance", "privacy"),
)

PLAN = Record(
    {
        "plan_version": Text(const="0.1.0"), "plan_id": NAME, "event_id": NAME, "phase": Text(enum=("I1.0", "I1.1", "I1.2")), "recorded_offset_ms": OFFSET,
        "selection_policy": Text(enum=("naturalistic", "balanced_safe_schedule", "randomized_safe_set", "expected_information_gain")),
        "action": Record(
            {"action_id": NAME,
             "action_type": Text(enum=("offer_social_contact", "present_toy", "open_permitted_access", "interact_relevant_object", "continue_due_feeding_routine", "brief_no_action_observation")),
             "scheduled_offset_ms": OFFSET, "parameters": Free()},
            ("action_id", "action_type", "scheduled_offset_ms", "parameters")),
        "hypotheses": Items(Record(
            {"hypothesis_id": NAME, "kind": Text(enum=("access_location", "social_contact", "play_engagement", "routine_food_related", "object_interest", "latent_state", "unknown")),
             "state_ref": NAME, "probability": Number(0, 1)},
            ("hypothesis_id", "kind", "probability"), (When("kind", "latent_state", require=("state_ref",)),)), min_items=2),
        "predictions": Items(Record(
            {"hypothesis_ref": NAME,
             "observables": Items(Record(
                 {"observable": Text(enum=("approach_withdrawal", "target_orientation", "threshold_crossed", "social_contact_engagement", "toy_engagement", "object_engagement", "vocalisation_continuation",
                                           "signalling_termination", "location_transition")),
                  "window": Text(enum=("immediate_0_5s", "short_5_30s", "episode_30_60s", "declared_delayed")), "expectation": NAME, "probability": Number(0, 1)},
                 ("observable", "window", "expectation")), min_items=1)},
            ("hypothesis_ref", "observables")), min_items=2),
        "safety": Record(
            {"eligible": Flag(const=True), "safety_class": Text(const="ordinary_low_risk_household_action"), "stop_conditions_acknowledged": Flag(const=True), "necessary_care_pending": Flag(), "notes": ANY},
            ("eligible", "safety_class", "stop_conditions_acknowledged")),
    },
    ("plan_version", "plan_id", "event_id", "phase", "recorded_offset_ms", "action", "hypotheses", "predictions", "safety"),
)
