"""Contracts: every validator adds ``errors array<string>`` (sorted, distinct) to its rows.

A rule is a pair of code and condition; item rules add the item reference to the code. All rules of a
record are row-local expressions, so validation is one projection on the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelens.functions import is_sha256, iso_micros

# Enumerations and tokens of the contracts.
MODALITIES = (
    "visual_pose", "visual_microstate", "audio_vocalisation", "audio_environment", "object_environment", "temporal_routine", "social_proxemic", "physiology", "human_input",
    "intervention", "outcome", "other",
)
EPISODE_ARRAYS = ("observations", "hypotheses", "human_actions", "interventions", "outcomes", "missing_modalities")
NON_EMPTY_ARRAYS = ("observations", "hypotheses")
NON_EMPTY_IDS = ("event_id", "episode_id", "subject_id", "household_id")
ALLOWED_CLASSES = ("surface_landmark", "surface_curve", "derived_temporal")
PROSPECTIVE_TIERS = ("G2", "G3", "S1", "S2")
FORBIDDEN_FIT_TOKENS = (
    "intent", "hypothesis", "translation", "outcome", "label", "termination", "future", "post_horizon", "post-horizon",
    "intervention_response", "response_after",
)
ARTIFACT_KINDS = {"visual_pose": "pose_features_json", "audio_vocalisation": "audio_wav"}
COUNT_METRICS = ("idsw", "frag", "objects_recovered_reference")


def rule(code: str, condition: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(code))


def rules(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def item_rule(items: Column | str, code: str, ref: Callable[[Column], Column], bad: Callable[[Column], Column]) -> Column:
    """``code:ref`` for every array element where ``bad`` holds."""
    hits = F.filter(items, lambda x: F.coalesce(bad(x), F.lit(False)))
    return listed(F.transform(hits, lambda x: F.concat_ws(":", F.lit(code), ref(x))))


def listed(strings: Column) -> Column:
    """An absent array of strings as an empty one."""
    return F.coalesce(strings, F.array().cast("array<string>"))


def not_unique(items: Column | str, key: Callable[[Column], Column]) -> Column:
    ids = F.transform(items, key)
    return F.size(F.array_distinct(ids)) < F.size(ids)


def merge(*parts: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.array(*parts))))


def require_valid(df: DataFrame) -> DataFrame:
    """Fails the job at the first row that carries an error."""
    message = F.concat(F.lit("contract violated: "), F.array_join("errors", ", "))
    return df.withColumn("errors", F.when(F.size("errors") > 0, F.raise_error(message).cast("array<string>")).otherwise(F.col("errors")))


# ---- episodes ------------------------------------------------------------------------------------


def with_episode_errors(docs: DataFrame, name: str = "errors") -> DataFrame:
    """Structure first; a structural failure suppresses the deeper rules.

    Parsed times, id lists and structure errors are columns of their own, so each is evaluated once.
    """
    end = F.col("end_offset_ms")
    hyp, acts = F.col("__hyp"), F.col("__acts")
    staged = docs.withColumns({
        "__t0": iso_micros("start_time"), "__t1": iso_micros("end_time"), "__hyp": listed(F.transform("hypotheses", lambda h: h["hypothesis_id"])),
        "__acts": listed(F.transform("human_actions", lambda a: a["action_id"]))})
    staged = staged.withColumn("__structure", rules(
        rule("event_id_missing", F.col("event_id").isNull()), *[rule(f"missing:{c}", F.col(c).isNull()) for c in (*NON_EMPTY_IDS[1:], *EPISODE_ARRAYS)], *[rule(f"empty:{c}", F.size(c) == 0) for c in NON_EMPTY_ARRAYS],
        *[rule(f"empty:{c}", F.col(c).cast("string") == "") for c in NON_EMPTY_IDS], rule("offset_negative", F.exists("observations", lambda o: o["start_offset_ms"] < 0)), rule("modality_unknown", F.exists("observations", lambda o: ~o["modality"].isin(*MODALITIES))),
        rule("probability_out_of_range", F.exists("hypotheses", lambda h: ~F.isnan(h["probability"]) & ((h["probability"] < 0) | (h["probability"] > 1)))), rule("schema_version", ~F.col("schema_version").eqNullSafe(F.lit("0.1.0"))), rule("time_malformed", F.col("__t0").isNull() | F.col("__t1").isNull())))
    unique = lambda ids: F.size(F.array_distinct(ids)) < F.size(ids)
    deeper = merge(
        rules(rule("time_end_before_start", F.col("__t1") < F.col("__t0")), rule("offsets_reversed", end < 0), rule("hypothesis_ids_not_unique", unique(hyp)),
              rule("action_ids_not_unique", unique(acts)), rule("intervention_ids_not_unique", not_unique("interventions", lambda i: i["intervention_id"])),
              rule("outcome_ids_not_unique", not_unique("outcomes", lambda o: o["outcome_id"]))),
        item_rule("observations", "observation_reversed", lambda o: o["observation_ref"], lambda o: o["end_offset_ms"] < o["start_offset_ms"]),
        item_rule("observations", "observation_after_episode", lambda o: o["observation_ref"], lambda o: o["end_offset_ms"] > end),
        item_rule("hypotheses", "probability_not_finite", lambda h: h["hypothesis_id"], lambda h: F.isnan(h["probability"]) | (F.abs(h["probability"]) == float("inf"))),
        item_rule("interventions", "action_unknown", lambda i: i["intervention_id"], lambda i: ~F.array_contains(acts, i["action_ref"])),
        item_rule("interventions", "candidate_unknown", lambda i: i["intervention_id"], lambda i: F.size(F.array_except(listed(i["candidates"]), hyp)) > 0),
        item_rule("interventions", "prediction_not_candidate", lambda i: i["intervention_id"], lambda i: F.size(F.array_except(listed(i["predictions"]), listed(i["candidates"]))) > 0),
        item_rule("interventions", "candidate_without_prediction", lambda i: i["intervention_id"], lambda i: F.size(F.array_except(listed(i["candidates"]), listed(i["predictions"]))) > 0),
        item_rule("outcomes", "outcome_reversed", lambda o: o["outcome_id"], lambda o: o["end_offset_ms"] < o["start_offset_ms"]),
        item_rule("outcomes", "outcome_after_episode", lambda o: o["outcome_id"], lambda o: F.coalesce(o["end_offset_ms"], o["start_offset_ms"]) > end),
        item_rule("outcomes", "outcome_hypothesis_unknown", lambda o: o["outcome_id"], lambda o: F.size(F.array_except(o["supports"], hyp)) > 0),
    )
    errors = F.when(F.size("__structure") > 0, F.array_sort("__structure")).otherwise(deeper)
    return staged.withColumn(name, errors).drop("__t0", "__t1", "__hyp", "__acts", "__structure")


def validate_episodes(docs: DataFrame) -> DataFrame:
    return with_episode_errors(docs)


def with_capture_errors(docs: DataFrame, name: str = "errors", modality: str = "object_environment", fields: Sequence[str] = ("location",)) -> DataFrame:
    """Episode rules plus exactly one time-zero snapshot that equals the context field by field."""
    staged = with_episode_errors(docs, "__episode").withColumn("__shots", F.filter("observations", lambda o: o["modality"] == modality))
    staged = staged.withColumn("__shot", F.when(F.size("__shots") == 1, F.get("__shots", F.lit(0))))
    shot = F.col("__shot")
    own = rules(
        rule("captured_at_differs", shot["captured_us"] != F.col("start_us")), rule("snapshot_count_not_one", shot.isNull()),
        *[rule(f"snapshot_{f}_differs", shot.isNotNull() & ~shot[f].eqNullSafe(F.col(f))) for f in sorted(fields)],
        rule("snapshot_not_at_zero", (shot["start_offset_ms"] != 0) | (shot["end_offset_ms"] != 0)))
    return staged.withColumn(name, F.array_sort(F.concat("__episode", own))).drop("__episode", "__shots", "__shot")


def validate_capture(docs: DataFrame) -> DataFrame:
    return with_capture_errors(docs)


def validate_plans(plans: DataFrame) -> DataFrame:
    """Prospective plans: order in time, probabilities, one prediction per hypothesis, action and policy rules."""
    ids = listed(F.transform("hypotheses", lambda h: h["hypothesis_id"]))
    total = F.aggregate("hypotheses", F.lit(0.0), lambda a, h: a + h["probability"])
    brief = F.col("action_type") == "brief_no_action_observation"
    return plans.withColumn("errors", merge(rules(
        *[rule(f"missing:{c}", F.col(c).isNull()) for c in ("hypotheses", "predictions")],
        rule("recorded_after_action", F.col("recorded_offset_ms") >= F.col("scheduled_offset_ms")),
        rule("hypothesis_ids_not_unique", not_unique("hypotheses", lambda h: h["hypothesis_id"])),
        rule("probabilities_do_not_sum_to_one", F.abs(total - 1.0) > 1e-6),
        rule("prediction_unknown", F.size(F.array_except(listed(F.col("predictions")), ids)) > 0),
        rule("prediction_missing", F.size(F.array_except(ids, listed(F.col("predictions")))) > 0),
        rule("prediction_repeated", F.size(F.array_distinct("predictions")) < F.size("predictions")),
        rule("feeding_not_due", (F.col("action_type") == "continue_due_feeding_routine") & ~F.coalesce("feeding_due", F.lit(False))),
        rule("care_pending", brief & F.coalesce("care_pending", F.lit(True))),
        rule("no_action_too_long", brief & ~F.coalesce(F.col("duration_ms").between(1, 10000), F.lit(False))),
        rule("policy_reserved_for_phase_2", (F.col("policy") == "expected_information_gain") & (F.col("phase") != "I1.2")),
        rule("policy_not_before_phase_1", (F.col("policy") == "randomized_safe_set") & (F.col("phase") == "I1.0"))))
    )


def validate_latent_input(manifest: Sequence[str], episodes: DataFrame, key: str = "episode_id", features: str = "features") -> DataFrame:
    """Rows ``(subject, errors)`` for manifest names, episodes with problems and names that are never set."""
    names = sorted(set(manifest))
    token = lambda n: [t for t in FORBIDDEN_FIT_TOKENS if t in n.lower()]
    counts = [F.count(F.try_element_at(features, F.lit(n))).alias(f"c{i}") for i, n in enumerate(names)]
    seen = episodes.agg(*counts)
    per_name = F.array(*[F.struct(F.lit(f"feature:{n}").alias("subject"), rules(
        rule("feature_name_not_unique", F.lit(list(manifest).count(n) > 1)), rule("forbidden_token", F.lit(bool(token(n)))),
        rule("feature_always_null", F.col(f"c{i}") == 0)).alias("errors")) for i, n in enumerate(names)])
    feature_rows = seen.select(F.explode(per_name).alias("r")).select("r.*")
    declared = F.array(*[F.lit(n) for n in names])
    keys = F.map_keys(features)
    bad_value = lambda v: F.isnan(v) | (F.abs(v) == float("inf"))
    row = episodes.select(F.col(key), rules(
        rule("feature_missing", F.size(F.array_except(declared, keys)) > 0), rule("feature_extra", F.size(F.array_except(keys, declared)) > 0),
        rule("value_not_finite", F.exists(F.map_values(features), lambda v: F.coalesce(bad_value(v), F.lit(False))))).alias("e"))
    per = row.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.bool_or(F.array_contains("e", c)).alias(c) for c in ("feature_missing", "feature_extra", "value_not_finite")])
    per = per.select(F.concat(F.lit("episode:"), F.col(key).cast("string")).alias("subject"), rules(
        rule("episode_not_unique", F.col("n") > 1), *[rule(c, F.col(c)) for c in ("feature_missing", "feature_extra", "value_not_finite")]).alias("errors"))
    return feature_rows.unionByName(per.where(F.size("errors") > 0)).withColumn("errors", F.array_sort("errors"))


def validate_score_packets(p: DataFrame, cutoff_ms: int = 5000) -> DataFrame:
    """Binding, windows, unique classes and frames, order in time, vector length and finite scores."""
    steps = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("frames") - 1)), lambda i: i < F.size("frames"))
    at = lambda i: F.get(F.col("frames"), i)
    back = F.exists(steps, lambda i: (at(i)["start_offset_ms"] < at(i - 1)["start_offset_ms"]) | (at(i)["end_offset_ms"] < at(i - 1)["end_offset_ms"]))
    some = lambda test: F.exists("frames", test)
    return p.withColumn("errors", merge(rules(
        rule("event_id_differs", F.col("event_id") != F.col("expected_event_id")), rule("artifact_digest_differs", F.lower("artifact_sha256") != F.lower("expected_sha256")),
        rule("audio_window_reversed", F.col("audio_start_ms") >= F.col("audio_end_ms")), rule("audio_after_cutoff", F.col("audio_end_ms") > cutoff_ms),
        rule("class_ids_not_unique", not_unique("class_map", lambda c: c["class_id"])), rule("class_names_not_unique", not_unique("class_map", lambda c: c["display_name"])),
        rule("frame_index_not_unique", not_unique("frames", lambda f: f["frame_index"])),
        rule("frame_reversed", some(lambda f: f["start_offset_ms"] >= f["end_offset_ms"])),
        rule("frame_outside_audio", some(lambda f: (f["start_offset_ms"] < F.col("audio_start_ms")) | (f["end_offset_ms"] > F.col("audio_end_ms")))),
        rule("frame_after_cutoff", some(lambda f: f["end_offset_ms"] > cutoff_ms)), rule("frames_not_in_order", back),
        rule("score_count_differs", some(lambda f: F.size(f["scores"]) != F.size("class_map"))),
        rule("score_not_finite", some(lambda f: F.exists(f["scores"], lambda s: F.isnan(s) | (F.abs(s) == float("inf"))))))))


def validate_pose_packages(p: DataFrame) -> DataFrame:
    """Package window, media, samples and observations. ``observations`` carry their ``sample_pos``."""
    offsets = F.transform("samples", lambda s: s["offset_ms"])
    some = lambda test: F.exists("observations", test)
    return p.withColumn("errors", merge(rules(
        rule("window_reversed", F.col("window_start_ms") >= F.col("window_end_ms")),
        rule("media_type_not_visual", F.exists("media_types", lambda m: ~F.lower(m).rlike("^(video|image)/"))),
        rule("samples_not_in_order", offsets != F.array_sort(offsets)), rule("sample_frames_not_unique", not_unique("samples", lambda s: s["frame_index"])),
        rule("sample_outside_window", F.exists("samples", lambda s: (s["offset_ms"] < F.col("window_start_ms")) | (s["offset_ms"] > F.col("window_end_ms")))),
        rule("no_observation", F.size("observations") == 0), rule("observation_ids_not_unique", not_unique("observations", lambda o: o["observation_id"])),
        rule("observation_sequence_differs", some(lambda o: o["sequence_id"] != F.col("sequence_id"))),
        rule("observation_frame_differs", some(lambda o: o["frame_index"] != F.get(F.col("samples"), o["sample_pos"].cast("int"))["frame_index"])),
        rule("observation_class_not_allowed", some(lambda o: ~o["observation_class"].isin(*ALLOWED_CLASSES))),
        rule("evidence_tier_not_allowed", some(lambda o: ~o["evidence_tier"].isin(*PROSPECTIVE_TIERS))),
        rule("mean_missing", some(lambda o: o["mean"].isNull())), rule("uncertainty_missing", some(lambda o: ~o["has_uncertainty"])),
        rule("observation_subject_differs", some(lambda o: o["subject_id"] != F.col("subject_id"))),
        rule("sidecar_event_differs", F.col("event_id") != F.col("sidecar_event_id")),
        rule("sidecar_subject_differs", F.col("subject_id") != F.col("sidecar_subject_id")))))


def validate_sidecars(s: DataFrame, version: str = "v0", cutoff_ms: int = 5000) -> DataFrame:
    """Reserved or sealed sensor sidecars against their own digests and the file facts read from storage.

    ``reservation_sha256``/``sealed_sha256`` are compared with the same digests recomputed in the row.
    """
    kind = F.create_map(*[F.lit(x) for kv in ARTIFACT_KINDS.items() for x in kv])
    sealed = F.col("state") == "sealed"
    a, b = F.col("start_offset_ms"), F.col("end_offset_ms")
    return s.withColumn("errors", merge(rules(
        rule("version_unsupported", F.col("sidecar_version") != version), rule("state_unknown", ~F.col("state").isin("reserved", "sealed")),
        rule("modality_unsupported", ~F.col("modality").isin(*ARTIFACT_KINDS)), rule("artifact_kind_differs", ~kind[F.col("modality")].eqNullSafe(F.col("artifact_kind"))),
        rule("schema_ref_differs", (F.col("modality") == "visual_pose") & (F.col("schema_ref") != "pose-package-v1")),
        rule("interval_outside_window", ~((a >= 0) & (a < b) & (b <= cutoff_ms))), rule("reserved_outside_own_window", ~F.col("reserved_at_offset_ms").between(F.lit(0), b)),
        rule("reservation_digest_differs", F.col("reservation_sha256") != reservation_digest()),
        rule("sealed_digest_differs", sealed & (F.col("sealed_sha256") != sealed_digest())),
        rule("file_digest_differs", sealed & (F.col("file_sha256") != F.col("actual_sha256"))),
        rule("file_length_differs", sealed & (F.col("byte_length") != F.col("actual_length"))),
        rule("duration_too_short", (F.col("modality") == "audio_vocalisation") & sealed & (F.col("duration_s") + 1e-9 < (b - a) / 1000.0)))))


def reservation_digest() -> Column:
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("event_id", "modality", "start_offset_ms", "end_offset_ms", "reserved_at_offset_ms")]), 256)


def sealed_digest() -> Column:
    return F.sha2(F.concat_ws("|", "reservation_sha256", "file_sha256", F.col("byte_length").cast("string")), 256)


def validate_run_manifests(m: DataFrame, system: str, commit: str, strata: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Tracker run manifests; ``metrics map<string,double>`` must be complete for quantitative runs."""
    known = F.array(*[F.lit(s) for s in strata])
    have = F.map_keys(F.map_filter("metrics", lambda k, v: v.isNotNull()))
    return m.withColumn("errors", merge(rules(
        rule("run_id_missing", F.col("run_id").isNull()), rule("system_not_frozen", ~F.col("system_id").eqNullSafe(F.lit(system))),
        rule("commit_differs", ~F.col("upstream_commit").eqNullSafe(F.lit(commit))), rule("sequence_digest_malformed", ~is_sha256("sequence_sha256")),
        rule("subject_ids_empty", (F.size("subject_ids") == 0) | F.exists("subject_ids", lambda s: F.trim(s) == "")),
        rule("strata_empty", F.size("strata") == 0), rule("stratum_unknown", F.size(F.array_except("strata", known)) > 0),
        rule("quantitative_without_ground_truth", F.col("quantitative") & ~F.coalesce("ground_truth", F.lit(False))),
        rule("quantitative_metric_missing", F.col("quantitative") & (F.size(F.array_except(F.array(*[F.lit(x) for x in metrics]), have)) > 0)))))


def validate_bundles(frames: DataFrame, header: DataFrame, keys: Sequence[str] = ("bundle_id",), dt_ns: int = 33_333_333) -> DataFrame:
    """Exploded frame rows re-aggregated per bundle; bounds come from counts, not from collected frames."""
    per = frames.join(header.select(*keys, "t0_ns"), list(keys)).groupBy(*keys).agg(
        F.count_distinct("frame_index").alias("n"), F.min("frame_index").alias("lo"), F.max("frame_index").alias("hi"),
        F.count_if(F.col("timestamp_ns") != F.col("t0_ns") + F.col("frame_index") * dt_ns).alias("bad_time"),
        F.count("observation_id").alias("obs"), F.count_distinct("observation_id").alias("obs_distinct"), F.count_if(F.col("evidence_tier") != "X1").alias("bad_tier"),
        F.count_if(F.size(F.array_distinct("source_ids")) < F.size("source_ids")).alias("bad_sources"), F.count_if(F.size("lineage") == 0).alias("no_lineage"),
        F.count_if(~F.col("has_uncertainty")).alias("no_uncertainty"))
    j = header.join(per, list(keys), "left")
    pos = lambda c: F.col(c) > 0
    return j.select(*keys, merge(rules(
        rule("frame_count_differs", F.coalesce("n", F.lit(0)) != F.col("frame_count")), rule("frame_index_not_sequential", (F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1)),
        rule("timestamp_differs", pos("bad_time")), rule("observation_ids_not_unique", F.col("obs") != F.col("obs_distinct")), rule("tier_not_synthetic", pos("bad_tier")),
        rule("source_ids_not_unique", pos("bad_sources")), rule("lineage_missing", pos("no_lineage")), rule("uncertainty_missing", pos("no_uncertainty")),
        rule("payload_digest_differs", F.col("payload_sha256") != F.col("expected_sha256")))).alias("errors"))


def forbidden_output_scan(df: DataFrame, tokens: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Rows whose rendered names or values contain a banned token."""
    text = F.lower(F.to_json(F.struct(*df.columns)))
    hits = F.filter(F.array(*[F.lit(t) for t in tokens]), lambda t: F.contains(text, t))
    return df.select(*keep, F.array_sort(hits).alias("errors"))


def action_window_rule(actions: DataFrame, locks: DataFrame, window_ms: int = 60_000) -> DataFrame:
    """Per episode: action rows against the lock; counts and an order-free digest sum, no action list.

    The append-only log is unchanged when count and the sum of per-action hashes still match the lock.
    """
    g = actions.groupBy("event_id").agg(
        F.count_if(F.trim(F.coalesce("action_type", F.lit(""))) == "").alias("empty_type"), F.count_if(~F.coalesce(F.col("offset_ms").between(0, window_ms), F.lit(False))).alias("outside"),
        F.count(F.lit(1)).alias("n"), action_log_digest().alias("digest"))
    j = locks.join(g, "event_id", "left")
    return j.select("event_id", merge(rules(
        rule("action_type_empty", F.col("empty_type") > 0), rule("action_outside_window", F.col("outside") > 0), rule("action_count_changed", F.coalesce("n", F.lit(0)) != F.col("action_count")),
        rule("action_log_changed", ~F.col("digest").eqNullSafe(F.col("action_digest"))))).alias("errors"))


def action_log_digest() -> Column:
    """Aggregate: sum over actions of a 60-bit hash, as text; independent of order, combined map-side."""
    one = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col("action_id"), F.col("action_type"), F.col("offset_ms").cast("string")), 256), 1, 15), 16, 10)
    return F.sum(one.cast("decimal(38,0)")).cast("string")


# ---- references ----------------------------------------------------------------------------------


def dangling_refs(child: DataFrame, parent: DataFrame, ref: str, key: str) -> DataFrame:
    """Child rows whose reference does not exist."""
    return child.join(parent.select(F.col(key).alias(ref)).distinct(), ref, "left_anti")
