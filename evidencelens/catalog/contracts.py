"""Contract validation queries: errors as one sorted string per record."""

from pyspark.sql import functions as F

from evidencelens import views
from evidencelens.catalog import query
from evidencelens.docs_view import ABSENT, SQL_DOCS, SQL_NESTED, SQL_SPARSE, array_of, documents, sparse_documents
from evidencelens.operators import contracts as ct
from evidencelens.views import spread, table


def text(df, *keys):
    return df.select(*keys, F.array_join("errors", ";").alias("errors"))


def collect_rules(base, key, rules):
    """SQL that unites ``(condition source, code)`` selects and joins the codes per record."""
    parts = " UNION ALL ".join(f"SELECT {key}, {code} AS code FROM {src}" for code, src in rules)
    return f"e AS ({parts}) SELECT b.{key}, coalesce(string_agg(DISTINCT code, ';' ORDER BY code), '') AS errors FROM {base} b LEFT JOIN e USING ({key}) GROUP BY 1"


UN = """, ob AS (SELECT event_id, end_offset_ms AS ep, unnest(observations) AS x FROM v_docs), hy AS (SELECT event_id, unnest(hypotheses) AS x FROM v_docs),
ac AS (SELECT event_id, unnest(human_actions) AS x FROM v_docs), iv AS (SELECT event_id, unnest(interventions) AS x FROM v_docs), oc AS (SELECT event_id, end_offset_ms AS ep, unnest(outcomes) AS x FROM v_docs),
hs AS (SELECT event_id, list(x.hypothesis_id) AS ids FROM hy GROUP BY 1), acs AS (SELECT event_id, list(x.action_id) AS ids FROM ac GROUP BY 1)"""
DUP = "{src} GROUP BY event_id HAVING count(*) > count(DISTINCT x.{id})"
DEEP = [
    ("'time_end_before_start'", "v_docs WHERE end_time < start_time"),
    ("'hypothesis_ids_not_unique'", DUP.format(src="hy", id="hypothesis_id")), ("'action_ids_not_unique'", DUP.format(src="ac", id="action_id")),
    ("'intervention_ids_not_unique'", DUP.format(src="iv", id="intervention_id")), ("'outcome_ids_not_unique'", DUP.format(src="oc", id="outcome_id")),
    ("'observation_reversed:' || x.observation_ref", "ob WHERE x.end_offset_ms < x.start_offset_ms"),
    ("'observation_after_episode:' || x.observation_ref", "ob WHERE x.end_offset_ms > ep"),
    ("'probability_not_finite:' || x.hypothesis_id", "hy WHERE isnan(x.probability)"),
    ("'action_unknown:' || x.intervention_id", "iv JOIN acs USING (event_id) WHERE NOT list_contains(ids, x.action_ref)"),
    ("'candidate_unknown:' || x.intervention_id", "iv JOIN hs USING (event_id) WHERE NOT list_has_all(ids, x.candidates)"),
    ("'prediction_not_candidate:' || x.intervention_id", "iv WHERE NOT list_has_all(x.candidates, x.predictions)"),
    ("'candidate_without_prediction:' || x.intervention_id", "iv WHERE NOT list_has_all(x.predictions, x.candidates)"),
    ("'outcome_reversed:' || x.outcome_id", "oc WHERE x.end_offset_ms < x.start_offset_ms"),
    ("'outcome_after_episode:' || x.outcome_id", "oc WHERE coalesce(x.end_offset_ms, x.start_offset_ms) > ep"),
    ("'outcome_hypothesis_unknown:' || x.outcome_id", "oc JOIN hs USING (event_id) WHERE NOT list_has_all(ids, x.supports)"),
]
DEEP_SQL = " UNION ALL ".join(f"SELECT event_id, {c} AS code FROM {s}" for c, s in DEEP)
EPISODE_ERRORS = SQL_DOCS + UN + f""", deep AS ({DEEP_SQL}),
ee AS (SELECT event_id, 'schema_version' AS code FROM v_docs WHERE schema_version <> '0.1.0' UNION ALL SELECT event_id, code FROM deep JOIN v_docs USING (event_id) WHERE schema_version = '0.1.0')"""


@query("validate_episodes", "V1", EPISODE_ERRORS + " SELECT d.event_id, coalesce(string_agg(DISTINCT code, ';' ORDER BY code), '') AS errors FROM v_docs d LEFT JOIN ee USING (event_id) GROUP BY 1")
def validate_episodes(spark, sf):
    return text(ct.validate_episodes(documents(spark, sf)), "event_id")


MISSING = " UNION ALL ".join(f"SELECT event_id, 'missing:{c}' AS code FROM v_docs WHERE {c} IS NULL" for c in ABSENT if c not in ("objects", "social"))


def absent_errors(docs_sql):
    """Errors of documents with absent arrays: structure errors stand alone, deeper ones need a sound structure."""
    return docs_sql + UN + f""", st AS (SELECT event_id, 'schema_version' AS code FROM v_docs WHERE schema_version <> '0.1.0' UNION ALL {MISSING}), deep AS ({DEEP_SQL}),
ee AS (SELECT * FROM st UNION ALL SELECT event_id, code FROM deep WHERE event_id NOT IN (SELECT event_id FROM st))"""


@query("validate_episodes_absent", "V1", absent_errors(SQL_SPARSE) + " SELECT d.event_id, coalesce(string_agg(DISTINCT code, ';' ORDER BY code), '') AS errors FROM v_docs d LEFT JOIN ee USING (event_id) GROUP BY 1")
def validate_episodes_absent(spark, sf):
    return text(ct.validate_episodes(sparse_documents(spark, sf)), "event_id")


CAPTURE = EPISODE_ERRORS + """, sn AS (SELECT event_id, list_filter(observations, lambda o: o.modality = 'object_environment') AS s, start_us, location FROM v_docs),
o1 AS (SELECT event_id, s[1] AS x, start_us, location FROM sn WHERE len(s) = 1),
ce AS (SELECT * FROM ee UNION ALL SELECT event_id, 'snapshot_count_not_one' FROM sn WHERE len(s) <> 1 UNION ALL SELECT event_id, 'snapshot_not_at_zero' FROM o1 WHERE x.start_offset_ms <> 0 OR x.end_offset_ms <> 0
 UNION ALL SELECT event_id, 'captured_at_differs' FROM o1 WHERE x.captured_us <> start_us UNION ALL SELECT event_id, 'snapshot_location_differs' FROM o1 WHERE x.location IS DISTINCT FROM o1.location)"""


@query("validate_capture", "V2", CAPTURE + " SELECT d.event_id, coalesce(string_agg(DISTINCT code, ';' ORDER BY code), '') AS errors FROM v_docs d LEFT JOIN ce USING (event_id) GROUP BY 1")
def validate_capture(spark, sf):
    return text(ct.validate_capture(documents(spark, sf)), "event_id")


@query("dangling_refs", "J8", """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 < 8)""")
def dangling_refs(spark, sf):
    parents = table(spark, sf, "customer").where("c_custkey % 10 < 8")
    return ct.dangling_refs(table(spark, sf, "orders"), parents, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


# ---- plans ---------------------------------------------------------------------------------------

PLAN_SCALARS = """event_id, event_id % 50 AS recorded_offset_ms, 40 - event_id % 7 AS scheduled_offset_ms,
 CASE event_id % 4 WHEN 0 THEN 'continue_due_feeding_routine' WHEN 1 THEN 'brief_no_action_observation' ELSE 'open_access' END AS action_type,
 CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 3 = 1 END AS feeding_due, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 5 = 1 END AS care_pending,
 (event_id * 37) % 12000 AS duration_ms, 'I1.' || (event_id % 3) AS phase, CASE event_id % 5 WHEN 0 THEN 'expected_information_gain' WHEN 1 THEN 'randomized_safe_set' ELSE 'naturalistic' END AS policy"""
PLAN_HYP = {"hypothesis_id": "'h' || CAST(i % (CASE WHEN event_id % 31 = 0 THEN 1 ELSE 9 END) AS STRING)",
            "probability": "CAST(1.0 AS DOUBLE) / (1 + event_id % 3) + (CASE WHEN event_id % 17 = 0 THEN CAST(0.01 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"}


def _plan(d):
    preds = "list_value" if d == "duckdb" else "array"
    return f"{PLAN_SCALARS}, {array_of(d, '(1 + event_id % 3)', PLAN_HYP)} AS hypotheses, {preds}('h0', 'h' || CAST(event_id % 4 AS STRING)) AS predictions"


PLANS_SQL = "WITH pl AS (SELECT " + _plan("duckdb") + " FROM events), ph AS (SELECT event_id, unnest(hypotheses) AS x FROM pl), ids AS (SELECT event_id, list(x.hypothesis_id) AS ids, sum(x.probability) AS s FROM ph GROUP BY 1), "


@query("validate_plans", "V3", PLANS_SQL + collect_rules("pl", "event_id", [
    ("'recorded_after_action'", "pl WHERE recorded_offset_ms >= scheduled_offset_ms"), ("'hypothesis_ids_not_unique'", DUP.format(src="ph", id="hypothesis_id")),
    ("'probabilities_do_not_sum_to_one'", "ids WHERE abs(s - 1) > 1e-6"), ("'prediction_unknown'", "pl JOIN ids USING (event_id) WHERE NOT list_has_all(ids, predictions)"),
    ("'prediction_missing'", "pl JOIN ids USING (event_id) WHERE NOT list_has_all(predictions, ids)"), ("'prediction_repeated'", "pl WHERE len(list_distinct(predictions)) < len(predictions)"),
    ("'feeding_not_due'", "pl WHERE action_type = 'continue_due_feeding_routine' AND feeding_due IS NOT TRUE"),
    ("'care_pending'", "pl WHERE action_type = 'brief_no_action_observation' AND care_pending IS NOT FALSE"),
    ("'no_action_too_long'", "pl WHERE action_type = 'brief_no_action_observation' AND NOT duration_ms BETWEEN 1 AND 10000"),
    ("'policy_reserved_for_phase_2'", "pl WHERE policy = 'expected_information_gain' AND phase <> 'I1.2'"), ("'policy_not_before_phase_1'", "pl WHERE policy = 'randomized_safe_set' AND phase = 'I1.0'"),
]))
def validate_plans(spark, sf):
    p = table(spark, sf, "events").selectExpr(*_split(_plan("spark")))
    return text(ct.validate_plans(p), "event_id")


def _split(projection):
    """Splits a projection list at top-level commas."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(projection):
        depth += ch == "("
        depth -= ch == ")"
        if ch == "," and depth == 0:
            out.append(projection[start:i])
            start = i + 1
    return [*out, projection[start:]]


# ---- latent input --------------------------------------------------------------------------------

MANIFEST = ["f1", "f2", "f3", "f4", "f4", "future_rate", "never"]


@query("validate_latent_input", "V4 T3", """
WITH e AS (SELECT vec_id AS id, vec_id % 97 = 5 AS miss, vec_id % 89 = 4 AS extra, vec_id % 83 = 3 AS bad FROM embeddings UNION ALL SELECT vec_id, false, false, false FROM embeddings WHERE vec_id % 79 = 2),
g AS (SELECT id, count(*) AS n, bool_or(miss) AS m, bool_or(extra) AS x, bool_or(bad) AS b FROM e GROUP BY 1)
SELECT 'feature:f1' AS subject, '' AS errors UNION ALL SELECT 'feature:f2', '' UNION ALL SELECT 'feature:f3', '' UNION ALL SELECT 'feature:f4', 'feature_name_not_unique'
UNION ALL SELECT 'feature:future_rate', 'forbidden_token' UNION ALL SELECT 'feature:never', 'feature_always_null'
UNION ALL SELECT 'episode:' || id, concat_ws(';', CASE WHEN n > 1 THEN 'episode_not_unique' END, CASE WHEN x THEN 'feature_extra' END, CASE WHEN m THEN 'feature_missing' END, CASE WHEN b THEN 'value_not_finite' END)
FROM g WHERE n > 1 OR m OR x OR b""")
def validate_latent_input(spark, sf):
    e = table(spark, sf, "embeddings")
    vals = ["CAST(embedding[0] AS DOUBLE)", "IF({bad}, double('NaN'), CAST(embedding[1] AS DOUBLE))", "CAST(embedding[2] AS DOUBLE)", "CAST(embedding[3] AS DOUBLE)"]

    def rows(src, miss, extra, bad):
        full = f"map('f1', {vals[0]}, 'f2', {vals[1].format(bad=bad)}, 'f3', {vals[2]}, 'future_rate', 1.0D, 'never', CAST(NULL AS DOUBLE))"
        m = f"map_concat({full}, IF({miss}, map(), map('f4', {vals[3]})), IF({extra}, map('unlisted', 1.0D), map()))"
        return src.selectExpr("vec_id AS episode_id", f"{m} AS features")

    eps = rows(e, "vec_id % 97 = 5", "vec_id % 89 = 4", "vec_id % 83 = 3").unionByName(rows(e.where("vec_id % 79 = 2"), "false", "false", "false"))
    return text(ct.validate_latent_input(MANIFEST, eps), "subject")


# ---- score packets -------------------------------------------------------------------------------

PACKET_FRAMES = {"frame_index": "i % (CASE WHEN event_id % 23 = 0 THEN 1 ELSE 99 END)", "start_offset_ms": "i * 1000 * (CASE WHEN event_id % 29 = 0 THEN -1 ELSE 1 END) + event_id % 7",
                 "end_offset_ms": "i * 1000 + 900 - (CASE WHEN event_id % 31 = 0 THEN 900 ELSE 0 END)",
                 "scores": "$list(CAST(0.5 AS DOUBLE), CASE WHEN event_id % 37 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(0.25 AS DOUBLE) END, CAST(0.1 AS DOUBLE))"}
PACKET_CLASSES = {"class_id": "i % (CASE WHEN event_id % 41 = 0 THEN 1 ELSE 99 END)", "display_name": "'c' || CAST(i % (CASE WHEN event_id % 43 = 0 THEN 2 ELSE 99 END) AS STRING)"}
PACKET_SCALARS = """event_id, CASE WHEN event_id % 47 = 0 THEN event_id + 1 ELSE event_id END AS expected_event_id, 'AB' || CAST(event_id AS STRING) AS artifact_sha256,
 CASE WHEN event_id % 53 = 0 THEN 'x' ELSE 'ab' || CAST(event_id AS STRING) END AS expected_sha256, CASE WHEN event_id % 59 = 0 THEN 6000 ELSE 0 END AS audio_start_ms, 3500 + event_id % 1600 AS audio_end_ms"""


def _packet(d):
    return (f"{PACKET_SCALARS}, {array_of(d, '(1 + event_id % 4)', PACKET_FRAMES, 4)} AS frames, "
            f"{array_of(d, '(CASE WHEN event_id % 61 = 0 THEN 4 ELSE 3 END)', PACKET_CLASSES, 4)} AS class_map")


PACKET_SQL = "WITH pk AS (SELECT " + _packet("duckdb") + """ FROM events), fr AS (SELECT event_id, audio_start_ms, audio_end_ms, len(class_map) AS k, unnest(frames) AS x, unnest(range(len(frames))) AS pos FROM pk),
cm AS (SELECT event_id, unnest(class_map) AS x FROM pk), lg AS (SELECT *, lag(x.start_offset_ms) OVER w AS ps, lag(x.end_offset_ms) OVER w AS pe FROM fr WINDOW w AS (PARTITION BY event_id ORDER BY pos)), """


@query("validate_score_packets", "V5 E17", PACKET_SQL + collect_rules("pk", "event_id", [
    ("'event_id_differs'", "pk WHERE event_id <> expected_event_id"), ("'artifact_digest_differs'", "pk WHERE lower(artifact_sha256) <> lower(expected_sha256)"),
    ("'audio_window_reversed'", "pk WHERE audio_start_ms >= audio_end_ms"), ("'audio_after_cutoff'", "pk WHERE audio_end_ms > 5000"), ("'class_ids_not_unique'", DUP.format(src="cm", id="class_id")),
    ("'class_names_not_unique'", DUP.format(src="cm", id="display_name")), ("'frame_index_not_unique'", DUP.format(src="fr", id="frame_index")), ("'frame_reversed'", "fr WHERE x.start_offset_ms >= x.end_offset_ms"),
    ("'frame_outside_audio'", "fr WHERE x.start_offset_ms < audio_start_ms OR x.end_offset_ms > audio_end_ms"), ("'frame_after_cutoff'", "fr WHERE x.end_offset_ms > 5000"),
    ("'frames_not_in_order'", "lg WHERE x.start_offset_ms < ps OR x.end_offset_ms < pe"), ("'score_count_differs'", "fr WHERE len(x.scores) <> k"),
    ("'score_not_finite'", "fr WHERE len(list_filter(x.scores, lambda s: isnan(s))) > 0"),
]))
def validate_score_packets(spark, sf):
    return text(ct.validate_score_packets(spread(table(spark, sf, "events")).selectExpr(*_split(_packet("spark")))), "event_id")


# ---- pose packages -------------------------------------------------------------------------------

SAMPLES = {"frame_index": "i % (CASE WHEN event_id % 23 = 0 THEN 1 ELSE 99 END)", "offset_ms": "i * 400 * (CASE WHEN event_id % 29 = 0 THEN -1 ELSE 1 END)"}
OBS = {"observation_id": "'o' || CAST(i % (CASE WHEN event_id % 31 = 0 THEN 2 ELSE 99 END) AS STRING)", "sample_pos": "i % (1 + event_id % 3)",
       "frame_index": "CASE WHEN event_id % 37 = 0 THEN 77 ELSE (i % (1 + event_id % 3)) % (CASE WHEN event_id % 23 = 0 THEN 1 ELSE 99 END) END",
       "sequence_id": "CASE WHEN event_id % 41 = 0 AND i = 0 THEN 'other' ELSE 's' || CAST(event_id AS STRING) END",
       "subject_id": "CASE WHEN event_id % 71 = 0 AND i = 1 THEN user_id + 1 ELSE user_id END",
       "observation_class": "CASE WHEN event_id % 43 = 0 THEN 'joint_angle' ELSE 'surface_landmark' END", "evidence_tier": "CASE (event_id + i) % 13 WHEN 0 THEN 'X1' WHEN 1 THEN 'G2' WHEN 2 THEN 'S1' ELSE 'S2' END",
       "quality": "CASE (event_id * 3 + i) % 4 WHEN 0 THEN 'gold' WHEN 1 THEN 'silver' WHEN 2 THEN 'bronze' ELSE 'unknown' END",
       "mean": "CASE WHEN event_id % 47 = 0 AND i = 1 THEN NULL ELSE CAST(0.5 AS DOUBLE) END", "has_uncertainty": "event_id % 53 > 0"}
PACKAGE_SCALARS = """event_id, CASE WHEN event_id % 59 = 0 THEN event_id + 1 ELSE event_id END AS sidecar_event_id, user_id AS subject_id, CASE WHEN event_id % 73 = 0 THEN user_id + 1 ELSE user_id END AS sidecar_subject_id, 's' || CAST(event_id AS STRING) AS sequence_id, CASE WHEN event_id % 61 = 0 THEN 6000 ELSE 0 END AS window_start_ms,
 900 AS window_end_ms"""


def _package(d):
    lst = "list_value" if d == "duckdb" else "array"
    return (f"{PACKAGE_SCALARS}, {array_of(d, '(1 + event_id % 3)', SAMPLES)} AS samples, {array_of(d, '(2 + event_id % 4)', OBS, 5)} AS observations, "
            f"{lst}('Video/mp4', CASE WHEN event_id % 67 = 0 THEN 'audio/wav' ELSE 'image/png' END) AS media_types")


PACKAGE_SQL = "WITH pk AS (SELECT " + _package("duckdb") + """ FROM events), sm AS (SELECT event_id, window_start_ms, window_end_ms, unnest(samples) AS x, unnest(range(len(samples))) AS pos FROM pk),
ob AS (SELECT event_id, sequence_id, subject_id, unnest(observations) AS x FROM pk), lg AS (SELECT *, lag(x.offset_ms) OVER (PARTITION BY event_id ORDER BY pos) AS p FROM sm), """


@query("validate_pose_packages", "V6", PACKAGE_SQL + collect_rules("pk", "event_id", [
    ("'window_reversed'", "pk WHERE window_start_ms >= window_end_ms"), ("'media_type_not_visual'", "pk WHERE len(list_filter(media_types, lambda m: lower(m) LIKE 'audio%')) > 0"),
    ("'samples_not_in_order'", "lg WHERE x.offset_ms < p"), ("'sample_frames_not_unique'", DUP.format(src="sm", id="frame_index")),
    ("'sample_outside_window'", "sm WHERE x.offset_ms < window_start_ms OR x.offset_ms > window_end_ms"), ("'observation_ids_not_unique'", DUP.format(src="ob", id="observation_id")),
    ("'observation_sequence_differs'", "ob WHERE x.sequence_id <> ob.sequence_id"), ("'observation_frame_differs'", "ob JOIN sm ON sm.event_id = ob.event_id AND sm.pos = ob.x.sample_pos WHERE ob.x.frame_index <> sm.x.frame_index"),
    ("'observation_class_not_allowed'", "ob WHERE x.observation_class = 'joint_angle'"), ("'evidence_tier_not_allowed'", "ob WHERE x.evidence_tier = 'X1'"), ("'mean_missing'", "ob WHERE x.mean IS NULL"),
    ("'uncertainty_missing'", "ob WHERE NOT x.has_uncertainty"), ("'sidecar_event_differs'", "pk WHERE event_id <> sidecar_event_id"),
    ("'observation_subject_differs'", "ob WHERE x.subject_id <> ob.subject_id"), ("'sidecar_subject_differs'", "pk WHERE subject_id <> sidecar_subject_id"),
]).replace("SELECT event_id, 'observation_frame_differs'", "SELECT ob.event_id, 'observation_frame_differs'"))
def validate_pose_packages(spark, sf):
    return text(ct.validate_pose_packages(packages(spark, sf)), "event_id")


def packages(spark, sf):
    return spread(table(spark, sf, "events")).selectExpr(*_split(_package("spark")))


# ---- sidecars ------------------------------------------------------------------------------------

SIDE = """event_id, CASE WHEN event_id % 41 = 0 THEN 'v9' ELSE 'v0' END AS sidecar_version, CASE event_id % 4 WHEN 0 THEN 'reserved' WHEN 3 THEN CASE WHEN event_id % 43 = 0 THEN 'open' ELSE 'sealed' END ELSE 'sealed' END AS state,
 CASE event_id % 3 WHEN 0 THEN 'visual_pose' WHEN 1 THEN 'audio_vocalisation' ELSE CASE WHEN event_id % 47 = 0 THEN 'thermal' ELSE 'audio_vocalisation' END END AS modality,
 CASE WHEN event_id % 3 = 0 AND event_id % 53 > 0 THEN 'pose_features_json' ELSE 'audio_wav' END AS artifact_kind, CASE WHEN event_id % 59 = 0 THEN 'other' ELSE 'pose-package-v1' END AS schema_ref,
 event_id % 1000 AS start_offset_ms, 900 + event_id % 4200 AS end_offset_ms, event_id % 1500 AS reserved_at_offset_ms, CASE WHEN event_id % 61 = 0 THEN 'f0' ELSE 'f' || CAST(event_id AS STRING) END AS file_sha256,
 'f' || CAST(event_id AS STRING) AS actual_sha256, event_id % 100 AS byte_length, event_id % 100 + (CASE WHEN event_id % 67 = 0 THEN 1 ELSE 0 END) AS actual_length, CAST(event_id % 5 AS DOUBLE) AS duration_s"""
RES = "concat_ws('|', CAST(event_id AS STRING), modality, CAST(start_offset_ms AS STRING), CAST(end_offset_ms AS STRING), CAST(reserved_at_offset_ms AS STRING))"
SEAL = "concat_ws('|', reservation_sha256, file_sha256, CAST(byte_length AS STRING))"
SIDE_SQL = f"""WITH s0 AS (SELECT {SIDE} FROM events), s1 AS (SELECT *, CASE WHEN event_id % 71 = 0 THEN 'tampered' ELSE sha256({RES}) END AS reservation_sha256 FROM s0),
sc AS (SELECT *, CASE WHEN event_id % 73 = 0 THEN 'tampered' ELSE sha256({SEAL}) END AS sealed_sha256 FROM s1), """


def sidecars(spark, sf):
    s0 = table(spark, sf, "events").selectExpr(*_split(SIDE))
    s1 = s0.selectExpr("*", f"IF(event_id % 71 = 0, 'tampered', sha2({RES}, 256)) AS reservation_sha256")
    return s1.selectExpr("*", f"IF(event_id % 73 = 0, 'tampered', sha2({SEAL}, 256)) AS sealed_sha256")


@query("validate_sidecars", "V11 F7 F9", SIDE_SQL + collect_rules("sc", "event_id", [
    ("'version_unsupported'", "sc WHERE sidecar_version <> 'v0'"), ("'state_unknown'", "sc WHERE state = 'open'"), ("'modality_unsupported'", "sc WHERE modality = 'thermal'"),
    ("'artifact_kind_differs'", "sc WHERE modality = 'thermal' OR (modality = 'visual_pose') <> (artifact_kind = 'pose_features_json')"), ("'schema_ref_differs'", "sc WHERE modality = 'visual_pose' AND schema_ref = 'other'"),
    ("'interval_outside_window'", "sc WHERE start_offset_ms >= end_offset_ms OR end_offset_ms > 5000"), ("'reserved_outside_own_window'", "sc WHERE reserved_at_offset_ms > end_offset_ms"),
    ("'reservation_digest_differs'", "sc WHERE event_id % 71 = 0"), ("'sealed_digest_differs'", "sc WHERE state = 'sealed' AND event_id % 73 = 0"), ("'file_digest_differs'", "sc WHERE state = 'sealed' AND file_sha256 <> actual_sha256"),
    ("'file_length_differs'", "sc WHERE state = 'sealed' AND byte_length <> actual_length"),
    ("'duration_too_short'", "sc WHERE modality = 'audio_vocalisation' AND state = 'sealed' AND duration_s + 1e-9 < (end_offset_ms - start_offset_ms) / 1000"),
]))
def validate_sidecars(spark, sf):
    return text(ct.validate_sidecars(sidecars(spark, sf)), "event_id")


# ---- run manifests, bundles, output scan, action log ---------------------------------------------

RUN = """event_id, CASE WHEN event_id % 31 = 0 THEN NULL ELSE 'run' || CAST(event_id AS STRING) END AS run_id, CASE WHEN event_id % 37 = 0 THEN 'modified' ELSE 'frozen_tracker' END AS system_id,
 CASE WHEN event_id % 41 = 0 THEN NULL ELSE 'c0ffee' END AS upstream_commit, CASE WHEN event_id % 43 = 0 THEN 'zz' ELSE {sha} END AS sequence_sha256, event_id % 2 = 0 AS quantitative,
 CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_id % 6 < 5 END AS ground_truth"""


@query("validate_run_manifests", "V12", "WITH r AS (SELECT " + RUN.format(sha="sha256(CAST(event_id AS STRING))") + " FROM events), " + collect_rules("r", "event_id", [
    ("'run_id_missing'", "r WHERE run_id IS NULL"), ("'system_not_frozen'", "r WHERE system_id = 'modified'"), ("'commit_differs'", "r WHERE upstream_commit IS NULL"),
    ("'sequence_digest_malformed'", "r WHERE sequence_sha256 = 'zz'"), ("'subject_ids_empty'", "r WHERE event_id % 47 = 0"), ("'strata_empty'", "r WHERE event_id % 53 = 0"), ("'stratum_unknown'", "r WHERE event_id % 59 = 0 AND event_id % 53 > 0"),
    ("'quantitative_without_ground_truth'", "r WHERE quantitative AND ground_truth IS NOT TRUE"), ("'quantitative_metric_missing'", "r WHERE quantitative AND event_id % 7 = 0")]))
def validate_run_manifests(spark, sf):
    r = table(spark, sf, "events").selectExpr(
        *_split(RUN.format(sha="sha2(CAST(event_id AS STRING), 256)")), "IF(event_id % 47 = 0, array('s1', ' '), array('s1', 's2')) AS subject_ids",
        "CASE WHEN event_id % 53 = 0 THEN CAST(array() AS array<string>) WHEN event_id % 59 = 0 THEN array('fog') ELSE array('crossing') END AS strata",
        "map('idf1', 0.5D, 'idsw', IF(event_id % 7 = 0, NULL, 3.0D)) AS metrics")
    return text(ct.validate_run_manifests(r, "frozen_tracker", "c0ffee", ["crossing", "long_gap"], ["idf1", "idsw"]), "event_id")


BUNDLE = """fr AS (SELECT event_id // 50 AS bundle_id, event_id % 50 AS fi, CASE WHEN event_id % 101 = 7 THEN event_id - 1 ELSE event_id END AS oid, event_id FROM events WHERE event_id % 211 <> 0),
g AS (SELECT bundle_id, count(DISTINCT fi) AS n, min(fi) AS lo, max(fi) AS hi, count(*) - count(DISTINCT oid) AS dup, bool_or(event_id % 307 = 3) AS bt, bool_or(event_id % 401 = 5) AS tier,
 bool_or(event_id % 503 = 9) AS src, bool_or(event_id % 601 = 11) AS lin, bool_or(event_id % 701 = 13) AS unc FROM fr GROUP BY 1)"""


@query("validate_bundles", "V16", "WITH " + BUNDLE + """ SELECT bundle_id, concat_ws(';', CASE WHEN n <> 50 THEN 'frame_count_differs' END, CASE WHEN lo <> 0 OR hi <> n - 1 THEN 'frame_index_not_sequential' END,
 CASE WHEN lin THEN 'lineage_missing' END, CASE WHEN dup > 0 THEN 'observation_ids_not_unique' END, CASE WHEN bundle_id % 9 = 4 THEN 'payload_digest_differs' END, CASE WHEN src THEN 'source_ids_not_unique' END,
 CASE WHEN tier THEN 'tier_not_synthetic' END, CASE WHEN bt THEN 'timestamp_differs' END, CASE WHEN unc THEN 'uncertainty_missing' END) AS errors FROM g""")
def validate_bundles(spark, sf):
    f = table(spark, sf, "events").where("event_id % 211 <> 0").selectExpr(
        "event_id div 50 AS bundle_id", "event_id % 50 AS frame_index", "IF(event_id % 101 = 7, event_id - 1, event_id) AS observation_id",
        "(event_id div 50) * 1000 + (event_id % 50) * 33333333 + IF(event_id % 307 = 3, 1, 0) AS timestamp_ns", "IF(event_id % 401 = 5, 'S2', 'X1') AS evidence_tier",
        "IF(event_id % 503 = 9, array('a', 'a'), array('a', 'b')) AS source_ids", "IF(event_id % 601 = 11, CAST(array() AS array<string>), array('sim')) AS lineage", "event_id % 701 <> 13 AS has_uncertainty")
    header = f.select("bundle_id").distinct().selectExpr("bundle_id", "bundle_id * 1000 AS t0_ns", "50 AS frame_count", "IF(bundle_id % 9 = 4, 'x', 'y') AS payload_sha256", "'y' AS expected_sha256")
    return text(ct.validate_bundles(f, header), "bundle_id")


@query("forbidden_output_scan", "V17", """
WITH t AS (SELECT doc_id, lower(source || ' ' || lang || ' ' || text) AS x FROM documents)
SELECT doc_id, concat_ws(';', CASE WHEN contains(x, 'forum') THEN 'forum' END, CASE WHEN contains(x, 'license') THEN 'license' END, CASE WHEN contains(x, 'the') THEN 'the' END) AS errors FROM t""")
def forbidden_output_scan(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    return text(ct.forbidden_output_scan(d, ["license", "forum", "the"], ["doc_id"]), "doc_id")


LOG = "SELECT event_id, unnest(human_actions) AS x, event_id % 17 AS k FROM v_docs"
H60 = "('0x' || substr(sha256(x.action_id || '|' || {t} || '|' || {o}), 1, 15))::HUGEINT"


@query("action_window_rule", "V18", SQL_DOCS + f""", a AS (SELECT event_id, k, x.action_id AS aid, CASE WHEN k = 3 THEN '  ' ELSE x.action_type END AS t, x.offset_ms + CASE WHEN k = 5 THEN 30000 ELSE 0 END AS o FROM ({LOG}) WHERE NOT (k = 7 AND x.action_id = 'a0')),
g AS (SELECT event_id, bool_or(trim(t) = '') AS e, bool_or(o NOT BETWEEN 0 AND 60000) AS w, count(*) AS n FROM a GROUP BY 1)
SELECT d.event_id, concat_ws(';', CASE WHEN coalesce(n, 0) <> len(human_actions) THEN 'action_count_changed' END, CASE WHEN d.event_id % 17 IN (3, 5, 7) THEN 'action_log_changed' END,
 CASE WHEN w THEN 'action_outside_window' END, CASE WHEN e THEN 'action_type_empty' END) AS errors FROM v_docs d LEFT JOIN g USING (event_id)""")
def action_window_rule(spark, sf):
    d = documents(spark, sf)
    base = d.select("event_id", F.explode("human_actions").alias("x")).select("event_id", "x.action_id", "x.action_type", "x.offset_ms")
    locks = base.groupBy("event_id").agg(F.count(F.lit(1)).alias("action_count"), ct.action_log_digest().alias("action_digest"))
    k = F.expr("event_id % 17")
    now = base.where("NOT (event_id % 17 = 7 AND action_id = 'a0')").withColumns({
        "action_type": F.when(k == 3, "  ").otherwise(F.col("action_type")), "offset_ms": F.col("offset_ms") + F.when(k == 5, 30000).otherwise(0)})
    return text(ct.action_window_rule(now, locks), "event_id")
