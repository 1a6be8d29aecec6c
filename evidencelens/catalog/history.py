"""History, context and outcome queries."""

from pyspark.sql import functions as F

from evidencelens import views
from evidencelens.catalog import query
from evidencelens.docs_view import SQL_DOCS, SQL_NESTED, SQL_NESTED_EMPTY, SQL_SPARSE_EMPTY, documents, sparse_documents
from evidencelens.functions import cyclic_hour, iso_micros, keyword_category, keyword_flags, local_hour, norm_token, r6
from evidencelens.operators import context, history
from evidencelens.catalog.contracts import absent_errors
from evidencelens.operators import contracts as ct
from evidencelens.plans.history import history_feature_rows
from evidencelens.session import scratch_path
from evidencelens.sources.documents import flatten_episodes, read_episodes

EP = views.with_views("v_episodes")


def flat_episodes(spark, sf):
    e = views.episodes(spark, sf)
    action = F.struct(keyword_category("action_type").alias("category"), "action_us")
    return e.withColumn("actions", F.array(action))


PREV_SQL = """
 SELECT e.event_id, p.event_id AS p_id, p.location AS p_loc, p.start_us AS p_start,
        CASE WHEN p.outcome_us <= e.start_us THEN p.terminated END AS p_term, p.outcome_us AS p_out, e.start_us
 FROM v_episodes e LEFT JOIN LATERAL (
   SELECT * FROM v_episodes x WHERE x.household_id = e.household_id AND x.start_us < e.start_us
   ORDER BY x.start_us DESC, x.event_id DESC LIMIT 1) p ON true"""


@query("previous_episode", "J2 E21 F13", EP + f"""
SELECT event_id, p_id AS previous_event_id, coalesce(p_loc, '__missing__') AS previous_location,
       round(coalesce((start_us - p_start) / 1e6, -1.0), 6) AS seconds_since_previous,
       (p_id IS NULL)::DOUBLE AS seconds_since_previous_missing,
       coalesce(p_term::DOUBLE, -1.0) AS previous_terminated, (p_term IS NULL)::DOUBLE AS previous_terminated_missing
FROM ({PREV_SQL})""")
def previous_episode(spark, sf):
    out = history.previous_episode(views.episodes(spark, sf))
    return out.withColumn("seconds_since_previous", r6("seconds_since_previous"))


ACT_SQL = """
 SELECT e.event_id, c.category, max(x.action_us) AS us, arg_max(x.event_id, x.action_us * 1::HUGEINT * 10000000 - x.start_us) AS src
 FROM v_episodes e CROSS JOIN (VALUES ('food'),('play'),('access'),('social')) c(category)
 LEFT JOIN v_episodes x ON x.household_id = e.household_id AND x.start_us < e.start_us
      AND x.action_us <= e.start_us AND x.category = c.category
 GROUP BY e.event_id, c.category"""

ACT_COLS = ", ".join(
    f"round(coalesce((e.start_us - max(us) FILTER (WHERE a.category = '{c}')) / 1e6, -1.0), 6) AS seconds_since_{c}, "
    f"(max(us) FILTER (WHERE a.category = '{c}') IS NULL)::DOUBLE AS seconds_since_{c}_missing"
    for c in history.CATEGORIES
)
SRC_COLS = ", ".join(
    f"max(src) FILTER (WHERE a.category = '{c}' AND us IS NOT NULL) AS {c}_source_event_id" for c in history.CATEGORIES
)


@query("time_since_action", "J3 P10", EP + f", a AS ({ACT_SQL}) SELECT e.event_id, {ACT_COLS}, {SRC_COLS} "
       "FROM v_episodes e JOIN a USING (event_id) GROUP BY e.event_id, e.start_us")
def time_since_action(spark, sf):
    out = history.time_since_action(flat_episodes(spark, sf))
    return out.withColumns({f"seconds_since_{c}": r6(f"seconds_since_{c}") for c in history.CATEGORIES})


ROLL_SQL = """
 SELECT e.event_id, count(x.event_id) FILTER (WHERE x.start_us >= e.start_us - 3600000000) AS episodes_last_1h,
        count(x.event_id) AS episodes_last_24h
 FROM v_episodes e LEFT JOIN v_episodes x ON x.household_id = e.household_id AND x.start_us < e.start_us
      AND x.start_us >= e.start_us - 86400000000 GROUP BY e.event_id"""


@query("rolling_counts", "E5", EP + ROLL_SQL)
def rolling_counts(spark, sf):
    return history.rolling_counts(views.episodes(spark, sf))


@query("history_provenance", "E22 V10", EP + f""", a AS ({ACT_SQL}), p AS ({PREV_SQL}),
u AS (SELECT event_id, src AS id, us FROM a WHERE us IS NOT NULL
      UNION ALL SELECT event_id, p_id, p_start FROM p WHERE p_id IS NOT NULL
      UNION ALL SELECT event_id, p_id, p_out FROM p WHERE p_term IS NOT NULL)
SELECT e.event_id, coalesce(string_agg(DISTINCT u.id::VARCHAR, ',' ORDER BY u.id::VARCHAR), '') AS source_event_ids,
       max(u.us) AS max_source_us, coalesce(max(u.us) > any_value(e.start_us), false) AS late
FROM v_episodes e LEFT JOIN u USING (event_id) GROUP BY e.event_id""")
def history_provenance(spark, sf):
    t = history.history_provenance(history.timeline(flat_episodes(spark, sf), windows={}))
    checked = history.validate_history(t)
    ids = F.array_join(F.array_sort(F.transform("source_event_ids", lambda i: i.cast("string"))), ",")
    return checked.select("event_id", ids.alias("source_event_ids"), "max_source_us",
                          (F.size("errors") > 0).alias("late"))


FLAG = "len(list_filter(objects, lambda o: {}))  > 0"
TOK = "replace(replace(lower(trim(coalesce(o.object_type,'') || ' ' || coalesce(o.object_id,''))),'-','_'),' ','_')"


def _duck_words(words):
    return "(" + " OR ".join(f"contains({TOK}, '{w}')" for w in words) + ")"


DOOR = _duck_words(("door", "gate", "window", "access"))
TOY = _duck_words(("toy", "play"))
FOOD = _duck_words(("food", "feeder", "bowl", "meal", "kitchen"))
NEAR = "list_min(list_transform(list_filter(social, lambda s: s.entity_type = 'human' AND s.distance_m IS NOT NULL), lambda s: s.distance_m))"
CONTEXT_SQL = f"""coalesce(location, '__missing__') AS location_value, len(objects)::DOUBLE AS n_objects,
 len(list_filter(social, lambda s: s.entity_type = 'human'))::DOUBLE AS n_humans,
 len(list_filter(social, lambda s: s.entity_type = 'peer'))::DOUBLE AS n_peers,
 coalesce({NEAR}, -1.0) AS nearest_human_m, ({NEAR} IS NULL)::DOUBLE AS nearest_human_m_missing,
 ({FLAG.format(DOOR)})::DOUBLE AS door_present, ({FLAG.format(DOOR + ' AND o.open')})::DOUBLE AS door_open,
 ({FLAG.format(DOOR + ' AND NOT o.open')})::DOUBLE AS door_closed, ({FLAG.format(TOY)})::DOUBLE AS toy_present,
 ({FLAG.format(FOOD)})::DOUBLE AS food_area_present"""


@query("context_features", "P15 P11", SQL_DOCS + f" SELECT event_id, {CONTEXT_SQL} FROM v_docs")
def context_features(spark, sf):
    return documents(spark, sf).select("event_id", *[c.alias(k) for k, c in context.context_features().items()])


@query("keyword_categories", "P10 P11 F1", SQL_DOCS + """
, a AS (SELECT event_id, unnest(human_actions) AS x FROM v_docs),
t AS (SELECT event_id, x.action_id AS action_id, replace(replace(lower(trim(x.action_type)),'-','_'),' ','_') AS token FROM a)
SELECT event_id, action_id, token,
 CASE WHEN contains(token,'feed') OR contains(token,'food') OR contains(token,'meal') THEN 'food'
      WHEN contains(token,'play') OR contains(token,'toy') THEN 'play'
      WHEN contains(token,'door') OR contains(token,'access') OR contains(token,'gate') OR contains(token,'window') THEN 'access'
      WHEN contains(token,'contact') OR contains(token,'pet') OR contains(token,'stroke') OR contains(token,'call')
           OR contains(token,'acknowledge') OR contains(token,'social') THEN 'social' END AS category,
 contains(token,'toy') OR contains(token,'play') AS toy_flag FROM t""")
def keyword_categories(spark, sf):
    a = documents(spark, sf).select("event_id", F.explode("human_actions").alias("x")).select("event_id", "x.*")
    return a.select("event_id", "action_id", norm_token("action_type").alias("token"),
                    keyword_category("action_type").alias("category"), keyword_flags("action_type")["toy"].alias("toy_flag"))


STAMPED = """list_transform(list_filter(outcomes, lambda o: o.outcome_type = 'signalling_termination' AND o.signalling_terminated IS NOT NULL),
 lambda o: {'v': o.signalling_terminated, 't': coalesce(o.end_offset_ms, o.start_offset_ms)})"""
LABEL_SQL = f"""
 SELECT *, list_filter(st, lambda s: s.t <= 60000) AS kept FROM (SELECT *, {STAMPED} AS st FROM v_docs)"""
LABEL_SQL2 = f"""
 SELECT *, list_distinct(list_transform(kept, lambda s: s.v)) AS vals, list_max(list_transform(kept, lambda s: s.t)) AS last_t
 FROM ({LABEL_SQL})"""
LABEL_SQL3 = f"""
 SELECT *, coalesce(len(vals) = 1 AND NOT vals[1] AND last_t < 60000, false) AS early,
   len(list_filter(st, lambda s: s.t > 60000)) > 0 AS beyond FROM ({LABEL_SQL2})"""
LABEL_VIEW = f"""
 SELECT *, CASE WHEN len(vals) = 1 AND NOT early THEN vals[1] END AS label,
   concat_ws(';', CASE WHEN len(vals) > 1 THEN 'contradictory_outcomes' END, CASE WHEN early THEN 'false_before_horizon' END,
             CASE WHEN beyond THEN 'outcome_after_horizon' END) AS label_errors FROM ({LABEL_SQL3})"""


@query("termination_label", "P12", SQL_DOCS + f" SELECT event_id, label, label_errors FROM ({LABEL_VIEW})")
def termination_label(spark, sf):
    label, errors = context.termination_label()
    return documents(spark, sf).select("event_id", label.alias("label"),
                                       F.array_join(F.array_sort(errors), ";").alias("label_errors"))


@query("termination_before", "P13 F3", SQL_DOCS + """
, o AS (SELECT event_id, start_us, unnest(outcomes) AS x FROM v_docs),
k AS (SELECT event_id, x.signalling_terminated AS v, start_us + x.start_offset_ms * 1000 AS t, start_us + 30000000 AS cut FROM o
      WHERE x.outcome_type = 'signalling_termination' AND x.signalling_terminated IS NOT NULL),
g AS (SELECT event_id, count(DISTINCT v) AS n, bool_or(v) AS v, max(t) AS t FROM k WHERE t <= cut GROUP BY event_id)
SELECT d.event_id, CASE WHEN n = 1 THEN v END AS value, CASE WHEN n = 1 THEN t END AS observed_us,
       coalesce(n > 1, false) AS contradictory FROM v_docs d LEFT JOIN g USING (event_id)""")
def termination_before(spark, sf):
    value, latest, clash = context.termination_before(cutoff=F.col("start_us") + 30000000)
    return documents(spark, sf).select("event_id", value.alias("value"), latest.alias("observed_us"),
                                       clash.alias("contradictory"))


@query("outcome_state", "P14", SQL_DOCS + """
 SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'open'
   WHEN outcomes[1].outcome_type = 'signalling_termination' THEN
     CASE WHEN coalesce(outcomes[1].signalling_terminated, false) THEN 'terminated' ELSE 'continued' END
   WHEN outcomes[1].outcome_type = 'unknown' THEN 'unknown' ELSE 'other' END AS state FROM v_docs""")
def outcome_state(spark, sf):
    return documents(spark, sf).select("event_id", context.outcome_state(F.expr("event_id % 4 <> 3")).alias("state"))


HEX = "regexp_full_match(o.{}, '[0-9a-fA-F]{{64}}')"
PROV = "coalesce(o.schema_ref = 'pose-package-v1' AND o.sidecar_version = 'v0' AND o.artifact_kind = 'pose_features_json' AND NOT o.local_path_included AND " + " AND ".join(
    HEX.format(c) for c in ("artifact_sha256", "reservation_sha256", "sealed_record_sha256", "producer_sha256")) + (
    " AND o.package_version = 'v0' AND o.package_event = event_id AND o.package_episode = episode_id AND o.package_subject = subject_id AND o.package_sequence <> ''"
    " AND o.window_start_ms = o.start_offset_ms AND o.window_end_ms = o.end_offset_ms AND o.observation_count >= 1 AND o.sample_count >= 1 AND o.source_media_count >= 1, false)")


def duck_refs(cond):
    return (f"list_sort(list_transform(list_filter(observations, lambda o: {cond}), lambda o: o.observation_ref))")


WINDOW_COLS = f"""
 {duck_refs("o.modality = 'visual_pose' AND o.end_offset_ms <= 5000 AND (" + PROV + ")")} AS v_ok,
 {duck_refs("o.modality = 'visual_pose' AND o.end_offset_ms > 5000")} AS v_late,
 {duck_refs("o.modality = 'visual_pose' AND o.end_offset_ms <= 5000 AND NOT (" + PROV + ")")} AS v_bad,
 {duck_refs("o.modality = 'audio_vocalisation' AND o.end_offset_ms <= 5000")} AS a_ok,
 {duck_refs("o.modality = 'audio_vocalisation' AND o.end_offset_ms > 5000")} AS a_late"""


@query("evidence_window", "P7 P8 F9", SQL_DOCS + f"""
SELECT event_id, array_to_string(v_ok, ',') AS visual_eligible, array_to_string(v_late, ',') AS visual_late,
  array_to_string(v_bad, ',') AS visual_invalid, array_to_string(a_ok, ',') AS audio_eligible, array_to_string(a_late, ',') AS audio_late
FROM (SELECT event_id, {WINDOW_COLS} FROM v_docs)""")
def evidence_window(spark, sf):
    v = context.evidence_window("visual_pose", checked=True)
    a = context.evidence_window("audio_vocalisation")
    cols = {"visual_eligible": v["eligible"], "visual_late": v["late"], "visual_invalid": v["invalid"],
            "audio_eligible": a["eligible"], "audio_late": a["late"]}
    return documents(spark, sf).select("event_id", *[F.array_join(c, ",").alias(k) for k, c in cols.items()])


@query("snapshot_context", "P9", SQL_DOCS + """, s AS (SELECT event_id, list_filter(observations, lambda o: o.modality = 'object_environment') AS s FROM v_docs),
x AS (SELECT event_id, CASE WHEN len(s) = 1 AND s[1].start_offset_ms = 0 AND s[1].end_offset_ms >= 0 THEN s[1] END AS x FROM s)
SELECT event_id, x.observation_ref AS snapshot_ref, x.location AS location, CASE WHEN x IS NULL THEN 'no_single_snapshot_at_zero' ELSE '' END AS errors FROM x""")
def snapshot_context(spark, sf):
    return context.snapshot_context(documents(spark, sf)).select("event_id", "snapshot_ref", "location", F.array_join("errors", ";").alias("errors"))


@query("redistribution_gate", "P6", """
SELECT doc_id, source IN ('web','books','wiki') AND lang IN ('en','fr') AS admitted,
  CASE WHEN NOT source IN ('web','books','wiki') THEN 'source_kind_not_admitted'
       WHEN NOT lang IN ('en','fr') THEN 'redistribution_not_allowed' END AS reason FROM documents""")
def redistribution_gate(spark, sf):
    kind = F.when(F.col("source").isin("web", "books", "wiki"), "owned").otherwise("licensed")
    terms = F.when(F.col("lang").isin("en", "fr"), "allowed").otherwise("denied")
    ok, why = context.redistribution_gate(kind, terms)
    return views.table(spark, sf, "documents").select("doc_id", ok.alias("admitted"), why.alias("reason"))


@query("iso_time_functions", "F2 E20", SQL_DOCS + """
SELECT event_id, (start_us // 1000000) * 1000000 AS parsed_us, round(sin(2 * pi() * h / 24), 6) + 0.0 AS hour_sin,
  round(cos(2 * pi() * h / 24), 6) + 0.0 AS hour_cos
FROM (SELECT event_id, start_us, substr(start_time, 12, 2)::DOUBLE + substr(start_time, 15, 2)::DOUBLE / 60
      + substr(start_time, 18, 2)::DOUBLE / 3600 AS h FROM v_docs)""")
def iso_time_functions(spark, sf):
    s, c = cyclic_hour(local_hour("start_time"))
    return documents(spark, sf).select("event_id", iso_micros("start_time").alias("parsed_us"),
                                       r6(s).alias("hour_sin"), r6(c).alias("hour_cos"))


L16_SQL = SQL_DOCS + f""",
o0 AS (SELECT event_id, count(DISTINCT x.signalling_terminated) AS n, bool_or(x.signalling_terminated) AS v,
         max(start_us + x.start_offset_ms * 1000) AS t FROM (SELECT event_id, start_us, unnest(outcomes) AS x FROM v_docs)
       WHERE x.outcome_type = 'signalling_termination' AND x.signalling_terminated IS NOT NULL GROUP BY event_id),
v_episodes AS (SELECT d.event_id, household_id, coalesce(location, '__missing__') AS location, start_us,
         CASE WHEN n = 1 THEN v END AS terminated, CASE WHEN n = 1 THEN t END AS outcome_us
       FROM v_docs d LEFT JOIN o0 USING (event_id)),
acts0 AS (SELECT event_id, household_id, start_us, unnest(human_actions) AS x FROM v_docs),
acts AS (SELECT event_id, household_id, start_us, start_us + x.offset_ms * 1000 AS action_us,
    CASE (x.action_type) WHEN ' Serve-Meal' THEN 'food' WHEN 'open door' THEN 'access' WHEN 'pet contact' THEN 'social'
      WHEN 'Play_Toy' THEN 'play' WHEN 'meal toy' THEN 'food' END AS category FROM acts0),
a AS (SELECT e.event_id, x.category, max(x.action_us) AS us FROM v_episodes e JOIN acts x ON x.household_id = e.household_id
       AND x.start_us < e.start_us AND x.action_us <= e.start_us AND x.category IS NOT NULL GROUP BY 1, 2),
ap AS (SELECT e.event_id, {ACT_COLS} FROM v_episodes e LEFT JOIN a USING (event_id) GROUP BY e.event_id, e.start_us),
p AS ({PREV_SQL}), r AS ({ROLL_SQL}),
c AS (SELECT event_id, {CONTEXT_SQL}, substr(start_time, 12, 2)::DOUBLE + substr(start_time, 15, 2)::DOUBLE / 60
      + substr(start_time, 18, 2)::DOUBLE / 3600 AS h FROM v_docs)
SELECT c.* EXCLUDE (h), ap.* EXCLUDE (event_id), r.* EXCLUDE (event_id),
  round(sin(2 * pi() * h / 24), 6) + 0.0 AS local_hour_sin, round(cos(2 * pi() * h / 24), 6) + 0.0 AS local_hour_cos,
  coalesce(p_loc, '__missing__') AS previous_location, round(coalesce((p.start_us - p_start) / 1e6, -1.0), 6) AS seconds_since_previous,
  (p_id IS NULL)::DOUBLE AS seconds_since_previous_missing, coalesce(p_term::DOUBLE, -1.0) AS previous_terminated,
  (p_term IS NULL)::DOUBLE AS previous_terminated_missing, e.terminated AS target_terminated
FROM c JOIN ap USING (event_id) JOIN r USING (event_id) JOIN p USING (event_id) JOIN v_episodes e USING (event_id)"""


@query("history_feature_rows", "L16 P16", L16_SQL)
def history_rows(spark, sf):
    out = history_feature_rows(documents(spark, sf))
    rounded = [c for c in out.columns if c.startswith(("seconds_since", "local_hour")) and not c.endswith("missing")]
    return out.drop("household_id", "start_us", "source_event_ids", "max_source_us", "excluded_fields").withColumns({c: r6(c) for c in rounded})


def rounded_rows(out):
    rounded = [c for c in out.columns if c.startswith(("seconds_since", "local_hour")) and not c.endswith("missing")]
    return out.drop("household_id", "start_us", "source_event_ids", "max_source_us", "excluded_fields").withColumns({c: r6(c) for c in rounded})


@query("history_feature_rows_absent", "L16", L16_SQL.replace(SQL_DOCS, SQL_SPARSE_EMPTY))
def history_rows_absent(spark, sf):
    """Episodes whose arrays are absent keep their row."""
    return rounded_rows(history_feature_rows(sparse_documents(spark, sf)))


def nested_json(docs):
    """The flat documents in the nested form of episode files."""
    # Named twice, an array stays a column of the projection below, where it is compiled; as a lambda's argument it would be interpreted.
    items = lambda c, f: F.when(F.col(c).isNotNull(), F.transform(c, f)) if isinstance(c, str) else F.transform(c, f)
    return docs.select(
        "schema_version", F.col("event_id").cast("string").alias("event_id"), "episode_id", F.col("subject_id").cast("string").alias("subject_id"), F.col("household_id").cast("string").alias("household_id"), "missing_modalities",
        F.struct("start_time", "end_time", F.lit(0).alias("start_offset_ms"), "end_offset_ms").alias("time"), "hypotheses", "human_actions",
        items("observations", lambda o: F.struct(*[o[c].alias(c) for c in ("observation_ref", "modality", "schema_ref", "start_offset_ms", "end_offset_ms")])).alias("observations"),
        items("interventions", lambda i: F.struct(i["intervention_id"].alias("intervention_id"), i["action_ref"].alias("action_ref"), i["candidates"].alias("candidate_hypotheses"),
                                                  F.transform(i["predictions"], lambda p: F.struct(p.alias("hypothesis_ref"))).alias("predictions"))).alias("interventions"),
        items("outcomes", lambda o: F.struct(*[o[c].alias(c) for c in ("outcome_id", "outcome_type", "signalling_terminated", "start_offset_ms", "end_offset_ms")], o["supports"].alias("supports_hypotheses"))).alias("outcomes"),
        F.struct("location", items("objects", lambda o: F.struct(o["object_type"].alias("object_type"), o["object_id"].alias("object_id"), F.create_map(F.lit("open"), o["open"].cast("string")).alias("state"))).alias("objects"), "social").alias("context"))


def read_nested(spark, sf):
    path = scratch_path(spark, "nested")
    nested_json(sparse_documents(spark, sf)).write.json(path)
    flat = flatten_episodes(read_episodes(spark, path, multi_line=False))
    return flat.withColumn("event_id", F.col("event_id").cast("long"))


@query("history_rows_from_files", "L16 S3", L16_SQL.replace(SQL_DOCS, SQL_NESTED_EMPTY))
def history_rows_from_files(spark, sf):
    """Nested files with absent arrays, read, flattened and turned into history rows."""
    return rounded_rows(history_feature_rows(read_nested(spark, sf)))


@query("episode_errors_from_files", "V1 S3", absent_errors(SQL_NESTED) + " SELECT d.event_id, coalesce(string_agg(DISTINCT code, ';' ORDER BY code), '') AS errors FROM v_docs d LEFT JOIN ee USING (event_id) GROUP BY 1")
def episode_errors_from_files(spark, sf):
    return ct.validate_episodes(read_nested(spark, sf)).select("event_id", F.array_join("errors", ";").alias("errors"))


@query("history_exclusions", "V10", """SELECT event_id, concat_ws(';', CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN 'excluded_fields_missing' END,
 CASE WHEN event_id % 5 = 4 THEN 'history_after_prediction_time' END) AS errors FROM events""")
def history_exclusions(spark, sf):
    named = ", ".join(f"'{f}'" for f in history.EXCLUDED_FIELDS)
    rows = views.table(spark, sf, "events").selectExpr("event_id", "event_id AS start_us", "event_id + event_id % 5 - 3 AS max_source_us",
                                                       f"CASE WHEN event_id % 7 = 0 THEN array('observations') WHEN event_id % 11 > 0 THEN array({named}) END AS excluded_fields")
    return history.validate_history(rows).select("event_id", F.array_join("errors", ";").alias("errors"))


@query("history_features", "L16 J2 J3 E5 E20", EP + f""", a AS ({ACT_SQL}), p AS ({PREV_SQL}), r AS ({ROLL_SQL}),
ap AS (SELECT e.event_id, {ACT_COLS} FROM v_episodes e JOIN a USING (event_id) GROUP BY e.event_id, e.start_us)
SELECT ap.*, r.* EXCLUDE (event_id), coalesce(p_loc, '__missing__') AS previous_location,
  round(coalesce((p.start_us - p_start) / 1e6, -1.0), 6) AS seconds_since_previous,
  (p_id IS NULL)::DOUBLE AS seconds_since_previous_missing, coalesce(p_term::DOUBLE, -1.0) AS previous_terminated,
  (p_term IS NULL)::DOUBLE AS previous_terminated_missing, p_id AS previous_event_id
FROM ap JOIN r USING (event_id) JOIN p USING (event_id)""")
def history_features(spark, sf):
    t = history.timeline(flat_episodes(spark, sf))
    out = t.select("event_id", *history.action_columns(), "episodes_last_1h", "episodes_last_24h",
                   *history.previous_columns())
    rounded = [c for c in out.columns if c.startswith("seconds_since") and not c.endswith("missing")]
    return out.withColumns({c: r6(c) for c in rounded})
