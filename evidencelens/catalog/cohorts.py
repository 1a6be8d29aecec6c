"""Cohort manifests, locks, enrichment, keyed comparison and ablation decisions."""

from pyspark.sql import functions as F

from evidencelens.catalog import query
from evidencelens.catalog.contracts import EPISODE_ERRORS, PACKAGE_SQL, SIDE_SQL, packages, sidecars, text
from evidencelens.catalog.history import LABEL_VIEW, WINDOW_COLS
from evidencelens.docs_view import documents
from evidencelens.functions import r6
from evidencelens.operators import cohorts as co
from evidencelens.plans.cohort import cohort_manifest, result_packets
from evidencelens.views import table

SUPPORT = EPISODE_ERRORS + f""", eg AS (SELECT event_id, list_sort(list_distinct(list(code))) AS codes FROM ee GROUP BY 1), lb AS (SELECT event_id, label, label_errors FROM ({LABEL_VIEW})),
wn AS (SELECT event_id, episode_id, household_id, missing_modalities AS mm, list_distinct(list_transform(observations, lambda o: o.modality)) AS seen, {WINDOW_COLS} FROM v_docs),
s0 AS (SELECT wn.*, coalesce(codes, []) AS codes, codes IS NULL AS b0, label, label_errors, array_to_string(list_sort(list_intersect(seen, mm)), ',') AS cf FROM wn LEFT JOIN eg USING (event_id) JOIN lb USING (event_id)),
su AS (SELECT *, b0 AND len(v_ok) > 0 AND NOT list_contains(mm, 'visual_pose') AS v1, b0 AND len(a_ok) > 0 AND NOT list_contains(mm, 'audio_vocalisation') AS a1,
  b0 AND label IS NOT NULL AND label_errors = '' AS target, cf <> '' AS conflict FROM s0)"""
REASONS = """list_distinct(list_concat(list_transform(codes, lambda c: 'contract:' || c), CASE WHEN b0 AND label_errors <> '' THEN list_transform(string_split(label_errors, ';'), lambda c: 'target:' || c) ELSE [] END,
 list_filter([CASE WHEN conflict THEN 'modality_conflict:' || cf END, CASE WHEN (NOT b0) OR (label IS NULL AND label_errors = '') THEN 'target:missing' END,
  CASE WHEN len(v_bad) > 0 THEN 'V1:invalid_provenance:' || array_to_string(v_bad, ',') END, CASE WHEN len(v_ok) = 0 THEN 'V1:none_in_window' END, CASE WHEN len(a_ok) = 0 THEN 'A1:none_in_window' END], lambda r: r IS NOT NULL)))"""


def support(spark, sf):
    return co.event_support(documents(spark, sf))


@query("event_support", "L15 P7 P8 P12 J12 T2", SUPPORT + f""" SELECT event_id, b0, v1, a1, target, CASE WHEN target THEN label END AS label, conflict, b0 AND v1 AND a1 AND target AND NOT conflict AS eligible,
 array_to_string(list_sort({REASONS}), ';') AS reasons FROM su""")
def event_support(spark, sf):
    return support(spark, sf).drop("episode_id", "household_id").withColumn("reasons", F.array_join("reasons", ";"))


@query("complete_case", "J12", SUPPORT + " SELECT episode_id FROM su WHERE b0 AND v1 AND a1 AND target AND NOT conflict")
def complete_case(spark, sf):
    return co.complete_case(support(spark, sf))


COUNTS = """count(*) AS received, count(*) FILTER (WHERE target) AS labelled, count(*) FILTER (WHERE b0) AS b0, count(*) FILTER (WHERE v1) AS v1, count(*) FILTER (WHERE a1) AS a1, count(*) FILTER (WHERE v1 AND a1) AS v1_a1,
 count(*) FILTER (WHERE b0 AND v1 AND a1) AS b0_v1_a1, count(*) FILTER (WHERE b0 AND v1 AND a1 AND target AND NOT conflict) AS primary_cases, count(*) FILTER (WHERE v1 AND a1) AS pattern_both,
 count(*) FILTER (WHERE v1 AND NOT a1) AS pattern_v1_only, count(*) FILTER (WHERE a1 AND NOT v1) AS pattern_a1_only, count(*) FILTER (WHERE NOT v1 AND NOT a1) AS pattern_neither"""


@query("cohort_support", "A23", SUPPORT + f" SELECT household_id, {COUNTS} FROM su GROUP BY 1")
def cohort_support(spark, sf):
    return co.cohort_support(support(spark, sf), ["household_id"])


@query("cohort_manifest", "L15 A21 A23", SUPPORT + f""", c AS (SELECT {COUNTS} FROM su), p AS (SELECT coalesce(sha256(string_agg(episode_id, chr(10) ORDER BY episode_id)), sha256('')) AS d, count(*) AS n
  FROM su WHERE b0 AND v1 AND a1 AND target AND NOT conflict)
SELECT received, labelled, primary_cases, 0 AS duplicate_event_ids, 0 AS duplicate_episode_ids, d AS primary_episode_sha256, n AS primary_ids, u.r AS row_id FROM c, p, (SELECT unnest(['B0','V','A','BV','BA','VA','BVA','BVA-V','BVA-A']) AS r) u""")
def manifest(spark, sf):
    return cohort_manifest(documents(spark, sf)).select("row_id", "received", "labelled", "primary_cases", "duplicate_event_ids", "duplicate_episode_ids", "primary_ids", "primary_episode_sha256")


@query("id_set_digest", "A21", """SELECT l_suppkey, count(DISTINCT l_orderkey) AS n_ids, sha256(string_agg(DISTINCT l_orderkey::VARCHAR, chr(10) ORDER BY l_orderkey::VARCHAR)) AS digest FROM lineitem GROUP BY 1""")
def id_set_digest(spark, sf):
    return co.id_set_digest(table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey").distinct(), ["l_suppkey"], "l_orderkey")


@query("id_set_digest_whole", "A21", """SELECT count(DISTINCT l_orderkey) AS n_ids, sha256(string_agg(DISTINCT l_orderkey::VARCHAR, chr(10) ORDER BY l_orderkey::VARCHAR)) AS digest FROM lineitem""")
def id_set_digest_whole(spark, sf):
    return co.id_set_digest(table(spark, sf, "lineitem").select("l_orderkey").distinct(), [], "l_orderkey")


@query("package_counts", "A22", PACKAGE_SQL + """o2 AS (SELECT event_id % 10 AS k, event_id, x.sample_pos AS p, x.observation_class AS c, x.evidence_tier AS t, x.quality AS q FROM ob)
SELECT k, 'samples' AS kind, '' AS value, count(DISTINCT (event_id, p)) AS n FROM o2 GROUP BY 1 UNION ALL SELECT k, 'all' AS kind, '' AS value, count(*) AS n FROM o2 GROUP BY 1 UNION ALL SELECT k, 'observation_class', c, count(*) FROM o2 GROUP BY 1, 3 UNION ALL SELECT k, 'evidence_tier', t, count(*) FROM o2 GROUP BY 1, 3
UNION ALL SELECT k, 'quality', q, count(*) FROM o2 GROUP BY 1, 3""")
def package_counts(spark, sf):
    obs = packages(spark, sf).select("event_id", (F.col("event_id") % 10).alias("k"), F.explode("observations").alias("o")).select("k", "event_id", "o.sample_pos", "o.observation_class", "o.evidence_tier", "o.quality")
    return co.package_counts(obs, ["k"], ["event_id", "sample_pos"])


# ---- locks ---------------------------------------------------------------------------------------

LOCK = """l AS (SELECT event_id, event_id % 10 AS household_id, epoch_us(ts) AS start_us, event_id % 13 <> 0 AS has, event_id % 4 < 3 AS fin, event_id % 29 = 1 AS bv, event_id % 31 = 1 AS be, event_id % 37 = 1 AS bp, event_id % 41 = 1 AS ba,
  event_id % 43 = 1 AS bn, event_id % 47 = 1 AS bc, CASE WHEN event_id % 4 < 3 THEN CASE WHEN event_id % 53 = 1 THEN 0 ELSE 1 END ELSE CASE WHEN event_id % 59 = 1 THEN 1 ELSE 0 END END AS n_out,
  CASE event_id % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'other' ELSE 'signalling_termination' END AS ot, value > 20 AS tv FROM events),
r AS (SELECT *, has AND fin AS finalized, concat_ws(';', CASE WHEN has AND ba THEN 'action_count_differs' END, CASE WHEN has AND bn THEN 'action_digest_differs' END, CASE WHEN has AND fin AND bc THEN 'completed_digest_differs' END,
  CASE WHEN has AND fin AND n_out = 0 THEN 'finalized_without_outcome' END, CASE WHEN has AND be THEN 'lock_event_differs' END, CASE WHEN NOT has THEN 'lock_missing' END, CASE WHEN has AND bv THEN 'lock_version_unsupported' END,
  CASE WHEN has AND NOT fin AND n_out > 0 THEN 'outcome_without_finalization' END, CASE WHEN has AND bp THEN 'predictor_digest_differs' END) AS errors,
  CASE WHEN NOT (has AND fin) OR n_out = 0 THEN 'open' WHEN ot = 'signalling_termination' THEN CASE WHEN tv THEN 'terminated' ELSE 'continued' END ELSE ot END AS outcome_state FROM l)"""


def records(spark, sf):
    e = table(spark, sf, "events")
    n_out = "IF(event_id % 4 < 3, IF(event_id % 53 = 1, 0, 1), IF(event_id % 59 = 1, 1, 0))"
    one = "array(named_struct('outcome_type', CASE event_id % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'other' ELSE 'signalling_termination' END, 'signalling_terminated', value > 20))"
    events = e.selectExpr("event_id", "event_id % 10 AS household_id", "unix_micros(CAST(ts AS timestamp)) AS start_us", "sha2(CAST(event_id AS string), 256) AS predictor_digest",
                          "sha2(concat('a', event_id), 256) AS action_digest", "event_id % 3 AS action_count", "sha2(concat('e', event_id), 256) AS event_digest", f"{n_out} AS n_outcomes", f"slice({one}, 1, {n_out}) AS outcomes")
    locks = e.where("event_id % 13 <> 0").selectExpr(
        "event_id", "IF(event_id % 29 = 1, 'v9', 'v0') AS version", "IF(event_id % 31 = 1, event_id + 1, event_id) AS lock_event_id", "IF(event_id % 37 = 1, 'x', sha2(CAST(event_id AS string), 256)) AS predictor_digest",
        "IF(event_id % 43 = 1, 'x', sha2(concat('a', event_id), 256)) AS action_digest", "event_id % 3 + IF(event_id % 41 = 1, 1, 0) AS action_count", "IF(event_id % 47 = 1, 'x', sha2(concat('e', event_id), 256)) AS completed_digest",
        "event_id % 4 < 3 AS finalized")
    return co.lock_integrity(events, locks)


@query("lock_integrity", "J11 P14", "WITH " + LOCK + " SELECT event_id, finalized, errors, outcome_state FROM r")
def lock_integrity(spark, sf):
    return records(spark, sf).select("event_id", "finalized", F.array_join("errors", ";").alias("errors"), "outcome_state")


@query("capture_status", "A24", "WITH " + LOCK + """ SELECT household_id, count(*) AS records, count(*) FILTER (WHERE NOT finalized) AS open_records, count(*) FILTER (WHERE finalized) AS finalized_records,
 count(*) FILTER (WHERE finalized AND errors = '') AS ready, count(*) FILTER (WHERE errors <> '') AS invalid, count(*) FILTER (WHERE finalized AND errors = '' AND outcome_state = 'terminated') AS terminated,
 count(*) FILTER (WHERE finalized AND errors = '' AND outcome_state = 'continued') AS continued, count(*) FILTER (WHERE finalized AND errors = '' AND outcome_state = 'unknown') AS unknown, 0 AS duplicate_ids,
 count(*) FILTER (WHERE finalized AND errors = '') >= 10 AS target_reached FROM r GROUP BY 1""")
def capture_status(spark, sf):
    return co.capture_status(records(spark, sf), ["household_id"])


@query("bundle_ready", "K12", "WITH " + LOCK + """, k AS (SELECT *, event_id // 8 AS bundle FROM r) SELECT bundle, event_id, start_us, sha256('e' || event_id) AS event_digest, outcome_state FROM k WHERE finalized
 AND bundle NOT IN (SELECT bundle FROM k WHERE errors <> '')""")
def bundle_ready(spark, sf):
    return co.bundle_ready(records(spark, sf).withColumn("bundle", F.expr("event_id div 8")), ["bundle"])


@query("canonical_minus_derived", "T5", "SELECT event_id, event_id % 6 = 0 AS derived FROM events")
def canonical_minus_derived(spark, sf):
    d = table(spark, sf, "events").selectExpr("event_id", "IF(event_id % 6 = 0, map('sensor_composer', 'v0'), IF(event_id % 6 = 1, map('other', 'v1'), NULL)) AS software_versions")
    canonical, derived = co.canonical_minus_derived(d, "sensor_composer")
    return canonical.select("event_id", F.lit(False).alias("derived")).unionByName(derived.select("event_id", F.lit(True).alias("derived")))


ENRICH = SIDE_SQL + """s2 AS (SELECT event_id, event_id // 3 AS ev, modality, state, CASE WHEN event_id % 83 = 0 THEN 'o0' ELSE 'o' || (event_id % 3) END AS oref FROM sc WHERE state = 'sealed' AND event_id % 71 > 0),
g AS (SELECT ev, list(oref ORDER BY event_id) AS refs, list(modality ORDER BY event_id) AS mods, list('rec' || event_id % 5 ORDER BY event_id) AS recs, bool_or(event_id % 7 = 0) AS ha, bool_or(event_id % 11 = 0) AS hi, bool_or(event_id % 19 = 0) AS bad FROM s2 GROUP BY 1)"""


@query("compose_enriched", "J9 T6", ENRICH + """ SELECT ev AS event_id, array_to_string(list_concat(['base', CASE WHEN ev % 23 = 0 THEN 'o2' ELSE 'b2' END], refs), ',') AS observation_refs,
 array_to_string(list_filter(['thermal', 'visual_pose', 'audio_vocalisation'], lambda m: NOT list_contains(mods, m)), ',') AS missing_after,
 array_to_string(list_concat(['rec1', 'src'], list_filter(recs, lambda r, i: r <> 'rec1' AND NOT list_contains(recs[1:i-1], r))), ',') AS source_ids, ha OR ev % 13 = 0 AS human_audio, hi AS human_image, len(refs) AS n_sidecars,
 concat_ws(';', CASE WHEN ev % 23 = 0 AND list_contains(refs, 'o2') THEN 'observation_ref_collides' END, CASE WHEN bad THEN 'sidecar_not_valid' END, CASE WHEN len(list_distinct(refs)) < len(refs) THEN 'sidecar_refs_not_unique' END) AS errors FROM g""")
def compose_enriched(spark, sf):
    s = sidecars(spark, sf).where("state = 'sealed' AND event_id % 71 > 0").selectExpr(
        "event_id div 3 AS event_id", "event_id AS ord", "IF(event_id % 83 = 0, 'o0', concat('o', event_id % 3)) AS observation_ref", "modality", "concat('rec', event_id % 5) AS record_id",
        "concat('/local/', event_id) AS local_path", "event_id % 7 = 0 AS human_audio", "event_id % 11 = 0 AS human_image", "IF(event_id % 19 = 0, array('x'), CAST(array() AS array<string>)) AS seal_errors")
    events = table(spark, sf, "events").selectExpr(
        "event_id", "array('base', IF(event_id % 23 = 0, 'o2', 'b2')) AS observation_refs", "array('thermal', 'visual_pose', 'audio_vocalisation') AS missing_modalities", "array('rec1', 'src') AS source_ids",
        "array('captured') AS lineage", "event_id % 13 = 0 AS contains_human_audio", "false AS contains_human_image")
    out = co.compose_enriched(events, s)
    j = lambda c: F.array_join(c, ",")
    return out.select("event_id", j("observation_refs_all").alias("observation_refs"), j("missing_after").alias("missing_after"), j("source_ids_all").alias("source_ids"), F.col("contains_human_audio").alias("human_audio"),
                      F.col("contains_human_image").alias("human_image"), (F.size("observation_refs_all") - 2).cast("long").alias("n_sidecars"), F.array_join("errors", ";").alias("errors"))


@query("modality_conflicts", "T2", SUPPORT + " SELECT event_id, cf AS conflicts FROM su")
def modality_conflicts(spark, sf):
    c = F.array_sort(F.array_intersect(F.transform("observations", lambda o: o["modality"]), "missing_modalities"))
    return documents(spark, sf).select("event_id", F.array_join(c, ",").alias("conflicts"))


# ---- keyed comparison ----------------------------------------------------------------------------


@query("tolerance_diff", "J13 F10", """
WITH t AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1),
e AS (SELECT k, CASE WHEN k % 11 = 3 THEN 'text' ELSE 'number' END AS ty, s AS num, k::VARCHAR AS txt FROM t WHERE k % 13 <> 4),
a AS (SELECT k, CASE WHEN k % 11 = 3 AND k % 2 = 0 THEN 'text' WHEN k % 11 = 3 THEN 'boolean' ELSE 'number' END AS ty, CASE WHEN k % 7 = 0 THEN s * 1.001 ELSE s + 1e-9 END AS num, CASE WHEN k % 4 = 0 THEN 'other' ELSE k::VARCHAR END AS txt FROM t WHERE k % 17 <> 5),
j AS (SELECT coalesce(e.k, a.k) AS k, CASE WHEN a.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'unexpected' WHEN e.ty <> a.ty THEN 'type_change'
  WHEN e.ty = 'number' AND abs(e.num - a.num) > greatest(1e-6 * greatest(abs(e.num), abs(a.num)), 1e-8) THEN 'value_differs' WHEN e.ty = 'text' AND e.txt <> a.txt THEN 'value_differs' END AS problem FROM e FULL JOIN a ON e.k = a.k)
SELECT k, problem FROM j WHERE problem IS NOT NULL""")
def tolerance_diff(spark, sf):
    t = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("s"))
    e = t.where("k % 13 <> 4").selectExpr("k", "IF(k % 11 = 3, 'text', 'number') AS type", "s AS num", "CAST(k AS string) AS txt")
    a = t.where("k % 17 <> 5").selectExpr("k", "CASE WHEN k % 11 = 3 AND k % 2 = 0 THEN 'text' WHEN k % 11 = 3 THEN 'boolean' ELSE 'number' END AS type",
                                          "IF(k % 7 = 0, s * 1.001D, s + 1e-9D) AS num", "IF(k % 4 = 0, 'other', CAST(k AS string)) AS txt")
    return co.tolerance_diff(e, a, ["k"], rel=1e-6)


@query("named_conformance", "J14", """
WITH e AS (SELECT o_orderkey AS name, o_totalprice AS x, o_custkey::DOUBLE AS y FROM orders WHERE o_orderkey % 13 <> 2),
a AS (SELECT o_orderkey AS name, o_totalprice + CASE WHEN o_orderkey % 5 = 0 THEN 0.5 ELSE 0.0001 END AS x, CASE WHEN o_orderkey % 7 = 0 THEN 'nan'::DOUBLE ELSE o_custkey END AS y FROM orders WHERE o_orderkey % 11 <> 3
  UNION ALL SELECT o_orderkey, 0, 0 FROM orders WHERE o_orderkey % 19 = 6),
g AS (SELECT name, count(*) AS n, max(x) AS x, max(y) AS y FROM a GROUP BY 1)
SELECT coalesce(g.name, e.name) AS name, concat_ws(';', CASE WHEN g.name IS NOT NULL AND e.name IS NOT NULL AND abs(g.x - e.x) > 0.01 THEN 'differs:x' END,
 CASE WHEN g.name IS NOT NULL AND e.name IS NOT NULL AND NOT isnan(g.y) AND abs(g.y - e.y) > 0.01 THEN 'differs:y' END, CASE WHEN n > 1 THEN 'duplicate' END, CASE WHEN g.name IS NULL THEN 'missing' END,
 CASE WHEN g.name IS NOT NULL AND e.name IS NOT NULL AND isnan(g.y) THEN 'not_finite:y' END, CASE WHEN e.name IS NULL THEN 'unexpected' END) AS errors FROM g FULL JOIN e ON g.name = e.name""")
def named_conformance(spark, sf):
    o = table(spark, sf, "orders")
    e = o.where("o_orderkey % 13 <> 2").selectExpr("o_orderkey AS name", "o_totalprice AS x", "CAST(o_custkey AS double) AS y")
    a = o.where("o_orderkey % 11 <> 3").selectExpr("o_orderkey AS name", "o_totalprice + IF(o_orderkey % 5 = 0, 0.5D, 0.0001D) AS x", "IF(o_orderkey % 7 = 0, double('NaN'), CAST(o_custkey AS double)) AS y")
    a = a.unionByName(o.where("o_orderkey % 19 = 6").selectExpr("o_orderkey AS name", "0.0D AS x", "0.0D AS y"))
    return text(co.named_conformance(a, e, "name", ["x", "y"], 0.01), "name")


@query("cohort_equality", "T4", """WITH a AS (SELECT DISTINCT l_suppkey AS k, l_orderkey AS id FROM lineitem WHERE l_suppkey % 5 > 0 OR l_linenumber <> 3), b AS (SELECT DISTINCT l_suppkey AS k, l_orderkey AS id FROM lineitem WHERE l_suppkey % 7 > 0 OR l_linenumber <> 2),
j AS (SELECT coalesce(a.k, b.k) AS k, a.id IS NOT NULL AS ia, b.id IS NOT NULL AS ib FROM a FULL JOIN b ON a.k = b.k AND a.id = b.id)
SELECT k, count(*) FILTER (WHERE NOT ib) AS only_a, count(*) FILTER (WHERE NOT ia) AS only_b, count(*) FILTER (WHERE NOT (ia AND ib)) = 0 AS equal FROM j GROUP BY 1""")
def cohort_equality(spark, sf):
    li = table(spark, sf, "lineitem")
    pick = lambda w: li.where(w).select(F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("id"))
    return co.cohort_equality(pick("l_suppkey % 5 > 0 OR l_linenumber <> 3"), pick("l_suppkey % 7 > 0 OR l_linenumber <> 2"), ["k"], "id")


# ---- ablation reports ----------------------------------------------------------------------------

ROWS = list(co.ABLATION_ROWS)
ROW_VALUES = ", ".join(f"('{r}', {i}, '{m}', '{','.join(sorted(x))}')" for i, (r, (m, x)) in enumerate(co.ABLATION_ROWS.items()))
ABL = f"""WITH sp(row_id, i, mode, inputs) AS (VALUES {ROW_VALUES}), rp AS (SELECT DISTINCT event_id % 40 AS report_id FROM events),
ep0 AS (SELECT event_id % 40 AS report_id, row_id, 'ep' || event_id AS episode_id FROM events CROSS JOIN sp WHERE NOT (event_id % 40 = 3 AND row_id = 'V' AND event_id % 400 = 3) AND NOT (event_id % 40 = 5 AND row_id = 'BA')),
ep AS (SELECT * FROM ep0 UNION ALL SELECT * FROM ep0 WHERE report_id = 7 AND row_id = 'A' AND episode_id = 'ep7'),
dg AS (SELECT report_id, row_id, count(*) > count(DISTINCT episode_id) AS dup, sha256(string_agg(DISTINCT episode_id, chr(10) ORDER BY episode_id)) AS d FROM ep GROUP BY 1, 2),
mt AS (SELECT report_id, row_id, i, m.metric, round((CASE WHEN report_id = 4 AND row_id = 'BV' AND metric = 'ece' THEN NULL ELSE CASE metric WHEN 'log_loss' THEN 0.5 + ((i * 7 + report_id) % 10) / 20.0 - CASE WHEN row_id = 'BVA' AND report_id % 3 > 0 THEN 0.4 ELSE 0 END
   WHEN 'ece' THEN 0.05 + CASE WHEN row_id = 'BVA' AND report_id % 4 = 1 THEN 0.06 ELSE 0 END ELSE 0.4 END END)::DOUBLE, 9) AS value FROM rp CROSS JOIN sp CROSS JOIN (VALUES ('log_loss'),('brier'),('ece'),('balanced_accuracy'),('macro_f1')) m(metric))"""


def ablation(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("event_id") % 40).alias("report_id"))
    sp = F.explode(F.array(*[F.struct(F.lit(r).alias("row_id"), F.lit(i).alias("i"), F.lit(m).alias("mode"), F.array(*[F.lit(x) for x in inputs]).alias("inputs"))
                             for i, (r, (m, inputs)) in enumerate(co.ABLATION_ROWS.items())]))
    episodes = e.select("event_id", "report_id", sp.alias("s")).select("report_id", "s.row_id", F.concat(F.lit("ep"), "event_id").alias("episode_id"), "event_id")
    episodes = episodes.where("NOT (report_id = 3 AND row_id = 'V' AND event_id % 400 = 3) AND NOT (report_id = 5 AND row_id = 'BA')").drop("event_id")
    episodes = episodes.unionByName(episodes.where("report_id = 7 AND row_id = 'A' AND episode_id = 'ep7'"))
    ids = e.select("report_id").distinct()
    # What a report declares: the digest of its episodes, which all of its rows share but V of report 3 and BA of report 5.
    own = F.filter(F.array(F.lit("all"), F.when((F.col("report_id") == 3) & (F.col("event_id") % 400 != 3), "V")), lambda x: x.isNotNull())
    sets = co.id_set_digest(e.select("report_id", F.explode(own).alias("of"), F.concat(F.lit("ep"), "event_id").alias("episode_id")), ["report_id", "of"], "episode_id", unique=True)
    of = F.when((F.col("report_id") == 3) & (F.col("row_id") == "V"), "V").when((F.col("report_id") == 5) & (F.col("row_id") == "BA"), F.lit(None)).otherwise("all")
    digest = sets.select("report_id", "of", "digest")
    rows = ids.select("report_id", sp.alias("s")).select("report_id", "s.*").withColumn("of", of).join(digest, ["report_id", "of"], "left").where("NOT (report_id = 9 AND row_id = 'VA')").selectExpr(
        "report_id", "row_id", "IF(report_id = 11 AND row_id = 'BVA-V', 'predictive', mode) AS mode", "IF(report_id = 13 AND row_id = 'B0', array('V1'), inputs) AS inputs",
        "IF(report_id = 15 AND row_id = 'V', 'x', concat('split-manifest-', report_id)) AS split_sha256", "CASE row_id WHEN 'BVA-V' THEN 'BVA/V1' WHEN 'BVA-A' THEN IF(report_id = 31, 'BVA/V1', 'BVA/A1') END AS stress",
        "IF(report_id = 33 AND row_id = 'B0', 'other/60', 'signalling_terminated/60') AS row_target", "IF(report_id = 17 AND row_id = 'A', 'x', digest) AS declared_sha256")
    metrics = ids.select("report_id", sp.alias("s")).select("report_id", "s.row_id", "s.i", F.explode(F.array(*[F.lit(x) for x in co.REQUIRED_METRICS])).alias("metric"))
    value = F.expr("""CASE WHEN report_id = 4 AND row_id = 'BV' AND metric = 'ece' THEN NULL ELSE CASE metric WHEN 'log_loss' THEN 0.5D + ((i * 7 + report_id) % 10) / 20.0D - IF(row_id = 'BVA' AND report_id % 3 > 0, 0.4D, 0D)
      WHEN 'ece' THEN 0.05D + IF(row_id = 'BVA' AND report_id % 4 = 1, 0.06D, 0D) ELSE 0.4D END END""")
    metrics = metrics.select("report_id", "row_id", "metric", value.alias("value"))
    reports = ids.selectExpr("report_id", "IF(report_id = 19, 'v9', 'v0') AS contract_version", "IF(report_id = 21, 'true_intent', 'signalling_terminated') AS target_name", "60 AS horizon_s",
                             "concat('split-manifest-', report_id) AS split_sha256", "report_id % 5 > 0 AS uncertainty_supported", "IF(report_id = 23, 'clip', 'household') AS resampling_unit",
                             "IF(report_id % 2 = 0, 'reported', 'not_applicable') AS abstention_status", "report_id % 8 > 0 AS threshold_frozen", "IF(report_id = 35, '', 'held-out households') AS claim_scope",
                             "IF(report_id = 10, NULL, 'too few units') AS uncertainty_reason", "IF(report_id = 37, NULL, 'nothing to abstain from') AS abstention_reason", "IF(report_id = 39, NULL, true) AS advancement_requested")
    probes = ids.select("report_id", F.explode(F.array(*[F.lit(p) for p in co.PROBES])).alias("probe")).where("NOT (report_id = 25 AND probe = 'location')").selectExpr(
        "report_id", "probe", "CASE WHEN report_id = 27 AND probe = 'location' THEN 'skipped' WHEN report_id = 29 AND probe = 'location' THEN 'unsupported' ELSE 'reported' END AS status", "CAST(NULL AS string) AS reason")
    diagnostics = ids.select("report_id", F.explode(F.array(*[F.lit(p) for p in co.DIAGNOSTICS])).alias("diagnostic")).where("NOT (report_id = 12 AND diagnostic = 'visual_dropout')").selectExpr(
        "report_id", "diagnostic", "CASE WHEN report_id = 14 AND diagnostic = 'visual_dropout' THEN 'lost' WHEN diagnostic = 'audio_dropout' THEN 'not_present' ELSE 'reported' END AS status",
        "IF(report_id = 18, NULL, 'no recordings') AS reason")
    return reports, rows, metrics, episodes, probes, diagnostics


@query("validate_ablation_reports", "V7 T4 A21", ABL + """, b AS (SELECT d.report_id, d.row_id, d.d <> a.d AS x FROM dg d JOIN dg a ON a.report_id = d.report_id AND a.row_id = 'B0'),
er AS (SELECT report_id, 'cohort_differs:' || row_id AS c FROM b WHERE x
 UNION ALL SELECT report_id, 'row_missing:VA' FROM rp WHERE report_id = 9 UNION ALL SELECT report_id, 'mode_differs:BVA-V' FROM rp WHERE report_id = 11 UNION ALL SELECT report_id, 'inputs_differ:B0' FROM rp WHERE report_id = 13
 UNION ALL SELECT report_id, 'split_differs:V' FROM rp WHERE report_id = 15 UNION ALL SELECT report_id, 'episodes_empty:BA' FROM rp WHERE report_id = 5 UNION ALL SELECT report_id, 'episodes_repeated:' || row_id FROM dg WHERE dup
 UNION ALL SELECT report_id, 'episode_digest_differs:A' FROM rp WHERE report_id = 17 UNION ALL SELECT report_id, 'metric_' || metric || ':' || row_id FROM mt WHERE value IS NULL
 UNION ALL SELECT report_id, 'contract_version' FROM rp WHERE report_id = 19 UNION ALL SELECT report_id, unnest(['target_differs', 'forbidden_target']) FROM rp WHERE report_id = 21
 UNION ALL SELECT report_id, 'resampling_unit_not_allowed' FROM rp WHERE report_id = 23 UNION ALL SELECT report_id, 'threshold_not_frozen' FROM rp WHERE report_id % 8 = 0
 UNION ALL SELECT report_id, 'stress_differs:BVA-A' FROM rp WHERE report_id = 31 UNION ALL SELECT report_id, 'row_target_differs:B0' FROM rp WHERE report_id = 33 UNION ALL SELECT report_id, 'claim_scope_missing' FROM rp WHERE report_id = 35
 UNION ALL SELECT report_id, 'uncertainty_reason_missing' FROM rp WHERE report_id = 10 UNION ALL SELECT report_id, 'abstention_reason_missing' FROM rp WHERE report_id = 37 UNION ALL SELECT report_id, 'advancement_not_declared' FROM rp WHERE report_id = 39
 UNION ALL SELECT report_id, 'diagnostic_missing' FROM rp WHERE report_id = 12 UNION ALL SELECT report_id, 'diagnostic_status' FROM rp WHERE report_id = 14 UNION ALL SELECT report_id, 'diagnostic_reason_missing' FROM rp WHERE report_id = 18
 UNION ALL SELECT report_id, 'probe_missing' FROM rp WHERE report_id = 25 UNION ALL SELECT report_id, 'probe_status' FROM rp WHERE report_id = 27 UNION ALL SELECT report_id, 'probe_reason_missing' FROM rp WHERE report_id = 29)
SELECT report_id, coalesce(string_agg(DISTINCT c, ';' ORDER BY c), '') AS errors FROM rp LEFT JOIN er USING (report_id) GROUP BY 1""")
def validate_ablation_reports(spark, sf):
    return text(co.validate_ablation_reports(*ablation(spark, sf)), "report_id")


@query("strongest_constituent", "K11", ABL + """ SELECT report_id, arg_min(row_id, (value * 1000)::BIGINT * 100 + i) AS strongest, round(min(value), 6) AS log_loss FROM mt WHERE metric = 'log_loss' AND i < 6 GROUP BY 1""")
def strongest_constituent(spark, sf):
    return co.strongest_constituent(ablation(spark, sf)[2].withColumn("value", F.round("value", 9))).withColumn("log_loss", r6("log_loss"))


@query("advancement_decision", "V8 K11 F10", ABL + """, s AS (SELECT report_id, arg_min(row_id, (value * 1000)::BIGINT * 100 + i) AS st, min(value) AS ll FROM mt WHERE metric = 'log_loss' AND i < 6 GROUP BY 1),
f AS (SELECT report_id, max(value) FILTER (WHERE metric = 'log_loss') AS ll, max(value) FILTER (WHERE metric = 'ece') AS ece FROM mt WHERE row_id = 'BVA' GROUP BY 1),
se AS (SELECT s.report_id, s.st, s.ll, m.value AS ece FROM s JOIN mt m ON m.report_id = s.report_id AND m.row_id = s.st AND m.metric = 'ece'),
d AS (SELECT f.report_id, st, f.ll - se.ll AS delta, concat_ws(';', CASE WHEN f.report_id % 7 = 1 THEN 'comparator_differs' END, CASE WHEN f.report_id % 11 = 2 THEN 'declared_delta_differs' END, CASE WHEN NOT f.ll < se.ll THEN 'does_not_beat_strongest' END,
  CASE WHEN f.ece - se.ece > 0.02 AND f.report_id % 8 <> 1 THEN 'ece_degradation_undisclosed' END, CASE WHEN f.report_id % 5 = 0 THEN 'uncertainty_not_supported' END) AS e FROM f JOIN se USING (report_id))
SELECT report_id, st AS strongest, round(delta, 6) + 0.0 AS delta_log_loss, e = '' AS advances, e AS errors FROM d""")
def advancement_decision(spark, sf):
    reports, _, metrics, *_ = ablation(spark, sf)
    metrics = metrics.withColumn("value", F.round("value", 9))
    best = co.strongest_constituent(metrics)
    full = metrics.where("row_id = 'BVA' AND metric = 'log_loss'").select("report_id", F.col("value").alias("ll"))
    declared = best.join(full, "report_id").selectExpr("report_id", "IF(report_id % 7 = 1, 'none', strongest) AS declared_comparator", "ll - log_loss + IF(report_id % 11 = 2, 0.01D, 0D) AS declared_delta", "report_id % 8 = 1 AS ece_disclosed")
    out = co.advancement_decision(reports.join(declared, "report_id"), metrics)
    return out.withColumns({"delta_log_loss": r6("delta_log_loss"), "errors": F.array_join("errors", ";")})


@query("result_packets", "L17 S10 V12", """
WITH r AS (SELECT event_id, event_id % 5 = 0 AS dupl, CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 13 = 0 THEN 'abc' ELSE ' ' || (event_id % 10) / 10 || ' ' END AS idf1, (event_id % 9) || '.0' AS idsw FROM events),
p AS (SELECT event_id, concat_ws(';', CASE WHEN event_id % 13 = 0 AND event_id % 7 > 0 THEN 'metric_not_numeric' END, CASE WHEN event_id % 2 = 0 AND (event_id % 7 = 0 OR event_id % 13 = 0) THEN 'quantitative_metric_missing' END,
  CASE WHEN dupl THEN 'summary_rows_not_one' END) AS errors, round(CASE WHEN event_id % 7 > 0 AND event_id % 13 > 0 THEN (event_id % 10) / 10 END, 6) AS idf1, event_id % 9 AS idsw FROM r)
SELECT * FROM p""")
def packets(spark, sf):
    e = table(spark, sf, "events")
    s = e.selectExpr("event_id AS run", "CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 13 = 0 THEN 'abc' ELSE concat(' ', (event_id % 10) / 10, ' ') END AS idf1", "concat(event_id % 9, '.0') AS idsw",
                     "explode(sequence(1, IF(event_id % 5 = 0, 2, 1))) AS copy").drop("copy")
    m = e.selectExpr("event_id AS run", "'r' AS run_id", "'frozen_tracker' AS system_id", "'c0ffee' AS upstream_commit", "sha2('a', 256) AS sequence_sha256", "array('s1') AS subject_ids", "array('crossing') AS strata",
                     "event_id % 2 = 0 AS quantitative", "true AS ground_truth")
    out = result_packets(s, m, "run", ["idf1", "idsw"], system="frozen_tracker", commit="c0ffee", strata=["crossing"])
    return out.select(F.col("run").alias("event_id"), F.array_join("errors", ";").alias("errors"), r6("idf1").alias("idf1"), F.col("idsw").cast("long").alias("idsw"))


