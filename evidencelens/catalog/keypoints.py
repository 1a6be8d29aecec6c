"""Landmark sequence queries."""

from pyspark.sql import functions as F

from evidencelens import views
from evidencelens.catalog import SQL, query
from evidencelens.functions import centroid_of, image_diagonal, r6, round_scaled
from evidencelens.operators import keypoints as kp
from evidencelens.plans.scorecards import sequence_scorecard, validate_sequences
from evidencelens.sources.pose_tables import detections_to_keypoints, wide_pose3d_to_long, wide_pose_to_long
from evidencelens.views import table

DIAG = 800.0  # hypot(640, 480)
KP = views.with_views("v_keypoints")
TR = views.with_views("v_track")
# kept: one row per (frame, name); the view never repeats a name in a frame, so the filter is the whole rule.
KEPT = KP + """, kept AS (SELECT * FROM v_keypoints WHERE score >= 0.2),
fc AS (SELECT sequence_id, count(DISTINCT frame_index) AS n_frames, min(frame_index) AS lo, max(frame_index) AS hi FROM v_keypoints GROUP BY 1)"""
EDGES = [("nose", "left_paw"), ("nose", "right_paw"), ("left_paw", "tail_tip")]
DEPTH = [("left_paw", "right_paw"), ("nose", "tail_tip")]
REQUIRED = {"head": ["nose", "left_ear"], "limbs": ["left_paw", "right_paw"], "tail": ["tail_tip", "tail_mid", "tail_root"]}
PAIRS_SQL = "(VALUES " + ", ".join(f"('{a}','{b}')" for a, b in EDGES) + ") e(a, b)"
DEPTH_SQL = "(VALUES " + ", ".join(f"('{a}','{b}')" for a, b in DEPTH) + ") e(a, b)"


def kept(spark, sf):
    return kp.confident_keypoints(views.keypoints(spark, sf))


def frames(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey div 300 AS sequence_id", "o_orderkey % 300 AS frame_index", "o_totalprice / 1000.0D AS inference_ms",
        "o_orderstatus AS timing_scope", "640 AS width_px", "480 AS height_px")


FRAMES_SQL = """v_frames AS (SELECT o_orderkey // 300 AS sequence_id, o_orderkey % 300 AS frame_index,
  o_totalprice / 1000.0 AS inference_ms, o_orderstatus AS timing_scope FROM orders)"""


@query("canonical_names", "P1", KP + """
SELECT sequence_id, frame_index, pos, CASE name WHEN 'nose' THEN 'nose_tip' WHEN 'tail_tip' THEN 'tail_end' ELSE name END AS name FROM v_keypoints""")
def canonical_names(spark, sf):
    raw = views.keypoints(spark, sf).withColumnRenamed("name", "native_name")
    mapping = {"nose": "nose_tip", "tail_tip": "tail_end", "left_paw": ""}
    return kp.canonical_names(raw, mapping).select("sequence_id", "frame_index", "pos", "name")


@query("confident_keypoints", "P2", KP + """
SELECT sequence_id, frame_index, name, round(arg_max(x_px, pos), 6) AS x_px, max(pos) AS pos FROM (
  SELECT sequence_id, frame_index, pos, x_px, score, CASE WHEN frame_index % 7 = 0 AND pos = 3 THEN 'nose' ELSE name END AS name
  FROM v_keypoints) WHERE score >= 0.2 GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY sequence_id, frame_index, name"))
def confident(spark, sf):
    raw = views.keypoints(spark, sf).withColumn(
        "name", F.expr("CASE WHEN frame_index % 7 = 0 AND pos = 3 THEN 'nose' ELSE name END"))
    return kp.confident_keypoints(raw).select("sequence_id", "frame_index", "name", r6("x_px").alias("x_px"), "pos")


@query("stride_sample", "P4", "WITH " + FRAMES_SQL + """, k AS (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY frame_index) - 1 AS i FROM v_frames WHERE frame_index % 7 = 0 AND NOT (frame_index % 49 = 14 AND sequence_id % 2 = 0))
SELECT sequence_id, i AS frame_index, frame_index AS source_frame, round(frame_index / 30.0, 6) AS timestamp_s FROM k WHERE i < 20""")
def stride_sample(spark, sf):
    f = frames(spark, sf).where("NOT (frame_index % 49 = 14 AND sequence_id % 2 = 0)")
    out = kp.stride_sample(f, 7, 20, 30.0)
    return out.select("sequence_id", "frame_index", "source_frame", r6("timestamp_s").alias("timestamp_s"))


@query("keypoint_coverage", "A5", KEPT + """
SELECT k.sequence_id, name, count(*) AS present, round(count(*) / any_value(n_frames), 6) AS coverage
FROM kept k JOIN fc USING (sequence_id) GROUP BY 1, 2""")
def keypoint_coverage(spark, sf):
    out = kp.coverage(kept(spark, sf), views.keypoints(spark, sf))
    return out.select("sequence_id", "name", "present", r6("coverage").alias("coverage"))


@query("overall_coverage", "A5", KEPT + """
SELECT k.sequence_id, count(DISTINCT name) AS n_names, round(count(*) / (count(DISTINCT name) * any_value(n_frames)), 6) AS coverage
FROM kept k JOIN fc USING (sequence_id) GROUP BY 1""")
def overall_coverage(spark, sf):
    return kp.overall_coverage(kept(spark, sf), views.keypoints(spark, sf)).withColumn("coverage", r6("coverage"))


@query("dropout_runs", "E1", KEPT + """,
g AS (SELECT k.sequence_id, name, frame_index, n_frames, lo, hi,
        lead(frame_index) OVER (PARTITION BY k.sequence_id, name ORDER BY frame_index) - frame_index - 1 AS gap
      FROM kept k JOIN fc USING (sequence_id)),
s AS (SELECT sequence_id, name, count(*) FILTER (WHERE gap > 0) AS b, avg(gap) FILTER (WHERE gap > 0) AS mb, coalesce(max(gap), 0) AS mg,
        min(frame_index) - any_value(lo) AS lead_gap, any_value(hi) - max(frame_index) AS trail_gap FROM g GROUP BY 1, 2)
SELECT sequence_id, name, b + (lead_gap > 0)::BIGINT + (trail_gap > 0)::BIGINT AS dropout_runs, b AS bounded_recoveries,
  greatest(mg, lead_gap, trail_gap) AS max_dropout_frames, round(coalesce(mb, 0.0), 6) AS mean_bounded_frames FROM s""")
def dropout_runs(spark, sf):
    return kp.dropout_runs(kept(spark, sf), views.keypoints(spark, sf)).withColumn("mean_bounded_frames", r6("mean_bounded_frames"))


@query("motion_curvature", "E2 F4", KEPT + """,
n AS (SELECT sequence_id, frame_index, x_px, y_px, lag(frame_index) OVER w AS pf, lag(x_px) OVER w AS px, lag(y_px) OVER w AS py,
  lead(frame_index) OVER w AS nf, lead(x_px) OVER w AS nx, lead(y_px) OVER w AS ny FROM kept
  WINDOW w AS (PARTITION BY sequence_id, name ORDER BY frame_index)),
c AS (SELECT sequence_id, CASE WHEN pf = frame_index - 1 AND nf = frame_index + 1 THEN
  sqrt((nx - 2 * x_px + px) ** 2 + (ny - 2 * y_px + py) ** 2) / 800.0 END AS curv FROM n)
SELECT sequence_id, round(avg(curv), 6) AS mean_curvature, round(avg((curv > 0.03)::DOUBLE), 6) AS spike_rate, count(curv) AS samples
FROM c GROUP BY 1""")
def motion_curvature(spark, sf):
    out = kp.motion_curvature(kept(spark, sf), image_diagonal(F.lit(640), F.lit(480)))
    return out.withColumns({"mean_curvature": r6("mean_curvature"), "spike_rate": r6("spike_rate")})


@query("latency_summary", "A6", "WITH " + FRAMES_SQL + """
SELECT sequence_id, timing_scope, round(avg(inference_ms), 6) AS mean_ms, count(*) AS n_frames,
  round(quantile_disc(inference_ms, 0.95), 6) AS p95_ms, round(1000.0 / avg(inference_ms), 6) AS fps FROM v_frames GROUP BY 1, 2""")
def latency_summary(spark, sf):
    out = kp.latency_summary(frames(spark, sf), ["sequence_id", "timing_scope"])
    return out.withColumns({c: r6(c) for c in ("mean_ms", "p95_ms", "fps")})


BONE = """, pr AS (SELECT e.a, e.b, x.sequence_id, x.frame_index, x.x_px AS x1, x.y_px AS y1, x.z AS z1, y.x_px AS x2, y.y_px AS y2, y.z AS z2
  FROM {pairs} JOIN kept x ON x.name = e.a JOIN kept y ON y.name = e.b AND y.sequence_id = x.sequence_id
   AND y.frame_index = x.frame_index AND y.coordinate_frame = x.coordinate_frame)"""


@query("landmark_pairs", "J5", KEPT + BONE.format(pairs=PAIRS_SQL) + """
SELECT sequence_id, frame_index, a, b, round(sqrt((x1-x2)**2 + (y1-y2)**2 + (z1-z2)**2), 6) AS length FROM pr""")
def landmark_pairs(spark, sf):
    from evidencelens.functions import dist3

    p = kp.landmark_pairs(kept(spark, sf), EDGES)
    length = dist3(*[F.col(f"pa.{c}") for c in ("x_px", "y_px", "z")], *[F.col(f"pb.{c}") for c in ("x_px", "y_px", "z")])
    return p.select("sequence_id", "frame_index", "a", "b", r6(length).alias("length"))


@query("bone_length_stability", "A7 F4", KEPT + BONE.format(pairs=PAIRS_SQL) + f""",
l AS (SELECT *, sqrt((x1-x2)**2 + (y1-y2)**2 + (z1-z2)**2) AS len FROM pr),
s AS (SELECT sequence_id, a, b, count(*) AS n, avg(len) AS m, stddev_pop(len) AS sd FROM l GROUP BY 1, 2, 3)
SELECT fc.sequence_id, e.a, e.b, coalesce(n, 0) AS samples, round(m, 6) AS mean_length,
  round(CASE WHEN n IS NULL THEN NULL WHEN n > 1 AND m > 0 THEN sd / m ELSE 0.0 END, 6) AS cv
FROM fc CROSS JOIN {PAIRS_SQL} LEFT JOIN s ON s.sequence_id = fc.sequence_id AND s.a = e.a AND s.b = e.b""")
def bone_length_stability(spark, sf):
    out = kp.bone_length_stability(kept(spark, sf), EDGES, views.keypoints(spark, sf))
    return out.withColumns({"mean_length": r6("mean_length"), "cv": r6("cv")})


@query("sign_flips", "E3", KEPT + BONE.format(pairs=DEPTH_SQL) + """,
s AS (SELECT sequence_id, a, b, frame_index, CASE WHEN z1 - z2 > 0 THEN 1 ELSE -1 END AS sg FROM pr WHERE abs(z1 - z2) > 1e-8),
f AS (SELECT *, lag(sg) OVER (PARTITION BY sequence_id, a, b ORDER BY frame_index) AS before FROM s)
SELECT sequence_id, a, b, count(*) AS samples, count(*) FILTER (WHERE before <> sg) AS flips FROM f GROUP BY 1, 2, 3""")
def sign_flips(spark, sf):
    return kp.sign_flips(kept(spark, sf), DEPTH)


REQ_ROWS = ", ".join(f"('{g}','{n}')" for g, ns in REQUIRED.items() for n in ns)


@query("topology_coverage", "A8", KEPT + f""",
rq(g, name) AS (VALUES {REQ_ROWS}), d AS (SELECT DISTINCT sequence_id, name FROM kept),
j AS (SELECT fc.sequence_id, g, rq.name, d.name IS NOT NULL AS hit FROM fc CROSS JOIN rq LEFT JOIN d ON d.sequence_id = fc.sequence_id AND d.name = rq.name)
SELECT sequence_id, g AS required_group, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE hit), '') AS present,
  coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE NOT hit), '') AS missing, round(avg(hit::DOUBLE), 6) AS coverage,
  CASE WHEN g = 'tail' THEN count(*) FILTER (WHERE hit) >= 3 END AS curve_capable FROM j GROUP BY 1, 2""")
def topology_coverage(spark, sf):
    out = kp.topology_coverage(kept(spark, sf), REQUIRED, views.keypoints(spark, sf))
    return out.withColumns({"present": F.array_join("present", ","), "missing": F.array_join("missing", ","), "coverage": r6("coverage")})


@query("consecutive_steps", "E4 F4", TR + """,
n AS (SELECT *, lag(frame_index) OVER w AS pf, lag(x) OVER w AS px, lag(y) OVER w AS py FROM v_track WHERE visible
 WINDOW w AS (PARTITION BY sequence_id ORDER BY frame_index))
SELECT sequence_id, frame_index, round(sqrt((x-px)**2 + (y-py)**2) / 800.0, 6) AS step FROM n WHERE pf = frame_index - 1""")
def consecutive_steps(spark, sf):
    return kp.consecutive_steps(views.track(spark, sf), DIAG).withColumn("step", r6("step"))


@query("internal_gaps", "E7", TR + """,
n AS (SELECT sequence_id, frame_index, lag(frame_index) OVER (PARTITION BY sequence_id ORDER BY frame_index) AS pf FROM v_track WHERE visible)
SELECT sequence_id, pf AS after_frame, frame_index - pf - 1 AS gap FROM n WHERE frame_index - pf > 1""")
def internal_gaps(spark, sf):
    return kp.internal_gaps(views.track(spark, sf), block=64)


@query("track_state", "E6", TR + """,
s AS (SELECT sequence_id, frame_index, CASE WHEN x <= 60 THEN 'target' ELSE 'lost' END AS state FROM v_track),
l AS (SELECT *, lag(state, 1, 'target') OVER (PARTITION BY sequence_id ORDER BY frame_index) AS was FROM s)
SELECT sequence_id, frame_index, state, CASE WHEN state = 'target' THEN CASE WHEN was = 'target' THEN 'tracked' ELSE 'reacquired' END
  ELSE CASE WHEN was = 'target' THEN 'lost' ELSE 'remain_lost' END END AS transition FROM l""")
def track_state(spark, sf):
    return kp.track_state(views.track(spark, sf), F.col("x") <= 60, block=100)


@query("turn_transitions", "E6 E17", views.with_views("v_turns") + """,
l AS (SELECT *, lag(n_chars) OVER w AS pc, lag(frame_index) OVER w AS pf FROM v_turns WINDOW w AS (PARTITION BY sequence_id ORDER BY frame_index))
SELECT sequence_id, count(*) AS n, count(*) FILTER (WHERE n_chars < pc) AS n_chars_steps_back, count(*) FILTER (WHERE frame_index = pf) AS repeated
FROM l GROUP BY 1""")
def turn_transitions(spark, sf):
    return kp.monotone_check(views.turns(spark, sf), ["sequence_id"], "frame_index", ["n_chars"])


@query("finite_differences", "E15", TR + """,
n AS (SELECT *, lag(frame_index) OVER w AS pf, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(frame_index) OVER w AS nf,
  lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM v_track WHERE visible WINDOW w AS (PARTITION BY sequence_id ORDER BY frame_index))
SELECT sequence_id, frame_index, round((nx - px) * 12.5, 6) + 0.0 AS vx, round((nx - 2 * x + px) * 625, 6) + 0.0 AS ax,
  round((ny - py) * 12.5, 6) + 0.0 AS vy, round((ny - 2 * y + py) * 625, 6) + 0.0 AS ay
FROM n WHERE pf = frame_index - 1 AND nf = frame_index + 1""")
def finite_differences(spark, sf):
    out = kp.finite_differences(views.track(spark, sf).where("visible"), 25.0)
    return out.withColumns({c: r6(c) for c in ("vx", "ax", "vy", "ay")})


@query("contact_slide", "E23", TR + """,
n AS (SELECT sequence_id, frame_index, x, y, lag(frame_index) OVER w AS pf, lag(x) OVER w AS px, lag(y) OVER w AS py FROM v_track WHERE visible
  WINDOW w AS (PARTITION BY sequence_id ORDER BY frame_index)),
s AS (SELECT sequence_id, frame_index, CASE WHEN pf = frame_index - 1 THEN sqrt((x-px)**2 + (y-py)**2) ELSE 0 END AS step FROM n),
c AS (SELECT event_id AS contact_id, event_id // 250 AS sequence_id, event_id % 250 AS a, event_id % 250 + event_id % 17 AS b FROM events)
SELECT c.sequence_id, contact_id, round(coalesce(sum(step), 0), 6) AS slide FROM c LEFT JOIN s ON s.sequence_id = c.sequence_id
  AND s.frame_index > a AND s.frame_index <= b GROUP BY 1, 2""")
def contact_slide(spark, sf):
    contacts = table(spark, sf, "events").selectExpr(
        "event_id AS contact_id", "event_id div 250 AS sequence_id", "event_id % 250 AS start_frame",
        "event_id % 250 + event_id % 17 AS end_frame")
    out = kp.contact_slide(views.track(spark, sf).where("visible"), contacts, ["sequence_id"], block=64)
    return out.withColumn("slide", r6("slide"))


INDIV = """k AS (SELECT l_orderkey // 10 AS sequence_id, l_orderkey % 10 AS frame_index, 'id' || (l_partkey % 3) AS individual,
  CASE WHEN l_suppkey % 19 = 0 THEN 'NaN'::DOUBLE ELSE (l_partkey % 16) / 16.0 END AS score, l_quantity AS x_px, l_tax * 1000 AS y_px FROM lineitem)"""


def individuals(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey div 10 AS sequence_id", "l_orderkey % 10 AS frame_index", "concat('id', l_partkey % 3) AS individual",
        "CASE WHEN l_suppkey % 19 = 0 THEN double('NaN') ELSE (l_partkey % 16) / 16.0D END AS score",
        "l_quantity AS x_px", "l_tax * 1000 AS y_px")


@query("best_individual", "K5", "WITH " + INDIV + """,
m AS (SELECT sequence_id, frame_index, individual, coalesce(avg(score) FILTER (WHERE NOT isnan(score)), '-inf'::DOUBLE) AS s FROM k GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, frame_index ORDER BY s DESC, individual DESC) AS rn FROM m)
SELECT sequence_id, frame_index, individual, round(s, 6) AS mean_score FROM r WHERE rn = 1""")
def best_individual(spark, sf):
    return kp.best_individual(individuals(spark, sf)).withColumn("mean_score", round_scaled("mean_score"))


CAND = "WITH " + INDIV + """,
g AS (SELECT sequence_id, frame_index, individual, avg(score) AS mean_score, count(*) FILTER (WHERE score >= 0.5) AS n_confident,
  min(x_px) FILTER (WHERE score >= 0.5) AS x0, min(y_px) FILTER (WHERE score >= 0.5) AS y0, max(x_px) FILTER (WHERE score >= 0.5) AS x1,
  max(y_px) FILTER (WHERE score >= 0.5) AS y1, avg(x_px) FILTER (WHERE score >= 0.5) AS cx, avg(y_px) FILTER (WHERE score >= 0.5) AS cy
  FROM k WHERE NOT isnan(score) GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE score >= 0.5) > 0)"""


@query("frame_candidates", "K7 F14", CAND + """
SELECT sequence_id, frame_index, individual, round(mean_score, 6) AS mean_score, n_confident, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1,
  round(y1, 6) AS y1, round(cx, 6) AS cx, round(cy, 6) AS cy, row_number() OVER (PARTITION BY sequence_id, frame_index
  ORDER BY n_confident DESC, mean_score DESC, individual DESC) AS rank FROM g""")
def frame_candidates(spark, sf):
    out = kp.frame_candidates(individuals(spark, sf))
    return out.withColumns({c: r6(c) for c in ("x0", "y0", "x1", "y1", "cx", "cy")}).withColumn("mean_score", round_scaled("mean_score"))


@query("candidate_layer_summary", "A35", CAND + """,
n AS (SELECT sequence_id, frame_index, count(*) AS n FROM g GROUP BY 1, 2), f AS (SELECT DISTINCT sequence_id, frame_index FROM k)
SELECT sequence_id, count(*) FILTER (WHERE n >= 2) AS frames_multiple, count(*) FILTER (WHERE n = 1) AS frames_single,
 count(*) FILTER (WHERE n IS NULL) AS frames_none, count(*) FILTER (WHERE n >= 2) > 0 AS feasible FROM f LEFT JOIN n USING (sequence_id, frame_index) GROUP BY 1""")
def candidate_layer_summary(spark, sf):
    k = individuals(spark, sf)
    return kp.candidate_layer_summary(kp.frame_candidates(k), k)


@query("detector_availability", "A36", "WITH " + INDIV + """,
d AS (SELECT DISTINCT sequence_id, frame_index, individual FROM k),
f AS (SELECT sequence_id, frame_index, count(*) AS n FROM d GROUP BY 1, 2), i AS (SELECT individual, count(*) AS n FROM d GROUP BY 1)
SELECT 'detections_per_frame' AS kind, n::VARCHAR AS key, count(*) AS value FROM f GROUP BY n UNION ALL SELECT 'observations_per_identity', individual, n FROM i""")
def detector_availability(spark, sf):
    from evidencelens.operators.instances import detector_availability as availability

    return availability(individuals(spark, sf).select("sequence_id", "frame_index", "individual").distinct())


@query("select_keyframe", "K3", KP.replace("v_keypoints AS", "v_raw AS") + """,
v_keypoints AS (SELECT sequence_id, frame_index, name, score, floor(x_px * (pos + 1)) AS x_px, y_px FROM v_raw),
f AS (SELECT sequence_id, frame_index, max(score) FILTER (WHERE name='nose') AS sa, max(score) FILTER (WHERE name='tail_tip') AS sb,
 max(x_px) FILTER (WHERE name='nose') AS xa, max(y_px) FILTER (WHERE name='nose') AS ya, max(x_px) FILTER (WHERE name='tail_tip') AS xb,
 max(y_px) FILTER (WHERE name='tail_tip') AS yb FROM v_keypoints GROUP BY 1, 2),
r AS (SELECT *, least(sa, sb) AS weakest, sqrt((xa-xb)**2 + (ya-yb)**2) / 800.0 AS separation FROM f WHERE sa >= 0.2 AND sb >= 0.2),
o AS (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY weakest DESC, separation DESC, frame_index) AS rn FROM r WHERE separation >= 0.03)
SELECT sequence_id, frame_index, round(weakest, 6) AS weakest, round(separation, 6) AS separation FROM o WHERE rn = 1""")
def select_keyframe(spark, sf):
    raw = views.keypoints(spark, sf)
    # Whole-pixel coordinates keep equal separations equal in both engines.
    out = kp.select_keyframe(raw.withColumn("x_px", F.floor(F.col("x_px") * (F.col("pos") + 1)).cast("double")), ("nose", "tail_tip"), DIAG)
    return out.select("sequence_id", "frame_index", r6("weakest").alias("weakest"), r6("separation").alias("separation"))


@query("select_negatives", "K4", KP + """,
kf AS (SELECT sequence_id, min(frame_index) AS frame_index FROM v_keypoints WHERE frame_index % 11 = 3 GROUP BY 1),
e AS (SELECT kf.*, max(x_px) FILTER (WHERE name='nose') AS xa, max(y_px) FILTER (WHERE name='nose') AS ya, max(x_px) FILTER (WHERE name='tail_tip') AS xb,
 max(y_px) FILTER (WHERE name='tail_tip') AS yb FROM kf JOIN v_keypoints USING (sequence_id, frame_index) GROUP BY ALL),
n AS (SELECT e.sequence_id, name FROM e JOIN v_keypoints k USING (sequence_id, frame_index) WHERE name IN ('left_paw','right_paw') AND score >= 0.2
 AND sqrt((x_px-xa)**2 + (y_px-ya)**2) >= 8.0 AND sqrt((x_px-xb)**2 + (y_px-yb)**2) >= 8.0)
SELECT e.sequence_id, count(n.name) AS n_negatives, string_agg(n.name, ',' ORDER BY n.name) AS negatives,
 CASE WHEN count(n.name) < 2 THEN 'too_few_negative_points' END AS error FROM e LEFT JOIN n USING (sequence_id) GROUP BY 1""")
def select_negatives(spark, sf):
    raw = views.keypoints(spark, sf)
    first = raw.where("frame_index % 11 = 3").groupBy("sequence_id").agg(F.min("frame_index").alias("frame_index"))
    pick = lambda n, c: F.max(F.when(F.col("name") == n, F.col(c)))
    kf = raw.join(first, ["sequence_id", "frame_index"]).groupBy("sequence_id", "frame_index").agg(
        pick("nose", "x_px").alias("x_px_a"), pick("nose", "y_px").alias("y_px_a"),
        pick("tail_tip", "x_px").alias("x_px_b"), pick("tail_tip", "y_px").alias("y_px_b"))
    out = kp.select_negatives(raw, kf, ["left_paw", "right_paw"], DIAG, separation=0.01)
    return out.withColumn("negatives", F.array_join("negatives", ","))


WIDE_COLUMNS = {(i, b, c): f"{i}_{b}_{c}" for i in ("one", "two") for b in ("nose", "tail") for c in ("x", "y", "likelihood")
                if not (i == "two" and c == "likelihood")}


@query("wide_pose_to_long", "S6 P3", """
WITH l AS (SELECT o_orderkey // 300 AS sequence_id, o_orderkey % 300 AS frame_index, i.ind AS individual, p.part AS native_name,
 CASE WHEN (o_custkey + i.n + p.n) % 13 = 0 THEN NULL ELSE o_totalprice / 100 + 10 * i.n + p.n END AS x_px, (o_custkey + p.n)::DOUBLE AS y_px,
 CASE WHEN i.n = 2 THEN 1.0 WHEN (o_custkey + p.n) % 7 = 0 THEN 0.0 ELSE (o_custkey % 10) / 10.0 END AS score
 FROM orders CROSS JOIN (VALUES ('one', 1), ('two', 2)) i(ind, n) CROSS JOIN (VALUES ('nose', 1), ('tail', 2)) p(part, n))
SELECT sequence_id, frame_index, round(frame_index / 30.0, 6) AS timestamp_s, individual, native_name, round(x_px, 6) AS x_px, y_px, round(score, 6) AS score
FROM l WHERE x_px IS NOT NULL""")
def wide_pose(spark, sf):
    cols = []
    for i, (ind, ni) in enumerate((("one", 1), ("two", 2))):
        for part, np_ in (("nose", 1), ("tail", 2)):
            cols += [
                f"CASE WHEN (o_custkey + {ni} + {np_}) % 13 = 0 THEN double('NaN') ELSE o_totalprice / 100 + 10 * {ni} + {np_} END AS {ind}_{part}_x",
                f"(o_custkey + {np_}) * 1.0D AS {ind}_{part}_y",
                f"CASE WHEN (o_custkey + {np_}) % 7 = 0 THEN double('Infinity') ELSE (o_custkey % 10) / 10.0D END AS {ind}_{part}_likelihood"]
    wide = table(spark, sf, "orders").selectExpr("o_orderkey div 300 AS sequence_id", "o_orderkey % 300 AS frame_index", *cols)
    out = wide_pose_to_long(wide, WIDE_COLUMNS, ["sequence_id"], "frame_index", 30.0)
    return out.withColumns({c: r6(c) for c in ("timestamp_s", "x_px", "score")})


@query("wide_pose3d_to_long", "S7", """
SELECT o_orderkey AS frame_index, p.part AS native_name, round(o_totalprice / 100 + p.n, 6) AS x, o_custkey::DOUBLE AS y, p.n::DOUBLE AS z,
 'world' AS coordinate_frame FROM orders CROSS JOIN (VALUES ('nose', 1), ('tail', 2)) p(part, n) WHERE (o_custkey + p.n) % 13 <> 0""")
def wide_pose3d(spark, sf):
    cols = []
    for part, n in (("nose", 1), ("tail", 2)):
        cols += [f"CASE WHEN (o_custkey + {n}) % 13 = 0 THEN double('NaN') ELSE o_totalprice / 100 + {n} END AS {part}_x",
                 f"o_custkey * 1.0D AS {part}_y", f"{n} * 1.0D AS {part}_z"]
    wide = table(spark, sf, "orders").selectExpr("o_orderkey AS frame_index", *cols)
    names = {("one", p, c): f"{p}_{c}" for p in ("nose", "tail") for c in "xyz"}
    return wide_pose3d_to_long(wide, names, [], "frame_index", "world").withColumn("x", r6("x"))


@query("detections_to_keypoints", "S8", """
WITH d AS (SELECT vec_id, embedding[1:6]::DOUBLE[] AS e, vec_id % 5 AS m FROM embeddings)
SELECT vec_id, i AS pos, CASE i WHEN 0 THEN 'nose' WHEN 1 THEN 'left_paw' ELSE 'tail_tip' END AS name, round(e[2*i+1], 6) + 0.0 AS x_px,
 round(e[2*i+2], 6) + 0.0 AS y_px, CASE WHEN m = 1 THEN 1.0 ELSE round(abs(e[i+1]), 6) END AS score
FROM d CROSS JOIN (VALUES (0),(1),(2)) k(i) WHERE m <> 2""")
def detections(spark, sf):
    return detection_tables(spark, sf)[0].withColumns({c: r6(c) for c in ("x_px", "y_px", "score")})


@query("detection_errors", "S8", "SELECT vec_id, 'score_count_differs_from_keypoints' AS errors FROM embeddings WHERE vec_id % 5 = 2")
def detection_errors(spark, sf):
    return detection_tables(spark, sf)[1].withColumn("errors", F.array_join("errors", ";"))


def detection_tables(spark, sf):
    v = "transform(embedding, x -> CAST(x AS DOUBLE))"
    raw = table(spark, sf, "embeddings").selectExpr("vec_id", f"{v} AS e").selectExpr(
        "vec_id", "array(array(e[0], e[1]), array(e[2], e[3]), array(e[4], e[5])) AS keypoints",
        "CASE vec_id % 5 WHEN 1 THEN array() WHEN 2 THEN array(0.5D) ELSE array(abs(e[0]), abs(e[1]), abs(e[2])) END AS keypoint_scores")
    return detections_to_keypoints(raw, ["nose", "left_paw", "tail_tip"], ["vec_id"])


@query("best_instance", "K6", """
WITH d AS (SELECT l_orderkey // 10 AS sequence_id, l_orderkey % 10 AS frame_index,   l_extendedprice * 1000 + l_linenumber AS pos, CASE WHEN l_partkey % 4 = 0 THEN coalesce(CASE WHEN l_suppkey % 3 > 0 THEN (l_partkey % 7) / 8.0 END, 0.0)
   ELSE ((l_partkey % 16) / 16.0 + (l_suppkey % 8) / 8.0) / 2 END AS s FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, frame_index ORDER BY s DESC, pos) AS k FROM d)
SELECT sequence_id, frame_index, pos, round(s, 6) AS instance_score FROM r WHERE k = 1""")
def best_instance(spark, sf):
    raw = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey div 10 AS sequence_id", "l_orderkey % 10 AS frame_index", "l_extendedprice * 1000 + l_linenumber AS pos",
        "CASE WHEN l_partkey % 4 = 0 THEN CAST(array() AS array<double>) ELSE array((l_partkey % 16) / 16.0D, (l_suppkey % 8) / 8.0D) END AS keypoint_scores",
        "CASE WHEN l_suppkey % 3 > 0 THEN (l_partkey % 7) / 8.0D END AS bbox_score")
    return kp.best_instance(raw).withColumn("instance_score", r6("instance_score"))


@query("validate_sequences", "V15 F4", "WITH " + FRAMES_SQL + """,
g AS (SELECT sequence_id, count(*) AS n, count(DISTINCT frame_index) AS u, max(frame_index) - min(frame_index) + 1 AS span FROM v_frames
  WHERE NOT (sequence_id % 5 = 2 AND frame_index = 17) GROUP BY 1)
SELECT sequence_id, n AS n_frames, concat_ws(';', CASE WHEN sequence_id % 7 = 3 THEN 'diagonal_not_positive' END,
  CASE WHEN u <> n OR span <> n THEN 'frame_index_not_contiguous' END) AS errors FROM g""")
def sequences_valid(spark, sf):
    f = frames(spark, sf).where("NOT (sequence_id % 5 = 2 AND frame_index = 17)").withColumns({
        "width_px": F.expr("IF(sequence_id % 7 = 3, 0, 640)"), "height_px": F.expr("IF(sequence_id % 7 = 3, 0, 480)")})
    return validate_sequences(f, "width_px", "height_px").withColumn("errors", F.array_join(F.array_sort("errors"), ";"))


CARD = KEPT + ", " + FRAMES_SQL + BONE.format(pairs=PAIRS_SQL) + """,
cov AS (SELECT k.sequence_id, name, count(*) / any_value(n_frames) AS v, count(*) AS c, any_value(n_frames) AS nf FROM kept k JOIN fc USING (sequence_id) GROUP BY 1, 2),
bl AS (SELECT sequence_id, a || '--' || b AS edge, count(*) AS n, avg(sqrt((x1-x2)**2 + (y1-y2)**2 + (z1-z2)**2)) AS m FROM pr GROUP BY 1, 2)
SELECT sequence_id, name AS detail, 'coverage' AS metric, round(v, 6) AS value FROM cov
UNION ALL SELECT sequence_id, '', 'overall_coverage', round(sum(c) / (count(*) * any_value(nf)), 6) FROM cov GROUP BY 1
UNION ALL SELECT sequence_id, edge, 'samples', n::DOUBLE FROM bl UNION ALL SELECT sequence_id, edge, 'mean_length', round(m, 6) FROM bl
UNION ALL SELECT sequence_id, '', 'mean_ms', round(avg(inference_ms), 6) FROM v_frames GROUP BY 1
UNION ALL SELECT sequence_id, '', 'p95_ms', round(quantile_disc(inference_ms, 0.95), 6) FROM v_frames GROUP BY 1"""


@query("sequence_scorecard", "A34", CARD)
def scorecard(spark, sf):
    out = sequence_scorecard(views.keypoints(spark, sf), frames(spark, sf), diagonal=DIAG, edges=EDGES, depth_pairs=DEPTH, required=REQUIRED)
    shown = out.where("metric IN ('coverage','overall_coverage','mean_length','mean_ms','p95_ms') OR (metric = 'samples' AND detail <> '')")
    return shown.withColumn("value", r6("value"))


def _rows(name, detail, *metrics):
    """Registered SQL as tidy rows; ``metrics`` are columns or (column, shown name)."""
    pairs = [m if isinstance(m, tuple) else (m, m) for m in metrics]
    items = ", ".join(f"{{'metric': '{shown}', 'value': {column}::DOUBLE}}" for column, shown in pairs)
    return f"SELECT sequence_id, {detail} AS detail, unnest([{items}], recursive := true) FROM ({SQL.get(name, name)})"


LATENCY = "WITH " + FRAMES_SQL + " SELECT sequence_id, round(avg(inference_ms), 6) AS mean_ms, round(quantile_disc(inference_ms, 0.95), 6) AS p95_ms, round(1000.0 / avg(inference_ms), 6) AS fps FROM v_frames GROUP BY 1"
FULL_CARD = " UNION ALL ".join([
    _rows("keypoint_coverage", "name", "coverage"), _rows("dropout_runs", "name", "dropout_runs", "bounded_recoveries", "max_dropout_frames", "mean_bounded_frames"),
    _rows("overall_coverage", "''", "n_names", ("coverage", "overall_coverage")), _rows("motion_curvature", "''", "mean_curvature", "spike_rate", "samples"),
    _rows("bone_length_stability", "a || '--' || b", "samples", "mean_length", "cv"), _rows("sign_flips", "a || '--' || b", ("samples", "flip_samples"), "flips"),
    _rows("topology_coverage", "required_group", ("coverage", "group_coverage")), _rows(LATENCY, "''", "mean_ms", "p95_ms", "fps")])


@query("sequence_scorecard_full", "A34", FULL_CARD)
def scorecard_full(spark, sf):
    """All metric names."""
    card = sequence_scorecard(views.keypoints(spark, sf), frames(spark, sf), diagonal=DIAG, edges=EDGES, depth_pairs=DEPTH, required=REQUIRED)
    return card.withColumn("value", r6("value"))


@query("reference_centroids", "F14", KP + """, p AS (SELECT sequence_id, frame_index, list({'x_px': x_px, 'y_px': y_px}) FILTER (WHERE score >= 0.7) AS points FROM v_keypoints GROUP BY 1, 2)
SELECT sequence_id, frame_index, round(list_avg(list_transform(points, lambda q: q.x_px)), 6) AS x, round(list_avg(list_transform(points, lambda q: q.y_px)), 6) AS y, CASE WHEN points IS NULL THEN 'reference_points_required' END AS error FROM p""")
def reference_centroids(spark, sf):
    """The centre of each frame's confident landmarks; a frame without any says why it has none."""
    near = F.collect_list(F.when(F.col("score") >= 0.7, F.struct("x_px", "y_px")))  # four landmarks a frame
    p = views.keypoints(spark, sf).groupBy("sequence_id", "frame_index").agg(near.alias("points"))
    return p.select("sequence_id", "frame_index", centroid_of("points").alias("c")).select("sequence_id", "frame_index", r6("c.x").alias("x"), r6("c.y").alias("y"), "c.error")
