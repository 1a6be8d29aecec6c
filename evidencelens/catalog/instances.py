"""Boxes, mask runs, curves, identity and track gates."""

from pyspark.sql import functions as F

from evidencelens import views
from evidencelens.catalog import query
from evidencelens.functions import angle_deg, bbox_iou_xywh, derived_seed, dist2, dist3, is_close, lgamma, r6, rgb_bin, seg_visible, sentinel, stable_hash
from evidencelens.operators import instances as ins
from evidencelens.views import table

BOX = views.with_views("v_boxes")
RUN = views.with_views("v_runs")
IOU_SQL = """CASE WHEN a.bw > 0 AND a.bh > 0 AND b.bw > 0 AND b.bh > 0 THEN
  greatest(0.0, least(a.bx + a.bw, b.bx + b.bw) - greatest(a.bx, b.bx)) * greatest(0.0, least(a.by + a.bh, b.by + b.bh) - greatest(a.by, b.by))
  / (a.bw * a.bh + b.bw * b.bh - greatest(0.0, least(a.bx + a.bw, b.bx + b.bw) - greatest(a.bx, b.bx))
     * greatest(0.0, least(a.by + a.bh, b.by + b.bh) - greatest(a.by, b.by))) ELSE 0.0 END"""
PAIR = f"""pr AS (SELECT a.sequence_id, a.frame_index, a.instance_id AS a, b.instance_id AS b, {IOU_SQL} AS iou
  FROM v_boxes a JOIN v_boxes b ON a.sequence_id = b.sequence_id AND a.frame_index = b.frame_index AND a.instance_id < b.instance_id
  WHERE a.visible AND b.visible)"""


@query("overlapping_instances", "J6 F5", BOX + ", " + PAIR + " SELECT sequence_id, frame_index, a, b, round(iou, 6) AS iou FROM pr WHERE iou > 0")
def overlapping_instances(spark, sf):
    return ins.overlapping_instances(views.boxes(spark, sf)).withColumn("iou", r6("iou"))


@query("overlap_frames", "J6", BOX + ", " + PAIR + " SELECT DISTINCT sequence_id, frame_index FROM pr WHERE iou > 0")
def overlap_frames(spark, sf):
    return ins.overlap_frames(views.boxes(spark, sf))


GAPS = """vis AS (SELECT sequence_id, instance_id, frame_index, lead(frame_index) OVER (PARTITION BY sequence_id, instance_id ORDER BY frame_index) - frame_index - 1 AS gap
  FROM v_boxes WHERE visible)"""
STATS = BOX + ", " + PAIR + ", " + GAPS + """,
co AS (SELECT sequence_id, count(*) AS c FROM (SELECT sequence_id, frame_index FROM v_boxes WHERE visible GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1),
ov AS (SELECT sequence_id, count(DISTINCT frame_index) AS c FROM pr WHERE iou > 0 GROUP BY 1),
g AS (SELECT sequence_id, count(*) AS n, coalesce(max(gap), 0) AS mg, count(*) FILTER (WHERE gap IN (1, 2)) AS s, count(*) FILTER (WHERE gap >= 3) AS l FROM vis GROUP BY 1),
i AS (SELECT sequence_id, count(DISTINCT instance_id) AS instances FROM v_boxes GROUP BY 1),
st AS (SELECT i.sequence_id, instances, coalesce(n, 0) AS visible_track_frames, coalesce(co.c, 0) AS co_visible_frames, coalesce(ov.c, 0) AS overlap_frames,
  greatest(coalesce(mg, 0), 0) AS max_internal_gap, concat_ws(';', CASE WHEN co.c > 0 THEN 'ordinary_continuity' END, CASE WHEN s > 0 THEN 'short_occlusion_candidate' END,
  CASE WHEN l > 0 THEN 'long_gap_reentry_candidate' END, CASE WHEN ov.c > 0 THEN 'crossing_close_interaction_candidate' END) AS hints
  FROM i LEFT JOIN g USING (sequence_id) LEFT JOIN co USING (sequence_id) LEFT JOIN ov USING (sequence_id))"""


@query("instance_sequence_stats", "A29 E7", STATS + " SELECT * FROM st")
def instance_sequence_stats(spark, sf):
    return ins.instance_sequence_stats(views.boxes(spark, sf)).withColumn("hints", F.array_join("hints", ";"))


@query("rank_sequences", "K10", STATS + """ SELECT sequence_id, instances, co_visible_frames, max_internal_gap, row_number() OVER (ORDER BY instances DESC,
 co_visible_frames DESC, max_internal_gap DESC, overlap_frames DESC, visible_track_frames DESC, sequence_id) AS selection_rank FROM st WHERE instances >= 2""")
def rank_sequences(spark, sf):
    s = ins.rank_sequences(ins.instance_sequence_stats(views.boxes(spark, sf)))
    return s.select("sequence_id", "instances", "co_visible_frames", "max_internal_gap", "selection_rank")


COUNTS = {
    "spark": "transform(sequence(0, CAST(event_id % 6 AS INT)), i -> (event_id * (i + 3)) % 50)",
    "duckdb": "list_transform(range(0, event_id % 6 + 1), lambda i: (event_id * (i + 3)) % 50)",
}


@query("interval_mask_runs", "S12", f"""
WITH c AS (SELECT event_id, {COUNTS['duckdb']} AS c FROM events WHERE event_id % 23 <> 0),
u AS (SELECT event_id, c, unnest(range(1, len(c) + 1)) AS p FROM c)
SELECT event_id, CAST(coalesce(list_sum(c[1:p-1]), 0) AS BIGINT) AS start, c[p] AS len FROM u WHERE p % 2 = 0 AND c[p] > 0
UNION ALL SELECT event_id, CAST(list_sum(c) AS BIGINT), 1000 - CAST(list_sum(c) AS BIGINT) FROM c WHERE len(c) % 2 = 1""")
def interval_mask_runs(spark, sf):
    return ins.interval_mask_runs(interval_masks(spark, sf), ["event_id"])[0]


def interval_masks(spark, sf):
    c = table(spark, sf, "events").selectExpr("event_id", f"{COUNTS['spark']} AS c")
    return c.selectExpr("event_id", "40 AS height", "25 AS width", "IF(event_id % 23 = 0, c, concat(c, array(1000 - aggregate(c, 0L, (a, x) -> a + x)))) AS counts")


@query("interval_mask_errors", "S12", f"""
SELECT event_id, 'runs_do_not_fill_mask' AS errors FROM (SELECT event_id, {COUNTS['duckdb']} AS c FROM events WHERE event_id % 23 = 0) WHERE list_sum(c) <> 1000""")
def interval_mask_errors(spark, sf):
    return ins.interval_mask_runs(interval_masks(spark, sf), ["event_id"])[1].withColumn("errors", F.array_join("errors", ";"))


@query("overlapping_mask_conflicts", "J7", RUN + """,
m AS (SELECT b.sequence_id, b.frame_index, b.instance_id, b.start, max({'stop': a.start + a.len, 'owner': a.instance_id}) AS o FROM v_runs b JOIN v_runs a
 ON a.sequence_id = b.sequence_id AND a.frame_index = b.frame_index AND (a.start < b.start OR (a.start = b.start AND a.instance_id < b.instance_id)) GROUP BY ALL)
SELECT sequence_id, frame_index, instance_id, start, o.owner AS conflict_with FROM m WHERE o.stop > start AND o.owner <> instance_id""")
def overlapping_mask_conflicts(spark, sf):
    return ins.overlapping_masks(views.runs(spark, sf))


@query("overlapping_masks", "J7", RUN + """
SELECT b.sequence_id, b.frame_index, b.instance_id, b.start FROM v_runs b WHERE EXISTS (SELECT 1 FROM v_runs a WHERE a.sequence_id = b.sequence_id
 AND a.frame_index = b.frame_index AND a.instance_id <> b.instance_id AND (a.start < b.start OR (a.start = b.start AND a.instance_id < b.instance_id)) AND a.start + a.len > b.start)""")
def overlapping_masks(spark, sf):
    return ins.overlapping_masks(views.runs(spark, sf)).drop("conflict_with")


PIX = RUN + """, px AS (SELECT sequence_id, frame_index, instance_id, unnest(range(start, start + len)) AS p FROM v_runs),
d AS (SELECT DISTINCT * FROM px)"""


@query("mask_stats", "A27", PIX.replace("SELECT DISTINCT * FROM px", "SELECT * FROM px") + """
SELECT sequence_id, frame_index, instance_id, count(*) AS area, min(p // 40) AS x0, max(p // 40) AS x1, min(p % 40) AS y0, max(p % 40) AS y1,
 round(avg(p // 40), 6) AS cx, round(avg(p % 40), 6) AS cy, round(count(*) / 1000, 6) AS area_fraction FROM d GROUP BY 1, 2, 3""")
def mask_stats(spark, sf):
    out = ins.mask_stats(views.runs(spark, sf), 40, 25, ["sequence_id", "frame_index", "instance_id"])
    return out.withColumns({c: r6(c) for c in ("cx", "cy", "area_fraction")}).withColumns({c: F.col(c).cast("long") for c in ("y0", "y1")})


@query("mask_iou", "A28", PIX + """,
a AS (SELECT sequence_id, frame_index, instance_id, p FROM d), b AS (SELECT sequence_id, frame_index, (instance_id + 4) % 5 AS instance_id, p FROM d),
j AS (SELECT coalesce(a.sequence_id, b.sequence_id) AS sequence_id, coalesce(a.frame_index, b.frame_index) AS frame_index, coalesce(a.instance_id, b.instance_id) AS instance_id,
  a.p IS NOT NULL AND b.p IS NOT NULL AS hit FROM a FULL JOIN b ON a.sequence_id = b.sequence_id AND a.frame_index = b.frame_index AND a.instance_id = b.instance_id AND a.p = b.p)
SELECT sequence_id, frame_index, instance_id, count(*) FILTER (WHERE hit) AS intersection, round(count(*) FILTER (WHERE hit) / count(*), 6) AS iou FROM j GROUP BY 1, 2, 3""")
def mask_iou(spark, sf):
    """Every instance against the next one of its frame."""
    r = views.runs(spark, sf)
    following = r.withColumn("instance_id", (F.col("instance_id") + 4) % 5)
    return ins.mask_iou(r, following, ["sequence_id", "frame_index", "instance_id"]).withColumn("iou", r6("iou"))


@query("stable_instance_ids", "E18", """
WITH a AS (SELECT DISTINCT event_id // 500 AS sequence_id, user_id AS annotation_id FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY annotation_id) AS stable_id FROM a)
SELECT *, CASE WHEN stable_id > 100 THEN 'too_many_instances' END AS error FROM r""")
def stable_instance_ids(spark, sf):
    a = table(spark, sf, "events").selectExpr("event_id div 500 AS sequence_id", "user_id AS annotation_id")
    return ins.stable_instance_ids(a, limit=100)


@query("validate_tracks", "V14", """
SELECT vec_id, concat_ws(';', CASE WHEN vec_id % 5 = 2 THEN 'bboxes_length_mismatch' END, CASE WHEN vec_id % 13 = 1 THEN 'dimension_not_positive' END,
 CASE WHEN vec_id % 7 = 3 THEN 'segmentations_length_mismatch' END) AS errors FROM embeddings""")
def validate_tracks(spark, sf):
    t = table(spark, sf, "embeddings").selectExpr(
        "vec_id", "64 AS length", "IF(vec_id % 13 = 1, 0, 480) AS height", "640 AS width",
        "IF(vec_id % 7 = 3, slice(embedding, 1, 60), embedding) AS segmentations",
        "CASE WHEN vec_id % 5 = 2 THEN slice(embedding, 1, 3) WHEN vec_id % 5 = 3 THEN embedding END AS bboxes",
        "CAST(NULL AS array<string>) AS file_names")
    return ins.validate_tracks(t).select("vec_id", F.array_join(F.array_sort("errors"), ";").alias("errors"))


PIXELS = """px AS (SELECT l_suppkey % 10 AS sequence_id, l_suppkey AS region, l_partkey % 256 AS r, (l_orderkey * 3) % 256 AS g, CAST(l_quantity * 5 AS BIGINT) AS b FROM lineitem),
c AS (SELECT sequence_id, region, ((r * 4 // 256) * 4 + (g * 4 // 256)) * 4 + least(b * 4 // 256, 3) AS bin, count(*) AS n FROM px GROUP BY 1, 2, 3),
h AS (SELECT sequence_id, region, bin, n / sum(n) OVER (PARTITION BY sequence_id, region) AS share FROM c)"""


def pixels(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "l_suppkey % 10 AS sequence_id", "l_suppkey AS region", "l_partkey % 256 AS r", "(l_orderkey * 3) % 256 AS g",
        "CAST(l_quantity * 5 AS BIGINT) AS b")


@query("quantised_histogram", "A25 F11", "WITH " + PIXELS + " SELECT sequence_id, region, bin, round(share, 6) AS share FROM h")
def quantised_histogram(spark, sf):
    return ins.quantised_histogram(pixels(spark, sf), ["sequence_id", "region"], 4).withColumn("share", r6("share"))


JSD = """, s AS (SELECT sequence_id, bin, share AS q FROM h WHERE region < 10),
k AS (SELECT DISTINCT sequence_id, region FROM h), gb AS (SELECT DISTINCT sequence_id, bin FROM h),
j AS (SELECT k.sequence_id, k.region, coalesce(h.share, 0.0) AS p, coalesce(s.q, 0.0) AS q FROM k JOIN gb USING (sequence_id)
  LEFT JOIN h ON h.sequence_id = k.sequence_id AND h.region = k.region AND h.bin = gb.bin LEFT JOIN s ON s.sequence_id = k.sequence_id AND s.bin = gb.bin),
jsd AS (SELECT sequence_id, region, (sum(CASE WHEN p > 0 THEN p * log2(p / greatest((p + q) / 2, 1e-12)) ELSE 0 END)
  + sum(CASE WHEN q > 0 THEN q * log2(q / greatest((p + q) / 2, 1e-12)) ELSE 0 END)) / 2 AS jsd FROM j GROUP BY 1, 2)"""


@query("seed_divergence", "A26 A25", "WITH " + PIXELS + JSD + " SELECT sequence_id, region, round(jsd, 6) + 0.0 AS jsd FROM jsd")
def seed_divergence(spark, sf):
    h = ins.quantised_histogram(pixels(spark, sf), ["sequence_id", "region"], 4)
    return ins.seed_divergence(h, h.where("region < 10"), ["sequence_id"], "region").withColumn("jsd", r6("jsd"))


@query("js_divergence", "A26", "WITH " + PIXELS + """,
a AS (SELECT sequence_id, region // 20 AS pair, bin, share AS p FROM h WHERE region % 20 < 10), b AS (SELECT sequence_id, region // 20 AS pair, bin, share AS q FROM h WHERE region % 20 >= 10),
j AS (SELECT coalesce(a.sequence_id, b.sequence_id) AS sequence_id, coalesce(a.pair, b.pair) AS pair, coalesce(p, 0.0) AS p, coalesce(q, 0.0) AS q FROM a FULL JOIN b ON a.sequence_id = b.sequence_id AND a.pair = b.pair AND a.bin = b.bin)
SELECT sequence_id, pair, round((sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)) / 2, 6) AS jsd
FROM j GROUP BY 1, 2""")
def js_divergence(spark, sf):
    """Of every twenty regions the first ten against the other ten."""
    h = ins.quantised_histogram(pixels(spark, sf), ["sequence_id", "region"], 4).withColumn("pair", F.expr("region div 20"))
    return ins.js_divergence(h.where("region % 20 < 10"), h.where("region % 20 >= 10"), ["sequence_id", "pair"]).withColumn("jsd", r6("jsd"))


@query("assign_target", "K8 A25 A26 E6", "WITH " + PIXELS + JSD + """,
f AS (SELECT DISTINCT sequence_id, region // 20 AS frame_index FROM h),
cd AS (SELECT sequence_id, region // 20 AS frame_index, region AS ci, round(jsd, 9) AS jsd, row_number() OVER (PARTITION BY sequence_id, region // 20 ORDER BY round(jsd, 9), -(region % 3), region) AS rn,
  count(*) OVER (PARTITION BY sequence_id, region // 20) AS n FROM jsd WHERE region >= 10)
SELECT f.sequence_id, f.frame_index, coalesce(n, 0) AS candidate_count, coalesce(jsd <= 0.04, false) AS accepted, CASE WHEN jsd <= 0.04 THEN ci END AS selected,
  CASE WHEN jsd <= 0.04 THEN round(jsd, 6) END AS jsd FROM f LEFT JOIN (SELECT * FROM cd WHERE rn = 1) c ON c.sequence_id = f.sequence_id AND c.frame_index = f.frame_index""")
def assign_target(spark, sf):
    h = ins.quantised_histogram(pixels(spark, sf), ["sequence_id", "region"], 4)
    d = ins.seed_divergence(h, h.where("region < 10"), ["sequence_id"], "region")
    cand = d.where("region >= 10").selectExpr("sequence_id", "region div 20 AS frame_index", "region AS candidate_index", "round(jsd, 9) AS jsd",
                                              "region % 3 AS n_confident", "1.0D AS mean_score", "'R3' AS seed_tier")
    frames = h.selectExpr("sequence_id", "region div 20 AS frame_index")
    return ins.assign_target(cand, frames, threshold=0.04).drop("error").withColumn("jsd", r6("jsd"))


@query("seed_box", "K9", views.with_views("v_track") + """,
g AS (SELECT sequence_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM v_track WHERE visible GROUP BY 1)
SELECT sequence_id, round(x0 - greatest(1.0, x1 - x0) * 0.05, 6) AS x0, round(y0 - greatest(1.0, y1 - y0) * 0.05, 6) AS y0,
 round(x1 + greatest(1.0, x1 - x0) * 0.05, 6) AS x1, round(y1 + greatest(1.0, y1 - y0) * 0.05, 6) AS y1 FROM g""")
def seed_box(spark, sf):
    out = ins.seed_box(views.track(spark, sf).where("visible"))
    return out.withColumns({c: r6(c) for c in ("x0", "y0", "x1", "y1")})


@query("prompt_hits", "K2", PIX + """,
pt AS (SELECT event_id // 200 AS sequence_id, (event_id % 200) // 10 AS frame_index, event_id AS point_id, event_id % 2 = 0 AS positive,
  (event_id * 7) % 25 AS x, (event_id * 11) % 40 AS y FROM events),
off AS (SELECT a.d AS dx, b.d AS dy FROM (VALUES (-2),(-1),(0),(1),(2)) a(d), (VALUES (-2),(-1),(0),(1),(2)) b(d)),
hit AS (SELECT DISTINCT pt.sequence_id, pt.frame_index, point_id, positive, instance_id FROM pt JOIN off ON abs(dx) <= CASE WHEN positive THEN 2 ELSE 1 END AND abs(dy) <= CASE WHEN positive THEN 2 ELSE 1 END
  JOIN d ON d.sequence_id = pt.sequence_id AND d.frame_index = pt.frame_index AND x + dx BETWEEN 0 AND 24 AND y + dy BETWEEN 0 AND 39 AND d.p = (x + dx) * 40 + y + dy),
n AS (SELECT sequence_id, frame_index, count(*) FILTER (WHERE positive) AS np, count(*) FILTER (WHERE NOT positive) AS nn FROM pt GROUP BY 1, 2),
h AS (SELECT sequence_id, frame_index, instance_id, count(*) FILTER (WHERE positive) AS hp, count(*) FILTER (WHERE NOT positive) AS hn FROM hit GROUP BY 1, 2, 3)
SELECT m.sequence_id, m.frame_index, m.instance_id, round(coalesce(hp, 0) / np, 6) AS positive_inside, round((nn - coalesce(hn, 0)) / nn, 6) AS negative_outside
FROM (SELECT DISTINCT sequence_id, frame_index, instance_id FROM v_runs) m JOIN n USING (sequence_id, frame_index) LEFT JOIN h USING (sequence_id, frame_index, instance_id)""")
def prompt_hits(spark, sf):
    points = table(spark, sf, "events").selectExpr(
        "event_id div 200 AS sequence_id", "(event_id % 200) div 10 AS frame_index", "event_id AS point_id", "event_id % 2 = 0 AS positive",
        "(event_id * 7) % 25 * 1.0D AS x", "(event_id * 11) % 40 * 1.0D AS y")
    out = ins.prompt_hits(points, views.runs(spark, sf), 40, 25, ["sequence_id", "frame_index"], ["instance_id"], 2, 1, cell=64)
    return out.withColumns({c: r6(c) for c in ("positive_inside", "negative_outside")})


def _rank_sql(order):
    return f"""SELECT event_id // 8 AS prompt_id, event_id AS pos, row_number() OVER (PARTITION BY event_id // 8 ORDER BY {order}, event_id) AS rank
 FROM (SELECT *, (event_id * 5 % 3) / 2.0 AS pin, (event_id * 7 % 2) / 1.0 AS nout, (event_id % 5) > 0 AS geo, (event_id * 11 % 4) / 8.0 AS area, (event_id * 13 % 4) / 4.0 AS iou FROM events)"""


def _candidates(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "event_id div 8 AS prompt_id", "event_id AS pos", "(event_id * 5 % 3) / 2.0D AS positive_inside", "(event_id * 7 % 2) / 1.0D AS negative_outside",
        "(event_id % 5) > 0 AS geometry_valid", "(event_id * 11 % 4) / 8.0D AS area_fraction", "(event_id * 13 % 4) / 4.0D AS iou")


@query("rank_candidates_part", "K1", _rank_sql("pin DESC, nout DESC, geo DESC, area, iou DESC"))
def rank_part(spark, sf):
    return ins.rank_candidates(_candidates(spark, sf), ["prompt_id"], "part").select("prompt_id", "pos", "rank")


@query("rank_candidates_whole", "K1", _rank_sql("pin DESC, nout DESC, iou DESC, area"))
def rank_whole(spark, sf):
    return ins.rank_candidates(_candidates(spark, sf), ["prompt_id"], "whole").select("prompt_id", "pos", "rank")


TRACKS = """tk AS (SELECT event_id // 250 AS sequence_id, event_id % 250 AS frame_index, event_type <> 'error' AND event_id % 11 <> 4 AS ok, value AS x, (event_id * 13 % 100)::DOUBLE AS y,
  CASE WHEN event_id % 50 = 7 THEN 0.0 WHEN (event_id // 250) % 3 = 0 THEN 0.02 ELSE (event_id * 29 % 60) / 400.0 END AS area FROM events),
sd AS (SELECT sequence_id, 0.01 + (sequence_id % 4) * 0.01 AS seed_area, 0.85 + (sequence_id % 3) * 0.05 AS seed_iou FROM tk GROUP BY 1)"""


def tracks(spark, sf):
    t = table(spark, sf, "events").selectExpr(
        "event_id div 250 AS sequence_id", "event_id % 250 AS frame_index", "event_type <> 'error' AND event_id % 11 <> 4 AS ok", "value AS x",
        "(event_id * 13 % 100) * 1.0D AS y",
        "CASE WHEN event_id % 50 = 7 THEN 0.0D WHEN (event_id div 250) % 3 = 0 THEN 0.02D ELSE (event_id * 29 % 60) / 400.0D END AS area_fraction")
    seeds = t.select("sequence_id").distinct().selectExpr(
        "sequence_id", "0.01D + (sequence_id % 4) * 0.01D AS seed_area", "0.85D + (sequence_id % 3) * 0.05D AS seed_iou")
    return t, seeds


@query("curve_track_summary", "A30 E4", "WITH " + TRACKS + """,
n AS (SELECT *, lag(frame_index) OVER w AS pf, sqrt((x - lag(x) OVER w)**2 + (y - lag(y) OVER w)**2) / 800 AS st, abs(x - lag(x) OVER w) / 800 AS tp FROM tk WHERE ok
  WINDOW w AS (PARTITION BY sequence_id ORDER BY frame_index)),
s AS (SELECT sequence_id, avg(st) AS rm, max(st) AS rx, avg(tp) AS tm, max(tp) AS tx FROM n WHERE pf = frame_index - 1 GROUP BY 1),
c AS (SELECT sequence_id, count(*) AS t, count(*) FILTER (WHERE ok) AS k, count(*) FILTER (WHERE area > greatest(0.01, seed_area * 4)) AS e,
  count(*) FILTER (WHERE ok AND x < 8.0) AS g, any_value(seed_iou >= 0.9) AS sp FROM tk JOIN sd USING (sequence_id) GROUP BY 1)
SELECT sequence_id, t AS frames_total, k AS frames_with_curve, round(k / t, 6) AS coverage, sp AS seed_preserved, e AS expansion_frames, g AS degenerate_frames,
 round(rm, 6) AS mean_root_step, round(rx, 6) AS max_root_step, round(tm, 6) AS mean_tip_step, round(tx, 6) AS max_tip_step,
 CASE WHEN k / t >= 0.75 AND sp AND e = 0 AND g = 0 THEN 'pass' ELSE 'revise' END AS feasibility FROM c LEFT JOIN s USING (sequence_id)""")
def curve_track_summary(spark, sf):
    t, seeds = tracks(spark, sf)
    f = t.selectExpr("*", "x AS curve_length", "x AS root_x", "y AS root_y", "x AS tip_x", "0.0D AS tip_y")
    out = ins.curve_track_summary(f, seeds, 800.0)
    return out.withColumns({c: r6(c) for c in ("coverage", "mean_root_step", "max_root_step", "mean_tip_step", "max_tip_step")})


@query("region_track_summary", "A31 E4", "WITH " + TRACKS + """,
n AS (SELECT *, lag(frame_index) OVER w AS pf, lag(ok) OVER w AS po, sqrt((x - lag(x) OVER w)**2 + (y - lag(y) OVER w)**2) / 800 AS st FROM tk
  WINDOW w AS (PARTITION BY sequence_id ORDER BY frame_index)),
s AS (SELECT sequence_id, avg(st) AS m, max(st) AS x FROM n WHERE pf = frame_index - 1 AND ok AND po GROUP BY 1),
c AS (SELECT sequence_id, count(*) AS t, avg((area > 0)::DOUBLE) AS cov, count(*) FILTER (WHERE area > greatest(0.15, seed_area * 4)) AS e,
  count(*) FILTER (WHERE area > 0 AND area < seed_area * 0.12) AS k, count(*) FILTER (WHERE area = 0) AS z, avg(y / 100) AS mj, max(y / 100) AS xj, any_value(seed_iou >= 0.9) AS sp
  FROM tk JOIN sd USING (sequence_id) GROUP BY 1)
SELECT sequence_id, t AS frames_total, round(cov, 6) AS coverage, sp AS seed_preserved, e AS expansion_frames, k AS collapse_frames, z AS empty_frames,
 round(m, 6) AS mean_step, round(s.x, 6) AS max_step, round(mj, 6) AS mean_jsd, round(xj, 6) AS max_jsd, CASE WHEN sp AND e = 0 AND k = 0 AND z = 0 THEN 'pass' ELSE 'revise' END AS feasibility
FROM c LEFT JOIN s USING (sequence_id)""")
def region_track_summary(spark, sf):
    t, seeds = tracks(spark, sf)
    f = t.selectExpr("sequence_id", "frame_index", "area_fraction", "CAST(area_fraction * 480000 AS BIGINT) AS area_px", "IF(ok, x, NULL) AS cx", "IF(ok, y, NULL) AS cy", "y / 100 AS jsd")
    out = ins.region_track_summary(f, seeds, 800.0)
    return out.withColumns({c: r6(c) for c in ("coverage", "mean_step", "max_step", "mean_jsd", "max_jsd")})


@query("flag_track_frames", "A30 A31", "WITH " + TRACKS + """, j AS (SELECT * FROM tk JOIN sd USING (sequence_id))
SELECT 'curve' AS profile, sequence_id, frame_index, 'failed' AS flag FROM j WHERE NOT ok UNION ALL SELECT 'curve', sequence_id, frame_index, 'degenerate' FROM j WHERE ok AND x < 8.0
UNION ALL SELECT 'curve', sequence_id, frame_index, 'expansion' FROM j WHERE area > greatest(0.01, seed_area * 4) UNION ALL SELECT 'region', sequence_id, frame_index, 'expansion' FROM j WHERE area > greatest(0.15, seed_area * 4)
UNION ALL SELECT 'region', sequence_id, frame_index, 'collapse' FROM j WHERE area > 0 AND area < seed_area * 0.12 UNION ALL SELECT 'region', sequence_id, frame_index, 'empty' FROM j WHERE area = 0""")
def flag_track_frames(spark, sf):
    t, seeds = tracks(spark, sf)
    f = t.selectExpr("*", "x AS curve_length", "CAST(area_fraction * 480000 AS BIGINT) AS area_px")
    one = lambda p: ins.flag_track_frames(f, seeds, 800.0, p).select(F.lit(p).alias("profile"), "*")
    return one("curve").unionByName(one("region"))


CURVES = """cv AS (SELECT o_orderkey // 8 AS curve_id, (o_orderkey // 8) // 20 AS sequence_id, (o_orderkey // 8) % 20 AS frame_index, o_orderkey % 8 AS pos, (o_orderkey % 8) / 7.0 AS u,
  10.0 * (o_orderkey % 8) + floor(o_totalprice / 1000) / 64 AS x, (o_custkey % 50)::DOUBLE AS y, CASE WHEN o_custkey % 40 = 3 THEN 'occluded' ELSE 'visible' END AS visibility,
  10.0 * (o_orderkey % 8) + o_custkey % 7 AS px, (o_custkey % 50)::DOUBLE + 2 AS py, CASE WHEN o_custkey % 30 = 4 THEN 'occluded' ELSE 'partially_visible' END AS pvis, max(o_orderkey % 8) OVER (PARTITION BY o_orderkey // 8) AS mp FROM orders)"""
RESAMPLE = """{n}s AS (SELECT curve_id, pos, {x} AS x, {y} AS y, lead({x}) OVER w AS nx, lead({y}) OVER w AS ny FROM cv WINDOW w AS (PARTITION BY curve_id ORDER BY pos)),
{n}d AS (SELECT *, coalesce(sqrt((nx - x)**2 + (ny - y)**2), 0) AS d FROM {n}s),
{n}c AS (SELECT *, sum(d) OVER (PARTITION BY curve_id ORDER BY pos) AS c1, sum(d) OVER (PARTITION BY curve_id) AS total FROM {n}d),
{n}g AS (SELECT *, c1 - d AS c0, row_number() OVER (PARTITION BY curve_id ORDER BY pos) AS k FROM {n}c),
{n}r AS (SELECT curve_id, j, x + a * (nx - x) AS x, y + a * (ny - y) AS y FROM (SELECT *, CASE WHEN total <= 1e-12 OR d <= 1e-12 THEN 0.0 ELSE (total * j / 31.0 - c0) / d END AS a,
   row_number() OVER (PARTITION BY curve_id, j ORDER BY pos) AS rn FROM {n}g CROSS JOIN (SELECT unnest(range(32)) AS j) t WHERE nx IS NOT NULL AND (c1 >= total * j / 31.0 - 1e-9 OR k = 7)) WHERE rn = 1)"""


def curves(spark, sf):
    c = table(spark, sf, "orders").selectExpr(
        "o_orderkey div 8 AS curve_id", "(o_orderkey div 8) div 20 AS sequence_id", "(o_orderkey div 8) % 20 AS frame_index", "o_orderkey % 8 AS pos", "(o_orderkey % 8) / 7.0D AS u",
        "10.0D * (o_orderkey % 8) + floor(o_totalprice / 1000) / 64 AS x", "(o_custkey % 50) * 1.0D AS y", "IF(o_custkey % 40 = 3, 'occluded', 'visible') AS visibility",
        "10.0D * (o_orderkey % 8) + o_custkey % 7 AS px", "(o_custkey % 50) + 2.0D AS py", "IF(o_custkey % 30 = 4, 'occluded', 'partially_visible') AS pvis")
    pred = c.selectExpr("curve_id", "sequence_id", "frame_index", "pos", "u", "px AS x", "py AS y", "pvis AS visibility")
    return c.drop("px", "py", "pvis"), pred


@query("resample_curve", "E12", "WITH " + CURVES + ", " + RESAMPLE.format(n="r", x="x", y="y") + " SELECT curve_id, j, round(x, 6) AS x, round(y, 6) + 0.0 AS y FROM rr")
def resample_curve(spark, sf):
    ref, _ = curves(spark, sf)
    return ins.resample_curve(ref, ["curve_id"]).withColumns({"x": r6("x"), "y": r6("y")})


CURVE_ERR = CURVES + ", " + RESAMPLE.format(n="r", x="x", y="y") + ", " + RESAMPLE.format(n="p", x="px", y="py") + """,
ce AS (SELECT curve_id, avg(sqrt((a.x-b.x)**2 + (a.y-b.y)**2)) AS m, max(sqrt((a.x-b.x)**2 + (a.y-b.y)**2)) AS mx FROM rr a JOIN pr b USING (curve_id, j) GROUP BY 1),
en AS (SELECT curve_id, any_value(sequence_id) AS sequence_id, any_value(frame_index) AS frame_index, avg((visibility = 'visible')::DOUBLE) AS f,
  max(CASE WHEN pos = 0 AND visibility = 'visible' AND pvis <> 'occluded' THEN sqrt((x-px)**2 + (y-py)**2) END) AS be,
  max(CASE WHEN pos = mp AND visibility = 'visible' AND pvis <> 'occluded' THEN sqrt((x-px)**2 + (y-py)**2) END) AS te FROM cv GROUP BY 1),
cr AS (SELECT en.*, CASE WHEN f = 1 THEN m / 800 END AS cm, CASE WHEN f = 1 THEN mx / 800 END AS cx FROM en JOIN ce USING (curve_id))"""


@query("curve_error", "E13 E12", "WITH " + CURVE_ERR + """ SELECT curve_id, round(f, 6) AS observable_fraction, round(be / 800, 6) AS base_error, round(te / 800, 6) AS tip_error,
 round(cm, 6) AS curve_mean_error, round(cx, 6) AS curve_max_error FROM cr""")
def curve_error(spark, sf):
    ref, pred = curves(spark, sf)
    out = ins.curve_error(ref, pred, ["curve_id"], 800.0)
    return out.withColumns({c: r6(c) for c in out.columns if c != "curve_id"})


@query("validate_curves", "V13", """
WITH c AS (SELECT o_orderkey // 8 AS curve_id, o_orderkey % 8 AS pos, CASE WHEN (o_orderkey // 8) % 9 = 4 AND o_orderkey % 8 = 3 THEN 2 ELSE o_orderkey % 8 END / 7.0 AS u FROM orders
  WHERE NOT ((o_orderkey // 8) % 11 = 5 AND o_orderkey % 8 > 0) AND NOT ((o_orderkey // 8) % 13 = 6 AND o_orderkey % 8 = 7)),
l AS (SELECT *, lag(u) OVER (PARTITION BY curve_id ORDER BY pos) AS pu FROM c),
g AS (SELECT curve_id, count(*) AS n, count(*) FILTER (WHERE u <= pu) AS back, arg_min(u, pos) AS u0, arg_max(u, pos) AS u1 FROM l GROUP BY 1)
SELECT curve_id, concat_ws(';', CASE WHEN n < 2 THEN 'too_few_samples' END, CASE WHEN abs(u0) > 1e-9 OR abs(u1 - 1) > 1e-9 THEN 'u_ends_not_0_1' END,
 CASE WHEN back > 0 THEN 'u_not_increasing' END) AS errors FROM g""")
def validate_curves(spark, sf):
    ref, _ = curves(spark, sf)
    c = ref.where("NOT (curve_id % 11 = 5 AND pos > 0) AND NOT (curve_id % 13 = 6 AND pos = 7)").withColumn(
        "u", F.expr("IF(curve_id % 9 = 4 AND pos = 3, 2, pos) / 7.0D"))
    return ins.validate_curves(c, ["curve_id"]).withColumn("errors", F.array_join(F.array_sort("errors"), ";"))


EARS = """er AS (SELECT event_id // 2 AS frame_id, (event_id // 2) // 50 AS sequence_id, event_id % 2 AS side, value AS x, (event_id * 13 % 100)::DOUBLE AS y, event_id % 7 = 0 AS hid, event_id % 9 = 0 AS phid, event_id % 10 = 4 AS gone FROM events),
em AS (SELECT frame_id, sequence_id, side, gone, CASE WHEN hid OR gone THEN NULL ELSE 2.0 / 800 END AS base_medial_error, CASE WHEN gone THEN NULL ELSE 3.0 / 800 END AS base_lateral_error,
  CASE WHEN phid OR gone THEN NULL ELSE 5.0 / 800 END AS tip_error, CASE WHEN hid OR phid OR gone THEN NULL ELSE sqrt(1.0 + 1.5**2) / 800 END AS base_centre_error,
  -- axis: reference (5, 20) from its base centre; prediction shifted by (+3-1, +4-1.5)
  CASE WHEN hid OR phid OR gone THEN NULL ELSE degrees(acos((5.0 * 7.0 + 20.0 * 22.5) / (sqrt(425.0) * sqrt(49.0 + 22.5**2)))) END AS axis_error_deg FROM er)"""


def ears(spark, sf):
    e = table(spark, sf, "events").selectExpr(
        "event_id div 2 AS frame_id", "(event_id div 2) div 50 AS sequence_id", "event_id % 2 AS side", "value AS x", "(event_id * 13 % 100) * 1.0D AS y",
        "event_id % 7 = 0 AS hid", "event_id % 9 = 0 AS phid", "event_id % 10 = 4 AS gone")
    pt = lambda dx, dy, v: f"named_struct('x', x + {dx}D, 'y', y + {dy}D, 'visibility', {v})"
    ref = e.selectExpr("sequence_id", "frame_id", "side", pt(0.0, 0.0, "IF(hid, 'occluded', 'visible')") + " AS base_medial", pt(10.0, 0.0, "'visible'") + " AS base_lateral",
                       pt(10.0, 20.0, "'visible'") + " AS tip")
    pred = e.where("NOT gone").selectExpr("sequence_id", "frame_id", "side", pt(2.0, 0.0, "'visible'") + " AS base_medial", pt(10.0, 3.0, "'visible'") + " AS base_lateral",
                                          pt(13.0, 24.0, "IF(phid, 'out_of_frame', 'visible')") + " AS tip")
    return ref, pred


@query("ear_error", "E14 F6", "WITH " + EARS + """ SELECT frame_id, side, gone AS missing_prediction, round(base_medial_error, 6) AS base_medial_error, round(base_lateral_error, 6) AS base_lateral_error,
 round(tip_error, 6) AS tip_error, round(base_centre_error, 6) AS base_centre_error, round(axis_error_deg, 6) AS axis_error_deg FROM em""")
def ear_error(spark, sf):
    ref, pred = ears(spark, sf)
    out = ins.ear_error(ref, pred, ["sequence_id", "frame_id", "side"], 800.0).drop("sequence_id")
    return out.withColumns({c: r6(c) for c in out.columns if c.endswith(("_error", "_deg"))})


@query("detail_summary", "A33", "WITH " + EARS + ", " + CURVE_ERR + """,
e AS (SELECT sequence_id, (sum(coalesce(base_medial_error, 0) + coalesce(base_lateral_error, 0) + coalesce(tip_error, 0))
   / nullif(count(base_medial_error) + count(base_lateral_error) + count(tip_error), 0)) AS m, avg(axis_error_deg) AS a FROM em GROUP BY 1),
c AS (SELECT sequence_id, avg(cm) AS m, count(cm) AS n FROM cr GROUP BY 1)
SELECT coalesce(e.sequence_id, c.sequence_id) AS sequence_id, round(e.m, 6) AS mean_ear_point_error, round(a, 6) AS mean_ear_axis_error_deg, round(c.m, 6) AS mean_curve_error, n AS fully_observable_frames
FROM e FULL JOIN c ON e.sequence_id = c.sequence_id""")
def detail_summary(spark, sf):
    rp, ref = ears(spark, sf), curves(spark, sf)
    e = ins.ear_error(*rp, ["sequence_id", "frame_id", "side"], 800.0)
    c = ins.curve_error(*ref, ["curve_id", "sequence_id"], 800.0)
    out = ins.detail_summary(e, c)
    return out.withColumns({c: r6(c) for c in ("mean_ear_point_error", "mean_ear_axis_error_deg", "mean_curve_error")})


@query("align_frames", "J1", """
WITH r AS (SELECT o_orderkey // 100 AS sequence_id, o_orderkey % 100 AS frame_index, 640 + (o_custkey % 50 = 3)::INT AS w FROM orders WHERE o_custkey % 30 <> 1),
p AS (SELECT o_orderkey // 100 AS sequence_id, o_orderkey % 100 AS frame_index, 640 AS w FROM orders WHERE o_custkey % 30 <> 2)
SELECT coalesce(r.sequence_id, p.sequence_id) AS sequence_id, coalesce(r.frame_index, p.frame_index) AS frame_index, CASE WHEN r.w IS NULL THEN 'frame_only_in_prediction'
 WHEN p.w IS NULL THEN 'frame_only_in_reference' WHEN r.w <> p.w THEN 'image_metadata_differs' END AS error
FROM r FULL JOIN p ON r.sequence_id = p.sequence_id AND r.frame_index = p.frame_index""")
def align_frames(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey div 100 AS sequence_id", "o_orderkey % 100 AS frame_index", "640 + IF(o_custkey % 50 = 3, 1, 0) AS w", "o_custkey AS c")
    return ins.align_frames(o.where("c % 30 <> 1").selectExpr("sequence_id", "frame_index", "w AS width", "480 AS height"),
                            o.where("c % 30 <> 2").selectExpr("sequence_id", "frame_index", "640 AS width", "480 AS height"))


@query("geometry_functions", "F4 F5 F6 F8 F10 F11 F12 F13", """
WITH e AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings)
SELECT vec_id, round(sqrt((e[1]-e[3])**2 + (e[2]-e[4])**2), 6) AS d2, round(sqrt((e[1]-e[4])**2 + (e[2]-e[5])**2 + (e[3]-e[6])**2), 6) AS d3,
 round(degrees(acos(greatest(-1.0, least(1.0, (e[1]*e[3] + e[2]*e[4]) / (sqrt(e[1]**2 + e[2]**2) * sqrt(e[3]**2 + e[4]**2)))))), 4) AS angle,
 ('0x' || substr(sha256('7|' || vec_id || '|a'), 1, 15))::BIGINT AS seed, sha256('x|' || vec_id) AS digest,
 abs(e[1] - e[2]) <= greatest(0.5 * greatest(abs(e[1]), abs(e[2])), 0.01) AS close, (e[1] > 0 AND e[1] IS NOT NULL) AS seg, round(coalesce(CASE WHEN e[1] > 0 THEN e[1] END, -1.0), 6) AS value,
 (NOT e[1] > 0)::DOUBLE AS missing, round(lgamma(1.0 + 1000 * abs(e[1])), 6) AS lg FROM e""")
def geometry_functions(spark, sf):
    e = table(spark, sf, "embeddings").selectExpr("vec_id", "transform(embedding, x -> CAST(x AS DOUBLE)) AS e")
    g = lambda i: F.col("e")[i]
    v, m = sentinel(F.when(g(0) > 0, g(0)))
    return e.select(
        "vec_id", r6(dist2(g(0), g(1), g(2), g(3))).alias("d2"), r6(dist3(g(0), g(1), g(2), g(3), g(4), g(5))).alias("d3"),
        r6(angle_deg(g(0), g(1), g(2), g(3)), 4).alias("angle"), derived_seed(7, "vec_id", F.lit("a")).alias("seed"), stable_hash(F.lit("x"), "vec_id").alias("digest"),
        is_close(g(0), g(1), 0.5, 0.01).alias("close"), seg_visible(F.array(F.when(g(0) > 0, 3).otherwise(0))).alias("seg"), r6(v).alias("value"), m.alias("missing"),
        r6(lgamma(F.lit(1.0) + F.abs(g(0)) * 1000)).alias("lg"))
