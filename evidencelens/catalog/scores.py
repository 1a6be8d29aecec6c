"""Prediction quality, score packets and summaries."""

from pyspark.sql import functions as F

from evidencelens import views
from evidencelens.catalog import query
from evidencelens.functions import finite, r6
from evidencelens.operators import metrics as m
from evidencelens.views import table

PB = views.with_views("v_proba")
PR = views.with_views("v_predictions")
SC = views.with_views("v_scores")
P = ["p0", "p1", "p2"]


def rounded(df, cols):
    return df.withColumns({c: r6(c) for c in cols})


@query("argmax_label", "M1", PB + " SELECT vec_id, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS label FROM v_proba")
def argmax_label(spark, sf):
    return views.proba(spark, sf).select("vec_id", m.argmax_label(P).alias("label"))


LIN = "[0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9]"


def multi_sql(src, key, k="fold", model=None):
    """Bundle SQL over ``src(key…, y, p0, p1, p2)`` for one grouping level."""
    cols = f"{key}, " if key else ""
    on = f"USING ({key})" if key else "ON true"
    group = f"GROUP BY {key}" if key else ""
    return f"""(WITH h AS (SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS hat, greatest(p0, p1, p2) AS cf,
   CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS py FROM {src}),
 c AS (SELECT {cols} k, count(*) FILTER (WHERE y = k) AS pos, count(*) FILTER (WHERE hat = k) AS hatn, count(*) FILTER (WHERE y = k AND hat = k) AS tp
   FROM h, (VALUES (0),(1),(2)) t(k) GROUP BY {cols} k),
 a AS (SELECT {cols} avg(tp / pos) FILTER (WHERE pos > 0) AS ba, avg(CASE WHEN pos + hatn > 0 THEN 2 * tp / (pos + hatn) END) AS f1 FROM c {group}),
 b AS (SELECT {cols} list_last(list_filter(range(10), lambda i: cf >= ({LIN})[i + 1])) AS bin, count(*) AS n, avg((y = hat)::DOUBLE) AS acc, avg(cf) AS conf FROM h GROUP BY {cols} bin),
 e AS (SELECT {cols} sum(n * abs(acc - conf)) / sum(n) AS ece FROM b {group}),
 l AS (SELECT {cols} count(*) AS n, -avg(ln(greatest(py, 2.220446049250313e-16))) AS ll,
   avg((p0 - (y=0)::INT)**2 + (p1 - (y=1)::INT)**2 + (p2 - (y=2)::INT)**2) AS br FROM h {group})
 SELECT {cols} n, round(ba, 6) AS balanced_accuracy, round(f1, 6) AS macro_f1, round(ll, 6) AS log_loss, round(br, 6) AS brier, round(ece, 6) AS ece
 FROM a JOIN e {on} JOIN l {on})"""


@query("metric_bundle", "M2 M3 M4 M5 M6 M8", PB + f" SELECT fold, * EXCLUDE (fold) FROM {multi_sql('v_proba', 'fold')} UNION ALL SELECT NULL, * FROM {multi_sql('v_proba', '')}")
def metric_bundle(spark, sf):
    return rounded(m.metric_bundle(views.proba(spark, sf), "y", P, [["fold"], []]), m.METRICS)


def binary_sql(src, key):
    cols = f"{key}, " if key else ""
    on = f"USING ({key})" if key else "ON true"
    group = f"GROUP BY {key}" if key else ""
    return f"""(WITH h AS (SELECT *, (p >= 0.5)::INT AS hat FROM {src}),
 c AS (SELECT {cols} k, count(*) FILTER (WHERE y = k) AS pos, count(*) FILTER (WHERE hat = k) AS hatn, count(*) FILTER (WHERE y = k AND hat = k) AS tp FROM h, (VALUES (0),(1)) t(k) GROUP BY {cols} k),
 a AS (SELECT {cols} avg(tp / pos) FILTER (WHERE pos > 0) AS ba, avg(CASE WHEN pos + hatn > 0 THEN 2 * tp / (pos + hatn) ELSE 0 END) AS f1 FROM c {group}),
 b AS (SELECT {cols} least(9, list_last(list_filter(range(10), lambda i: p >= i / 10))) AS bin, count(*) AS n, avg(y) AS acc, avg(p) AS conf FROM h GROUP BY {cols} bin),
 e AS (SELECT {cols} sum(n * abs(acc - conf)) / sum(n) AS ece FROM b {group}),
 l AS (SELECT {cols} count(*) AS n, -avg(CASE WHEN y = 1 THEN ln(greatest(p, 1e-9)) ELSE ln(1 - least(p, 1 - 1e-9)) END) AS ll, avg((p - y)**2) AS br FROM h {group})
 SELECT {cols} n, round(ba, 6) AS balanced_accuracy, round(f1, 6) AS macro_f1, round(ll, 6) AS log_loss, round(br, 6) AS brier, round(ece, 6) AS ece FROM a JOIN e {on} JOIN l {on})"""


@query("binary_bundle", "M2 M3 M4 M5 M7 M8", PR + f" SELECT fold, * EXCLUDE (fold) FROM {binary_sql('v_predictions', 'fold')} UNION ALL SELECT NULL, * FROM {binary_sql('v_predictions', '')}")
def binary_bundle(spark, sf):
    return rounded(m.binary_bundle(views.predictions(spark, sf), "y", "p", [["fold"], []]), m.METRICS)


@query("stratified_metrics", "M12", PR + f""" SELECT stratum, NULL AS fold, * EXCLUDE (stratum) FROM {binary_sql('v_predictions', 'stratum')}
 UNION ALL SELECT NULL, fold, * EXCLUDE (fold) FROM {binary_sql('v_predictions', 'fold')}
 UNION ALL SELECT NULL, NULL, * FROM {binary_sql('v_predictions', '')}""")
def stratified_metrics(spark, sf):
    return rounded(m.binary_bundle(views.predictions(spark, sf), "y", "p", [["stratum"], ["fold"], []]), m.METRICS)


BOTH = """, uni AS (SELECT 'uniform' AS model, fold, y, 1/3 AS p0, 1/3 AS p1, 1/3 AS p2 FROM v_proba), smx AS (SELECT 'softmax' AS model, fold, y, p0, p1, p2 FROM v_proba)"""


@query("metric_delta", "M9 T7", PB + BOTH + f""", a AS (SELECT * FROM {multi_sql('smx', 'fold')}), b AS (SELECT * FROM {multi_sql('uni', 'fold')})
SELECT fold, 'softmax' AS model, """ + ", ".join(f"round(a.{c} - b.{c}, 4) + 0.0 AS {c}" for c in m.METRICS) + " FROM a JOIN b USING (fold)")
def metric_delta(spark, sf):
    p = views.proba(spark, sf)
    third = F.lit(1.0 / 3.0)
    both = p.select(F.lit("softmax").alias("model"), "fold", "y", *P).unionByName(
        p.select(F.lit("uniform").alias("model"), "fold", "y", *[third.alias(c) for c in P]))
    b = m.metric_bundle(both, "y", P, [["model", "fold"]])
    return m.metric_delta(rounded(b, m.METRICS), ["fold"], "model", "uniform").select("fold", "model", *[r6(c, 4).alias(c) for c in m.METRICS])


@query("align_probabilities", "M10", PB + """, l AS (SELECT vec_id, c, CASE c WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS p FROM v_proba, (VALUES (0),(1),(2)) t(c) WHERE (vec_id + c) % 3 > 0),
g AS (SELECT vec_id, c, coalesce(max(p), 0) AS p FROM (SELECT DISTINCT vec_id FROM v_proba) CROSS JOIN (VALUES (0),(1),(2),(3)) t(c) LEFT JOIN l USING (vec_id, c) GROUP BY 1, 2)
SELECT vec_id, round(max(p) FILTER (WHERE c=0), 6) AS p0, round(max(p) FILTER (WHERE c=1), 6) AS p1, round(max(p) FILTER (WHERE c=2), 6) AS p2, round(max(p) FILTER (WHERE c=3), 6) AS p3 FROM g GROUP BY 1""")
def align_probabilities(spark, sf):
    long = views.proba(spark, sf).select("vec_id", F.posexplode(F.array(*P)).alias("class", "p")).where("(vec_id + class) % 3 > 0")
    out = m.align_long_probabilities(long, ["vec_id"], [0, 1, 2, 3])
    return rounded(out, ["p0", "p1", "p2", "p3"])


@query("risk_coverage", "M11", PB + """, h AS (SELECT fold, round(greatest(p0, p1, p2), 3) AS cf, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END = y AS ok FROM v_proba),
g AS (SELECT fold, cf, count(*) AS n, count(*) FILTER (WHERE ok) AS c FROM h GROUP BY 1, 2),
w AS (SELECT fold, cf, sum(n) OVER w AS k, sum(c) OVER w AS r, sum(n) OVER (PARTITION BY fold) AS t FROM g WINDOW w AS (PARTITION BY fold ORDER BY cf DESC))
SELECT fold, cf AS threshold, k::BIGINT AS retained, round(k / t, 6) AS coverage, round(r / k, 6) AS accuracy FROM w""")
def risk_coverage(spark, sf):
    p = views.proba(spark, sf).select("fold", F.round(F.greatest(*P), 3).alias("cf"), (m.argmax_label(P) == F.col("y")).alias("ok"))
    return rounded(m.risk_coverage(p, ["fold"], "cf", "ok"), ["coverage", "accuracy"])


@query("region_coverage", "M14", """
WITH e AS (SELECT label, embedding[1]::DOUBLE AS dx, embedding[2]::DOUBLE AS dy, 0.01 + abs(embedding[3]::DOUBLE) * 0.1 AS sxx, 0.005 AS sxy, 0.01 + abs(embedding[4]::DOUBLE) * 0.1 AS syy FROM embeddings),
d AS (SELECT label, sxx * syy - sxy * sxy AS det, syy * dx * dx - 2 * sxy * dx * dy + sxx * dy * dy AS q FROM e)
SELECT label, round(avg((q / det <= 5.991464547107979)::INT) FILTER (WHERE det > 0), 6) AS coverage, count(*) FILTER (WHERE det > 0) AS n FROM d GROUP BY 1""")
def region_coverage(spark, sf):
    g = lambda i: F.col("embedding")[i].cast("double")
    e = table(spark, sf, "embeddings").select("label", g(0).alias("dx"), g(1).alias("dy"), (0.01 + F.abs(g(2)) * 0.1).alias("sxx"), F.lit(0.005).alias("sxy"), (0.01 + F.abs(g(3)) * 0.1).alias("syy"))
    return m.region_coverage(e, ["label"], 5.991464547107979).withColumn("coverage", r6("coverage"))


@query("firm_decision_metrics", "M13", PR + """, d AS (SELECT stratum, CASE WHEN p > 0.6 THEN '1' WHEN p < 0.3 THEN '0' ELSE 'uncertain' END AS d, y::VARCHAR AS y FROM v_predictions)
SELECT stratum, round(avg((d <> 'uncertain')::INT), 6) AS firm_coverage, round(avg((d = y)::INT) FILTER (WHERE d <> 'uncertain'), 6) AS firm_accuracy, round(avg((d = 'uncertain')::INT), 6) AS uncertain_rate
FROM d GROUP BY 1""")
def firm_decision_metrics(spark, sf):
    p = views.predictions(spark, sf).select("stratum", F.when(F.col("p") > 0.6, "1").when(F.col("p") < 0.3, "0").otherwise("uncertain").alias("d"), F.col("y").cast("string").alias("y"))
    return rounded(m.firm_decision_metrics(p, ["stratum"], "d", "y"), ["firm_coverage", "firm_accuracy", "uncertain_rate"])


# Class names per position and the groups built from them for the score packets.
NAMES = {i: f"class_{i}" for i in range(64)}
GROUPS = {"door": ["class_3", "class_17", "class_40"], "speech": ["class_0", "class_1"], "unmatched": ["absent_class"]}


@query("project_class_groups", "J10", SC + """
SELECT event_id, frame_index, class_pos, round(score, 6) AS score, CASE WHEN class_pos IN (3, 17, 40) THEN 'door' ELSE 'speech' END AS class_group, 'class_' || class_pos AS class_name
FROM v_scores WHERE class_pos IN (0, 1, 3, 17, 40)""")
def project_class_groups(spark, sf):
    return m.project_class_groups(views.scores(spark, sf), NAMES, GROUPS).withColumn("score", r6("score"))


@query("class_group_features", "A32", SC + """, f AS (SELECT event_id, frame_index, max(score) FILTER (WHERE class_pos IN (3, 17, 40)) AS d, max(score) FILTER (WHERE class_pos IN (0, 1)) AS s,
 max(score) AS t, count(*) FILTER (WHERE score >= 0.25) AS a FROM v_scores GROUP BY 1, 2)
SELECT event_id, round(avg(d), 6) AS door_mean, round(max(d), 6) AS door_max, round(avg(s), 6) AS speech_mean, round(max(s), 6) AS speech_max, NULL::DOUBLE AS unmatched_mean, NULL::DOUBLE AS unmatched_max,
 round(avg(t), 6) AS top_score_mean, round(avg(a), 6) AS active_class_count_mean FROM f GROUP BY 1""")
def class_group_features(spark, sf):
    out = m.class_group_features(views.scores(spark, sf), NAMES, GROUPS)
    return rounded(out, [c for c in out.columns if c != "event_id"])


@query("finite_numeric", "P3", """
WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'nan' WHEN 2 THEN '-inf' WHEN 3 THEN 'x' || event_id ELSE ' ' || value::VARCHAR || ' ' END AS txt, value FROM events)
SELECT event_id, CASE WHEN event_id % 6 >= 4 THEN value END AS parsed FROM t""")
def finite_numeric(spark, sf):
    txt = F.expr("CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'nan' WHEN 2 THEN '-inf' WHEN 3 THEN concat('x', event_id) ELSE concat(' ', value, ' ') END")
    return table(spark, sf, "events").select("event_id", txt.alias("txt")).select("event_id", finite("txt").alias("parsed"))


@query("finite_summary", "A3", """
WITH l AS (SELECT user_id % 20 AS k, 'value' AS feature, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS v FROM events
  UNION ALL SELECT user_id % 20, 'ratio', CASE WHEN event_id % 100 = 0 THEN NULL ELSE 1000 / (event_id % 100) END FROM events)
SELECT k, feature, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, round(median(v), 6) AS median FROM l GROUP BY 1, 2""")
def finite_summary(spark, sf):
    e = table(spark, sf, "events").selectExpr("user_id % 20 AS k", "IF(event_id % 9 = 0, double('NaN'), value) AS value",
                                              "IF(event_id % 100 = 0, double('Infinity'), 1000.0D / (event_id % 100)) AS ratio")
    return rounded(m.finite_summary(e, ["k"], ["value", "ratio"]), ["mean", "std", "min", "max", "median"])


@query("frame_track_summary", "A4", """
WITH f AS (SELECT o_orderkey // 300 AS clip, o_orderstatus = 'F' AS voiced, CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE (o_custkey % 50) / 50 END AS vp, 200 + o_totalprice / 1000 AS f0 FROM orders)
SELECT clip, round((count(*) * 512 + 100) / 16000, 6) AS duration_s, round(avg(voiced::INT), 6) AS voiced_fraction, round(avg(vp), 6) AS voiced_prob_mean,
 round(max(f0) FILTER (WHERE voiced) - min(f0) FILTER (WHERE voiced), 6) AS f0_range, round(median(f0) FILTER (WHERE voiced), 6) AS f0_median FROM f GROUP BY 1""")
def frame_track_summary(spark, sf):
    f = table(spark, sf, "orders").selectExpr("o_orderkey div 300 AS clip", "o_orderstatus = 'F' AS voiced", "IF(o_custkey % 9 = 0, double('NaN'), (o_custkey % 50) / 50) AS voiced_prob",
                                              "200 + o_totalprice / 1000 AS f0")
    clips = f.groupBy("clip").agg((F.count(F.lit(1)) * 512 + 100).alias("n_samples")).withColumn("sample_rate", F.lit(16000))
    return rounded(m.frame_track_summary(f, clips, ["clip"]), ["duration_s", "voiced_fraction", "voiced_prob_mean", "f0_range", "f0_median"])


@query("feature_family_summary", "P5 A3", """
SELECT group_id, feature, round(avg(v), 6) AS mean, round(median(v), 6) AS median FROM (
 SELECT vec_id % 21 AS group_id, u.i AS i, CASE u.i WHEN 1 THEN 'duration_s' WHEN 2 THEN 'f0_median_hz' WHEN 3 THEN 'mfcc_01_mean' ELSE 'mfcc_02_mean' END AS feature, embedding[u.i]::DOUBLE AS v
 FROM embeddings, (SELECT unnest(range(1, 5)) AS i) u) GROUP BY 1, 2""")
def feature_family_summary(spark, sf):
    c = views.clips(spark, sf).withColumnsRenamed({"f1": "duration_s", "f2": "f0_median_hz", "f3": "mfcc_01_mean", "f4": "mfcc_02_mean"})
    family = m.feature_sets(c.columns, ["path", "context", "group_id", "owner_id", "session"], ["duration_s", "f0_median_hz"])
    out = m.finite_summary(c, ["group_id"], family["all_acoustic"])
    return rounded(out.select("group_id", "feature", "mean", "median"), ["mean", "median"])
