"""Model evaluation jobs."""

from pyspark.sql import functions as F

from evidencelens import views
from evidencelens.catalog import query
from evidencelens.catalog.scores import BOTH, multi_sql
from evidencelens.docs_view import documents
from evidencelens.functions import r6
from evidencelens.operators import metrics as mt
from evidencelens.plans import models as md
from evidencelens.plans.discovery import cluster_stability, confound_report, latent_discovery
from evidencelens.plans.history import history_feature_rows
from evidencelens.plans.scoring import score_sequences

FEATURES = ["f1", "f2", "f3", "f4"]
CL = views.with_views("v_clips")
GAPPY = CL.replace("v_clips AS", "v_all AS") + """, v_clips AS (SELECT path, group_id, session, context, CASE WHEN path % 13 = 0 THEN NULL ELSE f1 END AS f1, CASE WHEN path % 17 = 0 THEN NULL ELSE f2 END AS f2, f3, f4 FROM v_all)"""


def gappy(spark, sf, n_features=4):
    return views.clips(spark, sf, n_features).withColumns({"f1": F.expr("IF(path % 13 = 0, NULL, f1)"), "f2": F.expr("IF(path % 17 = 0, double('NaN'), f2)")})


@query("median_impute", "L1", GAPPY + """, m AS (SELECT median(f1) AS m1, median(f2) AS m2 FROM v_clips WHERE group_id <> 5)
SELECT path, round(coalesce(f1, m1), 6) + 0.0 AS f1, round(coalesce(f2, m2), 6) + 0.0 AS f2 FROM v_clips, m""")
def median_impute(spark, sf):
    c = gappy(spark, sf)
    out = md.median_impute(c.where("group_id <> 5"), c, ["f1", "f2"])
    return out.select("path", r6("f1").alias("f1"), r6("f2").alias("f2"))


@query("fold_medians", "L1 J4", GAPPY + """, f AS (SELECT DISTINCT group_id AS fold FROM v_clips)
SELECT fold, 'f1' AS feature, round(median(f1), 6) + 0.0 AS median FROM f JOIN v_clips ON group_id <> fold GROUP BY 1 UNION ALL SELECT fold, 'f2', round(median(f2), 6) + 0.0 FROM f JOIN v_clips ON group_id <> fold GROUP BY 1""")
def fold_medians(spark, sf):
    return md.fold_medians(gappy(spark, sf), "group_id", ["f1", "f2"]).withColumn("median", r6("median"))


@query("standardise", "L2", CL + """, s AS (SELECT avg(f1) AS a, stddev_pop(f1) AS d, avg(f2) AS a2, stddev_pop(f2) AS d2 FROM v_clips WHERE session < 4)
SELECT path, round((f1 - a) / d, 6) + 0.0 AS f1, round((f2 - a2) / d2, 6) + 0.0 AS f2 FROM v_clips, s""")
def standardise(spark, sf):
    c = views.clips(spark, sf)
    out = md.standardise(c.where("session < 4"), c, ["f1", "f2"])
    return out.select("path", r6("f1").alias("f1"), r6("f2").alias("f2"))


@query("one_hot_dict", "L4", views.with_views("v_episodes") + """ SELECT event_id, array_to_string(list_transform([location = 'click', location = 'purchase', location = 'signup', location = 'view'], lambda b: b::INT), ',') AS hot, round(value, 6) AS value FROM v_episodes""")
def one_hot_dict(spark, sf):
    e = views.episodes(spark, sf)
    words = md.vocabulary(e.where("location <> 'error'"), ["location"])
    size = words.agg(F.count(F.lit(1)).alias("k"))
    out = md.one_hot_dict(e.select("event_id", "location", "value"), ["location"], ["value"], words).crossJoin(F.broadcast(size))
    hot = F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda i: F.array_contains("idx", i).cast("int").cast("string"))
    return out.select("event_id", F.array_join(hot, ",").alias("hot"), r6(F.element_at("val", -1)).alias("value"))


@query("vocabulary", "L4", views.with_views("v_episodes") + """, w AS (SELECT DISTINCT 'action_type' AS feature, action_type AS value FROM v_episodes WHERE subject_id % 2 = 0 UNION SELECT DISTINCT 'location', location FROM v_episodes WHERE subject_id % 2 = 0
 UNION SELECT DISTINCT 'subject_id', subject_id::VARCHAR FROM v_episodes WHERE subject_id % 2 = 0)
SELECT feature, value, row_number() OVER (ORDER BY feature, value) - 1 AS index FROM w""")
def vocabulary(spark, sf):
    return md.vocabulary(views.episodes(spark, sf).where("subject_id % 2 = 0"), ["subject_id", "location", "action_type"])


PRIOR = CL + """, n AS (SELECT group_id, count(*) AS n, count(*) FILTER (WHERE context = 0) AS a, count(*) FILTER (WHERE context = 1) AS b, count(*) FILTER (WHERE context = 2) AS c FROM v_clips GROUP BY 1),
t AS (SELECT sum(n) AS n, sum(a) AS a, sum(b) AS b, sum(c) AS c FROM n),
pv AS (SELECT v.group_id AS fold, context AS y, (t.a - n.a) / (t.n - n.n) AS p0, (t.b - n.b) / (t.n - n.n) AS p1, (t.c - n.c) / (t.n - n.n) AS p2 FROM v_clips v JOIN n USING (group_id), t)"""


@query("prior_evaluation", "L5 L7 M8", PRIOR + f" SELECT fold, * EXCLUDE (fold) FROM {multi_sql('pv', 'fold')} UNION ALL SELECT NULL, * FROM {multi_sql('pv', '')}")
def prior_evaluation(spark, sf):
    c = views.clips(spark, sf)
    prior = mt.prior_baselines(c, "group_id", "context", [0, 1, 2])
    rows = c.select(F.col("group_id").alias("fold"), F.col("context").alias("y")).join(prior, "fold")
    out = mt.metric_bundle(rows, "y", ["p0", "p1", "p2"], [["fold"], []])
    return out.withColumns({m: r6(m) for m in mt.METRICS})


@query("covered", "L7", CL + """, p AS (SELECT * FROM v_clips WHERE path % 50 <> 7 UNION ALL SELECT * FROM v_clips WHERE path % 211 = 0)
SELECT group_id AS fold, 'prevalence' AS model, count(p.path) FILTER (WHERE true) AS n, count(p.path) = (SELECT count(*) FROM v_clips v WHERE v.group_id = f.group_id) AS covered FROM (SELECT DISTINCT group_id FROM v_clips) f LEFT JOIN p USING (group_id) GROUP BY 1
UNION ALL SELECT NULL, 'prevalence', (SELECT count(*) FROM p), (SELECT count(*) FROM p) = (SELECT count(*) FROM v_clips)""")
def covered(spark, sf):
    """Rows left out and rows scored twice are both found."""
    c = views.clips(spark, sf)
    prior = mt.prior_baselines(c, "group_id", "context", [0, 1, 2])
    tested = c.where("path % 50 <> 7").unionByName(c.where("path % 211 = 0"))
    rows = tested.select(F.col("group_id").alias("fold"), F.col("context").alias("y")).join(prior, "fold").withColumn("model", F.lit("prevalence"))
    bundle = mt.metric_bundle(rows, "y", ["p0", "p1", "p2"], [["model", "fold"], ["model"]])
    return md.covered(bundle, c, "group_id", ["prevalence"]).select("fold", "model", "n", "covered")


@query("grouped_evaluation", "L7 L3 L5 M8")
def grouped_evaluation(spark, sf):
    """Four overlapping families over 16 of the vector's components, some of them missing."""
    c = gappy(spark, sf, 16)
    names = [f"f{i}" for i in range(1, 17)]
    return md.grouped_evaluation(c, "group_id", "context", {"first_two": names[:2], "first_half": names[:8], "second_half": names[8:], "all": names}, 3)


SHIFTED = GAPPY + f""", f AS (SELECT DISTINCT group_id AS fold FROM v_clips), md AS (SELECT fold, {", ".join(f"median({x}) AS m_{x}" for x in FEATURES)} FROM f JOIN v_clips ON group_id <> fold GROUP BY 1),
x AS ({" UNION ALL ".join(f"SELECT fold, group_id, '{x}' AS feat, coalesce({x}, m_{x}) AS v FROM v_clips JOIN md ON group_id <> fold" for x in FEATURES)}),
o AS (SELECT fold, feat, avg(v) AS mu FROM x GROUP BY 1, 2), g AS (SELECT fold, feat, group_id, count(*)::DOUBLE AS n, avg(v) AS u FROM x GROUP BY 1, 2, 3),
y AS (SELECT fold, feat, group_id, unnest([{{'model': 'raw', 'z': v}}, {{'model': 'centred', 'z': v - u}}, {{'model': 'shrunk', 'z': v - (n / (n + 4) * u + 4 / (n + 4) * mu)}}], recursive := true) FROM x JOIN o USING (fold, feat) JOIN g USING (fold, feat, group_id)),
a AS (SELECT model, fold, feat, avg(z) AS m, var_pop(z) * count(*) AS total FROM y GROUP BY 1, 2, 3), b AS (SELECT model, fold, feat, group_id, count(*) AS n, avg(z) AS u FROM y GROUP BY 1, 2, 3, 4),
r AS (SELECT model, fold, feat, sum(n * (u - m) ** 2) / any_value(total) AS ratio FROM b JOIN a USING (model, fold, feat) WHERE total > 1e-12 GROUP BY 1, 2, 3)
"""


@query("variance_ratios", "L9 A9", SHIFTED + " SELECT fold, model, round(avg(ratio), 6) + 0.0 AS ratio FROM r GROUP BY 1, 2")
def variance_ratios(spark, sf):
    c = gappy(spark, sf)
    return md.variance_ratios(c, "group_id", FEATURES, 4.0, md._median_table(c, "group_id", FEATURES)).withColumn("ratio", r6("ratio"))


STEPS = "[" + ", ".join(map(repr, mt.POISSON)) + "]::DOUBLE[]"
EXACT = lambda src: multi_sql(src, "fold").replace(", 6) AS", ", 14) AS")


@query("unit_equal_deltas", "L8 A18 A19", views.with_views("v_proba") + BOTH + f""", a AS (SELECT * FROM {EXACT("smx")}), b AS (SELECT * FROM {EXACT("uni")}),
d AS (SELECT fold % 7 AS unit, fold, unnest([{", ".join(f"{{'metric': '{x}', 'v': a.{x} - b.{x}}}" for x in mt.METRICS)}], recursive := true) FROM a JOIN b USING (fold)),
u AS (SELECT unit, metric, avg(v) AS v FROM d GROUP BY 1, 2),
w AS (SELECT metric, r, v, len(list_filter({STEPS}, lambda s: s <= ('0x' || substr(md5('3/' || r || '/' || unit), 1, 8))::UBIGINT / 4294967296.0)) AS n FROM u, (SELECT unnest(range(500)) AS r) t),
m AS (SELECT metric, r, sum(n * v) / sum(n) AS m FROM w GROUP BY 1, 2 HAVING sum(n) > 0), q AS (SELECT metric, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m GROUP BY 1)
SELECT metric, round(avg(v), 6) + 0.0 AS mean, round(median(v), 6) + 0.0 AS median, round(any_value(lo), 6) + 0.0 AS lo, round(any_value(hi), 6) + 0.0 AS hi, count(*) AS units FROM u JOIN q USING (metric) GROUP BY 1""")
def unit_equal_deltas(spark, sf):
    """Softmax scores against a uniform model, folds within units of seven."""
    p = views.proba(spark, sf)
    third = [F.lit(1 / 3).alias(f"p{i}") for i in range(3)]
    both = p.select(F.lit("softmax").alias("model"), "fold", "y", "p0", "p1", "p2").unionByName(p.select(F.lit("uniform").alias("model"), "fold", "y", *third))
    bundle = mt.metric_bundle(both, "y", ["p0", "p1", "p2"], [["model", "fold"]]).withColumn("unit", F.col("fold") % 7)
    moves = md.deltas(bundle, ["unit", "fold"], [("softmax", "uniform")])
    out = md.unit_equal_deltas(moves, "unit", [], reps=500, seed=3)
    return out.select("metric", *[r6(c).alias(c) for c in ("mean", "median", "lo", "hi")], "units")


@query("identity_invariance", "L9 E9 E10 A9 A20")
def identity_invariance(spark, sf):
    return md.identity_invariance(gappy(spark, sf), "group_id", "context", "path", FEATURES, 3, repeats=20, seed=7)


@query("personalisation_evaluation", "L8 E8 E11 A1 A18 A19")
def personalisation(spark, sf):
    return md.personalisation_evaluation(gappy(spark, sf), "group_id", "session", "context", "path", FEATURES, 3, budgets=[1, 2, 4, 8, 16], repeats=20, seed=11)


@query("chronological_evaluation", "L14 L4 L6 E16")
def chronological(spark, sf):
    rows = history_feature_rows(documents(spark, sf))
    routine = ["local_hour_sin", "local_hour_cos", "seconds_since_previous", "seconds_since_previous_missing", "episodes_last_1h", "episodes_last_24h", "previous_terminated", "previous_terminated_missing",
               *[f"seconds_since_{c}{s}" for c in ("food", "play", "access", "social") for s in ("", "_missing")]]
    objects = ["n_objects", "n_humans", "n_peers", "nearest_human_m", "nearest_human_m_missing", "door_present", "door_open", "door_closed", "toy_present", "food_area_present"]
    families = {"routine_history": (["previous_location"], routine), "object_location": (["location_value"], objects), "context_routine": (["location_value", "previous_location"], objects + routine)}
    return md.chronological_evaluation(rows, "household_id", "start_us", "event_id", "target_terminated", families)


COMPONENTS = [f"f{i}" for i in range(1, 65)]


@query("cluster_stability", "L10 J15 A10 A11 L11")
def stability(spark, sf):
    """k = 2..8, 20 repeats, 50 and 20 restarts over all components of the vectors."""
    return cluster_stability(views.clips(spark, sf, 64), "path", COMPONENTS, ["context", "group_id", "owner_id"])[0]


@query("latent_discovery", "L12 L13 E19 A12")
def discovery(spark, sf):
    """k = 2..8, 20 repeats, 20 restarts over all components of the vectors, some of them missing, in four families."""
    c = gappy(spark, sf, 64)
    report, labels = latent_discovery(c.select("path", *COMPONENTS), "path", {f: f"part_{i // 16}" for i, f in enumerate(COMPONENTS)})
    audit = confound_report(labels, c.select("path", F.col("group_id").alias("subject"), F.col("owner_id").alias("household"), "session", "context"), "path", ["subject", "household", "session", "context"])
    kinds = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("identity_max_ami", "other_max_ami", "identity_confound_warning")])
    extra = audit.select("k", F.explode(kinds).alias("r")).select("k", "r.metric", F.lit("").alias("detail"), "r.value")
    return report.unionByName(extra)


@query("score_sequences", "U1", views.with_views("v_track") + " SELECT sequence_id, frame_index // 100 AS block, count(*) AS n, round(avg(x), 6) AS mean_x FROM v_track GROUP BY 1, 2")
def score(spark, sf):
    import pandas as pd

    def fn(p):
        return pd.DataFrame({"sequence_id": [p["sequence_id"].iloc[0]], "block": [int(p["frame_index"].iloc[0]) // 100], "n": [len(p)], "mean_x": [round(float(p["x"].mean()), 6)]})

    return score_sequences(views.track(spark, sf).select("sequence_id", "frame_index", "x"), fn, "sequence_id long, block long, n long, mean_x double", keys=["sequence_id"], block=100)
