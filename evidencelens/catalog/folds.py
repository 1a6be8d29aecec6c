"""Grouped folds, residuals, resampling and priors."""

from pyspark.sql import functions as F

from evidencelens import views
from evidencelens.catalog import query
from evidencelens.functions import r6
from evidencelens.operators import metrics as m
from evidencelens.views import table  # noqa: F401

CL = views.with_views("v_clips")
FEATURES = ["f1", "f2", "f3", "f4"]

FEAS = CL.replace("v_clips AS", "v_all AS") + """, v_clips AS (SELECT * FROM v_all WHERE (group_id % 7 <> 3 OR session = 1) AND (context <> 2 OR session <> 2 OR group_id % 3 > 0)),
cell AS (SELECT group_id, session, context, count(*) AS n FROM v_clips GROUP BY 1, 2, 3),
tot AS (SELECT group_id, context, sum(n)::BIGINT AS t FROM cell GROUP BY 1, 2),
held AS (SELECT c.group_id, c.session, sum(n)::BIGINT AS n_test, count(*) AS k, min(t - n) AS ms, string_agg(context::VARCHAR, ',' ORDER BY context) AS test_contexts FROM cell c JOIN tot USING (group_id, context) GROUP BY 1, 2),
ad AS (SELECT h.group_id, h.session, t.context, t.t - coalesce(c.n, 0) AS a, c.n IS NOT NULL AS tested FROM held h JOIN tot t USING (group_id) LEFT JOIN cell c ON c.group_id = h.group_id AND c.session = h.session AND c.context = t.context),
ag AS (SELECT group_id, session, sum(a)::BIGINT AS n_adapt, coalesce(string_agg(context::VARCHAR, ',' ORDER BY context) FILTER (WHERE a > 0), '') AS ac,
  coalesce(string_agg(context::VARCHAR, ',' ORDER BY context) FILTER (WHERE a > 0 AND tested), '') AS sc FROM ad GROUP BY 1, 2),
ns AS (SELECT group_id, count(DISTINCT session) AS s FROM cell GROUP BY 1),
ff AS (SELECT h.group_id, h.session, n_test, test_contexts, CASE WHEN s > 1 THEN n_adapt END AS n_adaptation, CASE WHEN s > 1 THEN ac END AS adaptation_contexts, CASE WHEN s > 1 THEN sc END AS shared_contexts,
  CASE WHEN s > 1 THEN k >= 2 END AS two_test_contexts, CASE WHEN s > 1 THEN ms > 0 END AS all_supported, CASE WHEN s > 1 THEN k >= 2 AND ms > 0 END AS primary_feasible,
  CASE WHEN s > 1 THEN greatest(ms, 0) END AS max_labelled_budget, CASE WHEN s > 1 THEN ms >= 1 END AS labelled_1, CASE WHEN s > 1 THEN ms >= 3 END AS labelled_3,
  CASE WHEN s > 1 THEN n_adapt >= 8 END AS unlabelled_8, CASE WHEN s > 1 THEN n_adapt >= 16 END AS unlabelled_16, CASE WHEN s <= 1 THEN 'fewer_than_two_sessions' END AS reason
  FROM held h JOIN ag USING (group_id, session) JOIN ns USING (group_id))"""


def feasibility(spark, sf):
    c = views.clips(spark, sf).where("(group_id % 7 <> 3 OR session = 1) AND (context <> 2 OR session <> 2 OR group_id % 3 > 0)")
    return m.fold_feasibility(c, [1, 3], [8, 16])


@query("fold_feasibility", "A1 T1", FEAS + " SELECT * FROM ff")
def fold_feasibility(spark, sf):
    return feasibility(spark, sf)


@query("fold_feasibility_summary", "A2", FEAS + """ SELECT sum(n_test)::BIGINT AS rows, count(DISTINCT group_id) AS groups, count(DISTINCT group_id) FILTER (WHERE reason IS NULL) AS multi_session_groups,
 count(*) FILTER (WHERE reason IS NULL) AS folds, count(*) FILTER (WHERE two_test_contexts) AS folds_two_contexts, count(*) FILTER (WHERE all_supported) AS folds_supported,
 count(*) FILTER (WHERE primary_feasible) AS primary_folds, count(DISTINCT group_id) FILTER (WHERE primary_feasible) AS primary_groups, count(*) FILTER (WHERE primary_feasible AND labelled_1) AS labelled_1,
 count(*) FILTER (WHERE primary_feasible AND labelled_3) AS labelled_3, count(*) FILTER (WHERE primary_feasible AND unlabelled_8) AS unlabelled_8, count(*) FILTER (WHERE primary_feasible AND unlabelled_16) AS unlabelled_16 FROM ff""")
def fold_feasibility_summary(spark, sf):
    return m.fold_feasibility_summary(feasibility(spark, sf), ["labelled_1", "labelled_3", "unlabelled_8", "unlabelled_16"])


@query("fold_join", "J4", CL + """ SELECT group_id AS fold, count(*) AS n_test, (SELECT count(*) FROM v_clips) - count(*) AS n_train, count(*) = count(DISTINCT path) AS covered_once FROM v_clips GROUP BY 1""")
def fold_join(spark, sf):
    return m.fold_join(views.clips(spark, sf), "group_id", "path")


@query("validate_folds", "V9", CL + """, a AS (SELECT group_id AS fold, path, group_id, true AS is_test FROM v_clips WHERE path % 50 <> 7
  UNION ALL SELECT (group_id + 1) % 21, path, group_id, false FROM v_clips UNION ALL SELECT 4, path, group_id, false FROM v_clips WHERE group_id = 4 AND path % 3 = 0
  UNION ALL SELECT 6, path, group_id, true FROM v_clips WHERE group_id = 5),
b AS (SELECT fold, path, group_id, bool_or(is_test) AS t, bool_or(NOT is_test) AS r FROM a GROUP BY 1, 2, 3),
c AS (SELECT path, count(*) FILTER (WHERE is_test) AS n FROM v_clips LEFT JOIN a USING (path) GROUP BY 1)
SELECT fold::VARCHAR AS subject, concat_ws(';', CASE WHEN bool_or(r AND group_id = fold) THEN 'held_out_group_in_train' END, CASE WHEN bool_or(t AND group_id <> fold) THEN 'test_row_outside_held_out_group' END,
 CASE WHEN bool_or(t AND r) THEN 'train_test_overlap' END) AS errors FROM b GROUP BY fold
UNION ALL SELECT 'all', CASE WHEN count(*) FILTER (WHERE n <> 1) > 0 THEN 'rows_not_tested_exactly_once' ELSE '' END FROM c""")
def validate_folds(spark, sf):
    c = views.clips(spark, sf)
    pick = lambda where, fold, test: c.where(where).select(F.expr(fold).alias("fold"), "path", F.lit(test).alias("is_test"))
    a = (pick("path % 50 <> 7", "group_id", True).unionByName(pick("true", "(group_id + 1) % 21", False))
         .unionByName(pick("group_id = 4 AND path % 3 = 0", "CAST(4 AS BIGINT)", False)).unionByName(pick("group_id = 5", "CAST(6 AS BIGINT)", True)))
    return m.validate_folds(a, c, "group_id", "path").withColumn("errors", F.array_join(F.array_sort("errors"), ";"))


@query("prior_baselines", "L5", CL + """, t AS (SELECT c, count(*) FILTER (WHERE context = c) AS n, count(*) AS total FROM v_clips, (VALUES (0),(1),(2)) k(c) GROUP BY 1),
o AS (SELECT group_id, c, count(*) FILTER (WHERE context = c) AS n, count(*) AS total FROM v_clips, (VALUES (0),(1),(2)) k(c) GROUP BY 1, 2),
p AS (SELECT group_id, o.c, (t.n - o.n) / (t.total - o.total) AS p, t.n - o.n AS k FROM o JOIN t USING (c))
SELECT group_id AS fold, round(max(p) FILTER (WHERE c = 0), 6) AS p0, round(max(p) FILTER (WHERE c = 1), 6) AS p1, round(max(p) FILTER (WHERE c = 2), 6) AS p2, arg_max(c, k * 10 - c) AS majority FROM p GROUP BY 1""")
def prior_baselines(spark, sf):
    out = m.prior_baselines(views.clips(spark, sf), "group_id", "context", [0, 1, 2])
    return out.withColumns({c: r6(c) for c in ("p0", "p1", "p2")})


@query("laplace_prevalence", "L6", views.with_views("v_predictions") + " SELECT fold, round((sum(y) + 1) / (count(y) + 2), 6) AS prevalence FROM v_predictions GROUP BY 1")
def laplace_prevalence(spark, sf):
    return m.laplace_prevalence(views.predictions(spark, sf), ["fold"], "y").withColumn("prevalence", r6("prevalence"))


VR = """, g AS (SELECT group_id, {n} FROM v_clips GROUP BY 1)"""
RATIO = " + ".join(f"coalesce(CASE WHEN t{i} > 1e-12 THEN b{i} / t{i} END, 0)" for i in range(1, 5))
COUNT = " + ".join(f"(t{i} > 1e-12)::INT" for i in range(1, 5))


@query("between_group_variance_ratio", "A9", CL + ", g AS (SELECT context, group_id, count(*) AS n, " + ", ".join(f"avg(f{i}) AS m{i}" for i in range(1, 5))
       + " FROM v_clips GROUP BY 1, 2), t AS (SELECT context, " + ", ".join(f"avg(f{i}) AS g{i}, var_pop(f{i}) * count(*) AS t{i}" for i in range(1, 5))
       + " FROM v_clips GROUP BY 1), s AS (SELECT context, " + ", ".join(f"sum(n * (m{i} - g{i})**2) AS b{i}, any_value(t{i}) AS t{i}" for i in range(1, 5))
       + f" FROM g JOIN t USING (context) GROUP BY 1) SELECT context, round(({RATIO}) / ({COUNT}), 6) AS ratio FROM s")
def variance_ratio(spark, sf):
    return m.between_group_variance_ratio(views.clips(spark, sf), "group_id", FEATURES, ["context"]).withColumn("ratio", r6("ratio"))


@query("residualise", "E10", CL + " SELECT path, " + ", ".join(f"round({f} - avg({f}) OVER (PARTITION BY group_id), 6) + 0.0 AS {f}" for f in FEATURES) + " FROM v_clips")
def residualise(spark, sf):
    out = m.residualise(views.clips(spark, sf), "group_id", FEATURES)
    return out.select("path", *[r6(f).alias(f) for f in FEATURES])


@query("residualise_shrunk", "E10", CL + """, g AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS n FROM v_clips) SELECT path, """ + ", ".join(
    f"round({f} - (n / (n + 4.0) * avg({f}) OVER (PARTITION BY group_id) + 4.0 / (n + 4.0) * avg({f}) OVER ()), 6) + 0.0 AS {f}" for f in FEATURES) + " FROM g")
def residualise_shrunk(spark, sf):
    out = m.residualise(views.clips(spark, sf), "group_id", FEATURES, tau=4.0)
    return out.select("path", *[r6(f).alias(f) for f in FEATURES])


ORDER = CL + """, o AS (SELECT path, group_id, session, f1, r.repeat, row_number() OVER (PARTITION BY r.repeat, group_id, session
 ORDER BY sha256('11|' || r.repeat || '|' || group_id || '|' || session || '|' || path), path) AS rank FROM v_clips, (VALUES (0),(1),(2)) r(repeat))"""


def ordered(spark, sf):
    rep = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    return m.stable_order(views.clips(spark, sf), 11, rep, ["group_id"], "session", "path")


@query("stable_order", "E8", ORDER + " SELECT path, repeat, group_id, session, rank FROM o")
def stable_order(spark, sf):
    return ordered(spark, sf).select("path", "repeat", "group_id", "session", "rank")


@query("adapt_centre", "E11 E8", ORDER + """, a AS (SELECT repeat, group_id, avg(f1) AS m FROM o WHERE session <> 1 AND rank <= 2 GROUP BY 1, 2), p AS (SELECT repeat, avg(f1) AS m FROM o GROUP BY 1)
SELECT t.path, t.repeat, round(t.f1 - (6 / (6 + 4.0) * a.m + (1 - 6 / (6 + 4.0)) * p.m), 6) + 0.0 AS f1 FROM o t JOIN a USING (repeat, group_id) JOIN p USING (repeat) WHERE t.session = 1""")
def adapt_centre(spark, sf):
    o = ordered(spark, sf)
    pop = o.groupBy("repeat").agg(F.avg("f1").alias("f1"))
    test = o.where("session = 1").select("path", "repeat", "group_id", "f1")
    adapt = o.where("session <> 1 AND rank <= 2")
    groups = test.select("repeat", "group_id").distinct().join(pop, "repeat")
    out = m.adapt_centre(test, adapt, groups, ["repeat", "group_id"], ["f1"], budget=6, tau=4.0)
    return out.select("path", "repeat", r6("f1").alias("f1"))


@query("pseudo_groups", "E9", CL + """, d AS (SELECT path, owner_id % 3 AS fold, group_id, sha256('5|' || owner_id % 3 || '|' || r.repeat || '|' || path) AS h, r.repeat FROM v_clips, (VALUES (0),(1)) r(repeat)),
a AS (SELECT fold, repeat, path, group_id AS true_group, row_number() OVER (PARTITION BY fold, repeat ORDER BY h, path) AS rk FROM d),
b AS (SELECT fold, repeat, group_id AS pseudo_group, row_number() OVER (PARTITION BY fold, repeat ORDER BY group_id, h, path) AS rk FROM d)
SELECT a.fold, a.repeat, path, true_group, pseudo_group FROM a JOIN b USING (fold, repeat, rk)""")
def pseudo_groups(spark, sf):
    c = views.clips(spark, sf).withColumn("fold", F.col("owner_id") % 3)
    return m.pseudo_groups(c, 5, ["fold"], F.explode(F.array(F.lit(0), F.lit(1))), "group_id", "path")


DELTA = CL + """, u AS (SELECT owner_id, session, avg(f1) AS d1, avg(f2) AS d2 FROM v_clips GROUP BY 1, 2)"""


def deltas(spark, sf):
    return views.clips(spark, sf).groupBy("owner_id", "session").agg(F.avg("f1").alias("d1"), F.avg("f2").alias("d2"))


@query("two_level_mean", "A18", DELTA + """, p AS (SELECT owner_id, avg(d1) AS d1, avg(d2) AS d2 FROM u GROUP BY 1), l AS (SELECT 'd1' AS metric, d1 AS v FROM p UNION ALL SELECT 'd2', d2 FROM p)
SELECT metric, round(avg(v), 6) AS mean, count(v) AS units, round(median(v), 6) AS median FROM l GROUP BY 1""")
def two_level_mean(spark, sf):
    return m.two_level_mean(deltas(spark, sf), "owner_id", "session", ["d1", "d2"]).withColumns({c: r6(c) for c in ("mean", "median")})


@query("bootstrap_ci", "A19", DELTA + """, p AS (SELECT owner_id, avg(d1) AS v, row_number() OVER (ORDER BY sha256(owner_id::VARCHAR), owner_id) - 1 AS i FROM u GROUP BY 1), n AS (SELECT count(*) AS n, avg(v) AS mean FROM p),
d AS (SELECT r, ('0x' || substr(md5('3/' || r || '/' || k), 1, 8))::UBIGINT % n.n AS i FROM n, (SELECT unnest(range(200)) AS r) t, (SELECT i AS k FROM p) q),
b AS (SELECT r, avg(v) AS m FROM d JOIN p ON p.i = d.i GROUP BY 1)
SELECT round((SELECT mean FROM n), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM b""")
def bootstrap_ci(spark, sf):
    units = deltas(spark, sf).groupBy("owner_id").agg(F.avg("d1").alias("v"))
    return m.bootstrap_ci(units, "v", "owner_id", 200, 3).withColumns({c: r6(c) for c in ("mean", "lo", "hi")})


@query("control_specificity", "A20", CL + """, d AS (SELECT session, 'f1' AS metric, avg(f1) AS v FROM v_clips GROUP BY 1 UNION ALL SELECT session, 'f2', avg(f2) FROM v_clips GROUP BY 1),
t AS (SELECT metric, v AS tv FROM d WHERE session = 1)
SELECT metric, round(any_value(tv), 6) AS true_delta, round(avg(v), 6) AS control_mean, round(min(v), 6) AS control_min, round(max(v), 6) AS control_max,
 round(avg((CASE WHEN metric = 'f1' THEN v >= tv ELSE v <= tv END)::INT), 6) AS fraction_as_good FROM d JOIN t USING (metric) WHERE session > 1 GROUP BY 1""")
def control_specificity(spark, sf):
    s = views.clips(spark, sf).groupBy("session").agg(F.avg("f1").alias("f1"), F.avg("f2").alias("f2"))
    long = s.select(F.when(F.col("session") > 1, F.col("session")).alias("control"), F.explode(F.array(
        F.struct(F.lit("f1").alias("metric"), F.col("f1").alias("delta")), F.struct(F.lit("f2").alias("metric"), F.col("f2").alias("delta")))).alias("r")).select("control", "r.*")
    out = m.control_specificity(long, {"f1": True, "f2": False})
    return out.withColumns({c: r6(c) for c in out.columns if c != "metric"})


@query("stack_folds", "T7", CL + " SELECT group_id AS fold, path, context FROM v_clips")
def stack_folds(spark, sf):
    from evidencelens.operators.keypoints import stack

    c = views.clips(spark, sf).select(F.col("group_id").alias("fold"), "path", "context")
    return stack([c.where("fold < 7"), c.where("fold >= 7 AND fold < 14"), c.where("fold >= 14")])


@query("chronological_split", "E16", views.with_views("v_episodes") + """, r AS (SELECT event_id, household_id, row_number() OVER w AS rank, count(*) OVER (PARTITION BY household_id) AS n FROM v_episodes WHERE terminated IS NOT NULL
 WINDOW w AS (PARTITION BY household_id ORDER BY start_us, event_id))
SELECT household_id, event_id, rank, CASE WHEN n < 6 THEN 'unsupported' WHEN rank <= greatest(2, least(n - 2, floor(n * 0.67::DOUBLE))) THEN 'train' ELSE 'test' END AS part FROM r""")
def chronological_split(spark, sf):
    out = m.chronological_split(views.episodes(spark, sf), ["household_id"], "start_us", "event_id", "terminated")
    return out.select("household_id", "event_id", "rank", "part")
