"""Agreement of labelings, confounds, silhouettes and outcome instrumentation."""

from pyspark.sql import functions as F

from evidencelens import views
from evidencelens.catalog import query
from evidencelens.catalog.contracts import CAPTURE
from evidencelens.docs_view import documents
from evidencelens.functions import r6
from evidencelens.operators import clusters as cl
from evidencelens.plans.instrumentation import instrumentation_report
from evidencelens.views import table

EMB = """v AS (SELECT vec_id, label, vec_id % 21 AS subject, vec_id % 4 AS household, (vec_id * 7 + label) % 3 AS context, CASE WHEN vec_id % 11 = 0 THEN NULL ELSE label % 2 END AS outcome,
 CASE WHEN embedding[1] > 0 THEN 1 ELSE 0 END + CASE WHEN embedding[2] > 0 THEN 2 ELSE 0 END AS cluster, CASE WHEN embedding[3] > 0 THEN 1 ELSE 0 END + CASE WHEN embedding[2] > 0.01 THEN 2 ELSE 0 END AS cluster2 FROM embeddings)"""
LONG = EMB + """, l AS (SELECT u.attribute, cluster, CASE u.attribute WHEN 'subject' THEN subject WHEN 'household' THEN household WHEN 'label' THEN label WHEN 'context' THEN context ELSE outcome END AS b FROM v,
 (SELECT unnest(['subject','household','label','context','outcome']) AS attribute) u), x AS (SELECT * FROM l WHERE b IS NOT NULL),
n AS (SELECT attribute, cluster AS a, b, count(*) AS n FROM x GROUP BY 1, 2, 3), ra AS (SELECT attribute, a, sum(n)::DOUBLE AS ai FROM n GROUP BY 1, 2), rb AS (SELECT attribute, b, sum(n)::DOUBLE AS bj FROM n GROUP BY 1, 2),
t AS (SELECT attribute, sum(n)::DOUBLE AS nn FROM n GROUP BY 1)"""


def labelled(spark, sf):
    e = lambda i: F.col("embedding")[i]
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", (F.col("vec_id") % 21).alias("subject"), (F.col("vec_id") % 4).alias("household"), ((F.col("vec_id") * 7 + F.col("label")) % 3).alias("context"),
        F.expr("IF(vec_id % 11 = 0, NULL, label % 2)").alias("outcome"), (F.when(e(0) > 0, 1).otherwise(0) + F.when(e(1) > 0, 2).otherwise(0)).alias("cluster"),
        (F.when(e(2) > 0, 1).otherwise(0) + F.when(e(1).cast("double") > 0.01, 2).otherwise(0)).alias("cluster2"))


ATTRIBUTES = ("subject", "household", "label", "context", "outcome")


def long_attributes(spark, sf):
    rows = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("b")) for a in ATTRIBUTES])
    return labelled(spark, sf).select("cluster", F.explode(rows).alias("r")).select("cluster", "r.*")


@query("contingency_ari", "A10", "WITH " + LONG + """, s AS (SELECT attribute, sum(n * (n - 1) / 2) AS sij FROM n GROUP BY 1), si AS (SELECT attribute, sum(ai * (ai - 1) / 2) AS v FROM ra GROUP BY 1), sj AS (SELECT attribute, sum(bj * (bj - 1) / 2) AS v FROM rb GROUP BY 1)
SELECT attribute, round((sij - si.v * sj.v / (nn * (nn - 1) / 2)) / ((si.v + sj.v) / 2 - si.v * sj.v / (nn * (nn - 1) / 2)), 6) AS ari FROM s JOIN si USING (attribute) JOIN sj USING (attribute) JOIN t USING (attribute)""")
def contingency_ari(spark, sf):
    return cl.contingency_ari(long_attributes(spark, sf), ["attribute"], "cluster", "b").withColumn("ari", r6("ari"))


AMI = "WITH " + LONG + """, mi AS (SELECT attribute, sum(n / nn * ln(nn * n / (ai * bj))) AS mi FROM n JOIN ra USING (attribute, a) JOIN rb USING (attribute, b) JOIN t USING (attribute) GROUP BY 1),
ha AS (SELECT attribute, -sum(ai / nn * ln(ai / nn)) AS h FROM ra JOIN t USING (attribute) GROUP BY 1), hb AS (SELECT attribute, -sum(bj / nn * ln(bj / nn)) AS h FROM rb JOIN t USING (attribute) GROUP BY 1),
em AS (SELECT attribute, ai, bj, nn, unnest(range(greatest(1, ai + bj - nn)::BIGINT, least(ai, bj)::BIGINT + 1))::DOUBLE AS k FROM ra JOIN rb USING (attribute) JOIN t USING (attribute)),
emi AS (SELECT attribute, sum(k / nn * ln(nn * k / (ai * bj)) * exp(lgamma(ai+1) + lgamma(bj+1) + lgamma(nn-ai+1) + lgamma(nn-bj+1) - lgamma(nn+1) - lgamma(k+1) - lgamma(ai-k+1) - lgamma(bj-k+1) - lgamma(nn-ai-bj+k+1))) AS emi FROM em GROUP BY 1),
ami AS (SELECT attribute, (mi - emi) / ((ha.h + hb.h) / 2 - emi) AS ami FROM mi JOIN emi USING (attribute) JOIN ha USING (attribute) JOIN hb USING (attribute))"""


@query("contingency_ami", "A11", AMI + " SELECT attribute, round(ami, 6) + 0.0 AS ami FROM ami")
def contingency_ami(spark, sf):
    return cl.contingency_ami(long_attributes(spark, sf), ["attribute"], "cluster", "b").withColumn("ami", r6("ami"))


@query("confound_audit", "L13 A11", AMI + """, g AS (SELECT max(ami) FILTER (WHERE attribute IN ('subject','household')) AS i, coalesce(max(ami) FILTER (WHERE attribute NOT IN ('subject','household')), 0) AS o FROM ami)
SELECT 4 AS k, round(i, 6) + 0.0 AS identity_max_ami, round(o, 6) + 0.0 AS other_max_ami, coalesce(i >= 0.5 AND i >= o + 0.1, false) AS identity_confound_warning FROM g""")
def confound_audit(spark, sf):
    ami = cl.contingency_ami(long_attributes(spark, sf).withColumn("k", F.lit(4)), ["k", "attribute"], "cluster", "b")
    return cl.confound_audit(ami, ["k"]).withColumns({c: r6(c) for c in ("identity_max_ami", "other_max_ami")})


@query("cluster_shape", "A12", "WITH " + EMB + """, c AS (SELECT household, cluster, count(*) AS n FROM v GROUP BY 1, 2), p AS (SELECT household, n, n / sum(n) OVER (PARTITION BY household) AS p FROM c)
SELECT household, count(*) AS clusters, sum(n)::BIGINT AS rows, round(min(p), 6) AS smallest_fraction, round(max(p), 6) AS largest_fraction, round(-sum(p * ln(p)) / ln(count(*)), 6) AS normalized_entropy FROM p GROUP BY 1""")
def cluster_shape(spark, sf):
    out = cl.cluster_shape(labelled(spark, sf), ["household"], "cluster")
    return out.withColumns({c: r6(c) for c in ("smallest_fraction", "largest_fraction", "normalized_entropy")})


@query("labelling_pairs", "J15", "WITH " + EMB + """ SELECT vec_id, 'cluster' AS rep_a, 'cluster2' AS rep_b, cluster::VARCHAR AS la, cluster2::VARCHAR AS lb FROM v UNION ALL SELECT vec_id, 'cluster', 'label', cluster::VARCHAR, label::VARCHAR FROM v
 UNION ALL SELECT vec_id, 'cluster2', 'label', cluster2::VARCHAR, label::VARCHAR FROM v""")
def labelling_pairs(spark, sf):
    return cl.labelling_pairs(labelled(spark, sf), "vec_id", ["cluster", "cluster2", "label"])


FEATS = ["x1", "x2", "x3", "x4"]
XY = EMB + """, p AS (SELECT e.vec_id, cluster AS c, household AS h, e.embedding[1]::DOUBLE AS x1, e.embedding[2]::DOUBLE AS x2, e.embedding[3]::DOUBLE AS x3, e.embedding[4]::DOUBLE AS x4 FROM v JOIN embeddings e USING (vec_id)),"""
SIL = """ d AS (SELECT a.vec_id, a.c, b.c AS o, {key} {dist} AS d, a.vec_id = b.vec_id AS self FROM p a JOIN p b ON {on}),
m AS (SELECT vec_id, c, o, {k} CASE WHEN c = o THEN sum(d) / nullif(count(*) - 1, 0) ELSE avg(d) END AS m FROM d GROUP BY {k} vec_id, c, o),
s AS (SELECT vec_id, {k} max(m) FILTER (WHERE c = o) AS a, min(m) FILTER (WHERE c <> o) AS b FROM m GROUP BY {k} vec_id)
SELECT {k} round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s {g}"""
SQ = "(a.x1-b.x1)**2 + (a.x2-b.x2)**2 + (a.x3-b.x3)**2 + (a.x4-b.x4)**2"


def points(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"x{i + 1}") for i in range(4)])
    return labelled(spark, sf).select("vec_id", F.col("cluster").alias("c"), F.col("household").alias("h")).join(e, "vec_id")


@query("silhouette_squared", "L11", "WITH " + XY + SIL.format(dist=SQ, key="a.h,", on="a.h = b.h", k="h,", g="GROUP BY h"))
def silhouette_squared(spark, sf):
    return cl.silhouette_squared(points(spark, sf), "c", FEATS, ["h"]).withColumn("silhouette", r6("silhouette"))


@query("silhouette_euclidean", "L11", "WITH " + XY + SIL.format(dist=f"sqrt({SQ})", key="", on="true", k="", g=""))
def silhouette_euclidean(spark, sf):
    return cl.silhouette_euclidean(points(spark, sf), "c", FEATS).withColumn("silhouette", r6("silhouette"))


@query("canonical_clusters", "E19", "WITH " + EMB + """, c AS (SELECT cluster AS raw, round(avg(embedding[1]), 6) AS a, round(avg(embedding[2]), 6) AS b FROM v JOIN embeddings USING (vec_id) GROUP BY 1)
SELECT raw, row_number() OVER (ORDER BY a, b) AS position, 'Z04-c' || row_number() OVER (ORDER BY a, b) AS cluster_id FROM c""")
def canonical_clusters(spark, sf):
    c = points(spark, sf).groupBy(F.col("c").alias("raw")).agg(F.array(F.round(F.avg("x1"), 6), F.round(F.avg("x2"), 6)).alias("centre"))
    return cl.canonical_clusters(c, 4).drop("centre")


EP = views.with_views("v_episodes")
DEP = """, lb AS (SELECT household_id, terminated::INT AS y, lag(terminated::INT) OVER (PARTITION BY household_id ORDER BY start_us, event_id) AS p FROM v_episodes WHERE terminated IS NOT NULL),
dp AS (SELECT household_id, count(*) AS n_labelled, CASE WHEN count(*) >= 4 THEN corr(p, y) END AS rho FROM lb GROUP BY 1)"""
DE = "CASE WHEN rho IS NULL THEN NULL WHEN greatest(rho, 0) >= 0.95 THEN 'inf'::DOUBLE ELSE (1 + greatest(rho, 0)) / (1 - greatest(rho, 0)) END"


@query("outcome_dependence", "A13 A14", EP + DEP + f" SELECT household_id, n_labelled, round(rho, 6) AS rho, round({DE}, 6) AS design_effect FROM dp")
def outcome_dependence(spark, sf):
    out = cl.outcome_dependence(views.episodes(spark, sf), ["household_id"], "start_us", "event_id", "terminated")
    return out.withColumns({"rho": r6("rho"), "design_effect": r6(cl.design_effect("rho"))})


@query("inter_event_stats", "A15", EP + """, g AS (SELECT household_id, (start_us - lag(start_us) OVER (PARTITION BY household_id ORDER BY start_us, event_id)) / 1e6 AS s FROM v_episodes)
SELECT household_id, count(s) AS n_intervals, round(min(s), 6) AS min_s, round(max(s), 6) AS max_s, round(median(s), 6) AS median_s FROM g GROUP BY 1""")
def inter_event_stats(spark, sf):
    out = cl.inter_event_stats(views.episodes(spark, sf), ["household_id"], "start_us", "event_id")
    return out.withColumns({c: r6(c) for c in ("min_s", "max_s", "median_s")})


@query("feature_missingness", "A16", EP + """, f AS (SELECT household_id, event_id % 7 = 0 AS a, event_id % 11 = 0 AS b, location = 'error' AS l FROM v_episodes)
SELECT household_id, 'distance_missing' AS flag, round(avg(a::INT), 6) AS rate FROM f GROUP BY 1 UNION ALL SELECT household_id, 'previous_missing', round(avg(b::INT), 6) FROM f GROUP BY 1
UNION ALL SELECT household_id, 'location_missing', round(avg(l::INT), 6) FROM f GROUP BY 1""")
def feature_missingness(spark, sf):
    e = views.episodes(spark, sf).selectExpr("household_id", "CAST(event_id % 7 = 0 AS double) AS distance_missing", "CAST(event_id % 11 = 0 AS double) AS previous_missing",
                                             "IF(location = 'error', '__missing__', location) AS location_value")
    return cl.feature_missingness(e, ["household_id"]).withColumn("rate", r6("rate"))


AUDIT = CAPTURE + """, bad AS (SELECT DISTINCT event_id FROM ce), lbl AS (SELECT event_id, count(DISTINCT x.signalling_terminated) AS n, bool_or(x.signalling_terminated) AS v FROM (SELECT event_id, unnest(outcomes) AS x FROM v_docs)
 WHERE x.outcome_type = 'signalling_termination' AND x.signalling_terminated IS NOT NULL GROUP BY 1),
a AS (SELECT d.event_id, household_id, start_us, bad.event_id IS NULL AS ok, CASE WHEN n = 1 THEN v END AS y FROM v_docs d LEFT JOIN bad USING (event_id) LEFT JOIN lbl USING (event_id)),
lg AS (SELECT household_id, y::INT AS y, lag(y::INT) OVER (PARTITION BY household_id ORDER BY start_us, event_id) AS p FROM a WHERE ok AND y IS NOT NULL), dp AS (SELECT household_id, CASE WHEN count(*) >= 4 THEN corr(p, y) END AS rho FROM lg GROUP BY 1),
gp AS (SELECT household_id, (start_us - lag(start_us) OVER (PARTITION BY household_id ORDER BY start_us, event_id)) / 1e6 AS s FROM a WHERE ok), ti AS (SELECT household_id, count(s) AS ni, median(s) AS md, min(s) AS mn, max(s) AS mx FROM gp GROUP BY 1),
c AS (SELECT household_id, count(*) AS received, count(*) FILTER (WHERE ok) AS valid, count(*) FILTER (WHERE ok AND y IS NOT NULL) AS labelled, avg(y::INT) FILTER (WHERE ok) AS prevalence FROM a GROUP BY 1),
au AS (SELECT household_id, received, valid, received - valid AS invalid, labelled, labelled / nullif(valid, 0) AS label_rate, prevalence, CASE WHEN isnan(rho) THEN NULL ELSE rho END AS rho, ni, md, mn, mx FROM c LEFT JOIN dp USING (household_id) LEFT JOIN ti USING (household_id))"""


@query("instrumentation_audit", "A17 A13 A14 A15", AUDIT + f""" SELECT household_id, received, valid, invalid, labelled, round(label_rate, 6) AS label_rate, round(prevalence, 6) AS prevalence, round(rho, 6) + 0.0 AS rho, round({DE}, 6) AS design_effect,
 CASE WHEN ni > 0 THEN ni END AS n_intervals, round(md, 6) AS median_s, round(mn, 6) AS min_s, round(mx, 6) AS max_s, valid >= 10 AS target_reached, concat_ws(';', CASE WHEN valid < 10 THEN 'too_few_valid_events' END,
 CASE WHEN labelled = 0 THEN 'no_labels' END, CASE WHEN rho IS NULL THEN 'dependence_not_estimable' END, CASE WHEN greatest(rho, 0) >= 0.95 THEN 'dependence_too_high' END) AS limitations FROM au""")
def instrumentation_audit(spark, sf):
    out = instrumentation_report(documents(spark, sf))
    return out.withColumns({c: r6(c) for c in ("label_rate", "prevalence", "rho", "design_effect", "median_s", "min_s", "max_s")}).withColumn("limitations", F.array_join("limitations", ";"))


@query("sizing_table", "A37 A14", EP + DEP + f""", r AS (SELECT household_id, count(terminated) / count(*) AS label_rate FROM v_episodes GROUP BY 1), a AS (SELECT household_id, CASE WHEN household_id = 7 THEN 0 ELSE label_rate END AS lr,
 CASE household_id WHEN 3 THEN NULL WHEN 5 THEN 'inf'::DOUBLE ELSE {DE} END AS de FROM r JOIN dp USING (household_id)),
s AS (SELECT *, ceil(((1.9599639845400536 + 0.8416212335729144) * sd / 0.05) ** 2) AS iid, CASE WHEN NOT (lr > 0 AND lr <= 1) THEN 'label_rate_out_of_range' WHEN de = 'inf'::DOUBLE THEN 'design_effect_infinite' END AS error FROM a, (VALUES (0.075::DOUBLE),(0.10),(0.15)) g(sd)),
t AS (SELECT *, CASE WHEN error IS NULL THEN ceil(iid * coalesce(de, 1.0)) END AS eff, CASE WHEN error IS NULL THEN ceil(ceil(iid * coalesce(de, 1.0)) / (0.30::DOUBLE * lr)) END AS req FROM s)
SELECT household_id, sd, error, CASE WHEN error IS NULL THEN iid::BIGINT END AS iid, eff::BIGINT AS effective, req::BIGINT AS required, CASE WHEN error IS NULL THEN CASE WHEN req < 40 THEN 'below' WHEN req <= 100 THEN 'within' ELSE 'exceeds' END END AS range_status,
 CASE WHEN de IS NULL THEN 'dependence_unknown_assumed_1' END AS note FROM t""")
def sizing_table(spark, sf):
    e = views.episodes(spark, sf)
    dep = cl.outcome_dependence(e, ["household_id"], "start_us", "event_id", "terminated").withColumn("design_effect", cl.design_effect("rho"))
    rate = e.groupBy("household_id").agg((F.count("terminated") / F.count(F.lit(1))).alias("label_rate"))
    a = rate.join(dep, "household_id").withColumns({
        "label_rate": F.expr("IF(household_id = 7, 0.0D, label_rate)"), "design_effect": F.expr("CASE household_id WHEN 3 THEN NULL WHEN 5 THEN double('Infinity') ELSE design_effect END")})
    return cl.sizing_table(a, [0.075, 0.10, 0.15])
