"""Small hand-computed cases, leakage and fail-closed checks."""

import datetime as dt
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidencelens.functions import angle_deg, bbox_iou_xywh, iso_micros, keyword_category, lgamma, local_hour, norm_token
from evidencelens.operators import clusters, cohorts, context, contracts, history, instances, keypoints, metrics
from evidencelens.plans.logistic import Model, fit_all, loaded, predict
from evidencelens.streaming import capture
from tests.conftest import SMALL


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_scalar_functions(spark):
    lit = F.lit
    r = one(spark, norm_token(lit(" Open-the Door ")).alias("t"), keyword_category(lit("play with food")).alias("c"), iso_micros(lit("2026-08-01T08:00:00+10:00")).alias("i"),
            iso_micros(lit("2026-08-01T08:00:00")).alias("naive"), local_hour(lit("2026-08-01T08:30:00+10:00")).alias("h"), angle_deg(lit(1.0), lit(0.0), lit(0.0), lit(1.0)).alias("a"),
            bbox_iou_xywh(*[lit(float(x)) for x in (0, 0, 2, 2, 1, 1, 2, 2)]).alias("iou"), bbox_iou_xywh(*[lit(float(x)) for x in (0, 0, 0, 2, 1, 1, 2, 2)]).alias("none"))
    assert r["t"] == "open_the_door" and r["c"] == "food" and r["naive"] is None and r["h"] == 8.5
    assert r["i"] == int(dt.datetime(2026, 7, 31, 22, tzinfo=dt.timezone.utc).timestamp() * 1e6)
    assert math.isclose(r["a"], 90.0) and math.isclose(r["iou"], 1 / 7) and r["none"] == 0.0


def test_lgamma(spark):
    xs = [1.0, 1.5, 2.0, 7.9, 8.0, 100.25, 20000.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", lgamma(F.col("x")).alias("g")).collect()
    assert all(abs(r["g"] - math.lgamma(r["x"])) < 1e-9 * max(1.0, abs(math.lgamma(r["x"]))) for r in got)


def brute_history(rows):
    out = {}
    for e in rows:
        prior = sorted((p for p in rows if p["household_id"] == e["household_id"] and p["start_us"] < e["start_us"]), key=lambda p: (p["start_us"], p["event_id"]))
        acts = [(a["action_us"], -p["start_us"], p["event_id"]) for p in prior for a in p["actions"] if a["category"] == "food" and a["action_us"] <= e["start_us"]]
        out[e["event_id"]] = (prior[-1]["event_id"] if prior else None, sum(e["start_us"] - p["start_us"] <= 3_600_000_000 for p in prior), max(acts)[0] if acts else None)
    return out


def episode_rows(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = rng.randrange(0, 12) * 1_800_000_000 + rng.randrange(3)  # many ties and exact hour distances
        acts = [{"category": rng.choice(["food", "play", None]), "action_us": t + rng.choice([0, 1, 2, 5_000_000, -3])} for _ in range(rng.randrange(3))]
        rows.append({"event_id": i, "household_id": 1 if rng.random() < 0.8 else 2, "start_us": t, "location": "x", "terminated": None, "outcome_us": None, "actions": acts})
    return rows


SCHEMA = "event_id long, household_id long, start_us long, location string, terminated boolean, outcome_us long, actions array<struct<category: string, action_us: long>>"


@pytest.mark.parametrize("segment", [1_000_000, 3_600_000_000, 10**14])
def test_history_against_brute_force(spark, segment):
    rows = episode_rows(4)
    df = spark.createDataFrame(rows, SCHEMA)
    t = history.timeline(df, categories=("food",), segment_us=segment)
    got = {r["event_id"]: (r["previous"]["event_id"] if r["previous"] else None, r["episodes_last_1h"], r["action_food"]["us"] if r["action_food"] else None) for r in t.collect()}
    assert got == brute_history(rows)


def test_history_ignores_present_and_future(spark):
    rows = episode_rows(9, 60)
    target = sorted(rows, key=lambda r: r["start_us"])[30]
    changed = [dict(r, location="changed", actions=[{"category": "food", "action_us": r["start_us"] + 9}], terminated=True, outcome_us=r["start_us"]) if r["start_us"] >= target["start_us"] else r for r in rows]
    cols = ["event_id", *history.action_columns(), *history.previous_columns()]
    pick = lambda rs: history.timeline(spark.createDataFrame(rs, SCHEMA), windows={}).select(*cols).where(F.col("event_id") == target["event_id"]).first()
    assert pick(rows) == pick(changed)


def test_termination_rules_differ(spark):
    schema = "start_us long, outcomes array<struct<outcome_id: string, outcome_type: string, signalling_terminated: boolean, start_offset_ms: long, end_offset_ms: long>>"
    o = lambda v, a, b: ("r", "signalling_termination", v, a, b)
    df = spark.createDataFrame([(0, [o(False, 1000, 30000)]), (0, [o(True, 1000, 70000)]), (0, [o(True, 1, 2), o(False, 3, 60000)]), (0, [o(False, 1, 60000)]), (0, [])], schema)
    label, errors = context.termination_label()
    got = [(r[0], r[1]) for r in df.select(label, errors).collect()]
    assert got == [(None, ["false_before_horizon"]), (None, ["outcome_after_horizon"]), (None, ["contradictory_outcomes"]), (False, []), (None, [])]
    value, latest, clash = context.termination_before(cutoff=F.col("start_us") + 2_000_000)
    assert [tuple(r) for r in df.select(value, latest, clash).collect()][0] == (False, 1_000_000, False)


def test_constant_velocity_has_no_curvature(spark):
    kp = spark.createDataFrame([(1, f, 0, "nose", 2.0 * f, 3.0 * f, 1.0) for f in range(20)], "sequence_id long, frame_index long, pos int, name string, x_px double, y_px double, score double")
    r = keypoints.motion_curvature(keypoints.confident_keypoints(kp), 100.0).first()
    assert r["samples"] == 18 and r["mean_curvature"] == 0.0 and r["spike_rate"] == 0.0


def test_dropout_runs(spark):
    seen = [1, 2, 5, 6, 9]
    kp = spark.createDataFrame([(1, f, 0, "nose", 0.0, 0.0, 1.0 if f in seen else 0.05) for f in range(12)], "sequence_id long, frame_index long, pos int, name string, x_px double, y_px double, score double")
    r = keypoints.dropout_runs(keypoints.confident_keypoints(kp), kp).first()
    assert (r["dropout_runs"], r["bounded_recoveries"], r["max_dropout_frames"], r["mean_bounded_frames"]) == (4, 2, 2, 2.0)


def test_ari_hand_values(spark):
    df = spark.createDataFrame([("a", 0, 0), ("a", 0, 0), ("a", 1, 1), ("a", 1, 2), ("b", 0, 5), ("b", 0, 5), ("b", 1, 7), ("b", 1, 7)], "k string, x int, y int")
    got = {r["k"]: r["ari"] for r in clusters.contingency_ari(df, ["k"], "x", "y").collect()}
    assert math.isclose(got["a"], 0.5714285714285714) and got["b"] == 1.0


def test_ami_against_permutations(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 3, 30), rng.integers(0, 4, 30)

    def mi(x, y):
        out = 0.0
        for i, j in itertools.product(set(x), set(y)):
            n = np.sum((x == i) & (y == j))
            if n:
                out += n / 30 * math.log(30 * n / (np.sum(x == i) * np.sum(y == j)))
        return out

    entropy = lambda x: -sum(np.mean(x == i) * math.log(np.mean(x == i)) for i in set(x))
    emi = np.mean([mi(a, rng.permutation(b)) for _ in range(4000)])
    want = (mi(a, b) - emi) / ((entropy(a) + entropy(b)) / 2 - emi)
    df = spark.createDataFrame([("k", int(x), int(y)) for x, y in zip(a, b)], "k string, x int, y int")
    assert abs(clusters.contingency_ami(df, ["k"], "x", "y").first()["ami"] - want) < 0.01


def test_centring_removes_between_group_variance(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(g, float(rng.normal() + 5 * g), float(rng.normal())) for g in range(3) for _ in range(10)], "g long, f1 double, f2 double")
    raw = metrics.between_group_variance_ratio(df, "g", ["f1", "f2"]).first()["ratio"]
    centred = metrics.between_group_variance_ratio(metrics.residualise(df, "g", ["f1", "f2"]), "g", ["f1", "f2"]).first()["ratio"]
    assert raw > 0.3 and centred < 1e-12


def test_pseudo_groups_keep_sizes(spark):
    df = spark.createDataFrame([(i, "abc"[min(i // 5, 2)], 0) for i in range(30)], "path long, g string, fold long")
    p = metrics.pseudo_groups(df, 1, ["fold"], F.lit(0), "g", "path")
    sizes = lambda c: {r[0]: r[1] for r in p.groupBy(c).count().collect()}
    assert sizes("true_group") == sizes("pseudo_group") and p.where("true_group <> pseudo_group").count() > 0


def test_digest_has_one_form_at_every_size(spark):
    sets = {"x": [f"id{i}" * 40 for i in range(30_000)], "y": [f"id{i}" for i in range(50)], "z": ["id0"], None: ["n\u00e9", "b"]}
    df = spark.createDataFrame([(k, i) for k, ids in sets.items() for i in ids], "k string, id string")
    got = {r["k"]: (r["n_ids"], r["digest"]) for r in cohorts.id_set_digest(df.repartition(7), ["k"], "id").collect()}
    assert got == {k: (len(ids), hashlib.sha256("\n".join(sorted(ids)).encode()).hexdigest()) for k, ids in sets.items()}
    whole = cohorts.id_set_digest(df, [], "id").first()
    assert whole["digest"] == hashlib.sha256("\n".join(sorted(i for ids in sets.values() for i in ids)).encode()).hexdigest()
    assert cohorts.id_set_digest(df.limit(0), ["k"], "id").count() == 0


def test_ami_tail_bound_on_skewed_marginals(spark):
    from math import comb, log

    rows = [(0, "a" if i < 3 else "b", "p" if i < 990 else "q") for i in range(1000)]
    got = clusters.contingency_ami(spark.createDataFrame(rows, "k long, a string, b string"), ["k"], "a", "b").first()["ami"]
    n, ai, bj = 1000, (3, 997), (990, 10)
    emi = sum(x / n * log(n * x / (a * b)) * comb(a, x) * comb(n - a, b - x) / comb(n, b) for a in ai for b in bj for x in range(max(1, a + b - n), min(a, b) + 1))
    h = lambda parts: -sum(p / n * log(p / n) for p in parts)
    cells = {(3, 990): 3, (997, 990): 987, (997, 10): 10}
    mi = sum(c / n * log(n * c / (a * b)) for (a, b), c in cells.items())
    assert abs(got - (mi - emi) / ((h(ai) + h(bj)) / 2 - emi)) < 1e-7


def test_require_valid_fails_the_job(spark):
    df = spark.createDataFrame([(1, ["bad_rule"])], "id long, errors array<string>")
    with pytest.raises(Exception, match="bad_rule"):
        contracts.require_valid(df).collect()


def test_zero_length_curve_and_line(spark):
    pts = [(1, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (3.0, 0.0), (3.0, 4.0)])] + [(2, 0, 5.0, 5.0), (2, 1, 5.0, 5.0)]
    df = spark.createDataFrame(pts, "c long, pos long, x double, y double")
    got = {(r["c"], r["j"]): (r["x"], r["y"]) for r in instances.resample_curve(df, ["c"], 8).collect()}
    assert len(got) == 16 and all(got[2, j] == (5.0, 5.0) for j in range(8))
    assert got[1, 0] == (0.0, 0.0) and got[1, 7] == (3.0, 4.0) and got[1, 3] == (3.0, 0.0)


def test_mask_iou_of_empty_and_equal(spark):
    r = spark.createDataFrame([(1, 10, 5), (1, 300, 20), (2, 0, 0)], "k long, start long, len long")
    got = {x["k"]: x["iou"] for x in instances.mask_iou(r, r, ["k"]).collect()}
    assert got == {1: 1.0, 2: 1.0}


def newton_reference(x, y, k, c=1.0, iters=60):
    """Plain multinomial ridge by Newton with a free intercept."""
    sd = x.std(axis=0)
    z = np.hstack([(x - x.mean(axis=0)) / np.where(sd > 0, sd, 1), np.ones((len(x), 1))])
    w = np.array([len(y) / (k * np.sum(y == i)) for i in range(k)])[y]
    beta = np.zeros((k, z.shape[1]))
    pen = np.ones_like(beta)
    pen[:, -1] = 0
    for _ in range(iters):
        s = z @ beta.T
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = c * ((p - np.eye(k)[y]) * w[:, None]).T @ z + pen * beta
        h = np.zeros((beta.size, beta.size))
        d = z.shape[1]
        for a in range(k):
            for b in range(k):
                h[a * d:(a + 1) * d, b * d:(b + 1) * d] = c * (z * (w * p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ z
        beta -= np.linalg.lstsq(h + np.diag(pen.ravel()), g.ravel(), rcond=1e-13)[0].reshape(beta.shape)
    return beta


def test_grouped_logistic_matches_single_fits(spark):
    rng = np.random.default_rng(3)
    x, g = rng.normal(size=(120, 2)), rng.integers(0, 4, 120)
    y = (x[:, 0] + 0.3 * rng.normal(size=120) > 0.3).astype(int) + (x[:, 1] > 0.8).astype(int)
    rows = spark.createDataFrame([(int(a), int(b), [float(v) for v in r]) for a, b, r in zip(g, y, x)], "g long, y int, x array<double>").repartition(5)
    fits = fit_all(rows, [Model("m", [0, 1])], 3, leave_out=True)
    for f in (loaded(r["state"]) for r in fits.collect()):
        want = newton_reference(x[g != int(f.group)], y[g != int(f.group)], 3)
        assert np.abs(f.beta - f.beta.mean(axis=0) - (want - want.mean(axis=0))).max() < 1e-5
    p = predict(rows, fits, ["g", "y"], 3).toPandas()
    assert len(p) == 120 and np.allclose(p[["p0", "p1", "p2"]].sum(axis=1), 1.0)


def test_centred_fit_equals_explicit_residuals(spark):
    rng = np.random.default_rng(8)
    g = np.repeat(np.arange(4), 25)
    x = rng.normal(size=(100, 2)) + g[:, None]
    y = (x[:, 0] - g + 0.5 * rng.normal(size=100) > 0).astype(int)
    rows = spark.createDataFrame([(int(a), int(b), [float(v) for v in r]) for a, b, r in zip(g, y, x)], "g long, y int, x array<double>")
    fits = fit_all(rows, [Model("shrunk", [0, 1], tau=4.0)], 2, leave_out=True)
    keep = g != 0
    xt, gt = x[keep], g[keep]
    a = 25 / 29
    res = xt - np.vstack([a * xt[gt == i].mean(axis=0) + (1 - a) * xt.mean(axis=0) for i in gt])
    plain = spark.createDataFrame([(1, int(b), [float(v) for v in r]) for b, r in zip(y[keep], res)], "g long, y int, x array<double>")
    want = fit_all(plain, [Model("m", [0, 1])], 2, leave_out=False)
    beta = lambda table, group: loaded(table.where(F.col("gs") == group).first()["state"]).beta
    assert np.abs(beta(fits, "0") - beta(want, "1")).max() < 1e-6


def test_bundle_extremes(spark):
    df = spark.createDataFrame([(0, 1.0, 0.0, 0.0), (1, 0.0, 1.0, 0.0), (1, 1.0, 0.0, 0.0)], "y int, p0 double, p1 double, p2 double")
    r = metrics.metric_bundle(df, "y", ["p0", "p1", "p2"], [[]]).first()
    assert math.isclose(r["log_loss"], -math.log(2.220446049250313e-16) / 3) and math.isclose(r["balanced_accuracy"], 0.75)
    assert math.isclose(r["brier"], 2 / 3) and math.isclose(r["ece"], 1 / 3)


def test_planted_clusters_are_found(spark):
    from evidencelens.plans.discovery import latent_discovery

    rng = np.random.default_rng(1)
    rows = [(i, float(rng.normal(8 * (i % 3), 0.5)), float(rng.normal(-8 * (i % 3), 0.5)), float("nan") if i % 17 == 0 else float(rng.normal(6 * ((i + 1) % 3), 0.5))) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    report, labels = latent_discovery(df, "id", {"a": "x", "b": "x", "c": "y"}, [3], repeats=2, restarts=4)
    truth = labels.withColumn("truth", F.col("id") % 3)
    assert clusters.contingency_ari(truth, ["k"], "cluster_id", "truth").first()["ari"] > 0.9
    with pytest.raises(ValueError, match="outside the feature manifest"):
        latent_discovery(df.withColumn("subject", F.lit("s")), "id", {"a": "x", "b": "x", "c": "y"}, [3])


def test_discovery_of_documents(spark, tmp_path):
    from evidencelens.sources.documents import discover_episodes, read_episodes

    ok = '{"schema_version":"0.1.0","event_id":"%s","provenance":{"software_versions":{"%s":"v"}}}'
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.json").write_text(ok % ("e1", "capture"))
    (tmp_path / "sub" / "b.json").write_text(ok % ("e2", "composer"))
    (tmp_path / "a.lock.json").write_text(ok % ("e3", "capture"))
    (tmp_path / "broken.json").write_text('{"schema_version": "0.1.0", ')
    (tmp_path / "old.json").write_text('{"schema_version":"0.0.9","event_id":"e4"}')
    got = {(r["event_id"], r["derived"]) for r in discover_episodes(spark, str(tmp_path), "composer").collect()}
    assert got == {("e1", False), ("e2", True)}
    (tmp_path / "list.json").write_text('[{"event_id":"x1"},{"event_id":"x2"}]')
    assert read_episodes(spark, str(tmp_path / "list.json")).count() == 2


def test_keyless_digest_over_many_ranges_and_blocks(spark, monkeypatch):
    """Ids of several ranges, each of several blocks, come out in one order (89 characters an id, blocks of 1 MB)."""
    import hashlib

    ids = [f"{i:09d}" + "x" * 80 for i in range(60_000)]
    df = spark.createDataFrame([(i,) for i in ids], "id string").repartition(7)
    want = hashlib.sha256("\n".join(sorted(ids)).encode()).hexdigest()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    for parts, coalesce in (("4", "true"), ("4", "false"), ("20", "false")):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
        got = cohorts.id_set_digest(df, [], "id").first()
        assert (got["n_ids"], got["digest"]) == (60_000, want)
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_values_that_are_not_finite_select_no_frame(spark):
    nan = float("nan")
    rows = [(1, f, n, s, x, 0.0) for f in range(3) for n, s, x in (("a", nan if f == 0 else 0.9, 0.0), ("b", 0.9, nan if f == 1 else 100.0), ("c", nan, 50.0), ("d", 0.9, 50.0), ("e", 0.9, nan))]
    kp = spark.createDataFrame(rows, "sequence_id long, frame_index long, name string, score double, x_px double, y_px double")
    frame = keypoints.select_keyframe(kp, ("a", "b"), 100.0)
    assert [r["frame_index"] for r in frame.collect()] == [2]
    assert keypoints.select_negatives(kp, frame, ["c", "d", "e"], 100.0).first()["negatives"] == ["d"]


def test_sweep_finds_every_overlap(spark):
    rng = np.random.default_rng(9)
    rows = []
    for frame in range(60):
        for i in range(int(rng.integers(1, 8))):
            x, y, w, h = (int(v) for v in rng.integers(0, 40, 4))
            rows.append((1, frame, i, float(x), float(y), float(w % 12), float(h % 12), bool(rng.random() < 0.9)))
    df = spark.createDataFrame(rows, "sequence_id long, frame_index long, instance_id long, bx double, by double, bw double, bh double, visible boolean")
    pairs = {r["frame_index"] for r in instances.overlapping_instances(df).collect()}
    got = [r["frame_index"] for r in instances.overlap_frames(df).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs and 5 < len(pairs) < 60


def test_flat_documents_with_null_constants_are_errors(spark):
    from evidencelens.docs_view import documents
    docs = documents(spark, SMALL)
    changed = {"schema_version": None, "subject_id": None, "household_id": None, "episode_id": ""}
    docs = docs.withColumns({c: F.lit(v).cast(docs.schema[c].dataType) for c, v in changed.items()})
    docs = docs.withColumn("hypotheses", F.transform("hypotheses", lambda h: h.withField("probability", F.lit(7.5))))
    rows = contracts.validate_episodes(docs).select("errors").collect()
    assert len(rows) == 1000 and all({"schema_version", "missing:subject_id", "missing:household_id", "empty:episode_id", "probability_out_of_range"} <= set(r["errors"]) for r in rows)


def test_every_schema_rule_fails_somewhere(spark):
    from evidencelens.catalog import records

    seen = {}
    for fields, spec, check in ((records.episode_fields("spark"), records.EPISODE, records.rc.validate_documents), (records.plan_fields("spark"), records.PLAN, records.rc.validate_plan_documents)):
        docs = records.typed(records.records(spark, SMALL, fields), spec)
        seen[id(spec)] = {re.sub("[.][0-9]+", ".#", e) for r in check(docs, ["row_id"]).select("errors").collect() for e in r["errors"]}
        singles, lists = records.sql_checks(spec, "", "", 0)
        named = {c.split("THEN '")[1].split("'")[0] for c in singles}
        assert named <= seen[id(spec)], sorted(named - seen[id(spec)])
    inner = {e for e in seen[id(records.EPISODE)] if ".#" in e}
    for code in ("hypotheses.#.probability:maximum", "hypotheses.#.label:not", "hypotheses.#.state_ref:required", "observations.#.record_ids:minItems", "observations.#.record_ids.#:minLength", "interventions.#.predictions.#.hypothesis_ref:required",
                 "interventions.#.candidate_hypotheses:uniqueItems", "interventions.#.safety_class:const", "context.social.#.entity_type:enum", "context.social.#.distance_m:minimum", "missing_modalities.#:enum"):
        assert code in inner


def test_csv_contract(spark, tmp_path):
    from evidencelens.sources.tables import read_table_csv

    (tmp_path / "t.csv").write_text("a,b\n1,2\n")
    (tmp_path / "empty.csv").write_text("a,b\n")
    assert read_table_csv(spark, str(tmp_path / "t.csv"), ["a"]).count() == 1
    with pytest.raises(ValueError, match="missing required"):
        read_table_csv(spark, str(tmp_path / "t.csv"), ["c"])
    with pytest.raises(ValueError, match="no rows"):
        read_table_csv(spark, str(tmp_path / "empty.csv"), ["a"])


def test_late_frames_are_reported(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    schema = "sequence_id long, frame_index long, accepted boolean"
    spark.createDataFrame([(1, 0, True), (1, 1, False), (1, 3, False)], schema).coalesce(1).write.parquet(str(src))
    stream = lambda: spark.readStream.schema(schema).parquet(str(src))
    capture.drain(capture.track_state_stream(stream()), str(out), str(tmp_path / "cp"))
    spark.createDataFrame([(1, 2, True), (1, 4, True)], schema).coalesce(1).write.mode("append").parquet(str(src))
    capture.drain(capture.track_state_stream(stream()), str(out), str(tmp_path / "cp"))
    got = {(r["frame_index"], r["transition"]) for r in spark.read.parquet(str(out)).collect()}
    assert got == {(0, "tracked"), (1, "lost"), (3, "remain_lost"), (2, "late"), (4, "reacquired")}


def test_results_do_not_depend_on_partitions(spark):
    rows = episode_rows(11, 80)
    df = spark.createDataFrame(rows, SCHEMA)
    cols = ["event_id", "episodes_last_1h", "episodes_last_24h", *history.previous_columns()]
    a = history.timeline(df.repartition(1)).select(*cols)
    b = history.timeline(df.repartition(9)).select(*cols)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
