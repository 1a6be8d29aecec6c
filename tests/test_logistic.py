"""Fits solved on the executors against a plain solver, and the sparse categories against dense ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidencelens.plans import logistic as lg
from evidencelens.plans import models as md


def data(n=300, d=3, groups=5, classes=3, seed=1, gaps=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, d)) * [1, 5, 0.1][:d] + 3
    y = (x[:, 0] + rng.normal(0, 1, n) > 3).astype(int) + (classes > 2) * (x[:, 1] + rng.normal(0, 3, n) > 6)
    if gaps:
        x[rng.random((n, d)) < gaps] = np.nan
    return x, y, rng.integers(0, groups, n)


def minimum(z, y, classes, c=1.0, penalise=False):
    """Gradient of the objective at the fit must vanish: returns a function of beta."""
    present = np.unique(y)
    w = len(y) / (len(present) * np.bincount(y, minlength=classes)[y])
    z = np.hstack([z, np.ones((len(z), 1))])

    def gradient(beta):
        if len(present) == 2:
            p = 1 / (1 + np.exp(-(z @ beta[0])))
            g = c * (z.T @ (w * (p - (y == present[1]))))[None]
        else:
            s = z @ beta.T
            e = np.exp(s - s.max(axis=1, keepdims=True))
            g = c * ((e / e.sum(axis=1, keepdims=True) - (y[:, None] == present)) * w[:, None]).T @ z
        ridge = np.ones_like(beta)
        if not penalise:
            ridge[:, -1] = 0
        return np.abs(g + ridge * beta).max()

    return gradient


def frame(spark, x, y, g, c=None):
    rows = [(int(a), int(b), [float(v) for v in r], [] if c is None else [int(v) for v in k]) for a, b, r, k in zip(g, y, x, [None] * len(y) if c is None else c)]
    return spark.createDataFrame(rows, "g long, y int, x array<double>, c array<long>").repartition(4)


def fits_of(table):
    return {(r["model"], r["gs"]): (lg.loaded(r["state"]), r) for r in table.collect()}


@pytest.mark.parametrize("classes", [2, 3])
def test_leave_one_group_out_fits_are_minima(spark, classes, monkeypatch):
    monkeypatch.setattr(lg, "BLOCK_FITS", 6)  # two blocks
    x, y, g = data(classes=classes)
    table = lg.fit_all(frame(spark, x, y, g), [lg.Model("all", [0, 1, 2]), lg.Model("two", [0, 2])], classes, leave_out=True)
    found = fits_of(table)
    assert len(found) == 10 and all(r["converged"] and r["gradient"] < 1e-7 for _, r in found.values())
    for (model, gs), (f, _) in found.items():
        own = g != int(gs)
        z = x[own][:, list(f.model.cols)]
        assert np.allclose(f.mean, z.mean(axis=0)) and np.allclose(f.scale, z.std(axis=0))
        assert minimum((z - f.mean) / f.scale, y[own], classes)(f.beta) < 1e-6
    scored = lg.predict(frame(spark, x, y, g).withColumn("row", F.monotonically_increasing_id()), table, ["g", "y", "row"], classes)
    rows = scored.collect()
    assert len(rows) == 2 * len(x) and all(abs(sum(r[f"p{i}"] for i in range(classes)) - 1) < 1e-9 and r["converged"] for r in rows)


def test_centred_fits_with_gaps(spark):
    x, y, g = data(gaps=0.15)
    fill = [(k, np.nanmedian(x[g != k], axis=0).tolist()) for k in range(5)]
    table = lg.fit_all(frame(spark, x, y, g), [lg.Model("centred", [0, 1, 2], tau=0.0), lg.Model("shrunk", [0, 1, 2], tau=4.0)], 3, leave_out=True, fill=spark.createDataFrame(fill, "g long, fill array<double>"))
    for (model, gs), (f, r) in fits_of(table).items():
        own = g != int(gs)
        full = np.where(np.isnan(x), np.array(dict(fill)[int(gs)]), x)[own]
        mu, z = full.mean(axis=0), full.copy()
        for k in set(g[own].tolist()):
            at = g[own] == k
            a = at.sum() / (at.sum() + f.model.tau)
            z[at] -= a * full[at].mean(axis=0) + (1 - a) * mu
        assert r["converged"] and np.allclose(f.mean, z.mean(axis=0)) and np.allclose(f.scale, z.std(axis=0))
        assert minimum((z - f.mean) / f.scale, y[own], 3)(f.beta) < 1e-6


def test_hot_group_fills_several_lanes_and_sums_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(lg, "LANE_ROWS", 20)
    monkeypatch.setattr(lg, "FAN", 3)
    x, y, g = data(n=400, groups=8, classes=2)
    g[:200] = 7
    for leave_out in (True, False):
        for (_, gs), (f, r) in fits_of(lg.fit_all(frame(spark, x, y, g), [lg.Model("m", [0, 1])], 2, leave_out=leave_out)).items():
            own = (g != int(gs)) if leave_out else (g == int(gs))
            z = x[own][:, :2]
            assert r["converged"] and minimum((z - z.mean(axis=0)) / z.std(axis=0), y[own], 2)(f.beta) < 1e-6


def test_one_class_is_unsupported_and_unfinished_fits_say_so(spark):
    x, y, g = data(n=60, groups=3, classes=2)
    y[g == 1] = 0
    table = lg.fit_all(frame(spark, x, y, g), [lg.Model("m", [0])], 2, leave_out=False, max_iter=1)
    got = {r["gs"]: (r["supported"], r["converged"], r["steps"]) for r in table.collect()}
    assert got["1"] == (False, False, 0) and got["0"] == (True, False, 1)
    assert {r["g"] for r in lg.predict(frame(spark, x, y, g), table, ["g"], 2).select("g").distinct().collect()} == {0, 2}


@pytest.mark.parametrize("dense", [400, 1])
def test_categories_equal_dense_columns(spark, dense, monkeypatch):
    """Newton and the quasi-Newton form end at the same minimum."""
    x, y, g = data(n=240, groups=2, classes=2)
    rng = np.random.default_rng(4)
    c = np.stack([rng.integers(-1, 7, len(y)), rng.integers(100, 103, len(y))], axis=1)
    monkeypatch.setattr(lg, "DENSE", dense)
    tol, near = (1e-7, 1e-6) if dense > 1 else (1e-4, 2e-4)
    for (_, gs), (f, r) in fits_of(lg.fit_all(frame(spark, x, y, g, c), [lg.Model("m", [0, 1], [0, 1])], 2, leave_out=False, centre=False, penalise_intercept=True, tol=tol)).items():
        own = g == int(gs)
        hot = np.hstack([(c[own, j][:, None] == v[None, :]).astype(float) for j, v in enumerate(f.values)])
        z = np.hstack([x[own][:, :2] / x[own][:, :2].std(axis=0), hot / hot.std(axis=0)])
        assert r["converged"] and minimum(z, y[own], 2, penalise=True)(f.beta) < near


def test_a_feature_of_fifty_thousand_values(spark):
    n = 60_000
    rows = spark.range(n).select(
        (F.col("id") % 40).alias("house"), F.col("id").alias("t"), F.col("id").alias("tie"), (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).cast("int").alias("y"),
        F.concat(F.lit("value "), F.pmod(F.xxhash64(F.col("id") + 1), F.lit(50_000)).cast("string")).alias("word"), F.rand(3).alias("v"))
    words = md.vocabulary(rows, ["word"])
    size = words.count()
    assert size > 30_000 and words.agg(F.min("index"), F.max("index"), F.count_distinct("index")).first()[:] == (0, size - 1, size)
    out = md.chronological_evaluation(rows, "house", "t", "tie", "y", {"words": (["word"], ["v"]), "numbers": ([], ["v"])}).collect()
    assert len(out) == 120 and {r["status"] for r in out} == {"ok"} and all(r["n"] > 400 for r in out)
    assert all(r["converged"] for r in out if r["model"] != "prevalence")


def test_sparse_designs(spark):
    df = spark.createDataFrame([(1, "b", None, 2.0), (2, "a", "y", None), (3, None, "z", 1.0)], "id long, p string, q string, v double")
    words = md.vocabulary(df.where("id < 3"), ["p", "q"])
    assert [tuple(r) for r in words.orderBy("index").select("feature", "value", "index").collect()] == [("p", "a", 0), ("p", "b", 1), ("q", "y", 2)]
    got = {r["id"]: (r["idx"], r["val"]) for r in md.one_hot_dict(df, ["p", "q"], ["v"], words).collect()}
    assert got == {1: ([1, 3], [1.0, 2.0]), 2: ([0, 2, 3], [1.0, 1.0, 0.0]), 3: ([3], [1.0])}
    empty = md.vocabulary(df.limit(0), ["p", "q"])
    assert empty.count() == 0 and md.one_hot_dict(df, ["p"], [], empty).select("idx").first()["idx"] == []
