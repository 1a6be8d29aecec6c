"""Curve errors keep a curve's points together; odd curves give what a join of points by place gives."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidencelens.catalog import instances as catalog
from evidencelens.operators import instances as ins
from tests.conftest import SMALL


def resampled(curve, n=32):
    """Every segment against every target, as rows."""
    out = {}
    for key in {r[0] for r in curve}:
        s = sorted((r for r in curve if r[0] == key), key=lambda r: r[1])
        length = [math.dist(a[2:4], b[2:4]) for a, b in zip(s, s[1:])]
        total = sum(length)
        for j in range(n if len(s) > 1 else 0):
            at, c0, k = total * j / (n - 1), 0.0, 0
            while total > 1e-12 and k < len(length) - 1 and at > c0 + length[k]:
                c0, k = c0 + length[k], k + 1
            a = 0.0 if total <= 1e-12 or length[k] <= 1e-12 else (at - c0) / length[k]
            out[key, j] = tuple(s[k][i] + a * (s[k + 1][i] - s[k][i]) for i in (2, 3))
    return out


CURVES = [(0, p, float(p * p), float(p)) for p in range(9)] + [(1, p, 3.0, 4.0) for p in range(4)] + [(2, 0, 1.0, 1.0)] + [(3, p, float(p // 2), 0.0) for p in range(6)]
CURVES += [(4, 0, 0.0, 0.0), (4, 1, 1e-9, 0.0), (4, 2, 1000.0, 0.0)] + [(5, p, float((p * 7) % 5), float((p * 3) % 4)) for p in range(40)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "visible") for r in rows], "curve_id long, pos long, x double, y double, visibility string")


def test_points_equal_a_walk_along_the_curve(spark):
    got = {(r["curve_id"], r["j"]): (r["x"], r["y"]) for r in ins.resample_curve(frame(spark, CURVES), ["curve_id"]).collect()}
    want = resampled(CURVES)
    assert got.keys() == want.keys() and all(math.dist(got[k], want[k]) < 1e-9 for k in want)


def test_errors_of_odd_curves(spark):
    other = [(c, p, x + 1, y + 2 * (p % 2)) for c, p, x, y in CURVES if c != 3] + [(9, 0, 0.0, 0.0), (9, 1, 1.0, 0.0)]
    got = {r["curve_id"]: r for r in ins.curve_error(frame(spark, CURVES), frame(spark, other), ["curve_id"], 10.0).collect()}
    a, b = resampled(CURVES), resampled(other)
    assert set(got) == {0, 1, 2, 4, 5} and got[2]["curve_mean_error"] is None and got[2]["base_error"] is not None
    for c in (0, 1, 4, 5):
        gaps = [math.dist(a[c, j], b[c, j]) / 10 for j in range(32)]
        assert abs(got[c]["curve_mean_error"] - sum(gaps) / 32) < 1e-9 and abs(got[c]["curve_max_error"] - max(gaps)) < 1e-9


def test_a_side_that_lacks_points_meets_by_place(spark):
    """A sample without a place ends its segment; the points that both sides have are compared."""
    gone = [(c, p, None if (c, p) == (5, 7) else x, y) for c, p, x, y in CURVES]
    r, p = frame(spark, gone), frame(spark, [(c, q, x + 1, y) for c, q, x, y in CURVES])
    got = {x["curve_id"]: x for x in ins.curve_error(r, p, ["curve_id"], 1.0).collect()}
    q = ins.resample_curve(p, ["curve_id"]).selectExpr("curve_id", "j", "x AS px", "y AS py")
    gap = F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2)
    want = {x["curve_id"]: x for x in ins.resample_curve(r, ["curve_id"]).join(q, ["curve_id", "j"]).groupBy("curve_id").agg(F.avg(gap).alias("m"), F.max(gap).alias("x")).collect()}
    assert abs(got[5]["curve_mean_error"] - want[5]["m"]) < 1e-9 and abs(got[5]["curve_max_error"] - want[5]["x"]) < 1e-9


def test_points_are_not_joined_as_rows(spark):
    plan = catalog.curve_error(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
