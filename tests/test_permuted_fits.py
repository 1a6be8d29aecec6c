"""Controls with permuted groups are fitted from the rows themselves, not from rows x folds x repeats."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidencelens.operators import metrics
from evidencelens.operators import permutation as pt
from evidencelens.plans import logistic as lg
from evidencelens.plans import models as md

GROUPS = [None, "a", "b", "c", "d"]


def odd_rows():
    """(path, group, class, value): some paths come twice or are missing, as do groups; equal paths hold equal rows."""
    rng = np.random.default_rng(8)
    rows = [(str(i), GROUPS[int(rng.integers(0, 5))], int(rng.integers(0, 2)), float(rng.normal())) for i in range(260)]
    return [*rows, *rows[:50], *[(None, "b", 1, 2.5)] * 40]


def by_hand(rows, fold, repeat):
    """Centres of the permuted groups, and of the true groups (rows, mean, variance) of what is left."""
    own = [r for r in rows if r[1] != fold]
    text = lambda r: f"9|{fold}|{repeat}" + ("" if r[0] is None else f"|{r[0]}")
    own.sort(key=lambda r: hashlib.sha256(text(r).encode()).hexdigest())
    labels = sorted((r[1] for r in own), key=GROUPS.index)
    centre = {g: np.mean([r[3] for r, x in zip(own, labels) if x == g]) for g in {*labels}}
    left = [(r[1], r[3] - centre[g]) for r, g in zip(own, labels) if g is not None]
    true = {g: [v for x, v in left if x == g] for g in {x for x, _ in left}}
    return {g: c for g, c in centre.items() if g is not None}, {g: (len(v), np.mean(v), np.var(v)) for g, v in true.items()}


@pytest.mark.parametrize("sizes", [{}, {"BLOCK_FITS": 3, "KEYED_ROWS": 40, "FAN": 2}])
def test_permuted_fits_are_centred_by_the_permuted_groups(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(lg, name, value)
    rows = odd_rows()
    base = spark.createDataFrame(rows, "path string, g string, y int, v double").select("g", "y", F.array("v").alias("x"), "path")
    models = [lg.Model(f"p_{r}", [0], permuted=(9, r)) for r in range(2)]
    fits = lg.fit_all(base, models, 2, leave_out=True, path="path", labels=lambda some, heads: metrics.pseudo_groups(some, 9, ["fold"], F.lit(0), "gs", "path", heads=heads))
    found = {(f.group, f.model.permuted[1]): f for f in (lg.loaded(r["state"]) for r in fits.collect())}
    assert found.keys() == {(g, r) for g in GROUPS[1:] for r in range(2)}
    moments = {}
    for r in lg.group_moments(fits, ["v"]).collect():
        moments.setdefault((r["fold"], r["repeat"]), {})[GROUPS[r["at"]]] = (r["n_v"], r["m_v"], r["v_v"])
    for (fold, repeat), f in found.items():
        centre, true = by_hand(rows, fold, repeat)
        assert f.supported and f.converged
        for g, c in centre.items():
            assert np.isclose(f.centres[GROUPS.index(g), 0], c)
        got = moments[fold, repeat]
        # Equal rows on both sides of a border between groups are told apart by their numbers, so a true group's rows are only as many as by hand.
        assert got.keys() == true.keys() and all(np.allclose(got[g], true[g]) for g in true)


def test_places_of_equal_and_nearly_equal_digests():
    """Rows that share their first bytes with the first row of a group are ordered by all of them and by their numbers."""
    tails, ids = np.array([None, None, "x", "y", None, "x"], object), np.arange(6)
    words = pt.words("h", tails, ids)
    order = sorted(range(6), key=lambda i: tuple(words[i].tolist()))
    key = (words[:, 0] >> np.uint64(32)).astype(np.uint32)
    for cut in range(1, 6):
        got = pt.places(words[[order[cut]]], "h", key, tails, ids)
        assert [int(got[i]) for i in order] == [0] * cut + [1] * (6 - cut)
    assert pt.places(np.zeros((0, 5), np.uint64), "h", key, tails, ids).tolist() == [0] * 6


def test_invariance_hands_the_rows_on_once(spark, monkeypatch):
    """Neither what the controls are fitted to nor what is written before grows by folds or repeats."""

    class Enough(Exception):
        pass

    given, written, write = [], [], md.materialise

    def fit_all(rows, *more, **named):
        given.append(rows.count())
        if len(given) == 2:
            raise Enough

    def materialise(df, label):
        written.append(df.count())
        return write(df, label)

    monkeypatch.setattr(md.lg, "fit_all", fit_all)
    monkeypatch.setattr(md, "materialise", materialise)
    rows = spark.createDataFrame([(i, i % 6, i % 2, float(i % 11), None if i % 7 == 0 else i * 0.5) for i in range(120)], "path long, g long, y long, f1 double, f2 double")
    with pytest.raises(Enough):
        md.identity_invariance(rows, "g", "y", "path", ["f1", "f2"], 2, repeats=4, seed=3)
    assert given == [120, 120] and max(written) == 120
