"""Imputation inside folds, against NumPy."""

import numpy as np

from evidencelens.plans import models as md
from evidencelens.plans.discovery import latent_discovery

F2 = ["f1", "f2"]


def gappy_rows():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        f = [float(x) for x in rng.normal(i % 4, 1, 2)]
        f = [None if rng.random() < 0.2 else float("nan") if rng.random() < 0.1 else x for x in f]
        rows.append((i, i % 4, i % 2, *f))
    return rows


def filled(rows, fold):
    """All rows with the medians of the rows outside the fold."""
    x = np.array([[np.nan if v is None else v for v in r[3:]] for r in rows], float)
    train = np.array([r[1] != fold for r in rows])
    return np.where(np.isnan(x), np.nanmedian(x[train], axis=0), x), train


def test_fold_means_are_means_of_imputed_training_rows(spark):
    rows = gappy_rows()
    df = spark.createDataFrame(rows, "path long, g long, y long, f1 double, f2 double")
    medians = md._median_table(df, "g", F2, [0, 1, 2, 3])
    got = {r["g"]: (r["pm_f1"], r["pm_f2"]) for r in md._fold_means(df, "g", F2, medians).collect()}
    for fold in range(4):
        x, train = filled(rows, fold)
        assert np.allclose(got[fold], x[train].mean(axis=0))


def test_held_out_rows_are_imputed_before_they_are_centred(spark):
    rows = gappy_rows()
    df = spark.createDataFrame(rows, "path long, g long, y long, f1 double, f2 double")
    medians = md._median_table(df, "g", F2, [0, 1, 2, 3])
    got = {r["path"]: (r["f1"], r["f2"]) for r in md._imputed(df, medians, "g", F2).collect()}
    assert len(got) == len(rows)
    for fold in range(4):
        x, train = filled(rows, fold)
        for i in np.flatnonzero(~train):
            assert np.allclose(got[rows[i][0]], x[i])


def test_complete_rows_need_no_medians(spark):
    df = spark.createDataFrame([(i, i % 2, i % 2, float(i), 1.0) for i in range(8)], "path long, g long, y long, f1 double, f2 double")
    assert md._median_table(df, "g", F2, [0, 1]) is None
    got = {r["g"]: r["pm_f1"] for r in md._fold_means(df, "g", F2, None).collect()}
    assert got == {0: 4.0, 1: 3.0}


def test_discovery_reports_what_it_cannot_do(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, float(rng.normal((i % 2) * 9)), None) for i in range(12)], "id long, f1 double, f2 double")
    report, labels = latent_discovery(df, "id", {"f1": "one", "f2": "two"}, [2, 12], repeats=2, restarts=1)
    got = {(r["k"], r["metric"], r["detail"]): r["value"] for r in report.collect()}
    assert got[12, "ineligible", "too_few_rows"] is None and (2, "ineligible", "no_feature_without:one") in got
    assert got[2, "stability", ""] == 1.0 and labels.count() == 12


def test_personalisation_is_registered_with_all_budgets_and_repeats(monkeypatch):
    from evidencelens.catalog import models

    seen = {}
    monkeypatch.setattr(models, "gappy", lambda spark, sf: None)
    monkeypatch.setattr(models.md, "personalisation_evaluation", lambda *a, **b: seen.update(b))
    models.personalisation(None, None)
    assert seen["budgets"] == [1, 2, 4, 8, 16] and seen["repeats"] == 20
