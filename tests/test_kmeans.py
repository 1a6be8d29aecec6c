"""Batched k-means against NumPy, and the discovery reports against SQL over the written labels."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evidencelens.operators import clusters as cl
from evidencelens.plans import kmeans as km
from evidencelens.plans.discovery import cluster_stability, latent_discovery


def planted(n=240, seed=1, gaps=True):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 6, (3, 4))
    x = centres[np.arange(n) % 3] + rng.normal(0, 1, (n, 4))
    if gaps:
        x[rng.random((n, 4)) < 0.1] = np.nan
    return x


def frame(spark, x, parts=5):
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], i % 3, f"g{i % 7}") for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"f{j} double" for j in range(x.shape[1])) + ", truth long, other string").repartition(parts)


FEATURES = ["f0", "f1", "f2", "f3"]


@pytest.fixture(scope="module")
def fitted(spark):
    x = planted()
    rows = km.packed(frame(spark, x), "id", FEATURES).cache()
    samples = [km.Sample(("all", k), k, 10 + k, range(4), 5) for k in (2, 3, 5)]
    samples += [km.Sample(("subset", k, r), k, 1000 * k + r, range(4), 5, 150 + r) for k in (2, 3) for r in range(4)]
    samples += [km.Sample(("without", 3), 3, 99, [0, 2], 5)]
    km.fit(rows, samples)
    h = {r["id"]: r["h"] for r in rows.collect()}
    return x, rows, samples, np.array([h[i] for i in range(len(x))], np.int64).view(np.uint64)


def test_samples_have_their_exact_size_and_exact_medians(fitted):
    x, _, samples, h = fitted
    for s in samples:
        use = km.used(s, h)
        own = x if use is None else x[use]
        assert len(own) == (s.size or len(x))
        assert np.allclose(s.fill, np.nanmedian(own[:, list(s.cols)], axis=0), atol=0)
        full = np.where(np.isnan(own), np.nan, own)[:, list(s.cols)]
        full = np.where(np.isnan(full), s.fill, full)
        assert np.allclose(s.mean, full.mean(axis=0)) and np.allclose(s.scale, full.std(axis=0))


def lloyd(z, k, rng, restarts=30):
    best = np.inf
    for _ in range(restarts):
        c = z[rng.choice(len(z), k, replace=False)]
        for _ in range(60):
            at = ((z[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            c = np.stack([z[at == i].mean(axis=0) if (at == i).any() else c[i] for i in range(k)])
        best = min(best, ((z[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).sum())
    return best


def test_fits_are_fixed_points_of_least_cost(fitted):
    x, _, samples, h = fitted
    rng = np.random.default_rng(0)
    for s in samples:
        use = km.used(s, h)
        z = km.scaled(s, x if use is None else x[use])
        d = ((z[:, None] - s.centre[None]) ** 2).sum(axis=2)
        at = d.argmin(axis=1)
        assert np.allclose([z[at == i].mean(axis=0) for i in range(s.k)], s.centre, atol=1e-3)
        assert np.isclose(d.min(axis=1).sum(), s.cost[s.best]) and s.cost[s.best] == s.cost.min()
        assert s.cost[s.best] <= 1.01 * lloyd(z, s.k, rng)


def test_stability_and_silhouette_equal_plain_python(fitted, spark):
    x, rows, samples, _ = fitted
    part = [s for s in samples if s.name[0] == "subset" and s.k == 3]
    got = km.mean_pairwise_ari(rows, {3: part})[3]
    labels = [km.assigned(s, x) for s in part]
    cells = lambda a, b: np.array([[((a == i) & (b == j)).sum() for j in range(1, 4)] for i in range(1, 4)])
    assert np.isclose(got, np.mean([km.adjusted_rand(cells(labels[i], labels[j])) for i in range(4) for j in range(i + 1, 4)]))
    long = spark.createDataFrame([(int(a), int(b)) for a, b in zip(labels[0], labels[1])], "a long, b long").withColumn("k", F.lit(1))
    assert np.isclose(cl.contingency_ari(long, ["k"], "a", "b").first()["ari"], km.adjusted_rand(cells(labels[0], labels[1])))
    for s in samples[:3]:
        z, at = km.scaled(s, x), km.assigned(s, x)
        d = ((z[:, None] - z[None]) ** 2).sum(axis=2)
        score = []
        for i in range(len(z)):
            own = [d[i, j] for j in range(len(z)) if at[j] == at[i] and j != i]
            other = [d[i, at == c].mean() for c in set(at.tolist()) - {at[i]}]
            a, b = np.mean(own), min(other)
            score.append((b - a) / max(a, b))
        assert np.isclose(km.silhouettes(rows, [s])[s.name], np.mean(score))


def test_passes_do_not_grow_with_the_fits(spark, monkeypatch):
    rows = km.packed(frame(spark, planted(90)), "id", FEATURES)
    counts = []
    plain = km.merged_pass
    for repeats in (1, 12):
        calls = []
        monkeypatch.setattr(km, "merged_pass", lambda *a, calls=calls: calls.append(1) or plain(*a))
        km.fit(rows, [km.Sample(("s", r), 3, r, range(4), 2, 70) for r in range(repeats)], max_iter=3)
        counts.append(len(calls))
    assert counts[0] == counts[1]


def test_same_result_at_any_partitioning(spark):
    x = planted(120)
    found = []
    for parts in (1, 7):
        s = km.Sample(("all", 3), 3, 5, range(4), 3)
        km.fit(km.packed(frame(spark, x, parts), "id", FEATURES), [s])
        found.append(s.centre)
    assert np.allclose(found[0], found[1])


def test_report_equals_sql_over_the_written_labels(spark, tmp_path):
    rows = frame(spark, planted(150, gaps=False))
    report, labels = cluster_stability(rows, "id", FEATURES, ["truth", "other"], [2, 3, 4], repeats=3, restarts=3, subset_restarts=2)
    labels.write.parquet(str(tmp_path / "labels"))
    rows.write.parquet(str(tmp_path / "rows"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW l AS SELECT * FROM '{tmp_path}/labels/*.parquet'; CREATE VIEW r AS SELECT * FROM '{tmp_path}/rows/*.parquet'")
    got = {(r["k"], r["metric"], r["detail"]): r["value"] for r in report.collect()}
    for k, cluster, n in duck.execute("SELECT k, cluster, count(*) FROM l GROUP BY 1, 2").fetchall():
        assert got[k, "size", str(cluster)] == n
    # Silhouette with squared distances of standardised features, and mutual information, from the labels alone.
    z = ", ".join(f"(f{j} - avg(f{j}) OVER ()) / stddev_pop(f{j}) OVER () AS z{j}" for j in range(4))
    squared = " + ".join(f"(a.z{j} - b.z{j}) ** 2" for j in range(4))
    sql = f"""WITH s AS (SELECT id, {z} FROM r), d AS (SELECT x.k, a.id, x.cluster AS own, y.cluster AS other, sum({squared}) / (count(*) - (x.cluster = y.cluster)::INT) AS m
      FROM s a JOIN l x USING (id), s b JOIN l y USING (id) WHERE x.k = y.k GROUP BY x.k, a.id, x.cluster, y.cluster),
    p AS (SELECT k, id, max(CASE WHEN own = other THEN m END) AS a, min(CASE WHEN own <> other THEN m END) AS b FROM d GROUP BY 1, 2) SELECT k, avg((b - a) / greatest(a, b)) FROM p GROUP BY 1"""
    for k, value in duck.execute(sql).fetchall():
        assert np.isclose(got[k, "silhouette", ""], value)
    sql = """WITH c AS (SELECT k, cluster, {0} AS b, count(*)::DOUBLE AS n FROM l JOIN r USING (id) GROUP BY 1, 2, 3), t AS (SELECT k, sum(n) AS total FROM c GROUP BY 1),
    a AS (SELECT k, cluster, sum(n) AS na FROM c GROUP BY 1, 2), b AS (SELECT k, b, sum(n) AS nb FROM c GROUP BY 1, 2)
    SELECT k, sum(n / total * ln(n * total / (na * nb))) FROM c JOIN t USING (k) JOIN a USING (k, cluster) JOIN b USING (k, b) GROUP BY 1"""
    information = dict(duck.execute(sql.format("truth")).fetchall())
    assert got[3, "ami", "truth"] > 0.95 and np.isclose(information[3], np.log(3), atol=0.05) and abs(got[3, "ami", "other"]) < 0.1
    assert {m for _, m, _ in got} == {"silhouette", "stability", "ami", "size", "fill", "mean", "scale", "centre"}
    assert sum(m == "centre" for _, m, _ in got) == 4 * (2 + 3 + 4) and got[3, "stability", ""] > 0.95


def test_latent_discovery_returns_frozen_parameters_and_family_deltas(spark):
    rows = frame(spark, planted(100)).drop("truth", "other")
    report, labels = latent_discovery(rows, "id", {"f0": "a", "f1": "a", "f2": "b", "f3": "b"}, [2, 3, 200], repeats=2, restarts=2)
    got = {(r["k"], r["metric"], r["detail"]): r["value"] for r in report.collect()}
    assert got[200, "ineligible", "too_few_rows"] is None
    for k in (2, 3):
        assert np.isclose(got[k, "delta_vs_full", "a"], got[k, "silhouette_without_family", "a"] - got[k, "silhouette", ""])
        assert got[k, "remaining_features", "b"] == 2.0
        assert sum(v for (kk, m, _), v in got.items() if kk == k and m == "size") == 100
    assert {r[0] for r in labels.select("cluster_id").distinct().collect()} == {"Z02-c1", "Z02-c2", "Z03-c1", "Z03-c2", "Z03-c3"}


def test_discovery_is_registered_at_full_size(monkeypatch):
    from evidencelens.catalog import models

    seen = []
    monkeypatch.setattr(models.views, "clips", lambda spark, sf, n=4: seen.append(n))
    monkeypatch.setattr(models, "cluster_stability", lambda *a, **b: seen.append((a[3:], b)) or [None])
    models.stability(None, None)
    assert seen[0] == 64 and seen[1] == ((["context", "group_id", "owner_id"],), {})
    import inspect

    for fn in (cluster_stability, latent_discovery):
        p = inspect.signature(fn).parameters
        assert list(p["k_values"].default) == list(range(2, 9)) and p["repeats"].default == 20 and p["restarts"].default >= 20
