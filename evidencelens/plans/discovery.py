"""k-means structure: stability, silhouette, agreement with metadata, latent discovery.

All fits of a job (every k, subset, left-out family and restart) advance together in :mod:`evidencelens.plans.kmeans`; the rows are read once a
step, whatever the number of fits.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelens.functions import finite_double
from evidencelens.operators import clusters as cl
from evidencelens.plans import kmeans as km
from evidencelens.session import cut_lineage, materialise

#: A k that cannot be fitted is reported, not left out.
INELIGIBLE = "ineligible"


def _usable(rows: DataFrame, features: Sequence[str]) -> list[str]:
    """Features with at least one value; a column without any says nothing and cannot be imputed."""
    seen = rows.agg(*[F.count(finite_double(f)).alias(f) for f in features]).first()
    return [f for f in features if seen[f]]


def _subsets(k: int, features: Sequence[str], repeats: int, seed: int, restarts: int, size: int) -> list[km.Sample]:
    return [km.Sample(("subset", k, r), k, seed + 1000 * k + r, range(len(features)), restarts, size) for r in range(repeats)]


def _shapes(labels: DataFrame) -> list[DataFrame]:
    shape = cl.cluster_shape(labels, ["k"], "cluster")
    return [km.tidy(shape, c, F.col(c)) for c in ("smallest_fraction", "largest_fraction", "normalized_entropy")]


def _sizes(labels: DataFrame, k_values: Sequence[int]) -> DataFrame:
    """Rows of every cluster, empty ones too."""
    every = labels.sparkSession.createDataFrame([(k, c) for k in k_values for c in range(1, k + 1)], "k int, cluster long")
    counts = labels.groupBy("k", "cluster").agg(F.count(F.lit(1)).alias("n"))
    return km.tidy(every.join(counts, ["k", "cluster"], "left"), "size", F.coalesce("n", F.lit(0)), F.col("cluster").cast("string"))


def _ami(labels: DataFrame, rows: DataFrame, row_id: str, metadata: Sequence[str]) -> DataFrame:
    j = labels.select(row_id, "k", "cluster").join(rows.select(row_id, *metadata), row_id)
    long = j.select("k", "cluster", F.explode(F.array(*[F.struct(F.lit(c).alias("detail"), F.col(c).cast("string").alias("b")) for c in metadata])).alias("r")).select("k", "cluster", "r.*")
    return km.tidy(cl.contingency_ami(long, ["k", "detail"], "cluster", "b"), "ami", F.col("ami"), F.col("detail"))


def cluster_stability(rows: DataFrame, row_id: str, features: Sequence[str], metadata: Sequence[str], k_values: Sequence[int] = tuple(range(2, 9)), *, repeats: int = 20, fraction: float = 0.8,
                      seed: int = 20260821, restarts: int = 50, subset_restarts: int = 20, max_iter: int = 50) -> tuple[DataFrame, DataFrame]:
    """(report, labels). Report rows per k: silhouette (squared distance), stability, AMI with each metadata column, sizes and the frozen parameters.

    Imputation and scaling are those of all rows; subsets only move the centres. Labels: row id, k, cluster.
    """
    features = _usable(rows, features)
    x = cut_lineage(km.packed(rows, row_id, features))
    n = x.count()
    fits = [k for k in k_values if n > k]
    size = {k: min(n - 1, max(k + 1, round(fraction * n))) for k in fits}
    whole = [km.Sample(("all", k), k, seed + k, range(len(features)), restarts) for k in fits]
    parts = {k: _subsets(k, features, repeats, seed, subset_restarts, size[k]) for k in fits}
    report = [(k, INELIGIBLE, "too_few_rows", None) for k in k_values if k not in fits]
    if not fits:
        return km.table(report, x), x.select(row_id, F.lit(0).alias("k"), F.lit(0).cast("long").alias("cluster")).limit(0)
    km.fit(x, [*whole, *(s for p in parts.values() for s in p)], max_iter, alike=whole[0])
    silhouette, stability = km.silhouettes(x, whole), km.mean_pairwise_ari(x, parts)
    for s in whole:
        report += [(s.k, "silhouette", "", silhouette[s.name]), (s.k, "stability", "", stability[s.k])]
    report += km.parameters(whole, features)
    labels = materialise(km.labels(x, whole, row_id).drop("sample"), "labels")
    return reduce(DataFrame.unionByName, [km.table(report, x), _ami(labels, rows, row_id, metadata), _sizes(labels, fits)]), labels


def latent_discovery(fit_features: DataFrame, row_id: str, families: dict[str, str], k_values: Sequence[int] = tuple(range(2, 9)), *, repeats: int = 20, fraction: float = 0.8,
                     seed: int = 20260821, restarts: int = 20, max_iter: int = 50) -> tuple[DataFrame, DataFrame]:
    """(metric rows per k, canonical cluster id per row and k) from predictor columns alone.

    The input holds the row id and the manifest's features; audit columns live in another DataFrame and
    cannot be reached from here. Every subset and every left-out family has an imputer and a scaler of its own.
    """
    features = list(families)
    extra = set(fit_features.columns) - {row_id, *features}
    if extra:
        raise ValueError(f"columns outside the feature manifest: {sorted(extra)}")
    features = _usable(fit_features, features)
    x = cut_lineage(km.packed(fit_features, row_id, features))
    n = x.count()
    fits = [k for k in k_values if n > k]
    report = [(k, INELIGIBLE, "too_few_rows", None) for k in k_values if k not in fits]
    names = sorted(set(families.values()))
    without = {f: [i for i, c in enumerate(features) if families[c] != f] for f in names}
    empty = x.select(row_id, F.lit(0).alias("k"), F.lit("").alias("cluster_id")).limit(0)
    if not fits:
        return km.table(report, x), empty
    whole = [km.Sample(("all", k), k, seed + k, range(len(features)), restarts) for k in fits]
    parts = {k: _subsets(k, features, repeats, seed, restarts, min(n, max(k + 1, int(fraction * n)))) for k in fits}
    left = [km.Sample(("without", k, f), k, seed + 10_000 + k, without[f], restarts) for k in fits for f in names if without[f]]
    km.fit(x, [*whole, *left, *(s for p in parts.values() for s in p)], max_iter)
    silhouette, stability = km.silhouettes(x, [*whole, *left]), km.mean_pairwise_ari(x, parts)
    for s in whole:
        full = silhouette[s.name]
        report += [(s.k, "silhouette", "", full), (s.k, "stability", "", stability[s.k])]
        for f in names:
            if not without[f]:
                report.append((s.k, INELIGIBLE, f"no_feature_without:{f}", None))
                continue
            other = silhouette["without", s.k, f]
            report.append((s.k, "silhouette_without_family", f, other))
            report.append((s.k, "delta_vs_full", f, None if other is None or full is None else other - full))
            report.append((s.k, "remaining_features", f, float(len(without[f]))))
    report += km.parameters(whole, features)
    labels = materialise(km.labels(x, whole, row_id).drop("sample"), "labels")
    shown = labels.select(row_id, "k", F.format_string("Z%02d-c%d", "k", "cluster").alias("cluster_id"))
    return reduce(DataFrame.unionByName, [km.table(report, x), *_shapes(labels), _sizes(labels, fits)]), shown


def confound_report(labels: DataFrame, audit: DataFrame, row_id: str, attributes: Sequence[str]) -> DataFrame:
    """AMI of every k's clusters with the audit attributes and the identity warning."""
    j = labels.join(audit.select(row_id, *attributes), row_id)
    long = j.select("k", "cluster_id", F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("b")) for a in attributes])).alias("r")).select("k", "cluster_id", "r.*")
    return cl.confound_audit(cl.contingency_ami(long, ["k", "attribute"], "cluster_id", "b"), ["k"])
