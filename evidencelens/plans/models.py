"""Evaluation jobs: grouped, personalised, invariance and chronological."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelens.functions import finite_double
from evidencelens.operators import metrics as m
from evidencelens.operators.keypoints import stack
from evidencelens.operators.quantiles import exact_quantiles
from evidencelens.operators.segments import digits_for, global_rank, meet_all, tasks_for
from evidencelens.plans import logistic as lg
from evidencelens.session import cut_lineage, materialise

PROBS = lambda k: [f"p{i}" for i in range(k)]
#: Columns of a report row; ``fold`` and ``budget`` are NULL where a value is about all of them.
REPORT = {"section": "string", "model": "string", "baseline": "string", "fold": "string", "test_session": "string", "budget": "int", "metric": "string", "value": "double"}
HIGHER_IS_BETTER = {"balanced_accuracy": True, "macro_f1": True, "log_loss": False, "brier": False, "ece": False}


def vector(features: Sequence[str]) -> Column:
    """Features as one array; NULL becomes NaN, the marker that is filled per fold."""
    return F.array(*[F.coalesce(finite_double(f), F.lit(float("nan"))) for f in features])


def fold_medians(rows: DataFrame, group: str, features: Sequence[str], folds: Sequence | None = None) -> DataFrame:
    """Exact training median per held-out group and feature.

    Every value meets every fold but its own, inside the task; only sketches and the few values near the median are shuffled on. ``folds``: some
    groups only, otherwise all of ``rows``.
    """
    long = rows.select(group, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), finite_double(f).alias("v")) for f in features])).alias("r")).select(group, "r.*").where("v IS NOT NULL")
    others = meet_all(long, _folds(rows, group, folds)).where(~F.col("fold").eqNullSafe(F.col(group)))
    # One bracket a fold and feature, as many as there are fits: broadcast, so that the rows x folds are not sorted to meet it.
    return exact_quantiles(others, ["fold", "feature"], "v", {"median": (0.5, "linear")}, small_keys=True)


def _folds(rows: DataFrame, group: str, folds: Sequence | None = None) -> DataFrame:
    if folds is None:
        return rows.select(F.col(group).alias("fold")).distinct()
    return rows.sparkSession.createDataFrame([(f,) for f in folds], f"fold {rows.schema[group].dataType.simpleString()}")


def median_impute(train: DataFrame, apply: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Exact training medians put in place of missing values; a column without any training value stays NULL where it is missing."""
    out, k = apply, list(keys)
    long = train.select(*k, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), finite_double(f).alias("v")) for f in features])).alias("r")).select(*k, "r.*")
    med = exact_quantiles(long, [*k, "feature"], "v", {"median": (0.5, "linear")})
    wide = med.groupBy(*k).agg(*[F.max(F.when(F.col("feature") == f, F.col("median"))).alias(f"__m_{f}") for f in features])
    out = apply.join(wide, k) if k else apply.crossJoin(F.broadcast(wide))
    return out.withColumns({f: F.coalesce(finite_double(f), F.col(f"__m_{f}")) for f in features}).drop(*[f"__m_{f}" for f in features])


def standardise(train: DataFrame, apply: DataFrame, features: Sequence[str], keys: Sequence[str] = (), centre: bool = True) -> DataFrame:
    """(x - mean) / population deviation of the training rows; zero variance divides by 1."""
    k = list(keys)
    stats = train.groupBy(*k).agg(*[a for f in features for a in (F.avg(f).alias(f"__a_{f}"), F.stddev_pop(f).alias(f"__s_{f}"))])
    j = apply.join(stats, k) if k else apply.crossJoin(F.broadcast(stats))
    scale = lambda f: F.when(F.col(f"__s_{f}") > 0, F.col(f"__s_{f}")).otherwise(F.lit(1.0))
    return j.withColumns({f: (F.col(f) - (F.col(f"__a_{f}") if centre else F.lit(0.0))) / scale(f) for f in features}).drop(
        *[f"__{t}_{f}" for f in features for t in "as"])


# ---- categories ----------------------------------------------------------------------------------


def vocabulary(train: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """(feature, value, index): the distinct training values of the categorical features, numbered in the order of feature and value.

    A table of any length: it is ranked by ranges and joined to the rows, never collected.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in categorical])
    values = train.select(F.explode(pairs).alias("p")).select("p.*").where("value IS NOT NULL").distinct()
    return global_rank(values, ["feature", "value"], "index")


def category_indices(df: DataFrame, categorical: Sequence[str], words: DataFrame, name: str) -> DataFrame:
    """``df`` with ``name`` array<long>: each feature's index, -1 for a missing or unseen value."""
    out = df
    for i, c in enumerate(categorical):
        own = words.where(F.col("feature") == c).select(F.col("value").alias(f"__v{i}"), F.col("index").alias(f"__i{i}"))
        out = out.join(own, F.col(c).cast("string") == F.col(f"__v{i}"), "left").drop(f"__v{i}")
    at = [F.coalesce(F.col(f"__i{i}"), F.lit(-1).cast("long")) for i in range(len(categorical))]
    return out.withColumn(name, F.array(*at) if at else F.array().cast("array<long>")).drop(*[f"__i{i}" for i in range(len(categorical))])


def one_hot_dict(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str], words: DataFrame) -> DataFrame:
    """Sparse designs: ``idx`` array<long>, ``val`` array<double>. A known category is a 1 at its index (unseen: nothing), numbers follow the vocabulary."""
    size = words.agg(F.count(F.lit(1)).alias("__size"))
    out = category_indices(df, categorical, words, "__c").crossJoin(F.broadcast(size))  # one row
    hot = F.filter("__c", lambda i: i >= 0)
    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numeric]
    places = [F.col("__size") + F.lit(j) for j in range(len(numeric))]
    idx = F.concat(hot, F.array(*places)) if places else hot
    ones = F.transform(hot, lambda _: F.lit(1.0))
    return out.withColumns({"idx": idx, "val": F.concat(ones, F.array(*numbers)) if numbers else ones}).drop("__c", "__size")


# ---- imputation inside folds ---------------------------------------------------------------------


def _median_table(rows: DataFrame, group: str, features: Sequence[str], folds: Sequence | None = None) -> DataFrame | None:
    """One row per fold with the training medians ``md_<feature>``; None when no feature has missing values."""
    missing = rows.agg(*[F.count_if(finite_double(f).isNull()).alias(f) for f in features]).first()
    if not any(missing):
        return None
    table = fold_medians(rows, group, features, folds)
    return cut_lineage(table.groupBy(F.col("fold").alias("__fold")).agg(*[F.max(F.when(F.col("feature") == f, F.col("median"))).alias(f"md_{f}") for f in features]))


def _imputed(rows: DataFrame, medians: DataFrame | None, fold: str, features: Sequence[str]) -> DataFrame:
    """Missing features hold the training median of the row's fold (0 where the fold has none), before anything is centred."""
    if medians is None:
        return rows
    filled = rows.join(medians, F.col(fold) == F.col("__fold"), "left")
    return filled.withColumns({f: F.coalesce(finite_double(f), F.col(f"md_{f}"), F.lit(0.0)) for f in features}).drop("__fold", *[f"md_{f}" for f in features])


def _fills(medians: DataFrame | None, features: Sequence[str]) -> DataFrame | None:
    """(g, fill): the medians of a fold as the array that its fits use."""
    return None if medians is None else medians.select(F.col("__fold").alias("g"), F.array(*[F.coalesce(F.col(f"md_{f}"), F.lit(0.0)) for f in features]).alias("fill"))


# ---- reports -------------------------------------------------------------------------------------


def report_rows(df: DataFrame, section: str, values: Sequence[str], **columns: Column) -> DataFrame:
    """Wide ``values`` as report rows; columns that are neither given nor in ``df`` are NULL."""
    have = {n: columns[n] if n in columns else F.col(n) if n in df.columns else F.lit(None) for n in list(REPORT)[1:-2]}
    pairs = F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])
    rows = df.select(F.lit(section).alias("section"), *[c.alias(n) for n, c in have.items()], F.explode(pairs).alias("__p")).select("section", *have, "__p.*")
    return rows.select(*[F.col(n).cast(t).alias(n) for n, t in REPORT.items()])


def fit_rows(fits: DataFrame) -> DataFrame:
    """Whether each fit was possible and converged, its last gradient and its steps."""
    shown = fits.withColumns({"supported": F.col("supported").cast("double"), "converged": F.col("converged").cast("double"), "steps": F.col("steps").cast("double")})
    return report_rows(shown.withColumnRenamed("gs", "fold"), "fit", ["supported", "converged", "gradient", "steps"])


def deltas(bundle: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Metric differences of (model, baseline) pairs on equal keys: keys, model, baseline, metrics."""
    parts = []
    k = list(keys)
    for model, baseline in pairs:
        own, base = bundle.where(F.col("model") == model), bundle.where(F.col("model") == baseline)
        met = own.select(*k, *[F.col(x).alias(f"__a_{x}") for x in m.METRICS]).alias("a").join(base.select(*[F.col(c).alias(f"__k_{c}") for c in k], *[F.col(x).alias(f"__b_{x}") for x in m.METRICS]), [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in k] or F.lit(True))
        parts.append(met.select(*k, F.lit(model).alias("model"), F.lit(baseline).alias("baseline"), *[(F.col(f"__a_{x}") - F.col(f"__b_{x}")).alias(x) for x in m.METRICS]))
    return stack(parts)


def unit_equal_deltas(fold_deltas: DataFrame, unit: str, keys: Sequence[str], *, reps: int, seed: int) -> DataFrame:
    """Mean of the fold deltas within each unit, equal weight across units: keys, metric, mean, median, lo, hi, units.

    ``fold_deltas``: keys, unit and the metrics, one row per fold. The interval resamples units in one pass (see ``metrics.poisson_ci``).
    """
    k = list(keys)
    per = fold_deltas.groupBy(*k, unit).agg(*[F.avg(x).alias(x) for x in m.METRICS])
    long = per.select(*k, unit, F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).alias("v")) for x in m.METRICS])).alias("r")).select(*k, unit, "r.*")
    ci = m.poisson_ci(long, "v", unit, reps, seed, [*k, "metric"])
    return ci.join(exact_quantiles(long, [*k, "metric"], "v", {"median": (0.5, "linear")}), [*k, "metric"])


def unit_equal_rows(fold_deltas: DataFrame, unit: str, keys: Sequence[str], *, reps: int, seed: int) -> DataFrame:
    equal = unit_equal_deltas(fold_deltas, unit, [*keys, "model", "baseline"], reps=reps, seed=seed)
    pairs = F.array(*[F.struct(F.concat_ws(":", F.col("metric"), F.lit(v)).alias("metric"), F.col(v).cast("double").alias("value")) for v in ("mean", "median", "lo", "hi", "units")])
    rows = equal.select(*keys, "model", "baseline", F.explode(pairs).alias("__p")).select(*keys, "model", "baseline", "__p.*")
    return _named(rows, "unit_equal")


def _named(rows: DataFrame, section: str) -> DataFrame:
    """Rows that have metric and value already as report rows."""
    return rows.select(F.lit(section).alias("section"), *[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in list(REPORT.items())[1:]])


# ---- grouped evaluation --------------------------------------------------------------------------


def grouped_evaluation(rows: DataFrame, group: str, label: str, families: dict[str, Sequence[str]], classes: int) -> DataFrame:
    """Majority, prevalence and one logistic per feature family, leave-one-group-out, pooled and per fold.

    All families and folds are fitted in the same Newton passes. Every row is scored once per model; ``covered`` says whether it was: a fold
    whose model could not be fitted keeps its row, with no metrics and ``covered`` false, and the pooled row then is not covered either.
    ``converged`` and ``gradient`` are the fit's (pooled: of all folds; NULL for the priors).
    """
    features = sorted({c for cols in families.values() for c in cols})
    at = {c: i for i, c in enumerate(features)}
    base = rows.select(F.col(group).alias("g"), F.col(label).cast("int").alias("y"), vector(features).alias("x"))
    fits = lg.fit_all(base, [lg.Model(name, [at[c] for c in cols]) for name, cols in families.items()], classes, leave_out=True, fill=_fills(_median_table(rows, group, features), features))
    scored = lg.predict(base, fits, ["g", "y"], classes)
    prior = m.prior_baselines(rows, group, label, list(range(classes)))
    flat = rows.select(F.col(group).alias("g"), F.col(label).cast("int").alias("y")).join(prior.withColumnRenamed("fold", "g"), "g")
    hard = flat.select("g", "y", F.lit("majority").alias("model"), *[(F.col("majority") == i).cast("double").alias(f"p{i}") for i in range(classes)])
    soft = flat.select("g", "y", F.lit("prevalence").alias("model"), *PROBS(classes))
    every = stack([scored.select("g", "y", "model", *PROBS(classes)), hard, soft]).withColumnRenamed("g", "fold")
    bundle = m.metric_bundle(every, "y", PROBS(classes), [["model", "fold"], ["model"]])
    return covered(bundle, rows, group, ["majority", "prevalence", *families], fits)


def covered(bundle: DataFrame, rows: DataFrame, group: str, models: Sequence[str], fits: DataFrame | None = None) -> DataFrame:
    """Every model and fold (and model, pooled) with its metrics, whether all its rows were scored exactly once, and how its fits ended."""
    sizes = rows.groupBy(F.col(group).alias("fold")).agg(F.count(F.lit(1)).alias("expected"))
    total = rows.agg(F.count(F.lit(1)).alias("expected")).select(F.lit(None).cast(rows.schema[group].dataType).alias("fold"), "expected")
    every = sizes.unionByName(total).withColumn("model", F.explode(F.array(*[F.lit(x) for x in models])))
    b = bundle.select(F.col("model").alias("__m"), F.col("fold").alias("__f"), "n", *m.METRICS)
    out = every.join(b, (F.col("model") == F.col("__m")) & F.col("fold").eqNullSafe(F.col("__f")), "left")
    out = out.select("fold", "model", F.coalesce("n", F.lit(0)).cast("long").alias("n"), *m.METRICS, (F.coalesce("n", F.lit(0)) == F.col("expected")).alias("covered"))
    if fits is None:
        return out
    pooled = fits.groupBy("model").agg(F.min("converged").alias("converged"), F.max("gradient").alias("gradient")).select("model", F.lit(None).cast("string").alias("gs"), "converged", "gradient")
    ends = fits.select("model", "gs", "converged", "gradient").unionByName(pooled).select(F.col("model").alias("__m"), "gs", "converged", "gradient")
    return out.join(ends, (F.col("model") == F.col("__m")) & F.col("fold").cast("string").eqNullSafe(F.col("gs")), "left").drop("__m", "gs")


# ---- invariance and personalisation --------------------------------------------------------------


def _fold_means(rows: DataFrame, group: str, features: Sequence[str], medians: DataFrame | None = None) -> DataFrame:
    """Population mean per fold over its imputed training rows: total minus own group, the missing ones at the fold's median."""
    facts = lambda t: [F.count(F.lit(1)).alias(f"{t}n"), *[a for f in features for a in (F.sum(finite_double(f)).alias(f"{t}s_{f}"), F.count(finite_double(f)).alias(f"{t}c_{f}"))]]
    own = rows.groupBy(group).agg(*facts("o"))
    j = own.crossJoin(F.broadcast(rows.agg(*facts("t"))))
    if medians is not None:
        j = j.join(medians, F.col(group) == F.col("__fold"), "left")
    size = F.col("tn") - F.col("on")

    def mean(f: str) -> Column:
        total = F.coalesce(F.col(f"ts_{f}"), F.lit(0.0)) - F.coalesce(F.col(f"os_{f}"), F.lit(0.0))
        gaps = size - (F.col(f"tc_{f}") - F.col(f"oc_{f}"))
        return total + gaps * F.coalesce(F.col(f"md_{f}"), F.lit(0.0)) if medians is not None else total

    return j.select(group, *[(mean(f) / F.nullif(size, F.lit(0))).alias(f"pm_{f}") for f in features])


def variance_ratios(rows: DataFrame, group: str, features: Sequence[str], tau: float, medians: DataFrame | None = None) -> DataFrame:
    """Between-group share of the variance of every fold's imputed training rows, raw, group-centred and shrunk: (fold, model, ratio).

    In closed form from one row of (n, mean, variance) per group: a fold meets the moments of the other groups, never their rows. Centring
    by a group's mean leaves no variance between groups; the shrunk centre leaves tau / (n + tau) of each group's distance.
    """
    aggs = [a for f in features for a in (F.count(finite_double(f)).alias(f"n_{f}"), F.avg(finite_double(f)).alias(f"m_{f}"), F.var_pop(finite_double(f)).alias(f"v_{f}"))]
    moments = cut_lineage(rows.groupBy(group).agg(F.count(F.lit(1)).alias("__n"), *aggs))
    pairs = meet_all(moments, _folds(rows, group)).where(~F.col("fold").eqNullSafe(F.col(group)))
    if medians is not None:
        pairs = pairs.join(medians, F.col("fold") == F.col("__fold"), "left")
    size = F.col("__n").cast("double")
    filled = []
    for f in features:
        n, mean, v = F.col(f"n_{f}"), F.coalesce(F.col(f"m_{f}"), F.lit(0.0)), F.coalesce(F.col(f"v_{f}"), F.lit(0.0))
        fill = F.coalesce(F.col(f"md_{f}"), F.lit(0.0)) if medians is not None else F.lit(0.0)
        full = (n * mean + (size - n) * fill) / size
        filled += [full.alias(f"u_{f}"), (n * v + n * (mean - full) * (mean - full) + (size - n) * (fill - full) * (fill - full)).alias(f"w_{f}")]
    pairs = cut_lineage(pairs.select("fold", size.alias("n"), (F.lit(float(tau)) / (size + F.lit(float(tau)))).alias("keep"), *filled))
    centres = pairs.groupBy("fold").agg(*[(F.sum(F.col("n") * F.col(f"u_{f}")) / F.sum("n")).alias(f"c_{f}") for f in features])
    j = pairs.join(centres, "fold")
    away = {f: F.col(f"u_{f}") - F.col(f"c_{f}") for f in features}
    sums = [a for f in features for a in (
        F.sum(F.col("n") * away[f] * away[f]).alias(f"raw_{f}"), F.sum(F.col("n") * F.col("keep") * away[f]).alias(f"s1_{f}"),
        F.sum(F.col("n") * F.col("keep") * F.col("keep") * away[f] * away[f]).alias(f"s2_{f}"), F.sum(f"w_{f}").alias(f"within_{f}"))]
    t = j.groupBy("fold").agg(F.sum("n").alias("n"), *sums)

    def ratio(between) -> Column:
        parts = F.array_compact(F.array(*[F.when(between(f) + F.col(f"within_{f}") > 1e-12, between(f) / (between(f) + F.col(f"within_{f}"))) for f in features]))
        return F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)).otherwise(F.lit(0.0))

    shrunk = lambda f: F.greatest(F.lit(0.0), F.col(f"s2_{f}") - F.col(f"s1_{f}") * F.col(f"s1_{f}") / F.col("n"))
    kinds = F.array(*[F.struct(F.lit(name).alias("model"), r.alias("ratio")) for name, r in (("raw", ratio(lambda f: F.col(f"raw_{f}"))), ("centred", ratio(lambda f: F.lit(0.0))), ("shrunk", ratio(shrunk)))])
    return t.select("fold", F.explode(kinds).alias("r")).select("fold", "r.*")


def _variants(features: Sequence[str], tau: float) -> list[lg.Model]:
    """Raw, centred and shrunk population models; the centre of a row's group under a fold is computed inside the task."""
    d = range(len(features))
    return [lg.Model("raw", d), lg.Model("centred", d, tau=0.0), lg.Model("shrunk", d, tau=tau)]


def _named_fits(fits: DataFrame) -> DataFrame:
    """Fits whose group is (model, group), so that a row can name the one model it is for."""
    return fits.withColumn("gs", F.concat_ws("|", "model", "gs"))


def identity_invariance(rows: DataFrame, group: str, label: str, path: str, features: Sequence[str], classes: int, *, repeats: int = 20, seed: int = 20260821, tau: float = 4.0,
                        bootstrap_reps: int = 2000) -> DataFrame:
    """Raw, centred and shrunk population models against pseudo-centred controls, which repeat the centred fit with permuted group labels.

    Report rows: ``metrics`` per model, pooled and per fold; ``pooled_delta`` to raw; ``specificity`` of the true centring among the controls; ``unit_equal``
    fold deltas with resampled intervals; ``variance_ratio`` per fold and their mean; ``fit`` (converged, gradient, steps).
    """
    medians = _median_table(rows, group, features)
    base = rows.select(F.col(group).alias("g"), F.col(label).cast("int").alias("y"), vector(features).alias("x"), F.col(path).alias("path"))
    fits = lg.fit_all(base, _variants(features, tau), classes, leave_out=True, fill=_fills(medians, features))
    pm = _fold_means(rows, group, features, medians)
    test = _imputed(rows, medians, group, features).join(pm, group)
    zero = F.array(*[F.col(f) - F.col(f"pm_{f}") for f in features])
    raw = F.array(*[F.col(f) for f in features])
    tested = materialise(test.select(path, F.col(group).alias("own"), F.col(label).cast("int").alias("y"), raw.alias("raw"), zero.alias("zero")), "tested")

    # Permuted labels within each fold's training pool: rows carry their digests under a block of folds and repeats, and the lanes that fit the controls
    # label and centre them. Rows x folds x repeats are passed over, as the controls are by definition, but never written, joined or shuffled.
    drawn = [lg.Model(f"pseudo_{r}", range(len(features)), permuted=(seed, r)) for r in range(repeats)]
    permuted = lambda lanes, heads: m.pseudo_groups(lanes, seed, ["fold"], F.col("repeat"), "gs", "path", heads=heads)
    controls = lg.fit_all(base, drawn, classes, leave_out=True, fill=_fills(medians, features), path="path", labels=permuted)

    scored = lg.predict(_asked(tested, [("raw", "raw"), ("centred", "zero"), ("shrunk", "zero")]), _named_fits(fits), [path, "own", "y"], classes)
    again = tested.select(path, "own", "y", F.col("own").alias("g"), F.col("zero").alias("x"))
    pscored = materialise(lg.predict(again, controls, [path, "own", "y"], classes), "controls")
    mean = pscored.groupBy(path, "own", "y").agg(*[F.avg(p).alias(p) for p in PROBS(classes)]).withColumn("model", F.lit("pseudo_mean"))
    cols = [F.col("own").alias("fold"), "y", "model", *PROBS(classes)]
    every = stack([scored.select(*cols), pscored.select(*cols), mean.select(*cols)])
    bundle = materialise(m.metric_bundle(every, "y", PROBS(classes), [["model", "fold"], ["model"]]), "bundle")

    pooled, folds = bundle.where("fold IS NULL"), bundle.where("fold IS NOT NULL")
    models = ("centred", "shrunk", "pseudo_mean")
    pairs = [(x, "raw") for x in models]
    parts = [report_rows(bundle, "metrics", ["n", *m.METRICS]), report_rows(deltas(pooled, [], pairs), "pooled_delta", m.METRICS)]
    parts.append(unit_equal_rows(deltas(folds, ["fold"], pairs), "fold", [], reps=bootstrap_reps, seed=seed))
    each = _against(pooled, "raw")
    for model in ("centred", "shrunk"):
        own = each.where(F.col("model").isin(model) | F.col("model").rlike("^pseudo_[0-9]+$")).withColumn("control", F.when(F.col("model") != model, F.col("model")))
        found = m.control_specificity(own.select("metric", "control", "delta"), HIGHER_IS_BETTER)
        values = ("true_delta", "control_mean", "control_min", "control_max", "fraction_as_good")
        long = found.select("metric", F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.col(v).alias("value")) for v in values])).alias("r"))
        parts.append(_named(long.select(F.lit(model).alias("model"), F.lit("raw").alias("baseline"), F.concat_ws(":", "metric", "r.v").alias("metric"), "r.value"), "specificity"))
    ratios = variance_ratios(rows, group, features, tau, medians).withColumn("fold", F.col("fold").cast("string"))
    control = m.between_group_variance_ratio(lg.group_moments(controls, features), "at", features, ["fold", "repeat"], moments=True).select("fold", F.lit("pseudo").alias("model"), "ratio")
    ratios = materialise(ratios.unionByName(control.groupBy("fold", "model").agg(F.avg("ratio").alias("ratio"))), "ratios")
    parts += [report_rows(ratios, "variance_ratio", ["ratio"]), report_rows(ratios.groupBy("model").agg(F.avg("ratio").alias("ratio")), "variance_ratio", ["ratio"])]
    named = controls.withColumns({"model": F.lit("pseudo"), "gs": F.concat_ws("#", "gs", F.substring_index("model", "_", -1))})
    return stack([*parts, fit_rows(fits.unionByName(named))])


def _against(pooled: DataFrame, baseline: str) -> DataFrame:
    """(model, metric, delta) of every model to the baseline; a few rows."""
    long = lambda df, name: df.select("model", F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).alias(name)) for x in m.METRICS])).alias("r")).select("model", "r.*")
    base = long(pooled.where(F.col("model") == baseline), "b").drop("model")
    return long(pooled.where(F.col("model") != baseline), "a").join(base, "metric").select("model", "metric", (F.col("a") - F.col("b")).alias("delta"))


def _asked(rows: DataFrame, variants: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows once for each (model, column): ``x`` is the column, ``g`` names model and group."""
    parts = F.array(*[F.struct(F.lit(model).alias("model"), F.col(column).alias("x")) for model, column in variants])
    out = rows.select("*", F.explode(parts).alias("__a"))
    return out.select("*", F.concat_ws("|", "__a.model", lg.group_text(F.col("own"))).alias("g"), F.col("__a.x").alias("x")).drop("__a")


def personalisation_evaluation(rows: DataFrame, group: str, session: str, label: str, path: str, features: Sequence[str], classes: int, *, budgets: Sequence[int],
                               repeats: int = 20, seed: int = 20260821, tau: float = 4.0, bootstrap_reps: int = 2000) -> DataFrame:
    """Feasible session folds: zero-shot against adapted models per budget, mean probability over repeats.

    Population models are fitted once per group; budgets and repeats only move the centre of the test rows: one table of centred test rows
    (budget, repeat, variant), one scoring pass. Report rows: ``metrics`` pooled and per fold, ``delta`` to the population model and of adaptation
    to the same model without it, both pooled and per fold, ``unit_equal`` deltas with resampled intervals over groups, ``support`` per budget, ``fit``.
    """
    medians = _median_table(rows, group, features)
    base = rows.select(F.col(group).alias("g"), F.col(label).cast("int").alias("y"), vector(features).alias("x"))
    fits = lg.fit_all(base, _variants(features, tau), classes, leave_out=True, fill=_fills(medians, features))
    feasible = m.fold_feasibility(rows, [1], list(budgets), group, session, label).where("primary_feasible").select(group, F.col(session).alias("test_session"), "n_adaptation")
    feasible = cut_lineage(feasible)
    pm = _fold_means(rows, group, features, medians)
    rows = _imputed(rows, medians, group, features)
    adaptation = rows.join(feasible, group).where(F.col(session) != F.col("test_session"))
    n = rows.count()
    sessions = feasible.groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    tasks = tasks_for(rows.sparkSession, n * sessions * repeats)
    order = m.stable_order(adaptation.select(path, group, "test_session", *features), seed, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))), [group], "test_session", path, tasks, digits_for(n))
    means = order.groupBy(group, "test_session", "repeat").agg(*[F.avg(F.when(F.col("rank") <= b, F.col(f))).alias(f"am{b}_{f}") for b in budgets for f in features])
    test = rows.join(feasible, group).where(F.col(session) == F.col("test_session")).join(pm, group)
    raw = F.array(*[F.col(f) for f in features])
    zero = F.array(*[F.col(f) - F.col(f"pm_{f}") for f in features])
    kept = [path, F.col(group).alias("own"), "test_session", F.col(label).cast("int").alias("y")]

    def ways(parts: list[tuple]) -> Column:
        """(name, the population model that scores, budget, x) of a test row."""
        kinds = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(model).alias("use"), F.lit(budget).cast("int").alias("budget"), (F.col("n_adaptation") >= (budget or 0)).alias("ok"), x.alias("x")) for name, model, budget, x in parts])
        return F.explode(F.filter(kinds, lambda w: w["ok"])).alias("w")

    still = test.select(*kept, F.lit(None).cast("int").alias("repeat"), "n_adaptation", ways([("population_raw", "raw", None, raw), ("centred_zero_shot", "centred", None, zero), ("shrinkage_zero_shot", "shrunk", None, zero)]))
    moved = []
    for b in budgets:
        a = b / (b + tau)
        moved.append(("centred_unshrunk", "centred", b, F.array(*[F.col(f) - F.col(f"am{b}_{f}") for f in features])))
        moved.append(("centred_shrinkage", "shrunk", b, F.array(*[F.col(f) - (a * F.col(f"am{b}_{f}") + (1 - a) * F.col(f"pm_{f}")) for f in features])))
    adapted = test.join(means, [group, "test_session"]).select(*kept, "repeat", "n_adaptation", ways(moved))
    asked = still.unionByName(adapted).select(path, "own", "test_session", "y", "repeat", "n_adaptation", F.col("w.name").alias("name"), F.col("w.budget").alias("budget"), F.concat_ws("|", "w.use", lg.group_text(F.col("own"))).alias("g"), F.col("w.x").alias("x"))
    keep = [path, "own", "test_session", "y", "name", "budget", "n_adaptation"]
    scored = lg.predict(asked, _named_fits(fits), keep, classes)
    mean = scored.groupBy(*keep).agg(*[F.avg(p).alias(p) for p in PROBS(classes)])
    every = mean.withColumn("budget", F.explode(F.when(F.col("budget").isNull(), F.filter(F.array(*[F.lit(b) for b in budgets]), lambda b: b <= F.col("n_adaptation"))).otherwise(F.array("budget"))))
    every = every.withColumnRenamed("own", "fold").withColumnRenamed("name", "model")
    bundle = materialise(m.metric_bundle(every, "y", PROBS(classes), [["model", "budget", "fold", "test_session"], ["model", "budget"]]), "bundle")

    against = [(x, "population_raw") for x in ("centred_zero_shot", "shrinkage_zero_shot", "centred_unshrunk", "centred_shrinkage")]
    against += [("centred_unshrunk", "centred_zero_shot"), ("centred_shrinkage", "shrinkage_zero_shot")]
    pooled, folds = bundle.where("fold IS NULL"), bundle.where("fold IS NOT NULL")
    moves = materialise(deltas(folds, ["budget", "fold", "test_session"], against), "deltas")
    support = feasible.select(F.explode(F.array(*[F.struct(F.lit(b).alias("budget"), (F.col("n_adaptation") >= b).cast("long").alias("ok")) for b in budgets])).alias("s")).groupBy("s.budget").agg(F.sum("s.ok").alias("supported_folds"), F.count(F.lit(1)).alias("primary_folds"))
    return stack([report_rows(bundle, "metrics", ["n", *m.METRICS]), report_rows(deltas(pooled, ["budget"], against), "delta", m.METRICS), report_rows(moves, "delta", m.METRICS),
                  unit_equal_rows(moves, "fold", ["budget"], reps=bootstrap_reps, seed=seed), report_rows(support, "support", ["supported_folds", "primary_folds"]), fit_rows(fits)])


# ---- chronological evaluation --------------------------------------------------------------------


def chronological_evaluation(rows: DataFrame, household: str, time: str, tie: str, label: str, families: dict[str, tuple[Sequence[str], Sequence[str]]], fraction: float = 0.67) -> DataFrame:
    """Per household: Laplace prevalence and one logistic per feature set on the same later test rows.

    A training part with one class yields status ``unsupported``. Families: name -> (categorical, numeric). Categories are indices into a vocabulary table;
    a household's fits have columns for the values of its own training rows (any other would have weight 0).
    """
    cats = sorted({c for c, _ in families.values() for c in c})
    nums = sorted({c for _, n in families.values() for c in n})
    # Feature rows are costly and feed the split, the vocabulary and every pass; they are written once.
    rows = cut_lineage(rows.select(*dict.fromkeys([household, time, tie, label, *cats, *nums])))
    split = m.chronological_split(rows, [household], time, tie, label, fraction).withColumn("y", F.col(label).cast("int"))
    split = cut_lineage(category_indices(split, cats, vocabulary(split.where("part = 'train'"), cats), "c"))
    train, test = split.where("part = 'train'"), split.where("part = 'test'")
    x = F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in nums]) if nums else F.array().cast("array<double>")
    shape = lambda df: df.select(F.col(household).alias("g"), "y", x.alias("x"), "c")
    models = [lg.Model(name, [nums.index(n) for n in n_], [cats.index(c) for c in c_]) for name, (c_, n_) in families.items()]
    fits = lg.fit_all(shape(train), models, 2, leave_out=False, centre=False, penalise_intercept=True)
    scored = lg.predict(shape(test), fits, ["g", "y"], 2).select("g", "y", "model", F.col("p1").alias("p"))
    prior = m.laplace_prevalence(train, [household], "y").withColumnRenamed(household, "g")
    base = test.select(F.col(household).alias("g"), "y").join(prior, "g").select("g", "y", F.lit("prevalence").alias("model"), F.col("prevalence").alias("p"))
    bundle = m.binary_bundle(scored.unionByName(base), "y", "p", [["model", "g"]])
    status = split.groupBy(F.col(household).alias("g")).agg(F.count_distinct(F.when(F.col("part") == "train", F.col("y"))).alias("c"), F.max("part").alias("part"))
    every = status.select("g", "c", "part", F.explode(F.array(*[F.lit(n) for n in ["prevalence", *families]])).alias("model"))
    state = F.when(F.col("part") == "unsupported", "too_few_labelled_rows").when((F.col("model") != "prevalence") & (F.col("c") < 2), "unsupported").otherwise("ok")
    ends = fits.select(F.col("model").alias("__m"), "gs", "converged", "gradient")
    out = every.withColumn("status", state).drop("c", "part").join(bundle, ["g", "model"], "left")
    return out.join(ends, (F.col("model") == F.col("__m")) & (lg.group_text(F.col("g")) == F.col("gs")), "left").drop("__m", "gs").withColumnRenamed("g", household)
