"""Prediction quality, resampling and grouped statistics.

Multiclass rows are wide: ``y`` plus one probability column per class. Binary rows hold ``y`` and ``p``.
Per-fold and pooled values come from one pass with grouping sets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelens.functions import finite_double
from evidencelens.operators.permutation import packed_keys
from evidencelens.operators.quantiles import exact_quantiles
from evidencelens.operators.segments import hash_ranked, running

# Bin edges of ten equal bins in floating point (three differ from i/10).
LINSPACE_EDGES = (0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0)
MULTICLASS_CLIP = 2.220446049250313e-16
BINARY_CLIP = 1e-9


def argmax_label(p_cols: Sequence[str]) -> Column:
    """Index of the highest probability; ties go to the first class."""
    best = F.greatest(*p_cols)
    out = F.lit(len(p_cols) - 1)
    for i in reversed(range(len(p_cols) - 1)):
        out = F.when(F.col(p_cols[i]) == best, F.lit(i)).otherwise(out)
    return out


def grouped(df: DataFrame, sets: Sequence[Sequence[str]], aggs: Sequence[Column], extra: Sequence[str] = ()) -> DataFrame:
    """``GROUPING SETS``; ``extra`` columns join every set. Missing keys are NULL."""
    keys = sorted({k for s in sets for k in s})
    full = [[*s, *extra] for s in sets]
    return df.groupingSets([[F.col(c) for c in s] for s in full], *[F.col(c) for c in [*keys, *extra]]).agg(*aggs)


def _bin(conf: Column, edges: Sequence[float]) -> Column:
    out = F.lit(len(edges) - 2)
    for i in reversed(range(len(edges) - 2)):
        out = F.when(conf < F.lit(edges[i + 1]), F.lit(i)).otherwise(out)
    return out


def metric_bundle(df: DataFrame, y: str, p_cols: Sequence[str], sets: Sequence[Sequence[str]], clip: float = MULTICLASS_CLIP) -> DataFrame:
    """Balanced accuracy, macro F1, log loss, Brier and top-label ECE per grouping set.

    One aggregation to (set, label, bin) cells holding counts and sums; every metric is read off these
    few cells, so rows are shuffled once and only as partial sums.
    """
    k = len(p_cols)
    keys = sorted({c for s in sets for c in s})
    p_y = F.element_at(F.array(*p_cols), F.col(y).cast("int") + 1)
    conf = F.greatest(*p_cols)
    brier = sum(((F.col(c) - F.when(F.col(y) == i, 1.0).otherwise(0.0)) * (F.col(c) - F.when(F.col(y) == i, 1.0).otherwise(0.0))
                 for i, c in enumerate(p_cols)), F.lit(0.0))
    row = df.select(
        *keys, F.col(y).cast("int").alias("__y"), argmax_label(p_cols).alias("__hat"), _bin(conf, LINSPACE_EDGES).alias("__bin"),
        (-F.ln(F.least(F.lit(1.0 - clip), F.greatest(F.lit(clip), p_y)))).alias("__ll"), brier.alias("__br"), conf.alias("__cf"))
    cells = grouped(row, sets, [F.count(F.lit(1)).alias("n"), F.sum("__ll").alias("ll"), F.sum("__br").alias("br"), F.sum("__cf").alias("cf")],
                    ["__y", "__hat", "__bin"])
    hit = F.when(F.col("__y") == F.col("__hat"), F.col("n")).otherwise(F.lit(0))
    aggs = [F.sum("n").alias("n"), F.sum("ll").alias("ll"), F.sum("br").alias("br")]
    for i in range(k):
        aggs += [F.sum(F.when(F.col("__y") == i, F.col("n")).otherwise(0)).alias(f"pos{i}"),
                 F.sum(F.when(F.col("__hat") == i, F.col("n")).otherwise(0)).alias(f"hat{i}"),
                 F.sum(F.when(F.col("__y") == i, hit).otherwise(0)).alias(f"tp{i}")]
    for b in range(10):
        inside = F.col("__bin") == b
        aggs.append(F.abs(F.coalesce(F.sum(F.when(inside, hit)), F.lit(0)) - F.coalesce(F.sum(F.when(inside, F.col("cf"))), F.lit(0.0))).alias(f"gap{b}"))
    g = cells.groupBy(*keys).agg(*aggs)
    add = lambda cols: sum(cols, F.lit(0.0))
    recall = [F.when(F.col(f"pos{i}") > 0, F.col(f"tp{i}") / F.col(f"pos{i}")).otherwise(0.0) for i in range(k)]
    present = add([(F.col(f"pos{i}") > 0).cast("double") for i in range(k)])
    seen = add([((F.col(f"pos{i}") + F.col(f"hat{i}")) > 0).cast("double") for i in range(k)])
    f1 = [F.when((F.col(f"pos{i}") + F.col(f"hat{i}")) > 0, 2.0 * F.col(f"tp{i}") / (F.col(f"pos{i}") + F.col(f"hat{i}"))).otherwise(0.0) for i in range(k)]
    return g.select(*keys, "n", (add(recall) / present).alias("balanced_accuracy"), (add(f1) / seen).alias("macro_f1"),
                    (F.col("ll") / F.col("n")).alias("log_loss"), (F.col("br") / F.col("n")).alias("brier"),
                    (add([F.col(f"gap{b}") for b in range(10)]) / F.col("n")).alias("ece"))


def binary_bundle(df: DataFrame, y: str, p: str, sets: Sequence[Sequence[str]], threshold: float = 0.5) -> DataFrame:
    """Binary variant: F1 over {0, 1} always, probabilities clipped at 1e-9, ECE on p(1)."""
    keys = sorted({c for s in sets for c in s})
    clipped = F.least(F.lit(1.0 - BINARY_CLIP), F.greatest(F.lit(BINARY_CLIP), F.col(p)))
    edges = [i / 10 for i in range(11)]
    row = df.select(*keys, F.col(y).cast("int").alias("__y"), (F.col(p) >= threshold).cast("int").alias("__hat"), _bin(F.col(p), edges).alias("__bin"),
                    (-F.when(F.col(y) == 1, F.ln(clipped)).otherwise(F.ln(1.0 - clipped))).alias("__ll"),
                    ((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("__br"), F.col(p).alias("__cf"))
    cells = grouped(row, sets, [F.count(F.lit(1)).alias("n"), F.sum("__ll").alias("ll"), F.sum("__br").alias("br"), F.sum("__cf").alias("cf")], ["__y", "__hat", "__bin"])
    n = F.col("n")
    aggs = [F.sum("n").alias("n"), F.sum("ll").alias("ll"), F.sum("br").alias("br")]
    for i in (0, 1):
        aggs += [F.sum(F.when(F.col("__y") == i, n).otherwise(0)).alias(f"pos{i}"), F.sum(F.when(F.col("__hat") == i, n).otherwise(0)).alias(f"hat{i}"),
                 F.sum(F.when((F.col("__y") == i) & (F.col("__hat") == i), n).otherwise(0)).alias(f"tp{i}")]
    for b in range(10):
        inside = F.col("__bin") == b
        aggs.append(F.abs(F.sum(F.when(inside, n * F.col("__y")).otherwise(0)) - F.sum(F.when(inside, F.col("cf")).otherwise(0.0))).alias(f"gap{b}"))
    g = cells.groupBy(*keys).agg(*aggs)
    rec = [F.when(F.col(f"pos{i}") > 0, F.col(f"tp{i}") / F.col(f"pos{i}")).otherwise(0.0) for i in (0, 1)]
    f1 = [F.when((F.col(f"pos{i}") + F.col(f"hat{i}")) > 0, 2.0 * F.col(f"tp{i}") / (F.col(f"pos{i}") + F.col(f"hat{i}"))).otherwise(0.0) for i in (0, 1)]
    present = (F.col("pos0") > 0).cast("double") + (F.col("pos1") > 0).cast("double")
    return g.select(*keys, "n", ((rec[0] + rec[1]) / present).alias("balanced_accuracy"), ((f1[0] + f1[1]) / 2.0).alias("macro_f1"),
                    (F.col("ll") / n).alias("log_loss"), (F.col("br") / n).alias("brier"), (sum((F.col(f"gap{b}") for b in range(10)), F.lit(0.0)) / n).alias("ece"))


METRICS = ("balanced_accuracy", "macro_f1", "log_loss", "brier", "ece")


def metric_delta(bundle: DataFrame, keys: Sequence[str], model: str, baseline: str) -> DataFrame:
    """Every other model minus the baseline, per key; the baseline row rides along as a struct (few rows)."""
    pick = F.max(F.when(F.col(model) == baseline, F.struct(*METRICS))).over(Window.partitionBy(*keys))
    return bundle.withColumn("__b", pick).where(F.col(model) != baseline).select(*keys, model, *[(F.col(m) - F.col(f"__b.{m}")).alias(m) for m in METRICS])


def align_probabilities(df: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Missing class columns become 0."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in classes})


def align_long_probabilities(df: DataFrame, keys: Sequence[str], classes: Sequence, class_col: str = "class", p: str = "p") -> DataFrame:
    """Long ``(keys, class, p)`` to one value per declared class, 0 where absent; one partial aggregate."""
    cols = [F.coalesce(F.max(F.when(F.col(class_col) == c, F.col(p))), F.lit(0.0)).alias(f"p{i}") for i, c in enumerate(classes)]
    return df.groupBy(*keys).agg(*cols)


def risk_coverage(df: DataFrame, keys: Sequence[str], confidence: str, correct: str, steps: int = 10_000) -> DataFrame:
    """Accuracy against the fraction retained when low-confidence rows abstain.

    Equal confidences are reduced first; segments are confidence blocks, so no key is one task.
    """
    tied = df.groupBy(*keys, F.col(confidence).alias("conf")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(correct).cast("long")).alias("c"))
    # Descending confidence: negate so that segments grow along the order.
    ran = running(tied, keys, F.floor(-F.col("conf") * steps).cast("long"), [-F.col("conf")],
                  sums={"kept": F.col("n"), "right": F.col("c")})
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    return ran.join(total, list(keys)).select(*keys, F.col("conf").alias("threshold"), F.col("kept").alias("retained"),
                                              (F.col("kept") / F.col("total")).alias("coverage"), (F.col("right") / F.col("kept")).alias("accuracy"))


def region_coverage(df: DataFrame, keys: Sequence[str], chi2: float) -> DataFrame:
    """Share of reference points inside the declared ellipse: ``dx, dy`` residuals, ``sxx, sxy, syy`` covariance."""
    det = F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy")
    d2 = (F.col("syy") * F.col("dx") * F.col("dx") - 2 * F.col("sxy") * F.col("dx") * F.col("dy") + F.col("sxx") * F.col("dy") * F.col("dy")) / det
    return df.groupBy(*keys).agg(F.avg((F.when(det > 0, d2) <= chi2).cast("double")).alias("coverage"), F.count(F.when(det > 0, F.lit(1))).alias("n"))


def firm_decision_metrics(df: DataFrame, keys: Sequence[str], decision: str, truth: str, uncertain: str = "uncertain") -> DataFrame:
    firm = F.col(decision) != uncertain
    return df.groupBy(*keys).agg(F.avg(firm.cast("double")).alias("firm_coverage"),
                                 F.avg(F.when(firm, (F.col(decision) == F.col(truth)).cast("double"))).alias("firm_accuracy"),
                                 F.avg((~firm).cast("double")).alias("uncertain_rate"))


# ---- summaries -----------------------------------------------------------------------------------


def finite_summary(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Mean, population std, median, min and max over finite values, one row per key and column."""
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), finite_double(c).alias("v")) for c in cols])
    long = df.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")
    k = [*keys, "feature"]
    basic = long.groupBy(*k).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    return basic.join(exact_quantiles(long, k, "v", {"median": (0.5, "linear")}), k, "left")


def frame_track_summary(frames: DataFrame, clips: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Duration, voiced fraction, mean voiced probability, F0 median and range over voiced frames."""
    voiced_f0 = F.when(F.col("voiced"), finite_double("f0"))
    g = frames.groupBy(*keys).agg(F.avg(F.col("voiced").cast("double")).alias("voiced_fraction"), F.avg(finite_double("voiced_prob")).alias("voiced_prob_mean"),
                                  (F.max(voiced_f0) - F.min(voiced_f0)).alias("f0_range"))
    med = exact_quantiles(frames.withColumn("__f0", voiced_f0), keys, "__f0", {"f0_median": (0.5, "linear")})
    d = clips.select(*keys, (F.col("n_samples") / F.col("sample_rate")).alias("duration_s"))
    return d.join(g, list(keys), "left").join(med, list(keys), "left")


def feature_sets(columns: Sequence[str], meta: Sequence[str], duration_f0: Sequence[str]) -> dict[str, list[str]]:
    """Column families by name."""
    numeric = [c for c in columns if c not in meta and c != "sample_rate_hz"]
    mfcc = [c for c in numeric if c.startswith("mfcc_")]
    interpretable = [c for c in numeric if not c.startswith("mfcc_")]
    return {"duration_f0": [c for c in duration_f0 if c in columns], "interpretable": interpretable, "mfcc": mfcc,
            "all_acoustic": sorted({*interpretable, *mfcc})}


def between_group_variance_ratio(df: DataFrame, group: str, features: Sequence[str], keys: Sequence[str] = (), moments: bool = False) -> DataFrame:
    """Mean over features of SSB/SST; features with SST <= 1e-12 are left out, 0 if none remains.

    ``moments``: ``df`` holds a row per key and group instead, with rows, mean and variance of every feature as n_, m_ and v_.
    """
    aggs = [a for f in features for a in (F.count(f).alias(f"n_{f}"), F.avg(f).alias(f"m_{f}"), F.var_pop(f).alias(f"v_{f}"))]
    g = df if moments else df.groupBy(*keys, group).agg(*aggs)
    tot = []
    for f in features:
        n, m, v = F.col(f"n_{f}"), F.col(f"m_{f}"), F.col(f"v_{f}")
        tot += [F.sum(n).alias(f"n_{f}"), (F.sum(n * m) / F.sum(n)).alias(f"m_{f}"), F.sum(n * m * m).alias(f"q_{f}"), F.sum(n * v).alias(f"w_{f}")]
    t = g.groupBy(*keys).agg(*tot)
    ratios = []
    for f in features:
        ssb = F.greatest(F.lit(0.0), F.col(f"q_{f}") - F.col(f"n_{f}") * F.col(f"m_{f}") * F.col(f"m_{f}"))
        sst = ssb + F.col(f"w_{f}")
        ratios.append(F.when(sst > 1e-12, ssb / sst))
    kept = F.array_compact(F.array(*ratios))
    return t.select(*keys, F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept)).otherwise(F.lit(0.0)).alias("ratio"))


def residualise(df: DataFrame, group: str, features: Sequence[str], tau: float | None = None) -> DataFrame:
    """x minus the group mean, or minus the shrunk centre a*group + (1-a)*population with a = n/(n+tau)."""
    means = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"), *[F.avg(f).alias(f"__g_{f}") for f in features])
    if tau is not None:
        pop = df.agg(*[F.avg(f).alias(f"__p_{f}") for f in features])
        a = F.col("__n") / (F.col("__n") + F.lit(float(tau)))
        means = means.crossJoin(F.broadcast(pop)).select(group, *[(a * F.col(f"__g_{f}") + (1 - a) * F.col(f"__p_{f}")).alias(f"__g_{f}") for f in features])
    j = df.join(means, group)
    return j.select(*[c for c in df.columns if c not in features], *[(F.col(f) - F.col(f"__g_{f}")).alias(f) for f in features])


def adapt_centre(test: DataFrame, adaptation: DataFrame, population: DataFrame, keys: Sequence[str], features: Sequence[str], budget: int, tau: float | None) -> DataFrame:
    """Test rows minus the adaptation mean, or minus the centre shrunk by a = b/(b+tau)."""
    m = adaptation.groupBy(*keys).agg(*[F.avg(f).alias(f"__a_{f}") for f in features])
    j = test.join(m, list(keys))
    if tau is None:
        return j.select(*[c for c in test.columns if c not in features], *[(F.col(f) - F.col(f"__a_{f}")).alias(f) for f in features])
    a = budget / (budget + tau)
    p = population.groupBy(*keys).agg(*[F.avg(f).alias(f"__p_{f}") for f in features])
    j = j.join(p, list(keys))
    return j.select(*[c for c in test.columns if c not in features], *[(F.col(f) - (a * F.col(f"__a_{f}") + (1 - a) * F.col(f"__p_{f}"))).alias(f) for f in features])


def stable_order(rows: DataFrame, seed: int, repeat: Column, group: Sequence[str], session: str, path: str, tasks: int | None = None, digits: int = 3) -> DataFrame:
    """Rank within (repeat, group, session) by SHA-256; the first b rows are the budget b. Labels unused."""
    r = rows.withColumn("repeat", repeat)
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("repeat").cast("string"), *[F.col(c).cast("string") for c in (*group, session, path)]), 256)
    return hash_ranked(r, ["repeat", *group, session], digest, [path], "rank", digits, tasks)


#: Ranks of a block in which rows meet the groups whose slots lie there.
SLOT_BLOCK = 256


def pseudo_groups(rows: DataFrame, seed: int, fold: Sequence[str], repeat: Column, group: str, path: str, keep: Sequence[str] = (), tasks: int | None = None,
                  digits: int = 3, heads: Sequence[str] | None = None) -> DataFrame:
    """Group labels permuted within a fold, keeping the size of every group: fold, repeat, path, true_group, ``keep``, pseudo_group.

    Rows get a hash rank. The slots are the groups in order, each as long as its rows: a group's first and last slot follow from the sizes alone,
    and a row takes the group whose slots hold its rank, found by block of ranks. ``tasks``: over how many tasks the rows are dealt; ``digits``: of
    the digest that make a segment.

    ``heads``: the beginnings of the digests' texts (``permutation.head``) of given folds and repeats. Then every row comes back once and whole, with
    ``keys``: the first bytes of its digest under each, from which, and the sizes of the groups, ``permutation`` tells the same labels.
    """
    if heads is not None:
        return rows.withColumn("keys", packed_keys(heads, F.col(path)))
    base = rows.select(*fold, path, group, *keep).withColumn("repeat", repeat)
    parts = lambda *c: F.concat_ws("|", F.lit(str(seed)), *[F.col(x).cast("string") for x in c])
    keys = [*fold, "repeat"]
    block = lambda rank: F.floor((rank - 1) / SLOT_BLOCK).cast("long")
    ranked_rows = hash_ranked(base, keys, F.sha2(parts(*fold, "repeat", path), 256), [path], "__rank", digits, tasks)
    ranked_rows = ranked_rows.select(*keys, path, F.col(group).alias("true_group"), *keep, "__rank", block(F.col("__rank")).alias("__block"))
    sizes = base.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("__n"))
    last = F.sum("__n").over(Window.partitionBy(*keys).orderBy(group).rowsBetween(Window.unboundedPreceding, 0))  # one row a group
    slots = sizes.select(*keys, F.col(group).alias("pseudo_group"), (last - F.col("__n") + 1).alias("__first"), last.alias("__last"))
    slots = slots.withColumn("__block", F.explode(F.sequence(block(F.col("__first")), block(F.col("__last")))))
    dealt = ranked_rows.repartition(tasks, *keys, "__block") if tasks else ranked_rows
    return dealt.join(slots, [*keys, "__block"]).where(F.col("__rank").between(F.col("__first"), F.col("__last"))).drop("__rank", "__block", "__first", "__last")


def two_level_mean(df: DataFrame, unit: str, sub: str, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean within unit over folds, then equal weight across units: mean and median."""
    per = df.groupBy(*keys, unit).agg(*[F.avg(v).alias(v) for v in values])
    rows = F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).alias("value")) for v in values])
    long = per.select(*keys, unit, F.explode(rows).alias("r")).select(*keys, unit, "r.*")
    k = [*keys, "metric"]
    mean = long.groupBy(*k).agg(F.avg("value").alias("mean"), F.count("value").alias("units"))
    return mean.join(exact_quantiles(long, k, "value", {"median": (0.5, "linear")}), k)


def bootstrap_ci(units: DataFrame, value: str, unit: str, reps: int, seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """Mean per resample of units with replacement; 2.5 and 97.5 linear percentiles.

    ``units`` has one row per unit. Draw ``i`` of repetition ``r`` takes the unit at
    ``md5(seed/r/i)[:8] mod n``. Each unit emits its own repetitions, and draws meet units on their rank.
    """
    keys = list(keys)
    if reps == 0:
        nothing = F.lit(None).cast("double")
        return units.groupBy(*keys).agg(F.avg(value).alias("mean")).withColumns({"lo": nothing, "hi": nothing})
    spark_n = units.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    r = hash_ranked(units, keys, F.sha2(F.col(unit).cast("string"), 256), [unit], "__rank") if keys else hash_ranked(
        units.withColumn("__k", F.lit(0)), ["__k"], F.sha2(F.col(unit).cast("string"), 256), [unit], "__rank").drop("__k")
    r = r.select(*keys, (F.col("__rank") - 1).alias("i"), F.col(value).alias("v"))
    rn = r.join(F.broadcast(spark_n.select(*keys, "n")) if not keys else spark_n.select(*keys, "n"), keys) if keys else r.crossJoin(F.broadcast(spark_n.select("n")))
    draws = rn.select(*keys, "n", "i", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    pick = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("rep").cast("string"), F.col("i").cast("string"))), 1, 8), 16, 10).cast("long") % F.col("n")
    draws = draws.withColumn("i", pick).groupBy(*keys, "rep", "i").agg(F.count(F.lit(1)).alias("times"))
    means = draws.join(r, [*keys, "i"]).groupBy(*keys, "rep").agg((F.sum(F.col("v") * F.col("times")) / F.sum("times")).alias("m"))
    q = exact_quantiles(means, keys, "m", {"lo": (0.025, "linear"), "hi": (0.975, "linear")})
    return spark_n.select(*keys, "mean").join(q, keys) if keys else spark_n.select("mean").crossJoin(F.broadcast(q))


#: Cumulative shares of a Poisson(1) count: 0, 1, .. 11 draws of a unit.
POISSON = tuple(sum(math.exp(-1) / math.factorial(j) for j in range(i + 1)) for i in range(12))


def poisson_ci(units: DataFrame, value: str, unit: str, reps: int, seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """keys, mean, lo, hi, units: the mean over units and the 2.5 and 97.5 linear percentiles of its resampled values, in one pass.

    Repetition ``r`` counts a unit Poisson(1) times, by where md5(seed/r/unit)[:8] / 2^32 falls; its mean is weighted by these counts. A task keeps
    one pair of sums per key and repetition, so what is shuffled does not grow with the units. A repetition without a draw is left out.
    """
    import hashlib
    import pickle

    import numpy as np
    import pyarrow as pa

    keys = list(keys)
    kinds = [(k, units.schema[k].dataType.simpleString()) for k in keys]
    rows = units.where(F.col(value).isNotNull()).select(*keys, F.col(unit).cast("string").alias("__unit"), F.col(value).cast("double").alias("__v"))
    width, steps = len(keys), np.array(POISSON)
    names = [*keys, "__s"]

    def counts(name: str) -> np.ndarray:
        drawn = [int(hashlib.md5(f"{seed}/{r}/{name}".encode()).hexdigest()[:8], 16) for r in range(reps)]
        return np.searchsorted(steps, np.array(drawn) / 2.0**32, side="right").astype(float)

    def packed(held: dict, schema) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in held], schema.field(i).type) for i in range(width)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([pickle.dumps(s, 5) for s in held.values()], pa.binary())], names)

    def partial(batches):
        held: dict = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            for *key, name, v in zip(*(c.to_pylist() for c in batch.columns)):
                n = counts(name or "")
                new = np.concatenate([n, n * v, [1.0, v]])
                key = tuple(key)
                held[key] = held[key] + new if key in held else new
        if held:
            yield packed(held, schema)

    def total(batches):
        held: dict = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            for *key, s in zip(*(c.to_pylist() for c in batch.columns)):
                key, new = tuple(key), pickle.loads(s)
                held[key] = held[key] + new if key in held else new
        if held:
            out = []
            for key, s in held.items():
                n, nv = s[:reps], s[reps : 2 * reps]
                means = nv[n > 0] / n[n > 0]
                lo, hi = np.quantile(means, [0.025, 0.975]) if len(means) else (None, None)
                out.append((*key, s[-1] / s[-2], lo, hi, int(s[-2])))
            types = [schema.field(i).type for i in range(width)] + [pa.float64()] * 3 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], [*keys, "mean", "lo", "hi", "units"])

    columns = "".join(f"`{k}` {t}, " for k, t in kinds)
    parts = rows.mapInArrow(partial, f"{columns}__s binary")
    met = parts.repartition(*keys) if keys else parts.repartition(1)
    return met.sortWithinPartitions(*keys, "__s").mapInArrow(total, f"{columns}mean double, lo double, hi double, units long")


def control_specificity(deltas: DataFrame, higher_is_better: dict[str, bool]) -> DataFrame:
    """Per metric: true delta against the control deltas. Columns ``metric, control (NULL = true), delta``."""
    true = deltas.where("control IS NULL").select("metric", F.col("delta").alias("true_delta"))
    better = F.create_map(*[F.lit(x) for kv in higher_is_better.items() for x in kv])
    j = deltas.where("control IS NOT NULL").join(F.broadcast(true), "metric").withColumn("__up", better[F.col("metric")])
    as_good = F.when(F.col("__up"), F.col("delta") >= F.col("true_delta")).otherwise(F.col("delta") <= F.col("true_delta"))
    return j.groupBy("metric").agg(F.max("true_delta").alias("true_delta"), F.avg("delta").alias("control_mean"), F.min("delta").alias("control_min"),
                                   F.max("delta").alias("control_max"), F.avg(as_good.cast("double")).alias("fraction_as_good"))


# ---- folds ---------------------------------------------------------------------------------------


def fold_feasibility(manifest: DataFrame, labelled: Sequence[int], unlabelled: Sequence[int], group: str = "group_id", session: str = "session",
                     context: str = "context") -> DataFrame:
    """Group x held-out session: what the other sessions of the group can support.

    Counts per (group, session, context) are aggregated first; the arrays below hold contexts, not rows.
    """
    cell = manifest.groupBy(group, session, context).agg(F.count(F.lit(1)).alias("n"))
    by_ctx = cell.groupBy(group, context).agg(F.sum("n").alias("total"))
    cell = cell.join(by_ctx, [group, context])
    held = cell.groupBy(group, session).agg(
        F.sum("n").alias("n_test"), F.array_sort(F.collect_list(context)).alias("test_contexts"),
        F.min(F.col("total") - F.col("n")).alias("min_support"))
    # Adaptation contexts of (group, session): contexts of the group whose total exceeds the session count.
    alls = by_ctx.groupBy(group).agg(F.collect_list(F.struct(F.col(context).alias("c"), F.col("total").alias("t"))).alias("ctx"),
                                     F.sum("total").alias("group_total"))
    own = cell.groupBy(group, session).agg(F.map_from_entries(F.collect_list(F.struct(context, "n"))).alias("own"))
    sessions = cell.groupBy(group).agg(F.count_distinct(session).alias("n_sessions"))
    j = held.join(own, [group, session]).join(alls, group).join(sessions, group)
    adapt = F.array_sort(F.transform(F.filter("ctx", lambda x: x["t"] > F.coalesce(F.try_element_at("own", x["c"]), F.lit(0))), lambda x: x["c"]))
    j = j.withColumn("adaptation_contexts", adapt)
    shared = F.array_intersect("test_contexts", "adaptation_contexts")
    n_adapt = F.col("group_total") - F.col("n_test")
    supported = F.size(F.array_except("test_contexts", "adaptation_contexts")) == 0
    multi = F.col("n_sessions") > 1
    best = F.when(supported, F.col("min_support")).otherwise(F.lit(0)).cast("long")
    two = F.size("test_contexts") >= 2
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    fold = {
        "n_adaptation": n_adapt.cast("long"), "adaptation_contexts": text("adaptation_contexts"), "shared_contexts": text(F.array_sort(shared)),
        "two_test_contexts": two, "all_supported": supported, "primary_feasible": two & supported, "max_labelled_budget": best,
        **{f"labelled_{b}": best >= b for b in labelled}, **{f"unlabelled_{b}": n_adapt >= b for b in unlabelled},
    }
    # A group with one session has no fold: its row only carries the reason.
    return j.select(group, session, "n_test", text("test_contexts").alias("test_contexts"), *[F.when(multi, c).alias(k) for k, c in fold.items()],
                    F.when(~multi, F.lit("fewer_than_two_sessions")).alias("reason"))


def fold_feasibility_summary(folds: DataFrame, budgets: Sequence[str], group: str = "group_id") -> DataFrame:
    """Counts over all folds, and primary-fold counts per budget flag."""
    multi = F.col("reason").isNull()
    return folds.agg(
        F.sum("n_test").alias("rows"), F.count_distinct(group).alias("groups"), F.count_distinct(F.when(multi, F.col(group))).alias("multi_session_groups"),
        F.count_if(multi).alias("folds"), F.count_if("two_test_contexts").alias("folds_two_contexts"), F.count_if("all_supported").alias("folds_supported"),
        F.count_if("primary_feasible").alias("primary_folds"), F.count_distinct(F.when(F.col("primary_feasible"), F.col(group))).alias("primary_groups"),
        *[F.count_if(F.col("primary_feasible") & F.col(b)).alias(b) for b in budgets])


def fold_join(rows: DataFrame, group: str, path: str) -> DataFrame:
    """Fold sizes without the fold x row product: test = own group, train = total minus own group."""
    g = rows.groupBy(F.col(group).alias("fold")).agg(F.count(F.lit(1)).alias("n_test"), F.count_distinct(path).alias("distinct_test"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return g.crossJoin(F.broadcast(total)).select("fold", "n_test", (F.col("total") - F.col("n_test")).alias("n_train"), (F.col("n_test") == F.col("distinct_test")).alias("covered_once"))


def validate_folds(assignments: DataFrame, rows: DataFrame, group: str, path: str) -> DataFrame:
    """Errors per fold from ``(fold, path, is_test)``: overlap, leak of the held-out group, foreign test rows; and rows not tested exactly once."""
    a = assignments.join(rows.select(path, F.col(group).alias("__g")), path)
    both = a.groupBy("fold", path).agg(F.bool_or("is_test").alias("t"), F.bool_or(~F.col("is_test")).alias("r"), F.max("__g").alias("g"))
    own = F.col("g").cast("string") == F.col("fold").cast("string")
    per = both.groupBy("fold").agg(F.count_if(F.col("t") & F.col("r")).alias("o"), F.count_if(F.col("t") & ~own).alias("f"), F.count_if(F.col("r") & own).alias("l"))
    folds = per.select(F.col("fold").cast("string").alias("subject"), F.array_compact(F.array(
        F.when(F.col("o") > 0, F.lit("train_test_overlap")), F.when(F.col("f") > 0, F.lit("test_row_outside_held_out_group")),
        F.when(F.col("l") > 0, F.lit("held_out_group_in_train")))).alias("errors"))
    tested = rows.select(path).join(assignments.where("is_test").groupBy(path).agg(F.count(F.lit(1)).alias("c")), path, "left")
    cover = tested.agg(F.count_if(F.coalesce("c", F.lit(0)) != 1).alias("bad")).select(F.lit("all").alias("subject"), F.array_compact(F.array(
        F.when(F.col("bad") > 0, F.lit("rows_not_tested_exactly_once")))).alias("errors"))
    return folds.unionByName(cover)


def prior_baselines(rows: DataFrame, group: str, label: str, classes: Sequence) -> DataFrame:
    """Leave-one-group-out prevalence and majority from class totals minus the group's own totals."""
    counts = lambda pre: [F.count_if(F.col(label) == c).alias(f"{pre}{i}") for i, c in enumerate(classes)]
    own = rows.groupBy(F.col(group).alias("fold")).agg(F.count(F.lit(1)).alias("on"), *counts("o"))
    tot = rows.agg(F.count(F.lit(1)).alias("tn"), *counts("t"))
    j = own.crossJoin(F.broadcast(tot))
    ps = [((F.col(f"t{i}") - F.col(f"o{i}")) / (F.col("tn") - F.col("on"))).alias(f"p{i}") for i in range(len(classes))]
    out = j.select("fold", *ps)
    return out.withColumn("majority", argmax_label([f"p{i}" for i in range(len(classes))]))


def laplace_prevalence(df: DataFrame, keys: Sequence[str], y: str) -> DataFrame:
    return df.groupBy(*keys).agg(((F.sum(F.col(y).cast("double")) + 1.0) / (F.count(y) + 2.0)).alias("prevalence"))


def chronological_split(df: DataFrame, keys: Sequence[str], time: str, ties: str, label: str, fraction: float = 0.67, segment_us: int = 3_600_000_000) -> DataFrame:
    """Labelled rows in time order, split at max(2, min(n-2, floor(n*fraction))); needs six rows."""
    from evidencelens.operators.segments import ranked, segment_of

    lab = df.where(F.col(label).isNotNull())
    n = lab.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    r = ranked(lab, keys, segment_of(time, segment_us), [time, ties], "rank").join(n, list(keys))
    cut = F.greatest(F.lit(2), F.least(F.col("n") - 2, F.floor(F.col("n") * F.lit(fraction)).cast("long")))
    return r.withColumn("part", F.when(F.col("n") < 6, F.lit("unsupported")).when(F.col("rank") <= cut, F.lit("train")).otherwise(F.lit("test")))


# ---- class-score packets -------------------------------------------------------------------------


def project_class_groups(scores: DataFrame, class_names: dict[int, str], groups: dict[str, Sequence[str]]) -> DataFrame:
    """Score rows of every class that belongs to a group, by exact name; the map is a literal."""
    by_pos: dict[int, list] = {}
    for g, wanted in groups.items():
        for pos, name in class_names.items():
            if name in wanted:
                by_pos.setdefault(pos, []).append((g, name))
    if not by_pos:
        return scores.where("false").select("event_id", "frame_index", "class_pos", "score", F.lit("").alias("class_group"), F.lit("").alias("class_name"))
    lookup = F.create_map(*[x for pos, hits in by_pos.items() for x in (
        F.lit(pos), F.array(*[F.struct(F.lit(g).alias("class_group"), F.lit(n).alias("class_name")) for g, n in hits]))])
    kept = scores.where(F.col("class_pos").isin(*by_pos))
    return kept.select("event_id", "frame_index", "class_pos", "score", F.explode(lookup[F.col("class_pos")]).alias("g")).select(
        "event_id", "frame_index", "class_pos", "score", "g.*")


def class_group_features(scores: DataFrame, class_names: dict[int, str], groups: dict[str, Sequence[str]], active: float = 0.25) -> DataFrame:
    """Per event: mean and max over frames of the per-frame group maximum (NULL when no class matches), top score and active count."""
    def top(names: Sequence[str]) -> Column:
        pos = [p for p, n in class_names.items() if n in names]
        return F.max(F.when(F.col("class_pos").isin(*pos), F.col("score"))) if pos else F.max(F.lit(None).cast("double"))

    frame = scores.groupBy("event_id", "frame_index").agg(
        F.max("score").alias("__top"), F.count_if(F.col("score") >= active).alias("__active"), *[top(n).alias(f"g_{g}") for g, n in groups.items()])
    outs = [a for g in groups for a in (F.avg(f"g_{g}").alias(f"{g}_mean"), F.max(f"g_{g}").alias(f"{g}_max"))]
    return frame.groupBy("event_id").agg(*outs, F.avg("__top").alias("top_score_mean"), F.avg("__active").alias("active_class_count_mean"))
