"""Many k-means fits that advance together, one pass over the rows for a step of all of them.

A *sample* says which rows and columns a family of fits sees: all rows, or exactly as many as asked for, those with the smallest hash draws.
Its fits differ in their restart only and share imputation (exact medians) and scaling, both learned from the sample. In a pass every task
adds, for each sample, short arrays that do not grow with its rows (counts, sums, best draws); one task a sample merges them in the order
of the tasks, so results do not depend on timing. The driver holds parameters only: samples x restarts x k x columns numbers.

* Sample limits and medians are order statistics, found byte by byte of the ordered 64-bit keys (``order_statistics``).
* Seeding is k-means||: in each round the 2k rows with the smallest exponential draws over squared distance join the candidates, which are
  weighted by the rows next to them and reduced to k by weighted k-means++.
* Lloyd steps stop fit by fit; an empty cluster keeps its centre. The restart of least cost stands for its sample.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The helpers below travel with the task, so executors need NumPy and Arrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROUNDS = 2
CHUNK = 4096
SLICE = 1024  # rows whose distances to all centres of a sample stay in the processor's cache
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SIGN = np.uint64(1 << 63)


@dataclass
class Sample:
    """``size`` None: all rows. ``cols`` index the row's vector."""

    name: tuple
    k: int
    seed: int
    cols: Sequence[int]
    restarts: int
    size: int | None = None
    limit: int = (1 << 64) - 1
    fill: np.ndarray = field(default=None)
    mean: np.ndarray = field(default=None)
    scale: np.ndarray = field(default=None)
    centres: np.ndarray = field(default=None)  # restarts x k x columns
    moving: np.ndarray = field(default=None)  # restarts whose centres still move
    cost: np.ndarray = field(default=None)
    best: int = 0

    @property
    def centre(self) -> np.ndarray:
        return self.centres[self.best]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draws(h: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit draw for each row hash."""
    return mixed(mixed(h ^ np.uint64(seed * int(_ODD) % (1 << 64))) + _ODD)


def ordered(values: np.ndarray) -> np.ndarray:
    """Unsigned keys in the order of the doubles."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def unordered(key: int) -> float:
    key = np.uint64(key)
    return float(np.array([key & ~_SIGN if key & _SIGN else ~key], np.uint64).view(np.float64)[0])


def packed(rows: DataFrame, row_id: str, features: Sequence[str]) -> DataFrame:
    """(row id, h, x): the id's hash and the finite values as one array, NaN where there is none.

    Rows are dealt evenly over the session's cores, as a pass costs far more than its rows' bytes, and files may be few; they are in the order of the
    hash in a task, so that sums do not depend on timing.
    """
    value = lambda f: F.coalesce(F.when(~F.isnan(c := F.col(f).cast("double")) & (F.abs(c) != float("inf")), c), F.lit(float("nan")))
    out = rows.select(F.col(row_id), F.xxhash64(F.col(row_id).cast("string")).alias("h"), F.array(*[value(f) for f in features]).alias("x"))
    return out.repartition(rows.sparkSession.sparkContext.defaultParallelism, "h").sortWithinPartitions("h")


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(row hashes, vectors, first row) of up to CHUNK rows of (.., h, x)."""
    h, x = batch.column(batch.schema.get_field_index("h")), batch.column(batch.schema.get_field_index("x"))
    for at in range(0, batch.num_rows, CHUNK):
        part = x.slice(at, CHUNK)
        yield np.asarray(h.slice(at, CHUNK)).astype(np.int64).view(np.uint64), np.asarray(part.flatten(), np.float64).reshape(len(part), -1), at


def merged_pass(rows: DataFrame, samples: Sequence[Sample], take: Callable, merge: Callable) -> dict:
    """By sample name: ``take(sample, h, x)`` of blocks of rows, merged inside tasks and then across them."""
    samples = list(samples)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, object] = {}
        for batch in batches:
            for h, x, _ in _blocks(batch):
                for i, s in enumerate(samples):
                    new = take(s, h, x)
                    if new is not None:
                        held[i] = merge(held[i], new) if i in held else new
        yield out(list(held), [pickle.dumps(v, 5) for v in held.values()])

    def out(at: list[int], values: list[bytes]) -> pa.RecordBatch:
        task = TaskContext.get().partitionId()
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([task] * len(at), pa.int32()), pa.array(values, pa.binary())], ["sample", "task", "v"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, object] = {}
        for batch in batches:
            for i, _, v in zip(*(c.to_pylist() for c in batch.columns)):
                new = pickle.loads(v)
                held[i] = merge(held[i], new) if i in held else new
        yield out(list(held), [pickle.dumps(v, 5) for v in held.values()])

    schema = "sample int, task int, v binary"
    parts = rows.select("h", "x").mapInArrow(partial, schema)
    summed = parts.repartition("sample").sortWithinPartitions("sample", "task").mapInArrow(total, schema)
    return {samples[r["sample"]].name: pickle.loads(r["v"]) for r in summed.collect()}  # one short array a sample


def plus(a, b):
    return a + b


def used(s: Sample, h: np.ndarray) -> np.ndarray | None:
    """Rows of the sample; None stands for all."""
    return None if s.size is None else draws(h, s.seed) <= np.uint64(s.limit)


def scaled(s: Sample, x: np.ndarray) -> np.ndarray:
    cols = list(s.cols)
    z = x if cols == list(range(x.shape[1])) else x[:, cols]
    z = np.where(np.isnan(z), s.fill, z)
    z -= s.mean
    z /= s.scale
    return z


def _seen(s: Sample, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    use = used(s, h)
    return (h, x) if use is None else (h[use], x[use])


def order_statistics(rows: DataFrame, samples: Sequence[Sample], keys: Callable, ranks: dict) -> dict:
    """The key of each (0-based) rank. ``keys(sample, h, x)`` gives lists of unsigned keys; ``ranks`` has, by sample name, a rank for each list."""
    found = {name: [0] * len(r) for name, r in ranks.items()}
    left = {name: list(r) for name, r in ranks.items()}
    asked = [s for s in samples if ranks.get(s.name)]
    for shift in range(56, -1, -8):
        if not asked:
            break

        def take(s, h, x, shift=shift, found=found):
            out = np.zeros((len(found[s.name]), 256), np.int64)
            for row, prefix, values in zip(out, found[s.name], keys(s, h, x)):
                if shift < 56:
                    values = values[values >> np.uint64(shift + 8) == np.uint64(prefix)]
                row += np.bincount(((values >> np.uint64(shift)) & np.uint64(255)).astype(np.int64), minlength=256)
            return out

        for name, counts in merged_pass(rows, asked, take, plus).items():
            for i, row in enumerate(counts):
                below = np.cumsum(row)
                byte = int(np.searchsorted(below, left[name][i], side="right"))
                left[name][i] -= int(below[byte - 1]) if byte else 0
                found[name][i] = (found[name][i] << 8) | byte
    return found


def _limits(rows: DataFrame, samples: Sequence[Sample]) -> None:
    """The draw up to which a sample takes rows, so that it has exactly its size (but for equal draws)."""
    part = [s for s in samples if s.size is not None]
    found = order_statistics(rows, part, lambda s, h, x: [draws(h, s.seed)], {s.name: [s.size - 1] for s in part})
    for s in part:
        s.limit = found[s.name][0]


def _prepare(rows: DataFrame, samples: Sequence[Sample]) -> None:
    """Exact medians for missing values, then mean and population deviation; a constant column divides by 1."""

    def values(s, h, x):
        z = _seen(s, h, x)[1][:, list(s.cols)]
        return [ordered(z[~np.isnan(z[:, j]), j]) for j in gaps[s.name] for _ in (0, 1)]

    every = Sample(("every",), 1, 0, range(1 + max(c for s in samples for c in s.cols)), 1)
    missing = merged_pass(rows, [every], lambda s, h, x: np.isnan(x[:, list(s.cols)]).any(axis=0), np.logical_or)[every.name]
    part = [s for s in samples if missing[list(s.cols)].any()]
    counts = merged_pass(rows, part, lambda s, h, x: (~np.isnan(_seen(s, h, x)[1][:, list(s.cols)])).sum(axis=0), plus) if part else {}
    gaps = {s.name: [j for j, c in enumerate(s.cols) if missing[c] and counts[s.name][j]] for s in part}
    ranks = {s.name: [r for j in gaps[s.name] for r in ((int(counts[s.name][j]) - 1) // 2, int(counts[s.name][j]) // 2)] for s in part}
    found = order_statistics(rows, samples, values, ranks)
    for s in samples:
        s.fill = np.zeros(len(s.cols))  # a column without a value says nothing: 0 everywhere
        for i, j in enumerate(gaps.get(s.name, ())):
            s.fill[j] = (unordered(found[s.name][2 * i]) + unordered(found[s.name][2 * i + 1])) / 2
        s.mean, s.scale = np.zeros(len(s.cols)), np.ones(len(s.cols))
    totals = merged_pass(rows, samples, lambda s, h, x: _sums(scaled(s, _seen(s, h, x)[1])), _add_moments)
    for s in samples:
        n, mean, m2 = totals[s.name]
        sd = np.sqrt(m2 / n)
        s.mean, s.scale = mean, np.where(sd > 1e-12 * np.maximum(1.0, np.abs(mean)), sd, 1.0)


def _sums(z: np.ndarray) -> tuple[int, np.ndarray, np.ndarray] | None:
    if not len(z):
        return None
    mean = z.mean(axis=0)
    return len(z), mean, ((z - mean) ** 2).sum(axis=0)


def _add_moments(a, b):
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + gap * gap * (a[0] * b[0] / n)


def squared(z: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Rows x fits x centres squared distances."""
    flat = centres.reshape(-1, centres.shape[-1])
    d = (z * z).sum(axis=1)[:, None] - 2 * z @ flat.T + (flat * flat).sum(axis=1)[None, :]
    return np.maximum(d, 0.0).reshape(len(z), *centres.shape[:-1])


def _smallest(m: int):
    def merge(a, b):
        keys, points = np.concatenate([a[0], b[0]], axis=1), np.concatenate([a[1], b[1]], axis=1)
        at = np.argsort(keys, axis=1, kind="stable")[:, :m]
        return np.take_along_axis(keys, at, axis=1), np.take_along_axis(points, at[..., None], axis=1)

    return merge


def _raced(m: int):
    """Of every fit the ``m`` rows with the smallest exponential draws over squared distance to its candidates (all alike without any)."""

    def take(s: Sample, h: np.ndarray, x: np.ndarray):
        h, x = _seen(s, h, x)
        if not len(h):
            return None
        z = scaled(s, x)
        step = 0 if s.centres is None else s.centres.shape[1]
        u = np.stack([draws(h, s.seed * 1_000_003 + 7919 * r + 101 * step + 1) for r in range(s.restarts)])
        race = -np.log((u >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54)
        if step:
            race = race / np.maximum(squared(z, s.centres).min(axis=2).T, 1e-300)
        at = np.argsort(race, axis=1, kind="stable")[:, :m]
        keys, points = np.take_along_axis(race, at, axis=1), z[at]
        if keys.shape[1] < m:
            more = m - keys.shape[1]
            keys = np.concatenate([keys, np.full((s.restarts, more), np.inf)], axis=1)
            points = np.concatenate([points, np.repeat(points[:, :1], more, axis=1)], axis=1)
        return keys, points

    return take


def _seeded(rows: DataFrame, samples: Sequence[Sample]) -> None:
    first = merged_pass(rows, samples, _raced(1), _smallest(1))
    for s in samples:
        s.centres = first[s.name][1]
    for _ in range(ROUNDS):
        for k in sorted({s.k for s in samples}):
            own = [s for s in samples if s.k == k]
            more = merged_pass(rows, own, _raced(2 * k), _smallest(2 * k))
            for s in own:
                s.centres = np.concatenate([s.centres, more[s.name][1]], axis=1)

    def near(s: Sample, h: np.ndarray, x: np.ndarray):
        x = _seen(s, h, x)[1]
        return nearest(scaled(s, x), s.centres)[1] if len(x) else None

    weights = merged_pass(rows, samples, near, plus)  # restarts x candidates
    for s in samples:
        s.centres = np.stack([_reduced(s.centres[r], weights[s.name][r], s.k, np.random.default_rng([s.seed % (1 << 32), r])) for r in range(s.restarts)])
        s.moving = np.ones(s.restarts, bool)


def nearest(z: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cost, counts, sums) by fit and centre of the rows next to it, the first of equal centres.

    Distances stand centre by centre, all fits side by side, for a slice of rows at a time; a row's own square is added to its least distance only.
    """
    fits, k, d = centres.shape
    flat = np.ascontiguousarray(centres.transpose(1, 0, 2)).reshape(k * fits, d)
    turned, norms = -2.0 * flat.T, (flat * flat).sum(axis=1)
    cost, counts, sums = np.zeros(fits), np.zeros(k * fits), np.zeros((k * fits, d))
    for at in range(0, len(z), SLICE):
        part = z[at : at + SLICE]
        g = part @ turned
        g += norms
        g = g.reshape(len(part), k, fits)
        least = g.min(axis=1)
        hot = g == least[:, None, :]
        taken = hot[:, 0].copy()
        for c in range(1, k):
            hot[:, c] &= ~taken
            taken |= hot[:, c]
        least += (part * part).sum(axis=1)[:, None]
        cost += np.maximum(least, 0.0).sum(axis=0)
        hot = hot.reshape(len(part), -1).astype(np.float64)
        counts += hot.sum(axis=0)
        sums += hot.T @ part
    return cost, counts.reshape(k, fits).T, sums.reshape(k, fits, d).transpose(1, 0, 2)


def _hot(d: np.ndarray) -> np.ndarray:
    """Rows x fits x centres: 1 at the nearest centre."""
    out = np.zeros(d.shape)
    np.put_along_axis(out, d.argmin(axis=2)[..., None], 1.0, axis=2)
    return out


def _reduced(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` of the weighted candidates by k-means++, then a few weighted Lloyd steps among them."""
    weights = weights + 1e-12
    chosen = [int(rng.choice(len(points), p=weights / weights.sum()))]
    near = squared(points, points[chosen][None])[:, 0, 0]
    for _ in range(k - 1):
        p = weights * near
        chosen.append(int(rng.choice(len(points), p=p / p.sum())) if p.sum() > 0 else int(np.argmax(near)))
        near = np.minimum(near, squared(points, points[chosen[-1:]][None])[:, 0, 0])
    centres = points[chosen].copy()
    for _ in range(5):
        hot = _hot(squared(points, centres[None]))[:, 0] * weights[:, None]
        mass = hot.sum(axis=0)
        centres = np.where(mass[:, None] > 1e-9, hot.T @ points / np.maximum(mass, 1e-9)[:, None], centres)
    return centres


def _lloyd(s: Sample, h: np.ndarray, x: np.ndarray):
    """(cost by fit, counts, sums) of the fits that still move."""
    x = _seen(s, h, x)[1]
    if not len(x):
        return None
    return nearest(scaled(s, x), s.centres[s.moving])


def _add_all(a, b):
    return tuple(x + y for x, y in zip(a, b))


def fit(rows: DataFrame, samples: Sequence[Sample], max_iter: int = 50, tol: float = 1e-4, alike: Sample | None = None) -> None:
    """Fills every sample's parameters and centres. ``rows``: h, x, from :func:`packed`. All impute and scale as ``alike``, where given."""
    rows = rows.select("h", "x").persist()
    try:
        _limits(rows, samples)
        _prepare(rows, samples if alike is None else [alike])
        for s in samples if alike is not None else ():
            s.fill, s.mean, s.scale = alike.fill, alike.mean, alike.scale
        _seeded(rows, samples)
        for _ in range(max_iter):
            todo = [s for s in samples if s.moving.any()]
            if not todo:
                break
            found = merged_pass(rows, todo, _lloyd, _add_all)
            for s in todo:
                _, counts, sums = found[s.name]
                old = s.centres[s.moving]
                new = np.where(counts[..., None] > 0, sums / np.maximum(counts, 1)[..., None], old)
                s.centres[s.moving] = new
                still = ((new - old) ** 2).sum(axis=(1, 2)) > tol * tol
                s.moving[np.flatnonzero(s.moving)[~still]] = False
        for s in samples:
            s.moving = np.ones(s.restarts, bool)
        found = merged_pass(rows, samples, _lloyd, _add_all)
        for s in samples:
            s.cost = found[s.name][0]
            s.best = int(np.argmin(s.cost))
    finally:
        rows.unpersist()


def assigned(s: Sample, x: np.ndarray) -> np.ndarray:
    """The best fit's cluster of every row, in the sample or not: 1..k by lexicographic centre."""
    order = sorted(range(s.k), key=lambda i: tuple(s.centre[i]))
    rank = np.empty(s.k, np.int64)
    rank[order] = np.arange(1, s.k + 1)
    return rank[squared(scaled(s, x), s.centre[None])[:, 0].argmin(axis=1)]


def labels(rows: DataFrame, samples: Sequence[Sample], row_id: str) -> DataFrame:
    """(row id, name number, k, cluster) of every row under every sample's best fit."""
    samples = list(samples)
    kind = rows.schema[row_id].dataType.simpleString()
    at = rows.columns.index(row_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, x, first in _blocks(batch):
                ids = batch.column(at).slice(first, len(h))
                for i, s in enumerate(samples):
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(h), i, np.int32)), pa.array(np.full(len(h), s.k, np.int32)), pa.array(assigned(s, x))], [row_id, "sample", "k", "cluster"])

    return rows.mapInArrow(run, f"`{row_id}` {kind}, sample int, k int, cluster long")


def silhouettes(rows: DataFrame, samples: Sequence[Sample]) -> dict[tuple, float | None]:
    """Mean silhouette with squared distances of every sample's best fit over all rows; None for one cluster."""

    def stats(s: Sample, h: np.ndarray, x: np.ndarray):
        z = scaled(s, x)
        hot = (assigned(s, x)[:, None] == np.arange(1, s.k + 1)).astype(float)
        return hot.sum(axis=0), hot.T @ z, hot.T @ (z * z).sum(axis=1)

    total = merged_pass(rows, samples, stats, _add_all)

    def scores(s: Sample, h: np.ndarray, x: np.ndarray):
        n, sums, squares = total[s.name]
        z, own = scaled(s, x), assigned(s, x) - 1
        d = np.maximum(0.0, (z * z).sum(axis=1)[:, None] * n - 2 * z @ sums.T + squares)
        at = np.arange(len(z))
        a = d[at, own] / np.maximum(n[own] - 1, 1)
        d = np.where(n > 0, d / np.maximum(n, 1), np.inf)
        d[at, own] = np.inf
        b = d.min(axis=1)
        top = np.maximum(a, b)
        score = np.where((n[own] == 1) | (top == 0), 0.0, (b - a) / np.where(top == 0, 1.0, top))
        return np.array([score.sum(), len(z)])

    wide = [s for s in samples if (total[s.name][0] > 0).sum() > 1]
    found = merged_pass(rows, wide, scores, plus) if wide else {}
    return {s.name: float(found[s.name][0] / found[s.name][1]) if s.name in found else None for s in samples}


def mean_pairwise_ari(rows: DataFrame, groups: dict[object, Sequence[Sample]]) -> dict[object, float | None]:
    """Per group of samples: the mean adjusted Rand index of all pairs of their labellings of all rows.

    The counts of all pairs are one product of a block's indicator matrix with itself; rows are not written once a pair.
    """
    anchors = {members[0].name: (key, list(members)) for key, members in groups.items() if len(members) > 1}

    def take(s: Sample, h: np.ndarray, x: np.ndarray):
        hot = np.hstack([assigned(m, x)[:, None] == np.arange(1, m.k + 1) for m in anchors[s.name][1]]).astype(float)
        return hot.T @ hot

    out: dict = {key: None for key in groups}
    if anchors:
        found = merged_pass(rows, [members[0] for _, members in anchors.values()], take, plus)
        for name, counts in found.items():
            key, members = anchors[name]
            at = np.cumsum([0, *(m.k for m in members)])
            cells = [[counts[at[i] : at[i + 1], at[j] : at[j + 1]] for j in range(len(members))] for i in range(len(members))]
            out[key] = float(np.mean([adjusted_rand(cells[i][j]) for i in range(len(members)) for j in range(i + 1, len(members))]))
    return out


def adjusted_rand(cells: np.ndarray) -> float:
    """Of a contingency table; 1 when no pair can disagree."""
    pairs = lambda n: float((n * (n - 1)).sum() / 2)
    a, b, both = pairs(cells.sum(axis=1)), pairs(cells.sum(axis=0)), pairs(cells)
    every = pairs(np.array([cells.sum()]))
    expected = a * b / every if every else 0.0
    top = (a + b) / 2
    return 1.0 if abs(top - expected) < 1e-12 else (both - expected) / (top - expected)


def parameters(samples: Sequence[Sample], features: Sequence[str]) -> list[tuple]:
    """(k, metric, detail, value) rows of the frozen fill, mean, scale and centres."""
    out = []
    for s in samples:
        names = [features[c] for c in s.cols]
        out += [(s.k, metric, name, float(v)) for metric in ("fill", "mean", "scale") for name, v in zip(names, getattr(s, metric))]
        for cluster, centre in enumerate(sorted(map(tuple, s.centre)), 1):
            out += [(s.k, "centre", f"{cluster}:{name}", float(v)) for name, v in zip(names, centre)]
    return out


def table(rows: Sequence[tuple], like: DataFrame) -> DataFrame:
    """Report rows (k, metric, detail, value) of bounded number as a DataFrame."""
    return like.sparkSession.createDataFrame(list(rows), "k int, metric string, detail string, value double")


def tidy(df: DataFrame, metric: str, value: Column, detail: Column | None = None) -> DataFrame:
    return df.select(F.col("k").cast("int").alias("k"), F.lit(metric).alias("metric"), (F.lit("") if detail is None else detail).alias("detail"), value.cast("double").alias("value"))
