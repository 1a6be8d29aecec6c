"""Many regularised logistic fits, kept and solved on the executors.

Leave-one-group-out needs one fit per group and model, households one per household and feature set. Fits are rows of a table keyed by
(model, group) that hold their parameters and the solver's state; the driver only counts the fits that still move.

* Rows are dealt once into lanes of bounded size, cached by lane: mixed groups for leave-one-group-out, otherwise parts of one group, so
  that a hot group fills as many lanes as it needs. A step sends the fits to the lanes they learn from, never the rows to the fits.
* A lane adds the loss, gradient and Hessian of its rows for each of its fits into one packed vector; vectors are summed by fit in two
  levels, and the task that ends the sum solves the fit's step and writes its new row.
* Fits with permuted groups (``Model.permuted``) are leave-one-group-out fits whose rows are centred by the mean of a permuted group. Rows carry a
  few bytes of a digest for each fit of the block at hand; the label, the centre and the centred row are made in the lane, in every pass.
* Categories are one index a feature and row. A fit has columns for the values its own training rows hold, found in its first pass, so a
  feature may have any number of values. Up to DENSE coefficients a step is Newton's; beyond, a limited-memory quasi-Newton step whose
  pass gathers by index and sends gradients and the Hessian's diagonal only. Both end at the same minimum.

Objective per fit: C * sum_i w_i * loss_i + 1/2 |beta|^2 with balanced class weights n / (k * n_c) over the classes present. Two classes use
one coefficient vector. The intercept is free unless ``penalise_intercept``. Categories are scaled but never centred.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelens.operators import permutation as pt
from evidencelens.operators.segments import tasks_for
from evidencelens.session import cut_lineage, materialise

# The helpers below travel with the task, so executors need NumPy and Arrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a lane, about; fits that are sent to the lanes together; partial sums of a fit that meet in one task, about.
LANE_ROWS, BLOCK_FITS, FAN = 1 << 16, 512, 64
#: Rows of a lane, about, whose rows carry the digests of a block of fits.
KEYED_ROWS = 1 << 14
#: Coefficients up to which a step is Newton's.
DENSE = 400
CHUNK = 4096
MEMORY = 8
NONE = "\0"  # the group of rows without one
_FITS = "model string, gs string, state binary, active boolean, supported boolean, converged boolean, gradient double, steps int"


@dataclass
class Model:
    """What the fits of one name have in common. ``cols`` index the row's numbers, ``cats`` its category indices.

    ``tau`` None trains on x itself, otherwise on x minus a*mean_g + (1-a)*mu with a = n_g/(n_g+tau), where mean_g is the row's group mean
    and mu the training mean; tau = 0 is plain group centring. ``permuted``: (seed, repeat) of the permuted labels by whose means it is centred.
    """

    name: str
    cols: Sequence[int]
    cats: Sequence[int] = ()
    tau: float | None = None
    permuted: tuple[int, int] | None = None


@dataclass
class Fit:
    """One fit and its solver's state. Columns: numbers, then the values of each category, then the intercept."""

    model: Model
    group: str
    fill: np.ndarray | None
    classes: int
    mu: np.ndarray = field(default=None)
    mean: np.ndarray = field(default=None)
    scale: np.ndarray = field(default=None)
    values: list = field(default_factory=list)
    value_scale: list = field(default_factory=list)
    class_weight: np.ndarray = field(default=None)
    beta: np.ndarray = field(default=None)
    objective: float = np.inf
    step: np.ndarray = field(default=None)
    length: float = 1.0
    history: list = field(default_factory=list)
    slope: np.ndarray = field(default=None)
    start: np.ndarray = field(default=None)
    gradient: float = np.inf
    steps: int = 0
    supported: bool = True
    converged: bool = False
    active: bool = True
    #: Permuted: rows of every group in order, the held-out one's place, that of the missing group (or -1), where the other groups begin (bucket and
    #: place in it, then the row itself), the centres of the permuted groups, the moments of the true ones.
    sizes: np.ndarray = field(default=None)
    at: int = -1
    missing: int = -1
    begins: tuple = field(default=None)
    bounds: np.ndarray = field(default=None)
    centres: np.ndarray = field(default=None)
    moments: tuple = field(default=None)

    @property
    def head(self) -> str:
        return pt.head(self.model.permuted[0], self.group, self.model.permuted[1])

    @property
    def bits(self) -> int:
        return pt.bits_for(len(self.sizes))

    @property
    def others(self) -> np.ndarray:
        return np.delete(np.arange(len(self.sizes)), self.at)

    @property
    def dense(self) -> bool:
        return self.beta.size <= DENSE

    @property
    def present(self) -> np.ndarray:
        return np.flatnonzero(self.class_weight > 0)


def group_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(NONE))


# ---- what a lane computes for a fit --------------------------------------------------------------


@dataclass
class Part:
    """Rows of a lane: classes, numbers, category indices, for centred models the moments of each row's group, and for permuted ones the row's group,
    the digest's first bytes under the fit, path and unique number, and the label once it is known."""

    y: np.ndarray
    x: np.ndarray
    c: np.ndarray
    own: tuple | None = None
    at: np.ndarray | None = None
    keyed: tuple | None = None
    label: np.ndarray | None = None

    def of(self, mask: np.ndarray) -> Part:
        one = lambda v: None if v is None else v[mask]
        every = lambda v: None if v is None else tuple(o[mask] for o in v)
        return Part(self.y[mask], self.x[mask], self.c[mask], every(self.own), one(self.at), every(self.keyed), one(self.label))

    def chunks(self) -> Iterator[Part]:
        for at in range(0, len(self.y), CHUNK):
            yield self.of(np.arange(at, min(at + CHUNK, len(self.y))))


def _filled(f: Fit, p: Part) -> np.ndarray:
    z = np.where(np.isnan(p.x), 0.0 if f.fill is None else f.fill, p.x)
    return z if f.centres is None or p.label is None else z - f.centres[p.label]


def _centred(f: Fit, p: Part) -> np.ndarray:
    """Filled numbers, less the centre of the row's group where the model asks for it and the rows carry their group's moments."""
    z = _filled(f, p)
    if f.model.tau is not None and p.own is not None:
        rows, n, mean = p.own
        full = (n * mean + (rows - n) * (0.0 if f.fill is None else f.fill)) / rows
        a = rows / (rows + f.model.tau)
        z = z - (a * full + (1 - a) * f.mu)
    return z[:, list(f.model.cols)]


def _numbers(f: Fit, p: Part) -> np.ndarray:
    return (_centred(f, p) - f.mean) / f.scale


def _codes(f: Fit, p: Part) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of every category: (rows that hold a known value, its place, the scaled 1)."""
    for cat, values, scale in zip(f.model.cats, f.values, f.value_scale):
        code = p.c[:, cat]
        at = np.searchsorted(values, code)
        rows = np.flatnonzero((at < len(values)) & (values[np.minimum(at, len(values) - 1)] == code)) if len(values) else np.zeros(0, np.int64)
        yield rows, at[rows], 1.0 / scale[at[rows]]


def _design(f: Fit, p: Part) -> np.ndarray:
    parts = [_numbers(f, p)]
    for (rows, at, one), values in zip(_codes(f, p), f.values):
        hot = np.zeros((len(p.y), len(values)))
        hot[rows, at] = one
        parts.append(hot)
    return np.hstack([*parts, np.ones((len(p.y), 1))])


def _scores(f: Fit, p: Part) -> np.ndarray:
    """Linear scores, one column per coefficient vector, without a design matrix of the categories."""
    d = len(f.model.cols)
    out = _numbers(f, p) @ f.beta[:, :d].T + f.beta[:, -1]
    for (rows, at, one), values in zip(_codes(f, p), f.values):
        out[rows] += (f.beta[:, d : d + len(values)].T[at]) * one[:, None]
        d += len(values)
    return out


def proba(f: Fit, p: Part) -> np.ndarray:
    """Class probabilities; classes absent from training get 0."""
    s = _scores(f, p)
    out = np.zeros((len(s), len(f.class_weight)))
    if len(f.present) == 2:
        t = s[:, 0]
        q = np.where(t >= 0, 1.0 / (1.0 + np.exp(-np.abs(t))), np.exp(-np.abs(t)) / (1.0 + np.exp(-np.abs(t))))
        out[:, f.present[1]], out[:, f.present[0]] = q, 1.0 - q
        return out
    e = np.exp(s - s.max(axis=1, keepdims=True))
    out[:, f.present] = e / e.sum(axis=1, keepdims=True)
    return out


def _contribution(f: Fit, p: Part) -> np.ndarray:
    """Loss, gradient and Hessian (or, beyond DENSE, its diagonal) of the weighted log loss, packed in one vector."""
    w = f.class_weight[p.y]
    q = proba(f, p)
    loss = -np.sum(w * np.log(np.maximum(q[np.arange(len(p.y)), p.y], 1e-300)))
    two = len(f.present) == 2
    q = q[:, f.present[1:]] if two else q[:, f.present]
    hot = (p.y[:, None] == (f.present[1:] if two else f.present)[None, :]).astype(float)
    slope, k = (q - hot) * w[:, None], q.shape[1]
    if not f.dense:
        curve = q * (1 - q) * w[:, None]
        z = _numbers(f, p)
        grad, diag = [slope.T @ z], [curve.T @ (z * z)]
        for (rows, at, one), values in zip(_codes(f, p), f.values):
            grad.append(np.stack([np.bincount(at, slope[rows, a] * one, len(values)) for a in range(k)]))
            diag.append(np.stack([np.bincount(at, curve[rows, a] * one * one, len(values)) for a in range(k)]))
        grad.append(slope.sum(axis=0)[:, None])
        diag.append(curve.sum(axis=0)[:, None])
        return np.concatenate([[loss], np.hstack(grad).ravel(), np.hstack(diag).ravel()])
    z = _design(f, p)
    d = z.shape[1]
    hess = np.empty((k, d, k, d))
    for a in range(k):
        for b in range(a, k):
            h = (z * (w * q[:, a] * ((a == b) - q[:, b]))[:, None]).T @ z
            hess[a, :, b, :] = h
            hess[b, :, a, :] = h.T
    return np.concatenate([[loss], (slope.T @ z).ravel(), hess.ravel()])


def _moments(z: np.ndarray) -> tuple:
    mean = z.mean(axis=0)
    return len(z), mean, ((z - mean) ** 2).sum(axis=0)


def _add_moments(a: tuple, b: tuple) -> tuple:
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + gap * gap * (a[0] * b[0] / n)


def _add_counts(a: tuple, b: tuple) -> tuple:
    values, back = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    return values, np.bincount(back, np.concatenate([a[1], b[1]]), len(values)).astype(np.int64)


def _first(f: Fit, p: Part) -> tuple:
    """Class counts, moments of the filled numbers, counts of the values of each category (negative: no value)."""
    held = [np.unique(p.c[:, cat][p.c[:, cat] >= 0], return_counts=True) for cat in f.model.cats]
    return np.bincount(p.y, minlength=f.classes), _moments(_filled(f, p)), held


def _add_first(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], _add_moments(a[1], b[1]), [_add_counts(x, y) for x, y in zip(a[2], b[2])]


def _spread(f: Fit, p: Part) -> tuple:
    return _moments(_centred(f, p))


# ---- permuted groups -----------------------------------------------------------------------------


def _outside(f: Fit, p: Part, key: np.ndarray) -> Part:
    """The rows that a permuted fit learns from. Once its groups' first rows are known, with their labels; rows labelled as the missing group go."""
    mask = p.at != f.at
    if f.bounds is None:
        return Part(p.y, p.x, p.c, None, p.at, (key, *p.keyed)).of(mask)
    label = f.others[pt.places(f.bounds, f.head, key, *p.keyed)]
    return Part(p.y, p.x, p.c, None, p.at, None, label).of(mask & (label != f.missing))


def _bucket_counts(f: Fit, p: Part) -> np.ndarray:
    return np.bincount(pt.buckets(p.keyed[0], f.bits), minlength=1 << f.bits)


def _near_begins(f: Fit, p: Part) -> np.ndarray:
    """The order of the rows in whose buckets a group begins."""
    asked = np.zeros(1 << f.bits, bool)
    asked[f.begins[0]] = True
    hit = asked[pt.buckets(p.keyed[0], f.bits)]
    return pt.words(f.head, p.keyed[1][hit], p.keyed[2][hit])


def _label_sums(f: Fit, p: Part) -> np.ndarray:
    """Rows, and sums of the filled numbers, of every label."""
    z = _filled(f, p)
    return np.stack([np.bincount(p.label, w, len(f.sizes)) for w in (None, *z.T)])


def _group_moments(f: Fit, p: Part) -> tuple:
    """Rows, mean and squared distances of the centred numbers in every true group."""
    z, g = _filled(f, p), len(f.sizes)
    n = np.bincount(p.at, minlength=g)[:, None]
    mean = np.stack([np.bincount(p.at, v, g) for v in z.T], axis=1) / np.maximum(n, 1)
    return n, mean, np.stack([np.bincount(p.at, v, g) for v in ((z - mean[p.at]) ** 2).T], axis=1)


def _add_group_moments(a: tuple, b: tuple) -> tuple:
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / np.maximum(n, 1)), a[2] + b[2] + gap * gap * (a[0] * b[0] / np.maximum(n, 1))


#: What a pass adds up for a fit, and how two sums meet.
PASSES: dict[str, tuple[Callable, Callable]] = {
    "first": (_first, _add_first), "spread": (_spread, _add_moments), "step": (_contribution, np.add),
    "buckets": (_bucket_counts, np.add), "begins": (_near_begins, lambda a, b: np.concatenate([a, b])), "centres": (_label_sums, np.add),
    "within": (_group_moments, _add_group_moments),
}


def _find_buckets(f: Fit, counts: np.ndarray | None) -> None:
    f.supported = counts is not None
    if f.supported:
        f.begins = pt.starts_in(counts, f.sizes[f.others])


def _find_bounds(f: Fit, found: np.ndarray | None) -> None:
    f.bounds = np.zeros((0, 5), np.uint64) if found is None or not len(f.begins[0]) else pt.bounds(found, f.bits, *f.begins)
    f.begins = None


def _find_centres(f: Fit, sums: np.ndarray | None) -> None:
    f.supported = sums is not None
    if f.supported:
        f.centres = (sums[1:] / np.maximum(sums[0], 1)).T


def _keep_moments(f: Fit, moments: tuple | None) -> None:
    f.moments = moments


# ---- what becomes of a fit -----------------------------------------------------------------------


def _scale(f: Fit, moments: tuple, centre: bool) -> None:
    n, mean, m2 = moments
    sd = np.sqrt(m2 / n)
    f.mean = mean if centre else np.zeros(len(mean))
    f.scale = np.where(sd > 1e-12 * np.maximum(1.0, np.abs(mean)), sd, 1.0)


def _begin(f: Fit, found: tuple | None, centre: bool) -> None:
    """Standardisation (population deviation, zero variance divides by 1), class weights and columns."""
    if found is None:
        f.supported = f.active = False
        return
    y, (n, mean, m2), held = found
    f.mu = mean
    cols = list(f.model.cols)
    _scale(f, (n, mean[cols], m2[cols]), centre)
    f.values = [values for values, _ in held]
    share = [counts / n for _, counts in held]
    f.value_scale = [np.where(s < 1, np.sqrt(s * (1 - s)), 1.0) for s in share]
    present = y > 0
    f.class_weight = np.where(present, y.sum() / (present.sum() * np.maximum(y, 1)), 0.0)
    f.supported = f.active = bool(present.sum() >= 2)
    if f.supported:
        k = int(present.sum())
        f.beta = np.zeros((1 if k == 2 else k, len(cols) + sum(map(len, f.values)) + 1))


def _advance(f: Fit, packed: np.ndarray, c: float, penalise_intercept: bool, max_iter: int, tol: float) -> None:
    """One step from the sums at ``beta``: back where the last step overshot, else on, else done."""
    ridge = np.ones_like(f.beta)
    if not penalise_intercept:
        ridge[:, -1] = 0.0
    size = f.beta.size
    objective = c * packed[0] + 0.5 * float(np.sum(ridge * f.beta * f.beta))
    grad = c * packed[1 : 1 + size] + (ridge * f.beta).ravel()
    f.steps += 1
    f.active = f.steps < max_iter
    allowed = f.objective + 1e-9 * abs(f.objective) if f.dense or f.slope is None else f.objective + 1e-4 * f.length * float(f.slope @ f.step)
    if f.step is not None and objective > allowed and f.length > 1e-8:
        f.length *= 0.5
        f.beta = f.start + f.length * f.step.reshape(f.beta.shape)
        return
    f.gradient = float(np.abs(grad).max())
    if f.gradient < tol:
        f.converged, f.active = True, False
        return
    if f.dense:
        hess = c * packed[1 + size :].reshape(size, size) + np.diag(ridge.ravel())
        step = -np.linalg.lstsq(hess, grad, rcond=1e-13)[0]
    else:
        if f.step is not None:
            move, turn = (f.beta - f.start).ravel(), grad - f.slope
            if move @ turn > 1e-12 * np.linalg.norm(move) * np.linalg.norm(turn):
                f.history = [*f.history, (move, turn)][-MEMORY:]
        step = -_two_loops(grad, f.history, np.maximum(c * packed[1 + size :] + ridge.ravel(), 1e-9))
        if step @ grad >= 0:
            f.history, step = [], -grad / np.maximum(c * packed[1 + size :] + ridge.ravel(), 1e-9)
    f.objective, f.slope, f.start, f.step, f.length = objective, grad, f.beta, step, 1.0
    f.beta = f.beta + step.reshape(f.beta.shape)


def _two_loops(grad: np.ndarray, history: list, diagonal: np.ndarray) -> np.ndarray:
    """The limited-memory quasi-Newton direction from the last moves, on top of the Hessian's diagonal."""
    q, back = grad.copy(), []
    for move, turn in reversed(history):
        a = (move @ q) / (move @ turn)
        q -= a * turn
        back.append(a)
    q = q / diagonal
    for (move, turn), a in zip(history, reversed(back)):
        q += move * (a - (turn @ q) / (move @ turn))
    return q


def dumped(f: Fit) -> bytes:
    """A fit as plain values: the classes travel with the task and have no name that a pickle could refer to."""
    return pickle.dumps({**vars(f), "model": vars(f.model)}, 5)


def loaded(state: bytes) -> Fit:
    values = pickle.loads(state)
    return Fit(**{**values, "model": Model(**values["model"])})


def _row(f: Fit) -> tuple:
    return f.model.name, f.group, dumped(f), f.active, f.supported, f.converged, None if np.isinf(f.gradient) else f.gradient, f.steps


def _fit_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.binary(), pa.bool_(), pa.bool_(), pa.bool_(), pa.float64(), pa.int32()]
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds)], [x.split()[0] for x in _FITS.split(", ")])


# ---- tables --------------------------------------------------------------------------------------


def _matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten(), kind).reshape(len(column), -1)


def _part(rows: pa.Table) -> Part:
    own = None
    if "own_rows" in rows.column_names:
        own = np.asarray(rows["own_rows"], float)[:, None], _matrix(rows["own_n"], float), _matrix(rows["own_mean"], float)
    part = Part(np.asarray(rows["y"], np.int64), _matrix(rows["x"], float), _matrix(rows["c"], np.int64), own)
    if "keys" in rows.column_names:
        part.at = np.asarray(rows["at"], np.int64)
        part.keyed = np.array(rows["path"].to_pylist(), object), np.asarray(rows["uid"], np.int64)
    return part


def _keys(column: pa.ChunkedArray) -> np.ndarray:
    """The digests' first bytes, a row for each fit of the block."""
    packed = np.frombuffer(b"".join(column.to_pylist()), f">u{pt.KEY_BYTES}").reshape(len(column), -1)
    return np.ascontiguousarray(packed.T).astype(np.uint32)


def _dealt(rows: DataFrame, mixed: bool) -> tuple[DataFrame, DataFrame | int]:
    """(rows dealt over tasks by lane, and either the number of lanes or the lanes of each group). ``rows``: written, with gs and uid.

    The tasks grow with the rows, so that what a task sorts by lane does not. Rows are kept sorted by lane: a pass over kept lanes sorts nothing.
    """
    n = rows.count()
    tasks = [t for t in [tasks_for(rows.sparkSession, n)] if t]
    if mixed:
        lanes = max(-(-n // LANE_ROWS), min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // 512)), 1)
        return rows.withColumn("lane", F.pmod(F.xxhash64("uid"), F.lit(lanes)).cast("string")).drop("uid").repartition(*tasks, "lane").sortWithinPartitions("lane"), lanes
    parts = rows.groupBy("gs").agg(F.ceil(F.count(F.lit(1)) / LANE_ROWS).cast("int").alias("parts"))
    dealt = rows.join(parts, "gs").withColumn("lane", F.concat_ws("#", "gs", F.pmod(F.xxhash64("uid"), "parts").cast("string"))).drop("parts", "gs", "uid")
    index = parts.select("gs", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("gs", F.concat_ws("#", "gs", F.col("part").cast("string")).alias("lane"))
    return dealt.repartition(*tasks, "lane").sortWithinPartitions("lane"), index


def _dealt_keyed(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows dealt as mixed lanes that are small enough to carry the digests of a block of fits, a task a lane."""
    n = rows.count()
    lanes = max(-(-n // KEYED_ROWS), min(4 * rows.sparkSession.sparkContext.defaultParallelism, -(-n // 512)), 1)
    return rows.withColumn("lane", F.pmod(F.xxhash64("uid"), F.lit(lanes)).cast("string")).repartition(lanes, "lane").sortWithinPartitions("lane"), lanes


def _places(rows: DataFrame) -> DataFrame:
    """(gs, at, sizes, missing): each group's place in the order of groups, the rows of all, the place of the missing group; one row a group."""
    sizes = rows.groupBy("gs").agg(F.min("g").alias("g"), F.count(F.lit(1)).alias("n"))
    placed = sizes.withColumn("at", F.row_number().over(Window.orderBy("g", "gs")) - 1)
    every = F.transform(F.array_sort(F.collect_list(F.struct("at", "n"))), lambda s: s["n"])
    missing = F.coalesce(F.max(F.when(F.col("gs") == NONE, F.col("at"))), F.lit(-1))
    return placed.select("gs", "at").crossJoin(F.broadcast(placed.agg(every.alias("sizes"), missing.alias("missing"))))  # one row


def _own_moments(rows: DataFrame, dim: int) -> DataFrame:
    """Rows with the size of their group and, per number, the count and mean of its finite values there."""
    value = lambda i: F.when(~F.isnan(F.col("x")[i]), F.col("x")[i])
    stats = rows.groupBy("gs").agg(
        F.count(F.lit(1)).cast("double").alias("own_rows"),
        *[a for i in range(dim) for a in (F.count(value(i)).cast("double").alias(f"n{i}"), F.coalesce(F.avg(value(i)), F.lit(0.0)).alias(f"m{i}"))],
    ).select("gs", "own_rows", F.array(*[f"n{i}" for i in range(dim)]).alias("own_n"), F.array(*[f"m{i}" for i in range(dim)]).alias("own_mean"))
    return rows.join(stats, "gs")


def _passed(lanes: DataFrame, index: DataFrame | int, fits: DataFrame, kind: str, update: Callable, order: dict | None = None) -> DataFrame:
    """The active fits after ``update(fit, sum over their rows)``; ``kind`` names what is summed, ``order`` the place of permuted fits in the rows' keys."""
    take, add = PASSES[kind]
    mixed = isinstance(index, int)
    asked = fits.select("model", "gs", "state")
    at = asked.withColumn("lane", F.explode(F.transform(F.sequence(F.lit(0), F.lit(index - 1)), lambda i: i.cast("string")))) if mixed else asked.join(index, "gs")

    def partial(rows: pa.Table, fits: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and fits.num_rows:
            part, gs = _part(rows), np.asarray(rows["gs"]) if mixed else None
            keys = _keys(rows["keys"]) if order else None
            for model, group, state in zip(*(fits[n].to_pylist() for n in ("model", "gs", "state"))):
                f = loaded(state)
                use = _outside(f, part, keys[order[model, group]]) if order else part if not mixed else part.of(gs != group)
                sums = [take(f, p) for p in use.chunks()]
                if sums:
                    out.append((model, group, pickle.dumps(reduce(add, sums), 5)))
        columns = list(zip(*out)) or [()] * 3
        return pa.table({"model": pa.array(columns[0], pa.string()), "gs": pa.array(columns[1], pa.string()), "v": pa.array(columns[2], pa.binary())})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partial sums of a (model, group, share) become one."""
        key, held = None, None
        for batch in batches:
            out = []
            for model, group, v in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2))):
                if (model, group) != key:
                    if key:
                        out.append((*key, pickle.dumps(held, 5)))
                    key, held = (model, group), pickle.loads(v)
                else:
                    held = add(held, pickle.loads(v))
            yield sums(out)
        if key:
            yield sums([(*key, pickle.dumps(held, 5))])

    def sums(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.binary()))], ["model", "gs", "v"])

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A fit's row comes before its sums; it ends with the next fit's."""
        fit, held = None, None

        def done() -> tuple:
            update(fit, held)
            return _row(fit)

        for batch in batches:
            out = []
            for state, v in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if state is not None:
                    if fit is not None:
                        out.append(done())
                    fit, held = loaded(state), None
                else:
                    new = pickle.loads(v)
                    held = new if held is None else add(held, new)
            yield _fit_batch(out)
        if fit is not None:
            yield _fit_batch([done()])

    parts = lanes.groupBy("lane").cogroup(at.groupBy("lane")).applyInArrow(partial, "model string, gs string, v binary")
    if mixed and index > FAN:  # many lanes: the first level of sums
        share = F.pmod(F.xxhash64("v"), F.lit(-(-index // FAN)))
        parts = parts.withColumn("share", share).repartition("model", "gs", "share").sortWithinPartitions("model", "gs", "share").select("model", "gs", "v").mapInArrow(summed, "model string, gs string, v binary")
    both = asked.withColumn("v", F.lit(None).cast("binary")).unionByName(parts.withColumn("state", F.lit(None).cast("binary")))
    met = both.repartition("model", "gs").sortWithinPartitions("model", "gs", F.col("state").isNull(), F.xxhash64("v"))
    return met.select("model", "gs", "state", "v").mapInArrow(solved, _FITS)


def fit_all(rows: DataFrame, models: Sequence[Model], classes: int, *, leave_out: bool, fill: DataFrame | None = None, c: float = 1.0, penalise_intercept: bool = False, centre: bool = True,
            max_iter: int = 100, tol: float = 1e-7, path: str | None = None, labels: Callable[[DataFrame, Sequence[str]], DataFrame] | None = None) -> DataFrame:
    """The table of fits, one for every model and group of ``rows`` (g, y, x array<double>, optionally c array<long>: category indices).

    ``leave_out``: a group's fits learn from all other groups, otherwise from the group itself. ``fill``: (g, fill array<double>), what missing
    numbers of a group's fits hold. Columns model, gs (the group as text), state, supported, converged, gradient, steps.

    ``labels(rows, heads)`` is given if and only if all models are permuted: it adds ``keys``, see ``permutation``, to the rows, which have a ``path``.
    Then a missing group has no fits, a group without rows to learn from neither, and ``group_moments`` reads the fits' moments.
    """
    models = list(models)
    categories = F.col("c") if "c" in rows.columns else F.array().cast("array<long>")
    more = ["g", F.col(path).cast("string").alias("path")] if labels else []
    rows = rows.select(group_text(F.col("g")).alias("gs"), F.col("y").cast("int").alias("y"), "x", categories.alias("c"), *more)
    rows = materialise(rows.withColumn("uid", F.monotonically_increasing_id()), "rows")
    groups = rows.select("gs").distinct()
    groups = groups.withColumn("fill", F.lit(None).cast("array<double>")) if fill is None else groups.join(fill.select(group_text(F.col("g")).alias("gs"), "fill"), "gs", "left")

    if labels:
        placed = cut_lineage(_places(rows))
        groups = groups.join(placed, "gs").where(F.col("gs") != NONE)
        rows = rows.join(placed.select("gs", "at"), "gs").drop("g")

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for g, v, *p in zip(*(c.to_pylist() for c in batch.columns)):
                own = {"at": p[0], "sizes": np.array(p[1], np.int64), "missing": p[2]} if p else {}
                made += [_row(Fit(m, g, None if v is None else np.nan_to_num(np.array(v, float)), classes, **own)) for m in models]
            yield _fit_batch(made)

    fits = materialise(groups.mapInArrow(begun, _FITS), "fits")
    if any(m.tau is not None for m in models):
        rows = _own_moments(rows, rows.select(F.size("x")).first()[0])
    lanes, index = _dealt_keyed(rows) if labels else _dealt(rows, leave_out)
    lanes = lanes.persist()
    blocks = -(-fits.count() // BLOCK_FITS) if leave_out else 1

    def fitted(lanes: DataFrame, block: DataFrame, order: dict | None = None) -> list[DataFrame]:
        block = materialise(_passed(lanes, index, block, "first", lambda f, found: _begin(f, found, centre), order), "fits")
        centred = F.col("supported") & F.col("model").isin([m.name for m in models if m.tau is not None])
        if any(m.tau is not None for m in models):
            spread = _passed(lanes, index, block.filter(centred), "spread", lambda f, found: _scale(f, found, centre))
            block = materialise(block.filter(~centred).unionByName(spread), "fits")
        ended = []
        while block.filter("active").limit(1).count():
            ended.append(block.filter("NOT active"))
            block = materialise(_passed(lanes, index, block.filter("active"), "step", lambda f, found: _advance(f, found, c, penalise_intercept, max_iter, tol), order), "fits")
        return [*ended, block]

    def permuted(block: DataFrame) -> list[DataFrame]:
        """The keys of a block's fits are kept beside the rows while the block is fitted."""
        drawn = {m.name: m.permuted for m in models}
        order = {(model, gs): i for i, (model, gs) in enumerate(sorted(map(tuple, block.select("model", "gs").collect())))}  # BLOCK_FITS, about
        if not order:
            return [block]
        keyed = labels(lanes, [pt.head(drawn[model][0], gs, drawn[model][1]) for model, gs in order]).persist()
        try:
            for kind, update in (("buckets", _find_buckets), ("begins", _find_bounds), ("centres", _find_centres)):
                block = materialise(_passed(keyed, index, block, kind, update, order).filter("supported"), "fits")
            block = reduce(DataFrame.unionByName, fitted(keyed, block, order))
            return [materialise(_passed(keyed, index, block, "within", _keep_moments, order), "fits")]
        finally:
            keyed.unpersist()

    done = []
    try:
        for b in range(blocks):
            block = fits if blocks == 1 else fits.filter(F.pmod(F.xxhash64("gs", "model"), F.lit(blocks)) == b)
            done += permuted(block) if labels else fitted(lanes, block)
        return cut_lineage(reduce(DataFrame.unionByName, done or [fits]).drop("active"))
    finally:
        lanes.unpersist()


def group_moments(fits: DataFrame, features: Sequence[str]) -> DataFrame:
    """(fold, repeat, at, and of every feature n_, m_, v_): rows, mean and variance of what permuted fits learnt from, in each true group."""
    names = ["fold", "repeat", "at", *[f"{t}_{f}" for f in features for t in "nmv"]]

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for state in batch.column(0).to_pylist():
                f = loaded(state)
                n, mean, m2 = f.moments
                for at in np.flatnonzero(n[:, 0]):
                    own = int(n[at, 0])
                    rows.append((f.group, f.model.permuted[1], int(at), *[v for j in range(len(features)) for v in (own, float(mean[at, j]), float(m2[at, j]) / own)]))
            kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.int64(), pa.float64(), pa.float64()] * len(features)]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(list(zip(*rows)) or [()] * len(kinds), kinds)], names)

    return fits.select("state").mapInArrow(exploded, "fold string, repeat int, at int, " + ", ".join(f"`n_{f}` long, `m_{f}` double, `v_{f}` double" for f in features))


def predict(rows: DataFrame, fits: DataFrame, keep: Sequence[str], classes: int) -> DataFrame:
    """Probabilities of every fit of the row's group: ``keep…, model, p0…, converged``. Unsupported fits give no row.

    Rows for centred models arrive already centred: what centre a held-out row gets is the caller's choice.
    """
    kinds = [*rows.select(*keep).dtypes]
    categories = F.col("c") if "c" in rows.columns else F.array().cast("array<long>")
    kept = F.struct(*[F.col(k) for k in keep]).alias("kept")
    shaped = materialise(rows.select(kept, group_text(F.col("g")).alias("gs"), F.lit(0).alias("y"), "x", categories.alias("c")).withColumn("uid", F.monotonically_increasing_id()), "scored")
    lanes, index = _dealt(shaped, False)
    at = fits.filter("supported").select("gs", "state").join(index, "gs")
    out = pa.schema([("model", pa.string()), *[(f"p{i}", pa.float64()) for i in range(classes)], ("converged", pa.bool_())])

    def score(rows: pa.Table, fits: pa.Table) -> pa.Table:
        parts = []
        if rows.num_rows and fits.num_rows:
            part = _part(rows)
            for state in fits["state"].to_pylist():
                f = loaded(state)
                p = np.vstack([proba(f, q) for q in part.chunks()])
                columns = [pa.array([f.model.name] * len(p)), *[pa.array(p[:, i]) for i in range(classes)], pa.array(np.full(len(p), f.converged))]
                parts.append(pa.table([rows["kept"], *columns], ["kept", *out.names]))
        return pa.concat_tables(parts) if parts else pa.table([pa.array([], rows.schema.field("kept").type), *[pa.array([], f.type) for f in out]], ["kept", *out.names])

    schema = f"kept struct<{', '.join(f'`{n}`: {t}' for n, t in kinds)}>, model string, {', '.join(f'p{i} double' for i in range(classes))}, converged boolean"
    return lanes.groupBy("lane").cogroup(at.groupBy("lane")).applyInArrow(score, schema).select("kept.*", "model", *[f"p{i}" for i in range(classes)], "converged")
