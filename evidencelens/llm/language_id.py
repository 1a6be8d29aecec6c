"""Language ID: a byte convolutional network, trained and applied in numpy.

Bytes are embedded, convolved with filters of several widths, max-pooled over a fixed-length window and classified by a
softmax. A whole text is cut into consecutive windows; its probabilities are the mean over its windows, weighted by
their bytes. The network is fitted on the driver from a bounded, hash-ordered sample of windows of labelled rows
(about ``per_language`` windows a language, ``max_rows`` in all, both parameters); its parameters are a few kB and travel
with the tasks, which evaluate all windows of a batch together.

At prediction a filter over bytes is a sum of table entries: the tables of byte pairs are computed once a worker.

Defined results: null text or text without a letter is ``und`` with score 0; without any labelled row every text is ``und``;
repeated rows keep their rows; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import appended, prepared

UNKNOWN = "und"
WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS, DIMENSIONS = 16, 8
PER_LANGUAGE, MAX_ROWS, MAX_LANGUAGES = 3_000, 12_000, 1_000
STEPS, BATCH, RATE = 1_200, 64, 0.01
#: Windows taken from a sampled document.
SPOTS = 2
#: Windows evaluated at a time, so that their activations stay in the processor's cache.
BLOCK_WINDOWS = 48
SLICE_BYTES = 1 << 19


@dataclass(frozen=True)
class Network:
    """Embedding (256, d), per width a filter (w, d, f) and offset (f,), and the output layer."""

    languages: tuple[str, ...]
    embedding: np.ndarray
    filters: tuple[np.ndarray, ...]
    offsets: tuple[np.ndarray, ...]
    dense: np.ndarray
    bias: np.ndarray


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(padded byte windows, text of each window, bytes in each window)."""
    counts = np.fromiter((-(-len(t) // WINDOW) for t in texts), np.int64, len(texts))
    first = np.concatenate(([0], np.cumsum(counts)))
    out = np.zeros((first[-1], WINDOW), np.uint8)
    sizes = np.full(first[-1], WINDOW, np.int64)
    flat = out.reshape(-1)
    for i, t in enumerate(texts):
        if t:
            at = first[i] * WINDOW
            flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
            sizes[first[i + 1] - 1] = len(t) - (counts[i] - 1) * WINDOW
    return out, np.repeat(np.arange(len(texts)), counts), sizes


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(samples: list[tuple[str, bytes]], seed: int = 7) -> Network:
    """Adam on the cross entropy; the order of the samples is shuffled by ``seed``, so equal samples give equal networks."""
    languages = tuple(sorted({lang for lang, _ in samples}))
    label = np.array([languages.index(lang) for lang, _ in samples])
    matrix = np.zeros((len(samples), WINDOW + max(WIDTHS) - 1), np.uint8)
    for i, (_, t) in enumerate(samples):
        matrix[i, : min(len(t), WINDOW)] = np.frombuffer(t[:WINDOW], np.uint8)
    rng = np.random.default_rng(seed)
    f32 = np.float32
    params = [rng.normal(0, 0.5, (256, DIMENSIONS)).astype(f32)]
    params += [rng.normal(0, (w * DIMENSIONS) ** -0.5, (w * DIMENSIONS, FILTERS)).astype(f32) for w in WIDTHS]
    params += [np.zeros(FILTERS, f32) for _ in WIDTHS]
    params += [rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(f32), np.zeros(len(languages), f32)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    k, step = len(WIDTHS), 0
    while step < STEPS:
        order = rng.permutation(len(samples))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            x, y, n = matrix[pick].copy(), label[pick], len(pick)
            cut = rng.integers(8, WINDOW, n)  # short windows are seen too
            x[np.arange(x.shape[1])[None, :] >= np.where(rng.random(n) < 0.3, cut, WINDOW)[:, None]] = 0
            embedded = params[0][x]
            pooled, places, patches = [], [], []
            for i, w in enumerate(WIDTHS):
                view = np.concatenate([embedded[:, o : o + WINDOW] for o in range(w)], axis=2)
                out = view @ params[1 + i] + params[1 + k + i]
                place = out.argmax(axis=1)
                pooled.append(np.take_along_axis(out, place[:, None, :], 1)[:, 0])
                places.append(place)
                patches.append(view[np.arange(n)[:, None], place])
            hidden = np.maximum(np.concatenate(pooled, axis=1), 0)
            error = softmax(hidden @ params[-2] + params[-1])
            error[np.arange(n), y] -= 1
            error /= n
            back = (error @ params[-2].T) * (hidden > 0)
            grads = [np.zeros_like(params[0])]
            offsets = []
            for i, w in enumerate(WIDTHS):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                grads.append(np.einsum("bfd,bf->df", patches[i], g))
                offsets.append(g.sum(axis=0))
                spread = g[:, :, None] * params[1 + i].T[None]
                for o in range(w):
                    np.add.at(grads[0], x[np.arange(n)[:, None], places[i] + o], spread[:, :, o * DIMENSIONS : (o + 1) * DIMENSIONS])
            grads += [*offsets, hidden.T @ error, error.sum(axis=0)]
            step += 1
            for p, g, (m, v) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    shaped = tuple(params[1 + i].reshape(w, DIMENSIONS, FILTERS) for i, w in enumerate(WIDTHS))
    return Network(languages, params[0], shaped, tuple(params[1 + k : 1 + 2 * k]), params[-2], params[-1])


class Evaluator:
    """The network with its filters expanded to tables of byte pairs."""

    def __init__(self, net: Network):
        self.net = net
        part = [[net.embedding @ f[o] for o in range(len(f))] for f in net.filters]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(1 << 16, FILTERS)
        # Widths 2, 3 and 4 all begin with a pair; 3 goes on with a byte, 4 with a second pair.
        self.first = np.concatenate([pair(p[0], p[1]) + off for p, off in zip(part, net.offsets)], axis=1)
        self.third = part[1][2]
        self.second = pair(part[2][2], part[2][3])

    def probabilities(self, matrix: np.ndarray) -> np.ndarray:
        out = np.empty((len(matrix), len(self.net.languages)), np.float32)
        for at in range(0, len(matrix), BLOCK_WINDOWS):
            block = np.pad(matrix[at : at + BLOCK_WINDOWS], ((0, 0), (0, 3))).astype(np.int32)
            pairs = block[:, :-1] * 256 + block[:, 1:]
            act = self.first[pairs[:, :WINDOW]]
            act[:, :, FILTERS : 2 * FILTERS] += self.third[block[:, 2 : WINDOW + 2]]
            act[:, :, 2 * FILTERS :] += self.second[pairs[:, 2 : WINDOW + 2]]
            hidden = np.maximum(act.max(axis=1), 0)
            out[at : at + BLOCK_WINDOWS] = softmax(hidden @ self.net.dense + self.net.bias)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        part: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if text and any(map(str.isalpha, text)):
                part.append(i)
                size += len(text)
            if part and (size >= SLICE_BYTES or i == len(texts) - 1):
                self._fill(part, texts, names, scores)
                part, size = [], 0
        if part:
            self._fill(part, texts, names, scores)
        return names, scores

    def _fill(self, part: list[int], texts: list[str | None], names: list[str], scores: list[float]) -> None:
        data = [texts[i].lower().encode() for i in part]
        matrix, owner, sizes = windows(data)
        weighted = self.probabilities(matrix) * sizes[:, None]
        first = np.searchsorted(owner, np.arange(len(part)))
        mean = np.add.reduceat(weighted.astype(np.float64), first, axis=0) / np.array([len(d) for d in data])[:, None]
        best = mean.argmax(axis=1)
        for i, b, row in zip(part, best, mean):
            names[i], scores[i] = self.net.languages[b], float(min(1.0, max(0.0, row[b])))


def evaluator(net: Network) -> Evaluator:
    return prepared(("language", net.dense.tobytes()), lambda: Evaluator(net))


def sample_windows(labelled: DataFrame, key: Column, lang: Column, text: Column, per_language: int = PER_LANGUAGE, max_rows: int = MAX_ROWS) -> list[tuple[str, bytes]]:
    """At most ``max_rows`` labelled windows in the order of a hash of ``key``, about equally many a language."""
    rows = labelled.select(lang.cast("string").alias("lang"), text.alias("text"), F.xxhash64(key, F.lit(11)).alias("h"), F.xxhash64(key, F.lit(13)).alias("g")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()}
    if not counts:
        return []
    wanted = max(1, min(per_language, max_rows // len(counts)) // SPOTS)
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1 << 30, (wanted << 30) // n + 1))))
    chosen = rows.filter(F.pmod("h", F.lit(1 << 30)) < share[F.col("lang")])
    start = lambda spot: F.lit(1) + F.pmod(F.xxhash64("g", spot), F.greatest(F.lit(1), F.length("text") - WINDOW)).cast("int")
    pieces = F.explode(F.array(*(F.substring("text", start(F.lit(spot)), F.lit(WINDOW)) for spot in range(SPOTS))))
    found = chosen.select("lang", pieces.alias("piece"), "h").filter(F.col("piece").rlike(r"\p{L}")).orderBy("h", "lang", "piece").limit(max_rows).collect()
    return [(r["lang"], r["piece"].lower().encode()) for r in found]


def predicted(docs: DataFrame, text: str, net: Network | None, name: str) -> DataFrame:
    """``docs`` with a column ``name`` struct<lang: string, score: double>."""

    def predict(text: pa.Array) -> pa.Array:
        values = text.to_pylist()
        names, scores = evaluator(net).predict(values) if net else ([UNKNOWN] * len(values), [0.0] * len(values))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return appended(docs, text, name, "struct<lang:string,score:double>", predict)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame) -> Network | None:
    """The network of the labelled documents that are not held out; documents without an id are not learned from."""
    samples = sample_windows(docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))), F.col("doc_id"), F.col("lang"), F.col("text"))
    return train(samples) if samples else None
