"""Vectorised word and shingle hashing inside tasks, and small plan helpers shared by the operators.

Words are runs of bytes that a 256-entry table does not map to a blank. Every byte position gets one term of a
polynomial modulo 2^64, so the hash of any word is a difference of two prefix sums: no Python loop over words.
"""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

BLANKS = b" \t\n\x0b\x0c\r"
SLICE_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def lower_table() -> np.ndarray:
    """A-Z to lower case, the six ASCII blanks to a space; every other byte is part of a word."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(BLANKS)] = 32
    return table


def alnum_table() -> np.ndarray:
    """ASCII letters and digits and all bytes from 0x80 form words; other bytes separate them."""
    table = lower_table()
    for b in range(128):
        if not chr(b).isalnum():
            table[b] = 32
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a hash can be used."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_arrays(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(texts: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the end, byte start, byte end) of the joined texts."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    raw = table[joined]
    blank = raw == 32
    edge = np.diff(np.concatenate(([True], blank)).view(np.int8))
    begin = np.flatnonzero(edge == -1)
    end = np.flatnonzero(edge == 1)
    powers, inverse = _power_arrays(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[: len(raw)], out=sums[1:])
    hashes = mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    first = np.searchsorted(begin, np.concatenate(([0], np.cumsum(lengths))))
    return hashes, first, begin, end


def fold(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive words."""
    n = max(0, len(words) - k + 1)
    out = words[:n].copy()
    for t in range(1, k):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + words[t : t + n])
    return out


def shingle_sets(texts: list[bytes], table: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct ``k``-word shingle hashes of each text; fewer words give the whole sequence as one."""
    words, first, _, _ = word_hashes(texts, table)
    runs = fold(words, k)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            out.append(fold(words[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(offset, UTF-8 texts) pieces of a string column, each of about ``limit`` bytes at most; null is empty."""
    at, size, part = 0, 0, []
    for i, value in enumerate(column.cast(pa.binary())):
        text = value.as_py() or b""
        if part and size + len(text) > limit:
            yield at, part
            at, size, part = i, 0, []
        part.append(text)
        size += len(text)
    if part:
        yield at, part


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def appended(docs: DataFrame, text: str, name: str, kind: str, fn: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """``docs`` with a further column ``name`` of type ``kind``, which ``fn`` makes from Arrow batches of column ``text``.

    All operators run in the same kind of Python worker this way, and a worker's memory is shared by the stages of a pipeline.
    """
    at = docs.columns.index(text)
    schema = StructType([*docs.schema.fields, StructType.fromDDL(f"`{name}` {kind}")[0]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, fn(batch.column(at))], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


_tool: list = [None, None]


def prepared(key: object, build: Callable[[], object]) -> object:
    """What a worker prepares for its tasks (a tokenizer, tables of a network), kept between tasks.

    Only one at a time: another operator's is given up first, so a worker that serves a whole pipeline never holds several.
    """
    if _tool[0] != key:
        _tool[:] = [None, None]
        gc.collect()
        _tool[:] = [key, build()]
    return _tool[1]


_shipped: set[str] = set()


#: Rows and bytes of an Arrow batch, unless the session says otherwise: long texts make large rows.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a session, for sessions started without ``--py-files``, and bounds their batches."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "evidencelens_code.zip")  # Spark copies it from the driver
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
