"""Removal of repeated byte strings: bucket-pointer refinement over content-chosen suffixes.

Every byte position starts a string of ``length`` bytes, its window. A window hangs on its anchor, the leftmost position inside it
whose q-gram hashes lowest among the ``width`` q-grams of the window, so equal windows hang on their anchors at the same distance and
only about 2 of ``width`` positions are anchors. The q-gram of the anchor is its initial bucket. An anchor stands for a range of windows
(distances); refinement halves that range twice a round. In each round all items are sorted by bucket identifier and content:

* an item whose bucket holds no other place starts no repeated window in its range and is done,
* an item whose whole content, from its first window to the end of its last, occurs at another place has only repeated windows and is done,
* the others are refined, and so are the first and last item of every repeated content in their bucket, for the others may share windows
  with it: their bucket identifier together with the identifiers of the bytes at further offsets, left and right, is the
  bucket of each part of the range. A part's identifier is made from the refined one, never again from the text.

The last round has single windows. Neighbours in the sorted order decide everything, so a bucket of any size is spread over as many
tasks as its items fill; only the first and last row of each task are settled in a second, tiny sort. Identifiers are BLAKE2b digests of
128 bits. Texts are shuffled twice: once to the anchors that are left after the first round, and once to the ranges to remove.
A text that occurs in several rows is repeated as a whole, if it is long enough, and no text of it is needed again.

Defined results: null is an empty text; texts shorter than ``length`` keep all bytes; every row, repeated ones too, is a document of its
own; a null id stays null; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .text import mix, slices

#: Bytes whose windows are looked at together; longer texts are cut into such pieces, which overlap by a window.
PIECE = 1 << 20
#: Parts into which a round divides a range of distances.
PARTS = 4
_ITEM = "c1 long, c2 long, w1 long, w2 long, k1 long, k2 long, a long, d0 int, d1 int, ext binary"
_KEY = ("c1", "c2", "w1", "w2", "k1", "k2", "a")
_ANCHORS = pa.list_(pa.struct([(n, pa.int64()) for n in ("c1", "w1", "w2", "a")] + [(n, pa.int32()) for n in ("d0", "d1")]))
_RANGES = pa.list_(pa.struct([("p0", pa.int64()), ("p1", pa.int64())]))
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)


def widths(length: int) -> list[int]:
    """Ranges of distances of the rounds: the largest power of two up to two thirds of ``length``, divided by PARTS down to one."""
    top = 1 << max(0, (2 * length // 3).bit_length() - 1)
    out = [top]
    while out[-1] > 1:
        out.append(max(1, out[-1] // PARTS))
    return out


def gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """A 32-bit hash of the q-gram at every position, from hashes of half the length at two offsets."""
    level, size, done, out = _BYTE[data], 1, 0, None
    while True:
        if q & size:
            part = level[done:]
            out = part if out is None else out[: len(part)] * np.uint32(0x85EBCA6B) + part[: len(out)]
            done += size
        if done == q:
            break
        level = level[:-size] * np.uint32(0x9E3779B1 + 2 * size) + level[size:]
        size *= 2
    out = out[: len(data) - q + 1]
    out = (out ^ (out >> np.uint32(16))) * np.uint32(0x7FEB352D)
    return out ^ (out >> np.uint32(15))


def anchors(data: np.ndarray, length: int, width: int) -> np.ndarray:
    """The anchor of every window of ``data``."""
    keys = (gram_hashes(data, length - width + 1).astype(np.uint64) << np.uint64(32)) | np.arange(len(data) - length + width, dtype=np.uint64)
    size = 1
    while size < width:
        keys = np.minimum(keys[:-size], keys[size:])  # width is a power of two
        size *= 2
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)


def runs(joined: bytes, ends: np.ndarray, length: int, width: int) -> Iterator[tuple[int, int, int]]:
    """(anchor, first window, last window) of the joined texts; ``ends`` are the ends of the texts, which no window crosses."""
    for at in range(0, max(0, len(joined) - length + 1), PIECE):
        data = np.frombuffer(joined, np.uint8, min(PIECE + length - 1, len(joined) - at), at)
        found = anchors(data, length, width)
        start = at + np.arange(len(found))
        text = np.searchsorted(ends, start, side="right")
        valid = start + length <= ends[text]
        new = np.concatenate(([True], (found[1:] != found[:-1]) | (text[1:] != text[:-1])))
        first = np.flatnonzero(new & valid)
        edge = np.flatnonzero(new | ~valid)
        after = np.append(edge, len(found))[np.searchsorted(edge, first, side="right")]
        yield from zip((found[first] + at).tolist(), (first + at).tolist(), (after - 1 + at).tolist())


def _pair(digest: bytes) -> tuple[int, int]:
    return struct.unpack(">qq", digest)


def _digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16).digest()


def _scanned(length: int, width: int):
    """Per row its text's key, size and digest, its anchors, and the windows that repeat inside it; a text repeated in a task has anchors once."""
    gram = length - width + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                digests = [hashlib.sha256(t).digest() for t in texts]
                fresh = []
                for i, (t, d) in enumerate(zip(texts, digests)):
                    if len(t) >= length and d not in seen:
                        seen.add(d)
                        fresh.append(i)
                items: list[dict[bytes, tuple]] = [{} for _ in texts]
                sure: list[list[tuple[int, int]]] = [[] for _ in texts]
                if fresh:
                    joined = b"".join(texts[i] for i in fresh)
                    ends = np.cumsum([len(texts[i]) for i in fresh])
                    starts = [0, *ends.tolist()]
                    where = 0
                    for a, p0, p1 in runs(joined, ends, length, width):
                        while p0 >= starts[where + 1]:
                            where += 1
                        base, own = starts[where], items[fresh[where]]
                        whole = _digest(struct.pack("<II", a - p1, a - p0), joined[p0 : p1 + length])
                        if whole in own:  # another place of this text has these windows, too
                            sure[fresh[where]] += [(p0 - base, p1 - base)]
                            own[whole][1] = True
                        else:
                            core = int.from_bytes(hashlib.blake2b(joined[a : a + gram], digest_size=8).digest(), "little", signed=True)
                            own[whole] = [(core, *_pair(whole), a - base, a - p1, a - p0), False]
                for own, known in zip(items, sure):
                    known += [(x[0][3] - x[0][5], x[0][3] - x[0][4]) for x in own.values() if x[1]]
                flat = [x[0] for own in items for x in own.values()]
                offsets = np.cumsum([0, *(len(own) for own in items)]).astype(np.int32)
                columns = list(zip(*flat)) or [()] * 6
                cells = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ANCHORS.value_type)], fields=list(_ANCHORS.value_type))
                keys = [_pair(d[:16]) for d in digests]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.array([k[0] for k in keys], pa.int64()),
                        pa.array([k[1] for k in keys], pa.int64()),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array([d.hex() for d in digests], pa.string()),
                        pa.ListArray.from_arrays(pa.array(offsets), cells),
                        pa.array([merged(known, 1) for known in sure], _RANGES),
                    ],
                    ["doc_id", "k1", "k2", "n", "sha", "anchors", "sure"],
                )

    return run


def merged(spans: list[tuple[int, int]], gap: int) -> list[tuple[int, int]]:
    """Ranges (first, last), joined where at most ``gap`` apart."""
    out: list[tuple[int, int]] = []
    for p0, p1 in sorted(spans):
        if out and p0 <= out[-1][1] + gap:
            out[-1] = out[-1][0], max(out[-1][1], p1)
        else:
            out.append((p0, p1))
    return out


def _same(rows: list[np.ndarray], names: int) -> np.ndarray:
    """Whether each row but the first agrees with the one before in the first ``names`` columns."""
    out = np.ones(len(rows[0]) - 1, bool)
    for c in rows[:names]:
        out &= c[1:] == c[:-1]
    return out


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by _KEY: those with a neighbour in their bucket (``known``), of the same content (``twice``) or of other content in
    their bucket (``other``), and the edges of the task."""
    schema = None
    last = None  # the row that still waits for its successor: a batch of one row, and what its predecessor says
    for batch in batches:
        if not batch.num_rows:
            continue
        schema = batch.schema
        table = pa.Table.from_batches([batch] if last is None else [last[0], batch])
        keys = [np.asarray(table.column(n).combine_chunks()) for n in _KEY]
        fresh = np.concatenate(([True], ~_same(keys, 7)))
        table, keys = table.filter(pa.array(fresh)), [k[fresh] for k in keys]
        first = last is None
        bucket, content = _same(keys, 2), _same(keys, 4)
        flags = np.zeros((4, len(keys[0])), bool)
        for row, pairs in zip(flags, (bucket, content, bucket & ~content)):
            row[1:] |= pairs
            row[:-1] |= pairs
        flags[:, 0] |= (False, False, False, True) if first else last[1]
        n = len(keys[0]) - 1
        yield from _flagged(table.slice(0, n), flags[:, :n])
        last = table.slice(n).combine_chunks().to_batches()[0], flags[:, n]
    if last is not None:
        last[1][3] = True
        yield from _flagged(pa.Table.from_batches([last[0]], schema), last[1][:, None])


def _flagged(table: pa.Table, found: np.ndarray) -> Iterator[pa.RecordBatch]:
    use = np.zeros(table.num_rows, bool)
    for name, flags in zip(("known", "twice", "other", "edge"), found):
        if name in table.column_names:  # what the task of the row found already
            flags = flags | np.asarray(table.column(name).combine_chunks())
            table = table.drop_columns(name)
        table = table.append_column(name, pa.array(flags))
        use |= flags
    yield from table.filter(pa.array(use)).to_batches()


def _settled(items: DataFrame, label: str) -> DataFrame:
    """Items that share their bucket or their content with another place."""
    kind = items.schema.simpleString()[7:-1].replace(":", " ")
    out = kind + ", known boolean, twice boolean, other boolean, edge boolean"
    found = items.repartitionByRange(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(_neighbours, out)
    found = materialise(found, label)
    edges = found.filter("edge").repartition(1).sortWithinPartitions(*_KEY).mapInArrow(_neighbours, out)  # two rows a task
    return found.filter("NOT edge").unionByName(edges).drop("edge")


def refined(rows: Iterator[tuple], lo_of, size: int, part: int) -> Iterator[tuple]:
    """Items for the parts (``part`` distances each) of ranges of ``size`` distances.

    ``ext`` holds the bytes from the first window to the bucket's string and from there to the end of the last window.
    """
    for c1, c2, k1, k2, a, d0, d1, ext in rows:
        lo = lo_of(d0)
        bucket = struct.pack("<qq", c1, c2)
        left, right = ext[: d1 - lo], ext[d1 - lo :]
        for at in range(d0 // part * part, d1 + 1, part):
            e0, e1 = max(at, d0), min(at + part - 1, d1)
            near_left, near_right = left[len(left) - (at - lo) :], right[: lo + size - at - part]
            far_left, far_right = left[len(left) - (e1 - lo) :], right[: lo + size - 1 - e0]
            core = _digest(bucket, struct.pack("<I", at), near_left, near_right)
            whole = _digest(bucket, struct.pack("<II", e0, e1), far_left, far_right)
            yield *_pair(core), *_pair(whole), k1, k2, a, e0, e1, far_left[: len(far_left) - len(near_left)] + far_right[len(near_right) :]


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """One row at a time, so that only one text is a Python value."""
    for row in zip(*batch.columns):
        yield tuple(cell.as_py() for cell in row)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.int32()] * 2 + [pa.binary()]
    columns = list(zip(*rows)) or [()] * 10
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [x.split()[0] for x in _ITEM.split(", ")])


def _from_texts(length: int, width: int, part: int):
    """Parts of the anchors' ranges, from (k1, k2, text, open anchors)."""
    gram = length - width + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, text, rows in _rows(batch):
                whole = (
                    (*_pair(_digest(text[r["a"] : r["a"] + gram])), k1, k2, r["a"], r["d0"], r["d1"], text[r["a"] - r["d1"] : r["a"]] + text[r["a"] + gram : r["a"] - r["d0"] + length])
                    for r in rows
                )
                yield _batch(list(refined(whole, lambda d0: 0, width, part)))

    return run


def _from_items(size: int, part: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(n).to_pylist() for n in ("c1", "c2", "k1", "k2", "a", "d0", "d1", "ext")))
            yield _batch(list(refined(rows, lambda d0: d0 // size * size, size, part)))

    return run


def _without(length: int):
    """(k1, k2, n_removed, n_spans, kept digest) from (k1, k2, text, ranges of repeated windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k1, k2, text, ranges in _rows(batch):
                kept, at, removed = hashlib.sha256(), 0, 0
                spans = merged([(r["p0"], r["p1"]) for r in ranges], length)
                for p0, p1 in spans:
                    kept.update(text[at:p0])
                    at = p1 + length
                    removed += at - p0
                kept.update(text[at:])
                out.append((k1, k2, removed, len(spans), kept.hexdigest()))
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 5, kinds)], ["k1", "k2", "n_removed", "n_spans", "kept_sha256"])

    return run


def without_repeats(docs: DataFrame, doc_id: Column, text: Column, length: int = 400) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 of the bytes that no repeated string of ``length`` bytes covers."""
    if length < 1:
        raise ValueError("length must be at least 1")
    rounds = widths(length)
    body = docs.select(doc_id.cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    scanned = body.mapInArrow(_scanned(length, rounds[0]), "doc_id long, k1 long, k2 long, n long, sha string, anchors array<struct<c1:long,w1:long,w2:long,a:long,d0:int,d1:int>>, sure array<struct<p0:long,p1:long>>")
    scanned = materialise(scanned, "anchors")
    halves = [F.conv(F.substring(F.sha2("text", 256), 16 * h + 1, 16), 16, -10).cast("long").alias(f"k{h + 1}") for h in (0, 1)]
    texts = body.select(F.col("text").cast("binary").alias("text")).filter(F.length("text") >= length).select(*halves, "text")

    window = lambda: (F.struct((F.col("a") - F.col("d1")).alias("p0"), (F.col("a") - F.col("d0")).alias("p1")))
    items = scanned.select("k1", "k2", F.inline("anchors")).select("c1", F.lit(0).cast("long").alias("c2"), "w1", "w2", "k1", "k2", "a", "d0", "d1")
    found = _settled(items, "buckets")
    repeated = scanned.select("k1", "k2", F.explode("sure").alias("r")).unionByName(found.filter("twice").select("k1", "k2", window().alias("r")))
    for i, size in enumerate(rounds[:-1]):
        left = found.filter("known AND (NOT twice OR other)")
        if i == 0:
            open_ = left.groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "d0", "d1")).alias("rows"))
            items = texts.join(open_, ["k1", "k2"]).select("k1", "k2", "text", "rows").mapInArrow(_from_texts(length, size, rounds[1]), _ITEM)
        else:
            items = left.mapInArrow(_from_items(size, rounds[i + 1]), _ITEM)
        found = _settled(materialise(items, "parts"), "buckets")
        repeated = repeated.unionByName(found.filter("twice").select("k1", "k2", window().alias("r")))

    copies = scanned.groupBy("k1", "k2").agg(F.count("*").alias("copies"))
    ranges = repeated.groupBy("k1", "k2").agg(F.collect_set("r").alias("ranges"))
    cut = texts.join(ranges.join(copies.filter("copies = 1"), ["k1", "k2"]), ["k1", "k2"]).select("k1", "k2", "text", "ranges")
    cut = cut.mapInArrow(_without(length), "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string")
    whole = (F.col("copies") > 1) & (F.col("n") >= length)
    verdicts = materialise(copies.join(cut, ["k1", "k2"], "left"), "verdicts")  # so that the last join reads two tables and can split a text of many rows
    return (
        scanned.select("doc_id", "k1", "k2", "n", "sha").join(verdicts, ["k1", "k2"])
        .select(
            "doc_id",
            F.col("n").alias("n_bytes"),
            F.when(whole, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(whole, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        )
    )
