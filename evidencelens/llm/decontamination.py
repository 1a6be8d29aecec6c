"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A test item is short, a document long, so their Jaccard similarity says nothing; what counts is the share of the item's five-word
shingles that the document contains. Only items are sketched: the ``SKETCH`` smallest shingle hashes of an item are a uniform sample of its set,
and a document that contains at least 80 % of the set contains about that share of the sample. Items are partitioned by size
(powers of two): a partition whose items are no larger than the sketch is sketched whole and needs its exact minimum of
hits; a partition of larger items needs the hits that a contained item misses with a probability below 1e-9. A document is probed
only with partitions whose smallest need it can meet. Candidates are verified on the word sequences themselves.

The item side is sent to the executors in blocks of at most ``BLOCK_BYTES`` of text, whose size is checked; a block holds the texts and arrays, a
small multiple of them; a larger benchmark takes several passes. Documents are neither shuffled nor cut.

Defined results: null or wordless text contains nothing and a wordless item is contained nowhere; an item of fewer than
five words is one shingle of all its words; equal items and repeated documents are reported each; empty tables give an empty
result; further columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .text import alnum_table, appended, fold, slices, word_hashes

SHINGLE, PERCENT, SKETCH = 5, 80, 32
MISS = 1e-9
BLOCK_BYTES = 32 << 20
FOUND = "array<struct<item_id:long,shared:long,n_item:long>>"
_TABLE = alnum_table()
_BYTES = bytes(_TABLE)
_PROBE_BITS = 20
#: Items whose shingles a worker keeps between documents.
KEPT_SETS = 256


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.string()))


def shingles_of(words: list[bytes], k: int) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def needed_hits(size: int, percent: int = PERCENT, sketch: int = SKETCH, miss: float = MISS) -> int:
    """Hits in the sketch below which a set of ``size`` shingles, contained to ``percent``, falls only with probability ``miss``."""
    must = -(-percent * size // 100)
    if size <= sketch:
        return must
    total, below = math.comb(size, sketch), 0
    for hits in range(sketch + 1):
        below += math.comb(must, hits) * math.comb(size - must, sketch - hits)
        if below > miss * total:
            return max(1, hits)
    return sketch


@dataclass
class Partition:
    """Items of one size class and shingle length: sorted sketch values and the items that hold each."""

    k: int
    need: int
    values: np.ndarray
    first: np.ndarray
    items: np.ndarray
    probe: np.ndarray


class ItemBlock:
    """A bounded part of the benchmark as the executors need it: the items' texts in one buffer, their sketches in arrays.

    About 2.5 times the texts; the shingles of an item are only made when a document has enough hits.
    """

    def __init__(self, ids: pa.Array, texts: pa.Array):
        """``ids`` long, ``texts`` lowered binary."""
        self.ids, self.texts = ids, texts
        self.sizes, self.lengths = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int8)
        hashes, owners = [], []
        for at, part in slices(texts):
            words, first, _, _ = word_hashes(part, _TABLE)
            runs = {k: fold(words, k) for k in range(1, SHINGLE + 1)}
            for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                k = min(SHINGLE, b - a)
                if k:
                    own = np.unique(runs[k][a : b - k + 1])
                    self.sizes[at + i], self.lengths[at + i] = len(own), k
                    hashes.append(own[:SKETCH].copy())
                    owners.append(at + i)
        need_of = {int(n): needed_hits(int(n)) for n in np.unique(self.sizes) if n}
        self.needs = np.array([need_of.get(n, 0) for n in self.sizes.tolist()], np.int64)
        self.partitions: list[Partition] = []
        owner = np.repeat(np.array(owners, np.int64), [len(h) for h in hashes])
        value = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        kind = self.lengths[owner].astype(np.int64) << 8 | np.frexp(self.sizes[owner].astype(float))[1]
        for c in np.unique(kind):
            use = kind == c
            held, values = owner[use], value[use]
            order = np.lexsort((held, values))
            held, values = held[order], values[order]
            distinct, start = np.unique(values, return_index=True)
            probe = np.zeros(1 << _PROBE_BITS, bool)
            probe[distinct >> np.uint64(64 - _PROBE_BITS)] = True
            self.partitions.append(Partition(int(c) >> 8, int(self.needs[held].min()), distinct, np.append(start, len(values)), held, probe))
        self._sets: dict[int, set] = {}

    def shingles(self, i: int) -> set[tuple[bytes, ...]]:
        """The exact shingles of an item; those of the last few are kept."""
        if i not in self._sets:
            if len(self._sets) >= KEPT_SETS:
                self._sets.clear()
            self._sets[i] = shingles_of(words_of(self.texts[i].as_py()), int(self.lengths[i]))
        return self._sets[i]

    def find(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """Per text the contained items, as (position of the item, shared shingles, all of the item's)."""
        hashes, first, _, _ = word_hashes(texts, _TABLE)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        sizes = np.diff(first)
        runs = {k: fold(hashes, k) for k in {p.k for p in self.partitions}}
        hits: dict[int, Counter] = defaultdict(Counter)
        for part in self.partitions:
            run = runs[part.k]
            at = np.flatnonzero(part.probe[run >> np.uint64(64 - _PROBE_BITS)])
            place = np.searchsorted(part.values, run[at])
            same = part.values[np.minimum(place, len(part.values) - 1)] == run[at]
            at, place = at[same], place[same]
            owner = np.searchsorted(first, at, side="right") - 1
            inside = (at + part.k <= first[owner + 1]) & (sizes[owner] - part.k + 1 >= part.need)
            for text, value in set(zip(owner[inside].tolist(), place[inside].tolist())):
                hits[text].update(part.items[part.first[value] : part.first[value + 1]].tolist())
        for text, counts in hits.items():
            likely = sorted(i for i, n in counts.items() if n >= self.needs[i])
            if likely:
                words = words_of(texts[text])
                own = {k: shingles_of(words, k) for k in {int(self.lengths[i]) for i in likely}}
                for i in likely:
                    item = self.shingles(i)
                    shared = len(item & own[int(self.lengths[i])])
                    if 100 * shared >= PERCENT * len(item):
                        found[text].append((i, shared, len(item)))
        return found


def item_blocks(items: DataFrame, item_id: Column, text: Column, limit: int = BLOCK_BYTES) -> Iterator[ItemBlock]:
    """The benchmark in parts of about ``limit`` bytes; each is read, used and given up in turn."""
    rows = items.select(item_id.cast("long").alias("i"), F.coalesce(text, F.lit("")).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    count = -(-size // limit)
    for b in range(count):
        part = rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == b).toArrow().combine_chunks()
        yield ItemBlock(part["i"].combine_chunks(), lowered(part["t"].combine_chunks()).cast(pa.binary()))


def found_in(docs: DataFrame, text: str, block: ItemBlock, name: str) -> DataFrame:
    """``docs`` with a column ``name`` of the items of ``block`` that column ``text`` contains."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    row = pa.struct([("item_id", pa.int64()), ("shared", pa.int64()), ("n_item", pa.int64())])

    def find(text: pa.Array) -> pa.Array:
        block = shared.value
        out = []
        for _, texts in slices(lowered(text)):
            out += [[{"item_id": block.ids[i].as_py(), "shared": n, "n_item": size} for i, n, size in found] for found in block.find(texts)]
        return pa.array(out, pa.list_(row))

    return appended(docs, text, name, FOUND, find)


def contained(docs: DataFrame, doc_id: Column, text: Column, items: DataFrame, item_id: Column, item_text: Column) -> DataFrame:
    """One row per document and contained item: doc_id, item_id, shared, n_item, containment."""
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"))
    parts = []
    for block in item_blocks(items, item_id, item_text):
        found = found_in(rows, "text", block, "found").select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")
        parts.append(found if not parts else materialise(found, "contained"))
    if not parts:
        parts = [rows.select("doc_id", *(F.lit(None).cast("long").alias(c) for c in ("item_id", "shared", "n_item"))).filter(F.lit(False))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("containment", F.col("shared") / F.col("n_item"))


def without_items(docs: DataFrame, text: str, items: DataFrame, item_id: Column, item_text: Column) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns."""
    for n, block in enumerate(item_blocks(items, item_id, item_text)):
        docs = found_in(docs, text, block, "__found").filter(F.size("__found") == 0).drop("__found")
        if n:
            docs = materialise(docs, "clean")
    return docs
