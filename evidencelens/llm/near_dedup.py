"""MinHash near-dedup with HyperMinHash registers.

A document's set of word shingles is hashed into buckets by the leading bits of each hash; a bucket keeps of its smallest remaining
value only the count of leading zeros and the first bits of its mantissa, in one byte. Buckets that a small set leaves empty are
filled by further rounds of hashing, so two sets agree in a register with about their Jaccard similarity at every size.

Eight registers form a band. Documents that agree in a band are tied to the bucket's first document; the ties'
components are the candidate groups, so no pair of a bucket is ever written. Within a group, blocks of documents meet in pairs of blocks,
with their registers only: the agreement, corrected for accidental collisions, selects candidate pairs, of which a meeting proposes a spanning
forest. Proposed pairs are confirmed on the full sets, and what is connected asks no more. Documents that share boilerplate tie large groups
together, but no pair of theirs is a candidate, so none of their texts is moved. Exact copies of a set are one node from the start.

Miss rate of a link: at similarity 0.85 two sets agree in a band with 0.85^8 = 0.27; that all 64 bands differ has
a probability of 1.5e-9. The estimate prunes six standard deviations below the threshold.

Defined results: a document without words (null or empty text) has size 0 and is linked with nothing; fewer words than a shingle
form one shingle; a null id counts as the largest; repeated rows are copies of each other; an empty table gives an empty table;
further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .components import components
from .text import lower_table, mix, shingle_sets, slices

BUCKET_BITS = 9
BUCKETS = 1 << BUCKET_BITS
ZERO_BITS, MANTISSA_BITS = 4, 4
ROWS = 8  # registers of a band: one 64-bit word
ROUNDS = 16
#: Documents of a block, and bytes where a block holds texts, about; a task holds two blocks.
BLOCK, BLOCK_BYTES = 1024, 8 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, buckets) one-byte registers of non-empty sets of 64-bit hashes."""
    n = len(sets)
    value = np.full((n, BUCKETS), _ALL, np.uint64)
    flat_value = value.reshape(-1)
    active = np.arange(n)
    shift = np.uint64(64 - BUCKET_BITS)
    for r in range(ROUNDS):
        if not len(active):
            break
        items = np.concatenate([sets[i] for i in active])
        owner = np.repeat(active, [len(sets[i]) for i in active])
        h = mix(items + np.uint64(r + 1) * _ODD)
        at = owner * BUCKETS + (h >> shift).astype(np.int64)
        rest = h << np.uint64(BUCKET_BITS)
        if r:
            empty = flat_value[at] == _ALL
            at, rest = at[empty], rest[empty]
        np.minimum.at(flat_value, at, rest)
        active = active[(value[active] == _ALL).any(axis=1)]
    for i in active:  # what is still empty: a hash function for each bucket
        empty = np.flatnonzero(value[i] == _ALL)
        value[i, empty] = mix(sets[i][:, None] ^ mix((empty + ROUNDS + 1).astype(np.uint64) * _ODD)[None, :]).min(axis=0)
    exponent = np.frexp(np.maximum(value, 1).astype(np.float64))[1]
    zeros = np.clip(64 - exponent, 0, 63)
    mantissa = (value << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA_BITS)
    top = (1 << ZERO_BITS) - 1
    return ((np.minimum(zeros, top) << MANTISSA_BITS) | mantissa.astype(np.int64)).astype(np.uint8)


def accidental(sizes_a: np.ndarray, sizes_b: np.ndarray) -> np.ndarray:
    """Probability that a register of two unrelated sets of these sizes agrees.

    The smallest of about size/buckets uniform values lies in a register's interval with exp(-lo*load) - exp(-hi*load), given that
    there is one; loads are rounded to powers of two.
    """
    grid = np.exp2(np.arange(-BUCKET_BITS, 16))
    zeros = np.arange(1 << ZERO_BITS)[:, None]
    mantissa = np.arange(1 << MANTISSA_BITS)[None, :]
    low = np.exp2(-1.0 - zeros) * (1 + mantissa / (1 << MANTISSA_BITS))
    high = low + np.exp2(-1.0 - zeros) / (1 << MANTISSA_BITS)
    p = np.stack([((np.exp(-low * g) - np.exp(-high * g)) / -np.expm1(-g)).reshape(-1) for g in grid])
    both = p @ p.T
    place = lambda n: np.clip(np.round(np.log2(np.maximum(n, 1))).astype(int), 0, len(grid) - 1)
    return both[place(sizes_a)[:, None], place(sizes_b)[None, :]] if np.ndim(sizes_a) else both[place(sizes_a), place(sizes_b)]


def _signatures(k: int, minimum: int):
    table = lower_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(2)):
                sets = shingle_sets(texts, table, k)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                keys = [[int.from_bytes(d[i : i + 8], "big", signed=True) if d else None for d in digests] for i in (0, 8)]
                large = [i for i, s in enumerate(sets) if len(s) >= minimum]
                regs: list[bytes | None] = [None] * len(sets)
                for j in range(0, len(large), 256):
                    part = large[j : j + 256]
                    for i, row in zip(part, registers([sets[i] for i in part])):
                        regs[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[0], pa.int64()), pa.array(keys[1], pa.int64()), pa.array(regs, pa.binary())],
                    ["doc_id", "text_hash", "n", "k1", "k2", "regs"],
                )

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bands = BUCKETS // ROWS
    salt = mix(np.arange(1, bands + 1, dtype=np.uint64) * _ODD)
    for batch in batches:
        if not batch.num_rows:
            continue
        regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, BUCKETS)
        keys = mix(regs.view("<u8") + salt[None, :]).view(np.int64)
        nid = np.repeat(np.asarray(batch.column(0)), bands)
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(nid)], ["band", "nid"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by band and node: every further node of a bucket with the bucket's first."""
    band = leader = None
    for batch in batches:
        if not batch.num_rows:
            continue
        bands, nid = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        new = np.concatenate(([band is None or bands[0] != band], bands[1:] != bands[:-1]))
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        leaders = np.where(first >= 0, nid[np.maximum(first, 0)], leader if leader is not None else 0)
        band, leader = bands[-1], leaders[-1]
        ties = np.unique(np.stack([nid[~new], leaders[~new]]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ties[0]), pa.array(ties[1])], ["u", "v"])


class Forest:
    """Union of nodes that are linked, for one block pair."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, j: int) -> None:
        self.parent[self.root(i)] = self.root(j)


def similar_pairs(regs: np.ndarray, sizes: np.ndarray, sides: np.ndarray, labels: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, candidates, estimates): the later documents that the registers may link with i, of other labels; two blocks only meet across ``sides``."""
    cut = percent / 100 - 6 * (percent / 100 * (1 - percent / 100) / BUCKETS) ** 0.5
    across = sides.any()
    for i in range(len(sizes)):
        others = np.arange(i + 1, len(sizes))
        fits = (100 * np.minimum(sizes[i], sizes[others]) >= percent * np.maximum(sizes[i], sizes[others])) & (labels[others] != labels[i])
        others = others[fits & (sides[others] != sides[i] if across else True)]
        if len(others):
            agree = (regs[others] == regs[i]).mean(axis=1)
            chance = accidental(sizes[i : i + 1], sizes[others])[0]
            similar = (agree - chance) / (1 - chance)
            use = similar >= cut
            if use.any():
                yield i, others[use], similar[use]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets are as similar as asked."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common) and common > 0


def _sides(blocks: np.ndarray) -> np.ndarray:
    return (blocks != blocks.min()).astype(np.int8)


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[s] for x in links], pa.int64()) for s in (0, 1)], ["u", "v"])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (part, meeting), the first two columns, by which they are sorted."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        part, meeting = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        edges = np.concatenate(([0], np.flatnonzero((np.diff(part) != 0) | (np.diff(meeting) != 0)) + 1, [batch.num_rows]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if (part[a], meeting[a]) != key:
                if held:
                    yield pa.Table.from_batches(held)
                key, held = (part[a], meeting[a]), []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _met(percent: int, forest: bool):
    """Of the registers of two blocks: a forest of the most similar pairs of different labels, or (u, u) for every node that is in any such pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches):
            if rows.num_rows < 2:
                continue
            nid, block, n, label = (np.asarray(rows[c].combine_chunks()) for c in ("nid", "block", "n", "label"))
            regs = np.frombuffer(b"".join(rows["regs"].to_pylist()), np.uint8).reshape(len(nid), BUCKETS)
            found = similar_pairs(regs, n, _sides(block), label, percent)
            if not forest:
                seen = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.append(others, i) for i, others, _ in found)]))
                yield _pairs([(int(x), int(x)) for x in nid[seen]])
                continue
            names, at = np.unique(label, return_inverse=True)
            union, links = Forest(len(names)), []
            for _, i, j in sorted((-s, i, int(j)) for i, others, estimates in found for j, s in zip(others, estimates)):
                if union.root(at[i]) != union.root(at[j]):
                    union.join(at[i], at[j])
                    links.append((int(nid[i]), int(nid[j])))
            yield _pairs(links)

    return run


def _verified(k: int, percent: int):
    """Of (u, v, text of u, text of v): the pairs that are linked on their full sets."""
    table = lower_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for u, v, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())):
                if linked(*shingle_sets([a.as_py(), b.as_py()], table, k), percent):
                    links.append((u, v))
            yield _pairs(links)

    return run


def _confirm(k: int, percent: int):
    """Links of two blocks from their texts: pairs of different labels in the order of their estimates, until they are connected."""
    table = lower_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches):
            nid, block, label = (np.asarray(rows[c].combine_chunks()) for c in ("nid", "block", "label"))
            _, first = np.unique(nid, return_index=True)  # a repeated row is one node
            if len(first) < 2:
                continue
            rows, nid, block, label = rows.take(pa.array(first)), nid[first], block[first], label[first]
            sets = [s for _, part in slices(rows["text"].combine_chunks()) for s in shingle_sets(part, table, k)]
            regs = np.frombuffer(b"".join(rows["regs"].to_pylist()), np.uint8).reshape(len(nid), BUCKETS)
            names, at = np.unique(label, return_inverse=True)
            union, links = Forest(len(names)), []
            found = similar_pairs(regs, np.array([len(s) for s in sets]), _sides(block), label, percent)
            for _, i, j in sorted((-s, i, int(j)) for i, others, estimates in found for j, s in zip(others, estimates)):
                if union.root(at[i]) != union.root(at[j]) and linked(sets[i], sets[j], percent):
                    union.join(at[i], at[j])
                    links.append((int(nid[i]), int(nid[j])))
            yield _pairs(links)

    return run


def _meetings(members: DataFrame, *columns: str, diagonal: bool = False) -> DataFrame:
    """Rows of (part, block, blocks) once for every pair of blocks that theirs is in, dealt and sorted by it; ``diagonal``: with their own block only."""
    with_ = F.array("block") if diagonal else F.sequence(F.lit(0), F.col("blocks") - 1)
    meet = F.transform(with_, lambda b: F.least(b, "block") * F.col("blocks").cast("long") + F.greatest(b, "block"))
    return members.select("part", F.explode(meet).alias("meeting"), "nid", "block", *columns).repartition("part", "meeting").sortWithinPartitions("part", "meeting")


def _block_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of the links (part, block, u, v) of one block at a time, whose nodes are few: the smallest node of each component."""
    for rows in _grouped(batches):
        ends = np.stack([np.asarray(rows[c].combine_chunks()) for c in ("u", "v")])
        nodes, at = np.unique(ends, return_inverse=True)
        union = Forest(len(nodes))
        for i, j in at.reshape(2, -1).T.tolist():
            union.join(max(union.root(i), union.root(j)), min(union.root(i), union.root(j)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[[union.root(i) for i in range(len(nodes))]])], ["node", "component"])


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``members`` with the component (node, component) that they are in so far."""
    known = labels.select(F.col("node").alias("nid"), F.col("component").alias("__c"))
    return members.join(known, "nid", "left").withColumn("label", F.coalesce("__c", "nid")).drop("__c")


def _connected(members: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, component) of what is linked inside the parts of ``members`` (nid, part, block, blocks, regs, n).

    1. Each block proposes a forest of its most similar pairs by registers alone; only their texts are fetched, pair by pair, and compared.
    2. Blocks meet in pairs, registers only, and propose forests between what is not yet connected.
    3. Nodes that still have a similar node elsewhere (near the threshold, or refuted in the first rounds) meet with their texts.

    A family of near copies is connected after the first two, with two texts a node; documents that share much but are not similar never
    fetch a text.
    """
    pair = lambda found: found.distinct().join(texts.select(F.col("nid").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("nid").alias("v"), F.col("text").alias("b")), "v").select("u", "v", "a", "b")
    columns = ("regs", "n", "label")
    shape = "u long, v long"
    found = _meetings(members.withColumn("label", F.col("nid")), *columns, diagonal=True).mapInArrow(_met(percent, True), shape)
    links = materialise(pair(found).mapInArrow(_verified(shingle, percent), shape), "links")
    home = members.select(F.col("nid").alias("u"), "part", F.col("block").cast("long").alias("block"))
    inside = links.join(home, "u").select("part", "block", "u", "v").repartition("part", "block").sortWithinPartitions("part", "block")
    labels = materialise(inside.mapInArrow(_block_labels, "node long, component long"), "labels")
    rows = materialise(_labelled(members, labels), "members")
    if rows.filter("blocks > 1").limit(1).count():
        found = _meetings(rows.filter("blocks > 1"), *columns).mapInArrow(_met(percent, True), shape)
        links = materialise(links.unionByName(pair(found).mapInArrow(_verified(shingle, percent), shape)), "links")
        labels = materialise(components(links), "labels")
        rows = materialise(_labelled(members, labels), "members")
    left = _meetings(rows, *columns).mapInArrow(_met(percent, False), shape).select(F.col("u").alias("nid")).distinct()
    open_ = materialise(rows.join(left, "nid").drop("block", "blocks").join(texts, "nid"), "open")
    size = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES)).cast("int")
    open_ = open_.join(open_.groupBy("part").agg(size.alias("blocks")), "part").withColumn("block", F.pmod(F.xxhash64("nid"), "blocks").cast("int"))
    last = _meetings(open_, "regs", "label", "text").mapInArrow(_confirm(shingle, percent), shape)
    named = rows.select("nid", "label")
    merged = components(last.join(named.select(F.col("nid").alias("u"), F.col("label").alias("a")), "u").join(named.select(F.col("nid").alias("v"), F.col("label").alias("b")), "v").select(F.col("a").alias("u"), F.col("b").alias("v")))
    joined = merged.select(F.col("node").alias("label"), "component")
    return named.join(joined, "label", "left").select(F.col("nid").alias("node"), F.coalesce("component", "label").alias("component"))


def near_duplicates(docs: DataFrame, doc_id: Column, text: Column, shingle: int = 3, percent: int = 85) -> DataFrame:
    """One row per input row: doc_id, text_hash, n, and the winner (doc_id, text_hash) of its group of linked documents."""
    minimum = -(-percent // (100 - percent))  # smaller sets are linked only if equal
    rows = docs.select(doc_id.cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    signed = materialise(rows.mapInArrow(_signatures(shingle, minimum), "doc_id long, text_hash long, n long, k1 long, k2 long, regs binary"), "signatures")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    nodes = signed.filter("n > 0").groupBy("k1", "k2").agg(F.min(order).alias("best"), F.max("regs").alias("regs"), F.max("n").alias("n"))
    nodes = materialise(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")

    bands = nodes.filter("regs IS NOT NULL").select("nid", "regs").mapInArrow(_bands, "band long, nid long")
    ties = bands.repartition("band").sortWithinPartitions("band", "nid").mapInArrow(_stars, "u long, v long")
    groups = components(ties)
    groups = materialise(groups.select(F.col("node").alias("nid"), F.col("component").alias("part")), "groups")

    sizes = groups.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = groups.join(sizes, "part").join(nodes.select("nid", "regs", "n", F.col("best.doc_id").alias("doc_id"), F.col("best.text_hash").alias("text_hash")), "nid")
    members = materialise(members.withColumn("block", F.pmod(F.xxhash64("nid"), "blocks").cast("int")), "members")
    left, right = members.alias("m"), rows.alias("r")
    texts = left.join(right, (F.col("m.text_hash") == F.col("r.text_hash")) & F.col("m.doc_id").eqNullSafe(F.col("r.doc_id"))).select("nid", "text").dropDuplicates(["nid"])
    found = _connected(members.drop("doc_id", "text_hash"), materialise(texts, "texts"), shingle, percent)

    best = found.join(nodes.select("nid", "best"), found["node"] == F.col("nid")).groupBy("component").agg(F.min("best").alias("best"))
    label = found.join(best, "component").select("node", F.col("best").alias("winner"))
    named = nodes.select("nid", "k1", "k2", "best").join(label, F.col("nid") == F.col("node"), "left").select("k1", "k2", F.coalesce("winner", "best").alias("winner"))
    own = F.struct("doc_id", "text_hash")
    return signed.select("doc_id", "text_hash", "n", "k1", "k2").join(named, ["k1", "k2"], "left").select(
        "doc_id", "text_hash", "n", F.when(F.col("winner").isNull(), own).otherwise(F.struct("winner.doc_id", "winner.text_hash")).alias("winner")
    )


def component_rows(found: DataFrame) -> DataFrame:
    component = F.col("winner.doc_id")
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
