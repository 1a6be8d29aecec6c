"""Exact hard-negative mining with cover trees over norm-augmented vectors.

Every integer vector gets a further component that gives all of them the largest norm, so the inner product with an anchor is a function
of a Euclidean distance, and a covering radius around a tree node's centre bounds the inner products below the node from both sides.

* Rows are dealt to the nearest of a bounded sample of centres, and a cell of any size is cut by a hash into parts of about TREE rows.
  A part becomes one cover tree: a node's children are centres more than half its scale apart, each covers the points within half the
  scale, and the covering radius that is stored is the true one. Single points are leaves of their node.
* Anchors are dealt in blocks; a block meets the trees of each of LANES lanes in a task of its own, so a task holds one block and one
  tree. The nodes of a tree are visited best first; a node is left out for every query whose score window, narrowed by what was found
  so far, lies outside the node's bounds. Leaves are scored exactly, in integers.
* The first descent finds each anchor's positives; their scores make the windows of the second, one query for each positive.

A lane returns the best few rows of a query, so the rows that are shuffled grow with the anchors, not with anchors times rows.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part; a null id comes after all others
in ties; repeated rows are rows of their own (a repeated anchor has its results twice); missing components are 0; an empty table, or
one without anchors, gives an empty table; scores beyond 64 bits are held at the limit; further columns are not read.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

CELLS = 64
#: Rows of a tree, about; anchors of a block, about; tasks that share the trees for one block.
TREE, BLOCK, LANES = 1024, 1024, 16
#: Points of a node that are scored at once.
CHUNK = 256
_NO_ID = np.iinfo(np.int64).max
_LIMIT = (1 << 63) - 1


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Integer rows of a list column, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, ends = np.asarray(column.flatten()), np.asarray(column.offsets)
    ends = ends - ends[0]
    out = np.zeros((len(column), dims), np.int64)
    sizes = np.diff(ends)
    rows = np.repeat(np.arange(len(column)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(ends[:-1], sizes)] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    most = (int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]) if a.size and b.size else 0
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, -_LIMIT, _LIMIT).astype(np.int64)


def augmented(vectors: np.ndarray, top: float) -> np.ndarray:
    """``vectors`` with a component that gives each the squared norm ``top``."""
    x = vectors.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(0.0, top - (x * x).sum(axis=1)))[:, None]])


class CoverTree:
    """Nodes as (centre, radius, children, leaf points); points are positions in the arrays."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, uids: np.ndarray, labels: np.ndarray, top: float):
        self.vectors, self.ids, self.uids, self.labels = vectors, ids, uids, labels
        points = augmented(vectors, top)
        self.centre, self.radius, self.children, self.leaves = [], [], [], []
        todo = [(self._node(0), np.arange(len(points)))]
        while todo:
            node, members = todo.pop()
            away = np.sqrt(((points[members] - points[self.centre[node]]) ** 2).sum(axis=1))
            self.radius[node] = float(away.max(initial=0.0))
            single = []
            if self.radius[node] == 0.0:
                single, members = members.tolist(), members[:0]
            else:
                scale = 2.0 ** np.floor(np.log2(self.radius[node]))
                if scale >= self.radius[node]:
                    scale /= 2
                near = away <= scale  # the node's own centre comes first
                groups = [(self.centre[node], members[near])]
                members = members[~near]
                while len(members):
                    close = ((points[members] - points[members[0]]) ** 2).sum(axis=1) <= scale * scale
                    close[0] = True
                    groups.append((members[0], members[close]))
                    members = members[~close]
                for first, group in groups:
                    if len(group) == 1:
                        single.append(int(group[0]))
                    else:
                        child = self._node(int(first))
                        self.children[node].append(child)
                        todo.append((child, group))
            self.leaves[node] = np.array(single, np.int64)

    def _node(self, centre: int) -> int:
        self.centre.append(centre)
        self.radius.append(0.0)
        self.children.append([])
        self.leaves.append(np.zeros(0, np.int64))
        return len(self.centre) - 1


class Queries:
    """Of each query the best rows so far: a score window, an anchor, and whether labels must agree or differ."""

    def __init__(self, vectors: np.ndarray, uids: np.ndarray, labels: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, keep: int, top: float):
        self.vectors, self.uids, self.labels, self.anchor, self.high, self.same, self.keep, self.top = vectors, uids, labels, anchor, high, same, keep, top
        self.low = low.copy()  # rises to the last score that is kept
        self.norm = (vectors.astype(np.float64) ** 2).sum(axis=1)
        self.found = [np.zeros(0, np.int64) for _ in range(4)]  # query, score, id, uid

    def bounds(self, centres: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) inner products of every anchor with what lies within ``radius`` of each centre."""
        product = products(self.vectors, centres).astype(np.float64)
        norm = self.norm[:, None]
        distance = np.sqrt(np.maximum(0.0, norm + self.top - 2 * product))
        slack = 1e-6 * (np.sqrt(norm) + self.top**0.5) ** 2
        reach = np.sqrt(norm) * radius
        near, far = np.maximum(0.0, distance - radius), distance + radius
        upper = np.minimum((norm + self.top - near * near) / 2, product + reach)
        lower = np.maximum((norm + self.top - far * far) / 2, product - reach)
        return lower - slack, upper + slack

    def alive(self, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        """(queries, nodes): whether a node's bounds meet a query's window."""
        return (upper[self.anchor] >= self.low[:, None]) & (lower[self.anchor] <= self.high[:, None])

    def score(self, tree: CoverTree, points: np.ndarray, queries: np.ndarray) -> None:
        """Takes what fits of ``points`` into the best rows of ``queries``."""
        anchors, back = np.unique(self.anchor[queries], return_inverse=True)
        score = products(self.vectors[anchors], tree.vectors[points])
        fits = (self.labels[anchors][:, None] == tree.labels[points][None, :]) == self.same
        fits &= self.uids[anchors][:, None] != tree.uids[points][None, :]
        wide = score[back]
        ok = fits[back] & (wide >= self.low[queries][:, None]) & (wide <= self.high[queries][:, None])
        q, p = np.nonzero(ok)
        if len(q):
            new = queries[q], wide[q, p], tree.ids[points[p]], tree.uids[points[p]]
            self.found = [np.concatenate(x) for x in zip(self.found, new)]
            self._trim()

    def _trim(self) -> None:
        query, score, ids, uids = self.found
        order = np.lexsort((uids, ids, ~score, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        order = order[rank < self.keep]
        self.found = [x[order] for x in self.found]
        last = rank[rank < self.keep] == self.keep - 1
        self.low[self.found[0][last]] = self.found[1][last]

    def descend(self, tree: CoverTree) -> None:
        """Visits the nodes of ``tree`` that some window meets, those with the highest bound first."""
        radius = np.array(tree.radius)
        lower, upper = self.bounds(tree.vectors[[tree.centre[0]]], radius[:1])
        heap = [(-upper.max(initial=-np.inf), 0, lower[:, 0], upper[:, 0])]
        while heap:
            _, node, lower, upper = heapq.heappop(heap)
            queries = np.flatnonzero(self.alive(lower[:, None], upper[:, None])[:, 0])
            if not len(queries):
                continue
            leaves = tree.leaves[node]
            for i in range(0, len(leaves), CHUNK):
                self.score(tree, leaves[i : i + CHUNK], queries)
            children = np.array(tree.children[node], np.int64)
            if len(children):
                lower, upper = self.bounds(tree.vectors[[tree.centre[c] for c in children]], radius[children])
                for k in np.flatnonzero(self.alive(lower, upper).any(axis=0)):
                    heapq.heappush(heap, (-upper[:, k].max(), int(children[k]), lower[:, k], upper[:, k]))


def _nearest(centres: np.ndarray, dims: int, top: float):
    """The cell of each row: its nearest centre."""
    points = augmented(centres, top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for i in range(0, batch.num_rows, 1024):
                x = augmented(matrix(batch.column(3).slice(i, 1024), dims), top)
                cells.append((-2 * x @ points.T + (points * points).sum(axis=1)).argmin(axis=1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(cells) if cells else np.zeros(0, np.int32))], [*batch.schema.names, "cell"])

    return run


def _trees(dims: int, top: float):
    """One pickled tree for each (cell, part) of rows sorted by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []

        def out() -> pa.RecordBatch:
            rows = pa.Table.from_batches(parts)
            ids, uids, labels = (np.asarray(rows.column(n).combine_chunks()) for n in ("vec_id", "uid", "label"))
            tree = CoverTree(matrix(rows.column("vec"), dims), ids, uids, labels, top)
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([pickle.dumps(tree, 5)], pa.binary())], ["cell", "part", "tree"])

        for batch in batches:
            cells, cuts = np.asarray(batch.column(4)), np.asarray(batch.column(5))
            edges = np.concatenate(([0], np.flatnonzero((np.diff(cells) != 0) | (np.diff(cuts) != 0)) + 1, [len(cells)]))
            for a, b in zip(edges[:-1], edges[1:]):
                if a < b:
                    if (cells[a], cuts[a]) != key:
                        if parts:
                            yield out()
                        key, parts = (cells[a], cuts[a]), []
                    parts.append(batch.slice(a, b - a))
        if parts:
            yield out()

    return run


def _search(dims: int, top: float, keep: int, same: bool):
    """Best rows of the queries of a (block, lane), whose anchors come before its trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, anchors, queries = None, [], None

        def prepared() -> Queries:
            rows = pa.Table.from_batches(anchors)
            windows = rows.column("windows").to_pylist()
            anchor = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
            low, high = (np.array([w[n] for ws in windows for w in ws], np.int64) for n in ("low", "high"))
            uids, labels = (np.asarray(rows.column(n).combine_chunks()) for n in ("uid", "label"))
            made = Queries(matrix(rows.column("vec"), dims), uids, labels, anchor, low, high, same, keep, top)
            made.number = np.concatenate([np.arange(len(w)) for w in windows]).astype(np.int32)
            return made

        def out() -> pa.RecordBatch:
            query, score, ids, uids = queries.found
            cells = [queries.uids[queries.anchor[query]], queries.number[query], score, ids, uids]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["anchor", "number", "score", "id", "uid"])

        for batch in batches:
            blocks, lanes, trees = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for i, this in enumerate(zip(blocks, lanes)):
                if this != key:
                    if queries is not None:
                        yield out()
                    key, anchors, queries = this, [], None
                if not trees[i].is_valid:
                    anchors.append(batch.slice(i, 1))
                elif anchors:
                    queries = queries or prepared()
                    queries.descend(pickle.loads(trees[i].as_py()))
        if queries is not None:
            yield out()

    return run


def _best(trees: DataFrame, anchors: DataFrame, blocks: int, dims: int, top: float, keep: int, same: bool) -> DataFrame:
    """The first ``keep`` rows (anchor, number, score, id, uid, rank) of every query; ``anchors`` have windows array<struct<low,high>>."""
    block = F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int")
    dealt = anchors.select(block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))).alias("lane"), F.lit(None).cast("binary").alias("tree"), "uid", "label", "vec", "windows")
    lane = F.pmod(F.xxhash64("cell", "part"), F.lit(LANES)).cast("int")
    empty = [F.lit(None).cast(t).alias(n) for n, t in (("uid", "long"), ("label", "int"), ("vec", "array<long>"), ("windows", "array<struct<low:long,high:long>>"))]
    shown = trees.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), lane.alias("lane"), "tree", *empty, "cell", "part")
    both = dealt.withColumns({"cell": F.lit(None).cast("int"), "part": F.lit(None).cast("int")}).unionByName(shown)
    both = both.repartition("block", "lane").sortWithinPartitions("block", "lane", F.col("tree").isNotNull(), "cell", "part", "uid").drop("cell", "part")
    found = both.mapInArrow(_search(dims, top, keep, same), "anchor long, number int, score long, id long, uid long")
    order = Window.partitionBy("anchor", "number").orderBy(F.desc("score"), "id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def mine(vectors: DataFrame, vec_id: Column, label: Column, embedding: Column, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256) -> DataFrame:
    """For each anchor and positive the best rows of other labels with low% to high% of the positive's score.

    anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = vectors.sparkSession
    number = lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")
    sound = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    rows = vectors.select(vec_id.cast("long").alias("vec_id"), label.cast("int").alias("label"), embedding.alias("vec"), anchor.alias("anchor"))
    rows = rows.filter(F.col("label").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", sound)).select(
        F.coalesce("vec_id", F.lit(_NO_ID)).alias("vec_id"), F.monotonically_increasing_id().alias("uid"), "label", F.transform("vec", number).alias("vec"), F.coalesce("anchor", F.lit(False)).alias("anchor")
    )
    rows = materialise(rows, "vectors")
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    top, dims, anchors = rows.agg(F.max(square), F.max(F.size("vec")), F.count(F.when(F.col("anchor"), 1))).first()
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not anchors:
        return spark.createDataFrame([], empty)
    blocks = -(-anchors // BLOCK)
    sample = rows.select("vec", F.xxhash64("vec").alias("h"), "uid").orderBy("h", "uid").limit(CELLS).collect()  # bounded
    centres = matrix(pa.array([r.vec for r in sample], pa.list_(pa.int64())), dims)

    celled = materialise(rows.select("vec_id", "uid", "label", "vec").mapInArrow(_nearest(centres, dims, top), "vec_id long, uid long, label int, vec array<long>, cell int"), "cells")
    sizes = celled.groupBy("cell").agg(F.ceil(F.count("*") / TREE).cast("long").alias("parts"))
    dealt = celled.join(F.broadcast(sizes), "cell")  # at most CELLS rows
    dealt = dealt.select("vec_id", "uid", "label", "vec", "cell", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int").alias("part"))
    trees = dealt.repartition("cell", "part").sortWithinPartitions("cell", "part", "uid").mapInArrow(_trees(dims, top), "cell int, part int, tree binary")
    trees = materialise(trees, "trees")

    everything = F.array(F.struct(F.lit(-_LIMIT).alias("low"), F.lit(_LIMIT).alias("high")))
    asking = rows.filter("anchor").select("uid", "vec_id", "label", "vec")
    first = materialise(_best(trees, asking.withColumn("windows", everything), blocks, dims, top, positives, True), "positives")
    lists = first.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("own"))  # at most ``positives`` rows
    floor_ = lambda s: F.ceil(s.cast("decimal(38,0)") * low / 100).cast("long")
    ceiling = lambda s: F.floor(s.cast("decimal(38,0)") * high / 100).cast("long")
    asking = materialise(asking.join(lists, F.col("uid") == F.col("anchor")).withColumn("windows", F.transform("own", lambda p: F.struct(floor_(p.score).alias("low"), ceiling(p.score).alias("high")))), "asking")
    second = _best(trees, asking.select("uid", "label", "vec", "windows"), blocks, dims, top, negatives, False)
    known = lambda c: F.when(c != _NO_ID, c)
    named = asking.select(F.col("uid").alias("anchor"), "vec_id", F.posexplode("own").alias("number", "p"))
    return second.join(named, ["anchor", "number"]).select(
        known(F.col("vec_id")).alias("anchor_id"),
        known(F.col("p.id")).alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        known(F.col("id")).alias("negative_id"),
        F.col("p.score").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
