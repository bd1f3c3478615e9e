"""Random forests of deep trees (M5): wide nodes grown by sweeps, the rest of each tree where its rows are.

Rows are binned once (few values: a bin for each, otherwise bins between quantiles) and packed. Every row counts in every tree as
often as a Poisson draw says, which depends on the seed, the tree and the row's place alone. While a node holds more than
``GROUP_ROWS`` rows of a tree, it is split by sweeps that add up its histograms; the splits are picked on the executors. Then each
row goes once to the (tree, node) it has reached, and a task grows everything below that node from its at most ``GROUP_ROWS``
rows. The subtrees stay in the shared folder as rows of a table, so neither the driver nor any task holds a forest; rows to be scored take
the same way to their subtrees. A row costs a few bytes for each tree, in shuffles of ``TOGETHER`` trees at a time.

As in Spark ML: the root of the number of features, rounded up, is drawn for each node; splits gain most Gini impurity; a node
without a gain is a leaf; two leaves of the same class under one node are merged; a probability is the mean of the leaves'
class shares; importances are gains weighted by rows, normed by tree. Weights belong to classes. Ties go to the feature drawn
first, then to the lowest cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .blocks import packed_rows, reduced
from .boosting import cut_points

GROUP_ROWS = 1 << 20  # about 150 bytes each while a task grows from them
MAX_BINS = 32
#: Rows for which cells are counted at a time, and blocks scored at a time.
STRIP, SCORED = 1 << 14, 32
#: Trees whose rows are shuffled at the same time.
TOGETHER = 50
_MOST = 63  # times a row can count in a tree; a Poisson draw of mean 1 is never near it
_PACK = float(1 << 26)  # of two counts in one number, the one that is multiplied

_NODES = "tree int, part int, feature binary, cut binary, child binary, p binary, w0 double, w1 double, importance array<double>"


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin of each value: the number of cuts at or below it; a missing value lies below all."""
    out = np.zeros(x.shape, np.uint8)
    for f, c in enumerate(cuts):
        if len(c):
            v = np.ascontiguousarray(x[:, f])
            out[:, f] = v >= c[0] if len(c) == 1 else np.searchsorted(c, v, side="right")
    out[np.isnan(x)] = 0
    return out


class _Layout:
    """Binned rows as bytes: features of two bins take a bit, the others a byte."""

    def __init__(self, cuts: list[np.ndarray]):
        two = np.array([len(c) < 2 for c in cuts], bool)
        self.bits, self.bytes, self.width = np.flatnonzero(two), np.flatnonzero(~two), len(cuts)

    def pack(self, b: np.ndarray) -> np.ndarray:
        return np.concatenate([b[:, self.bytes], np.packbits(b[:, self.bits], axis=1)], axis=1)

    def unpack(self, raw: np.ndarray) -> np.ndarray:
        out = np.empty((len(raw), self.width), np.uint8)
        out[:, self.bytes] = raw[:, :len(self.bytes)]
        out[:, self.bits] = np.unpackbits(raw[:, len(self.bytes):], axis=1, count=len(self.bits))
        return out

    def size(self) -> int:
        return len(self.bytes) + -(-len(self.bits) // 8)


def _counts(seed: int, tree: int, block: int, rows: int) -> np.ndarray:
    """How often each row of a block counts in a tree."""
    return np.minimum(np.random.default_rng([seed, tree, block]).poisson(1.0, rows), _MOST)


def _gini(w0, w1):
    n = w0 + w1
    return np.divide(2 * w0 * w1, n * n, out=np.zeros(np.shape(n)), where=n > 0)


def _drawn(rng: np.random.Generator, nodes: int, width: int, of: int) -> np.ndarray:
    """Features drawn for each node."""
    if of >= width:
        return np.tile(np.arange(width), (nodes, 1))
    return np.argpartition(rng.random((nodes, width), np.float32), of - 1, axis=1)[:, :of]


def _best(group: np.ndarray, b: np.ndarray, w0: np.ndarray, w1: np.ndarray, nodes: int, drawn: int):
    """The best cut of each node from the filled bins of its drawn features.

    The arrays hold one entry for each filled bin, ordered by ``group`` (node * drawn + place of the feature) and bin. Gives gain
    (0: none), place of the feature, and the first bin on the right of the cut.
    """
    gain, place, cut = np.zeros(nodes), np.zeros(nodes, int), np.zeros(nodes, int)
    if not len(group):
        return gain, place, cut
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(group))))
    all0, all1 = np.add.reduceat(w0, start), np.add.reduceat(w1, start)
    run0, run1 = np.cumsum(w0), np.cumsum(w1)
    left0, left1 = run0 - (run0[start] - w0[start])[of], run1 - (run1[start] - w1[start])[of]
    right0, right1 = all0[of] - left0, all1[of] - left1
    n, nl, nr = (all0 + all1)[of], left0 + left1, right0 + right1
    last = np.zeros(len(group), bool)
    last[np.append(start[1:], len(group)) - 1] = True
    fits = ~last & (nl > 0) & (nr > 0)
    worth = np.zeros(len(group))
    np.divide(nl * _gini(left0, left1) + nr * _gini(right0, right1), n, out=worth, where=fits)
    worth = np.where(fits, _gini(all0, all1)[of] - worth, 0.0)
    worth[worth < 1e-12] = 0.0  # differences in the last digits
    node = group // drawn
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    most = np.maximum.reduceat(worth, first)
    span = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(node))))
    hits = np.flatnonzero(worth >= most[span] - 1e-12)
    at = hits[np.unique(span[hits], return_index=True)[1]]
    own = node[first]
    gain[own], place[own], cut[own] = most, group[at] % drawn, b[np.minimum(at + 1, len(b) - 1)]
    return gain, place, cut


@dataclass
class _Tree:
    """Nodes of a (sub)tree: feature (-1: a leaf), first bin that goes right, left child (the right one follows it), weights, gain."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    w: np.ndarray
    gain: np.ndarray

    starts: list  # first node of each level

    def _inner(self, level: int) -> np.ndarray:
        first, end = self.starts[level], self.starts[level + 1] if level + 1 < len(self.starts) else len(self.feature)
        return first + np.flatnonzero(self.feature[first:end] >= 0)

    def merge(self) -> None:
        """Joins two leaves of the same class under one node, from the lowest nodes up."""
        positive = self.w[:, 1] > self.w[:, 0]
        for level in reversed(range(len(self.starts))):
            k = self._inner(level)
            c = self.child[k]
            self.feature[k[(self.feature[c] < 0) & (self.feature[c + 1] < 0) & (positive[c] == positive[c + 1])]] = -1

    def importances(self, width: int) -> np.ndarray:
        """Gains weighted by rows, of the nodes that can be reached."""
        out, live = np.zeros(width), np.zeros(len(self.feature), bool)
        live[0] = True
        for level in range(len(self.starts)):
            k = self._inner(level)
            k = k[live[k]]
            live[self.child[k]] = live[self.child[k] + 1] = True
            np.add.at(out, self.feature[k], self.gain[k] * self.w[k].sum(axis=1))
        return out


def _leaf_of(feature: np.ndarray, cut: np.ndarray, child: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The node at which each row ends."""
    out = np.zeros(len(b), np.int64)
    rows, at, flat = np.arange(len(b)) if feature[0] >= 0 else np.zeros(0, int), np.zeros(len(b), np.int64), b.ravel()
    while len(rows):
        value = flat.take(rows * b.shape[1] + feature.take(at))
        at = child.take(at) + (value >= cut.take(at))
        inner = feature.take(at) >= 0
        ends = ~inner
        out[rows[ends]] = at[ends]
        rows, at = rows[inner], at[inner]
    return out


def _cells(b: np.ndarray, sums: np.ndarray, sizes: np.ndarray, pick: np.ndarray, bins: np.ndarray):
    """Filled (node, place, bin) cells of the drawn features in this order: group (node * drawn + place), bin and sum.

    Rows are ordered by node; ``sizes`` are the rows of each node and ``bins`` the bins of each feature. Nodes are taken some
    ``STRIP`` rows at a time, so that what is made of them stays in the cache.
    """
    ends = np.cumsum(sizes)
    cuts = np.unique([0, *np.searchsorted(ends, np.arange(STRIP, len(b), STRIP)), len(sizes)])
    found = [_strip(b[start:end], sums[start:end], sizes[u:v], pick[u:v], bins)
             for u, v, start, end in zip(cuts[:-1], cuts[1:], ends[cuts[:-1]] - sizes[cuts[:-1]], ends[cuts[1:] - 1])]
    group = np.concatenate([g + u * pick.shape[1] for u, (g, _, _) in zip(cuts[:-1], found)])
    return group, np.concatenate([v for _, v, _ in found]), np.concatenate([v for _, _, v in found])


def _strip(b: np.ndarray, sums: np.ndarray, sizes: np.ndarray, pick: np.ndarray, bins: np.ndarray):
    nodes, drawn = pick.shape
    of = bins[pick]
    first = (np.cumsum(of.ravel()) - of.ravel()).reshape(of.shape)
    at, flat, all_ = np.arange(len(b)) * b.shape[1], b.ravel(), int(of.sum())
    if all_ <= 4 * len(b) * drawn:
        cells = np.empty(all_)
        for k in range(drawn):
            own = np.cumsum(of[:, k]) - of[:, k]
            key = np.repeat(own, sizes)
            key += flat.take(np.repeat(pick[:, k], sizes) + at)
            found = np.bincount(key, sums, int(of[:, k].sum()))
            cells[np.repeat(first[:, k] - own, of[:, k]) + np.arange(len(found))] = found
        filled = np.flatnonzero(cells)
        cells = cells[filled]
    else:  # few rows for their bins: runs of equal cells
        key = np.repeat(first, sizes, axis=0) + flat.take(np.repeat(pick, sizes, axis=0) + at[:, None])
        order = np.argsort(key, axis=None)
        key = key.ravel()[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        filled, cells = key[new], np.add.reduceat(np.repeat(sums, drawn)[order], new)
    group = np.repeat(np.arange(nodes * drawn), of.ravel())[filled]
    return group, filled - first.ravel()[group], cells


def grow(b: np.ndarray, y: np.ndarray, counts: np.ndarray, weights: np.ndarray, drawn: int, depth: int, rng: np.random.Generator) -> _Tree:
    """The whole tree of at most ``depth`` levels of splits over binned rows, level by level.

    The rows of nodes that may split are kept in the order of their nodes. A row's count of all rows and of rows of class 1 are
    one number, so that one sum gives both.
    """
    bins = b.max(axis=0, initial=0).astype(np.int64) + 1
    sums = counts + _PACK * (counts * y)
    node, sizes = np.array([sums.sum()]), np.array([len(b)])  # sums of the level's nodes, rows of those that may split
    feature, cut, child, w, gain = [], [], [], [], []
    done = 0

    def classes(packed: np.ndarray) -> np.ndarray:
        one = np.floor(packed / _PACK)
        return np.column_stack([packed - one * _PACK - one, one])

    for level in range(depth + 1):
        n = len(node)
        here = classes(node) * weights
        feat, first, kids, gains = np.full(n, -1), np.zeros(n, int), np.zeros(n, int), np.zeros(n)
        open_ = (here > 0).all(axis=1)
        node = np.zeros(0)
        if level < depth and open_.any():
            pick = _drawn(rng, len(sizes), b.shape[1], drawn)
            group, bin_, cells = _cells(b, sums, sizes, pick, bins)
            by_class = classes(cells) * weights
            g, place, right = _best(group, bin_, by_class[:, 0], by_class[:, 1], len(sizes), drawn)
            won = g > 0
            split = np.flatnonzero(open_)[won]
            best = pick[np.arange(len(pick)), place]
            feat[split], first[split], gains[split] = best[won], right[won], g[won]
            kids[split] = done + n + 2 * np.arange(len(split))
            rows = np.flatnonzero(np.repeat(won, sizes))
            held = sizes[won]
            go_right = b.ravel().take(rows * b.shape[1] + np.repeat(best[won], held)) >= np.repeat(right[won], held)
            to = 2 * np.repeat(np.arange(len(split)), held) + go_right
            node = np.bincount(to, sums[rows], 2 * len(split))
            stay = (classes(node) * weights > 0).all(axis=1)
            if stay.any() and level + 1 < depth:
                if not stay.all():
                    keep = stay[to]
                    rows, to, go_right = rows[keep], to[keep], go_right[keep]
                order, every = _by_child(to, go_right, len(split))
                rows = rows[order]
                b, sums, sizes = b.take(rows, axis=0), sums[rows], every[stay]
        for held, v in ((feature, feat), (cut, first), (child, kids), (w, here), (gain, gains)):
            held.append(v)
        done += n
        if not len(node):
            break
    starts = np.cumsum([0, *map(len, feature[:-1])]).tolist()
    tree = _Tree(*(np.concatenate(v) for v in (feature, cut, child, w, gain)), starts)
    tree.merge()
    return tree


def _by_child(to: np.ndarray, right: np.ndarray, parents: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by child, for rows in the order of their parents, and the rows of each child."""
    every = np.bincount(to, minlength=2 * parents)
    start = np.cumsum(every) - every
    rights = np.cumsum(right)
    before = np.cumsum(every[1::2]) - every[1::2]  # right rows of the parents before
    both = every[::2] + every[1::2]
    lefts_before = np.cumsum(every[::2]) - every[::2]
    place = np.where(right, rights - 1 + np.repeat(start[1::2] - before, both),
                     np.arange(len(to)) - rights + np.repeat(start[::2] - lefts_before, both))
    order = np.empty(len(to), np.int64)
    order[place] = np.arange(len(to))
    return order, every


class _Top:
    """The wide nodes of one tree. Rows that end at one of its leaves are grown on by a task (``part``: the leaf's number)."""

    def __init__(self):
        self.feature, self.cut, self.child, self.depth, self.w, self.gain = [-1], [0], [0], [0], [np.zeros(2)], [0.0]

    def ends(self, b: np.ndarray) -> np.ndarray:
        return _leaf_of(np.array(self.feature), np.array(self.cut), np.array(self.child), b)

    def leaves(self) -> list[int]:
        return [k for k, f in enumerate(self.feature) if f < 0]

    def split(self, k: int, feature: int, cut: int, gain: float, left: np.ndarray, right: np.ndarray) -> list[int]:
        self.feature[k], self.cut[k], self.gain[k], self.child[k] = feature, cut, gain, len(self.feature)
        for w in (left, right):
            for held, v in ((self.feature, -1), (self.cut, 0), (self.child, 0), (self.depth, self.depth[k] + 1), (self.w, w), (self.gain, 0.0)):
                held.append(v)
        return [self.child[k], self.child[k] + 1]


class Forest:
    """An estimator with Spark ML's settings for classes; ``label`` is 0 or 1 and ``weight`` one number a class."""

    def __init__(self, n_trees: int = 300, max_depth: int = 30, seed: int = 42):
        self.n_trees, self.max_depth, self.seed = n_trees, max_depth, seed

    def getMaxDepth(self) -> int:
        return self.max_depth

    def getNumTrees(self) -> int:
        return self.n_trees

    def fit(self, train: DataFrame) -> ForestModel:
        spark = train.sparkSession
        rows = train.select(vector_to_array("features").alias("x"), "label", "weight")
        of = [F.min("weight"), F.max("weight"), F.count(F.lit(1)), F.max(F.size("x"))]
        found = {int(r[0]): r[1:] for r in rows.groupBy((F.col("label") == 1).cast("int")).agg(*of).collect()}
        if any(low != high for low, high, _, _ in found.values()):
            raise ValueError("the rows of a class must have the same weight")
        weights = np.array([found[k][0] if k in found else 0.0 for k in (0, 1)])
        n, width = sum(r[2] for r in found.values()), max((r[3] for r in found.values()), default=0)
        if not width:
            return ForestModel(None, [], [], np.zeros(0))
        cuts = cut_points(rows, "x", width, MAX_BINS)
        packed = packed_rows(rows, "x", ["label"], width, n)
        kept = _numbered(packed, cuts).persist(StorageLevel.MEMORY_AND_DISK)
        kept.count()  # binned once, as every sweep reads all rows
        packed.unpersist()
        path = scratch_path(spark, "forest")
        tops = [_Top() for _ in range(self.n_trees)]
        for at in range(0, self.n_trees, TOGETHER):
            self._grow_some(spark, kept, cuts, weights, n, range(at, min(at + TOGETHER, self.n_trees)), tops, path)
        kept.unpersist()
        return self._finished(spark, tops, cuts, weights, path)

    def _drawn(self, width: int) -> int:
        return int(np.ceil(np.sqrt(width)))

    def _grow_some(self, spark, blocks: RDD, cuts, weights, n: int, trees: range, tops: list[_Top], path: str) -> None:
        sc, width, seed, depth = spark.sparkContext, len(cuts), self.seed, self.max_depth
        drawn, most, layout = self._drawn(width), MAX_BINS + 2, _Layout(cuts)
        wide = [(t, 0) for t in trees] if n > GROUP_ROWS and depth > 0 else []
        while wide:
            pick = np.concatenate([_drawn(np.random.default_rng([seed, t, k, 2]), 1, width, drawn) for t, k in wide])
            shared = sc.broadcast(({t: tops[t] for t, _ in wide}, wide, pick))

            def sums(block) -> np.ndarray:
                number, b, y = block
                tops_, wide_, pick_ = shared.value
                out = np.zeros((len(wide_), drawn * most * 2))
                for t, top in tops_.items():
                    counts, ends = _counts(seed, t, number, len(b)), top.ends(b)
                    place = np.full(len(top.feature), -1)
                    mine = [k for k, (tree, _) in enumerate(wide_) if tree == t]
                    place[[wide_[k][1] for k in mine]] = mine
                    own = np.flatnonzero((place[ends] >= 0) & (counts > 0))
                    node = place[ends[own]]
                    bins = np.take_along_axis(b[own], pick_[node], axis=1)
                    low = mine[0]
                    slot = ((((node - low)[:, None] * drawn + np.arange(drawn)) * most + bins) * 2 + y[own, None]).ravel()
                    out[low:mine[-1] + 1] += np.bincount(slot, np.repeat(counts[own], drawn), len(mine) * drawn * most * 2).reshape(len(mine), -1)
                return out

            def best(_, part: np.ndarray):
                cells = part.reshape(len(part) * drawn * most, 2)
                key = np.flatnonzero(cells.any(axis=1))
                gain, place, cut = _best(key // most, key % most, cells[key, 0] * weights[0], cells[key, 1] * weights[1], len(part), drawn)
                by = part.reshape(len(part), drawn, most, 2)
                won = by[np.arange(len(part)), place]
                left = (won * (np.arange(most) < cut[:, None])[:, :, None]).sum(axis=1)
                return gain, place, cut, left, won.sum(axis=1) - left

            pieces = min(len(wide), 2 * sc.defaultParallelism)
            gain, place, cut, left, right = map(np.concatenate, zip(*reduced(blocks, sums, best, pieces)))
            shared.destroy()
            following = []
            for i, (t, k) in enumerate(wide):
                tops[t].w[k] = left[i] + right[i]
                if gain[i] > 0:
                    kids = tops[t].split(k, int(pick[i, place[i]]), int(cut[i]), float(gain[i]), left[i], right[i])
                    following += [(t, c) for c in kids if tops[t].w[c].sum() > GROUP_ROWS and tops[t].w[c].all() and tops[t].depth[c] < depth]
            wide = sorted(following)

        shared = sc.broadcast({t: tops[t] for t in trees})
        groups = sorted(((t, k) for t in trees for k in tops[t].leaves()), key=lambda g: -tops[g[0]].w[g[1]].sum())
        tasks = min(len(groups), 4 * sc.defaultParallelism)
        task = {g: i % tasks for i, g in enumerate(groups)}

        def routed(it: Iterator) -> Iterator:
            held = list(it)
            if not held:
                return
            b, y = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            raw = layout.pack(b)
            for t, top in shared.value.items():
                counts = np.concatenate([_counts(seed, t, number, len(own)) for number, own, _ in held])
                yield from _sent(t, top.ends(b), np.column_stack([raw, (y << 6 | counts).astype(np.uint8)]), np.flatnonzero(counts > 0))

        def grown(item) -> tuple:
            (t, k), chunks = item
            raw = np.frombuffer(b"".join(chunks), np.uint8).reshape(-1, layout.size() + 1)
            top, last = shared.value[t], raw[:, -1].astype(np.int64)
            tree = grow(layout.unpack(raw[:, :-1]), last >> 6, last & 63, weights, drawn, depth - top.depth[k], np.random.default_rng([seed, t, k, 1]))
            return _stored(t, k, tree, width)

        got = blocks.mapPartitions(routed).groupByKey(tasks, lambda g: task[g]).map(grown)
        spark.createDataFrame(got, _NODES, verifySchema=False).write.mode("append").parquet(path)
        shared.destroy()

    def _finished(self, spark, tops: list[_Top], cuts, weights, path: str) -> ForestModel:
        """Merges leaves of the same class across the borders of tasks, and adds up the importances."""
        width = len(cuts)
        nodes = spark.read.schema(_NODES).parquet(path)
        roots = {(r["tree"], r["part"]): r for r in nodes.select("tree", "part", (F.length("feature") == 2).alias("leaf"), "w0", "w1").collect()}
        by_tree, extra = np.zeros((len(tops), width)), []
        for r in nodes.select("tree", F.posexplode("importance").alias("at", "v")).groupBy("tree", "at").agg(F.sum("v").alias("v")).collect():
            by_tree[r["tree"], r["at"]] = r["v"]
        for t, top in enumerate(tops):
            leaf = {k: roots.get((t, k)) is None or roots[t, k]["leaf"] for k in top.leaves()}
            positive = lambda k: (w := top.w[k] * weights if top.w[k].any() else (roots[t, k]["w0"], roots[t, k]["w1"]))[1] > w[0]
            for k in reversed([k for k, f in enumerate(top.feature) if f >= 0]):
                c = top.child[k]
                if leaf.get(c) and leaf.get(c + 1) and positive(c) == positive(c + 1):
                    top.feature[k], leaf[k] = -1, True
                    w = top.w[k] * weights
                    extra.append(_stored(t, k, _Tree(np.array([-1]), np.zeros(1, int), np.zeros(1, int), w[None], np.zeros(1), [0]), width))
            for k, f in enumerate(top.feature):
                if f >= 0:
                    by_tree[t, f] += top.gain[k] * (top.w[k] * weights).sum()
        if extra:
            spark.createDataFrame(extra, _NODES).write.mode("append").parquet(path)
        sums = by_tree.sum(axis=1, keepdims=True)
        mean = np.divide(by_tree, sums, out=np.zeros(by_tree.shape), where=sums > 0).sum(axis=0)
        return ForestModel(path, tops, cuts, mean / mean.sum() if mean.any() else mean)


def _numbered(blocks: RDD, cuts: list[np.ndarray]) -> RDD:
    """(number, bins, class) of every block; the number is the block's place."""
    def of(part: int, it: Iterator) -> Iterator:
        for k, (x, other) in enumerate(it):
            yield part << 24 | k, binned(x, cuts), (other[:, 0] == 1).astype(np.int64)

    return blocks.mapPartitionsWithIndex(of)


def _sent(t: int, ends: np.ndarray, raw: np.ndarray, own: np.ndarray) -> Iterator:
    """((tree, leaf), bytes) of the rows ``own``, by the leaf of the wide nodes they end at."""
    order = own[np.argsort(ends[own], kind="stable")]
    for rows in np.split(order, np.flatnonzero(np.diff(ends[order])) + 1):
        if len(rows):
            yield (t, int(ends[rows[0]])), raw[rows].tobytes()


def _stored(t: int, k: int, tree: _Tree, width: int) -> tuple:
    share = np.divide(tree.w[:, 1], tree.w.sum(axis=1), out=np.zeros(len(tree.w)), where=tree.w.sum(axis=1) > 0)
    leaf = tree.feature[0] < 0
    parts = [v[:1] if leaf else v for v in (tree.feature.astype(np.int16), tree.cut.astype(np.uint8), tree.child.astype(np.int32), share)]
    return (t, k, *(bytearray(v.tobytes()) for v in parts), float(tree.w[0, 0]), float(tree.w[0, 1]), tree.importances(width).tolist())


@dataclass
class ForestModel:
    """A fitted forest: its wide nodes, and the folder that holds the nodes below them."""

    path: str | None
    tops: list[_Top]
    cuts: list[np.ndarray]
    importance: np.ndarray

    @property
    def featureImportances(self) -> DenseVector:
        return DenseVector(self.importance)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``probability``, the mean of the classes' shares at each tree's leaf."""
        spark, trees = df.sparkSession, len(self.tops)
        if not trees:
            return df.withColumn("probability", array_to_vector(F.array(F.lit(1.0), F.lit(0.0))))
        shared, cuts, layout = spark.sparkContext.broadcast(self.tops), self.cuts, _Layout(self.cuts)
        rows = df.withColumn("forest_row", F.monotonically_increasing_id()).checkpoint()
        blocks = packed_rows(rows.withColumn("x", vector_to_array("features")), "x", ["forest_row"], len(cuts), rows.count())

        def routed(part: int, it: Iterator) -> Iterator:
            for number, (x, _) in enumerate(it):
                b = binned(x, cuts)
                raw = np.column_stack([layout.pack(b), np.arange(len(b), dtype="<u4").view(np.uint8).reshape(-1, 4)])
                for t, top in enumerate(shared.value):
                    for key, sent in _sent(t, top.ends(b), raw, np.arange(len(b))):
                        yield key, (part << 24 | number, sent)

        def scored(item) -> Iterator:
            (t, _), (chunks, nodes) = item
            nodes, chunks = list(nodes), iter(chunks)
            feature, cut, child, p = (np.frombuffer(nodes[0][k], kind) for k, kind in enumerate(("i2", "u1", "i4", "f8")))
            while some := list(islice(chunks, SCORED)):
                raw = np.frombuffer(b"".join(sent for _, sent in some), np.uint8).reshape(-1, layout.size() + 4)
                found = p[_leaf_of(feature, cut, child, layout.unpack(raw[:, :-4]))]
                ids, at = np.ascontiguousarray(raw[:, -4:]).view("<u4").ravel(), 0
                for number, sent in some:
                    end = at + len(sent) // raw.shape[1]
                    yield number, (t, ids[at:end], found[at:end])
                    at = end

        def added(item) -> Iterator:
            number, (found, ids) = item
            ids = next(iter(ids))
            out = np.zeros(len(ids))
            for _, at, p in sorted(found, key=lambda v: v[0]):
                out[at] += p
            return zip(ids.tolist(), (out / trees).tolist())

        tasks = max(4 * spark.sparkContext.defaultParallelism, blocks.getNumPartitions())
        nodes = spark.read.schema(_NODES).parquet(self.path).rdd.map(lambda r: (
            (r["tree"], r["part"]), tuple(bytes(r[c]) for c in ("feature", "cut", "child", "p"))))
        own = blocks.mapPartitionsWithIndex(lambda part, it: ((part << 24 | k, o[:, 0].astype(np.int64)) for k, (_, o) in enumerate(it)))
        sums = blocks.mapPartitionsWithIndex(routed).cogroup(nodes, tasks).flatMap(scored).cogroup(own, tasks).flatMap(added)
        p = spark.createDataFrame(sums, "forest_row long, p double", verifySchema=False).checkpoint()
        blocks.unpersist()
        shape = F.array(1.0 - F.col("p"), F.col("p"))
        return rows.join(p, "forest_row").withColumn("probability", array_to_vector(shape)).drop("forest_row", "p")
