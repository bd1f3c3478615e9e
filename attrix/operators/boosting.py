"""Second-order boosted trees (M6): histograms of gradients and Hessians, Newton leaf weights.

Rows are binned once: a feature of few different values has a bin for each, another has bins between its quantiles. Up to
``TASK_ROWS`` rows a task for each model holds them as bytes and grows all its trees. Beyond that each
level of a tree takes one sweep over the packed rows, which adds up the gradient and the Hessian of the log loss by (model,
node, bin); every node's split is picked from these sums on the executors, so that the driver gets a few numbers a node
whatever the rows and bins, and leaf weights are -G / (H + l2), shrunk by the rate. Models
that differ in the rows they leave out (folds) grow together in the same sweeps. Margins stay with the rows; one bounded
array of trees is all that moves to them. Every ``CHECKPOINT`` rounds the rows' lineage is cut in the shared folder.

A missing value (NaN) has a bin of its own and goes to the side that gains more. Ties go to missing values on the right, then
to the first feature, then to the lowest cut.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import packed_rows, reduced, total

CHECKPOINT = 20
MAX_BINS = 255
#: Rows of a model that one task may hold (about 100 bytes each, 400 MB).
TASK_ROWS = 1 << 22
#: A split must gain more than this.
LEAST_GAIN = 1e-6


@dataclass
class BoostSettings:
    rounds: int = 300
    depth: int = 4
    rate: float = 0.1
    l2: float = 1.0
    min_child_hessian: float = 1.0
    positive_weight: float = 1.0


@dataclass
class Tree:
    """Nodes in heap order: feature (-1: a leaf), cut (values below it go left), side of missing values, leaf weight."""

    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    weight: np.ndarray

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        for _ in range(int(np.log2(len(self.feature) + 1)) - 1):
            f = self.feature[at]
            v = x[np.arange(len(x)), np.maximum(f, 0)]
            left = np.where(np.isnan(v), self.missing_left[at], v < self.cut[at])
            at = np.where(f < 0, at, 2 * at + 2 - left)
        return at


@dataclass
class BoostedModel:
    base: float
    trees: list[Tree] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += t.weight[t.leaf(x)]
        return out

    def to_dict(self) -> dict:
        return {"base": self.base, "trees": [{k: getattr(t, k).tolist() for k in ("feature", "cut", "missing_left", "weight")}
                                             for t in self.trees]}

    @staticmethod
    def from_dict(d: dict) -> BoostedModel:
        return BoostedModel(d["base"], [Tree(**{k: np.array(v) for k, v in t.items()}) for t in d["trees"]])

    def importances(self, width: int) -> np.ndarray:
        """Share of splits of each feature."""
        n = np.zeros(width)
        for t in self.trees:
            np.add.at(n, t.feature[t.feature >= 0], 1)
        return n / max(1.0, n.sum())


def cut_points(df: DataFrame, features: str, width: int, max_bins: int = MAX_BINS) -> list[np.ndarray]:
    """Each feature's cuts in ascending order: all values but the least where there are few, quantiles otherwise."""
    long = df.select(F.posexplode(features).alias("idx", "value")).where("value is not null and not isnan(value)")
    values = long.groupBy("idx", "value").count()
    # a number a feature; joins instead would send all rows to the driver, as repeated values look small once compressed
    kinds = {r["idx"]: r["n"] for r in values.groupBy("idx").agg(F.count("*").alias("n")).collect()}
    few, many = [i for i, n in kinds.items() if n <= max_bins], [i for i, n in kinds.items() if n > max_bins]
    cuts: list[np.ndarray] = [np.zeros(0)] * width
    if few:
        listed = values.where(F.col("idx").isin(few)).groupBy("idx").agg(F.array_sort(F.collect_list("value")).alias("v"))
        for r in listed.collect():  # max_bins a feature
            cuts[r["idx"]] = np.array(r["v"][1:])
    if many:
        probs = [k / max_bins for k in range(1, max_bins)]
        rest = long.where(F.col("idx").isin(many)).groupBy("idx").agg(F.percentile_approx("value", probs, 100 * max_bins).alias("v"))
        for r in rest.collect():
            cuts[r["idx"]] = np.unique(r["v"])
    return cuts


class _Bins:
    """Slots of all (feature, bin) pairs side by side; each feature's last slot is for missing values."""

    def __init__(self, cuts: Sequence[np.ndarray]):
        self.cuts = list(cuts)
        self.sizes = np.array([len(c) + 2 for c in cuts])
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self.slots = int(self.first[-1])

    def of(self, x: np.ndarray) -> np.ndarray:
        return self.first[:-1].astype(np.int32) + self.numbers(x)

    def numbers(self, x: np.ndarray) -> np.ndarray:
        """Each value's place among its feature's slots, as bytes where they are enough."""
        out = np.zeros(x.shape, np.uint8 if self.sizes.max(initial=0) <= 256 else np.int32)
        for f, c in enumerate(self.cuts):
            if len(c):
                v = np.ascontiguousarray(x[:, f])
                out[:, f] = v >= c[0] if len(c) == 1 else np.searchsorted(c, v, side="right")
        row, f = np.nonzero(np.isnan(x))
        out[row, f] = self.sizes[f] - 1
        return out


@dataclass
class _Rows:
    """A block: slots of its rows, class, and weights and margins by model."""

    slots: np.ndarray
    y: np.ndarray
    weight: np.ndarray
    margin: np.ndarray


def _nodes(rows: _Rows, splits: list[dict], bins: _Bins, model: int) -> np.ndarray:
    """Heap number of the node each row stands in, after the splits made so far."""
    at = np.zeros(len(rows.y), int)
    for level in splits:
        feature, cut, missing_left = level["feature"][model], level["cut"][model], level["missing_left"][model]
        f = feature[at]
        slot = rows.slots[np.arange(len(at)), np.maximum(f, 0)] - bins.first[np.maximum(f, 0)]
        missing = slot == bins.sizes[np.maximum(f, 0)] - 1
        left = np.where(missing, missing_left[at], slot <= cut[at])
        at = np.where(f < 0, at, 2 * at + 2 - left)
    return at


def _histogram(rows: _Rows, splits: list[dict], bins: _Bins, level: int) -> np.ndarray:
    """(model, 2, node of the level, slot) sums of gradient and Hessian over one block."""
    models, first, count = len(rows.margin), (1 << level) - 1, 1 << level
    out = np.zeros((models, 2, count, bins.slots))
    for m in range(models):
        at = _nodes(rows, splits, bins, m) - first
        own = np.flatnonzero((at >= 0) & (rows.weight[m] > 0))
        p = 1 / (1 + np.exp(-rows.margin[m][own]))
        w = rows.weight[m][own]
        key = (at[own, None] * bins.slots + rows.slots[own]).ravel()
        width = rows.slots.shape[1]
        for k, v in enumerate((w * (p - rows.y[own]), w * p * (1 - p))):
            out[m, k] = np.bincount(key, np.repeat(v, width), count * bins.slots).reshape(count, bins.slots)
    return out


def _node_sums(v: np.ndarray, bins: _Bins) -> np.ndarray:
    """Gradient and Hessian of every node; the slots of one feature hold every row once."""
    return v[:, :, :int(bins.sizes[0])].sum(axis=2).T


def _left_sums(v: np.ndarray, bins: _Bins) -> np.ndarray:
    """For every slot the sum of its feature's slots up to it."""
    running = np.cumsum(v, axis=1)
    before = np.concatenate([np.zeros((len(v), 1)), running], axis=1)[:, bins.first[:-1]]
    return running - np.repeat(before, bins.sizes, axis=1)


def best_splits(g: np.ndarray, h: np.ndarray, bins: _Bins, s: BoostSettings) -> tuple[np.ndarray, ...]:
    """For each row of histograms (node): feature (-1: none gains), cut (last bin on the left), side of missing values, and
    the left side's sums."""
    gl, hl = _left_sums(g, bins), _left_sums(h, bins)
    whole = slice(0, int(bins.sizes[0]))
    all_g, all_h = g[:, whole].sum(axis=1)[:, None], h[:, whole].sum(axis=1)[:, None]
    missing = bins.first[1:] - 1
    cuts = np.ones(bins.slots, bool)
    cuts[missing] = cuts[missing - 1] = False  # nothing lies beyond a feature's last bin
    best = None
    for missing_left in (False, True):
        if missing_left:
            if not h[:, missing].any():
                break
            gl = gl + np.repeat(g[:, missing], bins.sizes, axis=1)
            hl = hl + np.repeat(h[:, missing], bins.sizes, axis=1)
        gr, hr = all_g - gl, all_h - hl
        gain = (gl ** 2 / (hl + s.l2) + gr ** 2 / (hr + s.l2) - all_g ** 2 / (all_h + s.l2)) / 2
        gain = np.where(cuts & (hl >= s.min_child_hessian) & (hr >= s.min_child_hessian), gain, -np.inf)
        most = np.where(np.isfinite(gain).any(axis=1), gain.max(axis=1), -np.inf)
        near = np.where(np.isfinite(most), most - 1e-10 * np.abs(most), -np.inf)  # sums differ in their last digits
        at = (gain >= near[:, None]).argmax(axis=1)
        row = np.arange(len(g))
        side = (most, at, np.full(len(g), missing_left), gl[row, at], hl[row, at])
        if best is None:
            best = side
        else:
            better = most > np.where(np.isfinite(best[0]), best[0] + 1e-10 * np.abs(best[0]), -np.inf)
            best = tuple(np.where(better, new, old) for new, old in zip(side, best))
    most, at, side, left_g, left_h = best
    feature = np.searchsorted(bins.first, at, side="right") - 1
    return np.where(most > LEAST_GAIN, feature, -1), at - bins.first[feature], side, left_g, left_h


class _Sweeps:
    """Rows as blocks over the cluster: a sweep is a job, moved margins are a new state."""

    def __init__(self, blocks: RDD, start):
        self.older, self.state, self.moves = blocks, blocks.map(start).persist(StorageLevel.MEMORY_AND_DISK), 0

    def _kept(self, got):
        if self.older is not None:
            self.older.unpersist()  # the state has been computed and is kept
            self.older = None
        return got

    def total(self, sums) -> np.ndarray | None:
        return self._kept(total(self.state, sums))

    def picked(self, sums, pick, nodes: int) -> tuple[np.ndarray, ...]:
        """What ``pick`` finds for each node in the rows of all sums, picked on the executors."""
        pieces = min(nodes, self.state.context.defaultParallelism)
        return tuple(map(np.concatenate, zip(*self._kept(reduced(self.state, sums, lambda _, part: pick(part), pieces)))))

    def move(self, change) -> None:
        self.older, self.state = self.state, self.state.map(change).persist(StorageLevel.MEMORY_AND_DISK)
        self.moves += 1
        if self.moves % CHECKPOINT == 0:
            self.state.checkpoint()

    def close(self) -> None:
        for kept in (self.older, self.state):
            if kept is not None:
                kept.unpersist()


def _grow(sweeps: _Sweeps, bins: _Bins, s: BoostSettings, models: int) -> tuple[list[dict], list[Tree]]:
    """The next tree of every model, and its splits by level in the form the rows are moved by."""
    size = (2 << s.depth) - 1
    shape = (models, size)
    feature, cut, missing_left = np.full(shape, -1), np.zeros(shape, int), np.zeros(shape, bool)
    sums = np.zeros((2, models, size))  # gradient and Hessian of the nodes
    splits: list[dict] = []
    for level in range(s.depth):
        first, count = (1 << level) - 1, 1 << level
        f, c, side, left_g, left_h, all_g, all_h = sweeps.picked(
            lambda r, done=tuple(splits), at=level: _histogram(r, list(done), bins, at).swapaxes(1, 2).reshape(-1, 2, bins.slots),
            lambda v: (*best_splits(v[:, 0], v[:, 1], bins, s), *_node_sums(v, bins)), models * count)
        if level == 0:
            sums[:, :, 0] = all_g, all_h
        made = {"feature": np.full(shape, -1), "cut": np.zeros(shape, int), "missing_left": np.zeros(shape, bool)}
        m, node = np.divmod(np.flatnonzero(f >= 0), count)
        won, at = m * count + node, first + node
        for name, value in (("feature", f), ("cut", c), ("missing_left", side)):
            made[name][m, at] = value[won]
        left = np.stack([left_g[won], left_h[won]])
        sums[:, m, 2 * at + 1], sums[:, m, 2 * at + 2] = left, sums[:, m, at] - left
        splits.append(made)
        feature, cut, missing_left = (np.where(made["feature"] >= 0, made[k], old) for k, old in
                                      (("feature", feature), ("cut", cut), ("missing_left", missing_left)))
        if not (made["feature"] >= 0).any():
            break
    weight = np.where(feature < 0, -s.rate * sums[0] / (sums[1] + s.l2), 0.0)
    trees = [Tree(feature[m], np.array([bins.cuts[f][c] if f >= 0 else 0.0 for f, c in zip(feature[m], cut[m])]), missing_left[m], weight[m])
             for m in range(models)]
    return splits, trees


def _boost(sweeps: _Sweeps, bins: _Bins, s: BoostSettings, models: int) -> list[BoostedModel]:
    sums = sweeps.total(lambda r: np.stack([(r.weight * (0.5 - r.y)).sum(axis=1), r.weight.sum(axis=1) / 4]))
    if sums is None or not bins.cuts:
        return [BoostedModel(0.0) for _ in range(models)]
    base = np.divide(-sums[0], sums[1], out=np.zeros(models), where=sums[1] > 0)  # one Newton step from even odds
    grown = [BoostedModel(float(b)) for b in base]
    sweeps.move(lambda r: _Rows(r.slots, r.y, r.weight, r.margin + base[:, None]))
    for _ in range(s.rounds):
        splits, trees = _grow(sweeps, bins, s, models)
        for model, tree in zip(grown, trees):
            model.trees.append(tree)
        weights = np.stack([tree.weight for tree in trees])
        if not weights.any():
            break

        def moved(r: _Rows, splits=splits, weights=weights) -> _Rows:
            margin = np.stack([r.margin[m] + weights[m][_nodes(r, splits, bins, m)] for m in range(len(r.margin))])
            return _Rows(r.slots, r.y, r.weight, margin)

        sweeps.move(moved)
    return grown


class _Columns:
    """Rows of one model as columns of bytes: eight features of two bins share a byte, which is counted once for all of them."""

    def __init__(self, parts: list[np.ndarray], bins: _Bins):
        self.bins = bins
        missing = np.zeros(len(bins.sizes), bool)
        for slots in parts:
            missing |= (slots == bins.sizes - 1).any(axis=0)
        two = (bins.sizes <= 3) & ~missing
        self.bits, self.bytes = np.flatnonzero(two), np.flatnonzero(~two)
        self.held = [np.concatenate([slots[:, f] for slots in parts]) for f in self.bytes]
        self.held += [np.concatenate([np.packbits(slots[:, self.bits[at:at + 8]], axis=1)[:, 0] for slots in parts])
                      for at in range(0, len(self.bits), 8)]
        self.shared = (np.arange(256)[:, None] >> np.arange(7, -1, -1) & 1).astype(float)

    def histogram(self, rows: np.ndarray | None, weights: Sequence[np.ndarray]) -> np.ndarray:
        """Sums of each of ``weights`` (one number a row of ``rows``; None: all) by slot."""
        out = np.zeros((len(weights), self.bins.slots))
        for k, column in enumerate(self.held):
            key = (column if rows is None else column[rows]).astype(np.intp)
            sums = [np.bincount(key, w, 256) for w in weights]
            if k < len(self.bytes):
                f = self.bytes[k]
                out[:, self.bins.first[f]:self.bins.first[f + 1]] = np.stack(sums)[:, :self.bins.sizes[f]]
                continue
            at = self.bins.first[self.bits[8 * (k - len(self.bytes)):][:8]]
            one = (np.stack(sums) @ self.shared)[:, :len(at)]
            two = self.bins.sizes[self.bits[8 * (k - len(self.bytes)):][:8]] == 3
            out[:, at] = np.stack([w.sum() for w in sums])[:, None] - one
            out[:, at[two] + 1] = one[:, two]
        return out

    def left(self, rows: np.ndarray, feature: int, cut: int, missing_left: bool) -> np.ndarray:
        """Which of ``rows`` go left."""
        place = np.searchsorted(self.bits, feature)
        if place < len(self.bits) and self.bits[place] == feature:
            return self.held[len(self.bytes) + place // 8][rows] & (128 >> place % 8) == 0
        slot = self.held[np.searchsorted(self.bytes, feature)][rows]
        left = slot <= cut
        return left | (slot == self.bins.sizes[feature] - 1) if missing_left else left


def _alone(blocks: Iterable, left_out: int, bins: _Bins, s: BoostSettings) -> BoostedModel:
    """One model over (bins, (label, fold)) of all blocks, in one task.

    Gradients and Hessians are rounded to a power of two at which all their sums are exact. So the order of the rows doesn't matter,
    and of two children only the smaller one's rows are added up: the other has what remains of its parent.
    """
    slots, labels = [], []
    for numbers, other in blocks:
        own = (other[:, 1] != left_out) & ((other[:, 0] != 1) | (s.positive_weight > 0))
        slots.append(numbers[own])
        labels.append(other[own, 0] == 1)
    if not slots or not bins.cuts:
        return BoostedModel(0.0)
    columns, y = _Columns(slots, bins), np.concatenate(labels).astype(float)
    slots.clear()
    n, positive, weight = len(y), y.sum(), np.where(y == 1, s.positive_weight, 1.0)
    whole = n - positive + s.positive_weight * positive
    base = (s.positive_weight * positive - (n - positive)) / 2 / (whole / 4) if n else 0.0
    unit = 2.0 ** (51 - np.ceil(np.log2(max(2.0, n * max(1.0, s.positive_weight)))))
    model, margin, every = BoostedModel(float(base)), np.full(n, base), np.arange(n, dtype=np.int32)
    for _ in range(s.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = (np.rint(v * unit) / unit for v in (weight * (p - y), weight * p * (1 - p)))
        tree, leaves = _grow_alone(columns, every, g, h, bins, s)
        model.trees.append(tree)
        if not tree.weight.any():
            break
        for at, rows in leaves.items():
            margin[rows] += tree.weight[at]
    return model


def _grow_alone(columns: _Columns, every: np.ndarray, g: np.ndarray, h: np.ndarray, bins: _Bins, s: BoostSettings) -> tuple[Tree, dict]:
    """The next tree, and the rows of each of its leaves."""
    size = (2 << s.depth) - 1
    tree = Tree(np.full(size, -1), np.zeros(size), np.zeros(size, bool), np.zeros(size))
    sums, rows = np.zeros((2, size)), {0: every}
    sums[:, 0] = g.sum(), h.sum()
    level = {0: columns.histogram(None, (g, h))} if s.depth else {}  # histograms of the nodes
    for depth in range(s.depth):
        nodes = list(level)
        found = best_splits(*np.stack([level[k] for k in nodes]).swapaxes(0, 1), bins, s)
        below = {}
        for k, f, cut, missing_left, left_g, left_h in zip(nodes, *found):
            if f < 0:
                continue
            tree.feature[k], tree.cut[k], tree.missing_left[k] = f, bins.cuts[f][cut], missing_left
            mine = rows.pop(k)
            left = columns.left(mine, f, cut, missing_left)
            kids = {2 * k + 1: mine[left], 2 * k + 2: mine[~left]}
            sums[:, 2 * k + 1] = left_g, left_h
            sums[:, 2 * k + 2] = sums[:, k] - sums[:, 2 * k + 1]
            rows |= kids
            if depth + 1 < s.depth:
                few, many = sorted(kids, key=lambda c: len(kids[c]))
                below[few] = columns.histogram(kids[few], (g[kids[few]], h[kids[few]]))
                below[many] = level[k] - below[few]
        level = below
        if not level:
            break
    tree.weight[:] = np.where(tree.feature < 0, -s.rate * sums[0] / (sums[1] + s.l2), 0.0)
    return tree, rows


def fit_boosted(df: DataFrame, features: str, label: str, width: int, settings: BoostSettings | None = None, fold: str | None = None,
                leave_out: Sequence[int | None] = (None,), rows: int | None = None,
                cuts: list[np.ndarray] | None = None, in_task: bool | None = None) -> list[BoostedModel]:
    """One model for each entry of ``leave_out`` (a fold whose rows it doesn't see, or None), all grown together.

    Where ``rows`` is given and at most ``TASK_ROWS``, a task for each model holds its rows as bytes and grows all its trees, instead
    of a few jobs for each tree; the models are the same, but for rounding.
    """
    s = settings or BoostSettings()
    bins = _Bins(cut_points(df, features, width) if cuts is None else cuts)
    numbered, fold = (df, fold) if fold is not None else (df.withColumn("fold", F.lit(0)), "fold")
    blocks = packed_rows(numbered, features, [label, fold], width, rows)
    left_out = np.array([-1 if o is None else o for o in leave_out])
    models = len(left_out)

    def start(block, left_out=left_out) -> _Rows:
        x, other = block
        y = (other[:, 0] == 1).astype(float)
        weight = np.where(y == 1, s.positive_weight, 1.0) * (other[:, 1] != left_out[:, None])
        return _Rows(bins.of(x), y, weight, np.zeros(weight.shape))

    if (rows is not None and rows <= TASK_ROWS and bins.sizes.max(initial=0) <= 256) if in_task is None else in_task:
        held = blocks.map(lambda b: (bins.numbers(b[0]), b[1])).persist(StorageLevel.MEMORY_AND_DISK)
        held.count()  # binned where the blocks are
        blocks.unpersist()
        one = held.coalesce(1)

        def alone(left: int) -> RDD:
            return one.mapPartitions(lambda it: [_alone(it, left, bins, s)])

        try:
            return one.context.union([alone(int(left)) for left in left_out]).collect()  # in the order of the models
        finally:
            held.unpersist()
    sweeps = _Sweeps(blocks, start)
    try:
        return _boost(sweeps, bins, s, models)
    finally:
        sweeps.close()


def boosted_probability(features: Column, models: dict[int, BoostedModel], which: Column | None = None) -> Column:
    """Probability of class 1 under the model with the number ``which`` (the only one, without it)."""
    def score(x: pd.Series, of: pd.Series) -> pd.Series:
        rows = np.stack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, 0))
        out = np.zeros(len(x))
        for k, model in models.items():
            own = np.flatnonzero(of.to_numpy() == k)
            if len(own):
                out[own] = 1 / (1 + np.exp(-model.margin(rows[own])))
        return pd.Series(out)

    only = next(iter(models))
    return F.pandas_udf(lambda x, of: score(x, of), "double")(features, F.lit(only) if which is None else which)
