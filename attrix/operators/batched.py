"""Many penalised logistic regressions at once.

A search fits one model for each parameter set and fold on the same rows. ``fit_batch`` advances all of them together: a sweep over the
packed rows adds up loss, gradient and Hessian of every model that isn't done, the tasks that hold a model's sums take one
proximal Newton step for it (coordinate descent on the quadratic model, so that an L1 penalty gives exact zeros), and the next
sweep tells by the loss whether the step holds or has to be halved. A sweep's sums are models x (width + 1) * (width + 2) / 2
numbers, added up on the executors; the driver gets models x width numbers whatever the number of rows. A handful of sweeps
replaces hundreds of separate fits. The Hessians of all models are one product of their rows' weights with the rows' pairwise
products of features.

Each model minimises sum(w_i loss_i) + (1 / C) (ratio |b|_1 + (1 - ratio) / 2 |b|^2), the intercept unpenalised, with balanced
class weights over its own rows: those of all folds but its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

import numpy as np
from pyspark import RDD

from .blocks import reduced, total

#: A model is done when its step promises less than this share of its objective.
TOLERANCE = 1e-14
MAX_SWEEPS = 200
#: Models of one sweep, so that a task's sums stay small.
TOGETHER = 512
#: Pairwise products of features that a task holds at once.
PRODUCTS = 1 << 19


@dataclass(frozen=True)
class Problem:
    C: float
    l1_ratio: float
    fold: int | None = None  # rows of this fold are left out


@dataclass
class Fitted:
    problem: Problem
    coefficients: np.ndarray
    intercept: float
    objective: float
    sweeps: int


def class_counts(blocks: RDD, folds: int) -> np.ndarray:
    """Rows by (fold, label); ``blocks`` have (label, fold) beside the matrix."""
    def count(block):
        _, other = block
        return np.bincount((other[:, 1] * 2 + (other[:, 0] == 1)).astype(int), minlength=2 * folds).astype(float)

    got = total(blocks, count)
    return np.zeros((folds, 2)) if got is None else got.reshape(folds, 2)


def balanced(counts: np.ndarray, fold: int | None) -> np.ndarray:
    """Weights of the two classes over all folds but ``fold``; a class without rows gets 0."""
    n = counts.sum(axis=0) - (0 if fold is None else counts[fold])
    return np.divide(n.sum(), 2 * n, out=np.zeros(2), where=n > 0)


def _sums(block, beta: np.ndarray, folds: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """loss, gradient and Hessian of each model over one block, packed in a row a model."""
    x, other = block
    x = np.column_stack([x, np.ones(len(x))])
    y, fold = other[:, 0] == 1, other[:, 1]
    z = x @ beta.T
    weight = np.where(y[:, None], weights[:, 1], weights[:, 0]) * (fold[:, None] != folds)
    margin = np.where(y[:, None], z, -z)
    loss = (weight * np.logaddexp(0, -margin)).sum(axis=0)
    p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
    gradient = (weight * (p - y[:, None])).T @ x
    curve = (weight * p * (1 - p)).T
    left, right = np.triu_indices(x.shape[1])
    hessian, strip = np.zeros((len(beta), len(left))), max(16, PRODUCTS // len(left))
    for at in range(0, len(x), strip):
        rows = x[at:at + strip]
        hessian += curve[:, at:at + strip] @ (rows[:, left] * rows[:, right])
    return np.column_stack([loss, gradient, hessian])


def _symmetric(upper: np.ndarray, d: int) -> np.ndarray:
    """Whole matrices from their upper triangles, one a row."""
    left, right = np.triu_indices(d)
    out = np.empty((len(upper), d, d))
    out[:, left, right] = out[:, right, left] = upper
    return out


def _soft(v: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.sign(v) * np.maximum(np.abs(v) - by, 0)


def proximal_step(beta: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, l1: np.ndarray, l2: np.ndarray, sweeps: int = 20) -> np.ndarray:
    """Minimisers of the penalised quadratic models at ``beta``, one a row; the last coefficient is the intercept.

    A few sweeps of coordinate descent find most signs; the rest is exact. Columns that add up to others leave the quadratic flat
    in some directions, along which coordinate descent alone takes thousands of sweeps.
    """
    k, d = beta.shape
    free = np.arange(d) == d - 1
    lam1, lam2 = np.where(free, 0, l1[:, None]), np.where(free, 0, l2[:, None])
    out, slope = beta.copy(), gradient.copy()
    diagonal = np.maximum(hessian[:, range(d), range(d)] + lam2, 1e-300)
    for _ in range(sweeps):  # always as many, so that a model's step doesn't depend on those it shares a task with
        for j in range(d):
            to = _soft(diagonal[:, j] * out[:, j] - slope[:, j] - lam2[:, j] * out[:, j], lam1[:, j]) / diagonal[:, j]
            move = to - out[:, j]
            out[:, j] = to
            slope += hessian[:, :, j] * move[:, None]
    for m in range(k):
        h = hessian[m] + np.diag(lam2[m])
        out[m] = _exact(out[m], gradient[m] - hessian[m] @ beta[m], h, lam1[m])
    return out


def _exact(b: np.ndarray, linear: np.ndarray, h: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """The minimiser of linear * b + b h b / 2 + sum(lam |b|), from ``b`` on, by active sets; every move lowers the value.

    With the signs held, a move goes to the lowest point, or down a flat direction, as far as the first coefficient that gets to
    0, which is then held there. Where nothing moves any more, the zero whose slope exceeds its penalty most is let go.
    """
    b, sign, d = b.copy(), np.sign(b), len(b)
    noise = 1e-11 * max(1.0, np.abs(np.diag(h)).max(), lam.max())
    for _ in range(20 * d):
        own = np.flatnonzero((sign != 0) | (lam == 0))
        down = -(linear + h @ b)
        pull = down[own] - lam[own] * sign[own]
        values, vectors = np.linalg.eigh(h[np.ix_(own, own)])
        parts, flat = vectors.T @ pull, values <= 1e-11 * max(values[-1], 1e-300) if len(own) else np.zeros(0, bool)
        falls = vectors[:, flat] @ parts[flat]
        if np.abs(falls).max(initial=0.0) > noise:
            move, longest = falls, np.inf
            curve = falls @ h[np.ix_(own, own)] @ falls
            if curve > 0:
                longest = (falls @ falls) / curve
        else:
            move, longest = vectors[:, ~flat] @ (parts[~flat] / values[~flat]), 1.0
        to_zero = np.full(len(own), np.inf)
        towards = (lam[own] > 0) & (move * sign[own] < 0)
        to_zero[towards] = np.abs(b[own][towards] / move[towards])
        step = min(longest, to_zero.min(initial=np.inf))
        if not np.isfinite(step):  # only rounding falls without an end
            return b
        b[own] += step * move
        stops = own[to_zero <= step]
        if len(stops):
            b[stops] = sign[stops] = 0
            continue
        if longest != 1.0 or np.abs(falls).max(initial=0.0) > noise:
            continue
        down = -(linear + h @ b)
        over = np.where((sign == 0) & (lam > 0), np.abs(down) - lam, -np.inf)
        j = int(over.argmax())
        if over[j] <= noise:
            return b
        sign[j] = np.sign(down[j])
    return b


def fit_batch(blocks: RDD, problems: Sequence[Problem], width: int, folds: int, max_sweeps: int = MAX_SWEEPS) -> list[Fitted]:
    """Fits every problem on blocks of (matrix, (label, fold)); ``folds`` is the number of folds, numbered from 0."""
    counts = class_counts(blocks, folds)
    out: list[Fitted] = []
    for at in range(0, len(problems), TOGETHER):
        out += _fit(blocks, list(problems[at:at + TOGETHER]), width, counts, max_sweeps)
    return out


@dataclass
class _Search:
    """Where every model stands: its last point that held, the point tried next, and the step between them."""

    beta: np.ndarray
    trial: np.ndarray
    step: np.ndarray
    promise: np.ndarray
    objective: np.ndarray
    length: np.ndarray
    l1: np.ndarray
    l2: np.ndarray

    def of(self, models) -> _Search:
        return _Search(*(getattr(self, f.name)[models] for f in fields(self)))

    def put(self, models, other: _Search) -> None:
        for f in fields(self):
            getattr(self, f.name)[models] = getattr(other, f.name)

    def penalty(self, b: np.ndarray) -> np.ndarray:
        return self.l1 * np.abs(b[:, :-1]).sum(axis=1) + self.l2 / 2 * (b[:, :-1] ** 2).sum(axis=1)

    def advanced(self, got: np.ndarray) -> tuple[_Search, np.ndarray]:
        """The state after a sweep of these models at ``trial`` that gave the sums ``got``, and which of them are done."""
        d = self.beta.shape[1]
        value = got[:, 0] + self.penalty(self.trial)
        holds = value <= self.objective + 1e-4 * self.length * self.promise + 1e-12 * np.abs(value)
        if holds.any():
            new, gradient = self.of(holds), got[holds, 1:1 + d]
            new.beta, new.objective, new.length = new.trial, value[holds], np.ones(len(gradient))
            to = proximal_step(new.beta, gradient, _symmetric(got[holds, 1 + d:], d), new.l1, new.l2)
            new.step = to - new.beta
            new.promise = (gradient * new.step).sum(axis=1) + new.penalty(to) - new.penalty(new.beta)
            self.put(holds, new)
        self.length[~holds] /= 2
        self.trial = self.beta + self.length[:, None] * self.step
        return self, (self.promise > -TOLERANCE * np.maximum(1, np.abs(self.objective))) | (self.length < 1e-10)


def _fit(blocks: RDD, problems: list[Problem], width: int, counts: np.ndarray, max_sweeps: int) -> list[Fitted]:
    sc, n, d = blocks.context, len(problems), width + 1
    fold = np.array([-1 if p.fold is None else p.fold for p in problems])
    weights = np.stack([balanced(counts, p.fold) for p in problems])
    at = _Search(np.zeros((n, d)), np.zeros((n, d)), np.zeros((n, d)), np.zeros(n), np.full(n, np.inf), np.ones(n),
                 np.array([p.l1_ratio / p.C for p in problems]), np.array([(1 - p.l1_ratio) / p.C for p in problems]))
    sweeps, active = np.zeros(n, int), np.arange(n)
    for _ in range(max_sweeps):
        now, pieces = at.of(active), min(len(active), sc.defaultParallelism)
        shared = sc.broadcast((now, fold[active], weights[active]))
        got = reduced(blocks, lambda b: _sums(b, shared.value[0].trial, *shared.value[1:]), lambda k, sums: shared.value[0].of(
            np.array_split(np.arange(len(shared.value[1])), pieces)[k]).advanced(sums), pieces)
        shared.destroy()
        if not got:  # no rows: nothing moves
            return [Fitted(p, np.zeros(width), 0.0, 0.0, 0) for p in problems]
        sweeps[active] += 1
        for models, (moved, _) in zip(np.array_split(active, pieces), got):
            at.put(models, moved)
        active = active[~np.concatenate([done for _, done in got])]
        if not len(active):
            break
    return [Fitted(p, at.beta[k, :-1].copy(), float(at.beta[k, -1]), float(at.objective[k]), int(sweeps[k]))
            for k, p in enumerate(problems)]
