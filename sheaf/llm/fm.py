"""A binary factorisation machine over sparse rows.

score(x) = w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j, where the double sum is computed in linear time as
(|sum_i v_i x_i|^2 - sum_i |v_i x_i|^2) / 2.  Trained by Adagrad on the logistic loss, the classes weighted alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Rows:
    """Sparse rows: the entries of row r are ``index[start[r]:start[r + 1]]`` and ``value`` likewise; no row is empty."""

    start: np.ndarray
    index: np.ndarray
    value: np.ndarray

    def __len__(self) -> int:
        return len(self.start) - 1

    def take(self, rows: np.ndarray) -> Rows:
        count = np.diff(self.start)[rows]
        start = np.concatenate([[0], np.cumsum(count)])
        at = np.arange(start[-1]) + np.repeat(self.start[:-1][rows] - start[:-1], count)
        return Rows(start, self.index[at], self.value[at])


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    threshold: float = 0.5

    def score(self, x: Rows) -> np.ndarray:
        """The probability of the positive class of each row."""
        if not len(x):
            return np.zeros(0)
        at = x.start[:-1]
        total = self.bias + np.add.reduceat(self.linear[x.index] * x.value, at).astype(np.float64)
        for f in range(self.factors.shape[1]):
            e = self.factors[:, f][x.index] * x.value
            total += 0.5 * (np.add.reduceat(e, at).astype(np.float64) ** 2 - np.add.reduceat(e * e, at))
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


#: Terms whose pairs are counted together, and the chance at which any pair passes that only looks as if it said something.
BLOCK, CHANCE = 1024, 0.01


def _evidence(pos: np.ndarray, seen: np.ndarray, low: np.ndarray | float, high: np.ndarray | float) -> np.ndarray:
    """Minus the logarithm of Chernoff's bound of the chance that ``pos`` or a more extreme count of ``seen`` rows is positive,
    when a share from ``low`` to ``high`` is expected (0 within it)."""
    share = pos / np.maximum(seen, 1)
    expected = np.clip(np.clip(share, low, high), 1e-6, 1 - 1e-6)
    with np.errstate(divide="ignore", invalid="ignore"):
        return pos * np.where(pos > 0, np.log(share / expected), 0) + (seen - pos) * np.where(seen > pos, np.log((1 - share) / (1 - expected)), 0)


def paired(x: Rows, y: np.ndarray, usable: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """Which of the ``usable`` features say something in a pair: rows with both have another share of positive ones than those
    of either (if one is ``marked`` by its own share already, than those of that one).  All pairs are counted, except for those
    with a feature of too few rows to pass with any other."""
    dims = len(usable)
    row, index = np.repeat(np.arange(len(x)), np.diff(x.start)), x.index
    seen, pos = np.bincount(index, minlength=dims), np.bincount(index, y[row], minlength=dims)
    terms, out = int(usable.sum()), np.zeros(dims, bool)
    if terms < 2:
        return out
    need, share, own = np.log(terms * (terms - 1) / 2 / CHANCE), y.mean(), pos / np.maximum(seen, 1)
    order = np.argsort(index, kind="stable")
    row, begin = row[order], np.searchsorted(index[order], np.arange(dims + 1))
    classes = [np.flatnonzero(y == 0), np.flatnonzero(y == 1)]
    place = np.zeros(len(x), np.int64)
    for rows in classes:
        place[rows] = np.arange(len(rows))

    def incidence(features: np.ndarray) -> list[np.ndarray]:
        """Of each class, its rows by these features."""
        m = [np.zeros((len(rows), len(features)), np.float32) for rows in classes]
        for k, f in enumerate(features):
            here = row[begin[f] : begin[f + 1]]
            for c in (0, 1):
                m[c][place[here[y[here] == c]], k] = 1
        return m

    def blocks(features: np.ndarray) -> list[np.ndarray]:
        return [features[low : low + BLOCK] for low in range(0, len(features), BLOCK)]

    def able(low: float, high: float) -> np.ndarray:
        """Unmarked features that can pass if all of their rows of one class, and no others, are the pair's."""
        best = np.maximum(pos * -np.log(np.clip(low, 1e-6, 1)), (seen - pos) * -np.log(np.clip(1 - high, 1e-6, 1)))
        return np.flatnonzero(usable & ~marked & (best >= need))

    def meet(left: np.ndarray, right: np.ndarray, a: list[np.ndarray], b: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> None:
        positive = (a[1].T @ b[1]).astype(np.float64)
        both = positive + a[0].T @ b[0]
        i, j = np.nonzero((positive * -np.log(np.clip(low, 1e-6, 1)) >= need) | ((both - positive) * -np.log(np.clip(1 - high, 1e-6, 1)) >= need))
        good = (left[i] != right[j]) & (_evidence(positive[i, j], both[i, j], low[i, j], high[i, j]) >= need)
        out[left[i[good]]] = True
        out[right[j[good]]] = True

    plain = blocks(able(share, share))
    for n, left in enumerate(plain):
        a = incidence(left)
        for right in plain[n:]:
            low = np.minimum(np.minimum(own[left][:, None], own[right][None]), share)
            high = np.maximum(np.maximum(own[left][:, None], own[right][None]), share)
            meet(left, right, a, a if right is left else incidence(right), low, high)
    known = np.flatnonzero(usable & marked)
    if len(known):
        others = blocks(able(own[known].min(), own[known].max()))
        for left in blocks(known):
            a = incidence(left)
            expected = own[left][:, None]
            for right in others:
                e = np.broadcast_to(expected, (len(left), len(right)))
                meet(left, right, a, incidence(right), e, e)
    return out


def train(x: Rows, y: np.ndarray, dims: int, factors: int = 8, epochs: int = 12, rate: float = 0.1, decay: float = 1e-4, batch: int = 64, least: int = 1, distinctive: float = 0.0, seed: int = 7) -> Machine:
    """Fits ``x`` to ``y`` (0 or 1).  Features of fewer than ``least`` rows get no weight: they would only tell rows apart.
    With ``distinctive``, nor do features whose share of positive rows is within so many standard errors of the overall one,
    unless a pair with another feature says what neither does (each feature then has to be once in a row)."""
    rows_of = np.repeat(y, np.diff(x.start))
    seen, pos = np.bincount(x.index, minlength=dims), np.bincount(x.index, rows_of, minlength=dims)
    known = seen >= least
    if distinctive:
        n, share = len(y), y.mean()
        spread = np.sqrt(np.maximum(seen * share * (1 - share) * (1 - seen / n), 1e-9))
        marked = np.abs(pos - seen * share) >= distinctive * spread
        known &= marked | paired(x, y, known, marked)
    here = known[x.index]
    row = np.repeat(np.arange(len(x)), np.diff(x.start))[here]
    filled = np.flatnonzero(np.bincount(row, minlength=len(x)))
    x = Rows(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(x))[filled])]), x.index[here], x.value[here])
    y = y[filled]
    rng = np.random.default_rng(seed)
    w, v = np.zeros(dims, np.float32), rng.normal(0, 0.02, (dims, factors)).astype(np.float32)
    v[~known] = 0
    gw, gv, b, gb = np.full(dims, 1e-3, np.float32), np.full((dims, factors), 1e-3, np.float32), 0.0, 1e-3
    weight = np.where(y == 1, len(y) / max(1, 2 * (y == 1).sum()), len(y) / max(1, 2 * (y == 0).sum()))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for low in range(0, len(order), batch):
            rows = order[low : low + batch]
            part = x.take(rows)
            at = part.start[:-1]
            row = np.repeat(np.arange(len(rows)), np.diff(part.start))
            e = v[part.index] * part.value[:, None]
            s = np.add.reduceat(e, at, axis=0)
            out = b + np.add.reduceat(w[part.index] * part.value, at) + 0.5 * (s**2 - np.add.reduceat(e * e, at, axis=0)).sum(1)
            g = ((1 / (1 + np.exp(-np.clip(out, -50, 50))) - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
            each = g[row] * part.value
            sort = np.argsort(part.index, kind="stable")
            index = part.index[sort]
            heads = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
            ids = index[heads]
            dw = np.add.reduceat(each[sort], heads) + decay * w[ids]
            dv = np.add.reduceat((each[:, None] * (s[row] - e))[sort], heads, axis=0) + decay * v[ids]
            gw[ids] += dw * dw
            gv[ids] += dv * dv
            w[ids] -= rate * dw / np.sqrt(gw[ids])
            v[ids] -= rate * dv / np.sqrt(gv[ids])
            gb += float(g.sum()) ** 2
            b -= rate * float(g.sum()) / np.sqrt(gb)
    return Machine(b, w, v)


def best_threshold(score: np.ndarray, y: np.ndarray, usual: float = 0.5) -> float:
    """The threshold with the best balanced accuracy on rows that weren't trained on; of equally good ones the middle of
    that gap between scores that lies nearest to the usual one."""
    if not (y == 1).any() or not (y == 0).any():
        return usual
    cuts = np.unique(np.concatenate([[0.0], score, [1.0]]))
    middle = (cuts[1:] + cuts[:-1]) / 2
    pos, neg = np.sort(score[y == 1]), np.sort(score[y == 0])
    good = (1 - np.searchsorted(pos, middle) / len(pos)) + np.searchsorted(neg, middle) / len(neg)
    best = np.flatnonzero(good >= good.max() - 1e-12)
    low, high = cuts[best[0]], cuts[best[-1] + 1]
    return float(usual if low < usual < high else middle[best[np.argmin(np.abs(middle[best] - usual))]])
