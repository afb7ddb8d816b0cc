"""A semi-Markov conditional random field over candidate segments.

A sequence of ``n`` tokens is cut into segments. Label 0 is outside: one token each, without
features. Every other segment is one of the candidates (begin, end, features), with any
label but 0; the score of a whole segment is the sum of its features' weights for the label.
Pairs of labels of neighbouring segments have weights too. Sums over all segmentations take
time in proportion to tokens and candidates, since a candidate is looked at once."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

Segment = tuple[int, int, tuple[str, ...]]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


@dataclass
class Model:
    """``labels[0]`` is outside. ``rows`` names the rows of ``weights`` (features by labels);
    ``pairs`` has the weights of a label (row) before another."""

    labels: tuple[str, ...]
    rows: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray | None = None
    pairs: np.ndarray | None = None

    def scores(self, segments: list[Segment]) -> np.ndarray:
        """Of each candidate under each label; features that were never trained weigh nothing."""
        out = np.zeros((len(segments), len(self.labels)))
        for k, (_, _, names) in enumerate(segments):
            found = [self.rows[x] for x in names if x in self.rows]
            if found:
                out[k] = self.weights[found].sum(axis=0)
        out[:, 0] = -np.inf
        return out

    def decode(self, n: int, segments: list[Segment]) -> list[tuple[int, int, int]]:
        """The best segmentation: (begin, end, label) of its segments other than outside.
        Of equally good ones, that with the earlier candidates and labels."""
        many, scored = len(self.labels), self.scores(segments)
        best = np.full((n + 1, many), -np.inf)
        best[0, 0] = 0
        came: dict[tuple[int, int], tuple[int, int]] = {}
        ending: dict[int, list[int]] = {}
        for k, (_, end, _) in enumerate(segments):
            ending.setdefault(end, []).append(k)
        into, prior = np.zeros((n + 1, many)), np.zeros((n + 1, many), np.int64)
        for at in range(n + 1):
            if at:
                best[at, 0], came[at, 0] = into[at - 1, 0], (at - 1, int(prior[at - 1, 0]))
                for k in ending.get(at, ()):
                    begin = segments[k][0]
                    total = into[begin] + scored[k]
                    for y in np.flatnonzero(total > best[at]).tolist():
                        if y:
                            best[at, y], came[at, y] = total[y], (begin, int(prior[begin, y]))
            steps = best[at][:, None] + self.pairs
            into[at], prior[at] = steps.max(axis=0), steps.argmax(axis=0)
        at, y, out = n, int(best[n].argmax()), []
        while at:
            begin, before = came[at, y]
            if y:
                out.append((begin, at, y))
            at, y = begin, before
        return out[::-1]

    def marginals(self, n: int, segments: list[Segment]) -> tuple[float, np.ndarray, np.ndarray]:
        """(log of the sum over all segmentations, probability of each candidate under each
        label, expected number of each pair of labels)."""
        many, scored = len(self.labels), self.scores(segments)
        alpha = np.full((n + 1, many), -np.inf)
        alpha[0, 0] = 0
        into = np.zeros((n + 1, many))
        ending: dict[int, list[int]] = {}
        starting: dict[int, list[int]] = {}
        for k, (begin, end, _) in enumerate(segments):
            ending.setdefault(end, []).append(k)
            starting.setdefault(begin, []).append(k)
        for at in range(n + 1):
            if at:
                mine = [into[segments[k][0]] + scored[k] for k in ending.get(at, ())]
                if mine:
                    alpha[at] = _lse(np.array(mine), 0)
                alpha[at, 0] = into[at - 1, 0]
            into[at] = _lse(alpha[at][:, None] + self.pairs, 0)
        total = float(_lse(alpha[n], 0))
        beta, held = np.zeros((n + 1, many)), np.zeros((len(segments), many))
        expected = np.zeros((many, many))
        for at in range(n - 1, -1, -1):
            onward = np.full(many, -np.inf)
            mine = starting.get(at, [])
            if mine:
                ahead = np.array([scored[k] + beta[segments[k][1]] for k in mine])
                onward = _lse(ahead, 0)
                held[mine] = np.exp(into[at] + ahead - total)
            onward[0] = beta[at + 1, 0]
            expected += np.exp(alpha[at][:, None] + self.pairs + onward - total)
            beta[at] = _lse(self.pairs + onward, 1)
        return total, held, expected


def train(labels: tuple[str, ...], examples: list[tuple[int, list[Segment], list[tuple[int, int, int]]]], epochs: int = 6, rate: float = 0.5, ridge: float = 1e-4, seed: int = 0) -> Model:
    """Fits the likelihood of the examples (tokens, candidates, true segments) by steps along
    its gradient, each weight's own rate falling with what it has moved."""
    model = Model(labels)
    for _, segments, _ in examples:
        for _, _, names in segments:
            for x in names:
                model.rows.setdefault(x, len(model.rows))
    model.weights, model.pairs = np.zeros((len(model.rows), len(labels))), np.zeros((len(labels), len(labels)))
    moved, moved_pairs = np.full_like(model.weights, 1e-2), np.full_like(model.pairs, 1e-2)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for e in order.permutation(len(examples)).tolist():
            n, segments, true = examples[e]
            _, held, expected = model.marginals(n, segments)
            change = -expected
            at, last, place = 0, 0, {(i, j): k for k, (i, j, _) in enumerate(segments)}
            for begin, end, y in [*true, (n, n, 0)]:
                for _ in range(at, begin):
                    change[last, 0] += 1
                    last = 0
                if end > begin:
                    change[last, y] += 1
                    held[place[begin, end], y] -= 1
                    last, at = y, end
            for k, (_, _, names) in enumerate(segments):
                rows = [model.rows[x] for x in names]
                step = -held[k] - ridge * model.weights[rows]
                moved[rows] += step**2
                model.weights[rows] += rate * step / np.sqrt(moved[rows])
            moved_pairs += change**2
            model.pairs += rate * change / np.sqrt(moved_pairs)
    return model
