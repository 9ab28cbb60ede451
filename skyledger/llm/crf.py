"""A linear-chain conditional random field over binary features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    """Weights of features, of label pairs in a row, and of the first label."""

    weight: np.ndarray  # features x labels
    follow: np.ndarray  # labels x labels
    first: np.ndarray

    def viterbi(self, features: list[list[int]]) -> np.ndarray:
        """The most probable labels of one sequence of feature lists."""
        if not features:
            return np.zeros(0, np.int64)
        score = np.array([self.weight[f].sum(axis=0) for f in features])
        best, back = score[0] + self.first, []
        for row in score[1:]:
            total = best[:, None] + self.follow
            back.append(total.argmax(axis=0))
            best = total.max(axis=0) + row
        label = int(best.argmax())
        out = [label]
        for pointers in reversed(back):
            label = int(pointers[label])
            out.append(label)
        return np.array(out[::-1])


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def train(sequences: list[tuple[list[list[int]], list[int]]], n_features: int, n_labels: int = 2,
          penalty: float = 1e-3, rounds: int = 150, rate: float = 0.1) -> Chain:
    """Maximise the penalised likelihood by full-batch gradient steps (Adam).

    `sequences` holds feature lists and labels. All are padded to the longest and run forward and
    backward together.
    """
    n, longest = len(sequences), max(len(y) for _, y in sequences)
    x = np.zeros((n, longest, n_features))
    y = np.zeros((n, longest), np.int64)
    real = np.zeros((n, longest), bool)
    for i, (features, labels) in enumerate(sequences):
        real[i, : len(labels)], y[i, : len(labels)] = True, labels
        for t, f in enumerate(features):
            x[i, t, f] = 1.0
    gold = np.eye(n_labels)[y] * real[..., None]
    pairs = np.einsum("ntk,ntl->kl", gold[:, :-1], gold[:, 1:])
    flat = x.reshape(-1, n_features)
    params = [np.zeros((n_features, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for step in range(1, rounds + 1):
        weight, follow, first = params
        score = (flat @ weight).reshape(n, longest, n_labels)
        ahead = np.zeros_like(score)
        behind = np.zeros_like(score)
        ahead[:, 0] = score[:, 0] + first
        for t in range(1, longest):
            moved = _logsum(ahead[:, t - 1, :, None] + follow, 1) + score[:, t]
            ahead[:, t] = np.where(real[:, t, None], moved, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            moved = _logsum(follow + (score[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(real[:, t + 1, None], moved, 0.0)
        total = _logsum(ahead[:, -1], 1)
        single = np.exp(ahead + behind - total[:, None, None]) * real[..., None]
        double = np.exp(ahead[:, :-1, :, None] + follow + (score + behind)[:, 1:, None, :] - total[:, None, None, None])
        double *= real[:, 1:, None, None]
        slopes = [
            flat.T @ (gold - single).reshape(-1, n_labels) / n, (pairs - double.sum(axis=(0, 1))) / n,
            (gold - single)[:, 0].sum(axis=0) / n,
        ]
        for p, g, m in zip(params, slopes, moments, strict=True):
            g = g - penalty * p
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            p += rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return Chain(*params)
