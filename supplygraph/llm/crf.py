"""A linear-chain conditional random field with two labels over binary features."""

from __future__ import annotations

import numpy as np


class ChainCrf:
    """Label 1 is content. ``weights``: features x 2; ``step``: 2 x 2, from the label before."""

    def __init__(self, n_features: int):
        self.weights = np.zeros((n_features, 2))
        self.step = np.zeros((2, 2))

    def scores(self, features: np.ndarray) -> np.ndarray:
        return features @ self.weights

    @staticmethod
    def _padded(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sequence x place x label, from rows in sequence order."""
        seq = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(seq)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out = np.zeros((len(lengths), int(lengths.max(initial=0)), 2))
        out[seq, place] = values
        return out

    def fit(self, features: np.ndarray, labels: np.ndarray, lengths: np.ndarray, rounds: int = 80, rate: float = 0.2, decay: float = 1e-4) -> ChainCrf:
        """Maximum likelihood by Adam over the whole sample; deterministic."""
        keep = lengths > 0
        lengths = lengths[keep]
        if not len(lengths):
            return self
        seq = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(seq)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        gold = np.eye(2)[labels]
        pairs = np.zeros((2, 2))
        same = seq[1:] == seq[:-1]
        np.add.at(pairs, (labels[:-1][same], labels[1:][same]), 1)
        params, n = [self.weights, self.step], len(seq)
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        alive = np.arange(lengths.max())[None, :] < lengths[:, None]
        for t in range(1, rounds + 1):
            node, edge = self._expected(self._padded(self.scores(features), lengths), alive)
            grads = [features.T @ (gold - node[seq, place]) / n - decay * self.weights, (pairs - edge) / n - decay * self.step]
            for p, g, a, b in zip(params, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p += rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-9)
        return self

    def _expected(self, score: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of labels and the expected number of label pairs."""
        m, longest, _ = score.shape
        ahead, back = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        for t in range(1, longest):
            move = np.logaddexp.reduce(ahead[:, t - 1, :, None] + self.step[None], axis=1)
            ahead[:, t] = np.where(alive[:, t, None], move + score[:, t], ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            move = np.logaddexp.reduce(self.step[None] + (score[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
            back[:, t] = np.where(alive[:, t + 1, None], move, back[:, t])
        whole = np.logaddexp.reduce(ahead[:, -1], axis=1)
        node = np.exp(ahead + back - whole[:, None, None])
        edge = np.zeros((2, 2))
        for t in range(1, longest):
            joint = ahead[:, t - 1, :, None] + self.step[None] + (score[:, t] + back[:, t])[:, None, :] - whole[:, None, None]
            edge += np.exp(joint)[alive[:, t]].sum(axis=0)
        return node, edge

    def viterbi(self, features: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best labels of each sequence, all sequences place by place; ties go to content."""
        out = np.ones(int(lengths.sum()), np.int8)
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        if not len(order):
            return out
        size, begin = lengths[order], (np.cumsum(lengths) - lengths)[order]
        score = self.scores(features)
        best, came = score[begin], []
        for t in range(1, int(size[0])):
            n = int(np.searchsorted(-size, -t))  # sequences longer than t stand first
            options = best[:n, :, None] + self.step[None]
            came.append((options[:, 1] >= options[:, 0]).astype(np.int8))
            best = np.concatenate((options.max(axis=1) + score[begin[:n] + t], best[n:]))
        label = (best[:, 1] >= best[:, 0]).astype(np.int8)
        out[begin + size - 1] = label
        for t in range(int(size[0]) - 1, 0, -1):
            n = len(came[t - 1])
            label[:n] = came[t - 1][np.arange(n), label[:n]]
            out[begin[:n] + t - 1] = label[:n]
        return out
