"""What linear-chain conditional random fields need: gradients of sequences, and Viterbi decoding."""

from __future__ import annotations

import numpy as np


def slopes(score: np.ndarray, tags: np.ndarray, move: np.ndarray, first: np.ndarray, there: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Observed less expected counts of states at each place, of transitions and of first states.

    score: (sequences, length, states) log scores; tags: (sequences, length) states; there: which places
    are real, for sequences of unequal length that are filled up at their ends.
    """
    n, length, k = score.shape
    there = np.ones((n, length), bool) if there is None else there
    psi, go, begin = np.exp(score - score.max(axis=2, keepdims=True)), np.exp(move), np.exp(first)
    alpha, beta = np.empty_like(psi), np.ones_like(psi)
    state = begin * psi[:, 0]
    for t in range(length):
        if t:
            state = (state @ go) * psi[:, t]
        state = state / state.sum(axis=1, keepdims=True)
        alpha[:, t] = state
    state = np.ones((n, k))
    for t in range(length - 1, 0, -1):
        state = np.where(there[:, t, None], (state * psi[:, t]) @ go.T, 1.0)
        state = state / state.sum(axis=1, keepdims=True)
        beta[:, t - 1] = state
    one = alpha * beta
    one /= one.sum(axis=2, keepdims=True)
    both = alpha[:, :-1, :, None] * go * (psi[:, 1:] * beta[:, 1:])[:, :, None, :]
    both /= both.sum(axis=(2, 3), keepdims=True)
    both *= there[:, 1:, None, None]
    seen = np.eye(k)[tags]
    pairs = np.zeros((k, k))
    np.add.at(pairs, (tags[:, :-1][there[:, 1:]], tags[:, 1:][there[:, 1:]]), 1)
    return (seen - one) * there[..., None], pairs - both.sum(axis=(0, 1)), (seen[:, 0] - one[:, 0]).sum(axis=0)


def viterbi(score: np.ndarray, move: np.ndarray, first: np.ndarray) -> list[int]:
    """The best states of one sequence of (length, states) log scores; of equals, the first state."""
    if not len(score):
        return []
    rows, go, k = score.tolist(), move.tolist(), range(score.shape[1])
    best = [f + s for f, s in zip(first.tolist(), rows[0])]
    back = []
    for row in rows[1:]:
        came = [max(k, key=lambda i: best[i] + go[i][j]) for j in k]
        best = [best[came[j]] + go[came[j]][j] + row[j] for j in k]
        back.append(came)
    state = max(k, key=best.__getitem__)
    out = [state]
    for came in reversed(back):
        state = came[state]
        out.append(state)
    return out[::-1]
