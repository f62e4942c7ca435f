"""Linear chains over many concatenated sequences, in numpy.

All sequences of a chunk stand one after the other; ``begins`` marks where one starts.  The
chain is cut into blocks of equal length.  The transfer matrix of every block is built for
all blocks at once, the block matrices are applied one after the other, and the inner
positions are filled in for all blocks at once.  Results are those of the plain recursions.
"""

from __future__ import annotations

import numpy as np

BLOCK = 256


def _blocked(scores: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(steps, blocks, labels) and (steps, blocks), padded with one-position sequences."""
    n, labels = scores.shape
    blocks = max(1, -(-n // BLOCK))
    full = np.zeros((blocks * BLOCK, labels))
    full[:n] = scores
    first = np.ones(blocks * BLOCK, dtype=bool)
    first[:n] = begins
    return (np.ascontiguousarray(full.reshape(blocks, BLOCK, labels).transpose(1, 0, 2)),
            np.ascontiguousarray(first.reshape(blocks, BLOCK).T))


def forward_backward(scores: np.ndarray, begins: np.ndarray, moves: np.ndarray,
                     start: np.ndarray, pairs: bool = False):
    """Label probabilities of every position; with ``pairs`` also the summed move counts.

    ``scores`` are log potentials (position, label), ``moves`` those of a label after a label.
    """
    n, labels = scores.shape
    if not n:
        return (np.zeros((0, labels)), np.zeros((labels, labels))) if pairs else np.zeros(
            (0, labels))
    scores = scores - scores.max(axis=1, keepdims=True)
    level = max(moves.max(), start.max())
    t, s = np.exp(moves - level), np.exp(start - level)
    e, first = _blocked(scores, begins)
    e = np.exp(e)
    steps, blocks, _ = e.shape
    some = first.any(axis=1)
    matrix = np.broadcast_to(np.eye(labels), (blocks, labels, labels)).copy()
    for k in range(steps):
        after = (matrix.reshape(-1, labels) @ t).reshape(blocks, labels, labels)
        if some[k]:
            f = first[k]
            after[f] = matrix[f].sum(axis=2, keepdims=True) * s
        after *= e[k][:, None, :]
        after /= after.max(axis=(1, 2), keepdims=True)
        matrix = after
    enter = np.empty((blocks, labels))
    leave = np.empty((blocks, labels))
    v = np.full(labels, 1.0 / labels)
    for b in range(blocks):
        enter[b] = v
        v = v @ matrix[b]
        v = v / v.sum()
    v = np.ones(labels)
    for b in range(blocks - 1, -1, -1):
        leave[b] = v
        v = matrix[b] @ v
        v = v / v.max()
    alpha = np.empty_like(e)
    v = enter
    for k in range(steps):
        after = v @ t
        if some[k]:
            f = first[k]
            after[f] = v[f].sum(axis=1, keepdims=True) * s
        v = after * e[k]
        v /= v.sum(axis=1, keepdims=True)
        alpha[k] = v
    both = np.empty_like(e)
    moved = np.zeros((labels, labels))
    v = leave
    for k in range(steps - 1, -1, -1):
        p = alpha[k] * v
        both[k] = p / p.sum(axis=1, keepdims=True)
        w = e[k] * v
        if pairs:
            before = alpha[k - 1] if k else enter
            joint = before[:, :, None] * t[None] * w[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            moved += joint[~first[k]].sum(axis=0)
        v = w @ t.T
        if some[k]:
            f = first[k]
            v[f] = (w[f] @ s)[:, None]
        v /= v.max(axis=1, keepdims=True)
    flat = both.transpose(1, 0, 2).reshape(-1, labels)[:n]
    return (flat, moved) if pairs else flat


def viterbi(scores: np.ndarray, begins: np.ndarray, moves: np.ndarray, start: np.ndarray
            ) -> np.ndarray:
    """The best labels; ties go to the smaller label."""
    n, labels = scores.shape
    if not n:
        return np.zeros(0, dtype=np.int8)
    e, first = _blocked(scores, begins)
    steps, blocks, _ = e.shape
    some = first.any(axis=1)
    matrix = np.full((blocks, labels, labels), -np.inf)
    matrix[:, range(labels), range(labels)] = 0.0
    for k in range(steps):
        after = (matrix[:, :, :, None] + moves).max(axis=2)
        if some[k]:
            f = first[k]
            after[f] = matrix[f].max(axis=2, keepdims=True) + start
        matrix = after + e[k][:, None, :]
    enter = np.empty((blocks, labels))
    v = np.zeros(labels)
    for b in range(blocks):
        enter[b] = v
        v = (v[:, None] + matrix[b]).max(axis=0)
        v = v - v.max()
    back = np.empty((steps, blocks, labels), dtype=np.int8)
    v = enter
    for k in range(steps):
        options = v[:, :, None] + moves
        best = options.argmax(axis=1)
        after = options.max(axis=1)
        if some[k]:
            f = first[k]
            best[f] = v[f].argmax(axis=1)[:, None]
            after[f] = v[f].max(axis=1, keepdims=True) + start
        back[k] = best
        v = after + e[k]
    last = np.empty(blocks, dtype=np.int64)
    label = int(v[-1].argmax())
    for b in range(blocks - 1, -1, -1):
        last[b] = label
        label = int((enter[b] + matrix[b][:, label]).argmax())
    out = np.empty((steps, blocks), dtype=np.int8)
    now, rows = last, np.arange(blocks)
    for k in range(steps - 1, -1, -1):
        out[k] = now
        now = back[k][rows, now]
    return out.T.reshape(-1)[:n]


def adam(parameters: dict[str, np.ndarray], gradient, steps: int, rate: float) -> None:
    """Ascend in place; ``gradient()`` gives a dict of arrays like ``parameters``."""
    first = {k: np.zeros_like(v) for k, v in parameters.items()}
    second = {k: np.zeros_like(v) for k, v in parameters.items()}
    for n in range(1, steps + 1):
        for k, g in gradient().items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            parameters[k] += rate * (first[k] / (1 - 0.9 ** n)) / (
                np.sqrt(second[k] / (1 - 0.999 ** n)) + 1e-8)
