"""Linear-chain conditional random fields over many sequences at once, in numpy.

All sequences of a batch lie one after another in one long chain that is cut into equal lanes. Each lane's
steps are multiplied into one small transfer matrix, all lanes side by side; a short pass over the lanes
gives every lane its true start and end; a second pass inside the lanes then has exact values. So long
and short sequences cost the same per token, and memory follows the batch.
"""

from __future__ import annotations

import numpy as np


def _lanes(scores: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """scores and first as (steps, lanes, ...), padded with neutral one-token sequences."""
    total = len(first)
    lanes = int(min(4096, max(1, np.sqrt(total) * 2)))
    steps = -(-total // lanes)
    pad = steps * lanes - total
    scores = np.concatenate((scores, np.zeros((pad, scores.shape[1])))) if pad else scores
    first = np.concatenate((first, np.ones(pad, bool))) if pad else first
    return np.ascontiguousarray(scores.reshape(lanes, steps, -1).transpose(1, 2, 0)), np.ascontiguousarray(first.reshape(lanes, steps).T), total


def marginals(scores: np.ndarray, first: np.ndarray, trans: np.ndarray, moves: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward. scores: (tokens, states) of log potentials; first: where a sequence begins; trans: log, from row to column.

    Returns each token's state probabilities and, unless moves is false, the expected number of each transition inside sequences.
    """
    states = scores.shape[1]
    if not len(first):
        return np.zeros((0, states)), np.zeros((states, states))
    e, head, total = _lanes(scores - scores.max(axis=1, keepdims=True), first)
    e = np.exp(e)
    a = np.exp(trans)
    steps, _, lanes = e.shape

    def forward_step(v: np.ndarray, t: int) -> np.ndarray:  # v: (..., states, lanes)
        moved = np.stack([sum(v[..., i, :] * a[i, j] for i in range(states)) for j in range(states)], axis=-2)
        moved = np.where(head[t], v.sum(axis=-2, keepdims=True), moved)
        return moved * e[t]

    def backward_step(v: np.ndarray, t: int) -> np.ndarray:
        w = v * e[t]
        moved = np.stack([sum(w[..., j, :] * a[i, j] for j in range(states)) for i in range(states)], axis=-2)
        return np.where(head[t], w.sum(axis=-2, keepdims=True), moved)

    forward = np.broadcast_to(np.eye(states)[:, :, None], (states, states, lanes))
    for t in range(steps):
        forward = forward_step(forward, t)
        forward /= forward.sum(axis=(0, 1))
    backward = np.broadcast_to(np.eye(states)[:, :, None], (states, states, lanes))
    for t in range(steps - 1, -1, -1):
        backward = backward_step(backward, t)
        backward /= backward.sum(axis=(0, 1))
    start, end = np.empty((states, lanes)), np.empty((states, lanes))
    v = np.full(states, 1 / states)
    for k in range(lanes):
        start[:, k] = v
        v = v @ forward[:, :, k]
        v /= v.sum()
    v = np.full(states, 1 / states)
    for k in range(lanes - 1, -1, -1):
        end[:, k] = v
        v = v @ backward[:, :, k]
        v /= v.sum()
    alpha = np.empty((steps, states, lanes))
    v = start
    for t in range(steps):
        v = forward_step(v, t)
        v = v / v.sum(axis=0)
        alpha[t] = v
    out = np.empty((steps, states, lanes))
    pairs = np.zeros((states, states))
    v = end
    for t in range(steps - 1, -1, -1):
        p = alpha[t] * v
        out[t] = p / p.sum(axis=0)
        if moves:
            before = alpha[t - 1] if t else start
            joint = before[:, None, :] * a[:, :, None] * (v * e[t])[None, :, :]
            pairs += (joint / np.maximum(joint.sum(axis=(0, 1)), 1e-300))[:, :, ~head[t]].sum(axis=2)
        v = backward_step(v, t)
        v = v / v.sum(axis=0)
    return out.transpose(2, 0, 1).reshape(-1, states)[:total], pairs


def viterbi(scores: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best state of each token, all sequences together. trans may hold large negative numbers for forbidden moves."""
    states = scores.shape[1]
    if not len(first):
        return np.zeros(0, np.int8)
    e, head, total = _lanes(scores, first)
    steps, _, lanes = e.shape

    def step(v: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:  # v: (..., states, lanes); also where each best came from
        moved = v[..., :, None, :] + np.where(head[t], 0.0, trans[:, :, None])
        came = moved.argmax(axis=-3)
        return np.take_along_axis(moved, came[..., None, :, :], axis=-3)[..., 0, :, :] + e[t], came

    whole = np.where(np.eye(states, dtype=bool)[:, :, None], 0.0, -1e12) + np.zeros((states, states, lanes))
    for t in range(steps):
        whole, _ = step(whole, t)
        whole -= whole.max(axis=(0, 1))
    best, back = np.zeros(states), np.empty((lanes, states), int)
    for k in range(lanes):
        way = best[:, None] + whole[:, :, k]
        back[k] = way.argmax(axis=0)
        best = way.max(axis=0)
        best -= best.max()
    end, begin = np.empty(lanes, int), np.empty(lanes, int)
    at = int(best.argmax())
    for k in range(lanes - 1, -1, -1):
        end[k] = at
        at = begin[k] = back[k][at]
    v = np.where(np.arange(states)[:, None] == begin, 0.0, -1e12)
    came = np.empty((steps, states, lanes), np.int8)
    for t in range(steps):
        v, came[t] = step(v, t)
        v -= v.max(axis=0)
    path = np.empty((steps, lanes), np.int8)
    at, lane = end, np.arange(lanes)
    for t in range(steps - 1, -1, -1):
        path[t] = at
        at = came[t][at, lane]
    return path.T.reshape(-1)[:total]


def fit(features: np.ndarray, labels: np.ndarray, first: np.ndarray, states: int, bins: int, rounds: int = 40, rate: float = 0.3, l2: float = 1e-4, forbidden: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights (bins, states) and log transitions by adaptive gradient ascent on the conditional likelihood.

    features: (tokens, kinds) of bins, bin 0 being unused padding; labels: the states.
    """
    weights, trans = np.zeros((bins, states)), np.zeros((states, states))
    seen_w, seen_t = np.full((bins, states), 1e-8), np.full((states, states), 1e-8)
    used = np.unique(features)
    compact = [np.searchsorted(used, of).astype(np.int32) for of in features.T]  # a column at a time: memory follows the tokens
    truth = np.eye(states)[labels]
    inside = ~first[1:]
    moves = np.zeros((states, states))
    np.add.at(moves, (labels[:-1][inside], labels[1:][inside]), 1)
    total = max(1, len(labels))
    w = np.zeros((len(used), states))
    g2 = np.full_like(w, 1e-8)
    ban = np.zeros((states, states)) if forbidden is None else np.where(forbidden, -1e4, 0.0)
    for _ in range(rounds):
        p, pairs = marginals(sum(w[at] for at in compact), first, trans + ban)
        wrong = truth - p
        for s in range(states):
            g = np.zeros(len(used))
            for at in compact:
                g += np.bincount(at, wrong[:, s], len(used))
            g = g - l2 * total * w[:, s] / len(used)
            g2[:, s] += g * g
            w[:, s] += rate * g / np.sqrt(g2[:, s])
        g = moves - pairs
        seen_t += g * g
        trans += rate * g / np.sqrt(seen_t)
    weights[used] = w
    weights[0] = 0
    del seen_w
    return weights, trans + ban
