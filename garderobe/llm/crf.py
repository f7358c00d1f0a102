"""Linear-chain conditional random fields in numpy: exact forward-backward over many sequences at once, and training."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

BLOCK = 32


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def messages(score: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(potentials, forward, backward), each up to a factor per position, of sequences laid end to end in ``score``.

    Every sequence has at least one position. Sequences are cut into blocks of BLOCK positions; the transfer matrix of
    each block is computed for all blocks together, a scan over the blocks of a sequence hands on the messages, and a
    second pass fills the blocks. The result is that of the plain recursion, whatever the lengths.
    """
    n, k = score.shape
    emit = np.exp(score - score.max(axis=1, keepdims=True))
    step, first = np.exp(trans - trans.max()), np.exp(start - start.max())
    order = np.argsort(-lengths, kind="stable")
    begin = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    blocks = (size - 1) // BLOCK + 1
    offset = np.cumsum(blocks) - blocks
    seq = np.repeat(np.arange(len(size)), blocks)
    turn = np.arange(blocks.sum()) - offset[seq]
    at = (begin[seq] + turn * BLOCK)[:, None] + np.arange(BLOCK)
    real = (turn * BLOCK)[:, None] + np.arange(BLOCK) < size[seq][:, None]
    e = np.ones((len(seq), BLOCK, k))
    e[real] = emit[at[real]]
    move = np.zeros((len(seq), k, k))
    move[:, range(k), range(k)] = e[:, 0]
    for j in range(1, BLOCK):
        on = real[:, j]
        nxt = (move[on] @ step) * e[on, j][:, None, :]
        move[on] = nxt / nxt.max(axis=(1, 2), keepdims=True)
    before = np.empty((len(seq), k))
    after = np.ones((len(seq), k))
    before[offset] = first
    most = int(blocks.max()) if len(blocks) else 0
    for r in range(1, most):
        b = offset[: np.searchsorted(-blocks, -r)] + r  # sequences with more than r blocks come first
        before[b] = _unit(np.einsum("bi,bij->bj", before[b - 1], move[b - 1]) @ step)
    for r in range(most - 1, 0, -1):
        b = offset[: np.searchsorted(-blocks, -r)] + r
        after[b - 1] = _unit(np.einsum("bij,bj->bi", move[b], after[b]) @ step.T)
    alpha, beta = np.empty((len(seq), BLOCK, k)), np.empty((len(seq), BLOCK, k))
    alpha[:, 0] = _unit(before * e[:, 0])
    for j in range(1, BLOCK):
        alpha[:, j] = _unit((alpha[:, j - 1] @ step) * e[:, j])
    beta[:, -1] = after
    for j in range(BLOCK - 2, -1, -1):
        on = real[:, j + 1]
        beta[:, j] = np.where(on[:, None], _unit((e[:, j + 1] * beta[:, j + 1]) @ step.T), after)
    fore, back = np.empty((n, k)), np.empty((n, k))
    fore[at[real]], back[at[real]] = alpha[real], beta[real]
    return emit, fore, back


def marginals(score: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    _, fore, back = messages(score, lengths, trans, start)
    return _unit(fore * back)


def fit(score_of: Callable, push: Callable, params: list[np.ndarray], gold: np.ndarray, lengths: np.ndarray, k: int, rounds: int, rate: float, decay: float) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Maximum likelihood by Adam over all sequences: (emission parameters, transitions, start scores).

    ``score_of(params)`` gives the state scores of all positions, ``push(errors)`` the gradient of the emission
    parameters from the errors (empirical minus expected) of all positions.
    """
    params = [*params, np.zeros((k, k)), np.zeros(k)]
    moment, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    truth = np.eye(k)[gold]
    firsts = np.cumsum(lengths) - lengths
    inner = np.ones(len(gold), bool)
    inner[firsts] = False
    right = np.flatnonzero(inner)
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[right - 1], gold[right]), 1)
    for t in range(1, rounds + 1):
        *own, trans, start = params
        emit, fore, back = messages(score_of(own), lengths, trans, start)
        error = truth - _unit(fore * back)
        pair = fore[right - 1][:, :, None] * np.exp(trans - trans.max()) * (emit[right] * back[right])[:, None, :]
        expected = (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        grads = [*push(error), seen - expected, error[firsts].sum(axis=0)]
        for i, g in enumerate(grads):
            g = g / len(gold) - decay * params[i]
            moment[i] = 0.9 * moment[i] + 0.1 * g
            square[i] = 0.99 * square[i] + 0.01 * g * g
            params[i] = params[i] + rate * (moment[i] / (1 - 0.9**t)) / (np.sqrt(square[i] / (1 - 0.99**t)) + 1e-8)
    *own, trans, start = params
    return own, trans, start
