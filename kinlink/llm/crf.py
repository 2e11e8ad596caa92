"""Linear-chain conditional random field with two labels, over many chains at once.

Chains of any length lie one after the other.  Forward and backward messages come from a blocked scan: the positions form
equal blocks, all blocks advance together, and 2 x 2 block products join them; so time is linear and a document of any
length costs no more than many short ones.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

LIMIT = 30.0


@dataclass
class Model:
    """Emission weights (log-odds of label 1 for each feature), transition potentials (log) and those of a first position."""

    weights: np.ndarray
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    first: np.ndarray = field(default_factory=lambda: np.zeros(2))
    calibration: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))

    def marginals(self, emission: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Probability of label 1 at each position; ``starts`` marks the first position of each chain."""
        p, b0, b1 = messages(self, emission, starts)
        on, off = p * b1, (1 - p) * b0
        return on / (on + off)


def _blocks(x: np.ndarray, fill: float, rows: int, cols: int) -> np.ndarray:
    """x as (step, block), so that a step of all blocks is contiguous."""
    out = np.full(rows * cols, fill)
    out[: len(x)] = x
    return np.ascontiguousarray(out.reshape(cols, rows).T)


def messages(m: Model, emission: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised forward probability of label 1, and the normalised backward messages of both labels."""
    n = len(emission)
    if not n:
        z = np.zeros(0)
        return z, z, z
    rows = max(1, int(np.sqrt(n)))
    cols = -(-n // rows)
    g = _blocks(np.exp(np.clip(emission, -LIMIT, LIMIT)), 1.0, rows, cols)
    at = _blocks(starts.astype(float), 1.0, rows, cols) > 0
    t, s = np.exp(m.trans), np.exp(m.first)
    # potentials of each step; at a start both rows are alike, so nothing passes from one chain into the next
    m00, m10 = np.where(at, s[0], t[0, 0]), np.where(at, s[0], t[1, 0])
    m01, m11 = np.where(at, s[1], t[0, 1]) * g, np.where(at, s[1], t[1, 1]) * g
    # product of each block
    a, b, c, d = np.ones(cols), np.zeros(cols), np.zeros(cols), np.ones(cols)
    for i in range(rows):
        a, b, c, d = a * m00[i] + b * m10[i], a * m01[i] + b * m11[i], c * m00[i] + d * m10[i], c * m01[i] + d * m11[i]
        z = 1 / (a + b + c + d)
        a, b, c, d = a * z, b * z, c * z, d * z
    # messages into each block, from the left and from the right
    into, back = np.empty(cols), np.empty(cols)
    p = 0.5
    for k in range(cols):
        into[k] = p
        u0, u1 = (1 - p) * a[k] + p * c[k], (1 - p) * b[k] + p * d[k]
        p = u1 / (u0 + u1)
    q = 0.5
    for k in range(cols - 1, -1, -1):
        back[k] = q
        u0, u1 = a[k] * (1 - q) + b[k] * q, c[k] * (1 - q) + d[k] * q
        q = u1 / (u0 + u1)
    fwd, bwd = np.empty((rows, cols)), np.empty((rows, cols))
    p = into
    for i in range(rows):
        u0, u1 = (1 - p) * m00[i] + p * m10[i], (1 - p) * m01[i] + p * m11[i]
        p = u1 / (u0 + u1)
        fwd[i] = p
    q = back
    for i in range(rows - 1, -1, -1):
        bwd[i] = q
        u0, u1 = m00[i] * (1 - q) + m01[i] * q, m10[i] * (1 - q) + m11[i] * q
        q = u1 / (u0 + u1)
    fwd, bwd = fwd.T.reshape(-1)[:n], bwd.T.reshape(-1)[:n]
    return fwd, 1 - bwd, bwd


def fit(emit, pull, size: int, starts: np.ndarray, label: np.ndarray, weight: np.ndarray | None = None, steps: int = 60, rate: float = 0.3, l2: float = 1e-4, model: Model | None = None) -> Model:
    """Maximise the conditional likelihood of ``label`` with Adam.

    ``emit(weights)`` gives the emission of each position, ``pull(gradient of emissions)`` the gradient of the weights.
    """
    m = model or Model(np.zeros(size))
    theta = np.concatenate([m.weights, m.trans.ravel(), m.first])
    mean, var = np.zeros_like(theta), np.zeros_like(theta)
    n, w = len(label), np.ones(len(label)) if weight is None else weight
    total = max(1.0, w.sum())
    inner = np.flatnonzero(~starts)
    for step in range(1, steps + 1):
        m = Model(theta[:size], theta[size : size + 4].reshape(2, 2), theta[size + 4 :])
        e = np.clip(emit(m.weights), -LIMIT, LIMIT)
        p, b0, b1 = messages(m, e, starts)
        on, off = p * b1, (1 - p) * b0
        marg = on / (on + off)
        grad = np.zeros_like(theta)
        grad[:size] = pull((label - marg) * w)
        if len(inner):
            t, g = np.exp(m.trans), np.exp(e[inner])
            q = p[inner - 1]
            pair = np.stack([(1 - q) * t[0, 0] * b0[inner], (1 - q) * t[0, 1] * g * b1[inner], q * t[1, 0] * b0[inner], q * t[1, 1] * g * b1[inner]])
            pair /= pair.sum(axis=0)
            seen = np.bincount((2 * label[inner - 1] + label[inner]).astype(int), weights=w[inner], minlength=4)
            grad[size : size + 4] = seen - (pair * w[inner]).sum(axis=1)
        y, q, ws = label[starts], marg[starts], w[starts]
        grad[size + 4 :] = [((1 - y - (1 - q)) * ws).sum(), ((y - q) * ws).sum()]
        grad = grad / total - l2 * theta
        mean, var = 0.9 * mean + 0.1 * grad, 0.99 * var + 0.01 * grad * grad
        theta = theta + rate * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8)
    return Model(theta[:size], theta[size : size + 4].reshape(2, 2), theta[size + 4 :])


def calibrate(x: np.ndarray, y: np.ndarray, prior: float, steps: int = 50, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression of y on the columns of x (with intercept first), by Newton steps.

    Classes are weighted to the share ``prior`` of label 1, whatever their shares in the sample.
    """
    a = np.column_stack([np.ones(len(x)), x])
    v = np.where(y > 0, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    b = np.zeros(a.shape[1])
    hold = ridge * np.eye(a.shape[1])
    hold[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -LIMIT, LIMIT)))
        step = np.linalg.solve((a * (v * p * (1 - p))[:, None]).T @ a + hold, a.T @ (v * (y - p)) - hold @ b)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def predict(b: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.column_stack([np.ones(len(x)), x]) @ b, -LIMIT, LIMIT)))
