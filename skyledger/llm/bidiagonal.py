"""Singular values and right singular vectors of a small square factor, by way of a bidiagonal.

Householder reflections make the factor bidiagonal, dqds finds its singular values to high relative
accuracy, and twisted factorisations give a vector for each. All work is on one d x d matrix, d
being the number of dimensions; it does not grow with the rows it was reduced from.
"""

from __future__ import annotations

import numpy as np

_TINY = np.finfo(np.float64).tiny
_EPS = np.finfo(np.float64).eps


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """v, tau, beta with (I - tau v v') x = beta e1."""
    norm = float(np.linalg.norm(x))
    if norm == 0.0:
        return np.zeros_like(x), 0.0, 0.0
    beta = -norm if x[0] >= 0 else norm
    v = x.copy()
    v[0] -= beta
    return v, 2.0 / float(v @ v), beta


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, p): r = u B p' with B upper bidiagonal, a on its diagonal and b above it."""
    m = r.astype(np.float64, copy=True)
    d = m.shape[0]
    p = np.eye(d)
    for k in range(d):
        v, tau, beta = _reflector(m[k:, k])
        m[k:, k:] -= tau * np.outer(v, v @ m[k:, k:])
        m[k, k], m[k + 1 :, k] = beta, 0.0
        if k < d - 2:
            v, tau, beta = _reflector(m[k, k + 1 :])
            m[k:, k + 1 :] -= tau * np.outer(m[k:, k + 1 :] @ v, v)
            m[k, k + 1], m[k, k + 2 :] = beta, 0.0
            p[:, k + 1 :] -= tau * np.outer(p[:, k + 1 :] @ v, v)
    return np.diag(m).copy(), np.diag(m, 1).copy(), p


def _sweep(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One differential quotient-difference sweep with a shift: new q, new e, and its pivots."""
    n = len(q)
    new_q, new_e, pivots = np.empty(n), np.empty(n - 1), np.empty(n)
    d = q[0] - shift
    for i in range(n - 1):
        pivots[i] = d
        new_q[i] = d + e[i]
        ratio = q[i + 1] / new_q[i] if new_q[i] else 0.0
        new_e[i] = e[i] * ratio
        d = d * ratio - shift
    pivots[-1] = new_q[-1] = d
    return new_q, new_e, pivots


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Singular values of the bidiagonal (a, b), falling.

    Sweeps come in pairs. The first has no shift; its pivots are the reciprocals of the diagonal of
    the inverse of B B', so one over the sum of their reciprocals is a lower bound of the smallest
    eigenvalue, and the second sweep is shifted by it. That is Newton's method from below: it never
    overshoots but by rounding, when the sweep is left out.
    """
    q, e = a * a, b * b
    # A vanished entry is replaced by one that changes no singular value by more than a rounding error.
    q = np.maximum(q, (_EPS * np.sqrt(max(q.max(initial=0.0), e.max(initial=0.0)))) ** 2 * _EPS)
    found, moved = [], 0.0
    blocks = [(q, e, 0.0)]
    while blocks:
        q, e, moved = blocks.pop()
        for _ in range(400 * (len(q) + 1)):
            n = len(q)
            if n <= 1:
                break
            small = e <= (64 * _EPS) ** 2 * (np.minimum(q[:-1], q[1:]) + moved)
            if small.any():
                cut = int(np.flatnonzero(small)[-1]) + 1
                if cut == n - 1:
                    found.append(q[-1] + moved)
                    q, e = q[:-1], e[:-1]
                else:
                    blocks.append((q[cut:], e[cut:], moved))
                    q, e = q[:cut], e[: cut - 1]
                continue
            if q[0] < q[-1]:  # work towards the smaller end
                q, e = q[::-1].copy(), e[::-1].copy()
            q, e, pivots = _sweep(q, e, 0.0)
            if pivots.min() <= 0:
                continue
            bound = (1.0 - 4 * n * _EPS) / float(np.sum(1.0 / pivots))
            shifted = _sweep(q, e, bound)
            if bound > _EPS * moved and shifted[2].min() > 0:
                q, e, moved = shifted[0], shifted[1], moved + bound
        else:
            raise ArithmeticError("dqds did not converge")
        found += [x + moved for x in q]
    return np.sqrt(np.sort(np.maximum(found, 0.0))[::-1])


def _twisted(a: np.ndarray, b: np.ndarray, value: float) -> tuple[np.ndarray, float]:
    """A vector z of B'B near an eigenvalue, and its Rayleigh correction, by the factorisation
    from both ends that meets at the smallest twist element."""
    d, n = a * a, len(a)
    l = b / a[:-1]  # noqa: E741
    s, p = np.empty(n), np.empty(n)
    down, up = np.empty(n - 1), np.empty(n - 1)
    s[0], p[-1] = -value, d[-1] - value
    floor = max(_TINY, _EPS**2 * value)
    for i in range(n - 1):
        pivot = d[i] + s[i]
        pivot = pivot if abs(pivot) > floor else floor
        down[i] = d[i] * l[i] / pivot
        s[i + 1] = down[i] * l[i] * s[i] - value
    for i in range(n - 2, -1, -1):
        pivot = d[i] * l[i] ** 2 + p[i + 1]
        pivot = pivot if abs(pivot) > floor else floor
        ratio = d[i] / pivot
        up[i] = l[i] * ratio
        p[i] = p[i + 1] * ratio - value
    gamma = s + p + value
    at = int(np.argmin(np.abs(gamma)))
    z = np.zeros(n)
    z[at] = 1.0
    for i in range(at - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(at, n - 1):
        z[i + 1] = -up[i] * z[i]
    square = float(z @ z)
    return z / np.sqrt(square), gamma[at] / square


def vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Orthonormal eigenvectors of B'B as columns, for singular values in falling order.

    Values within a thousandth of the next one form a cluster, whose vectors the factorisation leaves
    mixed. They span the cluster's space, to which a few steps of block inverse iteration add what
    is missing; the singular vectors of B within that space are its vectors.
    """
    n = len(a)
    if n == 1:
        return np.ones((1, len(values)))
    scale = max(float(np.abs(a).max()), float(np.abs(b).max()), _TINY)
    a = np.where(np.abs(a) < _EPS * scale, _EPS * scale, a)
    upper = np.diag(a) + np.diag(b, 1)
    draw = np.random.default_rng(0)
    out = np.zeros((n, len(values)))
    edges = np.flatnonzero(np.diff(values) < -1e-3 * values[:-1]) + 1
    for lo, hi in zip([0, *edges], [*edges, len(values)], strict=True):
        if lo == hi:
            continue
        for k in range(lo, hi):
            value = float(values[k]) ** 2
            z, step = _twisted(a, b, value)
            out[:, k] = _twisted(a, b, value + step)[0] if abs(step) <= 1e-6 * value else z
        if hi - lo == 1:
            continue
        beside = float(np.mean(values[lo:hi])) ** 2 * (1 + 1e-9) + _EPS * scale**2
        block = np.linalg.qr(out[:, lo:hi] + 1e-3 / n * draw.standard_normal((n, hi - lo)))[0]
        for _ in range(4):
            block = np.linalg.qr(np.linalg.solve(upper.T @ upper - beside * np.eye(n), block))[0]
        out[:, lo:hi] = block @ np.linalg.svd(upper @ block)[2].T
    return out


def right_singular(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of a square matrix, falling, and its right singular vectors as columns."""
    if not r.size:
        return np.zeros(0), np.zeros((0, 0))
    a, b, p = bidiagonalise(r)
    values = dqds(a, b)
    good = values > 16 * len(values) * _EPS * values[0] if values[0] > 0 else np.zeros(len(values), bool)
    values = values[good]
    return values, p @ vectors(a, b, values)
