"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

The inertia of ``L D Lᵀ = V - s I`` says how many eigenvalues lie below a shift s. Bisection with these counts puts each
leading eigenvalue alone between two shifts, Rayleigh quotient iteration converges to it cubically, and two more counts
certify its number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Pivots of 2 x 2 are taken where the diagonal is smaller than this share of its column (Bunch and Kaufman's constant).
_ALPHA = (1 + np.sqrt(17)) / 8
_MAX_STEPS = 60


def inertia_below(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues below ``shift``: the negative pivots of a symmetric indefinite factorisation."""
    a = matrix - shift * np.eye(len(matrix))
    tiny = np.finfo(float).eps * max(np.abs(a).max(), np.finfo(float).tiny)
    negative, d = 0, len(a)
    k = 0
    while k < d:
        wide = 1
        if k < d - 1:
            r = k + 1 + int(np.abs(a[k + 1:, k]).argmax())
            off = abs(a[r, k])
            if abs(a[k, k]) < _ALPHA * off:
                beside = max(np.abs(a[r, k:r]).max(), np.abs(a[r + 1:, r]).max() if r + 1 < d else 0.0)
                if abs(a[k, k]) * beside >= _ALPHA * off * off:
                    r = k
                elif abs(a[r, r]) < _ALPHA * beside:
                    wide = 2
                target = k + wide - 1
                if r != k and r != target:
                    a[[target, r]] = a[[r, target]]
                    a[:, [target, r]] = a[:, [r, target]]
        if wide == 1:
            pivot = a[k, k]
            if abs(pivot) < tiny:  # an eigenvalue at the shift counts as above it
                pivot = tiny
            negative += pivot < 0
            column = a[k + 1:, k].copy()
            a[k + 1:, k + 1:] -= np.outer(column, column / pivot)
        else:
            block, columns = a[k:k + 2, k:k + 2].copy(), a[k + 2:, k:k + 2].copy()
            negative += 1  # a 2 x 2 pivot is indefinite by choice
            a[k + 2:, k + 2:] -= columns @ np.linalg.solve(block, columns.T)
        k += wide
    return negative


@dataclass(frozen=True)
class Eigenpairs:
    """Falling eigenvalues, unit eigenvectors as rows, and whether inertia counts certify each number."""

    values: np.ndarray
    vectors: np.ndarray
    certified: np.ndarray


def _solve(matrix: np.ndarray, shift: float, right: np.ndarray, scale: float) -> np.ndarray:
    shifted = matrix - shift * np.eye(len(matrix))
    try:
        found = np.linalg.solve(shifted, right)
    except np.linalg.LinAlgError:
        found = None
    if found is None or not np.isfinite(found).all():  # the shift is an eigenvalue to the last bit
        found = np.linalg.solve(shifted - 4 * np.finfo(float).eps * scale * np.eye(len(matrix)), right)
    return found


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Columns of ``block`` made orthogonal to the rows of ``against`` and to each other."""
    for _ in range(2):
        if len(against):
            block = block - against.T @ (against @ block)
        block = np.linalg.qr(block)[0]
    return block


def leading_eigenpairs(matrix: np.ndarray, count: int) -> Eigenpairs:
    """The ``count`` largest eigenvalues (all, if there are fewer) of a symmetric matrix and their eigenvectors.

    Eigenvalues closer than the rounding of the matrix can't be told apart by any count; they are found as one cluster
    with an orthonormal basis of their space. Fixed start vectors make repeated calls agree bit for bit.
    """
    d = len(matrix)
    count = min(count, d)
    if not count:
        return Eigenpairs(np.zeros(0), np.zeros((0, d)), np.zeros(0, bool))
    scale = float(np.abs(matrix).sum(1).max())
    if scale == 0:
        return Eigenpairs(np.zeros(count), np.eye(d)[:count], np.ones(count, bool))
    unit = matrix / scale  # all eigenvalues within -1 and 1
    close = 8 * d * np.finfo(float).eps
    counts: dict[float, int] = {-1.0 - close: 0, 1.0 + close: d}

    def below(shift: float) -> int:
        if shift not in counts:
            counts[shift] = inertia_below(unit, shift)
        return counts[shift]

    rng = np.random.default_rng(d)
    values, vectors = [], np.zeros((0, d))
    while len(values) < count:
        place = d - len(values)  # the wanted eigenvalue is the place-th from below
        low = max(s for s, n in counts.items() if n < place)
        high = min(s for s, n in counts.items() if n >= place)
        while high - low > close and below(high) - below(low) > 1:
            middle = (low + high) / 2
            low, high = (middle, high) if below(middle) < place else (low, middle)
        inside = below(high) - below(low)
        # An isolated eigenvalue is one vector; a cluster is a basis of what is left of it above `low`.
        width = min(place - below(low), d - len(values)) if inside > 1 else 1
        while True:
            middle = (low + high) / 2
            block = _orthonormal(rng.normal(size=(d, width)), vectors)
            for _ in range(3):  # the middle of the interval is nearest to what it isolates
                block = _orthonormal(_solve(unit, middle, block, 1.0), vectors)
            if width > 1:
                break
            vector = block[:, 0]
            quotient = float(vector @ unit @ vector)
            for _ in range(_MAX_STEPS):
                step = _orthonormal(_solve(unit, quotient, vector[:, None], 1.0), vectors)[:, 0]
                moved = float(step @ unit @ step)
                done = abs(moved - quotient) <= 2 * np.finfo(float).eps
                vector, quotient = step, moved
                if done:
                    break
            block = vector[:, None]
            if low - close <= quotient <= high + close or high - low <= close:
                break
            middle = (low + high) / 2  # it ran to a neighbour: halve the interval and start again
            low, high = (middle, high) if below(middle) < place else (low, middle)
        quotients = ((unit @ block) * block).sum(0)
        order = np.argsort(-quotients)
        values += quotients[order].tolist()
        vectors = np.vstack([vectors, block[:, order].T])
    values, vectors = np.array(values[:count]), vectors[:count]
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[order]
    margin = max(close, 1e-13)
    sure = np.array([
        inertia_below(unit, v - margin) < d - i <= inertia_below(unit, v + margin) for i, v in enumerate(values)
    ])
    return Eigenpairs(values * scale, vectors, sure)
