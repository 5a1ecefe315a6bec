"""NumPy helpers that run inside Spark tasks, each on small matrices of one study."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _stack(column: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, dtype=float) for v in column])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def solve_ridge(xx: pd.Series, rx: pd.Series, ridge: pd.Series) -> pd.Series:
    """``(xx + ridge I)^-1 rx`` for a batch of studies or updates; null where singular."""
    if not len(rx):
        return pd.Series([], dtype=object)
    right = _stack(rx)
    d = right.shape[1]
    left = _stack(xx).reshape(-1, d, d) + ridge.to_numpy()[:, None, None] * np.eye(d)
    try:
        return pd.Series(list(np.linalg.solve(left, right[:, :, None])[:, :, 0]))
    except np.linalg.LinAlgError:
        return pd.Series([solve_or_none(a, b) for a, b in zip(left, right)])


def solve_or_none(left: np.ndarray, right: np.ndarray) -> np.ndarray | None:
    try:
        return np.linalg.solve(left, right)
    except np.linalg.LinAlgError:
        return None


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def inverse(matrix: pd.Series) -> pd.Series:
    """Inverse of a row-major square matrix; null where singular or null."""
    out = []
    for flat in matrix:
        if flat is None:
            out.append(None)
            continue
        d = int(round(len(flat) ** 0.5))
        solved = solve_or_none(np.asarray(flat, dtype=float).reshape(d, d), np.eye(d))
        out.append(None if solved is None else solved.ravel())
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.DoubleType())
def condition_number(matrix: pd.Series) -> pd.Series:
    out = []
    for flat in matrix:
        d = int(round(len(flat) ** 0.5))
        out.append(np.linalg.cond(np.asarray(flat, dtype=float).reshape(d, d)))
    return pd.Series(out, dtype=float)


def sandwich(bread_inverse: np.ndarray, meat: np.ndarray, n: int, method: str) -> np.ndarray:
    """``B^-1 M B^-T / n`` by the chosen route; only ``naive`` forms the inverse."""
    if method == "bread_inverse_T_qr":
        q, r = np.linalg.qr(bread_inverse.T)
        half = np.linalg.solve(r.T, meat)
        return q @ np.linalg.solve(r.T, half.T).T @ q.T / n
    if method == "meat_svd_solve":
        u, s, vt = np.linalg.svd(meat)
        root = np.sqrt(s)
        left = np.linalg.solve(bread_inverse, u * root)
        return left @ np.linalg.solve(bread_inverse, vt.T * root).T / n
    bread = np.linalg.inv(bread_inverse)
    return bread @ meat @ bread.T / n


def ridge_to_condition(matrix: np.ndarray, limit: float) -> float:
    """Ridge that brings a positive definite matrix about to the given condition number, or 0.

    The divisor ``limit + 1`` is a fixed part of the method; it stops slightly above the limit.
    """
    s = np.linalg.svd(matrix, compute_uv=False)
    return max(0.0, (s[0] - limit * s[-1]) / (limit + 1.0))


# Limits of the stabilisation.
DIAGONAL_CONDITION_LIMIT = 2e2
WHOLE_CONDITION_LIMIT = 1e4
DAMPING_FACTOR = 0.9
DAMPING_ROUNDS = 50


def stabilise(matrix: np.ndarray, b: int, updates: int) -> tuple[np.ndarray, list[dict]]:
    """Condition the update part of a joint bread inverse; theta rows stay as they are.

    Update by update: ridge on the diagonal block, then damping of the blocks left of it. When
    damping does not suffice they are dropped and the whole part so far gets a ridge.
    """
    m = np.array(matrix, dtype=float)
    audit = []
    for k in range(updates):
        lo, hi = k * b, (k + 1) * b
        before = np.linalg.cond(m[:hi, :hi])
        ridge = ridge_to_condition(m[lo:hi, lo:hi], DIAGONAL_CONDITION_LIMIT)
        m[lo:hi, lo:hi] += ridge * np.eye(b)
        damping, whole_ridge, rounds = 1.0, 0.0, 0
        while rounds < DAMPING_ROUNDS and np.linalg.cond(m[:hi, :hi]) > WHOLE_CONDITION_LIMIT:
            rounds += 1
            damping *= DAMPING_FACTOR
            m[lo:hi, :lo] *= DAMPING_FACTOR
        if rounds == DAMPING_ROUNDS:
            damping = 0.0
            m[lo:hi, :lo] = 0.0
            whole_ridge = ridge_to_condition(m[:hi, :hi], WHOLE_CONDITION_LIMIT)
            m[:hi, :hi] += whole_ridge * np.eye(hi)
        audit.append(
            {
                "policy_idx": k, "diagonal_ridge": ridge, "damping": damping,
                "whole_ridge": whole_ridge, "condition_before": before,
                "condition_after": np.linalg.cond(m[:hi, :hi]),
            }
        )
    return m, audit


def block_bounds(size: int, b: int, q: int) -> list[tuple[int, int]]:
    updates = (size - q) // b
    return [(k * b, (k + 1) * b) for k in range(updates)] + [(size - q, size)]


def block_triangular_inverse(matrix: np.ndarray, b: int, q: int, repair: str) -> np.ndarray:
    """Inverse that inverts only diagonal blocks and substitutes forward through the rest."""
    bounds = block_bounds(len(matrix), b, q)
    out = np.zeros_like(matrix, dtype=float)
    for lo, hi in bounds:
        head, _ = repaired_inverse(matrix[lo:hi, lo:hi], repair)
        out[lo:hi, lo:hi] = head
        out[lo:hi, :lo] = -head @ matrix[lo:hi, :lo] @ out[:lo, :lo]
    return out


def zero_small_blocks(matrix: np.ndarray, b: int, q: int, fraction: float = 1e-3) -> np.ndarray:
    """Drop blocks left of the diagonal that are small next to the diagonal block of their row."""
    bounds = block_bounds(len(matrix), b, q)
    out = np.array(matrix, dtype=float)
    for row, (lo, hi) in enumerate(bounds):
        size = np.linalg.norm(matrix[lo:hi, lo:hi])
        for left, right in bounds[:row]:
            if np.linalg.norm(out[lo:hi, left:right]) < fraction * size:
                out[lo:hi, left:right] = 0.0
    return out


def repaired_inverse(
    matrix: np.ndarray, repair: str, b: int = 0, q: int = 0, limit: float = 1e4,
    median_fraction: float = 0.01,
) -> tuple[np.ndarray, float]:
    """Inverse and the condition number it was formed at; repairs only above the limit."""
    eye = np.eye(len(matrix))
    condition = float(np.linalg.cond(matrix))
    if repair == "none" or condition <= limit:
        return np.linalg.solve(matrix, eye), condition
    u, s, vt = np.linalg.svd(matrix)
    if repair == "trim_small_singular_values":
        keep = s > s[0] / limit
        return (vt[keep].T / s[keep]) @ u[:, keep].T, float(s[0] / s[keep][-1])
    if repair == "inverse_bread_structure_aware_inversion":
        return (
            block_triangular_inverse(matrix, b, q, "add_ridge_fixed_condition_number"), condition
        )
    if repair == "zero_out_small_off_diagonals":
        changed = zero_small_blocks(matrix, b, q)
    elif repair == "add_ridge_fixed_condition_number":
        changed = matrix + (s[0] / limit - s[-1]) * eye
    elif repair == "add_ridge_median_singular_value_fraction":
        changed = matrix + median_fraction * np.median(s) * eye
    else:
        raise ValueError(f"unknown repair {repair!r}")
    return np.linalg.solve(changed, eye), float(np.linalg.cond(changed))
