"""Conditioning of joint matrices: one grouped map over the cells of many studies."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.config import INVERSE_REPAIRS, AnalysisConfig
from trialweave.functions import matrix as mx
from trialweave.operators.sandwich import dense_matrix


def _per_study(
    cells: DataFrame, frame: DataFrame, b: int, q: int,
    work: Callable[[str, np.ndarray, int], pd.DataFrame], schema: str,
) -> DataFrame:
    """Run ``work`` on the dense matrix of each study; a group is one p-by-p matrix."""

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        updates = int(pdf["n_updates"].iloc[0])
        return work(pdf["study_id"].iloc[0], dense_matrix(pdf, b, q, updates), updates)

    sized = cells.join(frame.select("study_id", "n_updates"), "study_id")
    return sized.groupBy("study_id").applyInPandas(apply, schema)


def _cells(study: str, matrix: np.ndarray, b: int, q: int) -> pd.DataFrame:
    """Dense matrix back to cells; exact zeros are left out."""
    top = (len(matrix) - q) // b
    rows, cols = np.nonzero(matrix)
    block = lambda at: np.minimum(at // b, top)
    return pd.DataFrame(
        {
            "study_id": study, "row_block": block(rows), "col_block": block(cols),
            "r": rows - block(rows) * b, "c": cols - block(cols) * b, "value": matrix[rows, cols],
        }
    )


CELL_SCHEMA = "study_id string, row_block int, col_block int, r int, c int, value double"


def stabilised(cells: DataFrame, frame: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Stabilised joint bread inverse as cells."""
    b, q = config.update.dim, config.inference.dim
    return _per_study(
        cells, frame, b, q,
        lambda study, m, k: _cells(study, mx.stabilise(m, b, k)[0], b, q), CELL_SCHEMA,
    )


def stabilisation_audit(cells: DataFrame, frame: DataFrame, config: AnalysisConfig) -> DataFrame:
    """What the stabilisation did at each update."""
    b, q = config.update.dim, config.inference.dim
    return _per_study(
        cells, frame, b, q,
        lambda study, m, k: pd.DataFrame(mx.stabilise(m, b, k)[1]).assign(study_id=study)[
            ["study_id", "policy_idx", "diagonal_ridge", "damping", "whole_ridge",
             "condition_before", "condition_after"]
        ],
        "study_id string, policy_idx int, diagonal_ridge double, damping double,"
        "whole_ridge double, condition_before double, condition_after double",
    )


def inverted(
    cells: DataFrame, frame: DataFrame, config: AnalysisConfig, repair: str = "none",
    limit: float = 1e4,
) -> DataFrame:
    """Inverse of each study's matrix with the chosen repair, plus audit columns."""
    if repair not in INVERSE_REPAIRS:
        raise ValueError(f"unknown repair {repair!r}")
    b, q = config.update.dim, config.inference.dim

    def work(study: str, m: np.ndarray, k: int) -> pd.DataFrame:
        inverse, used = mx.repaired_inverse(m, repair, b, q, limit)
        gap = inverse @ m - np.eye(len(m))
        return _cells(study, inverse, b, q).assign(
            condition=np.linalg.cond(m), condition_used=used,
            gap_max=np.abs(gap).max(), gap_norm=np.linalg.norm(gap),
        )

    return _per_study(
        cells, frame, b, q, work,
        CELL_SCHEMA + ", condition double, condition_used double, gap_max double, gap_norm double",
    )


def update_conditions(cells: DataFrame, frame: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Per update: condition of the matrix so far and of its block, norms of what lies left of it."""
    b, q = config.update.dim, config.inference.dim

    def work(study: str, m: np.ndarray, updates: int) -> pd.DataFrame:
        rows = []
        for k in range(updates):
            lo, hi = k * b, (k + 1) * b
            whole, own = m[:hi, :hi], m[lo:hi, lo:hi]
            inverse = mx.solve_or_none(whole, np.eye(hi))
            scaled = mx.solve_or_none(own, m[lo:hi, :lo])
            rows.append(
                (
                    study, k, np.linalg.cond(whole), np.linalg.cond(own),
                    np.nan if inverse is None else np.linalg.norm(inverse),
                    np.nan if scaled is None else sum(
                        np.linalg.norm(scaled[:, j * b:(j + 1) * b]) for j in range(k)
                    ),
                )
            )
        return pd.DataFrame(rows)

    return _per_study(
        cells, frame, b, q, work,
        "study_id string, policy_idx int, whole_condition double, block_condition double,"
        "inverse_norm double, scaled_off_diagonal double",
    )


def joint_conditions(cells: DataFrame, frame: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Condition number and smallest singular value of each study's matrix."""
    b, q = config.update.dim, config.inference.dim

    def work(study: str, m: np.ndarray, updates: int) -> pd.DataFrame:
        s = np.linalg.svd(m, compute_uv=False)
        theta = m[-q:, -q:]
        return pd.DataFrame([(study, np.linalg.cond(m), s[-1], np.linalg.cond(theta))])

    return _per_study(
        cells, frame, b, q, work,
        "study_id string, condition double, min_singular_value double, theta_condition double",
    )


def block_norms(cells: DataFrame) -> DataFrame:
    return cells.groupBy("study_id", "row_block", "col_block").agg(
        F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm")
    )


def off_diagonal_norms(cells: DataFrame) -> DataFrame:
    """Frobenius norm of everything left of (``row``) or below (``col``) each diagonal block."""
    below = cells.filter("row_block > col_block")
    square = F.col("value") * F.col("value")
    by_row = below.groupBy("study_id", F.col("row_block").alias("block")).agg(
        F.sqrt(F.sum(square)).alias("norm")
    )
    by_col = below.groupBy("study_id", F.col("col_block").alias("block")).agg(
        F.sqrt(F.sum(square)).alias("norm")
    )
    return by_row.withColumn("side", F.lit("row")).unionByName(
        by_col.withColumn("side", F.lit("col"))
    )


def without_small_blocks(cells: DataFrame, fraction: float = 1e-3) -> DataFrame:
    """Zero the blocks left of the diagonal that are small next to their row's diagonal block."""
    norms = block_norms(cells)
    diagonal = norms.filter("row_block = col_block").select(
        "study_id", "row_block", F.col("norm").alias("diagonal")
    )
    small = (
        norms.filter("row_block > col_block").join(diagonal, ["study_id", "row_block"])
        .filter(F.col("norm") < F.lit(fraction) * F.col("diagonal"))
        .select("study_id", "row_block", "col_block", F.lit(0.0).alias("kept"))
    )
    return cells.join(small, ["study_id", "row_block", "col_block"], "left").select(
        "study_id", "row_block", "col_block", "r", "c", F.coalesce("kept", "value").alias("value")
    )


ADJUSTMENT_SCHEMA = "study_id string, block int, m array<double>"


def adjustment_matrices(cells: DataFrame, frame: DataFrame, config: AnalysisConfig) -> DataFrame:
    """``M = V R^-1`` cut by update: theta rows of the bread inverse times the update inverse."""
    b, q = config.update.dim, config.inference.dim

    def work(study: str, m: np.ndarray, updates: int) -> pd.DataFrame:
        full = np.linalg.solve(m[:-q, :-q].T, m[-q:, :-q].T).T
        return pd.DataFrame(
            [(study, k, full[:, k * b:(k + 1) * b].ravel()) for k in range(updates)]
        )

    return _per_study(cells, frame, b, q, work, ADJUSTMENT_SCHEMA)


def adjusted_theta_functions(
    stack: DataFrame, adjustments: DataFrame, config: AnalysisConfig
) -> DataFrame:
    """Theta function of each subject minus the adjustments from its update functions.

    A theta-only sandwich of these equals the theta corner of the joint sandwich.
    """
    b, q = config.update.dim, config.inference.dim
    joined = stack.filter("kind = 'phi'").join(adjustments, ["study_id", "block"], "left")

    def entry(r: int):
        moved = -sum(
            (F.get("m", F.lit(r * b + c)) * F.get("v", F.lit(c)) for c in range(1, b)),
            F.get("m", F.lit(r * b)) * F.get("v", F.lit(0)),
        )
        return F.sum(F.when(F.col("is_theta"), F.get("v", F.lit(r))).otherwise(moved))

    return joined.groupBy("study_id", "subject_id").agg(
        *[entry(r).alias(f"a_{r}") for r in range(q)]
    ).select("study_id", "subject_id", F.array(*[F.col(f"a_{r}") for r in range(q)]).alias("v"))


def theta_only_variance(
    stack: DataFrame, cells: DataFrame, frame: DataFrame, config: AnalysisConfig
) -> DataFrame:
    """Adjusted variance from explicit per-subject adjustments, with the chosen correction."""
    from trialweave.operators.sandwich import classical_variance, theta_meat, with_weights

    m = adjustment_matrices(cells, frame, config)
    own = with_weights(stack.filter("kind = 'phi' and is_theta"), frame, config)
    rows = (
        adjusted_theta_functions(stack, m, config)
        .withColumn("kind", F.lit("phi")).withColumn("is_theta", F.lit(True))
        .join(own.select("study_id", "subject_id", "weight"), ["study_id", "subject_id"])
    )
    return classical_variance(theta_meat(rows, frame, config), frame, config).withColumnRenamed(
        "classical_variance", "theta_only_variance"
    )
