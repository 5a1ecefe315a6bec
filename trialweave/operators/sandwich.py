"""Corrections, classical and adjusted variances: one small matrix per study."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialweave.config import AnalysisConfig
from trialweave.functions import matrix as mx


def correction_weight(kind: str, leverage: Column, n: Column, q: int) -> Column:
    """Weight of a subject's outer product under a small-sample correction."""
    if kind == "none":
        return F.lit(1.0)
    if kind == "HC1theta":
        return n / (n - F.lit(q))
    return F.pow(F.lit(1.0) - leverage, F.lit(-1.0 if kind == "HC2theta" else -2.0))


def leverages(stack: DataFrame, frame: DataFrame) -> DataFrame:
    """Leverage of each subject in the theta fit; they add up to the dimension of theta."""
    return (
        stack.filter("kind = 'phi' and is_theta")
        .join(frame.select("study_id", "n_subjects"), "study_id")
        .select("study_id", "subject_id", (F.col("leverage") / F.col("n_subjects")).alias("leverage"))
    )


def with_weights(stack: DataFrame, frame: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Add the correction weight of the subject to all its stack rows.

    Only HC2 and HC3 need the subject's leverage and with it a join by subject.
    """
    q = config.inference.dim
    if config.correction in ("none", "HC1theta"):
        counted = stack.join(frame.select("study_id", "n_subjects"), "study_id")
        return counted.withColumn(
            "weight", correction_weight(config.correction, F.lit(0.0), F.col("n_subjects"), q)
        ).drop("n_subjects")
    h = leverages(stack, frame).withColumnRenamed("leverage", "h")
    weighted = correction_weight(config.correction, F.coalesce("h", F.lit(0.0)), F.lit(0), q)
    return stack.join(h, ["study_id", "subject_id"], "left").withColumn("weight", weighted).drop("h")


def theta_meat(weighted: DataFrame, frame: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Classical meat as q*q plain aggregates, row-major array per study."""
    q = config.inference.dim
    names = [f"m_{r}_{c}" for r in range(q) for c in range(q)]
    sums = weighted.filter("kind = 'phi' and is_theta").groupBy("study_id").agg(
        *[
            F.sum(F.col("weight") * F.get("v", F.lit(r)) * F.get("v", F.lit(c))).alias(f"m_{r}_{c}")
            for r in range(q)
            for c in range(q)
        ]
    )
    return sums.join(frame.select("study_id", "n_subjects"), "study_id").select(
        "study_id", F.array(*[F.col(n) / F.col("n_subjects") for n in names]).alias("meat")
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def sandwich_udf(
    bread_inverse: pd.Series, meat: pd.Series, n: pd.Series, method: pd.Series
) -> pd.Series:
    out = []
    for b, m, size, how in zip(bread_inverse, meat, n, method):
        d = int(round(len(b) ** 0.5))
        b = np.asarray(b, dtype=float).reshape(d, d)
        m = np.asarray(m, dtype=float).reshape(d, d)
        try:
            out.append(mx.sandwich(b, m, size, how).ravel())
        except np.linalg.LinAlgError:
            out.append(None)
    return pd.Series(out, dtype=object)


def classical_variance(meat: DataFrame, frame: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Classical sandwich; ``frame`` carries the mean derivative of the theta function."""
    return meat.join(frame.select("study_id", "n_subjects", "bread_inverse"), "study_id").select(
        "study_id",
        sandwich_udf(
            "bread_inverse", "meat", F.col("n_subjects"), F.lit(config.sandwich)
        ).alias("classical_variance"),
    )


ADJUSTED_SCHEMA = """
    study_id string, adjusted_variance array<double>, n_updates int, joint_condition double,
    raw_condition double, negative_variances int, bread_gap_max double, bread_gap_norm double,
    joint_sandwich array<double>, stabilised array<double>,
    audit array<struct<policy_idx:int, diagonal_ridge:double, damping:double,
        whole_ridge:double, condition_before:double, condition_after:double>>,
    reason string
"""
# Reasons for a study without variances.
BAD_MATRIX, NO_CONVERGENCE = "joint_matrices_not_finite", "joint_matrix_not_solvable"


JOINT_COLUMNS = (
    "study_id", "adjusted_variance", "n_updates", "joint_condition", "raw_condition",
    "negative_variances", "bread_gap_max", "bread_gap_norm", "joint_sandwich", "stabilised", "audit",
    "reason",
)


def dense_matrix(rows: pd.DataFrame, b: int, q: int, updates: int) -> np.ndarray:
    """Matrix of one study from its cells."""
    size = updates * b + q
    m = np.zeros((size, size))
    m[
        rows["row_block"].to_numpy() * b + rows["r"].to_numpy(),
        rows["col_block"].to_numpy() * b + rows["c"].to_numpy(),
    ] = rows["value"].to_numpy()
    return m


def joint_input(bread: DataFrame, meat: DataFrame, frame: DataFrame) -> DataFrame:
    """Cells of both matrices of every study with its sizes, ready for a grouped map."""
    sizes = frame.select("study_id", "n_subjects", "n_updates")
    return (
        bread.withColumn("piece", F.lit("bread"))
        .unionByName(meat.withColumn("piece", F.lit("meat")))
        .join(sizes, "study_id")
    )


def adjusted_variance(cells: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Adjusted sandwich of every study from its joint matrices.

    The group is one p-by-p pair of matrices; its size depends on the parameters, not the data.
    A study whose matrices cannot be used has null variances and a reason; the others go on.
    """
    b, q = config.update.dim, config.inference.dim
    method, stabilise = config.sandwich, config.stabilise

    def unusable(study: str, updates: int, reason: str) -> pd.DataFrame:
        row = {name: [None] for name in JOINT_COLUMNS}
        row |= {"study_id": [study], "n_updates": [updates], "reason": [reason]}
        return pd.DataFrame(row)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        study, updates = pdf["study_id"].iloc[0], int(pdf["n_updates"].iloc[0])
        if not np.isfinite(pdf["value"].astype(float)).all():
            return unusable(study, updates, BAD_MATRIX)
        try:
            return solved(pdf)
        except np.linalg.LinAlgError:
            return unusable(study, updates, NO_CONVERGENCE)

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        updates = int(pdf["n_updates"].iloc[0])
        raw = dense_matrix(pdf[pdf["piece"] == "bread"], b, q, updates)
        meat = dense_matrix(pdf[pdf["piece"] == "meat"], b, q, updates)
        used, audit = mx.stabilise(raw, b, updates) if stabilise else (raw, [])
        n = int(pdf["n_subjects"].iloc[0])
        try:
            joint = mx.sandwich(used, meat, n, method)
            gap = np.linalg.inv(used) @ used - np.eye(len(used))
        except np.linalg.LinAlgError:
            joint = gap = np.full_like(used, np.nan)
        corner = joint[-q:, -q:].copy()
        negative = np.flatnonzero(np.diag(corner) < 0)
        corner[negative, negative] = 0.0
        return pd.DataFrame(
            {
                "study_id": [pdf["study_id"].iloc[0]],
                "adjusted_variance": [corner.ravel()],
                "n_updates": [updates],
                "joint_condition": [np.linalg.cond(used)],
                "raw_condition": [np.linalg.cond(raw)],
                "negative_variances": [len(negative)],
                "bread_gap_max": [np.abs(gap).max()],
                "bread_gap_norm": [np.linalg.norm(gap)],
                "joint_sandwich": [joint.ravel()],
                "stabilised": [used.ravel()],
                "audit": [audit],
                "reason": [None],
            }
        )

    return cells.groupBy("study_id").applyInPandas(solve, ADJUSTED_SCHEMA)
