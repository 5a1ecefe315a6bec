"""Active decisions with their policy, probability, gradient and score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.config import AnalysisConfig


def place(log: DataFrame, frame: DataFrame, *carry: str) -> DataFrame:
    """Active rows with ``policy_idx`` (-1: initial or fallback), ``seg`` and ``horizon``."""
    looked_up = log.filter("active = 1").join(
        frame.select(
            "study_id", "t_min", "policy_nums", "seg_by_t", "horizon_by_t", *carry
        ),
        "study_id",
    )
    offset = F.col("calendar_t") - F.col("t_min")
    position = F.array_position("policy_nums", F.col("policy_num")).cast("int") - 1
    return (
        looked_up.withColumn("policy_idx", F.coalesce(position, F.lit(-1)))
        .withColumn("seg", F.get("seg_by_t", offset))
        .withColumn("horizon", F.get("horizon_by_t", offset))
        .drop("t_min", "policy_nums", "seg_by_t", "horizon_by_t")
    )


def own_beta() -> Column:
    """Beta of the decision's policy, null under the initial policy and under fallbacks."""
    return F.get("betas", F.col("policy_idx"))


def decisions(log: DataFrame, frame: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Placed rows with ``pi`` and what its gradient and score need.

    The probability is recomputed from the shared betas where a beta applies; under the initial
    policy and fallbacks the recorded one is kept and has no gradient and no score.
    """
    carry = config.policy.carry
    placed = place(log, frame, *carry)
    return config.policy.attach(placed, own_beta(), config.update.dim).drop(*carry)


def gradient(config: AnalysisConfig, entries: list[str]) -> Column:
    """Full-length array in beta from the gradient entries that can differ from zero."""
    first = config.policy.gradient_start(config.update.dim)
    return F.expr("array(" + ", ".join(["0D"] * first + entries) + ")")
