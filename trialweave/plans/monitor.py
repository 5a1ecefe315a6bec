"""Conditioning monitor: judges proposed policy updates before they go live."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.config import AnalysisConfig
from trialweave.operators import bread as bread_ops
from trialweave.operators import frame as frame_ops
from trialweave.operators import stack as stack_ops
from trialweave.operators import sums as sums_ops
from trialweave.operators.decisions import decisions
from trialweave.session import written

# Default limits of the monitor and its reasons.
WHOLE_LIMIT = 1000.0
DIAGONAL_LIMIT = 100.0
WHOLE_REASON = "whole_block_poor_conditioning"
DIAGONAL_REASON = "diagonal_block_poor_conditioning"

VERDICT_SCHEMA = """
    study_id string, policy_idx int, update_rejected boolean, rejection_reason string,
    whole_condition double, whole_limit double, diagonal_condition double, diagonal_limit double
"""


def newest_proposals(params: DataFrame) -> DataFrame:
    return params.groupBy("study_id").agg(F.max("policy_num").alias("policy_num"))


def proposed_frame(log: DataFrame, proposals: DataFrame) -> DataFrame:
    """Study frame over the data so far with the proposed policies (study_id, policy_num) added.

    A proposed policy without decisions takes all data so far. One that decides already is in the
    frame and keeps the cut at its first decision.
    """
    frame = frame_ops.study_frame(log)
    asked = proposals.groupBy("study_id").agg(F.array_sort(F.collect_set("policy_num")).alias("asked"))
    known = F.concat("policy_nums", F.array("initial_policy"))
    later = F.transform("new", lambda p: F.col("t_max") + 1)
    return (
        frame.join(asked, "study_id")
        .withColumn("new", F.filter("asked", lambda p: ~F.coalesce(F.array_contains(known, p), F.lit(False))))
        .withColumn("policy_nums", F.concat("policy_nums", "new"))
        .withColumn("update_times", F.concat("update_times", later))
        .withColumn("last_times", F.concat("last_times", later))
        .withColumn("n_updates", F.size("policy_nums"))
        .drop("asked", "new")
    )


def verdicts(
    cells: DataFrame, updates: DataFrame, b: int,
    whole_limit: float = WHOLE_LIMIT, diagonal_limit: float = DIAGONAL_LIMIT,
) -> DataFrame:
    """One verdict per (study_id, policy_idx) of ``updates`` from the bread inverse up to it.

    When both limits are passed the reason for the whole matrix is given.
    """

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        idx = int(pdf["policy_idx"].iloc[0])
        m = np.zeros(((idx + 1) * b, (idx + 1) * b))
        m[pdf["row_block"] * b + pdf["r"], pdf["col_block"] * b + pdf["c"]] = pdf["value"]
        whole, own = np.linalg.cond(m), np.linalg.cond(m[-b:, -b:])
        reason = (
            WHOLE_REASON if whole > whole_limit else DIAGONAL_REASON if own > diagonal_limit else ""
        )
        study = pdf["study_id"].iloc[0]
        return pd.DataFrame(
            [(study, idx, bool(reason), reason, whole, whole_limit, own, diagonal_limit)]
        )

    upto = updates.select(F.col("study_id").alias("study"), "policy_idx")
    prefixes = cells.join(
        upto, (F.col("study_id") == F.col("study")) & (F.col("row_block") <= F.col("policy_idx"))
    ).drop("study")
    return prefixes.groupBy("study_id", "policy_idx").applyInPandas(judge, VERDICT_SCHEMA)


@dataclass(frozen=True)
class UpdateAssessment:
    """Update-only tables for the proposed updates of each study, the newest parameters by default."""

    log: DataFrame
    params: DataFrame
    config: AnalysisConfig
    proposals: DataFrame | None = None

    @cached_property
    def frame(self) -> DataFrame:
        proposals = newest_proposals(self.params) if self.proposals is None else self.proposals
        frame = frame_ops.with_betas(proposed_frame(self.log, proposals), self.params)
        q = self.config.inference.dim
        users = sums_ops.contributor_counts(self.log, frame)
        return written(
            frame.join(users, "study_id", "left")
            .withColumn("theta", F.array(*[F.lit(0.0)] * q))
            .withColumn("bread", F.array(*[F.lit(0.0)] * (q * q))),
            "monitor_frame",
        )

    @cached_property
    def decided(self) -> DataFrame:
        return decisions(self.log, self.frame, self.config)

    @cached_property
    def sums(self) -> DataFrame:
        return written(sums_ops.study_sums(self.decided, self.config), "monitor_sums")

    @cached_property
    def digest(self) -> DataFrame:
        return stack_ops.subject_digest(self.decided, self.config)

    @cached_property
    def stack(self) -> DataFrame:
        """Update blocks and scores; there is no theta while the study runs."""
        full = stack_ops.stack_rows(self.digest, self.frame, self.config)
        return full.filter("kind = 'score' or not is_theta")

    @cached_property
    def stack_mean(self) -> DataFrame:
        return stack_ops.stack_mean(self.stack, self.frame)

    @cached_property
    def newest(self) -> DataFrame:
        """Place of the newest parameters among the updates."""
        place = F.array_position("policy_nums", F.col("policy_num")).cast("int") - 1
        return (
            self.frame.join(newest_proposals(self.params), "study_id")
            .select("study_id", place.alias("policy_idx")).filter("policy_idx >= 0")
        )

    def cells(self, updates: DataFrame | None = None) -> DataFrame:
        """Update part of the joint bread inverse, whole or only the block rows of ``updates``."""
        frame = self.frame
        every = frame.select("study_id", F.explode(F.sequence(F.lit(0), F.col("n_updates") - 1)).alias("policy_idx"))
        wanted = every.filter("policy_idx >= 0") if updates is None else updates
        products = bread_ops.digest_products(self.digest, frame, self.config, updates=wanted)
        cells = bread_ops.bread_cells(products, self.sums, frame, self.config).join(
            frame.select("study_id", "n_updates"), "study_id"
        ).filter("row_block < n_updates").drop("n_updates")
        if updates is not None:
            rows = updates.select("study_id", F.col("policy_idx").alias("row_block"))
            cells = cells.join(rows, ["study_id", "row_block"], "left_semi").select(*cells.columns)
        return cells

    def verdicts(self, whole_limit: float = WHOLE_LIMIT, diagonal_limit: float = DIAGONAL_LIMIT):
        return verdicts(self.cells(), self.newest, self.config.update.dim, whole_limit, diagonal_limit)
