"""Per-subject estimating function stacks and scores.

The log is first reduced to one row per (subject, segment, policy), with partial sums on the map
side, so a subject or study that holds a large share of all rows is spread over the whole
cluster. Those few rows are exchanged once, by buckets of subjects, and summed from segment to
segment there, which gives the stack in long form:

``kind = 'phi'``    ``block`` k: estimating function of update k (k = ``n_updates``: theta)
``kind = 'score'``  ``block`` j: sum of the scores of the decisions made under policy j

Blocks a subject has no data for are absent and count as zero; every mean divides by all
subjects of the study.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.config import AnalysisConfig
from trialweave.operators import segments
from trialweave.operators.sums import theta_gram, update_gram


def subject_digest(decided: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Sums per (study, subject, segment, horizon, policy); ``decided`` as from ``decisions``."""
    exprs = update_gram(config).sums(config.update.features())
    exprs += theta_gram(config).sums(config.inference.features())
    exprs += [F.expr(f"sum{s} AS score_{e}") for e, s in enumerate(config.policy.scores())]
    return decided.groupBy("study_id", "subject_id", "seg", "horizon", "policy_idx").agg(*exprs)


def stack_rows(digest: DataFrame, frame: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Long stack from the digest; ``frame`` carries betas, theta, ``bread`` and ``n_users``.

    Sums run from segment to segment inside buckets of subjects, so that no more rows than the
    digest and the stack itself have are ever made.
    """
    subject = digest.schema["subject_id"].dataType.simpleString()
    schema = (f"study_id string, subject_id {subject}, kind string, block int, v array<double>, is_theta boolean,"
              " leverage double")
    return segments.in_buckets(digest, segment_frame(frame), config, segments.long_stack(config.update.ridge), schema)


def segment_frame(frame: DataFrame) -> DataFrame:
    return frame.select("study_id", "n_subjects", "n_updates", "betas", "theta", "bread", "n_users")


def phi(stack: DataFrame) -> DataFrame:
    return stack.filter("kind = 'phi'")


def stack_mean(stack: DataFrame, frame: DataFrame) -> DataFrame:
    """Mean of the stack over all subjects of the study, by block and position."""
    return (
        phi(stack)
        .select("study_id", "block", F.posexplode("v").alias("pos", "value"))
        .groupBy("study_id", "block", "pos")
        .agg(F.sum("value").alias("total"))
        .join(frame.select("study_id", "n_subjects"), "study_id")
        .select("study_id", "block", "pos", (F.col("total") / F.col("n_subjects")).alias("mean"))
    )
