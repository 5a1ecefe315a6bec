"""Studies built from the raw tables: full-grid logs with betas and recorded probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.config import AnalysisConfig, LinearModel, LogisticPolicy
from trialweave.operators import frame as frame_ops
from trialweave.operators import sums as sums_ops
from trialweave.operators.decisions import own_beta, place
from trialweave.plans.analysis import Analysis
from trialweave.session import written
from trialweave.sources import events as src

EVENTS_CONFIG = AnalysisConfig(
    policy=LogisticPolicy(treat=("intercept",), steepness=3.0, clip="hard"),
    update=LinearModel(base=("intercept",), treat=("intercept",)),
    inference=LinearModel(base=("intercept",), treat=("intercept",), centered=True),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed = src.daily_actions(table(spark, sf_dir, "events"))
    return src.with_past(src.with_policies(src.full_grid(observed, past="reward"), 5))


def orders_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed = src.monthly_orders(
        table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    )
    return src.with_past(src.with_policies(src.full_grid(observed, past="reward"), 12))


def record_policies(grid: DataFrame, config: AnalysisConfig, initial: float = 0.5) -> Analysis:
    """Betas of an uncentred update model, the probabilities they imply, and the analysis of both.

    Uncentred updates do not use probabilities, so the betas need one pass and no recursion.
    """
    # Most passes want active rows only and then skip the files of the others.
    grid = written(grid, "grid", by="active")
    calendar = written(frame_ops.study_frame(grid), "calendar")
    sums = sums_ops.update_sums(place(grid, calendar), config.update, "action_prob")
    params = written(
        sums_ops.solve_updates(
            sums_ops.cumulative_update_sums(sums, calendar, config.update), config.update.ridge
        ),
        "params",
    )
    # Written, so that its real size is known and the grid is never taken for the small side.
    frame = written(
        frame_ops.with_betas(calendar, params).withColumn(
            "n_users", F.lit(None).cast("array<bigint>")
        ),
        "betas",
    )
    lookup = frame.select("study_id", "policy_nums", "betas")
    position = F.array_position("policy_nums", F.col("policy_num")).cast("int") - 1
    advantage = config.policy.advantage(own_beta(), config.update.dim)
    log = (
        grid.join(lookup, "study_id")
        .withColumn("policy_idx", F.coalesce(position, F.lit(-1)))
        .withColumn(
            "action_prob", src.recorded_probability(initial, config.policy.probability(advantage))
        )
        .drop("policy_idx", "policy_nums", "betas")
    )
    return Analysis(log, config, params, frame)


def events_analysis(
    spark: SparkSession, sf_dir: str, config: AnalysisConfig = EVENTS_CONFIG
) -> Analysis:
    return record_policies(events_grid(spark, sf_dir), config)


def orders_analysis(
    spark: SparkSession, sf_dir: str, config: AnalysisConfig = EVENTS_CONFIG
) -> Analysis:
    return record_policies(orders_grid(spark, sf_dir), config)


EVENTS_STATE_CONFIG = AnalysisConfig(
    policy=LogisticPolicy(treat=("intercept", "past_reward"), steepness=1.0, clip="smooth"),
    update=LinearModel(("intercept", "past_reward"), ("intercept", "past_reward")),
    inference=LinearModel(("intercept", "past_reward"), ("intercept", "past_reward"), centered=True),
)
