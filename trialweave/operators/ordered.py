"""Quantities that depend on time order: first times, weights, changes, running sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialweave.functions import scalar
from trialweave.functions.vectors import Gram, difference, squared_norm


def first_times_by_policy(log: DataFrame) -> DataFrame:
    """First time each policy applied to a subject."""
    return (
        log.filter("active = 1")
        .groupBy("study_id", "subject_id", "policy_num")
        .agg(F.min("calendar_t").alias("first_t"))
    )


def subject_spans(placed: DataFrame) -> DataFrame:
    """Start, end and first time under a learned policy of every subject."""
    learned = F.when(F.col("policy_idx") >= 0, F.col("calendar_t"))
    return placed.groupBy("study_id", "subject_id").agg(
        F.min("calendar_t").alias("start_t"),
        F.max("calendar_t").alias("end_t"),
        F.min(learned).alias("first_learned_t"),
    )


def decision_weights(decided: DataFrame, behaviour: str = "behaviour_prob") -> DataFrame:
    """Weight of each decision; 1 where no beta applies."""
    weight = scalar.decision_weight(F.col("pi"), F.col(behaviour), F.col("action"))
    return decided.withColumn("weight", F.when(F.col("policy_idx") >= 0, weight).otherwise(1.0))


def policy_log_weights(weighted: DataFrame) -> DataFrame:
    """Log weights added per (subject, policy), which bounds the rows of a subject by K."""
    return (
        weighted.filter("policy_idx >= 0")
        .groupBy("study_id", "subject_id", "policy_idx")
        .agg(F.sum(F.log("weight")).alias("log_weight"))
    )


def update_weights(weighted: DataFrame, frame: DataFrame) -> DataFrame:
    """Weight of each subject's estimating function at each update.

    It covers the decisions under learned policies before the subject first used policy k, or
    all of them if the subject never did. Policies do not fall over a subject's time, so these
    are the decisions under earlier policies. Subjects without such decisions have weight 1.
    """
    per_policy = policy_log_weights(weighted)
    order = Window.partitionBy("study_id", "subject_id").orderBy("policy_idx")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("study_id", "subject_id")
    running = per_policy.select(
        "study_id", "subject_id", "policy_idx",
        F.coalesce(F.sum("log_weight").over(before), F.lit(0.0)).alias("before"),
        F.sum("log_weight").over(whole).alias("total"),
    )
    subjects = weighted.select("study_id", "subject_id").distinct()
    grid = subjects.join(frame.select("study_id", "n_updates"), "study_id").select(
        "study_id", "subject_id",
        F.explode(
            F.when(F.col("n_updates") > 0, F.sequence(F.lit(0), F.col("n_updates") - 1))
        ).alias("policy_idx"),
    )
    totals = running.groupBy("study_id", "subject_id").agg(F.first("total").alias("total"))
    return (
        grid.join(running.drop("total"), ["study_id", "subject_id", "policy_idx"], "left")
        .join(totals, ["study_id", "subject_id"], "left")
        .select(
            "study_id", "subject_id", "policy_idx",
            F.exp(F.coalesce("before", "total", F.lit(0.0))).alias("weight"),
        )
    )


def inference_weights(weighted: DataFrame) -> DataFrame:
    """Weight of each subject's theta function: all decisions under learned policies."""
    return weighted.groupBy("study_id", "subject_id").agg(
        F.exp(F.sum(F.when(F.col("policy_idx") >= 0, F.log("weight")).otherwise(0.0))).alias("weight")
    )


def weighted_stack(stack: DataFrame, updates: DataFrame, inference: DataFrame) -> DataFrame:
    """Stack with the weights applied; needed when the recorded betas are not the shared ones."""
    by_block = updates.withColumnRenamed("policy_idx", "block").withColumnRenamed("weight", "w_u")
    return (
        stack.filter("kind = 'phi'")
        .join(by_block, ["study_id", "subject_id", "block"], "left")
        .join(inference.withColumnRenamed("weight", "w_t"), ["study_id", "subject_id"], "left")
        .withColumn("w", F.when(F.col("is_theta"), F.col("w_t")).otherwise(F.col("w_u")))
        .withColumn("v", F.transform("v", lambda x: x * F.coalesce("w", F.lit(1.0))))
        .drop("w", "w_u", "w_t")
    )


def beta_changes(params: DataFrame) -> DataFrame:
    """Size of each successive change of the betas; at most K rows per study."""
    order = Window.partitionBy("study_id").orderBy("policy_num")
    return (
        params.withColumn("earlier", F.lag("beta").over(order))
        .filter("earlier is not null")
        .select(
            "study_id", "policy_num",
            F.sqrt(squared_norm(difference(F.col("beta"), F.col("earlier")))).alias("change"),
        )
    )


def beta_change_summary(params: DataFrame) -> DataFrame:
    return beta_changes(params).groupBy("study_id").agg(
        F.max("change").alias("max_change"), F.stddev_pop("change").alias("std_change")
    )


def running_sums(sums: DataFrame, gram: Gram) -> DataFrame:
    """Cumulative Gram sums over the segments of a study; at most K+1 rows per study."""
    upto = (
        Window.partitionBy("study_id").orderBy("seg")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return sums.select("study_id", "seg", *[F.sum(c).over(upto).alias(c) for c in gram.columns])
