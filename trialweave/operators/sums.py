"""Study-level sums: everything the estimates and diagonal blocks need from one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.config import AnalysisConfig, LinearModel
from trialweave.functions.matrix import solve_ridge
from trialweave.functions.vectors import Gram, ProbabilitySums


def update_gram(config: AnalysisConfig) -> Gram:
    return Gram("u", config.update.dim)


def theta_gram(config: AnalysisConfig) -> Gram:
    return Gram("i", config.inference.dim)


def probability_sums(config: AnalysisConfig) -> dict[str, ProbabilitySums]:
    grad = config.policy.gradient_dim
    return {
        name: ProbabilitySums(name, len(model.base), len(model.treat), grad)
        for name, model in (("u", config.update), ("i", config.inference))
        if model.centered
    }


def update_sums(placed: DataFrame, model: LinearModel, prob: str) -> DataFrame:
    """Gram sums of the update model by study and segment."""
    return placed.groupBy("study_id", "seg").agg(
        *Gram("u", model.dim).sums(model.features(prob))
    )


def update_list(frame: DataFrame) -> DataFrame:
    return frame.select(
        "study_id", F.posexplode("policy_nums").alias("policy_idx", "policy_num")
    )


def cumulative_update_sums(sums: DataFrame, frame: DataFrame, model: LinearModel) -> DataFrame:
    """Sufficient statistics of every update: the sums of all segments up to its own.

    Both sides have at most one row per study and update, so the range condition stays small.
    """
    gram = Gram("u", model.dim)
    updates = update_list(frame).withColumnRenamed("study_id", "study")
    return (
        sums.join(
            updates, (F.col("study_id") == F.col("study")) & (F.col("seg") <= F.col("policy_idx"))
        )
        .groupBy("study_id", "policy_idx", "policy_num")
        .agg(*gram.totals())
        .select(
            "study_id", "policy_idx", "policy_num",
            gram.xx_array().alias("xx"), gram.rx_array().alias("rx"),
        )
    )


def solve_updates(statistics: DataFrame, ridge: float) -> DataFrame:
    return statistics.select(
        "study_id", "policy_num", "policy_idx",
        solve_ridge("xx", "rx", F.lit(float(ridge))).alias("beta"),
    )


def study_sums(decided: DataFrame, config: AnalysisConfig) -> DataFrame:
    """All study-level sums by (study, segment, horizon, policy) in one aggregation."""
    update, inference = config.update, config.inference
    exprs = update_gram(config).sums(update.features())
    exprs += theta_gram(config).sums(inference.features())
    grad = config.policy.gradients()
    tensors = probability_sums(config)
    for name, model in (("u", update), ("i", inference)):
        if name in tensors:
            exprs += tensors[name].sums(model.features(), model.treat, grad)
    return decided.groupBy("study_id", "seg", "horizon", "policy_idx").agg(*exprs)


def theta_statistics(sums: DataFrame, config: AnalysisConfig) -> DataFrame:
    gram = theta_gram(config)
    return (
        sums.groupBy("study_id")
        .agg(*gram.totals())
        .select("study_id", gram.xx_array().alias("xx"), gram.rx_array().alias("rx"))
    )


def estimate_theta(sums: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Theta by least squares over all active rows, one row per study."""
    return theta_statistics(sums, config).select(
        "study_id", "xx", solve_ridge("xx", "rx", F.lit(0.0)).alias("theta")
    )


def contributors(log: DataFrame, frame: DataFrame) -> DataFrame:
    """Subjects with data before each update: first row per subject, then counts per segment."""
    first = log.filter("active = 1").groupBy("study_id", "subject_id").agg(
        F.min("calendar_t").alias("first_t")
    )
    per_time = first.groupBy("study_id", "first_t").agg(F.count("*").alias("n"))
    updates = frame.select(
        "study_id",
        F.explode(F.arrays_zip("policy_nums", "update_times")).alias("u"),
        F.size("policy_nums").alias("k"),
    ).select(
        F.col("study_id").alias("study"),
        F.col("u.policy_nums").alias("policy_num"),
        F.col("u.update_times").alias("update_t"),
    )
    return (
        per_time.join(
            updates, (F.col("study_id") == F.col("study")) & (F.col("first_t") < F.col("update_t"))
        )
        .groupBy("study_id", "policy_num")
        .agg(F.sum("n").alias("n_users"))
    )


def contributor_counts(log: DataFrame, frame: DataFrame) -> DataFrame:
    """Contributing subjects of each update as an array in ``policy_idx`` order."""
    return (
        contributors(log, frame)
        .groupBy("study_id")
        .agg(F.array_sort(F.collect_list(F.struct("policy_num", "n_users"))).alias("u"))
        .select("study_id", F.transform("u", lambda s: s["n_users"]).alias("n_users"))
    )
