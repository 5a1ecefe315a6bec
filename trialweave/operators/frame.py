"""The study frame: one small row per study with all that every decision needs to look up.

``policy_nums``, ``update_times`` and ``last_times`` are ordered by ``policy_idx`` (0-based,
initial policy left out). ``seg_by_t[t - t_min]`` counts the updates already in force at ``t``;
a row with segment ``s`` feeds the updates ``s, s+1, ...``. ``horizon_by_t`` does the same for
the pretended ends of the study. Arrays are indexed, so a decision finds its policy, its betas
and its segment with one equi-join on ``study_id`` and no range join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def policy_spans(log: DataFrame) -> DataFrame:
    """First and last time of each non-fallback policy in each study, over active rows."""
    return (
        log.filter((F.col("active") == 1) & (F.col("policy_num") >= 0))
        .groupBy("study_id", "policy_num")
        .agg(F.min("calendar_t").alias("first_t"), F.max("calendar_t").alias("last_t"))
    )


def subject_counts(log: DataFrame) -> DataFrame:
    """Number of subjects per study, counted in two steps so that one large study spreads out."""
    return (
        log.select("study_id", "subject_id")
        .distinct()
        .groupBy("study_id")
        .agg(F.count("*").alias("n_subjects"))
    )


def study_frame(log: DataFrame) -> DataFrame:
    """One row for every study of the log; one without active decisions has no policies."""
    bounds = log.groupBy("study_id").agg(
        F.min("calendar_t").alias("t_min"), F.max("calendar_t").alias("t_max")
    )
    listed = policy_spans(log).groupBy("study_id").agg(
        F.array_sort(F.collect_list(F.struct("policy_num", "first_t", "last_t"))).alias("spans")
    )
    updates = F.slice("spans", F.lit(2), F.greatest(F.size("spans") - 1, F.lit(0)))
    return (
        bounds.join(listed, "study_id", "left")
        .withColumn("spans", F.coalesce("spans", F.array().cast(listed.schema["spans"].dataType)))
        .join(subject_counts(log), "study_id")
        .select(
            "study_id",
            "t_min",
            "t_max",
            "n_subjects",
            F.get("spans", F.lit(0))["policy_num"].alias("initial_policy"),
            F.transform(updates, lambda s: s["policy_num"]).alias("policy_nums"),
            F.transform(updates, lambda s: s["first_t"]).alias("update_times"),
            F.transform(updates, lambda s: s["last_t"]).alias("last_times"),
        )
        .withColumn("n_updates", F.size("policy_nums"))
        .withColumn("horizon_times", F.array_sort(F.array_distinct("last_times")))
        .withColumn("times", F.sequence("t_min", "t_max"))
        .withColumn(
            "seg_by_t",
            F.transform("times", lambda t: F.size(F.filter("update_times", lambda u: u <= t))),
        )
        .withColumn(
            "horizon_by_t",
            F.transform("times", lambda t: F.size(F.filter("horizon_times", lambda h: h < t))),
        )
        .drop("times")
    )


def with_betas(frame: DataFrame, policy_params: DataFrame) -> DataFrame:
    """Add ``betas``: the post-update parameter vectors in ``policy_idx`` order.

    ``policy_params`` holds (study_id, policy_num, beta); other policies than the frame's
    updates are ignored, and an update without a beta gets null.
    """
    given = policy_params.groupBy("study_id").agg(
        F.map_from_entries(F.collect_list(F.struct("policy_num", "beta"))).alias("given")
    )
    return (
        frame.join(given, "study_id", "left")
        .withColumn(
            "betas", F.transform("policy_nums", lambda p: F.try_element_at("given", p))
        )
        .drop("given")
    )


def policy_index(log: DataFrame) -> DataFrame:
    """``policy_idx`` of every policy in use; the initial policy has -1."""
    frame = study_frame(log)
    initial = frame.filter("initial_policy is not null").select(
        "study_id", F.col("initial_policy").alias("policy_num"), F.lit(-1).alias("policy_idx")
    )
    rest = frame.select("study_id", F.posexplode("policy_nums").alias("policy_idx", "policy_num"))
    return initial.unionByName(rest)
