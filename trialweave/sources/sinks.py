"""Writers of results and of nested argument tables.

Tables are partitioned by study, and a write replaces the studies it holds and no others: a rerun
changes nothing, and studies written before by another run stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.plans.analysis import Analysis
from trialweave.session import written

#: Subjects in one map of a nested table, on average.
SUBJECTS = 1000


def replace_studies(df: DataFrame, path: str) -> None:
    """Write ``df`` by study over what the same studies had there."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("study_id").parquet(path))


def write_analysis(a: Analysis, path: str) -> None:
    """Theta and both variances, one row per study."""
    replace_studies(
        a.result.select("study_id", "theta", "adjusted_variance", "classical_variance"), f"{path}/analysis")


def debug_tables(a: Analysis) -> dict[str, DataFrame]:
    """Named intermediates of an analysis; what several of them are made of is built once."""
    from trialweave.operators.conditioning import joint_conditions
    from trialweave.operators.sandwich import leverages

    joint, stack, meat = written(a.joint, "joint"), written(a.stack, "stack"), written(a.meat, "meat")
    bread_inverse = written(a.bread_inverse, "bread")
    return {
        "theta_est": a.frame.select("study_id", "theta"),
        "adjusted_sandwich_var_estimate": joint.select("study_id", "adjusted_variance"),
        "classical_sandwich_var_estimate": a.classical,
        "raw_joint_bread_inverse_matrix": bread_inverse,
        "stabilized_joint_bread_inverse_matrix": joint.select("study_id", "stabilised"),
        "joint_meat_matrix": meat,
        "joint_sandwich_matrix": joint.select("study_id", "joint_sandwich"),
        "classical_bread_inverse_matrix": a.frame.select("study_id", "bread_inverse"),
        "classical_meat_matrix": meat.join(
            a.frame.select("study_id", F.col("n_updates").alias("row_block")), ["study_id", "row_block"]
        ).filter("row_block = col_block"),
        "all_estimating_function_stacks": stack.filter("kind = 'phi'").drop("leverage", "kind"),
        "joint_bread_inverse_condition_number": joint_conditions(bread_inverse, a.frame, a.config),
        "all_post_update_betas": a.frame.select("study_id", "policy_nums", "betas"),
        "per_subject_corrections": leverages(stack, a.frame),
        "stabilization_audit": joint.select("study_id", F.explode("audit").alias("a")).select(
            "study_id", "a.*"
        ),
    }


def write_debug_pieces(a: Analysis, path: str) -> None:
    for name, df in debug_tables(a).items():
        replace_studies(df, f"{path}/{name}")


def write_study_features(features: DataFrame, path: str) -> None:
    """Add the feature rows of these studies, in place of those they had."""
    replace_studies(features, path)


def _nested(rows: DataFrame, keys: list[str], value) -> DataFrame:
    """Maps from subject to ``value``, several for each of ``keys``, of some ``SUBJECTS`` each."""
    # Maps by hash of the subject, as many as its study has subjects for; one row per study is joined.
    maps = written(
        rows.groupBy("study_id").agg(F.ceil(F.approx_count_distinct("subject_id") / SUBJECTS).alias("maps")),
        "nested-maps")
    return (
        rows.join(maps, "study_id")
        .withColumn("part", F.pmod(F.xxhash64("subject_id"), F.greatest("maps", F.lit(1))))
        .groupBy(*keys, "part").agg(F.collect_list(F.struct("subject_id", value)).alias("entries"))
        .select(*keys, F.map_from_entries("entries").alias("subjects"))
    )


def write_policy_inputs(inputs: DataFrame, path: str) -> None:
    """Arguments of the probability function as maps by subject for each study and time."""
    replace_studies(_nested(inputs, ["study_id", "calendar_t"], F.col("inputs")), path)


def write_update_rows(rows: DataFrame, path: str) -> None:
    """Data of every update as maps from subject to parallel arrays over its times.

    An array is as long as a subject has times before the update, at most the study.
    """
    keys = ["study_id", "policy_num"]
    item = F.struct("calendar_t", "base_state", "treat_state", "action", "reward", "action_prob")
    one = rows.groupBy(*keys, "subject_id").agg(F.array_sort(F.collect_list(item)).alias("x"))
    args = F.struct(
        F.col("x.base_state").alias("base_states"), F.col("x.treat_state").alias("treat_states"),
        F.transform("x.action", lambda v: v.cast("double")).alias("actions"), F.col("x.reward").alias("rewards"),
        F.col("x.action_prob").alias("action_probs"), F.col("x.calendar_t").alias("times"),
    )
    replace_studies(_nested(one, keys, args), path)


def wide_policy_params(params: DataFrame, beta_dim: int) -> DataFrame:
    """Betas as columns beta_0, beta_1, ..."""
    return params.select(
        "study_id", "policy_num",
        *[F.get("beta", F.lit(i)).alias(f"beta_{i}") for i in range(beta_dim)],
    )


def write_policy_params(params: DataFrame, beta_dim: int, path: str) -> None:
    wide_policy_params(params, beta_dim).write.mode("overwrite").parquet(path)
