"""Feature table of a study: one (name, i, j, value) row per feature, label included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.operators import conditioning as cond
from trialweave.operators import ordered, summaries
from trialweave.operators import stack as stack_ops
from trialweave.operators.horizons import premature_estimates
from trialweave.plans.analysis import Analysis
from trialweave.session import written


def _long(df: DataFrame, names: dict[str, Column], i: Column | None = None, j: Column | None = None):
    none = F.lit(None).cast("int")
    structs = F.array(
        *[F.struct(F.lit(k).alias("name"), v.cast("double").alias("value")) for k, v in names.items()]
    )
    return df.select(
        "study_id",
        (i if i is not None else none).cast("string").alias("i"),
        (j if j is not None else none).cast("string").alias("j"),
        F.explode(structs).alias("f"),
    ).select("study_id", "f.name", "i", "j", "f.value")


def _diagonal(df: DataFrame, name: str, column: str, q: int, end: Column) -> DataFrame:
    return (
        df.select("study_id", end.alias("end"), F.posexplode(column).alias("p", "value"))
        .filter(F.col("p") % (q + 1) == 0)
        .select(
            "study_id", F.lit(name).alias("name"), F.col("end").cast("string").alias("i"),
            (F.col("p") / (q + 1)).cast("int").cast("string").alias("j"), "value",
        )
    )


def study_features(a: Analysis) -> DataFrame:
    """All features of all studies of an analysis in long form."""
    b, q = a.config.update.dim, a.config.inference.dim
    frame = a.frame
    # Read by many features each: the log is passed once for all of them.
    cells = written(a.bread_inverse, "bread")
    digest = written(a.digest, "digest")
    stack = written(stack_ops.stack_rows(digest, frame, a.config), "stack")
    params = frame.select("study_id", F.posexplode("betas").alias("policy_num", "beta"))
    block, row, col = F.col("block"), F.col("row_block"), F.col("col_block")
    norms = cond.block_norms(cells)
    times = summaries.time_statistics(a.log)
    active = a.log.filter("active = 1").groupBy("study_id").agg(F.max("reward").alias("r"))
    updates = cond.update_conditions(cells, frame, a.config)
    joint = cond.joint_conditions(cells, frame, a.config)
    mean_norm = stack_ops.stack_mean(stack, frame).groupBy("study_id").agg(
        F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("m")
    )
    per_subject = summaries.stack_norms(stack)
    premature = premature_estimates(digest, a.sums, frame, a.config)
    parts = [
        _long(joint, {
            "joint_bread_inverse_condition_number": F.col("condition"),
            "joint_bread_inverse_min_singular_value": F.col("min_singular_value"),
        }),
        _long(active, {"max_reward": F.col("r")}),
        _long(mean_norm, {"norm_avg_estimating_function_stack": F.col("m")}),
        _long(
            per_subject.groupBy("study_id").agg(F.max("norm").alias("m")),
            {"max_estimating_function_stack_norm": F.col("m")},
        ),
        _long(ordered.beta_change_summary(params), {
            "max_successive_beta_diff_norm": F.col("max_change"),
            "std_successive_beta_diff_norm": F.col("std_change"),
        }),
        _long(norms.filter("row_block > col_block"), {"off_diag_block_norm": F.col("norm")}, row, col),
        _long(norms.filter("row_block = col_block"), {"diag_block_norm": F.col("norm")}, row),
        _long(updates, {"diag_block_cond": F.col("block_condition")}, F.col("policy_idx")),
        _long(
            joint.join(frame.select("study_id", "n_updates"), "study_id"),
            {"diag_block_cond": F.col("theta_condition")}, F.col("n_updates"),
        ),
        _long(
            cond.off_diagonal_norms(cells).filter("side = 'row'"),
            {"off_diag_row_norm": F.col("norm")}, block,
        ),
        _long(
            cond.off_diagonal_norms(cells).filter("side = 'col'"),
            {"off_diag_col_norm": F.col("norm")}, block,
        ),
        _long(per_subject, {"estimating_function_stack_norm_subject": F.col("norm")}, F.col("subject_id")),
        _long(
            summaries.segment_norms(stack, frame),
            {"avg_estimating_function_stack_norm_segment": F.col("mean_norm")}, block,
        ),
        _long(
            ordered.beta_changes(params), {"successive_beta_diff_norm": F.col("change")},
            F.col("policy_num") - 1,
        ),
        _long(times, {
            "action_prob_logit_mean_t": F.col("logit_mean"), "action_prob_logit_std_t": F.col("logit_std"),
            "reward_mean_t": F.col("reward_mean"), "reward_std_t": F.col("reward_std"),
        }, F.col("calendar_t")),
        frame.select("study_id", F.posexplode("theta").alias("p", "value")).select(
            "study_id", F.lit("theta_est").alias("name"), F.col("p").cast("string").alias("i"),
            F.lit(None).cast("string").alias("j"), "value",
        ),
        _long(updates, {
            "premature_RL_block_condition_number_after_update": F.col("whole_condition"),
            "premature_RL_block_inverse_norm_after_update": F.col("inverse_norm"),
            "off_diagonal_RL_scaled_block_norm_sum_for_update": F.col("scaled_off_diagonal"),
        }, F.col("policy_idx")),
        _long(
            premature, {"premature_joint_adjusted_bread_inverse_condition_number": F.col("joint_condition")},
            F.col("end_idx"),
        ),
        _diagonal(premature, "premature_adjusted_sandwich", "adjusted_variance", q, F.col("end_idx")),
        _diagonal(premature, "premature_classical_sandwich", "classical_variance", q, F.col("end_idx")),
        _diagonal(a.joint, "label", "adjusted_variance", q, F.lit(None).cast("int")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def wide_features(features: DataFrame, names: list[str]) -> DataFrame:
    """One row per study with a column per unindexed feature, for training."""
    return (
        features.filter("i is null and j is null").groupBy("study_id")
        .pivot("name", names).agg(F.first("value"))
    )
