"""Gradients and derivatives per subject, for inspection and for the joint derivative."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.config import AnalysisConfig, LinearModel
from trialweave.functions.vectors import Gram, plus
from trialweave.operators.decisions import gradient
from trialweave.operators.rows import KEY, with_recomputed
from trialweave.session import written


def policy_gradients(log: DataFrame, decided: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Policy and weight gradient in beta for every subject and time, zero where inactive."""
    zero = F.array(*[F.lit(0.0)] * config.update.dim)
    have = decided.select(
        *KEY,
        gradient(config, config.policy.gradients()).alias("pi_gradient"),
        gradient(config, config.policy.scores()).alias("weight_gradient"),
    )
    return log.select(*KEY).join(have, KEY, "left").select(
        *KEY,
        F.coalesce("pi_gradient", zero).alias("pi_gradient"),
        F.coalesce("weight_gradient", zero).alias("weight_gradient"),
    )


def state_model(model: LinearModel) -> list[str]:
    """Features of update rows, whose states are arrays, as SQL text."""
    dose = "(action - action_prob)" if model.centered else "action"
    return [f"get(base_state, {i})" for i in range(len(model.base))] + [
        f"({dose} * get(treat_state, {i}))" for i in range(len(model.treat))
    ]


def update_functions(rows: DataFrame, params: DataFrame, model: LinearModel) -> DataFrame:
    """Loss, gradient and second derivative of each (update, subject) from update rows.

    ``rows`` are update rows in long form; the ridge is shared by the contributing subjects.
    """
    gram = Gram("u", model.dim)
    sums = rows.groupBy("study_id", "policy_num", "subject_id").agg(
        *gram.sums(state_model(model)), F.expr("sum(reward * reward) AS rr")
    )
    users = sums.groupBy("study_id", "policy_num").agg(F.count("*").alias("n_users"))
    ready = sums.join(users, ["study_id", "policy_num"]).join(
        params.select("study_id", "policy_num", "beta"), ["study_id", "policy_num"]
    )
    d = range(model.dim)
    beta = [f"get(beta, {i})" for i in d]
    share = f"({model.ridge!r}D / n_users)"
    loss = plus(
        ["rr"]
        + [f"-2D * {beta[i]} * {gram.rx(i)}" for i in d]
        + [f"{beta[i]} * {beta[j]} * {gram.xx(i, j)}" for i in d for j in d]
        + [f"{share} * {b} * {b}" for b in beta]
    )
    slope = [f"{v} + 2D * {share} * {beta[i]}" for i, v in enumerate(gram.residual_sums("beta"))]
    second = [
        f"2D * {gram.xx(i, j)}" + (f" + 2D * {share}" if i == j else "") for i in d for j in d
    ]
    return ready.selectExpr(
        "study_id", "policy_num", "subject_id", f"{loss} AS loss",
        f"array({', '.join(slope)}) AS gradient", f"array({', '.join(second)}) AS second",
    )


def previous_beta_functions(
    rows: DataFrame, decided: DataFrame, params: DataFrame, model: LinearModel
) -> DataFrame:
    """``update_functions`` as functions of the betas of earlier policies, not of recorded probabilities.

    Every row's centring probability is rebuilt from the beta of the policy that decided it; rows of
    the initial policy and of fallbacks keep the recorded one, which depends on no beta.
    """
    return update_functions(with_recomputed(rows, decided), params, model)


def previous_beta_derivatives(
    decided: DataFrame, frame: DataFrame, config: AnalysisConfig
) -> DataFrame:
    """Mean derivative of each update's estimating function in each earlier beta, by cell.

    The probabilities are centred out, so an earlier beta enters through them alone. One pass over
    the decisions gives sums per (study, segment, policy) that every later update shares; only these
    are combined per pair of updates. ``row_block`` is the update and ``col_block`` the earlier policy.
    A model that is not centred depends on no earlier beta and gives no rows.
    """
    from trialweave.operators.bread import update_level_cells
    from trialweave.operators.sums import study_sums

    sums = written(study_sums(decided, config), "previous-beta-sums")
    return update_level_cells(sums, frame, config).filter("col_block < row_block")


def mean_second_derivative(functions: DataFrame, calendar: DataFrame) -> DataFrame:
    """Mean second derivative per update over all subjects, by position."""
    return (
        functions.select("study_id", "policy_num", F.posexplode("second").alias("pos", "value"))
        .groupBy("study_id", "policy_num", "pos").agg(F.sum("value").alias("total"))
        .join(calendar.select("study_id", "n_subjects"), "study_id")
        .select("study_id", "policy_num", "pos", (F.col("total") / F.col("n_subjects")).alias("value"))
    )


def mixed_derivatives(rows: DataFrame, params: DataFrame, model: LinearModel) -> DataFrame:
    """Derivative of each row's estimating function in its own probability, zero if uncentred."""
    f, d, nb = state_model(model), range(model.dim), len(model.base)
    g = {nb + i: f"(-get(treat_state, {i}))" for i in range(len(model.treat))}
    joined = rows.join(params.select("study_id", "policy_num", "beta"), ["study_id", "policy_num"])
    slope = plus([f"{x} * get(beta, {i})" for i, x in g.items()])
    resid = f"(reward - {plus([f'{f[i]} * get(beta, {i})' for i in d])})"
    mixed = [
        f"2D * {slope} * {f[i]}" + (f" - 2D * {resid} * {g[i]}" if i in g else "")
        if model.centered
        else "0D"
        for i in d
    ]
    return joined.selectExpr(
        "study_id", "policy_num", "subject_id", "calendar_t", f"array({', '.join(mixed)}) AS mixed"
    )


def inference_rows(log: DataFrame, frame: DataFrame, model: LinearModel) -> tuple[DataFrame, DataFrame]:
    """Inference data and theta in the shape of update rows, under policy number 0."""
    rows = log.filter("active = 1").select(
        "study_id", F.lit(0).alias("policy_num"), "subject_id", "calendar_t",
        F.array(*[F.col(c).cast("double") for c in model.base]).alias("base_state"),
        F.array(*[F.col(c).cast("double") for c in model.treat]).alias("treat_state"),
        "action", "reward", "action_prob",
    )
    theta = frame.select("study_id", F.lit(0).alias("policy_num"), F.col("theta").alias("beta"))
    return rows, theta
