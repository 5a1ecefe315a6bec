"""Bayesian linear regression updates and posterior-sampling policies."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialweave.config import LinearModel
from trialweave.functions.vectors import Gram, plus
from trialweave.operators import sums as sums_ops
from trialweave.operators.decisions import place


@dataclass(frozen=True)
class NormalPrior:
    """Independent normal prior and known noise variance."""

    mean: float = 0.0
    precision: float = 1.0
    noise_var: float = 1.0


def triangle(d: int) -> list[tuple[int, int]]:
    """Positions of the packed upper triangle, row by row."""
    return [(i, j) for i in range(d) for j in range(i, d)]


def posterior_updates(
    log: DataFrame, calendar: DataFrame, model: LinearModel, prior: NormalPrior
) -> DataFrame:
    """Packed posterior per update: mean, then upper triangle of the precision per subject.

    The sums are plain aggregates over the data before each update; the solve runs on one row
    per (study, update).
    """
    sums = sums_ops.update_sums(place(log, calendar), model, "action_prob")
    stats = sums_ops.cumulative_update_sums(sums, calendar, model)
    users = sums_ops.contributors(log, calendar)
    d = model.dim
    precision = F.transform(
        "xx",
        lambda v, i: v / F.lit(prior.noise_var)
        + F.when(i % (d + 1) == 0, F.lit(prior.precision)).otherwise(F.lit(0.0)),
    )
    right = F.transform(
        "rx", lambda v: v / F.lit(prior.noise_var) + F.lit(prior.precision * prior.mean)
    )
    upper = F.array(*[F.get("precision", F.lit(i * d + j)) for i, j in triangle(d)])
    return (
        stats.withColumn("precision", precision)
        .withColumn("right", right)
        .join(users, ["study_id", "policy_num"], "left")
        .withColumn("n_users", F.coalesce("n_users", F.lit(0)))
        .withColumn("mean", sums_ops.solve_ridge("precision", "right", F.lit(0.0)))
        .select(
            "study_id", "policy_num", "policy_idx", "n_users",
            F.concat(
                "mean", F.transform(upper, lambda v: v / F.greatest("n_users", F.lit(1)))
            ).alias("beta"),
        )
    )


def posterior_functions(
    rows: DataFrame, params: DataFrame, model: LinearModel, prior: NormalPrior
) -> DataFrame:
    """Packed estimating function per (update, subject): mean part, then precision part."""
    from trialweave.operators.derivatives import state_model

    d, gram = model.dim, Gram("u", model.dim)
    sums = rows.groupBy("study_id", "policy_num", "subject_id").agg(
        *gram.sums(state_model(model))
    )
    users = sums.groupBy("study_id", "policy_num").agg(F.count("*").alias("n"))
    ready = sums.join(users, ["study_id", "policy_num"]).join(
        params.select("study_id", "policy_num", "beta"), ["study_id", "policy_num"]
    )
    noise, prec = f"{prior.noise_var!r}D", f"{prior.precision!r}D"
    mu = [f"get(beta, {i})" for i in range(d)]
    first = [
        f"({gram.rx(i)} - {plus([f'{gram.xx(i, j)} * {mu[j]}' for j in range(d)])}) / {noise}"
        f" + {prec} * ({prior.mean!r}D - {mu[i]}) / n"
        for i in range(d)
    ]
    second = [
        f"{gram.xx(i, j)} / {noise}" + (f" + {prec} / n" if i == j else "") + f" - get(beta, {d + p})"
        for p, (i, j) in enumerate(triangle(d))
    ]
    values = ", ".join(f"-({v})" for v in first + second)
    return ready.selectExpr("study_id", "policy_num", "subject_id", f"array({values}) AS v")


@F.pandas_udf(T.StructType([T.StructField("mean", T.DoubleType()), T.StructField("var", T.DoubleType())]))
def advantage_moments(beta: pd.Series, advantage: pd.Series, n_users: pd.Series) -> pd.DataFrame:
    """Mean and variance of the advantage under a packed posterior."""
    out = []
    for packed, x, n in zip(beta, advantage, n_users):
        if packed is None or x is None:
            out.append((None, None))
            continue
        x, packed = np.asarray(x, dtype=float), np.asarray(packed, dtype=float)
        d = 2 * len(x)
        precision = np.zeros((d, d))
        precision[np.triu_indices(d)] = packed[d:] * max(n, 1)
        precision = precision + np.triu(precision, 1).T
        direction = np.concatenate([np.zeros(d - len(x)), x])
        out.append((x @ packed[d - len(x):d], direction @ np.linalg.solve(precision, direction)))
    return pd.DataFrame(out, columns=["mean", "var"], dtype=float)


#: Lehmer's recurrence x' = FACTOR x mod MODULUS, from START on.
FACTOR, MODULUS, START = 48271, (1 << 31) - 1, 20_240_101


def normal_draws(count: int = 10_000, seed: int = 0) -> np.ndarray:
    """Fixed standard normal draws, the same in every task and on every run.

    An integer recurrence gives pairs of uniforms and each pair a draw by Box and Muller, so
    that any language with 64-bit integers can repeat them.
    """
    x = np.empty(2 * count, np.int64)
    last = (START + seed) % MODULUS or 1
    for i in range(2 * count):
        x[i] = last
        last = last * FACTOR % MODULUS
    u, v = x[0::2] / MODULUS, x[1::2] / MODULUS
    return np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)


def sampled_probability(
    mean: Column, var: Column, lower: float, upper: float, steepness: float, count: int = 10_000
) -> Column:
    """Average of the smooth policy over fixed draws of the advantage.

    Every task makes the draws from the seed once and averages whole Arrow batches against
    them, so nothing is multiplied out into rows.
    """

    @F.pandas_udf(T.DoubleType())
    def average(m: pd.Series, v: pd.Series) -> pd.Series:
        draws = normal_draws(count)
        out = np.empty(len(m))
        center, scale = m.to_numpy(dtype=float), np.sqrt(v.to_numpy(dtype=float))
        for at in range(0, len(m), 256):
            z = center[at:at + 256, None] + scale[at:at + 256, None] * draws
            out[at:at + 256] = (lower + (upper - lower) / (1 + np.exp(-steepness * z))).mean(axis=1)
        return pd.Series(out)

    return average(mean, var)


@dataclass(frozen=True)
class PosteriorSampling:
    """Probability function of a posterior-sampling policy over packed betas.

    The treatment part of the posterior gives the advantage a normal distribution; the smooth
    policy is averaged over it, by the closed approximation or over fixed draws. Use it as the
    function of a ``UserPolicy``.
    """

    lower: float = 0.1
    upper: float = 0.9
    steepness: float = 1.0
    draws: int | None = None

    def __call__(self, beta: np.ndarray, state: np.ndarray, n_users: np.ndarray) -> np.ndarray:
        m = state.shape[1]
        d = 2 * m
        precision = np.zeros((len(beta), d, d))
        rows, cols = np.triu_indices(d)
        packed = beta[:, d:] * np.maximum(n_users, 1)[:, None]
        precision[:, rows, cols] = packed
        precision[:, cols, rows] = packed
        direction = np.hstack([np.zeros_like(state), state])
        mean = np.einsum("ij,ij->i", state, beta[:, m:d])
        var = np.einsum(
            "ij,ij->i", direction, np.linalg.solve(precision, direction[:, :, None])[:, :, 0]
        )
        s = self.steepness
        if self.draws is None:
            e = 1 / (1 + np.exp(-s * mean / np.sqrt(1 + np.pi * s * s * var / 8)))
        else:
            z, e = normal_draws(self.draws), np.empty(len(mean))
            for at in range(0, len(mean), 256):
                advantage = mean[at:at + 256, None] + np.sqrt(var[at:at + 256, None]) * z
                e[at:at + 256] = (1 / (1 + np.exp(-s * advantage))).mean(axis=1)
        return self.lower + (self.upper - self.lower) * e
