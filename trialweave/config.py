"""Declarative description of a study: column roles, policy, models, switches."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialweave.functions import scalar

# Names of the small-sample corrections.
CORRECTIONS = ("none", "HC1theta", "HC2theta", "HC3theta")

# Names of the ways to form a sandwich.
SANDWICH_METHODS = ("bread_inverse_T_qr", "meat_svd_solve", "naive")

# Names of the repairs for an ill-conditioned matrix.
INVERSE_REPAIRS = (
    "none",
    "trim_small_singular_values",
    "zero_out_small_off_diagonals",
    "add_ridge_fixed_condition_number",
    "add_ridge_median_singular_value_fraction",
    "inverse_bread_structure_aware_inversion",
)


@dataclass(frozen=True)
class LogColumns:
    """Which column of the user's log plays which role. ``study_id=None`` means one study."""

    study_id: str | None = "study_id"
    subject_id: str = "subject_id"
    calendar_t: str = "calendar_t"
    active: str = "active"
    action: str = "action"
    policy_num: str = "policy_num"
    action_prob: str = "action_prob"
    reward: str = "reward"
    features: tuple[str, ...] = ()

    def standardise(self, df: DataFrame) -> DataFrame:
        """Select the roles under their own names and cast them; other columns are pruned."""
        needed = [
            c
            for c in (
                self.study_id, self.subject_id, self.calendar_t, self.active, self.action,
                self.policy_num, self.action_prob, self.reward, *self.features,
            )
            if c
        ]
        missing = [c for c in needed if c not in df.columns]
        if missing:
            raise ValueError(f"columns not in the log: {missing}")
        study = F.col(self.study_id).cast("string") if self.study_id else F.lit("study")
        return df.select(
            study.alias("study_id"),
            F.col(self.subject_id).alias("subject_id"),
            F.col(self.calendar_t).cast("int").alias("calendar_t"),
            F.col(self.active).cast("int").alias("active"),
            F.col(self.action).cast("int").alias("action"),
            F.col(self.policy_num).cast("int").alias("policy_num"),
            F.col(self.action_prob).cast("double").alias("action_prob"),
            F.col(self.reward).cast("double").alias("reward"),
            *[F.col(c).cast("double").alias(c) for c in self.features],
        )


@dataclass(frozen=True)
class LogisticPolicy:
    """Probability of action 1 from the last ``len(treat)`` entries of beta.

    ``clip="smooth"`` rescales the logistic curve into (lower, upper), ``"hard"`` cuts it there.
    The limits and the steepness are numbers or names of columns.
    """

    treat: tuple[str, ...] = ("intercept",)
    lower: float | str = 0.1
    upper: float | str = 0.9
    steepness: float | str = 1.0
    clip: str = "smooth"

    def __post_init__(self) -> None:
        if self.clip not in ("smooth", "hard"):
            raise ValueError(f"unknown clip {self.clip!r}")

    # Columns of the study frame the probability needs.
    carry = ("betas",)

    @property
    def columns(self) -> tuple[str, ...]:
        return self.treat

    @property
    def gradient_dim(self) -> int:
        return len(self.treat)

    def gradient_start(self, beta_dim: int) -> int:
        """First entry of beta that has a gradient; the entries before it have none."""
        return beta_dim - len(self.treat)

    def _bounds(self) -> tuple[Column, Column, Column]:
        return tuple(
            F.col(v) if isinstance(v, str) else F.lit(float(v))
            for v in (self.lower, self.upper, self.steepness)
        )

    def advantage(self, beta: Column, beta_dim: int) -> Column:
        first = self.gradient_start(beta_dim)
        terms = [F.col(c) * F.get(beta, F.lit(first + j)) for j, c in enumerate(self.treat)]
        return sum(terms[1:], terms[0])

    def probability(self, advantage: Column) -> Column:
        lower, upper, steepness = self._bounds()
        form = scalar.smooth_clipped if self.clip == "smooth" else scalar.hard_clipped
        return form(advantage, lower, upper, steepness)

    def slope(self, advantage: Column) -> Column:
        """d probability / d advantage; the gradient in beta is this times the treat state."""
        lower, upper, steepness = self._bounds()
        form = scalar.smooth_clipped_slope if self.clip == "smooth" else scalar.hard_clipped_slope
        return form(advantage, lower, upper, steepness)

    def attach(self, placed: DataFrame, beta: Column, beta_dim: int) -> DataFrame:
        """Add the probability and its slopes; without a beta the recorded probability stays."""
        return (
            placed.withColumn("advantage", self.advantage(beta, beta_dim))
            .withColumn("pi", F.coalesce(self.probability(F.col("advantage")), "action_prob"))
            .withColumn("pi_slope", F.coalesce(self.slope(F.col("advantage")), F.lit(0.0)))
            .withColumn(
                "score_slope",
                F.when(
                    F.col("pi_slope") != 0.0,
                    scalar.score_slope(F.col("pi_slope"), F.col("pi"), F.col("action")),
                ).otherwise(0.0),
            )
        )

    def gradients(self) -> list[str]:
        """SQL text of each gradient entry of the probability."""
        return [f"(pi_slope * {c})" for c in self.treat]

    def scores(self) -> list[str]:
        """SQL text of each gradient entry of the log likelihood."""
        return [f"(score_slope * {c})" for c in self.treat]


@dataclass(frozen=True)
class UserPolicy:
    """A probability function supplied by the user, with its gradient in beta.

    ``function(beta, state, n_users)`` takes one array row per decision and returns the
    probabilities, or the probabilities and their gradients; without gradients central
    differences are taken. It runs on Arrow batches inside the tasks.
    """

    function: Callable[..., np.ndarray | tuple[np.ndarray, np.ndarray]]
    columns: tuple[str, ...]
    beta_dim: int
    step: float = 1e-5

    carry = ("betas", "n_users")

    @property
    def gradient_dim(self) -> int:
        return self.beta_dim

    def gradient_start(self, beta_dim: int) -> int:
        return 0

    def _evaluate(self, beta: np.ndarray, state: np.ndarray, users: np.ndarray):
        out = self.function(beta, state, users)
        if isinstance(out, tuple):
            return out
        grad = np.empty_like(beta)
        for e in range(beta.shape[1]):
            up, down = beta.copy(), beta.copy()
            up[:, e] += self.step
            down[:, e] -= self.step
            grad[:, e] = (self.function(up, state, users) - self.function(down, state, users)) / (
                2 * self.step
            )
        return out, grad

    def attach(self, placed: DataFrame, beta: Column, beta_dim: int) -> DataFrame:
        evaluate = self._evaluate
        kind = T.StructType(
            [T.StructField("pi", T.DoubleType()), T.StructField("gradient", T.ArrayType(T.DoubleType()))]
        )

        @F.pandas_udf(kind)
        def both(betas: pd.Series, states: pd.Series, users: pd.Series) -> pd.DataFrame:
            known = betas.notna().to_numpy()
            pi, grad = np.full(len(betas), np.nan), np.empty(len(betas), dtype=object)
            if known.any():
                p, g = evaluate(
                    np.array(betas[known].tolist(), dtype=float),
                    np.array(states[known].tolist(), dtype=float),
                    users[known].to_numpy(),
                )
                pi[known] = p
                grad[np.flatnonzero(known)] = list(g)
            return pd.DataFrame({"pi": pd.Series(pi).where(known), "gradient": grad})

        state = F.array(*[F.col(c).cast("double") for c in self.columns])
        users = F.get("n_users", F.col("policy_idx"))
        scale = F.when(F.col("action") == 1, F.lit(1.0) / F.col("pi")).otherwise(
            F.lit(-1.0) / (F.lit(1.0) - F.col("pi"))
        )
        return (
            placed.withColumn("own", both(beta, state, F.coalesce(users, F.lit(0))))
            .withColumn("pi", F.coalesce(F.col("own.pi"), "action_prob"))
            .withColumn("pi_gradient", F.col("own.gradient"))
            .withColumn("score_scale", scale)
            .drop("own")
        )

    def gradients(self) -> list[str]:
        return [f"coalesce(get(pi_gradient, {e}), 0D)" for e in range(self.beta_dim)]

    def scores(self) -> list[str]:
        return [f"(score_scale * {g})" for g in self.gradients()]


@dataclass(frozen=True)
class LinearModel:
    """Least squares of the reward on the base state and action times treatment state.

    With ``centered`` the action has its probability ``pi`` subtracted first.
    """

    base: tuple[str, ...] = ("intercept",)
    treat: tuple[str, ...] = ("intercept",)
    centered: bool = False
    ridge: float = 0.0

    @property
    def dim(self) -> int:
        return len(self.base) + len(self.treat)

    def features(self, prob: str = "pi") -> list[str]:
        """SQL text of each feature, in parameter order."""
        dose = f"(action - {prob})" if self.centered else "action"
        return [f"({c} * 1D)" for c in self.base] + [f"({dose} * {c})" for c in self.treat]


@dataclass(frozen=True)
class AnalysisConfig:
    """Everything an analysis needs besides the tables.

    ``explicit_adjustments`` adds the variance from explicit per-subject adjustments to the result
    and compares it with the joint one among the checks; ``collect_features`` lets ``features``
    describe the study.
    """

    policy: LogisticPolicy | UserPolicy = field(default_factory=LogisticPolicy)
    update: LinearModel = field(default_factory=LinearModel)
    inference: LinearModel = field(default_factory=lambda: LinearModel(centered=True))
    correction: str = "none"
    sandwich: str = "bread_inverse_T_qr"
    stabilise: bool = True
    subjects_per_bucket: int = 4096
    suppress_checks: bool = False
    explicit_adjustments: bool = False
    collect_features: bool = False

    def __post_init__(self) -> None:
        if self.correction not in CORRECTIONS:
            raise ValueError(f"unknown correction {self.correction!r}")
        if self.sandwich not in SANDWICH_METHODS:
            raise ValueError(f"unknown sandwich {self.sandwich!r}")
        if self.policy.gradient_dim > self.update.dim:
            raise ValueError("the policy uses more parameters than an update estimates")

    @property
    def feature_columns(self) -> tuple[str, ...]:
        models = (self.update.base, self.update.treat, self.inference.base, self.inference.treat)
        names = [*self.policy.columns, *[c for part in models for c in part]]
        return tuple(dict.fromkeys(names))

    def advise(self) -> list[str]:
        """Warnings about choices that are allowed but often not meant."""
        notes = []
        if self.correction == "none":
            notes.append("no small-sample correction chosen")
        if not (self.update.centered or self.inference.centered):
            notes.append("no function uses action probabilities")
        if not self.stabilise:
            notes.append("the joint bread inverse is not stabilised")
        for note in notes:
            warnings.warn(note, stacklevel=2)
        return notes
