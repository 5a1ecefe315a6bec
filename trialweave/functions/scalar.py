"""Column expressions for likelihoods, policies, gradients and weights."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def expit(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def logit(p: Column) -> Column:
    return F.log(p / (F.lit(1.0) - p))


def clip(x: Column, lower: Column, upper: Column) -> Column:
    """Null stays null, which ``least`` and ``greatest`` would not keep."""
    return F.when(x < lower, lower).when(x > upper, upper).otherwise(x)


def likelihood(prob: Column, action: Column) -> Column:
    """``prob`` if the action is 1 and ``1 - prob`` if it is 0, smooth in both."""
    return (F.lit(1.0) - action) + (F.lit(2.0) * action - F.lit(1.0)) * prob


def decision_weight(prob: Column, behaviour_prob: Column, action: Column) -> Column:
    """Likelihood of the action under one policy over that under another."""
    return likelihood(prob, action) / likelihood(behaviour_prob, action)


def smooth_clipped(advantage: Column, lower: Column, upper: Column, steepness: Column) -> Column:
    return lower + (upper - lower) * expit(steepness * advantage)


def smooth_clipped_slope(
    advantage: Column, lower: Column, upper: Column, steepness: Column
) -> Column:
    e = expit(steepness * advantage)
    return (upper - lower) * steepness * e * (F.lit(1.0) - e)


def hard_clipped(advantage: Column, lower: Column, upper: Column, steepness: Column) -> Column:
    return clip(expit(steepness * advantage), lower, upper)


def hard_clipped_slope(
    advantage: Column, lower: Column, upper: Column, steepness: Column
) -> Column:
    """Zero outside the open interval between the limits."""
    e = expit(steepness * advantage)
    inside = (e > lower) & (e < upper)
    return F.when(inside, steepness * e * (F.lit(1.0) - e)).otherwise(F.lit(0.0))


def score_slope(slope: Column, prob: Column, action: Column) -> Column:
    """d log likelihood / d advantage for a given d probability / d advantage."""
    return F.when(action == 1, slope / prob).otherwise(-slope / (F.lit(1.0) - prob))


def posterior_sampling_mean_field(
    mean: Column, var: Column, lower: Column, upper: Column, steepness: Column
) -> Column:
    """Approximate average of the smooth policy over a normal advantage."""
    scale = F.sqrt(F.lit(1.0) + F.lit(math.pi / 8.0) * steepness * steepness * var)
    return lower + (upper - lower) * expit(steepness * mean / scale)
