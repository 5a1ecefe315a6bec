"""User-supplied policies and functions against the built-in ones."""

import sys
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle

from brute import random_study
from test_joint import FEATURES, config, tables
from trialweave.config import UserPolicy
from trialweave.operators.posterior import PosteriorSampling
from trialweave.plans.analysis import Analysis
from trialweave.plans.functions import FunctionAnalysis, UserFunction

# The functions below live in this test module, which the workers cannot import.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def logistic(beta, state, n_users):
    z = np.einsum("ij,ij->i", beta[:, -state.shape[1]:], state)
    return 0.1 + 0.8 / (1 + np.exp(-2.0 * z))


def centered_loss(param, rows):
    s = rows[["intercept", "x"]].to_numpy(dtype=float)
    a = (rows["action"] - rows["action_prob"]).to_numpy(dtype=float)[:, None]
    return float(((rows["reward"].to_numpy() - np.hstack([s, a * s]) @ param) ** 2).sum())


def centered_estimating(param, rows):
    s = rows[["intercept", "x"]].to_numpy(dtype=float)
    a = (rows["action"] - rows["action_prob"]).to_numpy(dtype=float)[:, None]
    f = np.hstack([s, a * s])
    return -2 * f.T @ (rows["reward"].to_numpy() - f @ param)


def test_user_policy_equals_built_in(spark):
    cfg = config()
    df, betas = random_study(31)
    log, params = tables(spark, df, betas)
    user = replace(cfg, policy=UserPolicy(logistic, FEATURES, 4))
    x = Analysis(log, cfg, params).result.first()
    y = Analysis(log, user, params).result.first()
    np.testing.assert_allclose(x["adjusted_variance"], y["adjusted_variance"], rtol=1e-6)


@pytest.mark.parametrize("fn, kind", [(centered_estimating, "estimating"), (centered_loss, "loss")])
def test_user_functions_equal_built_in(spark, fn, kind):
    cfg = config()
    df, betas = random_study(32, late=True, gaps=True)
    log, params = tables(spark, df, betas)
    a = Analysis(log, cfg, params)
    hook = UserFunction(fn, FEATURES, 4, kind)
    b = FunctionAnalysis(log, params, cfg, hook, hook, a.frame.select("study_id", "theta"))
    np.testing.assert_allclose(
        b.result.first()["adjusted_variance"], a.result.first()["adjusted_variance"], rtol=1e-4
    )


def test_posterior_sampling_policy_runs_in_an_analysis(spark):
    """Gradients through a packed posterior: the mean-field form and the drawn one are close."""
    half = np.eye(4) + 0.3
    precision = half @ half.T + np.eye(4)
    beta = np.concatenate([[0.1, 0.2, 0.3, -0.2], precision[np.triu_indices(4)] / 5])[None, :]
    state, users = np.array([[1.0, 0.5]]), np.array([5])
    one = UserPolicy(PosteriorSampling(steepness=2.0), FEATURES, 14)
    two = UserPolicy(PosteriorSampling(steepness=2.0, draws=10_000), FEATURES, 14)
    (p, g), (q, h) = one._evaluate(beta, state, users), two._evaluate(beta, state, users)
    assert abs(p[0] - q[0]) < 0.01
    np.testing.assert_allclose(g[0][:4], h[0][:4], atol=0.02)
    assert np.all(g[0][:2] == 0)


@pytest.mark.parametrize("additive, rows", [(False, 50), (True, 20)])
def test_user_functions_with_corrections(spark, monkeypatch, additive, rows):
    """Small buckets, split subjects where the functions allow it, and HC3 weights."""
    from trialweave.plans import functions

    monkeypatch.setattr(functions, "BUCKET_ROWS", rows)
    monkeypatch.setattr(functions, "TOGETHER", 3)
    cfg = replace(config(), correction="HC3theta")
    df, betas = random_study(33, late=True, gaps=True)
    log, params = tables(spark, df, betas)
    a = Analysis(log, cfg, params)
    hook = UserFunction(centered_estimating, FEATURES, 4, step=0.25, additive=additive)
    b = FunctionAnalysis(log, params, cfg, hook, hook, lambda log: a.frame.select("study_id", "theta"))
    mine, built_in = b.result.first(), a.result.first()
    for kind in ("adjusted_variance", "classical_variance"):
        np.testing.assert_allclose(mine[kind], built_in[kind], rtol=1e-6)
    found = {r["check"] for r in b.checks.select("check").distinct().collect()}
    assert {"mean_stack_near_zero", "probabilities_recomputed"} <= found


def test_buckets_are_dealt_to_tasks_of_their_own(spark, monkeypatch):
    """The calls cost time, not bytes: small buckets must not be merged into one task."""
    from trialweave.plans import functions

    monkeypatch.setattr(functions, "BUCKET_ROWS", 10)
    df, betas = random_study(34)
    log, params = tables(spark, df, betas)
    hook = UserFunction(centered_estimating, FEATURES, 4, step=0.25)
    b = FunctionAnalysis(log, params, config(), hook, hook, Analysis(log, config(), params).frame.select("study_id", "theta"))
    assert len(b.pieces.inputFiles()) > 2


def test_still_probabilities_need_no_calls():
    from trialweave.plans.functions import central, probability_slope

    calls = []

    def counted(param, rows):
        calls.append(1)
        return centered_estimating(param, rows)

    rng = np.random.default_rng(5)
    rows = pd.DataFrame({"intercept": 1.0, "x": rng.normal(size=6), "action": [0, 1, 1, 0, 1, 0], "action_prob": 0.4,
                         "reward": rng.normal(size=6)})
    param, pi = rng.normal(size=4), rows["action_prob"].to_numpy()
    grad = np.zeros((6, 4))
    grad[1:4, 3] = [0.1, -0.2, 0.3]
    fn = UserFunction(counted, FEATURES, 4, step=0.25)
    want = central(lambda d: fn.value(param, rows.assign(action_prob=pi + grad @ d)), np.zeros(4), fn.step)
    phi = fn.value(param, rows)
    calls.clear()
    np.testing.assert_array_equal(probability_slope(rows.copy(), grad, param, fn, phi), want)
    assert len(calls) == 2
