"""The joint derivative and both variances against central differences."""

import numpy as np
import pytest

from brute import Brute, random_study
from trialweave.config import AnalysisConfig, LinearModel, LogisticPolicy
from trialweave.functions.matrix import sandwich
from trialweave.operators.bread import score_cells_by_join
from trialweave.operators.sandwich import dense_matrix
from trialweave.plans.analysis import Analysis

FEATURES = ("intercept", "x")


def config(clip="smooth", update_centered=True, ridge=0.0, **more):
    return AnalysisConfig(
        policy=LogisticPolicy(treat=FEATURES, steepness=2.0, clip=clip),
        update=LinearModel(FEATURES, FEATURES, centered=update_centered, ridge=ridge),
        inference=LinearModel(FEATURES, FEATURES, centered=True),
        stabilise=False,
        **more,
    )


def tables(spark, df, betas):
    nullable = {"policy_num": "Int32", "action": "Int32", "action_prob": float, "reward": float}
    log = spark.createDataFrame(
        df.astype(nullable),
        "study_id string, subject_id long, calendar_t int, active int, intercept double, x double,"
        "policy_num int, action int, action_prob double, reward double",
    )
    params = spark.createDataFrame(
        [(df["study_id"].iloc[0], k + 1, [float(v) for v in beta]) for k, beta in enumerate(betas)],
        "study_id string, policy_num int, beta array<double>",
    )
    return log, params


@pytest.mark.parametrize(
    "seed, clip, centered, ridge, late, gaps",
    [
        (1, "smooth", True, 0.0, False, False),
        (2, "smooth", True, 0.7, True, True),
        (3, "hard", False, 0.0, True, False),
    ],
)
def test_joint_matrices(spark, seed, clip, centered, ridge, late, gaps):
    cfg = config(clip, centered, ridge, correction="HC1theta")
    df, betas = random_study(seed, late=late, gaps=gaps)
    brute = Brute(df, betas, cfg)
    a = Analysis(*tables(spark, df, betas)[:1], cfg, tables(spark, df, betas)[1])
    theta = np.array(a.frame.first()["theta"])
    np.testing.assert_allclose(theta, brute.theta, rtol=1e-6)

    b, q, K = 4, 4, brute.K
    got = dense_matrix(a.bread_inverse.toPandas(), b, q, K)
    np.testing.assert_allclose(got, brute.bread_inverse(), atol=1e-6)

    stacks = brute.stacks()
    meat = stacks.T @ stacks / brute.n * brute.n / (brute.n - q)
    np.testing.assert_allclose(dense_matrix(a.meat.toPandas(), b, q, K), meat, rtol=1e-8, atol=1e-9)

    row = a.result.first()
    joint = sandwich(got, meat, brute.n, "naive")[-q:, -q:]
    np.testing.assert_allclose(np.reshape(row["adjusted_variance"], (q, q)), joint, rtol=1e-7)
    psi = stacks[:, -q:]
    classical = sandwich(
        got[-q:, -q:], psi.T @ psi / brute.n * brute.n / (brute.n - q), brute.n, "naive"
    )
    np.testing.assert_allclose(np.reshape(row["classical_variance"], (q, q)), classical, rtol=1e-7)

    mean = {(r["block"], r["pos"]): r["mean"] for r in a.stack_mean.collect()}
    expect = stacks.mean(0)
    assert all(abs(v - expect[k * b + p]) < 1e-9 for (k, p), v in mean.items())


def test_score_part_by_join_equals_buckets(spark):
    cfg = config(subjects_per_bucket=5)
    df, betas = random_study(5, gaps=True)
    log, params = tables(spark, df, betas)
    a = Analysis(log, cfg, params)
    left = {
        (r["row_block"], r["col_block"], r["r"], r["c"] + 2): r["value"]
        for r in a.products.filter("piece = 'score'").collect()
    }
    right = {
        (r["row_block"], r["col_block"], r["r"], r["c"]): r["value"]
        for r in score_cells_by_join(a.stack, a.frame, cfg).collect()
    }
    assert left.keys() == right.keys()
    assert all(abs(left[k] - right[k]) < 1e-10 for k in left)
    one = Analysis(log, config(subjects_per_bucket=1000), params).result.first()
    np.testing.assert_allclose(
        a.result.first()["adjusted_variance"], one["adjusted_variance"], rtol=1e-9
    )


def test_flat_policy_gives_equal_variances(spark):
    """A policy that does not learn leaves nothing to adjust."""
    cfg = AnalysisConfig(
        policy=LogisticPolicy(treat=FEATURES, steepness=0.0),
        update=LinearModel(FEATURES, FEATURES, centered=True),
        inference=LinearModel(FEATURES, FEATURES, centered=True),
        correction="HC3theta",
    )
    df, betas = random_study(6)
    log, params = tables(spark, df, betas)
    a = Analysis(log, cfg, params)
    row = a.result.first()
    np.testing.assert_allclose(row["adjusted_variance"], row["classical_variance"], rtol=1e-8)


@pytest.mark.parametrize("kind", ["HC2theta", "HC3theta"])
def test_leverage_corrections(spark, kind):
    from trialweave.operators.sandwich import leverages

    cfg = config(correction=kind)
    df, betas = random_study(7)
    brute = Brute(df, betas, cfg)
    log, params = tables(spark, df, betas)
    a = Analysis(log, cfg, params)
    h = {r["subject_id"]: r["leverage"] for r in leverages(a.stack, a.frame).collect()}
    assert abs(sum(h.values()) - cfg.inference.dim) < 1e-9
    power = -1 if kind == "HC2theta" else -2
    w = np.array([(1 - h[s]) ** power for s in brute.subjects])
    psi = brute.stacks()[:, -4:]
    meat = (psi * w[:, None]).T @ psi / brute.n
    bread = np.reshape(a.frame.first()["bread_inverse"], (4, 4))
    np.testing.assert_allclose(
        np.reshape(a.result.first()["classical_variance"], (4, 4)),
        sandwich(bread, meat, brute.n, "naive"), rtol=1e-7,
    )
