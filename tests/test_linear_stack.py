"""Rows per subject stay linear in the updates, and ends reuse the update blocks."""

from dataclasses import replace

import numpy as np
import pytest

from brute import Brute, random_study
from test_joint import config, tables
from trialweave.functions.matrix import sandwich
from trialweave.operators import bread, segments
from trialweave.operators.horizons import premature_estimates
from trialweave.plans.analysis import Analysis

B = Q = 4


def analysis(spark, seed, cfg, **study):
    df, betas = random_study(seed, **study)
    log, params = tables(spark, df, betas)
    return df, betas, Analysis(log, cfg, params)


def test_rows_between_exchanges(spark):
    """With 12 updates: the digest and the stack hold at most a few rows per subject and update."""
    df, betas, a = analysis(spark, 21, config(), subjects=6, times=25, period=2)
    K, n = len(betas), df["subject_id"].nunique()
    assert K == 12
    digest, frame, cfg = a.digest.cache(), a.frame, a.config
    # Every segment has decisions of one policy, or of two where a policy comes late.
    assert digest.count() <= 2 * n * (K + 1)
    assert a.stack.count() <= n * (2 * K + 1)
    seen = []

    def count(sums, study):
        import pyarrow as pa

        return pa.table({"rows": pa.array([len(sums.seg)], pa.int64()), "subjects": pa.array([sums.n], pa.int64())})

    read = segments.in_buckets(digest, frame.select("study_id", "n_subjects", "n_updates"), cfg, count, "rows long, subjects long")
    seen = read.collect()
    assert sum(r["rows"] for r in seen) == digest.count() and sum(r["subjects"] for r in seen) == n
    # Nothing is exploded on the way to the products but the studies' buckets and the sums of the buckets.
    plan = bread.digest_products(digest, frame, cfg)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(") <= 2


def test_small_buckets_give_the_same(spark, monkeypatch):
    _, _, a = analysis(spark, 22, config(correction="HC3theta"), gaps=True, late=True)
    whole = {tuple(r)[:6]: r["value"] for r in a.products.collect()}
    monkeypatch.setattr(segments, "BUCKET_CELLS", 40)
    parts = {tuple(r)[:6]: r["value"] for r in bread.digest_products(a.digest, a.frame, a.config).collect()}
    assert whole.keys() == parts.keys() and all(abs(whole[k] - parts[k]) < 1e-9 for k in whole)
    by_stack = {tuple(r)[:6]: r["value"] for r in bread.subject_products(a.weighted_stack, a.frame, a.config).collect()}
    assert all(abs(by_stack.get(k, 0.0) - v) < 1e-9 for k, v in whole.items())


@pytest.mark.parametrize("correction", ["none", "HC3theta"])
def test_ends_of_late_subjects(spark, correction):
    """Subjects who still use an old policy after an end: their later decisions do not count there."""
    cfg = config(correction=correction)
    df, betas, a = analysis(spark, 23, cfg, late=True, gaps=True)
    got = premature_estimates(a.digest, a.sums, a.frame, cfg).collect()
    updates = sorted(p for p in df["policy_num"].dropna().unique() if p > 0)
    n = df["subject_id"].nunique()
    assert len(got) == len(updates)
    for row in got:
        k = row["end_idx"]
        end = df[(df["policy_num"] == updates[k]) & (df["active"] == 1)]["calendar_t"].max()
        cut = df[df["calendar_t"] <= end].copy()
        # Policies after the end's own are not learned yet there: as if they were fixed.
        cut.loc[cut["policy_num"] > updates[k], "policy_num"] = -1
        prob = Brute(df, betas, cfg)
        again = cut["policy_num"] == -1
        if again.any():
            rows = df.loc[cut.index[again]]
            cut.loc[rows.index, "action_prob"] = prob.probs(rows, prob.betas)
        part = Brute(cut, betas[: k + 1], cfg)
        part.first_t = part.first_t[: k + 1]
        np.testing.assert_allclose(row["theta"], part.theta, rtol=1e-6)
        scale = len(part.subjects) / n
        stacks = np.vstack([part.stacks(), np.zeros((n - len(part.subjects), (k + 1) * B + Q))])
        bread_inverse = part.bread_inverse() * scale
        weight = np.ones(n)
        if correction != "none":
            bread = np.linalg.inv(bread_inverse[-Q:, -Q:])
            for i, s in enumerate(part.subjects):
                if s in part.by_subject:
                    own = part.by_subject[s]
                    f = part.design(cfg.inference, own, part.probs(own, part.betas))
                    weight[i] = (1 - np.trace(2 * f.T @ f @ bread) / n) ** -2
        meat = (stacks * weight[:, None]).T @ stacks / n
        joint = sandwich(bread_inverse, meat, n, "naive")[-Q:, -Q:]
        np.testing.assert_allclose(np.reshape(row["adjusted_variance"], (Q, Q)), joint, rtol=2e-5)
        assert row["joint_condition"] == pytest.approx(np.linalg.cond(bread_inverse), rel=1e-4)


def test_no_updates(spark):
    """A study that never updates has a theta block only and no ends."""
    cfg = replace(config(), correction="HC1theta")
    _, _, a = analysis(spark, 24, cfg, times=2, period=3)
    assert {(r["row_block"], r["col_block"]) for r in a.products.collect()} == {(0, 0)}
    assert premature_estimates(a.digest, a.sums, a.frame, cfg).collect() == []
    row = a.result.first()
    np.testing.assert_allclose(row["adjusted_variance"], row["classical_variance"], rtol=1e-8)
