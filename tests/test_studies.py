"""Study-level results against brute force: ends, weights, adjustments, monitor, invariance."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brute import Brute, random_study
from test_joint import config, tables
from trialweave.functions.matrix import sandwich
from trialweave.operators import conditioning, derivatives, ordered, rows
from trialweave.operators import stack as stack_ops
from trialweave.operators.decisions import decisions
from trialweave.operators.horizons import premature_estimates
from trialweave.operators.sandwich import dense_matrix
from trialweave.plans.analysis import Analysis
from trialweave.plans.monitor import UpdateAssessment

B = Q = 4


@pytest.fixture(scope="module")
def study(spark):
    cfg = config()
    df, betas = random_study(11)
    log, params = tables(spark, df, betas)
    return cfg, df, betas, Analysis(log, cfg, params), Brute(df, betas, cfg)


def test_premature_estimates_equal_truncated_studies(study):
    cfg, df, betas, a, brute = study
    got = premature_estimates(a.digest, a.sums, a.frame, cfg).orderBy("end_idx").collect()
    assert len(got) == brute.K
    for row in got:
        k = row["end_idx"]
        end = df[(df["policy_num"] == brute.updates[k]) & (df["active"] == 1)]["calendar_t"].max()
        part = Brute(df[df["calendar_t"] <= end], betas[: k + 1], cfg)
        part.n = brute.n
        np.testing.assert_allclose(row["theta"], part.theta, rtol=1e-6)
        pad = brute.n - len(part.subjects)
        stacks = np.vstack([part.stacks(), np.zeros((pad, (k + 1) * B + Q))])
        bread = part.bread_inverse() * len(part.subjects) / brute.n
        meat = stacks.T @ stacks / brute.n
        joint = sandwich(bread, meat, brute.n, "naive")[-Q:, -Q:]
        np.testing.assert_allclose(np.reshape(row["adjusted_variance"], (Q, Q)), joint, rtol=1e-5)


def test_weighted_stack_with_other_betas(spark, study):
    """Recorded betas differ from the shared ones, so the weights are not 1."""
    cfg, df, betas, a, brute = study
    rng = np.random.default_rng(5)
    moved = betas + rng.normal(scale=0.3, size=betas.shape)
    log, params = tables(spark, df, moved)
    b = Analysis(log, cfg, params)
    behaviour = a.decided.select(*rows.KEY, F.col("pi").alias("behaviour_prob"))
    weighted = ordered.decision_weights(b.decided.join(behaviour, rows.KEY))
    out = ordered.weighted_stack(
        b.stack, ordered.update_weights(weighted, b.frame), ordered.inference_weights(weighted)
    ).toPandas()
    theta = np.array(b.frame.first()["theta"])
    expect = brute.stacks(np.concatenate([moved.ravel(), theta]))
    got = np.zeros_like(expect)
    for _, r in out.iterrows():
        lo = r["block"] * B
        got[brute.subjects.index(r["subject_id"]), lo:lo + B] = r["v"]
    np.testing.assert_allclose(got, expect, rtol=1e-7, atol=1e-9)


def test_explicit_adjustments_equal_joint_sandwich(study):
    cfg, _, _, a, _ = study
    one = conditioning.theta_only_variance(a.stack, a.bread_inverse, a.frame, cfg).first()
    np.testing.assert_allclose(
        one["theta_only_variance"], a.joint.first()["adjusted_variance"], rtol=1e-8
    )


def test_update_functions_equal_finite_differences(spark, study):
    cfg, df, betas, a, brute = study
    update = replace(cfg.update, ridge=0.5)
    long = rows.with_recomputed(rows.update_rows(a.log, a._calendar, update), a.decided)
    got = derivatives.update_functions(long, a.params, update).toPandas()
    brute = Brute(df, betas, replace(cfg, update=update))
    stacks = brute.stacks()
    for _, r in got.iterrows():
        k = brute.updates.index(r["policy_num"])
        want = stacks[brute.subjects.index(r["subject_id"]), k * B:(k + 1) * B]
        np.testing.assert_allclose(r["gradient"], want, rtol=1e-8, atol=1e-9)


def test_prefix_of_previous_betas(study):
    _, _, betas, a, _ = study
    got = {r["policy_num"]: r["previous"] for r in rows.previous_betas(a.params).collect()}
    for k in range(len(betas)):
        np.testing.assert_allclose(np.array(got[k + 1]).reshape(-1, B), betas[:k])


def test_monitor_equals_analysis_and_rejects(spark, study):
    cfg, df, betas, a, brute = study
    before = a.log.filter(F.col("calendar_t") < int(brute.first_t[-1]))
    m = UpdateAssessment(before, a.params, cfg)
    whole = brute.bread_inverse()[: brute.K * B, : brute.K * B]
    got = dense_matrix(m.cells().toPandas(), B, 0, brute.K)
    seen = before.select("subject_id").distinct().count()
    np.testing.assert_allclose(got * seen / brute.n, whole, atol=1e-6)
    newest = dense_matrix(m.cells(m.newest).toPandas(), B, 0, brute.K)
    np.testing.assert_allclose(newest[-B:], got[-B:], rtol=1e-9, atol=1e-12)
    assert np.all(newest[:-B] == 0)
    fine = m.verdicts(1e9, 1e9).first()
    assert not fine["update_rejected"]
    assert fine["whole_condition"] == pytest.approx(np.linalg.cond(got), rel=1e-6)
    assert m.verdicts(1.0, 1.0).first()["rejection_reason"] == "whole_block_poor_conditioning"
    assert m.verdicts(1e9, 1.0).first()["rejection_reason"] == "diagonal_block_poor_conditioning"


def test_partitions_row_order_and_string_ids_do_not_matter(spark, study):
    cfg, df, betas, a, _ = study
    log, params = tables(spark, df.sample(frac=1, random_state=0), betas)
    log = log.withColumn("subject_id", F.concat(F.lit("u"), F.col("subject_id").cast("string")))
    b = Analysis(log.repartition(13), replace(cfg, subjects_per_bucket=3), params)
    x, y = a.result.first(), b.result.first()
    np.testing.assert_allclose(x["adjusted_variance"], y["adjusted_variance"], rtol=1e-9)
    np.testing.assert_allclose(x["theta"], y["theta"], rtol=1e-9)


def test_many_studies_in_one_job_and_one_large_one(spark):
    """A study with most subjects beside small ones: each result is as if it were alone."""
    cfg = config(subjects_per_bucket=8)
    frames, betas_of = [], {}
    for seed, subjects in ((21, 60), (22, 10), (23, 12)):
        df, betas = random_study(seed, subjects=subjects, times=6)
        frames.append(df)
        betas_of[seed] = betas
    logs = [tables(spark, df, betas_of[s]) for s, df in zip(betas_of, frames)]
    log = logs[0][0].unionByName(logs[1][0]).unionByName(logs[2][0])
    params = logs[0][1].unionByName(logs[1][1]).unionByName(logs[2][1])
    together = {r["study_id"]: r for r in Analysis(log, cfg, params).result.collect()}
    for one_log, one_params in logs[1:]:
        alone = Analysis(one_log, cfg, one_params).result.first()
        np.testing.assert_allclose(
            together[alone["study_id"]]["adjusted_variance"], alone["adjusted_variance"], rtol=1e-9
        )


def test_sinks(spark, study, tmp_path):
    from trialweave.operators.features import study_features, wide_features
    from trialweave.sources import sinks

    a = study[3]
    sinks.write_analysis(a, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "analysis")).count() == 1
    sinks.write_debug_pieces(a, str(tmp_path / "debug"))
    assert len(list((tmp_path / "debug").iterdir())) == 14
    features = study_features(a)
    sinks.write_study_features(features, str(tmp_path / "features"))
    sinks.write_study_features(features, str(tmp_path / "features"))
    back = spark.read.parquet(str(tmp_path / "features"))
    assert back.filter("name = 'max_reward'").count() == 1  # a rerun changes nothing
    other = spark.createDataFrame([("another", "max_reward", None, None, 1.0)], features.schema)
    sinks.write_study_features(other, str(tmp_path / "features"))
    assert spark.read.parquet(str(tmp_path / "features")).filter("name = 'max_reward'").count() == 2
    wide = wide_features(features, ["max_reward", "max_estimating_function_stack_norm"]).first()
    stacks = study[4].stacks()
    assert wide["max_estimating_function_stack_norm"] == pytest.approx(
        np.linalg.norm(stacks, axis=1).max()
    )
    sinks.write_policy_params(a.params, B, str(tmp_path / "params"))
    assert "beta_3" in spark.read.parquet(str(tmp_path / "params")).columns


def test_late_decisions_are_set_aside_and_counted(spark, study, tmp_path):
    """Rows that arrive after the update they belong to is closed do not change its matrix."""
    from trialweave.sources.tables import POLICY_PARAMS_SCHEMA
    from trialweave.streaming.monitor import StreamingMonitor

    cfg, df, betas, a, brute = study
    schema = a.log.schema
    monitor = StreamingMonitor(spark, str(tmp_path / "state"), cfg, schema)
    cut = int(brute.first_t[0])
    late = (F.col("subject_id") == 0) & (F.col("calendar_t") < cut)
    known = a.log.filter((F.col("calendar_t") < cut) & ~late)
    known.write.parquet(str(tmp_path / "decisions"))
    stream = spark.readStream.schema(a.log.schema).parquet(str(tmp_path / "decisions"))
    monitor.start_decisions(stream).awaitTermination()
    a.params.filter("policy_num = 1").select("study_id", "policy_num", "beta").write.parquet(
        str(tmp_path / "notices")
    )
    notices = spark.readStream.schema(POLICY_PARAMS_SCHEMA).parquet(str(tmp_path / "notices"))
    monitor.start_notices(notices).awaitTermination()
    before = sorted(map(tuple, monitor.cells.collect()))
    a.log.filter(late).write.mode("append").parquet(str(tmp_path / "decisions"))
    monitor.start_decisions(stream).awaitTermination()
    assert monitor.late.count() == a.log.filter(late).count() > 0
    assert monitor.decisions.count() == known.count()
    monitor.start_notices(notices).awaitTermination()
    assert sorted(map(tuple, monitor.cells.collect())) == before
    assert monitor.verdicts.count() == 1


def test_conditions_and_inverses_equal_numpy(study):
    cfg, _, _, a, brute = study
    m = dense_matrix(a.bread_inverse.toPandas(), B, Q, brute.K)
    for r in conditioning.update_conditions(a.bread_inverse, a.frame, cfg).collect():
        lo, hi = r["policy_idx"] * B, (r["policy_idx"] + 1) * B
        assert r["whole_condition"] == pytest.approx(np.linalg.cond(m[:hi, :hi]), rel=1e-6)
        assert r["block_condition"] == pytest.approx(np.linalg.cond(m[lo:hi, lo:hi]), rel=1e-6)
        assert r["inverse_norm"] == pytest.approx(np.linalg.norm(np.linalg.inv(m[:hi, :hi])), rel=1e-6)
        scaled = np.linalg.inv(m[lo:hi, lo:hi]) @ m[lo:hi, :lo]
        want = sum(np.linalg.norm(scaled[:, j:j + B]) for j in range(0, lo, B))
        assert r["scaled_off_diagonal"] == pytest.approx(want, rel=1e-6, abs=1e-9)
    one = conditioning.joint_conditions(a.bread_inverse, a.frame, cfg).first()
    assert one["condition"] == pytest.approx(np.linalg.cond(m), rel=1e-6)
    cells = conditioning.inverted(a.bread_inverse, a.frame, cfg).toPandas()
    np.testing.assert_allclose(dense_matrix(cells, B, Q, brute.K), np.linalg.inv(m), rtol=1e-6, atol=1e-9)
    assert cells["gap_max"].max() < 1e-8
