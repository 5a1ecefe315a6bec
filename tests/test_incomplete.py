"""Nothing is dropped silently: unusable studies, repeated notices, late rows of running sums."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import random_study
from test_joint import config, tables
from trialweave.operators import checks, ordered
from trialweave.operators.decisions import decisions
from trialweave.operators.frame import policy_index, study_frame, with_betas
from trialweave.operators.sandwich import dense_matrix
from trialweave.plans.analysis import Analysis
from trialweave.plans.monitor import UpdateAssessment, proposed_frame
from trialweave.streaming.monitor import NOTICE_SCHEMA, RunningStatistics, StreamingMonitor

B = 4


@pytest.fixture(scope="module")
def pair(spark):
    """A healthy study and one beside it, to be made unusable."""
    cfg = config()
    df, betas = random_study(21, subjects=10, times=6)
    log, params = tables(spark, df, betas)
    other = log.withColumn("study_id", F.lit("zz_bad"))
    return cfg, log, params, other, params.withColumn("study_id", F.lit("zz_bad"))


@pytest.mark.parametrize("fault", ["missing", "null", "nan"])
def test_a_study_without_betas_keeps_its_row(pair, fault):
    cfg, log, params, other, bad = pair
    last = bad.agg(F.max("policy_num")).first()[0]
    if fault == "missing":
        bad = bad.filter(F.col("policy_num") < last)
    else:
        value = F.lit(None) if fault == "null" else F.array(*[F.lit(float("nan"))] * B)
        bad = bad.withColumn("beta", F.when(F.col("policy_num") == last, value.cast("array<double>"))
                             .otherwise(F.col("beta")))
    both = Analysis(log.unionByName(other), cfg, params.unionByName(bad))
    rows = {r["study_id"]: r for r in both.result.collect()}
    alone = Analysis(log, cfg, params).result.first()
    good = rows[alone["study_id"]]
    np.testing.assert_allclose(good["adjusted_variance"], alone["adjusted_variance"], rtol=1e-9)
    assert good["reason"] is None
    assert rows["zz_bad"]["adjusted_variance"] is None
    assert rows["zz_bad"]["reason"] == "learned_policy_without_finite_beta"
    found = {r["study_id"]: r["violations"] for r in checks.policies_have_betas(
        with_betas(study_frame(log.unionByName(other)), params.unionByName(bad)), B).collect()}
    assert found["zz_bad"] == 1 and found[alone["study_id"]] == 0


def test_a_study_without_active_rows_keeps_its_row(pair):
    cfg, log, params, other, _ = pair
    idle = other.withColumn("active", F.lit(0))
    frame = study_frame(log.unionByName(idle))
    row = frame.filter("study_id = 'zz_bad'").first()
    assert row["n_updates"] == 0 and row["policy_nums"] == [] and row["initial_policy"] is None
    assert policy_index(idle).count() == 0
    rows = {r["study_id"]: r for r in Analysis(log.unionByName(idle), cfg, params).result.collect()}
    assert rows["zz_bad"]["reason"] == "no_active_decisions" and len(rows) == 2
    assert [r["reason"] for s, r in rows.items() if s != "zz_bad"] == [None]


def test_weights_of_a_study_without_updates(pair):
    cfg, log, params, _, _ = pair
    first = log.withColumn("policy_num", F.when(F.col("active") == 1, F.lit(0)))
    frame = with_betas(study_frame(first), params)
    assert frame.first()["n_updates"] == 0
    decided = decisions(first, frame, cfg).withColumn("behaviour_prob", F.col("pi"))
    assert ordered.update_weights(ordered.decision_weights(decided), frame).count() == 0


def test_the_message_of_many_errors_names_every_check(spark):
    report = spark.createDataFrame(
        [(c, f"s{i}", "error", 1, "x") for c in ("one", "two") for i in range(50)] + [("three", "s0", "warning", 4, "x")],
        "check string, study_id string, severity string, violations long, sample string")
    with pytest.raises(ValueError, match="one: 50 in 50 studies.*two: 50 in 50 studies") as raised:
        checks.raise_on_errors(report)
    assert "three" not in str(raised.value)


def test_a_policy_that_decides_is_not_proposed_twice(pair):
    _, log, params, _, _ = pair
    used = study_frame(log).first()["policy_nums"]
    frame = proposed_frame(log, params.select("study_id", "policy_num")).first()
    assert frame["policy_nums"] == used and frame["n_updates"] == len(used)
    early = log.filter(F.col("policy_num") < used[0])
    ahead = proposed_frame(early, params.filter(F.col("policy_num") >= used[0])).first()
    assert ahead["policy_nums"] == sorted(set(used)) and set(ahead["update_times"]) == {ahead["t_max"] + 1}


def test_notices_together_and_again(spark, pair, tmp_path):
    """Two notices in one batch are both judged; a second notice of a policy replaces the first."""
    cfg, log, params, _, _ = pair
    policies = sorted(study_frame(log).first()["policy_nums"])
    cut = log.filter(F.col("policy_num") == policies[0]).agg(F.min("calendar_t")).first()[0]
    monitor = StreamingMonitor(spark, str(tmp_path / "state"), cfg, log.schema)
    log.filter(F.col("calendar_t") < cut).write.parquet(str(tmp_path / "decisions"))
    monitor.start_decisions(spark.readStream.schema(log.schema).parquet(str(tmp_path / "decisions"))).awaitTermination()
    told = params.filter(F.col("policy_num").isin(policies[:2])).select("study_id", "policy_num", "beta")

    def notice(rows):
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "notices"))
        stream = spark.readStream.schema(NOTICE_SCHEMA).parquet(str(tmp_path / "notices"))
        monitor.start_notices(stream).awaitTermination()

    notice(told)
    assert monitor.verdicts.count() == 2
    assert {r[0] for r in monitor.cells.select("row_block").collect()} == {0, 1}
    other = told.filter(F.col("policy_num") == policies[0]).withColumn("beta", F.transform("beta", lambda x: x * 0.5))
    notice(other)
    assert monitor.verdicts.count() == 3
    assert monitor.params.count() == 2
    before = log.filter(F.col("calendar_t") < cut)
    alone = UpdateAssessment(before, other, cfg)
    got = dense_matrix(monitor.cells.filter("row_block = 0").toPandas(), B, 0, 1)
    want = dense_matrix(alone.cells().toPandas(), B, 0, 1)
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_running_sums_lose_nothing(spark, pair, tmp_path):
    cfg, log, _, _, _ = pair
    running = RunningStatistics(spark, str(tmp_path / "state"), cfg.update)
    last = log.agg(F.max("calendar_t")).first()[0]
    for part in (log.filter(F.col("calendar_t") == last), log, log.filter(F.col("calendar_t") < 3)):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        running.start(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))).awaitTermination()
    active = log.filter("active = 1")
    want = {r["policy_num"]: r["count"] for r in active.groupBy("policy_num").count().collect()}
    assert {r["policy_num"]: r["n"] for r in running.sums.collect()} == want
    late = active.filter(F.col("calendar_t") < last).count()
    assert running.late.agg(F.sum("n")).first()[0] == late
    again = {c: running.sums.agg(F.sum(c)).first()[0] for c in running.sums.columns if c.startswith("u_")}
    running.take(log, 99)
    assert {c: running.sums.agg(F.sum(c)).first()[0] for c in again} == pytest.approx(again)


def test_an_analysis_runs_its_checks(pair):
    cfg, log, params, _, _ = pair
    whole = Analysis(log, cfg, params)
    names = {r["check"] for r in whole.checks.select("check").distinct().collect()}
    assert {"learned_policies_have_finite_betas", "mean_stack_near_zero", "probabilities_recomputed"} <= names
    # The betas of this study are drawn, not estimated, so its mean stack is not zero.
    bad = whole.checks.filter("severity = 'error' and violations > 0").select("check").distinct().collect()
    assert [r["check"] for r in bad] == ["mean_stack_near_zero"]
    last = params.agg(F.max("policy_num")).first()[0]
    broken = Analysis(log, cfg, params.filter(F.col("policy_num") < last))
    with pytest.raises(ValueError, match="learned_policies_have_finite_betas: 1 in 1 studies.*mean_stack_near_zero"):
        broken.checked()
    assert Analysis(log, replace(cfg, suppress_checks=True), params.filter(F.col("policy_num") < last)).checked()
