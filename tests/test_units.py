"""Small fixtures with known answers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialweave.config import AnalysisConfig, LinearModel, LogColumns, LogisticPolicy
from trialweave.functions import matrix as mx
from trialweave.functions import scalar
from trialweave.operators import checks, ordered, posterior
from trialweave.sources import tables


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns))


def test_gradient_of_hard_clipped_policy(spark):
    """Inside the limits the logistic derivative, at a limit nothing."""
    # Advantage 1 at steepness 1; with limits 0.1 and 0.9 it is inside, at 3 it is cut.
    rows = spark.createDataFrame([(1.0, 0), (3.0, 0), (1.0, 1)], "z double, a int")
    lim = (F.lit(0.1), F.lit(0.9), F.lit(1.0))
    out = rows.select(
        scalar.hard_clipped_slope(F.col("z"), *lim).alias("g"),
        scalar.score_slope(
            scalar.hard_clipped_slope(F.col("z"), *lim), scalar.hard_clipped(F.col("z"), *lim), F.col("a")
        ).alias("s"),
    ).collect()
    assert out[0]["g"] == pytest.approx(0.19661194, abs=1e-8)
    assert out[0]["s"] == pytest.approx(-0.73105858, abs=1e-8)
    assert out[1]["g"] == 0.0 and out[1]["s"] == 0.0
    assert out[2]["s"] == pytest.approx(0.19661194 / 0.73105858, abs=1e-7)


def test_decision_weight(spark):
    df = spark.createDataFrame([(0.4, 0.2, 1), (0.4, 0.2, 0), (0.3, 0.3, 1)], "p double, q double, a int")
    got = [r[0] for r in df.select(scalar.decision_weight(F.col("p"), F.col("q"), F.col("a"))).collect()]
    assert got == pytest.approx([2.0, 0.75, 1.0])


@pytest.mark.parametrize("b, q, updates", [(2, 2, 0), (2, 2, 1), (2, 2, 2), (2, 3, 2), (3, 2, 3)])
@pytest.mark.parametrize("repair", ["none", "inverse_bread_structure_aware_inversion"])
def test_block_inverse(b, q, updates, repair):
    rng = np.random.default_rng(b * 10 + q + updates)
    size = updates * b + q
    m = np.tril(rng.normal(size=(size, size))) + 3 * np.eye(size)
    for k in range(updates + 1):
        lo, hi = k * b, (k * b + q if k == updates else (k + 1) * b)
        m[lo:hi, lo:hi] += 0.1 * rng.normal(size=(hi - lo, hi - lo))
    got, _ = mx.repaired_inverse(m, repair, b, q, limit=0.0)
    np.testing.assert_allclose(got @ m, np.eye(size), atol=1e-9)


def test_inverse_repairs_reach_their_conditions():
    rng = np.random.default_rng(0)
    u, _ = np.linalg.qr(rng.normal(size=(4, 4)))
    m = u @ np.diag([1.0, 0.5, 1e-3, 1e-8]) @ u.T
    _, used = mx.repaired_inverse(m, "trim_small_singular_values")
    assert used == pytest.approx(1000.0)
    _, used = mx.repaired_inverse(m, "add_ridge_fixed_condition_number")
    assert used == pytest.approx(1e4, rel=1e-3)
    _, used = mx.repaired_inverse(m, "add_ridge_median_singular_value_fraction")
    assert used < 1e3


def test_sandwich_methods_agree():
    rng = np.random.default_rng(3)
    bread = np.tril(rng.normal(size=(6, 6))) + 4 * np.eye(6)
    half = rng.normal(size=(6, 6))
    meat = half @ half.T
    results = [mx.sandwich(bread, meat, 10, m) for m in ("bread_inverse_T_qr", "meat_svd_solve", "naive")]
    np.testing.assert_allclose(results[0], results[2], rtol=1e-9)
    np.testing.assert_allclose(results[1], results[2], rtol=1e-9)


def test_stabilise():
    rng = np.random.default_rng(4)
    m = np.diag([1.0, 1e-6, 2.0, 2.0, 1.0, 1.0])
    m[2:4, :2] = 1e6
    out, audit = mx.stabilise(m, 2, 2)
    assert np.linalg.cond(out[:2, :2]) == pytest.approx(200.0, rel=0.02)
    assert np.linalg.cond(out[:4, :4]) <= 1e4 * 1.001
    assert audit[0]["diagonal_ridge"] > 0 and audit[1]["damping"] < 1
    np.testing.assert_array_equal(out[4:], m[4:])
    fine = np.tril(rng.normal(size=(6, 6))) + 5 * np.eye(6)
    same, audit = mx.stabilise(fine, 2, 2)
    np.testing.assert_array_equal(same, fine)
    assert all(a["damping"] == 1 and a["diagonal_ridge"] == 0 for a in audit)


def test_zero_small_blocks_looks_left_of_the_diagonal():
    m = np.eye(6)
    m[2:4, :2], m[4:, 2:4] = 1e-5, 0.5
    out = mx.zero_small_blocks(m, 2, 2)
    assert np.all(out[2:4, :2] == 0) and np.all(out[4:, 2:4] == 0.5)


def clean_log(spark, rows=None):
    data = []
    for s in range(3):
        for t in range(4):
            data.append([str("a"), s, t, 1, (s + t) % 2, t // 2, 0.4, 1.0 * t])
    for at, column, value in rows or []:
        data[at][column] = value
    return spark.createDataFrame(
        [tuple(r) for r in data],
        "study_id string, subject_id long, calendar_t int, active int, action int, policy_num int,"
        "action_prob double, reward double",
    )


@pytest.mark.parametrize(
    "change, check, sample",
    [
        ([], None, None),
        ([(5, 4, 2)], "actions_binary", "1|1"),
        ([(5, 4, None)], "actions_binary", "1|1"),
        ([(5, 3, 3)], "active_flags_binary", "1|1"),
        ([(2, 6, 1.0)], "probabilities_inside_unit_interval", "0|2"),
        ([(2, 6, 0.0)], "probabilities_inside_unit_interval", "0|2"),
        ([(0, 1, None)], "subject_ids_not_null", "0"),
        ([(i, 5, 3) for i in (2, 3, 6, 7, 10, 11)], "policy_numbers_consecutive", None),
        ([(i, 2, 7) for i in (3, 7, 11)], "times_consecutive", None),
        ([(3, 2, 2)], "every_subject_has_every_time", "0"),
        ([(0, 5, 1), (3, 5, 0)], "policy_numbers_do_not_fall", "0|1"),
    ],
)
def test_log_checks_find_what_is_wrong(spark, change, check, sample):
    found = {
        r["check"]: r["sample"]
        for r in checks.all_log_checks(clean_log(spark, change)).filter("violations > 0").collect()
    }
    if check is None:
        assert not found
        return
    assert check in found
    if sample:
        assert found[check] == sample


def test_raise_on_errors(spark):
    checks.raise_on_errors(checks.all_log_checks(clean_log(spark)))
    with pytest.raises(ValueError, match="actions_binary"):
        checks.raise_on_errors(checks.all_log_checks(clean_log(spark, [(5, 4, 2)])))


def test_schema_problems(spark):
    df = clean_log(spark).withColumn("reward", F.col("reward").cast("string")).drop("action")
    found = checks.schema_problems(df, LogColumns())
    assert "missing column action" in found and any("reward" in f for f in found)


def test_column_roles(spark):
    raw = clean_log(spark).withColumnRenamed("subject_id", "user_id").withColumn("x", F.lit(1))
    raw = raw.drop("study_id").withColumn("policy_num", F.col("policy_num").cast("float"))
    out = LogColumns(study_id=None, subject_id="user_id", features=("x",)).standardise(raw)
    assert dict(out.dtypes)["policy_num"] == "int" and "user_id" not in out.columns
    with pytest.raises(ValueError, match="nothere"):
        LogColumns(reward="nothere").standardise(raw)


def test_config_warnings_and_errors():
    with pytest.warns(UserWarning):
        notes = AnalysisConfig(inference=LinearModel(), stabilise=False).advise()
    assert len(notes) == 3
    with pytest.raises(ValueError):
        AnalysisConfig(correction="HC9")
    with pytest.raises(ValueError):
        LogisticPolicy(clip="round")


def test_flatten_nested_inputs(spark):
    nested = spark.createDataFrame(
        [("a", 1, {7: ([1.0, 2.0], 0.1), 8: None})],
        "study_id string, calendar_t int, subjects map<long, struct<beta:array<double>, lower:double>>",
    )
    rows = {r["subject_id"]: r["inputs"] for r in tables.flatten_policy_inputs(nested).collect()}
    assert rows[8] is None and rows[7]["beta"] == [1.0, 2.0]
    args = "struct<base_states:array<array<double>>, treat_states:array<array<double>>,actions:array<int>,"
    args += "rewards:array<double>,action_probs:array<double>,times:array<int>>"
    nested = spark.createDataFrame(
        [("a", 2, {7: ([[1.0], [1.0]], [[2.0], [3.0]], [0, 1], [0.5, 0.6], [0.3, 0.4], [1, 2]), 8: None})],
        f"study_id string, policy_num int, subjects map<long, {args}>",
    )
    got = tables.flatten_update_rows(nested).orderBy("calendar_t").collect()
    assert [r["treat_state"] for r in got] == [[2.0], [3.0]]
    assert [r["action_prob"] for r in got] == [0.3, 0.4]


def test_posterior_sampling(spark):
    """Packed posterior to advantage moments; sampled and mean-field probabilities are close."""
    rng = np.random.default_rng(1)
    half = rng.normal(size=(4, 4))
    precision = half @ half.T + 4 * np.eye(4)
    mean, n = rng.normal(size=4), 6
    packed = np.concatenate([mean, precision[np.triu_indices(4)] / n]).tolist()
    df = one(spark, beta=packed, x=[1.0, 0.5], n=n)
    row = df.select(posterior.advantage_moments("beta", "x", "n").alias("m")).first()["m"]
    x = np.array([1.0, 0.5])
    var = np.linalg.inv(precision)[2:, 2:]
    assert row["mean"] == pytest.approx(x @ mean[2:]) and row["var"] == pytest.approx(x @ var @ x)
    df = spark.createDataFrame([(0.4, 0.25), (-1.0, 0.5)], "m double, v double")
    got = df.select(
        posterior.sampled_probability(F.col("m"), F.col("v"), 0.1, 0.9, 2.0).alias("s"),
        scalar.posterior_sampling_mean_field(
            F.col("m"), F.col("v"), F.lit(0.1), F.lit(0.9), F.lit(2.0)
        ).alias("f"),
    ).collect()
    assert all(abs(r["s"] - r["f"]) < 0.02 for r in got)


def test_update_weights_late_policy(spark):
    """A subject that never uses policy 2 keeps all its weights in the update of policy 2."""
    data = [("a", 1, 0, -1, 0.5), ("a", 1, 1, 0, 2.0), ("a", 1, 2, 1, 3.0), ("a", 2, 1, 0, 5.0), ("a", 3, 0, -1, 9.0)]
    df = spark.createDataFrame(data, "study_id string, subject_id long, calendar_t int, policy_idx int, weight double")
    frame = spark.createDataFrame([("a", 2)], "study_id string, n_updates int")
    got = {
        (r["subject_id"], r["policy_idx"]): r["weight"]
        for r in ordered.update_weights(df, frame).collect()
    }
    assert got == pytest.approx({(1, 0): 1, (1, 1): 2, (2, 0): 1, (2, 1): 5, (3, 0): 1, (3, 1): 1})
    whole = {r["subject_id"]: r["weight"] for r in ordered.inference_weights(df).collect()}
    assert whole == pytest.approx({1: 6, 2: 5, 3: 1})
