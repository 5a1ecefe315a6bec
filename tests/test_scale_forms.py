"""Operators written in parts so that no group has to fit one task, against the plain way."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from trialweave.operators import summaries
from trialweave.sources import events


def test_quartiles_of_a_large_time(spark):
    """More rows than the sketch keeps, all values distinct, beside a small and a tied group."""
    rng = np.random.default_rng(0)
    parts = [(1, rng.uniform(size=45_001)), (2, rng.uniform(size=6)), (3, rng.integers(1, 4, 30_000) / 5)]
    pdf = pd.concat([pd.DataFrame({"calendar_t": t, "action_prob": v}) for t, v in parts])
    log = spark.createDataFrame(pdf).withColumn("study_id", F.lit("s")).withColumn("active", F.lit(1))
    got = {r["calendar_t"]: r for r in summaries.probability_quartiles(log.repartition(8)).collect()}
    for t, v in parts:
        want = np.quantile(v, [0.25, 0.5, 0.75])
        np.testing.assert_allclose([got[t][c] for c in ("q25", "q50", "q75")], want, rtol=1e-12)


def test_dosage_over_several_chunks(spark):
    rng = np.random.default_rng(1)
    actions = rng.integers(0, 2, 1000)
    pdf = pd.DataFrame({"study_id": "s", "subject_id": 1, "calendar_t": range(1000), "action": actions})
    got = events.with_dosage(spark.createDataFrame(pdf)).orderBy("calendar_t").toPandas()
    d, want = 0.0, []
    for a in actions:
        want.append(d)
        d = 0.05 * a + 0.95 * d
    np.testing.assert_allclose(got["dosage"], want, rtol=1e-9, atol=1e-12)
    assert list(got["past_action"][1:]) == list(actions[:-1])


def _observed(spark):
    rng = np.random.default_rng(2)
    rows = [(s, u, t, int(rng.integers(0, 2)), None if rng.integers(0, 9) == 0 else float(rng.normal()))
            for s in ("a", "b") for u in (None, *range(12)) for t in range(3, 25) if rng.integers(0, 2)]
    return spark.createDataFrame(rows, "study_id string, subject_id long, calendar_t int, action int, reward double")


def test_past_of_the_grid_from_observed_rows(spark):
    """The value before is the same as by a window over the grid, without a sort of the grid."""
    one = events.with_past(events.full_grid(_observed(spark), past="reward"))
    other = events.with_past(events.full_grid(_observed(spark)))
    assert one.columns == other.columns
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(one) == rows(other)
    assert one.filter("past_reward <> 0").count() > 50


def test_grids_are_written_without_a_sort(spark, tmp_path):
    from trialweave import session
    from trialweave.plans import studies

    pd.DataFrame({"event_id": range(60), "ts": pd.Timestamp("2024-01-03") + pd.to_timedelta(np.arange(60) % 9, "D"),
                  "user_id": np.arange(60) % 7, "event_type": "click", "value": 1.0, "props": "{}"}).astype(
        {"ts": "datetime64[us]"}).to_parquet(tmp_path / "events.parquet")
    grid = studies.events_grid(spark, str(tmp_path))
    plan = grid._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Window") and plan.count("Window [") <= 2
    before = spark.conf.get(session.OPEN_FILES)
    back = session.written(grid, "grid", by="active")
    assert spark.conf.get(session.OPEN_FILES) == before
    assert sorted(map(repr, back.select(grid.columns).collect())) == sorted(map(repr, grid.collect()))
