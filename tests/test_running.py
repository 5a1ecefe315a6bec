"""State of the streams: what a batch reads does not grow with the batches before it."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from test_joint import config
from trialweave.plans.monitor import UpdateAssessment
from trialweave.streaming.monitor import NO_DECISIONS, NOTICE_SCHEMA, RunningStatistics, StreamingMonitor

SCHEMA = ("study_id string, subject_id long, calendar_t int, active int, action int, policy_num int,"
          "action_prob double, reward double, intercept double, x double")


def decisions(spark, times, subjects=20):
    rows = [("s", i, t, 1, (i + t) % 2, t // 4, 0.5, 0.1 * i + t, 1.0, (i * 7 + t) % 5 - 2.0) for t in times for i in range(subjects)]
    return spark.createDataFrame(rows, SCHEMA)


def read_bytes(monkeypatch, running, frame, batch_id):
    """Bytes of the state files that a batch reads."""
    paths = []
    real = type(frame).join

    def join(self, other, *args, **kwargs):
        paths.extend(f for f in other.inputFiles() if "/state/" in f)
        return real(self, other, *args, **kwargs)

    monkeypatch.setattr(type(frame), "join", join)
    running.take(frame, batch_id)
    monkeypatch.setattr(type(frame), "join", real)
    return sum(Path(p.removeprefix("file:")).stat().st_size for p in set(paths))


def test_batches_read_their_own_spans(spark, tmp_path, monkeypatch):
    running = RunningStatistics(spark, str(tmp_path / "state"), config().update, span=4)
    read = [read_bytes(monkeypatch, running, decisions(spark, range(4 * b, 4 * b + 4)), b) for b in range(12)]
    assert max(read[6:]) <= max(read[2:5]) * 1.5
    # An old span again, with rows of the newest: nothing counts twice, nothing is lost.
    running.take(decisions(spark, [0, 1, 47, 48]), 12)
    assert running.sums.agg(F.sum("n")).first()[0] == 49 * 20
    late = decisions(spark, [3], 30)
    running.take(late, 13)
    assert running.sums.agg(F.sum("n")).first()[0] == 49 * 20 + 10
    assert running.late.agg(F.sum("n")).first()[0] == 10
    running.take(late, 13)
    assert running.sums.agg(F.sum("n")).first()[0] == 49 * 20 + 10
    running.take(decisions(spark, []), 14)
    assert running.sums.agg(F.sum("n")).first()[0] == 49 * 20 + 10


def test_decisions_delivered_twice_and_notices_without_decisions(spark, tmp_path):
    cfg = config()
    monitor = StreamingMonitor(spark, str(tmp_path / "state"), cfg, SCHEMA)
    log = decisions(spark, range(8))
    for part in (log, log.filter("calendar_t > 3"), log.unionByName(log)):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        monitor.start_decisions(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))).awaitTermination()
    assert monitor.decisions.count() == log.count() and monitor.late.count() == 0
    told = spark.createDataFrame([("s", 1, [0.1, 0.2, 0.3, -0.1]), ("unknown", 1, [0.0] * 4)], NOTICE_SCHEMA)
    told.write.parquet(str(tmp_path / "notices"))
    monitor.start_notices(spark.readStream.schema(NOTICE_SCHEMA).parquet(str(tmp_path / "notices"))).awaitTermination()
    assert [tuple(r) for r in monitor.unjudged.collect()] == [("unknown", 1, NO_DECISIONS)]
    once = UpdateAssessment(log, told.filter("study_id = 's'"), cfg).verdicts().first()
    got = monitor.verdicts.first()
    assert got["study_id"] == "s" and monitor.verdicts.count() == 1
    assert got["whole_condition"] == pytest.approx(once["whole_condition"])
    # Late and delivered twice: set aside once.
    old = decisions(spark, [2], 25)
    for _ in range(2):
        old.write.mode("append").parquet(str(tmp_path / "in"))
        monitor.start_decisions(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))).awaitTermination()
    assert monitor.late.count() == 5 and monitor.decisions.count() == log.count()
