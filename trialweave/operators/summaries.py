"""Summaries of a study for review and for feature extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialweave.functions import scalar


def study_summary(log: DataFrame) -> DataFrame:
    """Counts and probability range of the active rows of each study.

    Rows are first counted per (study, subject, time, policy) dimension by plain partial sums;
    the distinct counts are taken on the few distinct values, never on one task's raw rows.
    """
    active = log.filter("active = 1")
    number = F.col("policy_num")
    base = active.groupBy("study_id").agg(
        F.count("*").alias("n_decisions"),
        F.count_if(number < 0).alias("n_fallback_decisions"),
        F.min("action_prob").alias("min_action_prob"),
        F.max("action_prob").alias("max_action_prob"),
        F.min(F.when(number >= 0, number)).alias("initial_policy"),
    )
    subjects = (
        active.select("study_id", "subject_id").distinct()
        .groupBy("study_id").agg(F.count("*").alias("n_subjects"))
    )
    per_policy = active.groupBy("study_id", "policy_num").agg(F.count("*").alias("rows"))
    times = (
        active.select("study_id", "calendar_t").distinct()
        .groupBy("study_id").agg(F.count("*").alias("n_times"))
    )
    policies = (
        per_policy.join(base.select("study_id", "initial_policy"), "study_id")
        .groupBy("study_id")
        .agg(
            F.count_if(number > F.col("initial_policy")).alias("n_updates"),
            F.sum(F.when(number == F.col("initial_policy"), F.col("rows")).otherwise(0)).alias(
                "n_rows_before_first_update"
            ),
        )
    )
    several = times_with_several_policies(log)
    return (
        base.join(subjects, "study_id").join(times, "study_id").join(policies, "study_id")
        .join(several, "study_id", "left")
        .withColumn("decisions_per_subject", F.col("n_decisions") / F.col("n_subjects"))
        .withColumn("n_multi_policy_times", F.coalesce("n_multi_policy_times", F.lit(0)))
    )


def times_with_several_policies(log: DataFrame) -> DataFrame:
    """Times of each study at which more than one non-fallback policy was in use."""
    used = log.filter("active = 1 and policy_num >= 0").select(
        "study_id", "calendar_t", "policy_num"
    ).distinct()
    per_time = used.groupBy("study_id", "calendar_t").agg(F.count("*").alias("n"))
    return per_time.groupBy("study_id").agg(F.count_if(F.col("n") > 1).alias("n_multi_policy_times"))


QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
SKETCH_ACCURACY = 10_000


def probability_quartiles(log: DataFrame) -> DataFrame:
    """Exact quartiles of the recorded probability per time, linear between ranks.

    A sketch first gives two bounds for each quartile. With its guaranteed rank error, both order
    statistics that a quartile lies between are between the bounds, or next to them: asked for three
    errors lower and answered within one, the lower bound is at most one rank too high, and so the
    upper one. Rows between the bounds are reduced to (value, count) pairs; of those below only the
    number and the greatest, of those above only the least are kept. No task holds all values of a
    time however many rows it has, and groups of any size go the same way.
    """
    keys = ["study_id", "calendar_t"]
    active = log.filter("active = 1").select(*keys, F.col("action_prob").alias("p"))
    margin = 3.0 / SKETCH_ACCURACY
    steps = [max(0.0, q - margin) for q in QUARTILES.values()]
    steps += [min(1.0, q + margin) for q in QUARTILES.values()]
    sketch = active.groupBy(*keys).agg(
        F.percentile_approx("p", F.array(*[F.lit(x) for x in steps]), SKETCH_ACCURACY).alias("s"),
        F.count("p").alias("n"),
    )
    # Rank 1 + q (n - 1) lies between two order statistics.
    bounds = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"), F.lit(q).alias("q"),
                F.get("s", F.lit(i)).alias("lo"), F.get("s", F.lit(i + 3)).alias("hi"),
            )
            for i, (name, q) in enumerate(QUARTILES.items())
        ]
    )
    wanted = sketch.select(*keys, "n", F.explode(bounds).alias("b")).select(*keys, "n", "b.*")
    tagged = active.join(
        sketch.select(*keys, bounds.alias("bounds")), keys
    ).select(*keys, "p", F.explode("bounds").alias("b"))
    side = (F.col("p") > F.col("b.hi")).cast("int") - (F.col("p") < F.col("b.lo")).cast("int")
    counted = (
        tagged.filter("p is not null").withColumn("side", side)
        .groupBy(*keys, "b.name", "side", F.when(F.col("side") == 0, F.col("p")).alias("inside"))
        .agg(F.count("*").alias("c"), F.min("p").alias("least"), F.max("p").alias("greatest"))
        .withColumn("value", F.when(F.col("side") < 0, F.col("greatest")).otherwise(F.col("least")))
    )
    order = Window.partitionBy(*keys, "name").orderBy("value")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("upto", F.sum("c").over(upto)).join(wanted, [*keys, "name"])
    target = F.lit(1.0) + F.col("q") * (F.col("n") - 1)
    found = ranked.groupBy(*keys, "name").agg(
        F.min(F.when(F.col("upto") >= F.floor(target), F.col("value"))).alias("a"),
        F.min(F.when(F.col("upto") >= F.ceil(target), F.col("value"))).alias("b"),
        F.first(target - F.floor(target)).alias("f"),
    )
    value = F.col("a") + F.col("f") * (F.coalesce("b", "a") - F.col("a"))
    return found.groupBy(*keys).pivot("name", list(QUARTILES)).agg(F.first(value))


def time_statistics(log: DataFrame) -> DataFrame:
    """Mean and sample deviation of the logit probability and the reward per time."""
    value = scalar.logit(F.col("action_prob"))
    return log.filter("active = 1").groupBy("study_id", "calendar_t").agg(
        F.avg(value).alias("logit_mean"), F.stddev_samp(value).alias("logit_std"),
        F.avg("reward").alias("reward_mean"), F.stddev_samp("reward").alias("reward_std"),
        F.max("reward").alias("reward_max"),
    )


def stack_norms(stack: DataFrame) -> DataFrame:
    """Norm of the whole stack of each subject."""
    return (
        stack.filter("kind = 'phi'")
        .select("study_id", "subject_id", F.explode("v").alias("x"))
        .groupBy("study_id", "subject_id")
        .agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    )


def segment_norms(stack: DataFrame, frame: DataFrame) -> DataFrame:
    """Mean over all subjects of the norm of each block."""
    squared = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)
    return (
        stack.filter("kind = 'phi'")
        .groupBy("study_id", "block")
        .agg(F.sum(F.sqrt(squared)).alias("total"))
        .join(frame.select("study_id", "n_subjects"), "study_id")
        .select("study_id", "block", (F.col("total") / F.col("n_subjects")).alias("mean_norm"))
    )
