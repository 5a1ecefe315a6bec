"""Full-grid decision logs from raw event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.session import written


def daily_actions(events: DataFrame, origin: str = "2024-01-01") -> DataFrame:
    """One row per user and day with events: action 1 on a purchase or click, summed value.

    Values are added as whole hundredths, so the sums do not depend on row order.
    """
    acted = F.col("event_type").isin("purchase", "click")
    return (
        events.select(
            F.concat(F.lit("cohort_"), F.pmod("user_id", F.lit(2)).cast("string")).alias("study_id"),
            F.col("user_id").alias("subject_id"),
            F.datediff(F.to_date("ts"), F.to_date(F.lit(origin))).alias("calendar_t"),
            acted.cast("int").alias("acted"),
            F.round(F.col("value") * 100).cast("long").alias("cents"),
        )
        .groupBy("study_id", "subject_id", "calendar_t")
        .agg(F.max("acted").alias("action"), (F.sum("cents") / 10000.0).alias("reward"))
    )


def monthly_orders(orders: DataFrame, customer: DataFrame, first_year: int = 1995) -> DataFrame:
    """One row per customer and month with orders, by market segment."""
    month = (F.year("o_orderdate") - F.lit(first_year)) * 12 + F.month("o_orderdate") - 1
    urgent = F.substring("o_orderpriority", 1, 1).isin("1", "2")
    return (
        orders.join(
            customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey"
        )
        .select(
            F.col("c_mktsegment").alias("study_id"),
            F.col("o_custkey").alias("subject_id"),
            month.cast("int").alias("calendar_t"),
            urgent.cast("int").alias("acted"),
            F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
        )
        .groupBy("study_id", "subject_id", "calendar_t")
        .agg(F.max("acted").alias("action"), (F.sum("cents") / 1e8).alias("reward"))
    )


def full_grid(observed: DataFrame, past: str | None = None) -> DataFrame:
    """Every subject at every time of its study; ``active`` marks the observed rows.

    ``past`` names a column whose value at the time before is added as ``past_`` and the name, 0 if
    there was none. It is taken among the observed rows, so the far longer grid is never sorted.

    An observed row fills the gap up to the subject's next one, and the first also the time before
    it, so the rows are dealt once, by subject, and windows by subject that follow find them so.
    The bounds are a written table of one row per study, small enough to be sent to all tasks or
    joined by size. Observed rows without a study or a time have no place in the grid.
    """
    bounds = written(
        observed.groupBy("study_id").agg(
            F.min("calendar_t").alias("t_min"), F.max("calendar_t").alias("t_max")
        ),
        "grid-bounds",
    )
    mine = Window.partitionBy("study_id", "subject_id").orderBy("calendar_t")
    t = F.col("calendar_t")
    values = [c for c in observed.columns if c not in ("study_id", "subject_id", "calendar_t")]
    first = F.when(F.col("before").isNull(), F.col("t_min")).otherwise(t)
    last = F.greatest(F.coalesce(F.col("after") - 1, F.col("t_max")), t)
    # An observed row of the time before, or of the same time where one comes twice.
    near = F.when(F.col("before") >= t - 1, F.lag(past).over(mine)) if past else F.lit(None)
    one_before = F.when(F.col("time") == t, F.col("near")).when(F.col("time") == t + 1, F.col(past or "near"))
    return (
        observed.filter(t.isNotNull()).join(bounds, "study_id")
        .withColumn("before", F.lag("calendar_t").over(mine))
        .withColumn("after", F.lead("calendar_t").over(mine))
        .withColumn("near", near)
        .withColumn("time", F.explode(F.sequence(first, last)))
        .select(
            "study_id", "subject_id", F.col("time").alias("calendar_t"),
            *[F.when(F.col("time") == t, F.col(c)).alias(c) for c in values],
            (F.col("time") == t).cast("int").alias("active"),
            *([F.coalesce(one_before, F.lit(0.0)).alias(f"past_{past}")] if past else []),
        )
    )


def with_policies(grid: DataFrame, period: int) -> DataFrame:
    """Policy number by calendar time, null where inactive."""
    number = F.floor(F.col("calendar_t") / F.lit(period)).cast("int")
    return grid.withColumn("policy_num", F.when(F.col("active") == 1, number))


def with_past(grid: DataFrame) -> DataFrame:
    """State features: an intercept and the reward of the time before, 0 if there was none.

    A grid made with ``past="reward"`` has the latter. Another has one row per subject and time, so the
    window is as long as the study.
    """
    w = Window.partitionBy("study_id", "subject_id").orderBy("calendar_t")
    before = F.col("past_reward") if "past_reward" in grid.columns else F.coalesce(F.lag("reward").over(w), F.lit(0.0))
    kept = [c for c in grid.columns if c != "past_reward"]
    return grid.select(*kept, F.lit(1.0).alias("intercept"), before.alias("past_reward"))


DOSAGE_CHUNK = 256


def with_dosage(grid: DataFrame, gamma: float = 0.95) -> DataFrame:
    """Past action and decayed dosage: ``d' = (1 - gamma) a + gamma d``, from the past only.

    The action at time s counts ``(1 - gamma) gamma^(t-1-s)`` at t. Times are cut into chunks: a
    running sum within the chunk, plus what earlier chunks left behind, taken from one total per
    chunk. The work is linear in the length of the study and the powers stay in range.
    """
    keys = ["study_id", "subject_id"]
    t, g = F.col("calendar_t"), F.lit(gamma)
    chunk = F.floor(t / DOSAGE_CHUNK).cast("int")
    given = F.lit(1.0 - gamma) * F.coalesce("action", F.lit(0))
    placed = grid.withColumn("chunk", chunk).withColumn("local", t - F.col("chunk") * DOSAGE_CHUNK)
    inside = (
        Window.partitionBy(*keys, "chunk").orderBy("calendar_t")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    within = F.sum(given * F.pow(g, -F.col("local"))).over(inside) * F.pow(g, F.col("local") - 1)
    totals = placed.groupBy(*keys, "chunk").agg(
        F.sum(given * F.pow(g, DOSAGE_CHUNK - 1 - F.col("local"))).alias("left_behind")
    )
    before = (
        Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    earlier = F.collect_list(F.struct("chunk", "left_behind")).over(before)
    carried = totals.withColumn("earlier", earlier).select(
        *keys, "chunk",
        F.aggregate(
            "earlier", F.lit(0.0),
            lambda acc, x: acc
            + x["left_behind"] * F.pow(g, (F.col("chunk") - 1 - x["chunk"]) * DOSAGE_CHUNK),
        ).alias("carried"),
    )
    by_time = Window.partitionBy(*keys).orderBy("calendar_t")
    return (
        placed.withColumn("within", F.coalesce(within, F.lit(0.0)))
        .withColumn("past_action", F.coalesce(F.lag("action").over(by_time), F.lit(0)))
        .join(carried, [*keys, "chunk"])
        .withColumn("dosage", F.col("within") + F.col("carried") * F.pow(g, F.col("local")))
        .drop("chunk", "local", "within", "carried")
    )


def recorded_probability(initial: float, learned: Column) -> Column:
    """Probability to record: ``initial`` while no beta applies."""
    return F.when(F.col("active") == 1, F.coalesce(learned, F.lit(initial)))
