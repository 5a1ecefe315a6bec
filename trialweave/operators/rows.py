"""Row-level selections and lookups on decision logs and the tables derived from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.config import AnalysisConfig, LinearModel, LogisticPolicy
from trialweave.functions import scalar

KEY = ["study_id", "subject_id", "calendar_t"]


def active_rows(log: DataFrame, *columns: str) -> DataFrame:
    return log.filter("active = 1").select(*KEY, *columns)


def masked_logit(log: DataFrame) -> DataFrame:
    """Logit of the recorded probability, null where inactive."""
    return log.withColumn(
        "action_prob_logit", F.when(F.col("active") == 1, scalar.logit(F.col("action_prob")))
    )


def inference_columns(log: DataFrame, model: LinearModel) -> DataFrame:
    """The columns the theta function reads, active rows only."""
    names = dict.fromkeys([*model.base, *model.treat, "action", "reward"])
    if model.centered:
        names["action_prob"] = None
    return active_rows(log, *names)


def pre_post_update(log: DataFrame, calendar: DataFrame) -> DataFrame:
    """Active rows marked ``pre`` (initial policy), ``post`` (learned) or ``fallback``."""
    initial = calendar.select("study_id", "initial_policy")
    number, first = F.col("policy_num"), F.col("initial_policy")
    phase = F.when(number < 0, "fallback").when(number == first, "pre").otherwise("post")
    return (
        active_rows(log, "policy_num", "action_prob").join(initial, "study_id")
        .withColumn("phase", phase).drop("initial_policy")
    )


def since_policy(log: DataFrame, last_seen: int) -> DataFrame:
    """Data of an incremental update: active rows under policies after ``last_seen``."""
    return log.filter((F.col("active") == 1) & (F.col("policy_num") > last_seen))


def policy_inputs(log: DataFrame, params: DataFrame, policy: LogisticPolicy) -> DataFrame:
    """Inputs of the probability function per subject and time, null struct where inactive.

    The betas come from a small table with one row per policy; the initial policy has none.
    """
    def number(v: float | str) -> Column:
        return F.col(v).cast("double") if isinstance(v, str) else F.lit(float(v))

    joined = log.join(params.select("study_id", "policy_num", "beta"), ["study_id", "policy_num"], "left")
    inputs = F.struct(
        F.col("beta"),
        number(policy.lower).alias("lower"),
        number(policy.steepness).alias("steepness"),
        number(policy.upper).alias("upper"),
        F.array(*[F.col(c).cast("double") for c in policy.treat]).alias("treat_state"),
    )
    return joined.select(*KEY, "policy_num", F.when(F.col("active") == 1, inputs).alias("inputs"))


def replace_input(inputs: DataFrame, field: str, value: Column) -> DataFrame:
    """Replace one argument of the inputs; blank inputs stay blank."""
    return inputs.withColumn(
        "inputs", F.when(F.col("inputs").isNotNull(), F.col("inputs").withField(field, value))
    )


def share_betas(inputs: DataFrame, params: DataFrame) -> DataFrame:
    """Put the shared beta of each row's policy into its inputs; without one the own beta stays."""
    shared = params.select("study_id", "policy_num", F.col("beta").alias("shared"))
    joined = inputs.join(shared, ["study_id", "policy_num"], "left")
    return replace_input(joined, "beta", F.coalesce("shared", "inputs.beta")).drop("shared")


def update_rows(log: DataFrame, calendar: DataFrame, model: LinearModel) -> DataFrame:
    """Data of every update in long form: all active rows before the update took effect.

    Each row finds its segment by an array index and is copied to the updates it feeds, so the
    range condition costs no join on a range.
    """
    offset = F.col("calendar_t") - F.col("t_min")
    fed = F.slice("policy_nums", F.get("seg_by_t", offset) + 1, F.size("policy_nums"))
    return (
        log.filter("active = 1")
        .join(calendar.select("study_id", "t_min", "seg_by_t", "policy_nums"), "study_id")
        .select(
            "study_id", F.explode(fed).alias("update_num"), "subject_id", "calendar_t",
            F.array(*[F.col(c).cast("double") for c in model.base]).alias("base_state"),
            F.array(*[F.col(c).cast("double") for c in model.treat]).alias("treat_state"),
            "action", "reward", "action_prob",
        )
        .withColumnRenamed("update_num", "policy_num")
    )


def newest_update(rows: DataFrame) -> DataFrame:
    """Rows of the newest update of each study."""
    newest = rows.groupBy("study_id").agg(F.max("policy_num").alias("policy_num"))
    return rows.join(newest, ["study_id", "policy_num"], "left_semi")


def previous_betas(params: DataFrame) -> DataFrame:
    """For every update the betas of all updates before it, in order. At most K rows per study."""
    earlier = (
        Window.partitionBy("study_id").orderBy("policy_num")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return params.select(
        "study_id", "policy_num", "beta", F.collect_list("beta").over(earlier).alias("previous")
    )


def recomputed_probabilities(decided: DataFrame) -> DataFrame:
    return decided.select(*KEY, "pi")


def with_recomputed(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """Replace the supplied probabilities of update or inference rows by recomputed ones."""
    return (
        rows.join(recomputed_probabilities(decided), KEY, "left")
        .withColumn("action_prob", F.coalesce("pi", "action_prob"))
        .drop("pi")
    )


def disagreements(
    left: DataFrame, right: DataFrame, keys: Sequence[str], column: str, atol: float
) -> DataFrame:
    """Keys at which two sources differ, or that only one of them has."""
    a = left.select(*keys, F.col(column).alias("left_value"), F.lit(1).alias("in_left"))
    b = right.select(*keys, F.col(column).alias("right_value"), F.lit(1).alias("in_right"))
    lv, rv = F.col("left_value"), F.col("right_value")
    differs = ~F.coalesce(
        (lv.isNull() & rv.isNull()) | (F.abs(lv - rv) <= atol), F.lit(False)
    )
    missing = F.col("in_left").isNull() | F.col("in_right").isNull()
    return a.join(b, list(keys), "full").filter(missing | differs)


def uncovered(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present on one side only."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return (
        a.join(b, list(keys), "left_anti").withColumn("side", F.lit("left"))
        .unionByName(b.join(a, list(keys), "left_anti").withColumn("side", F.lit("right")))
    )


def zero_filled_by_subject(
    values: DataFrame, log: DataFrame, calendar: DataFrame, column: str
) -> DataFrame:
    """One row per (study, update, subject); updates a subject has no data for count as zero."""
    subjects = log.select("study_id", "subject_id").distinct()
    grid = subjects.join(calendar.select("study_id", "policy_nums"), "study_id").select(
        "study_id", "subject_id", F.explode("policy_nums").alias("policy_num")
    )
    return grid.join(values, ["study_id", "subject_id", "policy_num"], "left").withColumn(
        column, F.coalesce(column, F.lit(0.0))
    )


def zero_filled_by_time(values: DataFrame, calendar: DataFrame, column: str) -> DataFrame:
    """One row per study, subject and time; times without a value count as zero."""
    subjects = values.select("study_id", "subject_id").distinct()
    grid = subjects.join(calendar.select("study_id", "t_min", "t_max"), "study_id").select(
        "study_id", "subject_id", F.explode(F.sequence("t_min", "t_max")).alias("calendar_t")
    )
    return grid.join(values.select(*KEY, column), KEY, "left").withColumn(
        column, F.coalesce(column, F.lit(0.0))
    )


def actions_at(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """Action of each wanted (study, subject, time) if active."""
    return wanted.select(*KEY).join(active_rows(log, "action"), KEY)


def first_betas(inputs: DataFrame) -> DataFrame:
    """Per policy the beta of the first subject with one, in policy order."""
    return (
        inputs.filter("inputs.beta is not null")
        .groupBy("study_id", "policy_num")
        .agg(F.min_by("inputs.beta", F.struct("subject_id", "calendar_t")).alias("beta"))
    )


def beta_dimension(params: DataFrame) -> DataFrame:
    """Dimension of the betas of each study; ``dims`` other than 1 means they disagree."""
    size = F.size("beta")
    return params.filter("beta is not null").groupBy("study_id").agg(
        F.max(size).alias("beta_dim"), F.count_distinct(size).alias("dims")
    )


def flat_parameters(params: DataFrame, theta: DataFrame, beta_dim: int) -> DataFrame:
    """Betas and theta as one flat vector per study: (study_id, position, value)."""
    order = Window.partitionBy("study_id").orderBy("policy_num")
    ranked = params.withColumn("idx", F.row_number().over(order) - 1)
    betas = ranked.select(
        "study_id", "idx", F.posexplode("beta").alias("pos", "value")
    ).select("study_id", (F.col("idx") * beta_dim + F.col("pos")).alias("position"), "value")
    sizes = params.groupBy("study_id").agg(F.count("*").alias("k"))
    tail = theta.join(sizes, "study_id").select(
        "study_id", "k", F.posexplode("theta").alias("pos", "value")
    ).select("study_id", (F.col("k") * beta_dim + F.col("pos")).alias("position"), "value")
    return betas.unionByName(tail)


def unflattened(flat: DataFrame, sizes: DataFrame, beta_dim: int) -> DataFrame:
    """Inverse of ``flat_parameters``: (study_id, block, pos, value), theta as the last block."""
    block = F.least(F.floor(F.col("position") / beta_dim), F.col("n_updates"))
    return (
        flat.join(sizes.select("study_id", "n_updates"), "study_id")
        .withColumn("block", block.cast("int"))
        .select(
            "study_id", "block", (F.col("position") - F.col("block") * beta_dim).alias("pos"), "value"
        )
    )


def truncated(log: DataFrame, calendar: DataFrame) -> DataFrame:
    """The log once per pretended end: rows up to the last time of each learned policy.

    All ends in one job; a row is copied to the ends at or after its time.
    """
    ends = F.filter(
        F.arrays_zip("policy_nums", "last_times"), lambda e: e["last_times"] >= F.col("calendar_t")
    )
    return (
        log.join(calendar.select("study_id", "policy_nums", "last_times"), "study_id")
        .withColumn("end", F.explode(ends))
        .withColumn("horizon_policy", F.col("end.policy_nums"))
        .withColumn("horizon_t", F.col("end.last_times"))
        .drop("end", "policy_nums", "last_times")
    )
