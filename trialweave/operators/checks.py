"""Data-quality checks as tables: (check, study_id, severity, violations, sample).

Checks of one table are counted together in one aggregation. Nothing is asked of a person; a
caller decides with ``raise_on_errors`` what to do with the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.config import AnalysisConfig, LogColumns
from trialweave.operators import rows as row_ops

# Tolerances of the checks.
PROBABILITY_ATOL = 1e-6
MEAN_STACK_FAIL = 1e-2
MEAN_STACK_WARN = 5e-4
MEAN_STACK_WARN_UPDATE_ONLY = 1e-5
IDENTITY_TOLERANCE = 1e-5
UPDATE_FUNCTION_TOLERANCES = (1e-7, 1e-3)
INFERENCE_FUNCTION_TOLERANCES = (0.0, 1e-2)
EXPLICIT_VARIANCE_RTOL = 3e-2


def _where(*columns: str) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])


def _report(counted: DataFrame, checks: dict[str, tuple[str, Column, Column]]) -> DataFrame:
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("check"), F.lit(severity).alias("severity"),
                F.coalesce(n, F.lit(0)).cast("long").alias("violations"),
                sample.cast("string").alias("sample"),
            )
            for name, (severity, n, sample) in checks.items()
        ]
    )
    return counted.select("study_id", F.explode(entries).alias("e")).select(
        "e.check", "study_id", "e.severity", "e.violations", "e.sample"
    )


def _row_checks(df: DataFrame, checks: dict[str, Column], where: Column) -> DataFrame:
    """Count rows that violate each condition, with the smallest violating key as a sample."""
    aggs = []
    for name, bad in checks.items():
        bad = F.coalesce(bad, F.lit(False))
        aggs += [F.count_if(bad).alias(f"n_{name}"), F.min(F.when(bad, where)).alias(f"s_{name}")]
    return _report(
        df.groupBy("study_id").agg(*aggs),
        {n: ("error", F.col(f"n_{n}"), F.col(f"s_{n}")) for n in checks},
    )


def schema_problems(df: DataFrame, columns: LogColumns) -> list[str]:
    """Missing or non-numeric columns; needs no job."""
    types = dict(df.dtypes)
    wanted = [
        columns.subject_id, columns.calendar_t, columns.active, columns.action,
        columns.policy_num, columns.action_prob, columns.reward, *columns.features,
    ]
    numeric = ("int", "bigint", "smallint", "tinyint", "double", "float", "decimal")
    out = [f"missing column {c}" for c in wanted if c not in types]
    for c in wanted:
        if c in types and c != columns.subject_id and not types[c].startswith(numeric):
            out.append(f"column {c} has type {types[c]}")
    if types.get(columns.subject_id, "").startswith(("map", "array", "struct")):
        out.append(f"column {columns.subject_id} cannot be a key")
    return out


def supply_problems(rows: DataFrame, uses_probabilities: bool) -> list[str]:
    """Times are given exactly if probabilities are given; needs no job."""
    has_times, has_probs = "calendar_t" in rows.columns, "action_prob" in rows.columns
    out = []
    if uses_probabilities and not has_probs:
        out.append("the function uses probabilities but the rows have none")
    if has_probs and not has_times:
        out.append("probabilities are given without times")
    return out


def log_row_checks(log: DataFrame) -> DataFrame:
    """Flags, actions, probabilities and keys of single rows."""
    active = F.col("active") == 1
    prob, action = F.col("action_prob"), F.col("action")
    return _row_checks(
        log,
        {
            "active_flags_binary": F.col("active").isNull() | ~F.col("active").isin(0, 1),
            "actions_binary": active & (action.isNull() | ~action.isin(0, 1)),
            "probabilities_inside_unit_interval": active
            & (prob.isNull() | (prob <= 0.0) | (prob >= 1.0)),
            "subject_ids_not_null": F.col("subject_id").isNull(),
        },
        _where("subject_id", "calendar_t"),
    )


def _consecutive(values: DataFrame, column: str, name: str) -> DataFrame:
    v = F.col(column)
    span = values.groupBy("study_id").agg(
        (F.max(v) - F.min(v) + 1 - F.count("*")).alias("gaps"), F.min(v).alias("low")
    )
    return _report(span, {name: ("error", F.col("gaps"), F.col("low"))})


def policies_consecutive(log: DataFrame) -> DataFrame:
    used = log.filter("active = 1 and policy_num >= 0").select("study_id", "policy_num").distinct()
    return _consecutive(used, "policy_num", "policy_numbers_consecutive")


def times_consecutive(log: DataFrame) -> DataFrame:
    return _consecutive(
        log.select("study_id", "calendar_t").distinct(), "calendar_t", "times_consecutive"
    )


def full_grid_check(log: DataFrame) -> DataFrame:
    """Every subject has every time of its study exactly once."""
    cells = log.groupBy("study_id", "subject_id", "calendar_t").agg(F.count("*").alias("n"))
    per_subject = cells.groupBy("study_id", "subject_id").agg(
        F.count("*").alias("times"), F.max("n").alias("copies")
    )
    times = (
        log.select("study_id", "calendar_t").distinct()
        .groupBy("study_id").agg(F.count("*").alias("all_times"))
    )
    bad = (F.col("times") != F.col("all_times")) | (F.col("copies") > 1)
    return _row_checks(
        per_subject.join(times, "study_id"), {"every_subject_has_every_time": bad},
        _where("subject_id"),
    )


def policies_do_not_fall(log: DataFrame) -> DataFrame:
    """The policy number of a subject never falls, fallbacks aside.

    Checked on the first and last time per (subject, policy): at most K rows per subject.
    """
    spans = log.filter("active = 1 and policy_num >= 0").groupBy(
        "study_id", "subject_id", "policy_num"
    ).agg(F.min("calendar_t").alias("lo"), F.max("calendar_t").alias("hi"))
    order = Window.partitionBy("study_id", "subject_id").orderBy("policy_num")
    seen = spans.withColumn("earlier", F.lag("hi").over(order))
    return _row_checks(
        seen, {"policy_numbers_do_not_fall": F.col("earlier") >= F.col("lo")},
        _where("subject_id", "policy_num"),
    )


def probabilities_recomputed(log: DataFrame, decided: DataFrame) -> DataFrame:
    """Recorded probabilities equal the recomputed ones."""
    bad = F.col("action_prob").isNull() | (F.abs(F.col("pi") - F.col("action_prob")) > PROBABILITY_ATOL)
    return _row_checks(decided, {"probabilities_recomputed": bad}, _where("subject_id", "calendar_t"))


def policies_have_betas(frame: DataFrame, dim: int) -> DataFrame:
    """Every learned policy has a beta of ``dim`` finite numbers; ``frame`` is one with betas."""
    learned = frame.select("study_id", F.explode(F.arrays_zip("policy_nums", "betas")).alias("p"))
    finite = F.forall(
        "beta", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    bad = ~F.coalesce((F.size("beta") == dim) & finite, F.lit(False))
    return _row_checks(
        learned.select("study_id", F.col("p.policy_nums").alias("policy_num"), F.col("p.betas").alias("beta")),
        {"learned_policies_have_finite_betas": bad}, _where("policy_num"),
    )


def _coverage(missing: DataFrame, name: str, *keys: str) -> DataFrame:
    """Rows that should not be there: one row per study that has any."""
    return _row_checks(missing, {name: F.lit(True)}, _where(*keys))


def policy_input_checks(log: DataFrame, inputs: DataFrame) -> DataFrame:
    """Inputs exist for every subject and time, and are blank exactly where inactive."""
    keys = row_ops.KEY
    a = log.select(*keys, "active", F.lit(1).alias("in_log"))
    b = inputs.select(*keys, F.col("inputs").isNull().alias("blank"), F.lit(1).alias("in_inputs"))
    both = a.join(b, keys, "full")
    active = F.coalesce(F.col("active"), F.lit(0)) == 1
    blank = F.coalesce("blank", F.lit(True))
    return _row_checks(
        both,
        {
            "inputs_for_every_subject_and_time": F.col("in_inputs").isNull(),
            "inputs_only_for_known_times": F.col("in_log").isNull(),
            "inputs_blank_exactly_when_inactive": active == blank,
        },
        _where("subject_id", "calendar_t"),
    )


def update_coverage_checks(log: DataFrame, update_rows: DataFrame, calendar: DataFrame) -> DataFrame:
    """Update rows cover the log's updates, subjects and probabilities."""
    in_log = log.filter("active = 1 and policy_num >= 0").select("study_id", "policy_num").distinct()
    learned = in_log.join(
        calendar.select("study_id", F.explode("policy_nums").alias("policy_num")),
        ["study_id", "policy_num"], "left_semi",
    )
    given = update_rows.select("study_id", "policy_num").distinct()
    unknown = given.join(in_log, ["study_id", "policy_num"], "left_anti")
    absent = learned.join(given, ["study_id", "policy_num"], "left_anti")
    subjects = log.filter("active = 1").groupBy("study_id", "subject_id").agg(
        F.min("calendar_t").alias("first_t")
    )
    expected = (
        subjects.join(
            calendar.select("study_id", F.explode(F.arrays_zip("policy_nums", "update_times")).alias("u")),
            "study_id",
        )
        .filter(F.col("first_t") < F.col("u.update_times"))
        .select("study_id", F.col("u.policy_nums").alias("policy_num"), "subject_id")
    )
    have = update_rows.select("study_id", "policy_num", "subject_id").distinct()
    lost = expected.join(have, ["study_id", "policy_num", "subject_id"], "left_anti")
    differing = row_ops.disagreements(
        update_rows.select("study_id", "policy_num", "subject_id", "calendar_t", "action_prob"),
        update_rows.select("study_id", "policy_num", "subject_id", "calendar_t").join(
            row_ops.active_rows(log, "action_prob"), row_ops.KEY
        ),
        ["study_id", "policy_num", "subject_id", "calendar_t"], "action_prob", PROBABILITY_ATOL,
    )
    return (
        _coverage(unknown, "update_rows_only_for_known_policies", "policy_num")
        .unionByName(_coverage(absent, "every_update_has_rows", "policy_num"))
        .unionByName(_coverage(lost, "every_subject_in_every_update", "policy_num", "subject_id"))
        .unionByName(
            _coverage(differing, "update_probabilities_equal_log", "policy_num", "subject_id", "calendar_t")
        )
    )


def update_times_check(update_rows: DataFrame, calendar: DataFrame) -> DataFrame:
    """Times of each (update, subject) are distinct and inside the study."""
    counted = update_rows.groupBy("study_id", "policy_num", "subject_id", "calendar_t").agg(
        F.count("*").alias("n")
    ).join(calendar.select("study_id", "t_min", "t_max"), "study_id")
    t = F.col("calendar_t")
    return _row_checks(
        counted,
        {
            "update_times_strictly_increasing": F.col("n") > 1,
            "update_times_inside_study": (t < F.col("t_min")) | (t > F.col("t_max")),
        },
        _where("policy_num", "subject_id", "calendar_t"),
    )


def shared_beta_checks(inputs: DataFrame) -> DataFrame:
    """Betas of one policy agree across subjects, and have one dimension."""
    have = inputs.filter("inputs.beta is not null")
    values = have.groupBy("study_id", "policy_num", "inputs.beta").agg(F.count("*").alias("n"))
    per_policy = values.groupBy("study_id", "policy_num").agg(F.count("*").alias("betas"))
    sizes = values.groupBy("study_id").agg(
        (F.max(F.size("beta")) - F.min(F.size("beta"))).alias("spread")
    )
    return _row_checks(
        per_policy, {"betas_agree_across_subjects": F.col("betas") > 1}, _where("policy_num")
    ).unionByName(_report(sizes, {"betas_have_one_dimension": ("error", F.col("spread"), F.col("spread"))}))


def mean_stack_check(stack_mean: DataFrame, update_only: bool = False) -> DataFrame:
    """Mean stack near zero: an error above the loose limit, a warning above the tight one."""
    warn = MEAN_STACK_WARN_UPDATE_ONLY if update_only else MEAN_STACK_WARN
    size = F.abs(F.col("mean"))
    counted = stack_mean.groupBy("study_id", "block").agg(
        F.count_if(size > MEAN_STACK_FAIL).alias("failed"),
        F.count_if((size > warn) & (size <= MEAN_STACK_FAIL)).alias("warned"),
        F.max(size).alias("worst"),
    )
    where = F.concat_ws("|", F.lit("block"), F.col("block").cast("string"))
    return _report(
        counted,
        {
            "mean_stack_near_zero": ("error", F.col("failed"), where),
            "mean_stack_close_to_zero": ("warning", F.col("warned"), where),
        },
    )


def identity_check(joint: DataFrame) -> DataFrame:
    """Bread times its inverse is the identity."""
    bad = F.when(F.col("bread_gap_max") > IDENTITY_TOLERANCE, 1).otherwise(0)
    return _report(joint, {"bread_times_inverse_is_identity": ("warning", bad, F.col("bread_gap_max"))})


def variance_agreement(explicit: DataFrame, joint: DataFrame, rtol: float = EXPLICIT_VARIANCE_RTOL) -> DataFrame:
    """Entries of the explicitly adjusted variance that are far from the joint sandwich's.

    ``explicit`` has (study_id, theta_only_variance), ``joint`` (study_id, adjusted_variance).
    """
    both = joint.select("study_id", "adjusted_variance").join(explicit, "study_id", "left")
    far = F.size(F.filter(
        F.zip_with("theta_only_variance", "adjusted_variance", lambda x, y: F.abs(x - y) > F.lit(rtol) * F.abs(y)),
        lambda bad: F.coalesce(bad, F.lit(True)),
    ))
    bad = F.when(F.col("theta_only_variance").isNull() != F.col("adjusted_variance").isNull(), 1).when(
        F.col("adjusted_variance").isNull(), 0).otherwise(far)
    return _report(both, {"explicit_variance_agrees": ("warning", bad, F.col("study_id"))})


def function_agreement(
    given: DataFrame, recomputed: DataFrame, keys: list[str], tolerances: tuple[float, float], name: str
) -> DataFrame:
    """Estimating functions from given and from recomputed probabilities agree."""
    atol, rtol = tolerances
    a = given.select(*keys, F.col("gradient").alias("a"))
    b = recomputed.select(*keys, F.col("gradient").alias("b"))
    far = F.exists(
        F.zip_with(
            "a", "b", lambda x, y: F.abs(x - y) > F.lit(atol) + F.lit(rtol) * F.abs(y)
        ),
        lambda bad: bad,
    )
    return _row_checks(a.join(b, keys), {name: far}, _where(*[k for k in keys if k != "study_id"]))


def all_log_checks(log: DataFrame) -> DataFrame:
    return (
        log_row_checks(log)
        .unionByName(policies_consecutive(log))
        .unionByName(times_consecutive(log))
        .unionByName(full_grid_check(log))
        .unionByName(policies_do_not_fall(log))
    )


def raise_on_errors(report: DataFrame) -> None:
    """Raise if any error was counted.

    The message has one part for each check that failed, so its length does not grow with the
    number of studies.
    """
    bad = (
        report.filter("severity = 'error' and violations > 0").groupBy("check")
        .agg(
            F.countDistinct("study_id").alias("studies"), F.sum("violations").alias("violations"),
            F.min("study_id").alias("study"),
        )
        .orderBy("check").collect()
    )
    if bad:
        raise ValueError("; ".join(
            f"{r['check']}: {r['violations']} in {r['studies']} studies, as in {r['study']}" for r in bad
        ))


def check_everything(
    log: DataFrame, inputs: DataFrame, update_rows: DataFrame, decided: DataFrame,
    calendar: DataFrame, config: AnalysisConfig,
) -> DataFrame:
    """All table checks that come before an analysis."""
    return (
        all_log_checks(log)
        .unionByName(probabilities_recomputed(log, decided))
        .unionByName(policy_input_checks(log, inputs))
        .unionByName(update_coverage_checks(log, update_rows, calendar))
        .unionByName(update_times_check(update_rows, calendar))
        .unionByName(shared_beta_checks(inputs))
    )
