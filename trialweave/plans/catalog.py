"""Registered queries, each with SQL that recomputes it from the raw tables where SQL can.

In the SQL, ``[[x]]`` stands for ``x`` rounded to six digits.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.config import LogColumns
from trialweave.functions import scalar
from trialweave.functions.matrix import solve_ridge
from trialweave.operators import bread as bread_ops
from trialweave.operators import checks, conditioning, derivatives, ordered, posterior, summaries
from trialweave.operators import rows as row_ops
from trialweave.operators import sandwich as sandwich_ops
from trialweave.operators import sums as sums_ops
from trialweave.operators.features import study_features
from trialweave.operators.frame import policy_index, study_frame
from trialweave.operators.horizons import premature_estimates
from trialweave.plans import studies
from trialweave.plans.analysis import Analysis
from trialweave.plans.functions import FunctionAnalysis, UserFunction
from trialweave.plans.monitor import UpdateAssessment
from trialweave.plans.oracles import ENDS, statement
from trialweave.plans.workspace import Workspace, rounded, six, workspace
from trialweave.sources import events as event_source
from trialweave.session import work_folder
from trialweave.sources import sinks
from trialweave.sources import tables as table_source
from trialweave.sources.tables import POLICY_PARAMS_SCHEMA
from trialweave.streaming.monitor import StreamingMonitor, RunningStatistics

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def shifted(sql: str) -> str:
    return re.sub(r"\[\[(.*?)\]\]", r"(round((\1) + 1.234e-8, 6) + 0.0)", sql)


def entry(name: str, sql: str | None = None, log_block: str = "glog"):
    def register(build: Callable[[Workspace], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(workspace(spark, sf_dir))
        if sql:
            ORACLES[name] = statement(shifted(sql), log_block)
        return build

    return register


def at(array: str, *names: str):
    return [six(F.get(array, F.lit(i))).alias(n) for i, n in enumerate(names)]


# Sources and sinks


@entry(
    "decision_log_from_events",
    """SELECT study_id, subject_id, calendar_t, active, action, [[reward]] AS reward, policy_num,
              [[past_reward]] AS past_reward FROM glog""",
)
def _(w):
    grid = studies.events_grid(w.spark, w.sf_dir)
    return rounded(grid.drop("intercept"), "reward", "past_reward")


@entry(
    "decision_log_from_orders",
    """SELECT study_id, subject_id, calendar_t, active, action, [[reward]] AS reward, policy_num,
              [[past_reward]] AS past_reward FROM olog""",
)
def _(w):
    grid = studies.orders_grid(w.spark, w.sf_dir)
    return rounded(grid.drop("intercept"), "reward", "past_reward")


INPUTS_SQL = """SELECT l.study_id, l.subject_id, l.calendar_t, CASE WHEN active = 1 THEN 0 ELSE 1 END AS blank,
              [[CASE WHEN active = 1 THEN b0 END]] AS beta_0, [[CASE WHEN active = 1 THEN b1 END]] AS beta_1,
              CASE WHEN active = 1 THEN CAST(0.1 AS DOUBLE) END AS lower,
              CASE WHEN active = 1 THEN CAST(3 AS DOUBLE) END AS steepness,
              CASE WHEN active = 1 THEN CAST(0.9 AS DOUBLE) END AS upper,
              CASE WHEN active = 1 THEN CAST(1 AS DOUBLE) END AS treat_0
       FROM glog l LEFT JOIN beta b ON l.study_id = b.study_id AND l.policy_num = b.policy_num"""


def _shown_inputs(inputs: DataFrame) -> DataFrame:
    return inputs.select(
        *row_ops.KEY, F.col("inputs").isNull().cast("int").alias("blank"),
        *at("inputs.beta", "beta_0", "beta_1"),
        "inputs.lower", "inputs.steepness", "inputs.upper",
        F.get("inputs.treat_state", F.lit(0)).alias("treat_0"),
    )


@entry("policy_inputs", INPUTS_SQL)
def _(w):
    return _shown_inputs(w.inputs)


@entry(
    "update_rows",
    """SELECT r.study_id, r.policy_num, r.subject_id, r.calendar_t, r.action, [[r.reward]] AS reward,
              [[d.pi]] AS action_prob
       FROM urows r JOIN dec d ON r.study_id = d.study_id AND r.subject_id = d.subject_id
         AND r.calendar_t = d.calendar_t""",
)
def _(w):
    return rounded(w.update_rows.drop("base_state", "treat_state"), "reward", "action_prob")


@entry(
    "policy_params_wide",
    "SELECT study_id, policy_num, [[b0]] AS beta_0, [[b1]] AS beta_1 FROM beta",
)
def _(w):
    return rounded(sinks.wide_policy_params(w.params, 2), "beta_0", "beta_1")


@entry(
    "log_read_back",
    """SELECT study_id, subject_id, calendar_t, active, action, [[reward]] AS reward, policy_num,
              [[past_reward]] AS past_reward FROM glog""",
)
def _(w):
    """The log written under other names and read through its column roles."""
    names = {"study_id": "site", "subject_id": "user", "calendar_t": "day", "active": "in_study", "reward": "gain"}
    path = f"{work_folder(w.spark)}/trialweave/log-{uuid.uuid4().hex}"
    w.log.withColumnsRenamed(names).write.parquet(path)
    columns = LogColumns(**names, features=("past_reward",))
    out = table_source.read_decision_log(w.spark, path, columns)
    return rounded(out.select(*row_ops.KEY, "active", "action", "reward", "policy_num", "past_reward"),
                   "reward", "past_reward")


@entry("policy_inputs_read_back", re.sub(r"\bl\.subject_id,", "CAST(l.subject_id AS VARCHAR) AS subject_id,",
                                         INPUTS_SQL))
def _(w):
    """The inputs written as maps by subject, with ids as strings, and read back flat."""
    path = f"{work_folder(w.spark)}/trialweave/inputs-{uuid.uuid4().hex}"
    given = w.inputs.withColumn("subject_id", F.col("subject_id").cast("string"))
    sinks.write_policy_inputs(given, path)
    return _shown_inputs(table_source.read_policy_inputs(w.spark, path, subject_type="string", nested=True))


@entry(
    "update_rows_read_back",
    """SELECT r.study_id, r.policy_num, r.subject_id, r.calendar_t, CAST(r.action AS DOUBLE) AS action,
              [[r.reward]] AS reward, [[d.pi]] AS action_prob, CAST(1 AS DOUBLE) AS base_0, CAST(1 AS DOUBLE) AS treat_0
       FROM urows r JOIN dec d ON r.study_id = d.study_id AND r.subject_id = d.subject_id
         AND r.calendar_t = d.calendar_t""",
)
def _(w):
    """The update data written as maps of arrays by subject and read back in long form."""
    path = f"{work_folder(w.spark)}/trialweave/updates-{uuid.uuid4().hex}"
    sinks.write_update_rows(w.update_rows, path)
    out = table_source.read_update_rows(w.spark, path, nested=True)
    return rounded(
        out.select("study_id", "policy_num", "subject_id", "calendar_t", "action", "reward", "action_prob",
                   F.get("base_state", F.lit(0)).alias("base_0"), F.get("treat_state", F.lit(0)).alias("treat_0")),
        "reward", "action_prob")


# Selections


@entry(
    "active_rewards",
    "SELECT study_id, subject_id, calendar_t, [[reward]] AS reward FROM glog WHERE active = 1",
)
def _(w):
    return rounded(row_ops.active_rows(w.log, "reward"), "reward")


@entry(
    "actions_and_policies_by_time",
    "SELECT study_id, subject_id, calendar_t, action, policy_num FROM glog WHERE active = 1",
)
def _(w):
    return row_ops.active_rows(w.log, "action", "policy_num")


@entry(
    "inputs_by_subject",
    """SELECT study_id, subject_id, count(*) AS times, CAST(sum(active) AS BIGINT) AS given,
              min(CASE WHEN active = 1 THEN calendar_t END) AS first_given,
              max(CASE WHEN active = 1 THEN calendar_t END) AS last_given FROM glog GROUP BY 1, 2""",
)
def _(w):
    given = F.when(F.col("inputs").isNotNull(), F.col("calendar_t"))
    return w.inputs.groupBy("study_id", "subject_id").agg(
        F.count("*").alias("times"), F.count("inputs").alias("given"),
        F.min(given).alias("first_given"), F.max(given).alias("last_given"),
    )


@entry(
    "replaced_argument",
    """SELECT study_id, subject_id, calendar_t, CASE WHEN active = 1 THEN CAST(2.5 AS DOUBLE) END AS steepness,
              CASE WHEN active = 1 THEN CAST(0.9 AS DOUBLE) END AS upper FROM glog""",
)
def _(w):
    changed = row_ops.replace_input(w.inputs, "steepness", F.lit(2.5))
    return changed.select(*row_ops.KEY, "inputs.steepness", "inputs.upper")


@entry(
    "masked_logits",
    """SELECT g.study_id, g.subject_id, g.calendar_t, [[ln(pi / (1 - pi))]] AS action_prob_logit
       FROM glog g LEFT JOIN dec d ON g.study_id = d.study_id AND g.subject_id = d.subject_id
         AND g.calendar_t = d.calendar_t""",
)
def _(w):
    return rounded(
        row_ops.masked_logit(w.log).select(*row_ops.KEY, "action_prob_logit"), "action_prob_logit"
    )


@entry(
    "truncated_studies",
    """SELECT u.study_id, u.policy_num AS horizon_policy, u.last_t AS horizon_t, g.subject_id, g.calendar_t, g.active,
              [[g.reward]] AS reward
       FROM glog g JOIN upd u ON g.study_id = u.study_id AND g.calendar_t <= u.last_t""",
)
def _(w):
    cut = row_ops.truncated(w.log, w.analysis._calendar)
    return rounded(
        cut.select("study_id", "horizon_policy", "horizon_t", "subject_id", "calendar_t", "active", "reward"),
        "reward",
    )


@entry(
    "newest_update_rows",
    """SELECT r.study_id, r.policy_num, subject_id, calendar_t, action, [[reward]] AS reward FROM urows r
       JOIN (SELECT study_id, max(policy_num) AS m FROM upd GROUP BY 1) x ON r.study_id = x.study_id AND r.policy_num = m""",
)
def _(w):
    newest = row_ops.newest_update(w.update_rows)
    return rounded(
        newest.select("study_id", "policy_num", "subject_id", "calendar_t", "action", "reward"), "reward"
    )


@entry("policy_index", "SELECT study_id, policy_num, k AS policy_idx FROM ranked")
def _(w):
    return policy_index(w.log)


@entry(
    "pre_and_post_update_rows",
    """SELECT study_id, subject_id, calendar_t, policy_num, [[pi]] AS action_prob,
              CASE WHEN policy_num < 0 THEN 'fallback' WHEN k < 0 THEN 'pre' ELSE 'post' END AS phase FROM dec""",
)
def _(w):
    return rounded(row_ops.pre_post_update(w.log, w.analysis._calendar), "action_prob")


@entry(
    "incremental_update_rows",
    """SELECT study_id, subject_id, calendar_t, policy_num, action, [[reward]] AS reward
       FROM glog WHERE active = 1 AND policy_num > 3""",
)
def _(w):
    return rounded(
        row_ops.since_policy(w.log, 3).select(*row_ops.KEY, "policy_num", "action", "reward"), "reward"
    )


@entry(
    "inference_columns",
    """SELECT study_id, subject_id, calendar_t, CAST(1 AS DOUBLE) AS intercept, action, [[reward]] AS reward,
              [[pi]] AS action_prob FROM dec""",
)
def _(w):
    return rounded(row_ops.inference_columns(w.log, w.config.inference), "reward", "action_prob")


# Lookups and comparisons


@entry(
    "beta_per_decision",
    """SELECT l.study_id, l.subject_id, l.calendar_t, [[b0]] AS beta_0, [[b1]] AS beta_1
       FROM glog l LEFT JOIN beta b ON l.study_id = b.study_id AND l.policy_num = b.policy_num""",
)
def _(w):
    own = row_ops.replace_input(w.inputs, "beta", F.lit(None).cast("array<double>"))
    shared = row_ops.share_betas(own, w.params)
    return shared.select(*row_ops.KEY, *at("inputs.beta", "beta_0", "beta_1"))


@entry(
    "beta_per_update_row",
    """SELECT r.study_id, r.policy_num, r.subject_id, r.calendar_t, [[b0]] AS beta_0, [[b1]] AS beta_1
       FROM urows r JOIN beta b ON r.study_id = b.study_id AND r.policy_num = b.policy_num""",
)
def _(w):
    return w.update_rows.join(w.params.select("study_id", "policy_num", "beta"), ["study_id", "policy_num"]).select(
        "study_id", "policy_num", "subject_id", "calendar_t", *at("beta", "beta_0", "beta_1")
    )


@entry(
    "previous_betas",
    """SELECT c.study_id, c.policy_num, p.k AS pos, [[p.b0]] AS beta_0, [[p.b1]] AS beta_1
       FROM beta c JOIN beta p ON c.study_id = p.study_id AND p.k < c.k""",
)
def _(w):
    listed = row_ops.previous_betas(w.params).select(
        "study_id", "policy_num", F.posexplode("previous").alias("pos", "b")
    )
    return listed.select("study_id", "policy_num", "pos", *at("b", "beta_0", "beta_1"))


@entry(
    "recomputed_update_probabilities",
    """SELECT r.study_id, r.policy_num, r.subject_id, r.calendar_t, [[d.pi]] AS action_prob
       FROM urows r JOIN dec d ON r.study_id = d.study_id AND r.subject_id = d.subject_id
         AND r.calendar_t = d.calendar_t""",
)
def _(w):
    wrong = w.update_rows.withColumn("action_prob", F.lit(0.123))
    right = row_ops.with_recomputed(wrong, w.decided)
    return rounded(
        right.select("study_id", "policy_num", "subject_id", "calendar_t", "action_prob"), "action_prob"
    )


@entry(
    "recomputed_inference_probabilities",
    "SELECT study_id, subject_id, calendar_t, [[pi]] AS action_prob FROM dec",
)
def _(w):
    wrong = row_ops.active_rows(w.log).withColumn("action_prob", F.lit(0.5))
    return rounded(row_ops.with_recomputed(wrong, w.decided), "action_prob")


@entry(
    "source_disagreements",
    """SELECT g.study_id, g.subject_id, g.calendar_t, [[g.reward]] AS left_value, [[p.past_reward]] AS right_value
       FROM glog g LEFT JOIN glog p ON g.study_id = p.study_id AND g.subject_id = p.subject_id
         AND g.calendar_t = p.calendar_t
       WHERE NOT coalesce(abs(g.reward - p.past_reward) <= 0.5, FALSE)""",
)
def _(w):
    rewards = w.log.select(*row_ops.KEY, F.col("reward").alias("x"))
    past = w.log.select(*row_ops.KEY, F.col("past_reward").alias("x"))
    out = row_ops.disagreements(rewards, past, row_ops.KEY, "x", 0.5)
    return rounded(out.drop("in_left", "in_right"), "left_value", "right_value")


@entry(
    "key_coverage",
    """WITH a AS (SELECT DISTINCT subject_id, calendar_t FROM daily WHERE action = 1),
            b AS (SELECT DISTINCT user_id AS subject_id,
                    CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS calendar_t
                  FROM events WHERE event_type = 'error')
       SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
       UNION ALL SELECT *, 'right' AS side FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""".replace(
        "WITH a", "SELECT * FROM (WITH a"
    ) + ") q",
)
def _(w):
    acted = w.log.filter("action = 1").select("subject_id", "calendar_t")
    day = F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-01")))
    errors = studies.table(w.spark, w.sf_dir, "events").filter("event_type = 'error'").select(
        F.col("user_id").alias("subject_id"), day.alias("calendar_t")
    )
    return row_ops.uncovered(acted, errors, ["subject_id", "calendar_t"])


@entry(
    "zero_filled_updates",
    """SELECT s.study_id, s.subject_id, u.policy_num, [[coalesce(x.total, 0)]] AS total
       FROM (SELECT DISTINCT study_id, subject_id FROM glog) s JOIN upd u ON s.study_id = u.study_id
       LEFT JOIN (SELECT study_id, subject_id, policy_num, sum(reward) AS total FROM urows GROUP BY 1, 2, 3) x
         ON x.study_id = s.study_id AND x.subject_id = s.subject_id AND x.policy_num = u.policy_num""",
)
def _(w):
    totals = w.update_rows.groupBy("study_id", "subject_id", "policy_num").agg(
        F.sum("reward").alias("total")
    )
    return rounded(
        row_ops.zero_filled_by_subject(totals, w.log, w.analysis._calendar, "total"), "total"
    )


@entry(
    "zero_filled_times",
    """SELECT g.study_id, g.subject_id, g.calendar_t, [[coalesce(d.pi, 0)]] AS pi
       FROM glog g LEFT JOIN dec d ON g.study_id = d.study_id AND g.subject_id = d.subject_id
         AND g.calendar_t = d.calendar_t""",
)
def _(w):
    return rounded(row_ops.zero_filled_by_time(w.decided, w.analysis._calendar, "pi"), "pi")


@entry(
    "actions_at_times",
    """SELECT d.study_id, d.subject_id, d.calendar_t, d.action FROM dec d JOIN upd u
         ON d.study_id = u.study_id AND d.calendar_t = u.first_t""",
)
def _(w):
    times = w.analysis._calendar.select("study_id", F.explode("update_times").alias("calendar_t"))
    subjects = w.log.select("study_id", "subject_id").distinct().join(times, "study_id")
    return row_ops.actions_at(w.log, subjects)


# Sums


@entry(
    "stack_mean",
    "SELECT study_id, block, pos, [[mean]] AS mean FROM smean",
)
def _(w):
    return rounded(w.analysis.stack_mean, "mean")


@entry(
    "joint_meat",
    "SELECT study_id, row_block, col_block, r, c, [[value]] AS value FROM meat",
)
def _(w):
    return rounded(w.analysis.meat, "value")


@entry(
    "classical_meat",
    """SELECT m.study_id, r, c, [[value]] AS value FROM meat m JOIN sizes z ON m.study_id = z.study_id
       WHERE row_block = kk AND col_block = kk""",
)
def _(w):
    meat = sandwich_ops.theta_meat(w.analysis.weighted_stack, w.frame, w.config)
    q = w.config.inference.dim
    return meat.select("study_id", F.posexplode("meat").alias("p", "value")).select(
        "study_id", (F.col("p") / q).cast("int").alias("r"), (F.col("p") % q).alias("c"),
        six("value").alias("value"),
    )


@entry(
    "classical_bread_inverse",
    """SELECT b.study_id, r, c, [[value]] AS value FROM own b JOIN sizes z ON b.study_id = z.study_id
       WHERE row_block = kk""",
)
def _(w):
    q = w.config.inference.dim
    return w.frame.select("study_id", F.posexplode("bread_inverse").alias("p", "value")).select(
        "study_id", (F.col("p") / q).cast("int").alias("r"), (F.col("p") % q).alias("c"),
        six("value").alias("value"),
    )


JOINT_BREAD_SQL = "SELECT study_id, row_block, col_block, r, c, [[value]] AS value FROM bread"


@entry("joint_bread_inverse", JOINT_BREAD_SQL)
def _(w):
    return rounded(w.analysis.bread_inverse, "value")


@entry(
    "score_part_by_join",
    "SELECT study_id, row_block, col_block, r, c, [[value]] AS value FROM scorepart",
)
def _(w):
    return rounded(bread_ops.score_cells_by_join(w.stack, w.frame, w.config), "value")


@entry(
    "study_summary",
    """SELECT d.study_id, count(*) AS n_decisions, count(*) FILTER (WHERE d.policy_num < 0) AS n_fallback_decisions,
              [[min(pi)]] AS min_action_prob, [[max(pi)]] AS max_action_prob,
              min(d.policy_num) AS initial_policy, count(DISTINCT d.subject_id) AS n_subjects,
              count(DISTINCT d.calendar_t) AS n_times, any_value(kk) AS n_updates,
              count(*) FILTER (WHERE k < 0) AS n_rows_before_first_update,
              [[count(*) / count(DISTINCT d.subject_id)]] AS decisions_per_subject,
              CAST(0 AS BIGINT) AS n_multi_policy_times
       FROM dec d JOIN sizes z ON d.study_id = z.study_id GROUP BY 1""",
)
def _(w):
    return rounded(
        summaries.study_summary(w.log), "min_action_prob", "max_action_prob", "decisions_per_subject"
    )


@entry(
    "times_with_several_policies",
    """SELECT study_id, count(*) FILTER (WHERE n > 1) AS n_multi_policy_times FROM (
         SELECT study_id, calendar_t, count(DISTINCT policy_num) AS n FROM glog
         WHERE active = 1 AND policy_num >= 0 GROUP BY 1, 2) GROUP BY 1""",
)
def _(w):
    return summaries.times_with_several_policies(w.log)


@entry(
    "probability_quartiles",
    """SELECT study_id, calendar_t, [[quantile_cont(pi, 0.25)]] AS q25, [[quantile_cont(pi, 0.5)]] AS q50,
              [[quantile_cont(pi, 0.75)]] AS q75 FROM dec GROUP BY 1, 2""",
)
def _(w):
    return rounded(summaries.probability_quartiles(w.log), "q25", "q50", "q75")


@entry(
    "time_statistics",
    """SELECT study_id, calendar_t, [[avg(ln(pi / (1 - pi)))]] AS logit_mean,
              [[coalesce(stddev_samp(round(ln(pi / (1 - pi)), 9)), 0)]] AS logit_std, [[avg(reward)]] AS reward_mean,
              [[stddev_samp(reward)]] AS reward_std, [[max(reward)]] AS reward_max FROM dec GROUP BY 1, 2""",
)
def _(w):
    out = summaries.time_statistics(w.log).withColumn("logit_std", F.coalesce("logit_std", F.lit(0.0)))
    return rounded(out, "logit_mean", "logit_std", "reward_mean", "reward_std", "reward_max")


@entry(
    "stack_norms",
    "SELECT study_id, subject_id, [[sqrt(sum(v * v))]] AS norm FROM cells GROUP BY 1, 2",
)
def _(w):
    return rounded(summaries.stack_norms(w.stack), "norm")


@entry(
    "segment_norms",
    """SELECT s.study_id, block, [[sum(sqrt(v0 * v0 + v1 * v1)) / any_value(n)]] AS mean_norm
       FROM stack s JOIN sizes z ON s.study_id = z.study_id GROUP BY 1, 2""",
)
def _(w):
    return rounded(summaries.segment_norms(w.stack, w.frame), "mean_norm")


@entry("policy_first_times", "SELECT study_id, policy_num, first_t FROM ranked")
def _(w):
    from trialweave.operators.frame import policy_spans

    return policy_spans(w.log).drop("last_t")


@entry("subjects_before_update", "SELECT study_id, policy_num, users AS n_users FROM ustat")
def _(w):
    return sums_ops.contributors(w.log, w.analysis._calendar)


@entry(
    "mean_second_derivatives",
    """SELECT o.study_id, u.policy_num, r * 2 + c AS pos, [[value]] AS value FROM own o JOIN upd u
         ON o.study_id = u.study_id AND o.row_block = u.k""",
)
def _(w):
    functions = derivatives.update_functions(w.update_rows, w.params, w.config.update)
    return rounded(derivatives.mean_second_derivative(functions, w.analysis._calendar), "value")


@entry(
    "adjusted_theta_functions",
    "SELECT study_id, subject_id, [[v0]] AS v0, [[v1]] AS v1 FROM adjpsi",
)
def _(w):
    m = conditioning.adjustment_matrices(w.analysis.bread_inverse, w.frame, w.config)
    out = conditioning.adjusted_theta_functions(w.stack, m, w.config)
    return out.select("study_id", "subject_id", *at("v", "v0", "v1"))


# Ordered quantities


@entry(
    "first_times_by_policy",
    """SELECT study_id, subject_id, policy_num, min(calendar_t) AS first_t FROM glog WHERE active = 1
       GROUP BY 1, 2, 3""",
)
def _(w):
    return ordered.first_times_by_policy(w.log)


@entry(
    "subject_spans",
    """SELECT study_id, subject_id, min(calendar_t) AS start_t, max(calendar_t) AS end_t,
              min(calendar_t) FILTER (WHERE k >= 0) AS first_learned_t FROM dec GROUP BY 1, 2""",
)
def _(w):
    return ordered.subject_spans(w.decided)


# Weights of the recorded policy against one whose betas are a tenth smaller.
WEIGHTED_SQL = """
    (SELECT *, CASE WHEN k < 0 THEN 1 ELSE (CASE WHEN action = 1 THEN pi / q ELSE (1 - pi) / (1 - q) END) END AS w
     FROM (SELECT *, least(greatest(1 / (1 + exp(-2.7 * b1)), 0.1), 0.9) AS q FROM dec WHERE k >= 0
           UNION ALL SELECT *, 0.5 AS q FROM dec WHERE k < 0))
"""


def _weighted(w):
    lower, upper, steep = F.lit(0.1), F.lit(0.9), F.lit(2.7)
    other = scalar.hard_clipped(F.col("advantage"), lower, upper, steep)
    return ordered.decision_weights(w.decided.withColumn("behaviour_prob", other))


@entry(
    "decision_weights",
    f"SELECT study_id, subject_id, calendar_t, [[w]] AS weight FROM {WEIGHTED_SQL}",
)
def _(w):
    return rounded(_weighted(w).select(*row_ops.KEY, "weight"), "weight")


@entry(
    "update_weights",
    f"""SELECT s.study_id, s.subject_id, u.k AS policy_idx,
               [[coalesce(exp(sum(ln(x.w)) FILTER (WHERE x.k >= 0 AND (f.t IS NULL OR x.calendar_t < f.t))), 1)]] AS weight
        FROM (SELECT DISTINCT study_id, subject_id FROM dec) s JOIN upd u ON s.study_id = u.study_id
        LEFT JOIN (SELECT study_id, subject_id, k, min(calendar_t) AS t FROM dec GROUP BY 1, 2, 3) f
          ON f.study_id = s.study_id AND f.subject_id = s.subject_id AND f.k = u.k
        JOIN {WEIGHTED_SQL} x ON x.study_id = s.study_id AND x.subject_id = s.subject_id GROUP BY 1, 2, 3""",
)
def _(w):
    return rounded(ordered.update_weights(_weighted(w), w.frame), "weight")


@entry(
    "inference_weights",
    f"SELECT study_id, subject_id, [[exp(sum(ln(w)))]] AS weight FROM {WEIGHTED_SQL} GROUP BY 1, 2",
)
def _(w):
    return rounded(ordered.inference_weights(_weighted(w)), "weight")


@entry(
    "beta_changes",
    """SELECT c.study_id, c.policy_num, [[sqrt((c.b0 - p.b0) ** 2 + (c.b1 - p.b1) ** 2)]] AS change
       FROM beta c JOIN beta p ON c.study_id = p.study_id AND p.k = c.k - 1""",
)
def _(w):
    return rounded(ordered.beta_changes(w.params), "change")


@entry(
    "beta_change_summary",
    """SELECT study_id, [[max(x)]] AS max_change, [[stddev_pop(x)]] AS std_change FROM (
         SELECT c.study_id, sqrt((c.b0 - p.b0) ** 2 + (c.b1 - p.b1) ** 2) AS x
         FROM beta c JOIN beta p ON c.study_id = p.study_id AND p.k = c.k - 1) GROUP BY 1""",
)
def _(w):
    return rounded(ordered.beta_change_summary(w.params), "max_change", "std_change")


@entry(
    "running_update_sums",
    """SELECT study_id, k AS seg, [[c]] AS u_xx_0_0, [[sa]] AS u_xx_0_1, [[sr]] AS u_rx_0, [[sra]] AS u_rx_1
       FROM ustat""",
)
def _(w):
    gram = sums_ops.update_gram(w.config)
    sums = w.analysis.sums.groupBy("study_id", "seg").agg(*gram.totals())
    out = ordered.running_sums(sums, gram).join(
        w.frame.select("study_id", "n_updates"), "study_id"
    ).filter("seg < n_updates")
    names = ["u_xx_0_0", "u_xx_0_1", "u_rx_0", "u_rx_1"]
    return rounded(out.select("study_id", "seg", *names), *names)


@entry(
    "past_actions_and_dosage",
    """SELECT g.study_id, g.subject_id, g.calendar_t, any_value(coalesce(g.pa, 0)) AS past_action,
              [[coalesce(sum(0.05 * coalesce(p.action, 0) * pow(0.95, g.calendar_t - 1 - p.calendar_t)), 0)]] AS dosage
       FROM (SELECT *, lag(action) OVER (PARTITION BY study_id, subject_id ORDER BY calendar_t) AS pa FROM glog) g
       LEFT JOIN glog p ON g.study_id = p.study_id AND g.subject_id = p.subject_id AND p.calendar_t < g.calendar_t
       GROUP BY 1, 2, 3""",
)
def _(w):
    out = event_source.with_dosage(w.log.select(*row_ops.KEY, "action"))
    return rounded(out.drop("action"), "dosage")


@entry(
    "premature_thetas",
    """SELECT study_id, k AS end_idx, [[(sdd * sr - sd * srd) / (c * sdd - sd * sd)]] AS theta_0,
              [[(c * srd - sd * sr) / (c * sdd - sd * sd)]] AS theta_1
       FROM (SELECT u.study_id, u.k, CAST(count(*) AS DOUBLE) AS c, sum(d) AS sd, sum(d * d) AS sdd, sum(reward) AS sr,
                    sum(reward * d) AS srd
             FROM dec x JOIN upd u ON x.study_id = u.study_id AND x.calendar_t <= u.last_t GROUP BY 1, 2)""",
)
def _(w):
    from trialweave.operators.horizons import horizon_frame, spread

    ends = horizon_frame(spread(w.analysis.sums, w.frame), w.frame, w.config)
    return ends.select(F.col("parent").alias("study_id"), "end_idx", *at("theta", "theta_0", "theta_1"))


@entry("premature_estimates")
def _(w):
    out = premature_estimates(w.analysis.digest, w.analysis.sums, w.frame, w.config, w.analysis.products)
    return out.select("study_id", "end_idx", *at("theta", "theta_0", "theta_1"), *_variances(2))


# Parameters


@entry(
    "first_betas",
    "SELECT study_id, policy_num, [[b0]] AS beta_0, [[b1]] AS beta_1 FROM beta",
)
def _(w):
    return row_ops.first_betas(w.inputs).select("study_id", "policy_num", *at("beta", "beta_0", "beta_1"))


@entry("sorted_subjects", "SELECT DISTINCT study_id, subject_id FROM glog ORDER BY 1, 2")
def _(w):
    return w.log.select("study_id", "subject_id").distinct().orderBy("study_id", "subject_id")


@entry(
    "beta_dimension",
    "SELECT DISTINCT study_id, 2 AS beta_dim, CAST(1 AS BIGINT) AS dims FROM beta",
)
def _(w):
    return row_ops.beta_dimension(w.params)


@entry(
    "flat_parameters",
    """SELECT study_id, k * 2 AS position, [[b0]] AS value FROM beta
       UNION ALL SELECT study_id, k * 2 + 1, [[b1]] FROM beta
       UNION ALL SELECT t.study_id, kk * 2, [[t0]] FROM theta t JOIN sizes z ON t.study_id = z.study_id
       UNION ALL SELECT t.study_id, kk * 2 + 1, [[t1]] FROM theta t JOIN sizes z ON t.study_id = z.study_id""",
)
def _(w):
    flat = row_ops.flat_parameters(w.params, w.frame.select("study_id", "theta"), 2)
    return flat.select("study_id", F.col("position").cast("long").alias("position"), six("value").alias("value"))


@entry(
    "unflattened_parameters",
    """SELECT study_id, k AS block, 0 AS pos, [[b0]] AS value FROM beta
       UNION ALL SELECT study_id, k, 1, [[b1]] FROM beta
       UNION ALL SELECT t.study_id, CAST(kk AS INTEGER), 0, [[t0]] FROM theta t JOIN sizes z ON t.study_id = z.study_id
       UNION ALL SELECT t.study_id, CAST(kk AS INTEGER), 1, [[t1]] FROM theta t JOIN sizes z ON t.study_id = z.study_id""",
)
def _(w):
    flat = row_ops.flat_parameters(w.params, w.frame.select("study_id", "theta"), 2)
    out = row_ops.unflattened(flat, w.frame, 2).withColumn("pos", F.col("pos").cast("int"))
    return rounded(out, "value")


@entry(
    "joint_bread_blocks",
    """SELECT study_id, row_block, col_block, [[m00]] AS m00, [[m01]] AS m01, [[m10]] AS m10, [[m11]] AS m11
       FROM blocks""",
)
def _(w):
    blocks = bread_ops.as_blocks(w.analysis.bread_inverse, w.frame, w.config)
    return blocks.select("study_id", "row_block", "col_block", *at("m", "m00", "m01", "m10", "m11"))


# Scalar functions


@entry(
    "policy_probabilities",
    """SELECT study_id, subject_id, calendar_t, [[pi]] AS hard, [[0.1 + 0.8 / (1 + exp(-3.0 * b1))]] AS smooth,
              [[CASE WHEN action = 1 THEN pi ELSE 1 - pi END]] AS likelihood,
              [[0.1 + 0.8 / (1 + exp(-3.0 * b1 / sqrt(1 + pi() * 9 * 0.25 / 8)))]] AS mean_field FROM dec""".replace(
        "pi()", "3.141592653589793"
    ),
)
def _(w):
    lower, upper, steep = F.lit(0.1), F.lit(0.9), F.lit(3.0)
    adv = F.col("advantage")
    return w.decided.select(
        *row_ops.KEY, six("pi").alias("hard"),
        six(scalar.smooth_clipped(adv, lower, upper, steep)).alias("smooth"),
        six(scalar.likelihood(F.col("pi"), F.col("action"))).alias("likelihood"),
        six(scalar.posterior_sampling_mean_field(adv, F.lit(0.25), lower, upper, steep)).alias("mean_field"),
    )


@entry(
    "sampled_policy_probabilities",
    """SELECT study_id, subject_id, calendar_t, [[p]] AS sampled FROM (
         SELECT study_id, subject_id, calendar_t, avg(0.1 + 0.8 / (1 + exp(-3.0 * (b1 + 0.5 * z)))) AS p
         FROM dec JOIN draws ON true WHERE k >= 0 GROUP BY 1, 2, 3)""",
)
def _(w):
    return w.decided.filter("policy_idx >= 0").select(
        *row_ops.KEY,
        six(posterior.sampled_probability(F.col("advantage"), F.lit(0.25), 0.1, 0.9, 3.0)).alias("sampled"),
    )


@entry(
    "policy_gradients",
    """SELECT g.study_id, g.subject_id, g.calendar_t, [[coalesce(slope, 0)]] AS pi_gradient_1,
              [[coalesce(score, 0)]] AS weight_gradient_1, CAST(0 AS DOUBLE) AS pi_gradient_0
       FROM glog g LEFT JOIN dec d ON g.study_id = d.study_id AND g.subject_id = d.subject_id
         AND g.calendar_t = d.calendar_t""",
)
def _(w):
    out = derivatives.policy_gradients(w.log, w.decided, w.config)
    return out.select(
        *row_ops.KEY, six(F.get("pi_gradient", F.lit(1))).alias("pi_gradient_1"),
        six(F.get("weight_gradient", F.lit(1))).alias("weight_gradient_1"),
        six(F.get("pi_gradient", F.lit(0))).alias("pi_gradient_0"),
    )


@entry(
    "update_functions",
    """SELECT r.study_id, r.policy_num, r.subject_id, [[sum((reward - b0 - b1 * action) ** 2)]] AS loss,
              [[sum(-2 * (reward - b0 - b1 * action))]] AS gradient_0,
              [[sum(-2 * (reward - b0 - b1 * action) * action)]] AS gradient_1,
              [[CAST(2 * count(*) AS DOUBLE)]] AS second_00, [[CAST(2 * sum(action) AS DOUBLE)]] AS second_01,
              [[CAST(2 * sum(action) AS DOUBLE)]] AS second_10, [[CAST(2 * sum(action * action) AS DOUBLE)]] AS second_11
       FROM urows r JOIN beta b ON r.study_id = b.study_id AND r.k = b.k GROUP BY 1, 2, 3""",
)
def _(w):
    out = derivatives.update_functions(w.update_rows, w.params, w.config.update)
    return out.select(
        "study_id", "policy_num", "subject_id", six("loss").alias("loss"),
        *at("gradient", "gradient_0", "gradient_1"), *at("second", "second_00", "second_01", "second_10", "second_11"),
    )


@entry(
    "previous_beta_functions",
    """SELECT r.study_id, r.policy_num, r.subject_id, [[sum((r.reward - b.b0 - b.b1 * d.d) ** 2)]] AS loss,
              [[sum(-2 * (r.reward - b.b0 - b.b1 * d.d))]] AS gradient_0,
              [[sum(-2 * (r.reward - b.b0 - b.b1 * d.d) * d.d)]] AS gradient_1
       FROM urows r JOIN beta b ON r.study_id = b.study_id AND r.k = b.k
       JOIN dec d ON r.study_id = d.study_id AND r.subject_id = d.subject_id AND r.calendar_t = d.calendar_t
       GROUP BY 1, 2, 3""",
)
def _(w):
    """No recorded probability is given: all come from the betas of earlier policies."""
    rows = w.update_rows.withColumn("action_prob", F.lit(None).cast("double"))
    out = derivatives.previous_beta_functions(rows, w.decided, w.params, replace(w.config.update, centered=True))
    return out.select(
        "study_id", "policy_num", "subject_id", six("loss").alias("loss"), *at("gradient", "gradient_0", "gradient_1"))


@entry(
    "previous_beta_derivatives",
    """SELECT r.study_id, r.k AS row_block, d.k AS col_block, q.r, 1 AS c,
              [[sum(slope * CASE WHEN q.r = 0 THEN -2 * b.b1 ELSE 2 * (r.reward - b.b0 - 2 * b.b1 * d.d) END) / any_value(n)]] AS value
       FROM urows r JOIN beta b ON r.study_id = b.study_id AND r.k = b.k
       JOIN dec d ON r.study_id = d.study_id AND r.subject_id = d.subject_id AND r.calendar_t = d.calendar_t
       JOIN sizes z ON r.study_id = z.study_id JOIN (VALUES (0), (1)) AS q(r) ON true
       WHERE d.k >= 0 AND d.k < r.k GROUP BY 1, 2, 3, 4""",
)
def _(w):
    config = replace(w.config, update=replace(w.config.update, centered=True))
    return rounded(derivatives.previous_beta_derivatives(w.decided, w.frame, config), "value")


@entry(
    "inference_functions",
    """SELECT d.study_id, d.subject_id, [[sum((reward - t0 - t1 * d) ** 2)]] AS loss,
              [[sum(-2 * (reward - t0 - t1 * d))]] AS gradient_0, [[sum(-2 * (reward - t0 - t1 * d) * d)]] AS gradient_1,
              [[CAST(2 * count(*) AS DOUBLE)]] AS second_00, [[2 * sum(d)]] AS second_01,
              [[2 * sum(d)]] AS second_10, [[2 * sum(d * d)]] AS second_11
       FROM dec d JOIN theta t ON d.study_id = t.study_id GROUP BY 1, 2""",
)
def _(w):
    data, theta = derivatives.inference_rows(w.log, w.frame, w.config.inference)
    out = derivatives.update_functions(data, theta, w.config.inference)
    return out.select(
        "study_id", "subject_id", six("loss").alias("loss"),
        *at("gradient", "gradient_0", "gradient_1"), *at("second", "second_00", "second_01", "second_10", "second_11"),
    )


@entry(
    "inference_mixed_derivatives",
    """SELECT d.study_id, d.subject_id, d.calendar_t, [[-2 * t1]] AS mixed_0,
              [[-2 * t1 * d + 2 * (reward - t0 - t1 * d)]] AS mixed_1
       FROM dec d JOIN theta t ON d.study_id = t.study_id""",
)
def _(w):
    data, theta = derivatives.inference_rows(w.log, w.frame, w.config.inference)
    out = derivatives.mixed_derivatives(data, theta, w.config.inference)
    return out.select("study_id", "subject_id", "calendar_t", *at("mixed", "mixed_0", "mixed_1"))


@entry(
    "update_mixed_derivatives",
    """SELECT r.study_id, r.policy_num, r.subject_id, r.calendar_t, [[-2 * b1]] AS mixed_0,
              [[-2 * b1 * d.d + 2 * (r.reward - b0 - b1 * d.d)]] AS mixed_1
       FROM urows r JOIN (SELECT study_id, k, b0, b1 FROM beta) b ON r.study_id = b.study_id AND r.k = b.k
       JOIN (SELECT study_id, subject_id, calendar_t, d FROM dec) d ON r.study_id = d.study_id
         AND r.subject_id = d.subject_id AND r.calendar_t = d.calendar_t""",
)
def _(w):
    model = replace(w.config.update, centered=True)
    out = derivatives.mixed_derivatives(w.update_rows, w.params, model)
    return out.select("study_id", "policy_num", "subject_id", "calendar_t", *at("mixed", "mixed_0", "mixed_1"))


# Estimates


@entry("theta", "SELECT study_id, [[t0]] AS theta_0, [[t1]] AS theta_1 FROM theta")
def _(w):
    return w.frame.select("study_id", *at("theta", "theta_0", "theta_1"))


@entry(
    "uncentered_theta",
    """SELECT study_id, [[(sa * sr - sa * sra) / (c * sa - sa * sa)]] AS theta_0,
              [[(c * sra - sa * sr) / (c * sa - sa * sa)]] AS theta_1
       FROM (SELECT study_id, CAST(count(*) AS DOUBLE) AS c, CAST(sum(action) AS DOUBLE) AS sa, sum(reward) AS sr,
                    sum(reward * action) AS sra FROM glog WHERE active = 1 GROUP BY 1)""",
)
def _(w):
    gram = sums_ops.Gram("i", 2)
    model = w.config.update
    sums = w.log.filter("active = 1").groupBy("study_id").agg(
        *gram.sums(model.features("action_prob"))
    )
    solved = sums.select("study_id", solve_ridge(gram.xx_array(), gram.rx_array(), F.lit(0.0)).alias("theta"))
    return solved.select("study_id", *at("theta", "theta_0", "theta_1"))


@entry(
    "ridge_betas",
    """SELECT study_id, policy_num, [[((sa + 2) * sr - sa * sra) / ((c + 2) * (sa + 2) - sa * sa)]] AS beta_0,
              [[((c + 2) * sra - sa * sr) / ((c + 2) * (sa + 2) - sa * sa)]] AS beta_1 FROM ustat""",
)
def _(w):
    a = Analysis(w.log, replace(w.config, update=replace(w.config.update, ridge=2.0)))
    return a.estimated_params.select("study_id", "policy_num", *at("beta", "beta_0", "beta_1"))


@entry(
    "posterior_updates",
    """SELECT study_id, policy_num, users AS n_users,
              [[((sa + 1) * sr - sa * sra) / ((c + 1) * (sa + 1) - sa * sa)]] AS mean_0,
              [[((c + 1) * sra - sa * sr) / ((c + 1) * (sa + 1) - sa * sa)]] AS mean_1,
              [[(c + 1) / users]] AS precision_00, [[sa / users]] AS precision_01, [[(sa + 1) / users]] AS precision_11
       FROM ustat""",
)
def _(w):
    out = posterior.posterior_updates(w.log, w.analysis._calendar, w.config.update, posterior.NormalPrior())
    return out.select(
        "study_id", "policy_num", "n_users",
        *at("beta", "mean_0", "mean_1", "precision_00", "precision_01", "precision_11"),
    )


@entry(
    "posterior_functions",
    """SELECT r.study_id, r.policy_num, r.subject_id,
              [[-(sum(r.reward - m0 - m1 * r.action) - any_value(m0) / any_value(users))]] AS v0,
              [[-(sum((r.reward - m0 - m1 * r.action) * r.action) - any_value(m1) / any_value(users))]] AS v1,
              [[-(count(*) + 1.0 / any_value(users) - any_value((c + 1) / users))]] AS v2,
              [[-(sum(r.action) - any_value(sa / users))]] AS v3,
              [[-(sum(r.action * r.action) + 1.0 / any_value(users) - any_value((sa + 1) / users))]] AS v4
       FROM urows r JOIN (
         SELECT *, ((sa + 1) * sr - sa * sra) / ((c + 1) * (sa + 1) - sa * sa) AS m0,
                ((c + 1) * sra - sa * sr) / ((c + 1) * (sa + 1) - sa * sa) AS m1 FROM ustat) p
       ON r.study_id = p.study_id AND r.k = p.k GROUP BY 1, 2, 3""",
)
def _(w):
    prior = posterior.NormalPrior()
    params = posterior.posterior_updates(w.log, w.analysis._calendar, w.config.update, prior)
    out = posterior.posterior_functions(w.update_rows, params, w.config.update, prior)
    return out.select("study_id", "policy_num", "subject_id", *at("v", "v0", "v1", "v2", "v3", "v4"))


@entry(
    "subject_stacks",
    "SELECT study_id, subject_id, block, [[v0]] AS v0, [[v1]] AS v1 FROM stack",
)
def _(w):
    return w.analysis.stack.filter("kind = 'phi'").select(
        "study_id", "subject_id", "block", *at("v", "v0", "v1")
    )


def _square(df: DataFrame, column: str) -> DataFrame:
    return df.select("study_id", F.posexplode(column).alias("p", "value")).select(
        "study_id", (F.col("p") / 2).cast("int").alias("r"), (F.col("p") % 2).alias("c"),
        F.round(F.col("value") * 1e6, 4).alias("value_e6"),
    )


@entry(
    "classical_variance",
    "SELECT study_id, r, c, round(value * 1e6, 4) AS value_e6 FROM classical",
)
def _(w):
    return _square(w.analysis.classical, "classical_variance")


@entry(
    "adjusted_variance",
    "SELECT study_id, r, c, round(value * 1e6, 4) AS value_e6 FROM adjusted",
)
def _(w):
    return _square(w.analysis.joint, "adjusted_variance")


CORNERS = [(r, c) for r in range(2) for c in range(2)]
#: Every entry of both variances beside theta; ``{0}`` stands for further columns.
RESULT_SQL = (
    "SELECT t.study_id, {0}[[t0]] AS theta_0, [[t1]] AS theta_1"
    + "".join(f", round(1e6 * {kind[0]}{r}{c}.value, 4) AS {kind}_{r}{c}_e6" for kind in ("adjusted", "classical") for r, c in CORNERS)
    + " FROM theta t"
    + "".join(f" JOIN {kind} {kind[0]}{r}{c} ON {kind[0]}{r}{c}.study_id = t.study_id AND {kind[0]}{r}{c}.r = {r} AND {kind[0]}{r}{c}.c = {c}"
              for kind in ("adjusted", "classical") for r, c in CORNERS)
)


def _variances(q: int):
    """Every entry of both variances as a column of its own."""
    return [
        F.round(F.get(f"{kind}_variance", F.lit(r * q + c)) * 1e6, 4).alias(f"{kind}_{r}{c}_e6")
        for kind in ("adjusted", "classical") for r in range(q) for c in range(q)
    ]


# The analysis in SQL once per pretended end, each on its own cut of the log.
ORACLES["premature_estimates"] = " UNION ALL ".join(
    f"SELECT * FROM ({statement(shifted(RESULT_SQL.format(f"{k} AS end_idx, ")), f'endlog{k}')}) e{k}"
    for k in range(ENDS)
)


@entry("after_study_analysis", RESULT_SQL.format(""))
def _(w):
    """The whole analysis from the raw events, nothing reused."""
    return flagship(w.spark, w.sf_dir)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = studies.events_analysis(spark, sf_dir).result
    return result.select(
        "study_id", *at("theta", "theta_0", "theta_1"),
        *_variances(2),
    )


@entry("after_study_analysis_orders", RESULT_SQL.format(""), "olog")
def _(w):
    result = studies.orders_analysis(w.spark, w.sf_dir).result
    return result.select(
        "study_id", *at("theta", "theta_0", "theta_1"),
        *_variances(2),
    )


@entry("after_study_analysis_with_state")
def _(w):
    """Four parameters per update: the reward before the decision joins the state."""
    result = studies.events_analysis(w.spark, w.sf_dir, studies.EVENTS_STATE_CONFIG).result
    return result.select(
        "study_id", *at("theta", "theta_0", "theta_1", "theta_2", "theta_3"),
        *_variances(4),
    )


# User functions


def least_squares(param, rows):
    """A user's estimating function: reward on the action less its probability."""
    dose = rows["action"].to_numpy() - rows["action_prob"].to_numpy()
    resid = rows["reward"].to_numpy() - param[0] - param[1] * dose
    return [-2.0 * resid.sum(), -2.0 * (resid * dose).sum()]


def plain_least_squares(param, rows):
    dose = rows["action"].to_numpy()
    resid = rows["reward"].to_numpy() - param[0] - param[1] * dose
    return [-2.0 * resid.sum(), -2.0 * (resid * dose).sum()]


def squared_loss(param, rows):
    """A user's loss; its gradient is the estimating function above."""
    dose = rows["action"].to_numpy() - rows["action_prob"].to_numpy()
    return ((rows["reward"].to_numpy() - param[0] - param[1] * dose) ** 2).sum()


def plain_loss(param, rows):
    return ((rows["reward"].to_numpy() - param[0] - param[1] * rows["action"].to_numpy()) ** 2).sum()


def _centered_theta(log: DataFrame) -> DataFrame:
    """A user's theta function of the whole log: least squares with the recorded probabilities."""
    gram = sums_ops.Gram("i", 2)
    features = ["(intercept * 1D)", "(action - action_prob)"]
    sums = log.filter("active = 1").groupBy("study_id").agg(*gram.sums(features))
    return sums.select("study_id", solve_ridge(gram.xx_array(), gram.rx_array(), F.lit(0.0)).alias("theta"))


def _user_analysis(w, kind: str, correction: str = "none", additive: bool = False) -> FunctionAnalysis:
    # Differences of a quadratic are exact at any step, and a wide one loses no digits.
    update, inference = (plain_least_squares, least_squares) if kind == "estimating" else (plain_loss, squared_loss)
    make = lambda f: UserFunction(f, ("intercept",), 2, kind, 0.25, additive)
    config = replace(w.config, correction=correction)
    return FunctionAnalysis(w.log, w.params, config, make(update), make(inference), _centered_theta)


@entry("user_theta", "SELECT study_id, [[t0]] AS theta_0, [[t1]] AS theta_1 FROM theta")
def _(w):
    return _user_analysis(w, "estimating").frame.select("study_id", *at("theta", "theta_0", "theta_1"))


@entry("user_function_analysis", RESULT_SQL.format(""))
def _(w):
    """Estimating functions given as Python functions: the same analysis as with the built-in models."""
    result = _user_analysis(w, "estimating", additive=True).result
    return result.select("study_id", *at("theta", "theta_0", "theta_1"), *_variances(2))


@entry("user_loss_stacks", "SELECT study_id, subject_id, block, [[v0]] AS v0, [[v1]] AS v1 FROM stack")
def _(w):
    """Losses given as Python functions: their gradients are the estimating functions."""
    return _user_analysis(w, "loss").stack.filter("kind = 'phi'").select(
        "study_id", "subject_id", "block", *at("v", "v0", "v1"))


@entry(
    "user_function_bread_inverse",
    "SELECT study_id, row_block, col_block, r, c, [[value]] AS value FROM bread WHERE round(value, 6) <> 0",
)
def _(w):
    out = _user_analysis(w, "loss").bread_inverse
    return rounded(out, "value").filter("value <> 0")


@entry(
    "user_function_corrected_meats",
    f"""SELECT p.study_id, [[sum(v0 * v0 / ((1 - h) * (1 - h))) / any_value(n)]] AS m00,
               [[sum(v0 * v1 / ((1 - h) * (1 - h))) / any_value(n)]] AS m01,
               [[sum(v1 * v1 / ((1 - h) * (1 - h))) / any_value(n)]] AS m11
        FROM psi p JOIN leverage x ON p.study_id = x.study_id AND p.subject_id = x.subject_id GROUP BY 1""",
)
def _(w):
    """The corner of the joint meat under HC3, with leverages of the user's function."""
    a = _user_analysis(w, "estimating", "HC3theta")
    meat = sandwich_ops.theta_meat(a.weighted_stack, a.frame, a.config)
    return meat.select("study_id", *[six(F.get("meat", F.lit(i))).alias(n) for i, n in ((0, "m00"), (1, "m01"), (3, "m11"))])


@entry(
    "sandwich_by_three_methods",
    """SELECT study_id, r, c, round(value * 1e6, 4) AS value_e6, method FROM adjusted,
       (VALUES ('bread_inverse_T_qr'), ('meat_svd_solve'), ('naive')) AS m(method)""",
)
def _(w):
    cells = sandwich_ops.joint_input(w.analysis.bread_inverse, w.analysis.meat, w.frame)
    parts = [
        _square(
            sandwich_ops.adjusted_variance(cells, replace(w.config, sandwich=m)), "adjusted_variance"
        ).withColumn("method", F.lit(m))
        for m in ("bread_inverse_T_qr", "meat_svd_solve", "naive")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@entry(
    "leverages",
    f"SELECT study_id, subject_id, [[h]] AS leverage FROM leverage",
)
def _(w):
    return rounded(sandwich_ops.leverages(w.stack, w.frame), "leverage")


@entry(
    "corrected_classical_meats",
    f"""SELECT p.study_id, kind, [[sum(weight * v0 * v0) / any_value(n)]] AS m00,
               [[sum(weight * v0 * v1) / any_value(n)]] AS m01, [[sum(weight * v1 * v1) / any_value(n)]] AS m11
        FROM psi p JOIN (
          SELECT study_id, subject_id, n, unnest(['none', 'HC1theta', 'HC2theta', 'HC3theta']) AS kind,
                 unnest([1.0, n / (n - 2), 1 / (1 - h), 1 / ((1 - h) * (1 - h))]) AS weight FROM leverage) x
          ON p.study_id = x.study_id AND p.subject_id = x.subject_id GROUP BY 1, 2""",
)
def _(w):
    out = None
    for kind in ("none", "HC1theta", "HC2theta", "HC3theta"):
        config = replace(w.config, correction=kind)
        weighted = sandwich_ops.with_weights(w.stack, w.frame, config)
        part = sandwich_ops.theta_meat(weighted, w.frame, config).select(
            "study_id", F.lit(kind).alias("kind"), six(F.get("meat", F.lit(0))).alias("m00"),
            six(F.get("meat", F.lit(1))).alias("m01"), six(F.get("meat", F.lit(3))).alias("m11"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@entry("stabilised_bread_inverse", JOINT_BREAD_SQL + " WHERE round(value, 6) <> 0")
def _(w):
    """The event study is well conditioned, so stabilising must leave it as it is."""
    cells = conditioning.stabilised(w.analysis.bread_inverse, w.frame, w.config)
    return rounded(cells, "value").filter("value <> 0")


@entry("stabilisation_audit")
def _(w):
    audit = conditioning.stabilisation_audit(w.analysis.bread_inverse, w.frame, w.config)
    return rounded(audit, "condition_before", "condition_after")


@entry("repaired_inverses")
def _(w):
    out = None
    for repair in ("none", "trim_small_singular_values", "add_ridge_fixed_condition_number",
                   "add_ridge_median_singular_value_fraction", "zero_out_small_off_diagonals",
                   "inverse_bread_structure_aware_inversion"):
        cells = conditioning.inverted(w.analysis.bread_inverse, w.frame, w.config, repair, limit=20.0)
        part = cells.select(
            "study_id", F.lit(repair).alias("repair"), "row_block", "col_block", "r", "c",
            six("value").alias("value"), six("condition_used").alias("condition_used"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@entry(
    "theta_only_adjusted_variance",
    "SELECT study_id, r, c, round(value * 1e6, 4) AS value_e6 FROM adjusted",
)
def _(w):
    """Explicit adjustments of every subject; must equal the corner of the joint sandwich."""
    out = conditioning.theta_only_variance(w.stack, w.analysis.bread_inverse, w.frame, w.config)
    return _square(out, "theta_only_variance")


@entry("corrected_variances", "SELECT study_id, r, c, route, round(value * 1e6, 4) AS value_e6 FROM corrected, (VALUES ('joint'), ('explicit')) AS v(route)")
def _(w):
    """The adjusted variance under HC3: from the joint matrices, and from explicit adjustments."""
    a = replace(w.analysis, config=replace(w.config, correction="HC3theta", explicit_adjustments=True, stabilise=False))
    result = a.result
    return _square(result, "adjusted_variance").withColumn("route", F.lit("joint")).unionByName(
        _square(result, "theta_only_variance").withColumn("route", F.lit("explicit")))


@entry("update_conditions")
def _(w):
    out = conditioning.update_conditions(w.analysis.bread_inverse, w.frame, w.config)
    return rounded(out, "whole_condition", "block_condition", "inverse_norm", "scaled_off_diagonal")


@entry(
    "block_norms",
    "SELECT study_id, row_block, col_block, [[sqrt(sum(value * value))]] AS norm FROM bread GROUP BY 1, 2, 3",
)
def _(w):
    return rounded(conditioning.block_norms(w.analysis.bread_inverse), "norm")


@entry(
    "off_diagonal_norms",
    """SELECT study_id, row_block AS block, [[sqrt(sum(value * value))]] AS norm, 'row' AS side FROM bread
       WHERE row_block > col_block GROUP BY 1, 2
       UNION ALL SELECT study_id, col_block, [[sqrt(sum(value * value))]], 'col' FROM bread
       WHERE row_block > col_block GROUP BY 1, 2""",
)
def _(w):
    return rounded(conditioning.off_diagonal_norms(w.analysis.bread_inverse), "norm")


@entry(
    "without_small_blocks",
    """SELECT b.study_id, b.row_block, b.col_block, b.r, b.c,
              [[CASE WHEN b.row_block > b.col_block AND sqrt(n.s) < 0.05 * sqrt(d.s) THEN 0 ELSE b.value END]] AS value
       FROM bread b
       JOIN (SELECT study_id, row_block, col_block, sum(value * value) AS s FROM bread GROUP BY 1, 2, 3) n
         ON b.study_id = n.study_id AND b.row_block = n.row_block AND b.col_block = n.col_block
       JOIN (SELECT study_id, row_block, sum(value * value) AS s FROM bread WHERE row_block = col_block GROUP BY 1, 2) d
         ON b.study_id = d.study_id AND b.row_block = d.row_block""",
)
def _(w):
    return rounded(conditioning.without_small_blocks(w.analysis.bread_inverse, 0.05), "value")


@entry("study_features")
def _(w):
    return rounded(study_features(w.analysis), "value")


# Checks


CHECK_ZERO = "SELECT '{0}' AS \"check\", study_id, 'error' AS severity, CAST(0 AS BIGINT) AS violations FROM bounds"


@entry(
    "log_checks",
    " UNION ALL ".join(
        CHECK_ZERO.format(c)
        for c in (
            "active_flags_binary", "actions_binary", "probabilities_inside_unit_interval",
            "subject_ids_not_null", "policy_numbers_consecutive", "times_consecutive",
            "every_subject_has_every_time", "policy_numbers_do_not_fall",
        )
    ),
)
def _(w):
    return checks.all_log_checks(w.log).drop("sample")


@entry(
    "observed_rows_full_grid_check",
    """SELECT 'every_subject_has_every_time' AS "check", s.study_id, 'error' AS severity,
              count(*) FILTER (WHERE c <> t) AS violations
       FROM (SELECT study_id, subject_id, count(*) AS c FROM daily GROUP BY 1, 2) s
       JOIN (SELECT study_id, count(DISTINCT calendar_t) AS t FROM daily GROUP BY 1) x ON s.study_id = x.study_id
       GROUP BY 2""",
)
def _(w):
    observed = event_source.daily_actions(studies.table(w.spark, w.sf_dir, "events"))
    return checks.full_grid_check(observed).drop("sample")


@entry(
    "input_checks",
    " UNION ALL ".join(
        CHECK_ZERO.format(c)
        for c in (
            "probabilities_recomputed", "inputs_for_every_subject_and_time", "inputs_only_for_known_times",
            "inputs_blank_exactly_when_inactive", "update_times_strictly_increasing",
            "update_times_inside_study", "betas_agree_across_subjects", "betas_have_one_dimension",
        )
    ),
)
def _(w):
    calendar = w.analysis._calendar
    return (
        checks.probabilities_recomputed(w.log, w.decided)
        .unionByName(checks.policy_input_checks(w.log, w.inputs))
        .unionByName(checks.update_times_check(w.update_rows, calendar))
        .unionByName(checks.shared_beta_checks(w.inputs))
        .drop("sample")
    )


@entry(
    "disturbed_probability_check",
    """SELECT 'probabilities_recomputed' AS "check", study_id, 'error' AS severity,
              count(*) FILTER (WHERE k >= 0 AND abs(pi - 0.8) > 1e-6) AS violations FROM dec GROUP BY 2""",
)
def _(w):
    """Recorded probabilities set to 0.8: every learned decision with another one is counted."""
    bad = w.decided.withColumn(
        "action_prob", F.when(F.col("policy_idx") >= 0, F.lit(0.8)).otherwise(F.col("action_prob"))
    )
    return checks.probabilities_recomputed(w.log, bad).drop("sample")


@entry(
    "update_coverage_check",
    """SELECT 'every_subject_in_every_update' AS "check", study_id, 'error' AS severity, count(*) AS violations
       FROM (SELECT DISTINCT r.study_id, r.policy_num, r.subject_id FROM urows r
             EXCEPT SELECT DISTINCT r.study_id, r.policy_num, r.subject_id FROM urows r WHERE r.reward > 2)
       GROUP BY 2""",
)
def _(w):
    """Update rows with a large reward only: subjects without one go missing."""
    some = w.update_rows.filter("reward > 2")
    return checks.update_coverage_checks(w.log, some, w.analysis._calendar).drop("sample")


@entry(
    "mean_stack_check",
    """SELECT "check", study_id, severity, CAST(0 AS BIGINT) AS violations, block FROM (SELECT DISTINCT study_id, block FROM smean),
       (VALUES ('mean_stack_near_zero', 'error'), ('mean_stack_close_to_zero', 'warning')) AS v("check", severity)""",
)
def _(w):
    out = checks.mean_stack_check(w.analysis.stack_mean)
    block = F.split("sample", r"\|")
    return out.withColumn("block", F.get(block, F.lit(1)).cast("int")).drop("sample")


@entry(
    "identity_check",
    """SELECT 'bread_times_inverse_is_identity' AS "check", study_id, 'warning' AS severity,
              CAST(0 AS BIGINT) AS violations FROM bounds""",
)
def _(w):
    return checks.identity_check(w.analysis.joint).drop("sample")


@entry(
    "function_agreement_check",
    "SELECT 'update_functions_agree' AS \"check\", study_id, 'error' AS severity, CAST(0 AS BIGINT) AS violations FROM bounds",
)
def _(w):
    keys = ["study_id", "policy_num", "subject_id"]
    model = replace(w.config.update, centered=True)
    given = derivatives.update_functions(w.update_rows, w.params, model)
    again = derivatives.update_functions(row_ops.with_recomputed(w.update_rows, w.decided), w.params, model)
    return checks.function_agreement(
        given, again, keys, checks.UPDATE_FUNCTION_TOLERANCES, "update_functions_agree"
    ).drop("sample")


# Checks that fire: one disturbance each, and the violations counted from the raw tables


def _counted(name: str, select: str, severity: str = "error") -> str:
    """A check's rows from SQL that gives (study_id, violations)."""
    return f"SELECT '{name}' AS \"check\", study_id, '{severity}' AS severity, CAST(violations AS BIGINT) AS violations FROM ({select})"


@entry(
    "disturbed_update_probabilities_check",
    _counted("update_probabilities_equal_log",
             """SELECT r.study_id, count(*) AS violations FROM urows r JOIN dec d ON r.study_id = d.study_id
                AND r.subject_id = d.subject_id AND r.calendar_t = d.calendar_t
                WHERE r.calendar_t % 3 = 0 AND abs(pi - 0.8) > 1e-6 GROUP BY 1"""),
)
def _(w):
    """Probabilities of every third time are 0.8 in the update rows only."""
    third = F.col("calendar_t") % 3 == 0
    rows = w.update_rows.withColumn("action_prob", F.when(third, 0.8).otherwise(F.col("action_prob")))
    return checks.update_coverage_checks(w.log, rows, w.analysis._calendar).drop("sample")


@entry(
    "disturbed_policy_inputs_check",
    " UNION ALL ".join([
        _counted("inputs_for_every_subject_and_time", "SELECT study_id, count(*) FILTER (WHERE calendar_t = 2) AS violations FROM glog GROUP BY 1"),
        _counted("inputs_only_for_known_times", "SELECT study_id, count(*) FILTER (WHERE calendar_t = 2) AS violations FROM glog GROUP BY 1"),
        _counted("inputs_blank_exactly_when_inactive",
                 """SELECT study_id, 2 * count(*) FILTER (WHERE calendar_t = 2 AND active = 1)
                           + count(*) FILTER (WHERE calendar_t = 4 AND active = 1) AS violations FROM glog GROUP BY 1"""),
    ]),
)
def _(w):
    """Inputs of time 2 stand at time 999, and those of time 4 are blank."""
    blank = F.when(F.col("calendar_t") != 4, F.col("inputs"))
    moved = F.when(F.col("calendar_t") == 2, 999).otherwise(F.col("calendar_t")).cast("int")
    inputs = w.inputs.withColumns({"inputs": blank, "calendar_t": moved})
    return checks.policy_input_checks(w.log, inputs).drop("sample")


@entry(
    "disturbed_update_coverage_check",
    " UNION ALL ".join([
        _counted("update_rows_only_for_known_policies", "SELECT DISTINCT study_id, 1 AS violations FROM urows WHERE policy_num = 2"),
        _counted("every_update_has_rows", "SELECT DISTINCT study_id, 1 AS violations FROM urows WHERE policy_num = 2"),
        _counted("every_subject_in_every_update",
                 "SELECT study_id, count(DISTINCT subject_id) AS violations FROM urows WHERE policy_num = 2 GROUP BY 1"),
    ]),
)
def _(w):
    """The rows of update 2 say that they are of update 77, which no decision uses."""
    rows = w.update_rows.withColumn("policy_num", F.when(F.col("policy_num") == 2, 77).otherwise(F.col("policy_num")))
    return checks.update_coverage_checks(w.log, rows, w.analysis._calendar).drop("sample")


@entry(
    "disturbed_betas_check",
    _counted("betas_agree_across_subjects",
             """SELECT study_id, count(*) FILTER (WHERE kinds = 2) AS violations
                FROM (SELECT study_id, k, count(DISTINCT subject_id % 4 = 0) AS kinds FROM dec WHERE k >= 0 GROUP BY 1, 2) GROUP BY 1""")
    + " UNION ALL "
    + _counted("betas_have_one_dimension",
               "SELECT study_id, count(DISTINCT subject_id % 4 = 0) - 1 AS violations FROM dec WHERE k >= 0 GROUP BY 1"),
)
def _(w):
    """Every fourth subject is given a longer beta."""
    longer = F.when(F.col("subject_id") % 4 == 0, F.array_append("inputs.beta", F.lit(1.0))).otherwise(F.col("inputs.beta"))
    inputs = w.inputs.withColumn("inputs", F.when(F.col("inputs").isNotNull(), F.col("inputs").withField("beta", longer)))
    return checks.shared_beta_checks(inputs).drop("sample")


@entry(
    "disturbed_update_times_check",
    _counted("update_times_strictly_increasing", "SELECT study_id, count(*) FILTER (WHERE calendar_t = 1) AS violations FROM urows GROUP BY 1")
    + " UNION ALL "
    + _counted("update_times_inside_study", "SELECT study_id, count(*) FILTER (WHERE calendar_t = 0) AS violations FROM urows GROUP BY 1"),
)
def _(w):
    """Rows of time 1 come twice, rows of time 0 once more at time -5."""
    rows = w.update_rows
    again = rows.filter("calendar_t = 1").unionByName(rows.filter("calendar_t = 0").withColumn("calendar_t", F.lit(-5)))
    return checks.update_times_check(rows.unionByName(again), w.analysis._calendar).drop("sample")


def _moved_means(scale: float) -> str:
    """Mean stack per block and position when all betas are scaled: the theta block stays at zero."""
    return f"""(SELECT s.study_id, CAST(s.k AS INTEGER) AS block, abs(2 * {scale} * (s.c * b0 + sa * b1) / n) AS m0,
                       abs(2 * {scale} * (sa * b0 + sa * b1) / n) AS m1
                FROM ustat s JOIN beta b ON s.study_id = b.study_id AND s.k = b.k JOIN sizes z ON s.study_id = z.study_id
                UNION ALL SELECT study_id, CAST(kk AS INTEGER), 0, 0 FROM sizes)"""


def _moved_check(scale: float, warn: float, last: str = "") -> str:
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS "check", m.study_id, '{severity}' AS severity, block,
                   CAST({" + ".join(f"CASE WHEN {p} > {lo} AND {p} <= {hi} THEN 1 ELSE 0 END" for p in ("m0", "m1"))} AS BIGINT) AS violations
            FROM {_moved_means(scale)} m JOIN sizes z ON m.study_id = z.study_id {last}"""
        for name, severity, lo, hi in (("mean_stack_near_zero", "error", 1e-2, 1e300), ("mean_stack_close_to_zero", "warning", warn, 1e-2)))


def _stack_findings(out: DataFrame) -> DataFrame:
    block = F.get(F.split("sample", r"\|"), F.lit(1)).cast("int")
    return out.withColumn("block", block).drop("sample")


def _moved(w, scale: float) -> DataFrame:
    return w.params.withColumn("beta", F.transform("beta", lambda v: v * (1.0 + scale)))


@entry("disturbed_mean_stack_check", _moved_check(0.004, 5e-4))
def _(w):
    """All betas are 0.4 % too large."""
    a = Analysis(w.log, w.config, _moved(w, 0.004))
    return _stack_findings(checks.mean_stack_check(a.stack_mean))


@entry("disturbed_update_only_stack_check", _moved_check(0.0001, 1e-5, "WHERE block < kk"))
def _(w):
    """All betas are 0.01 % too large, under the tighter limit while the study runs."""
    a = UpdateAssessment(w.log, _moved(w, 0.0001), w.config)
    return _stack_findings(checks.mean_stack_check(a.stack_mean, update_only=True))


def _far(a: str, b: str, atol: float, rtol: float) -> str:
    return f"abs({a} - {b}) > {atol} + {rtol} * abs({b})"


@entry(
    "disturbed_update_functions_check",
    _counted("update_functions_agree",
             f"""SELECT study_id, count(*) FILTER (WHERE {_far("x0", "y0", 1e-7, 1e-3)} OR {_far("x1", "y1", 1e-7, 1e-3)}) AS violations
                 FROM (SELECT r.study_id, r.policy_num, r.subject_id,
                         sum(-2 * (r.reward - b.b0 - b.b1 * e)) AS x0, sum(-2 * (r.reward - b.b0 - b.b1 * e) * e) AS x1,
                         sum(-2 * (r.reward - b.b0 - b.b1 * d)) AS y0, sum(-2 * (r.reward - b.b0 - b.b1 * d) * d) AS y1
                       FROM urows r JOIN beta b ON r.study_id = b.study_id AND r.k = b.k
                       JOIN (SELECT study_id, subject_id, calendar_t, d, CASE WHEN calendar_t % 5 = 0 THEN action - 0.8 ELSE d END AS e
                             FROM dec) x ON r.study_id = x.study_id AND r.subject_id = x.subject_id AND r.calendar_t = x.calendar_t
                       GROUP BY 1, 2, 3) GROUP BY 1"""),
)
def _(w):
    """Recorded probabilities of every fifth time are 0.8, under a centred update model."""
    model = replace(w.config.update, centered=True)
    rows = w.update_rows.withColumn("action_prob", F.when(F.col("calendar_t") % 5 == 0, 0.8).otherwise(F.col("action_prob")))
    given = derivatives.update_functions(rows, w.params, model)
    again = derivatives.update_functions(row_ops.with_recomputed(rows, w.decided), w.params, model)
    return checks.function_agreement(
        given, again, ["study_id", "policy_num", "subject_id"], checks.UPDATE_FUNCTION_TOLERANCES, "update_functions_agree"
    ).drop("sample")


@entry(
    "disturbed_inference_functions_check",
    _counted("inference_functions_agree",
             f"""SELECT study_id, count(*) FILTER (WHERE {_far("x0", "y0", 0, 1e-2)} OR {_far("x1", "y1", 0, 1e-2)}) AS violations
                 FROM (SELECT x.study_id, subject_id, sum(-2 * (reward - t0 - t1 * e)) AS x0, sum(-2 * (reward - t0 - t1 * e) * e) AS x1,
                         sum(-2 * (reward - t0 - t1 * d)) AS y0, sum(-2 * (reward - t0 - t1 * d) * d) AS y1
                       FROM (SELECT *, CASE WHEN calendar_t % 5 = 0 THEN action - 0.8 ELSE d END AS e FROM dec) x
                       JOIN theta t ON x.study_id = t.study_id GROUP BY 1, 2) GROUP BY 1"""),
)
def _(w):
    data, theta = derivatives.inference_rows(w.log, w.frame, w.config.inference)
    rows = data.withColumn("action_prob", F.when(F.col("calendar_t") % 5 == 0, 0.8).otherwise(F.col("action_prob")))
    given = derivatives.update_functions(rows, theta, w.config.inference)
    again = derivatives.update_functions(row_ops.with_recomputed(rows, w.decided), theta, w.config.inference)
    return checks.function_agreement(
        given, again, ["study_id", "policy_num", "subject_id"], checks.INFERENCE_FUNCTION_TOLERANCES, "inference_functions_agree"
    ).drop("sample")


@entry(
    "disturbed_explicit_variance_check",
    _counted("explicit_variance_agrees",
             """SELECT a.study_id, count(*) FILTER (WHERE abs(c.value - a.value) > 3e-2 * abs(a.value)) AS violations
                FROM adjusted a JOIN classical c ON a.study_id = c.study_id AND a.r = c.r AND a.c = c.c GROUP BY 1""", "warning"),
)
def _(w):
    """The classical variance in place of the explicitly adjusted one."""
    wrong = w.analysis.classical.withColumnRenamed("classical_variance", "theta_only_variance")
    return checks.variance_agreement(wrong, w.analysis.joint).drop("sample")


# Monitor


def _assessment(w) -> UpdateAssessment:
    """The last policy as a proposed update: its decisions are not known yet."""
    last = w.analysis._calendar.select("study_id", F.array_max("policy_nums").alias("last"))
    seen = w.log.join(last, "study_id")
    cut = w.analysis._calendar.select(
        "study_id", F.element_at("update_times", -1).alias("cut_t")
    )
    before = seen.join(cut, "study_id").filter("calendar_t < cut_t").drop("cut_t", "last")
    return UpdateAssessment(before, w.params, w.config)


@entry(
    "monitor_bread_inverse",
    """SELECT b.study_id, row_block, col_block, r, c, [[value]] AS value FROM bread b
       JOIN sizes z ON b.study_id = z.study_id WHERE row_block < kk""",
)
def _(w):
    return rounded(_assessment(w).cells(), "value")


@entry(
    "monitor_newest_block_row",
    """SELECT b.study_id, row_block, col_block, r, c, [[value]] AS value FROM bread b
       JOIN sizes z ON b.study_id = z.study_id WHERE row_block = kk - 1""",
)
def _(w):
    a = _assessment(w)
    return rounded(a.cells(a.newest), "value")


@entry(
    "monitor_stack_mean",
    """SELECT s.study_id, block, pos, [[mean]] AS mean FROM smean s JOIN sizes z ON s.study_id = z.study_id
       WHERE block < kk""",
)
def _(w):
    return rounded(_assessment(w).stack_mean, "mean")


@entry("update_verdicts")
def _(w):
    return rounded(_assessment(w).verdicts(), "whole_condition", "diagonal_condition")


LOG_SCHEMA = (
    "study_id string, subject_id long, calendar_t int, active int, action int, policy_num int,"
    "action_prob double, reward double, intercept double, past_reward double, ts timestamp"
)


def _stream_folder(w, name: str) -> str:
    return f"{work_folder(w.spark)}/trialweave/{name}-{uuid.uuid4().hex}"


def _streamed_monitor(w) -> StreamingMonitor:
    """Decisions and notices of the event study sent through the monitor in two instalments."""
    base = _stream_folder(w, "monitor")
    # Both are read as file streams; each instalment is appended to the source folders.
    columns = [c.split()[0] for c in LOG_SCHEMA.split(",")]
    log = w.log.withColumn(
        "ts", F.to_timestamp(F.date_add(F.to_date(F.lit("2024-01-01")), F.col("calendar_t")))
    ).select(*columns)
    last = w.analysis._calendar.select("study_id", F.array_max("policy_nums").alias("last"))
    log, params = log.join(last, "study_id"), w.params.join(last, "study_id")
    period = F.floor(F.col("calendar_t") / 5)
    monitor = StreamingMonitor(w.spark, f"{base}/state", w.config, LOG_SCHEMA)
    half = F.floor(F.col("last") / 2)
    for part in (True, False):
        first = (period <= half) if part else ((period > half) & (period < F.col("last")))
        log.filter(first).select(*columns).write.mode("append").parquet(f"{base}/decisions")
        source = w.spark.readStream.schema(LOG_SCHEMA).parquet(f"{base}/decisions")
        monitor.start_decisions(source).awaitTermination()
        noticed = (F.col("policy_num") <= half + 1) if part else (F.col("policy_num") > half + 1)
        params.filter(noticed).select("study_id", "policy_num", "beta").write.mode("append").parquet(
            f"{base}/notices"
        )
        notices = w.spark.readStream.schema(POLICY_PARAMS_SCHEMA).parquet(f"{base}/notices")
        monitor.start_notices(notices).awaitTermination()
    return monitor


@entry(
    "streamed_monitor_bread_inverse",
    """SELECT b.study_id, row_block, col_block, r, c, [[value]] AS value FROM bread b
       JOIN sizes z ON b.study_id = z.study_id WHERE row_block < kk""",
)
def _(w):
    """Block rows appended notice by notice equal the matrix computed at once."""
    return rounded(_streamed_monitor(w).cells, "value")


@entry(
    "streamed_update_statistics",
    """SELECT study_id, policy_num, CAST(count(*) AS BIGINT) AS n, CAST(sum(action) AS DOUBLE) AS sum_action,
              [[sum(reward)]] AS sum_reward, [[sum(reward * action)]] AS sum_product
       FROM glog WHERE active = 1 GROUP BY 1, 2""",
)
def _(w):
    base = _stream_folder(w, "statistics")
    columns = [c.split()[0] for c in LOG_SCHEMA.split(",")]
    w.log.withColumn(
        "ts", F.to_timestamp(F.date_add(F.to_date(F.lit("2024-01-01")), F.col("calendar_t")))
    ).select(*columns).write.parquet(f"{base}/decisions")
    source = w.spark.readStream.schema(LOG_SCHEMA).parquet(f"{base}/decisions")
    running = RunningStatistics(w.spark, f"{base}/state", w.config.update)
    running.start(source).awaitTermination()
    return _running_totals(running.sums)


def _running_totals(sums: DataFrame) -> DataFrame:
    return sums.select(
        "study_id", "policy_num", "n", F.col("u_xx_0_1").alias("sum_action"),
        six("u_rx_0").alias("sum_reward"), six("u_rx_1").alias("sum_product"),
    )


@entry(
    "streamed_late_statistics",
    """SELECT study_id, policy_num, CAST(count(*) AS BIGINT) AS n, CAST(sum(action) AS DOUBLE) AS sum_action,
              [[sum(reward)]] AS sum_reward, [[sum(reward * action)]] AS sum_product,
              CAST(sum(CASE WHEN calendar_t % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_late
       FROM glog WHERE active = 1 GROUP BY 1, 2""",
)
def _(w):
    """Every third time comes after all others, and all rows come twice: all count once."""
    base = _stream_folder(w, "late")
    columns = [c.split()[0] for c in LOG_SCHEMA.split(",")]
    log = w.log.withColumn("ts", F.lit(None).cast("timestamp")).select(*columns)
    running = RunningStatistics(w.spark, f"{base}/state", w.config.update)
    for late in (False, True):
        part = log.filter(((F.col("calendar_t") % 3) == 0) == F.lit(late)).select(*columns)
        part.write.mode("append").parquet(f"{base}/decisions")
        part.write.mode("append").parquet(f"{base}/decisions")
        source = w.spark.readStream.schema(LOG_SCHEMA).parquet(f"{base}/decisions")
        running.start(source).awaitTermination()
    late = running.late.withColumnRenamed("n", "n_late")
    return _running_totals(running.sums).join(late, ["study_id", "policy_num"], "left").fillna(0, ["n_late"])


@entry("streamed_repeated_decisions", "SELECT study_id, count(*) AS n, sum(active) AS active, [[sum(coalesce(reward, 0))]] AS reward FROM glog GROUP BY 1")
def _(w):
    """All decisions come twice, the second time after a notice: each counts once."""
    base = _stream_folder(w, "repeated")
    columns = [c.split()[0] for c in LOG_SCHEMA.split(",")]
    log = w.log.withColumn("ts", F.lit(None).cast("timestamp")).select(*columns)
    monitor = StreamingMonitor(w.spark, f"{base}/state", w.config, LOG_SCHEMA)
    for again in (False, True):
        log.write.mode("append").parquet(f"{base}/decisions")
        monitor.start_decisions(w.spark.readStream.schema(LOG_SCHEMA).parquet(f"{base}/decisions")).awaitTermination()
        if not again:
            w.params.select("study_id", "policy_num", "beta").filter("policy_num = 1").write.parquet(f"{base}/notices")
            notices = w.spark.readStream.schema(POLICY_PARAMS_SCHEMA).parquet(f"{base}/notices")
            monitor.start_notices(notices).awaitTermination()
    taken = monitor.decisions.unionByName(monitor.late)
    return rounded(taken.groupBy("study_id").agg(
        F.count("*").alias("n"), F.sum("active").alias("active"), F.sum(F.coalesce("reward", F.lit(0.0))).alias("reward")), "reward")


@entry("notice_without_decisions", "SELECT study_id, policy_num, 'no_decisions' AS reason FROM beta")
def _(w):
    """Notices that come before any decision of their study."""
    base = _stream_folder(w, "early")
    monitor = StreamingMonitor(w.spark, f"{base}/state", w.config, LOG_SCHEMA)
    w.params.select("study_id", "policy_num", "beta").write.parquet(f"{base}/notices")
    notices = w.spark.readStream.schema(POLICY_PARAMS_SCHEMA).parquet(f"{base}/notices")
    monitor.start_notices(notices).awaitTermination()
    return monitor.unjudged
