"""Readers and schemas of the input tables, and flattening of nested argument tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.config import LogColumns

# Input table layouts; {id} is the type of subject ids.
INPUTS = "struct<beta:array<double>, lower:double, steepness:double, upper:double, treat_state:array<double>>"
POLICY_INPUTS_SCHEMA = f"study_id string, subject_id {{id}}, calendar_t int, policy_num int, inputs {INPUTS}"
NESTED_INPUTS_SCHEMA = f"study_id string, calendar_t int, subjects map<{{id}}, {INPUTS}>"
UPDATE_ROWS_SCHEMA = """
    study_id string, policy_num int, subject_id {id}, calendar_t int, base_state array<double>,
    treat_state array<double>, action double, reward double, action_prob double
"""
NESTED_ROWS_SCHEMA = """
    study_id string, policy_num int, subjects map<{id}, struct<base_states:array<array<double>>,
        treat_states:array<array<double>>, actions:array<double>, rewards:array<double>,
        action_probs:array<double>, times:array<int>>>
"""
POLICY_PARAMS_SCHEMA = "study_id string, policy_num int, beta array<double>"


def read_decision_log(
    spark: SparkSession, path: str, columns: LogColumns | None = None, format: str = "parquet"
) -> DataFrame:
    """Decision log with its columns mapped to their roles; unmapped columns are never read."""
    options = {"header": "true", "inferSchema": "true"} if format == "csv" else {}
    raw = spark.read.format(format).options(**options).load(path)
    return (columns or LogColumns()).standardise(raw)


def read_policy_inputs(
    spark: SparkSession, path: str, subject_type: str = "long", nested: bool = False
) -> DataFrame:
    """Arguments of the probability function, one row per subject and time.

    ``subject_type`` is the type of subject ids, ``long`` or ``string``. With ``nested`` the files
    hold maps from subject to arguments, any number of them per study and time.
    """
    schema = NESTED_INPUTS_SCHEMA if nested else POLICY_INPUTS_SCHEMA
    table = spark.read.schema(schema.format(id=subject_type)).parquet(path)
    return flatten_policy_inputs(table) if nested else table


def read_update_rows(
    spark: SparkSession, path: str, subject_type: str = "long", nested: bool = False
) -> DataFrame:
    """Data of every update in long form; ``subject_type`` and ``nested`` as for the inputs."""
    schema = NESTED_ROWS_SCHEMA if nested else UPDATE_ROWS_SCHEMA
    table = spark.read.schema(schema.format(id=subject_type)).parquet(path)
    return flatten_update_rows(table) if nested else table


def read_policy_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POLICY_PARAMS_SCHEMA).parquet(path)


def flatten_policy_inputs(nested: DataFrame) -> DataFrame:
    """(study_id, calendar_t, subjects map<subject, struct>) to one row per subject and time.

    A map value that is null stays as a blank input.
    """
    return nested.select(
        "study_id", "calendar_t", F.explode("subjects").alias("subject_id", "inputs")
    )


def flatten_update_rows(nested: DataFrame) -> DataFrame:
    """Update arguments with 2-D states and column vectors to one row per time.

    ``args`` holds parallel arrays: base_states, treat_states, actions, rewards, action_probs,
    times. Subjects without data have a null struct and give no rows.
    """
    zipped = F.arrays_zip(
        *[
            F.col(f"args.{c}").alias(c)
            for c in ("base_states", "treat_states", "actions", "rewards", "action_probs", "times")
        ]
    )
    return (
        nested.select("study_id", "policy_num", F.explode("subjects").alias("subject_id", "args"))
        .filter("args is not null")
        .select("study_id", "policy_num", "subject_id", F.explode(zipped).alias("z"))
        .select(
            "study_id", "policy_num", "subject_id", F.col("z.times").cast("int").alias("calendar_t"),
            F.col("z.base_states").alias("base_state"), F.col("z.treat_states").alias("treat_state"),
            F.col("z.actions").cast("double").alias("action"), F.col("z.rewards").alias("reward"),
            F.col("z.action_probs").alias("action_prob"),
        )
    )
