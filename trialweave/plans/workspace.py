"""The event study over one data folder, built once and shared by the registered queries."""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.operators import rows
from trialweave.plans import studies
from trialweave.plans.analysis import Analysis
from trialweave.session import written


class Workspace:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.config = studies.EVENTS_CONFIG

    @cached_property
    def analysis(self) -> Analysis:
        """The analysis over the written log, so that single queries do not rebuild it."""
        a = studies.events_analysis(self.spark, self.sf_dir)
        return replace(a, log=written(a.log, "log", by="active"))

    @property
    def log(self) -> DataFrame:
        return self.analysis.log

    @property
    def params(self) -> DataFrame:
        return self.analysis.policy_params

    @property
    def frame(self) -> DataFrame:
        return self.analysis.frame

    @property
    def decided(self) -> DataFrame:
        return self.analysis.decided

    @cached_property
    def inputs(self) -> DataFrame:
        return rows.policy_inputs(self.log, self.params, self.config.policy)

    @cached_property
    def update_rows(self) -> DataFrame:
        return rows.update_rows(self.log, self.analysis._calendar, self.config.update)

    @cached_property
    def stack(self) -> DataFrame:
        return written(self.analysis.stack, "stack")


_spaces: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _spaces:
        _spaces[key] = Workspace(spark, sf_dir)
    return _spaces[key]


def forget() -> None:
    """Drop all shared tables, so that the next query starts from the raw files."""
    _spaces.clear()


def six(value: Column | str) -> Column:
    """Six digits, with a small shift so that exact ties do not depend on the order of a sum."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column + F.lit(1.234e-8), 6) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, six(c))
    return df
