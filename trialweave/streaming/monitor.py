"""Monitor of policy updates on streams.

Two streams run side by side. Decisions are appended to a table as they arrive; rows that come
after an update they should have fed is closed are set aside and counted. Update notices
(study_id, policy_num, beta) are judged batch by batch: only the block rows of the noticed
updates are kept, beside the rows of earlier notices; a policy noticed again replaces its
parameters and its rows, and a notice for a study without decisions is kept with that reason. All state is in tables below one folder, written per batch, so a repeated
batch overwrites itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from trialweave.config import AnalysisConfig, LinearModel
from trialweave.functions.vectors import Gram
from trialweave.plans.monitor import DIAGONAL_LIMIT, WHOLE_LIMIT, UpdateAssessment, verdicts

CELLS_SCHEMA = "study_id string, row_block int, col_block int, r int, c int, value double, noticed long"
NOTICE_SCHEMA = "study_id string, policy_num int, beta array<double>"
CLOSED_SCHEMA = "study_id string, closed_t int"
UNJUDGED_SCHEMA = "study_id string, policy_num int, reason string"
#: Reason for a notice without a verdict.
NO_DECISIONS = "no_decisions"


def _table(
    spark: SparkSession, path: str, schema: str | StructType, before: int | None = None
) -> DataFrame:
    """All batches of a state table, or no rows before the first one.

    With ``before``, only earlier batches, so that a batch taken again does not meet itself.
    """
    try:
        table = spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    if before is not None:
        table = table.filter(F.col("batch") < before)
    want = spark.createDataFrame([], schema).schema
    return table.select(*[F.col(f.name).cast(f.dataType) for f in want])


def _append(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


@dataclass(frozen=True)
class StreamingMonitor:
    spark: SparkSession
    state: str
    config: AnalysisConfig
    log_schema: str | StructType
    whole_limit: float = WHOLE_LIMIT
    diagonal_limit: float = DIAGONAL_LIMIT

    @property
    def decisions(self) -> DataFrame:
        return _table(self.spark, f"{self.state}/decisions", self.log_schema)

    @property
    def late(self) -> DataFrame:
        return _table(self.spark, f"{self.state}/late", self.log_schema)

    @property
    def params(self) -> DataFrame:
        """The newest parameters of each policy."""
        told = _table(self.spark, f"{self.state}/params", f"{NOTICE_SCHEMA}, noticed long")
        return told.groupBy("study_id", "policy_num").agg(
            F.max(F.struct("noticed", "beta"))["beta"].alias("beta")
        )

    @property
    def cells(self) -> DataFrame:
        """Block rows of the bread inverse, each from its newest notice."""
        every = _table(self.spark, f"{self.state}/cells", CELLS_SCHEMA)
        newest = every.groupBy("study_id", "row_block").agg(F.max("noticed").alias("noticed"))
        return every.join(newest, ["study_id", "row_block", "noticed"], "left_semi").drop("noticed")

    @property
    def verdicts(self) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.state}/verdicts")

    @property
    def unjudged(self) -> DataFrame:
        """Notices that no verdict could be given for, with the reason."""
        return _table(self.spark, f"{self.state}/unjudged", UNJUDGED_SCHEMA)

    def _closed(self) -> DataFrame:
        """Per study the time up to which updates have used the data."""
        return (
            _table(self.spark, f"{self.state}/closed", CLOSED_SCHEMA)
            .groupBy("study_id").agg(F.max("closed_t").alias("closed_t"))
        )

    def take_decisions(self, batch: DataFrame, batch_id: int) -> None:
        """Append the decisions that are new; one delivered twice counts once.

        A repeated decision is told within its own study's times: only stored rows of the times that
        the batch covers are read.
        """
        keys = ["study_id", "subject_id", "calendar_t"]
        batch = batch.dropDuplicates(keys)
        lo, hi = batch.agg(F.min("calendar_t"), F.max("calendar_t")).first()
        for name in ("decisions", "late"):
            known = _table(self.spark, f"{self.state}/{name}", self.log_schema, batch_id)
            batch = batch.join(known.filter(F.col("calendar_t").between(lo, hi)).select(*keys), keys, "left_anti")
        joined = batch.join(self._closed(), "study_id", "left")
        is_late = F.coalesce(F.col("calendar_t") <= F.col("closed_t"), F.lit(False))
        joined = joined.withColumn("is_late", is_late).persist()
        _append(joined.filter("not is_late").select(*batch.columns), f"{self.state}/decisions", batch_id)
        _append(joined.filter("is_late").select(*batch.columns), f"{self.state}/late", batch_id)
        joined.unpersist()

    def judge_notices(self, batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        noticed = batch.select("study_id").distinct()
        told = batch.select("study_id", "policy_num", "beta").withColumn("noticed", F.lit(batch_id).cast("long"))
        _append(told, f"{self.state}/params", batch_id)
        asked = batch.select("study_id", "policy_num").distinct()
        log = self.decisions.join(noticed, "study_id", "left_semi")
        params = self.params.join(noticed, "study_id", "left_semi")
        nothing = asked.join(log.select("study_id").distinct(), "study_id", "left_anti")
        _append(nothing.withColumn("reason", F.lit(NO_DECISIONS)), f"{self.state}/unjudged", batch_id)
        assessment = UpdateAssessment(log, params, self.config, asked)
        index = assessment.frame.select(
            "study_id", F.posexplode("policy_nums").alias("policy_idx", "policy_num")
        )
        updates = asked.join(index, ["study_id", "policy_num"])
        cells = assessment.cells(updates).withColumn("noticed", F.lit(batch_id).cast("long"))
        _append(cells.select(*[c.split()[0] for c in CELLS_SCHEMA.split(", ")]), f"{self.state}/cells", batch_id)
        judged = verdicts(
            self.cells.join(noticed, "study_id", "left_semi"), updates, self.config.update.dim,
            self.whole_limit, self.diagonal_limit,
        ).join(index, ["study_id", "policy_idx"])
        _append(judged, f"{self.state}/verdicts", batch_id)
        closed = assessment.frame.select("study_id", F.col("t_max").alias("closed_t"))
        _append(closed, f"{self.state}/closed", batch_id)

    def start_decisions(self, source: DataFrame, **trigger) -> StreamingQuery:
        return (
            source.writeStream.foreachBatch(self.take_decisions)
            .option("checkpointLocation", f"{self.state}/checkpoints/decisions")
            .trigger(**(trigger or {"availableNow": True})).start()
        )

    def start_notices(self, source: DataFrame, **trigger) -> StreamingQuery:
        return (
            source.writeStream.foreachBatch(self.judge_notices)
            .option("checkpointLocation", f"{self.state}/checkpoints/notices")
            .trigger(**(trigger or {"availableNow": True})).start()
        )


#: Study slots of the keys seen; a batch of few studies reads few of them.
SLOTS = 16
PLACE_SCHEMA = "slot int, span int, version long"


@dataclass(frozen=True)
class RunningStatistics:
    """Gram sums per (study, policy) while decisions arrive, for as long as they arrive.

    Every distinct (study, subject, time) counts once, whenever it comes: repeated deliveries are
    told by the keys seen so far, not by a watermark. Rows whose time is more than ``delay`` steps
    before the newest seen in earlier batches are counted in the sums like all others, and in
    ``late`` as well.

    The keys are kept by (slot of the study, span of times). A batch reads the spans it has rows in
    and writes each of them anew as one version, so that what it reads does not grow with the
    batches before it: its own spans, the list of the newest versions, and the totals that the last
    batch left, one row per (study, policy). A batch that is taken again overwrites what it wrote.
    """

    spark: SparkSession
    state: str
    model: LinearModel
    delay: int = 0
    span: int = 16

    @property
    def gram(self) -> Gram:
        return Gram("u", self.model.dim)

    @property
    def _totals_schema(self) -> str:
        added = ", ".join(f"{c} double" for c in self.gram.columns)
        return f"study_id string, policy_num int, {added}, n long, n_late long, newest int"

    def _left(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        """What the last batch left in a table that every batch writes whole."""
        folder = f"{self.state}/{name}"
        if before is not None:
            try:
                return self.spark.read.schema(schema).parquet(f"{folder}/batch={before - 1}")
            except AnalysisException:
                pass  # the first batch, or the batch before it was left out
        try:
            table = self.spark.read.schema(f"{schema}, batch long").parquet(folder)
        except AnalysisException:
            return self.spark.createDataFrame([], schema)
        table = table if before is None else table.filter(F.col("batch") < before)
        last = table.agg(F.max("batch")).first()[0]
        return table.filter(F.col("batch") == F.lit(last)).drop("batch")

    @property
    def sums(self) -> DataFrame:
        """Totals of all batches."""
        return self._left("totals", self._totals_schema).drop("n_late", "newest")

    @property
    def late(self) -> DataFrame:
        """(study_id, policy_num, n): decisions that came late."""
        return self._left("totals", self._totals_schema).filter("n_late > 0").select(
            "study_id", "policy_num", F.col("n_late").alias("n"))

    def _seen(self, places: DataFrame, touched: list, schema: StructType) -> DataFrame:
        """Keys of the touched spans, each in its newest version."""
        versions = {(r["slot"], r["span"]): r["version"] for r in places.collect()}
        paths = [f"{self.state}/seen/batch={versions[t]}/slot={t[0]}/span={t[1]}" for t in touched if t in versions]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def take(self, batch: DataFrame, batch_id: int) -> None:
        keys = ["study_id", "subject_id", "calendar_t"]
        rows = batch.filter("active = 1").dropDuplicates(keys).withColumns({
            "slot": F.pmod(F.xxhash64("study_id"), F.lit(SLOTS)).cast("int"),
            "span": F.floor(F.col("calendar_t") / self.span).cast("int")})
        # A few numbers: times of the batch over the span, for each slot.
        touched = [tuple(r) for r in rows.select("slot", "span").distinct().collect()]
        places = self._left("places", PLACE_SCHEMA, batch_id)
        asked = self.spark.createDataFrame(touched, "slot int, span int")
        seen = self._seen(places.join(asked, ["slot", "span"], "left_semi"), touched, batch.select(*keys).schema)
        fresh = rows.join(seen, keys, "left_anti").persist()

        before = self._left("totals", self._totals_schema, batch_id)
        mark = before.groupBy("study_id").agg(F.max("newest").alias("mark"))
        behind = F.coalesce(F.col("calendar_t") < F.col("mark") - self.delay, F.lit(False))
        new = fresh.join(mark, "study_id", "left").groupBy("study_id", "policy_num").agg(
            *self.gram.sums(self.model.features("action_prob")), F.count("*").alias("n"),
            F.count_if(behind).alias("n_late"), F.max("calendar_t").alias("newest"))
        both = before.unionByName(new.select(*before.columns)).groupBy("study_id", "policy_num").agg(
            *[F.sum(c).alias(c) for c in (*self.gram.columns, "n", "n_late")], F.max("newest").alias("newest"))
        _append(both, f"{self.state}/totals", batch_id)

        old = seen.withColumns({"slot": F.pmod(F.xxhash64("study_id"), F.lit(SLOTS)).cast("int"),
                                "span": F.floor(F.col("calendar_t") / self.span).cast("int")})
        (fresh.select(*keys, "slot", "span").unionByName(old).write.mode("overwrite").partitionBy("slot", "span")
         .parquet(f"{self.state}/seen/batch={batch_id}"))
        newest = asked.withColumn("version", F.lit(batch_id).cast("long"))
        _append(places.join(asked, ["slot", "span"], "left_anti").unionByName(newest), f"{self.state}/places", batch_id)
        fresh.unpersist()

    def start(self, source: DataFrame, **trigger) -> StreamingQuery:
        return (
            source.writeStream.foreachBatch(self.take)
            .option("checkpointLocation", f"{self.state}/checkpoints/statistics")
            .trigger(**(trigger or {"availableNow": True})).start()
        )
