"""Analysis with estimating functions or losses supplied by the user.

A function sees the rows of one subject and a parameter vector. Its derivative in the parameter
and in the probabilities is taken by central differences where the rows are; everything after
that (scores, products, corrections, sandwiches, checks) is the same as for the built-in models.

Rows are sent once, in buckets of a bounded number of rows, and a bucket evaluates all blocks that
its subjects have data for. A subject is whole in its bucket, unless both functions are declared
``additive``, that is plain sums over rows: then a subject of very many rows is spread over buckets
and its parts are added up.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.config import AnalysisConfig
from trialweave.functions.matrix import inverse
from trialweave.functions.vectors import plus
from trialweave.operators import bread as bread_ops
from trialweave.operators import checks as check_ops
from trialweave.operators import sandwich as sandwich_ops
from trialweave.operators import stack as stack_ops
from trialweave.operators.decisions import gradient
from trialweave.plans.analysis import Analysis
from trialweave.session import written


@dataclass(frozen=True)
class UserFunction:
    """``function(param, rows)`` with columns, action, reward and ``action_prob`` in ``rows``.

    ``kind="estimating"`` returns a vector, ``kind="loss"`` a number whose gradient is taken.
    ``additive`` says that the value of some rows is the sum of the values of their parts.
    """

    function: Callable[[np.ndarray, pd.DataFrame], np.ndarray | float]
    columns: tuple[str, ...]
    dim: int
    kind: str = "estimating"
    step: float = 1e-4
    additive: bool = False

    def __post_init__(self) -> None:
        if self.kind not in ("estimating", "loss"):
            raise ValueError(f"unknown kind {self.kind!r}")

    def value(self, param: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
        if self.kind == "estimating":
            return np.asarray(self.function(param, rows), dtype=float)
        return central(lambda p: self.function(p, rows), param, self.step).ravel()

    def slope(self, param: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
        return central(lambda p: self.value(p, rows), param, self.step)


def central(f: Callable, at: np.ndarray, step: float) -> np.ndarray:
    """Derivative by central differences, one column per entry of ``at``."""
    columns = []
    for e in np.eye(len(at)) * step:
        columns.append((np.atleast_1d(f(at + e)) - np.atleast_1d(f(at - e))) / (2 * step))
    return np.array(columns).T


PIECES = "study_id string, subject_id {0}, block int, piece string, col_block int, m array<double>"
#: Rows of a bucket, a second or so of calls, and steps of time that stay together where a subject may be split.
BUCKET_ROWS = 4_000
TOGETHER = 64
#: Tasks that the buckets are dealt to at most; a task then has several.
MOST_TASKS = 10_000


def by_subject(pdf: pd.DataFrame):
    """(subject, rows, gradients) of every subject of a bucket, by time; rows without a subject are left out."""
    pdf = pdf.sort_values("calendar_t")
    codes, subjects = pd.factorize(pdf["subject_id"])
    order = np.argsort(codes, kind="stable")
    cuts = np.searchsorted(codes[order], np.arange(len(subjects) + 1))
    pdf = pdf.take(order)
    grads = np.array(pdf["pi_grad"].tolist(), dtype=float)
    for subject, start, end in zip(subjects, cuts[:-1], cuts[1:]):
        yield subject, pdf.iloc[start:end].reset_index(drop=True), grads[start:end]


def probability_slope(rows: pd.DataFrame, grad: np.ndarray, param: np.ndarray, fn: UserFunction, phi: np.ndarray) -> np.ndarray:
    """Derivative through the probabilities, one column per entry of beta; ``phi`` is the value without a move.

    ``action_prob`` of ``rows`` is overwritten. An entry that moves no probability needs no calls.
    """
    pi, place = rows["action_prob"].to_numpy().copy(), rows.columns.get_loc("action_prob")

    def moved(d: np.ndarray) -> np.ndarray:
        rows.isetitem(place, pi + grad @ d)
        return fn.value(param, rows)

    finite = np.isfinite(grad).all()
    columns = []
    for e in np.eye(grad.shape[1]) * fn.step:
        still = finite and not (grad @ e).any()
        up, down = (phi, phi) if still else (moved(e), moved(-e))
        columns.append((np.atleast_1d(up) - np.atleast_1d(down)) / (2 * fn.step))
    return np.array(columns).T


def subject_pieces(rows: pd.DataFrame, grads: np.ndarray, params: list[np.ndarray], fn: UserFunction, blocks: range,
                   slopes: bool):
    """(block, piece, col_block, value) of one subject for each block from its first data on."""
    seg, policies = rows["seg"].to_numpy(), rows["policy_idx"].to_numpy()
    for block in blocks:
        last = block == len(params) - 1
        fed = np.ones(len(rows), bool) if last else seg <= block
        n = int(fed.sum())
        if not n:
            continue
        # Rows are by time and so by segment.
        data = rows.iloc[:n] if fed[:n].all() else rows[fed].reset_index(drop=True)
        param, policy, grad = params[block], policies[fed], grads[fed]
        own, phi = fn.slope(param, data), fn.value(param, data)
        yield block, "phi", -1, phi
        yield block, "own", block, own
        if slopes and last:
            yield block, "slope", block, own
        used = np.unique(policy[(policy >= 0) & (policy < block)])
        # A plain copy for the moved probabilities: the rows themselves stay as they are.
        copy, pi = data.copy(), data["action_prob"].to_numpy()
        for j in used:
            copy["action_prob"] = pi
            yield block, "prob", int(j), probability_slope(copy, np.where((policy == j)[:, None], grad, 0.0), param, fn, phi)


@dataclass(frozen=True)
class FunctionAnalysis:
    """``theta`` has one row per study, (study_id, theta), or is a function of the log that gives it."""

    log: DataFrame
    params: DataFrame
    config: AnalysisConfig
    update: UserFunction
    inference: UserFunction
    theta: DataFrame | Callable[[DataFrame], DataFrame]

    @cached_property
    def _base(self) -> Analysis:
        return Analysis(self.log, self.config, self.params)

    @cached_property
    def _plain_frame(self) -> DataFrame:
        theta = self.theta(self.log) if callable(self.theta) else self.theta
        return written(self._base._beta_frame.join(theta, "study_id"), "function_frame")

    @cached_property
    def frame(self) -> DataFrame:
        """The study frame with theta and the mean derivative of its estimating function."""
        q = self.inference.dim
        own = (
            self.summed.filter("piece = 'own'").join(self._plain_frame.select("study_id", "n_updates"), "study_id")
            .filter("block = n_updates").groupBy("study_id")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("cells"))
            .select("study_id", F.transform("cells", lambda c: c["value"]).alias("bread_inverse"))
            .filter(F.size("bread_inverse") == q * q)
        )
        return written(self._plain_frame.join(own, "study_id", "left").withColumn("bread", inverse("bread_inverse")),
                       "function_study")

    @cached_property
    def decided(self) -> DataFrame:
        entries = self.config.policy.gradients()
        return self._base.decided.withColumn("pi_grad", gradient(self.config, entries)).withColumn(
            "action_prob", F.col("pi")
        )

    @cached_property
    def pieces(self) -> DataFrame:
        """phi of every subject, and the bucket's sums of the slopes in the parameters and probabilities."""
        update, inference = self.update, self.inference
        slopes = self.config.correction in ("HC2theta", "HC3theta")
        columns = dict.fromkeys(["study_id", "subject_id", "calendar_t", "policy_idx", "seg", "action", "reward",
                                 "action_prob", "pi_grad", *update.columns, *inference.columns])
        rows = self.decided.select(*columns)
        buckets = F.ceil(F.count(F.lit(1)) / F.lit(BUCKET_ROWS)).alias("buckets")
        studies = written(rows.groupBy("study_id").agg(buckets).join(
            self._plain_frame.select("study_id", "betas", "theta"), "study_id"), "function_studies")
        split = update.additive and inference.additive
        key = ["subject_id", F.expr(f"calendar_t div {TOGETHER}")] if split else ["subject_id"]
        left = rows.join(studies.select("study_id", "buckets"), "study_id").withColumn(
            "bucket", F.pmod(F.xxhash64(*key), "buckets")).drop("buckets")
        right = studies.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)))

        def work(pdf: pd.DataFrame, study: pd.DataFrame) -> pd.DataFrame:
            names = ["study_id", "subject_id", "block", "piece", "col_block", "m"]
            if not len(pdf) or not len(study):
                return pd.DataFrame(columns=names)
            name, K = study["study_id"].iloc[0], len(study["betas"].iloc[0])
            params = [np.asarray(p, dtype=float) for p in (*study["betas"].iloc[0], study["theta"].iloc[0])]
            out, sums = [], {}
            for subject, own, grads in by_subject(pdf):
                for fn, blocks in ((update, range(K)), (inference, range(K, K + 1))):
                    for block, piece, j, m in subject_pieces(own, grads, params, fn, blocks, slopes):
                        if piece in ("phi", "slope"):
                            out.append((name, subject, block, piece, j, np.ravel(m)))
                        else:
                            sums[block, piece, j] = sums.get((block, piece, j), 0.0) + np.ravel(m)
            out += [(name, None, block, piece, j, m) for (block, piece, j), m in sums.items()]
            return pd.DataFrame(out, columns=names)

        # The work is in the calls, not in the bytes: as many tasks as buckets, which no merging by size undoes.
        tasks = max(int(studies.agg(F.sum("buckets")).first()[0] or 1), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        left = left.repartition(min(tasks, MOST_TASKS), "study_id", "bucket")
        made = left.groupBy("study_id", "bucket").cogroup(right.groupBy("study_id", "bucket")).applyInPandas(
            work, PIECES.format(dict(rows.dtypes)["subject_id"]))
        return written(made, "function_pieces")

    @cached_property
    def summed(self) -> DataFrame:
        """Mean slopes: study_id, block, piece, col_block, pos, value."""
        return (
            self.pieces.filter("piece in ('own', 'prob')")
            .select("study_id", "block", "piece", "col_block", F.posexplode("m").alias("pos", "x"))
            .groupBy("study_id", "block", "piece", "col_block", "pos").agg(F.sum("x").alias("x"))
            .join(self._plain_frame.select("study_id", "n_subjects"), "study_id")
            .selectExpr("study_id", "block", "piece", "col_block", "pos", "x / n_subjects AS value")
        )

    def _per_subject(self, piece: str, width: int) -> DataFrame:
        """Values of the subjects; parts of one subject are added up."""
        rows = self.pieces.filter(F.col("piece") == piece)
        if not (self.update.additive and self.inference.additive):
            return rows.select("study_id", "subject_id", "block", "m")
        added = rows.groupBy("study_id", "subject_id", "block").agg(
            *[F.sum(F.get("m", F.lit(i))).alias(f"m_{i}") for i in range(width)], F.max(F.size("m")).alias("width"))
        values = F.array(*[F.col(f"m_{i}") for i in range(width)])
        return added.select("study_id", "subject_id", "block", F.slice(values, F.lit(1), F.col("width")).alias("m"))

    @cached_property
    def stack(self) -> DataFrame:
        q = self.inference.dim
        scores = self.decided.filter("policy_idx >= 0").groupBy(
            "study_id", "subject_id", F.col("policy_idx").alias("block")
        ).agg(*[F.expr(f"sum{s} AS s_{e}") for e, s in enumerate(self.config.policy.scores())])
        names = [f"s_{e}" for e in range(self.config.policy.gradient_dim)]
        phi = self._per_subject("phi", max(q, self.update.dim)).join(
            self._plain_frame.select("study_id", "n_updates"), "study_id"
        ).selectExpr(
            "study_id", "subject_id", "'phi' AS kind", "block", "m AS v", "block = n_updates AS is_theta",
        )
        trace = plus([f"get(m, {r * q + c}) * get(bread, {c * q + r})" for r in range(q) for c in range(q)])
        leverage = self._per_subject("slope", q * q).join(self.frame.select("study_id", "bread"), "study_id").selectExpr(
            "study_id", "subject_id", "block", f"{trace} AS leverage")
        return phi.join(leverage, ["study_id", "subject_id", "block"], "left").select(
            "study_id", "subject_id", "kind", "block", "v", "is_theta", "leverage"
        ).unionByName(
            scores.selectExpr(
                "study_id", "subject_id", "'score' AS kind", "block",
                f"array({', '.join(names)}) AS v", "false AS is_theta", "CAST(NULL AS double) AS leverage",
            )
        )

    @cached_property
    def weighted_stack(self) -> DataFrame:
        return written(sandwich_ops.with_weights(self.stack, self.frame, self.config), "function_stack")

    @cached_property
    def products(self) -> DataFrame:
        return written(
            bread_ops.subject_products(self.weighted_stack, self.frame, self.config), "function_products"
        )

    @cached_property
    def bread_inverse(self) -> DataFrame:
        first = self.config.policy.gradient_start(self.config.update.dim)
        score = self.products.filter("piece = 'score'").withColumn("c", F.col("c") + F.lit(first))
        own_width = F.expr(f"IF(block = n_updates, {self.inference.dim}, {self.update.dim})")
        width = F.when(F.col("piece") == "prob", F.lit(self.config.update.dim)).otherwise(own_width)
        slopes = (
            self.summed.join(self.frame.select("study_id", "n_updates"), "study_id").withColumn("width", width)
            .selectExpr("study_id", "block AS row_block", "col_block", "CAST(pos / width AS int) AS r",
                        "pos % width AS c", "value")
        )
        return bread_ops.add_cells(slopes, score.select(*bread_ops.CELL))

    @cached_property
    def classical(self) -> DataFrame:
        meat = sandwich_ops.theta_meat(self.weighted_stack, self.frame, self.config)
        return sandwich_ops.classical_variance(meat, self.frame, self.config)

    @cached_property
    def stack_mean(self) -> DataFrame:
        return stack_ops.stack_mean(self.stack, self.frame)

    @cached_property
    def checks(self) -> DataFrame:
        """Findings of the checks of the built-in analysis, with the mean of this stack."""
        return self._base.findings(self.stack_mean)

    def checked(self) -> FunctionAnalysis:
        """The same analysis, once its checks have run, as ``Analysis.checked``."""
        self.config.advise()
        if not self.config.suppress_checks:
            check_ops.raise_on_errors(self.checks)
        return self

    @cached_property
    def result(self) -> DataFrame:
        """Theta and both variances per study, with a reason where the joint matrix cannot be used."""
        cells = sandwich_ops.joint_input(
            self.bread_inverse, bread_ops.meat_cells(self.products), self.frame
        )
        joint = sandwich_ops.adjusted_variance(cells, self.config)
        return (
            self.frame.select("study_id", "n_subjects", "n_updates", "theta")
            .join(joint.select("study_id", "adjusted_variance", "joint_condition", "reason"), "study_id", "left")
            .join(self.classical, "study_id", "left")
        )
