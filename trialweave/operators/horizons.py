"""Estimates as if the study had ended after each update, all ends in one plan.

Sums of a study are keyed by the horizon segment they fall in and copied to the ends at or after
it, a few rows per study. What is kept per subject is never copied: buckets of subjects carry their
sums from end to end. The log itself is read once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.config import AnalysisConfig
from trialweave.functions.matrix import inverse
from trialweave.operators import bread as bread_ops
from trialweave.operators import sandwich as sandwich_ops
from trialweave.operators import sums as sums_ops
from trialweave.operators.segments import SubjectSums, in_buckets, leverage_sums, product_rows, theta_values, vectors, weights
from trialweave.session import written


def _name(study: str = "study_id", idx: str = "policy_idx"):
    return F.concat_ws("#", F.col(study), F.col(idx).cast("string"))


def horizons(frame: DataFrame) -> DataFrame:
    """(study_id, end_idx, rank): the end after each update and its rank among distinct ends."""
    return frame.select(
        "study_id", F.posexplode("last_times").alias("end_idx", "end_t"), "horizon_times"
    ).select(
        "study_id", "end_idx", "end_t",
        (F.array_position("horizon_times", F.col("end_t")).cast("int") - 1).alias("rank"),
    )


def spread(keyed: DataFrame, frame: DataFrame) -> DataFrame:
    """Copy rows with a ``horizon`` segment to every end that includes them.

    Under end k only the policies up to k are learned and only the updates up to k exist.
    """
    ends = F.filter(
        F.transform(
            "last_times",
            lambda t, k: F.struct(
                k.alias("end_idx"),
                (F.array_position("horizon_times", t).cast("int") - 1).alias("rank"),
            ),
        ),
        lambda e: e["rank"] >= F.col("horizon"),
    )
    return (
        keyed.join(frame.select("study_id", "last_times", "horizon_times"), "study_id")
        .withColumn("end", F.explode(ends))
        .withColumn("end_idx", F.col("end.end_idx"))
        .withColumn("study_id", _name(idx="end_idx"))
        .withColumn(
            "policy_idx",
            F.when(F.col("policy_idx") <= F.col("end_idx"), F.col("policy_idx")).otherwise(-1),
        )
        .withColumn("seg", F.least("seg", F.col("end_idx") + 1))
        .drop("end", "last_times", "horizon_times")
    )


def horizon_frame(sums: DataFrame, frame: DataFrame, config: AnalysisConfig) -> DataFrame:
    theta = sums_ops.estimate_theta(sums, config)
    short = (
        frame.select("study_id", "n_subjects", "betas", "n_users", F.posexplode("policy_nums").alias("end_idx", "p"))
        .withColumn("parent", F.col("study_id"))
        .withColumn("study_id", _name(idx="end_idx"))
        .withColumn("n_updates", F.col("end_idx") + 1)
        .withColumn("betas", F.slice("betas", F.lit(1), F.col("n_updates")))
    )
    return (
        short.join(theta, "study_id")
        .withColumn("bread_inverse", F.transform("xx", lambda v: v * 2.0 / F.col("n_subjects")))
        .withColumn("bread", inverse("bread_inverse"))
        .drop("xx", "p")
    )


def end_rows(sums: SubjectSums, ranks: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(end, rows that are new at it) in the order of the ends' times; ``ranks`` gives each end's place."""
    order = sorted(range(len(ranks)), key=lambda e: ranks[e])
    return zip(order, sums.by(sums.horizon, [ranks[e] for e in order]))


def end_values(sums: SubjectSums, study: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per end: theta's estimating functions, the subjects' derivatives, and the scores so far."""
    thetas, K = vectors(study["thetas"], sums.q), len(study["ranks"])
    xx, rx = np.zeros((sums.n, sums.q, sums.q)), np.zeros((sums.n, sums.q))
    scores = np.zeros((sums.n, K, sums.g))
    for e, new in end_rows(sums, study["ranks"]):
        more_xx, more_rx = sums.theta_sums(new)
        xx, rx, scores = xx + more_xx, rx + more_rx, scores + sums.scores(K, new)[0]
        yield e, theta_values(xx, rx, thetas[e]), xx, scores


def theta_row_products(ridge: float):
    """Theta's estimating functions of every end times the scores up to it.

    The rows of the updates are those of the whole study, except where a subject still decides
    under an early policy after the end; what those decisions add is given as ``late``, to be
    taken away again.
    """
    def run(sums: SubjectSums, study: dict) -> pa.Table:
        betas, K = vectors(study["betas"], sums.b), len(study["ranks"])
        phis = [phi for phi, _ in sums.updates(betas, study["n_users"] or [None] * K, ridge)]
        whole = sums.scores(K)[0]
        ends, rows = [], []
        for e, psi, _, scores in end_values(sums, study):
            made = [("score", e + 1, j, psi.T @ scores[:, j]) for j in range(e + 1) if scores[:, j].any()]
            late = whole[:, :e + 1] - scores[:, :e + 1]
            for j in np.flatnonzero(np.abs(late).max(axis=(0, 2)) > 0):
                made += [("late", k, int(j), phis[k].T @ late[:, j]) for k in range(j + 1, e + 1)]
            ends += [e] * len(made)
            rows += made
        return product_rows(study["study_id"], rows).append_column("end_idx", pa.array(ends, pa.int32()))
    return run


INFLUENCE = "study_id string, end_idx int, influence array<double>, joint_condition double"


def influences(b: int, q: int):
    """Theta's rows of the joint bread of every end, from the update part that all ends share.

    The group is one study's matrix; its size depends on the parameters, not on the data.
    """
    def run(cells: pd.DataFrame) -> pd.DataFrame:
        K = int(cells["n_updates"].iloc[0])
        whole = np.zeros((K * b, K * b))
        shared = cells[cells["piece"] == "updates"]
        whole[shared["row_block"] * b + shared["r"], shared["col_block"] * b + shared["c"]] = shared["value"]
        out = []
        for e, own in cells[cells["piece"] != "updates"].groupby("end_idx"):
            side = (int(e) + 1) * b
            m = np.zeros((side + q, side + q))
            m[:side, :side] = whole[:side, :side]
            late = own[own["piece"] == "late"]
            np.subtract.at(m, (late["row_block"] * b + late["r"], late["col_block"] * b + late["c"]), late["value"])
            last = own[own["piece"] == "theta"]
            np.add.at(m, (side + last["r"], last["col_block"] * b + last["c"]), last["value"])
            try:
                rows = np.linalg.solve(m.T, np.eye(side + q)[:, side:]).T
                out.append((cells["study_id"].iloc[0], int(e), rows.ravel(), np.linalg.cond(m)))
            except np.linalg.LinAlgError:
                continue
        return pd.DataFrame(out, columns=["study_id", "end_idx", "influence", "joint_condition"])
    return run


END_MEAT = "study_id string, end_idx int, influenced array<double>, plain array<double>"


def end_products(ridge: float, correction: str):
    """Sums over a bucket of the outer products of the subjects' influence on theta, for every end."""
    def run(sums: SubjectSums, study: dict) -> pa.Table:
        betas, K, n = vectors(study["betas"], sums.b), len(study["ranks"]), study["n_subjects"]
        users = study["n_users"] or [None] * K
        phis = np.concatenate([np.zeros((sums.n, 0)), *[phi for phi, _ in sums.updates(betas, users, ridge)]], axis=1)
        breads = vectors(study["breads"], sums.q ** 2)
        influenced, plain, ends = [], [], []
        for e, psi, xx, _ in end_values(sums, study):
            weight = weights(correction, leverage_sums(xx, breads[e].reshape(sums.q, sums.q)) / n, n, sums.q)[:, None]
            ends.append(e)
            plain.append(((psi * weight).T @ psi).ravel())
            if (rows := study["influences"][e]) is None:
                influenced.append(None)
                continue
            side = (e + 1) * sums.b
            rows = np.reshape(rows, (sums.q, side + sums.q))
            own = phis[:, :side] @ rows[:, :side].T + psi @ rows[:, side:].T
            influenced.append(((own * weight).T @ own).ravel())
        kind = pa.list_(pa.float64())
        return pa.table({"study_id": pa.array([study["study_id"]] * len(ends), pa.string()), "end_idx": pa.array(ends, pa.int32()),
                         "influenced": pa.array(influenced, kind), "plain": pa.array(plain, kind)})
    return run


def by_end(ends: DataFrame, *columns: str) -> DataFrame:
    """Columns of the ends as arrays per study, in the order of the ends."""
    listed = ends.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("end_idx", *columns))).alias("ends"))
    return listed.select(F.col("parent").alias("study_id"),
                         *[F.transform("ends", lambda e: e[c]).alias(f"{c}s") for c in columns])


def premature_estimates(
    digest: DataFrame, sums: DataFrame, frame: DataFrame, config: AnalysisConfig, products: DataFrame | None = None
) -> DataFrame:
    """Theta and both variances per (study, end).

    The update blocks of an end are those of the whole study, so only theta's row, column and own
    block are formed anew, and the digest is read twice as it is. ``products`` are those of the
    whole study, where the caller has them. An end whose matrix cannot be solved has no adjusted
    variance.
    """
    b, q, ridge = config.update.dim, config.inference.dim, config.update.ridge
    digest = written(digest, "end_digest")
    end_sums = written(spread(sums, frame), "end_sums")
    ends = written(horizon_frame(end_sums, frame, config), "end_frame")
    ranks = F.transform("last_times", lambda t: F.array_position("horizon_times", t).cast("int") - 1)
    studies = written(
        frame.select("study_id", "n_subjects", "n_updates", "betas", "n_users", ranks.alias("ranks"))
        .join(by_end(ends.select("parent", "end_idx", "theta", "bread"), "theta", "bread"), "study_id"), "end_studies")

    first = config.policy.gradient_start(b)
    shared = bread_ops.digest_products(digest, frame, config, meat=False) if products is None else products
    names = ends.select("study_id", "parent", "end_idx")
    partial = in_buckets(digest, studies, config, theta_row_products(ridge), f"{bread_ops.PRODUCT_SCHEMA}, end_idx int")
    rows = bread_ops.summed_products(partial, frame, "end_idx").withColumn("c", (F.col("c") + first).cast("int"))
    null = F.lit(None).cast("int")
    cell = ["study_id", "end_idx", "piece", "row_block", "col_block", "r", "c", "value"]
    updates = bread_ops.update_level_cells(sums, frame, config).unionByName(
        shared.filter("piece = 'score'").withColumn("c", (F.col("c") + first).cast("int")).select(*bread_ops.CELL))
    updates = (bread_ops.add_cells(updates).join(frame.select("study_id", "n_updates"), "study_id").filter("row_block < n_updates")
               .withColumns({"end_idx": null, "piece": F.lit("updates")}).select(*cell))
    theta = (bread_ops.theta_level_cells(end_sums, ends, config).join(names, "study_id")
             .drop("study_id").withColumnRenamed("parent", "study_id").withColumn("piece", F.lit("theta"))
             # The own block stands behind the updates.
             .select(*cell))
    rows = rows.withColumn("piece", F.when(F.col("piece") == "score", "theta").otherwise(F.col("piece"))).select(*cell)
    cells = updates.unionByName(theta).unionByName(rows).join(frame.select("study_id", "n_updates"), "study_id")
    solved = written(cells.groupBy("study_id").applyInPandas(influences(b, q), INFLUENCE), "end_influences")

    told = names.join(solved.withColumnRenamed("study_id", "parent"), ["parent", "end_idx"], "left")
    second = studies.join(by_end(told, "influence"), "study_id").select(
        "study_id", "n_subjects", "n_updates", "betas", "n_users", "ranks", "thetas", "breads", "influences")
    partial = in_buckets(digest, second, config, end_products(ridge, config.correction), END_MEAT)
    added = partial.groupBy("study_id", "end_idx").agg(*[
        F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(q * q)]).alias(c) for c in ("influenced", "plain")])
    scaled = lambda c, by: F.transform(c, lambda v: v / by)
    meats = written(
        added.withColumnRenamed("study_id", "parent").join(ends.select("parent", "end_idx", "study_id", "n_subjects"), ["parent", "end_idx"])
        .select("study_id", scaled("plain", F.col("n_subjects")).alias("meat"),
                F.when(F.get("influenced", F.lit(0)).isNotNull(), scaled("influenced", F.col("n_subjects") * F.col("n_subjects")))
                .alias("adjusted_variance")), "end_meats")
    classical = sandwich_ops.classical_variance(meats.select("study_id", "meat"), ends, config)
    return (
        ends.select("study_id", "parent", "end_idx", "theta")
        .join(meats.select("study_id", "adjusted_variance"), "study_id", "left")
        .join(classical, "study_id", "left")
        .join(told.select("parent", "end_idx", "joint_condition"), ["parent", "end_idx"], "left")
        .select(
            F.col("parent").alias("study_id"), "end_idx", "theta", "adjusted_variance",
            "classical_variance", "joint_condition",
        )
    )
