"""Joint bread inverse and meat as sums of small matrix cells.

A matrix is a table (study_id, row_block, col_block, r, c, value); block ``n_updates`` is theta
and missing cells are zero. The derivative of the mean stack has three parts:

* own block: twice the Gram sums of the data that feed it (plus the ridge),
* score part: each subject's block times the scores of the earlier policies,
* probability part, for centred models: from study-level sums, no per-subject work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.config import AnalysisConfig
from trialweave.functions.vectors import Gram, ProbabilitySums
from trialweave.operators import segments
from trialweave.operators import stack as stack_ops
from trialweave.operators.sums import probability_sums, theta_gram, update_gram

CELL = ["study_id", "row_block", "col_block", "r", "c", "value"]


def _unpivot(df: DataFrame, cells: list[tuple[int, int, str]]) -> DataFrame:
    """One row per cell; the values are SQL text over the columns of ``df``."""
    values = ", ".join(f"struct({r} AS r, {c} AS c, {v} AS value)" for r, c, v in cells)
    return df.selectExpr(
        "study_id", "row_block", "col_block", f"inline(array({values})) AS (r, c, value)"
    )


def _per_block(sums: DataFrame, frame: DataFrame, totals: list[Column], keys: list[str]):
    """Study sums rolled up to every update block they feed (segments up to the block)."""
    updates = frame.select(
        F.col("study_id").alias("study"), F.posexplode("betas").alias("row_block", "param"),
        "n_subjects",
    )
    return (
        sums.join(
            updates, (F.col("study_id") == F.col("study")) & (F.col("seg") <= F.col("row_block"))
        )
        .groupBy("study_id", "row_block", "param", "n_subjects", *keys)
        .agg(*totals)
    )


def _own(df: DataFrame, gram: Gram, ridge: float) -> DataFrame:
    d = range(gram.dim)
    cells = [
        (r, c, f"(2D * {gram.xx(r, c)} + {2.0 * ridge if r == c else 0.0!r}D) / n_subjects")
        for r in d
        for c in d
    ]
    return _unpivot(df.withColumn("col_block", F.col("row_block")), cells)


def _probability(df: DataFrame, sums: ProbabilitySums, first: int) -> DataFrame:
    cells = [
        (r, first + e, f"{sums.derivative(r, e, 'param')} / n_subjects")
        for r in range(sums.dim)
        for e in range(sums.grad)
    ]
    return _unpivot(df.withColumn("col_block", F.col("policy_idx")), cells)


def study_level_cells(sums: DataFrame, frame: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Own blocks and probability parts, for the updates and for theta."""
    return update_level_cells(sums, frame, config).unionByName(theta_level_cells(sums, frame, config))


def update_level_cells(sums: DataFrame, frame: DataFrame, config: AnalysisConfig) -> DataFrame:
    first, tensors, u = config.policy.gradient_start(config.update.dim), probability_sums(config), update_gram(config)
    out = _own(_per_block(sums, frame, u.totals(), []), u, config.update.ridge)
    if "u" in tensors:
        rolled = _per_block(sums.filter("policy_idx >= 0"), frame, tensors["u"].totals(), ["policy_idx"])
        out = out.unionByName(_probability(rolled.filter("policy_idx < row_block"), tensors["u"], first))
    return out.select(*CELL)


def theta_level_cells(sums: DataFrame, frame: DataFrame, config: AnalysisConfig) -> DataFrame:
    first, tensors, i = config.policy.gradient_start(config.update.dim), probability_sums(config), theta_gram(config)
    theta = frame.select(
        "study_id", F.col("n_updates").alias("row_block"), F.col("theta").alias("param"),
        "n_subjects",
    )
    out = _own(sums.groupBy("study_id").agg(*i.totals()).join(theta, "study_id"), i, 0.0)
    if "i" in tensors:
        rolled = sums.filter("policy_idx >= 0").groupBy("study_id", "policy_idx").agg(*tensors["i"].totals())
        out = out.unionByName(_probability(rolled.join(theta, "study_id"), tensors["i"], first))
    return out.select(*CELL)


def bucketed(stack: DataFrame, frame: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Split every study into buckets of a bounded number of subjects."""
    buckets = F.ceil(F.col("n_subjects") / F.lit(config.subjects_per_bucket))
    return stack.join(frame.select("study_id", "n_subjects"), "study_id").withColumn(
        "bucket", F.pmod(F.xxhash64("subject_id"), buckets)
    )


PRODUCT_SCHEMA = (
    "study_id string, piece string, row_block int, col_block int, width int, m array<double>"
)


def _bucket_products(table: pa.Table) -> pa.Table:
    """phi'phi (weighted) and phi'score of one bucket, cut into blocks."""
    _, row = np.unique(table["subject_id"].to_numpy(zero_copy_only=False), return_inverse=True)
    block = table["block"].to_numpy()
    is_phi = table["kind"].to_numpy(zero_copy_only=False) == "phi"
    lists = table["v"].combine_chunks()
    width = lists.value_lengths().to_numpy()
    start = lists.offsets.to_numpy()[:-1]
    flat = lists.values.to_numpy()
    weight = np.zeros(row.max() + 1)
    weight[row] = table["weight"].to_numpy()

    def dense(mask: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Subject-by-position array of one kind, and where each block lies in it."""
        spans, parts, lo = [], [], 0
        for k in np.unique(block[mask]):
            at = np.flatnonzero(mask & (block == k))
            d = int(width[at[0]])
            part = np.zeros((len(weight), d))
            part[row[at]] = flat[start[at][:, None] + np.arange(d)]
            spans.append((int(k), lo, lo + d))
            parts.append(part)
            lo += d
        return (np.hstack(parts) if parts else np.zeros((len(weight), 0))), spans

    phi, phi_spans = dense(is_phi)
    score, score_spans = dense(~is_phi)
    products = {"meat": (phi * weight[:, None]).T @ phi, "score": phi.T @ score}
    study = table["study_id"][0].as_py()
    rows = []
    for k, r0, r1 in phi_spans:
        rows += [("meat", k, j, c1 - c0, (r0, r1, c0, c1)) for j, c0, c1 in phi_spans]
        rows += [("score", k, j, c1 - c0, (r0, r1, c0, c1)) for j, c0, c1 in score_spans if j < k]
    return pa.table(
        {
            "study_id": pa.array([study] * len(rows), pa.string()),
            "piece": pa.array([r[0] for r in rows], pa.string()),
            "row_block": pa.array([r[1] for r in rows], pa.int32()),
            "col_block": pa.array([r[2] for r in rows], pa.int32()),
            "width": pa.array([r[3] for r in rows], pa.int32()),
            "m": pa.array(
                [products[p][r0:r1, c0:c1].ravel() for p, _, _, _, (r0, r1, c0, c1) in rows],
                pa.list_(pa.float64()),
            ),
        }
    )


def summed_products(partial: DataFrame, frame: DataFrame, *keys: str) -> DataFrame:
    """Partial block products added up cell by cell and divided by the subjects of the study."""
    return (
        partial.select(
            "study_id", *keys, "piece", "row_block", "col_block", "width",
            F.posexplode("m").alias("pos", "value"),
        )
        .groupBy("study_id", *keys, "piece", "row_block", "col_block", "width", "pos")
        .agg(F.sum("value").alias("total"))
        .join(frame.select("study_id", "n_subjects"), "study_id")
        .select(
            "study_id", *keys, "piece", "row_block", "col_block",
            (F.col("pos") / F.col("width")).cast("int").alias("r"),
            F.pmod("pos", "width").alias("c"),
            (F.col("total") / F.col("n_subjects")).alias("value"),
        )
    )


def digest_products(
    digest: DataFrame, frame: DataFrame, config: AnalysisConfig, meat: bool = True, updates: DataFrame | None = None
) -> DataFrame:
    """Meat and score products straight from the digest, as ``subject_products`` gives them.

    A bucket gives one triangle of its meat, and the other is filled in after the sums. With
    ``updates`` (study_id, policy_idx) only those block rows are formed, without meat.
    """
    studies = stack_ops.segment_frame(frame)
    if updates is not None:
        meat = False
        wanted = updates.groupBy("study_id").agg(F.collect_set("policy_idx").alias("wanted"))
        studies = studies.join(wanted, "study_id")
    run = segments.block_products(config.update.ridge, config.correction, meat)
    cells = summed_products(segments.in_buckets(digest, studies, config, run, PRODUCT_SCHEMA), frame)
    mirrored = cells.filter("piece = 'meat' AND col_block < row_block").select(
        "study_id", "piece", F.col("col_block").alias("row_block"), F.col("row_block").alias("col_block"),
        F.col("c").cast("int").alias("r"), F.col("r").cast("int").alias("c"), "value",
    )
    return cells.unionByName(mirrored)


def subject_products(weighted: DataFrame, frame: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Meat and score products of a long stack, as (study_id, piece, row_block, col_block, r, c, value).

    Every bucket is one group of bounded size; buckets are then added up cell by cell.
    ``weighted`` is the stack with a ``weight`` per subject, which applies to the meat only.
    """
    partial = (
        bucketed(weighted, frame, config)
        .select("study_id", "bucket", "subject_id", "kind", "block", "v", "weight")
        .groupBy("study_id", "bucket")
        .applyInArrow(_bucket_products, PRODUCT_SCHEMA)
    )
    return summed_products(partial, frame)


def score_cells_by_join(stack: DataFrame, frame: DataFrame, config: AnalysisConfig) -> DataFrame:
    """The score part as a join within subjects and plain sums; for few updates."""
    g = config.policy.gradient_dim
    first = config.update.dim - g
    width = max(config.update.dim, config.inference.dim)
    left = stack.filter("kind = 'phi'").select(
        "study_id", "subject_id", F.col("block").alias("row_block"), "v"
    )
    right = stack.filter("kind = 'score'").select(
        F.col("study_id").alias("study"), F.col("subject_id").alias("subject"),
        F.col("block").alias("col_block"), F.col("v").alias("s"),
    )
    pairs = left.join(
        right,
        (F.col("study_id") == F.col("study"))
        & (F.col("subject_id") == F.col("subject"))
        & (F.col("col_block") < F.col("row_block")),
    )
    terms = [(r, e) for r in range(width) for e in range(g)]
    sums = pairs.groupBy("study_id", "row_block", "col_block").agg(
        *[F.expr(f"sum(get(v, {r}) * get(s, {e})) AS p_{r}_{e}") for r, e in terms]
    ).join(frame.select("study_id", "n_subjects"), "study_id")
    cells = [(r, first + e, f"p_{r}_{e} / n_subjects") for r, e in terms]
    return _unpivot(sums, cells).filter("value is not null").select(*CELL)


def bread_cells(
    products: DataFrame, sums: DataFrame, frame: DataFrame, config: AnalysisConfig
) -> DataFrame:
    """Joint bread inverse: study-level cells plus the score part, added per cell."""
    first = config.policy.gradient_start(config.update.dim)
    score = products.filter("piece = 'score'").withColumn("c", F.col("c") + F.lit(first))
    return add_cells(study_level_cells(sums, frame, config), score.select(*CELL))


def add_cells(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("study_id", "row_block", "col_block", "r", "c").agg(
        F.sum("value").alias("value")
    )


def meat_cells(products: DataFrame) -> DataFrame:
    return products.filter("piece = 'meat'").select(*CELL)


def as_blocks(cells: DataFrame, frame: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Cells as (study_id, row_block, col_block, m): whole row-major blocks, absent cells are zero."""
    b, q = config.update.dim, config.inference.dim
    side = lambda block: F.when(F.col(block) == F.col("n_updates"), q).otherwise(b)
    rows, cols = side("row_block"), side("col_block")
    placed = cells.join(frame.select("study_id", "n_updates"), "study_id").select(
        "study_id", "row_block", "col_block", (rows * cols).alias("size"),
        F.struct((F.col("r") * cols + F.col("c")).alias("at"), "value").alias("cell"),
    )
    return (
        placed.groupBy("study_id", "row_block", "col_block", "size")
        .agg(F.map_from_entries(F.collect_list("cell")).alias("cells"))
        .select(
            "study_id", "row_block", "col_block",
            F.transform(
                F.sequence(F.lit(0), F.col("size") - 1),
                lambda i: F.coalesce(F.try_element_at("cells", i), F.lit(0.0)),
            ).alias("m"),
        )
    )
