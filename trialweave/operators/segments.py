"""Per-subject work on digest rows, in buckets of a bounded number of subjects and matrix cells.

A digest row holds a subject's sums over one segment. The estimating function of update k needs
the sums of all segments up to k, so within a bucket the sums are carried from segment to segment:
what is exchanged is the digest, at most one row per (subject, segment, policy), and never a row
per (subject, segment, later update). The study's parameters come to each bucket as one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.config import AnalysisConfig
from trialweave.functions.vectors import Gram
from trialweave.operators.sums import theta_gram, update_gram
from trialweave.session import ship_package

#: Cells (subjects times joint parameters) that a bucket may hold.
BUCKET_CELLS = 2_000_000


def bucket_count(config: AnalysisConfig) -> Column:
    """Buckets of a study, from its number of subjects and of updates."""
    size = F.col("n_updates") * config.update.dim + config.inference.dim
    most = F.greatest(F.lit(1), F.least(F.lit(config.subjects_per_bucket), F.floor(F.lit(BUCKET_CELLS) / size)))
    return F.greatest(F.lit(1), F.ceil(F.col("n_subjects") / most)).cast("long")


def in_buckets(
    digest: DataFrame, studies: DataFrame, config: AnalysisConfig,
    run: Callable[[SubjectSums, dict], pa.Table | None], schema: str,
) -> DataFrame:
    """``run`` on every bucket of subjects with the row of its study; both as Arrow inside the tasks.

    ``studies`` has one row per study with ``n_subjects`` and ``n_updates``; studies that are not in
    it are left out.
    """
    ship_package(digest.sparkSession)
    sizes = studies.select("study_id", bucket_count(config).alias("buckets"))
    left = digest.join(sizes, "study_id").withColumn("bucket", F.pmod(F.xxhash64("subject_id"), "buckets")).drop("buckets")
    right = studies.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), bucket_count(config) - 1)))
    dims = (config.update.dim, config.inference.dim, config.policy.gradient_dim)
    empty = pa.schema([])

    def apply(rows: pa.Table, study: pa.Table) -> pa.Table:
        made = run(SubjectSums(rows, *dims), study.to_pylist()[0]) if rows.num_rows and study.num_rows else None
        return empty.empty_table() if made is None else made

    return (left.groupBy("study_id", "bucket").cogroup(right.groupBy("study_id", "bucket"))
            .applyInArrow(apply, schema))


def _array(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy().astype(float)


def _square(table: pa.Table, gram: Gram) -> np.ndarray:
    d = range(gram.dim)
    return np.stack([np.stack([_array(table, gram.xx(i, j)) for j in d], axis=1) for i in d], axis=1)


def vectors(values: list[list[float] | None] | None, width: int) -> np.ndarray:
    """Parameter vectors as rows; missing ones are not a number."""
    rows = [v if v is not None and len(v) == width else [np.nan] * width for v in values or []]
    return np.array([[np.nan if x is None else x for x in r] for r in rows], dtype=float).reshape(len(rows), width)


class SubjectSums:
    """The digest rows of one bucket as arrays, one place per subject."""

    def __init__(self, table: pa.Table, b: int, q: int, g: int) -> None:
        u, i = Gram("u", b), Gram("i", q)
        coded = table["subject_id"].combine_chunks().dictionary_encode()
        self.subjects, self.row = coded.dictionary, coded.indices.to_numpy()
        self.n, self.b, self.q, self.g = len(self.subjects), b, q, g
        self.seg, self.horizon = table["seg"].to_numpy(), table["horizon"].to_numpy()
        self.policy = table["policy_idx"].to_numpy()
        self.u_xx, self.i_xx = _square(table, u), _square(table, i)
        self.u_rx = np.stack([_array(table, u.rx(k)) for k in range(b)], axis=1)
        self.i_rx = np.stack([_array(table, i.rx(k)) for k in range(q)], axis=1)
        self.score = np.stack([_array(table, f"score_{e}") for e in range(g)], axis=1)

    def by(self, key: np.ndarray, steps: list[int]) -> Iterator[np.ndarray]:
        """For ascending ``steps``: the rows with a key up to the step that no earlier step had."""
        order = np.argsort(key, kind="stable")
        cuts = np.searchsorted(key[order], steps, side="right")
        for start, end in zip([0, *cuts[:-1]], cuts):
            yield order[start:end]

    def updates(self, betas: np.ndarray, users: list[int | None], ridge: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per update: estimating functions (subject, parameter), and which subjects have data for it."""
        xx, rx = np.zeros((self.n, self.b, self.b)), np.zeros((self.n, self.b))
        have = np.zeros(self.n, bool)
        for k, new in enumerate(self.by(self.seg, list(range(len(betas))))):
            np.add.at(xx, self.row[new], self.u_xx[new])
            np.add.at(rx, self.row[new], self.u_rx[new])
            have[self.row[new]] = True
            phi = -2.0 * (rx - xx @ betas[k])
            if ridge:
                phi += 2.0 * ridge / users[k] * betas[k] if users[k] else np.nan
            phi[~have] = 0.0
            yield phi, have.copy()

    def theta_sums(self, rows: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        xx, rx = np.zeros((self.n, self.q, self.q)), np.zeros((self.n, self.q))
        np.add.at(xx, self.row[rows], self.i_xx[rows])
        np.add.at(rx, self.row[rows], self.i_rx[rows])
        return xx, rx

    def scores(self, updates: int, rows: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Scores (subject, policy, entry), and which of them come from any decision."""
        out, have = np.zeros((self.n, updates, self.g)), np.zeros((self.n, updates), bool)
        row, policy, score = self.row[rows], self.policy[rows], self.score[rows]
        learned = policy >= 0
        np.add.at(out, (row[learned], policy[learned]), score[learned])
        have[row[learned], policy[learned]] = True
        return out, have


def theta_values(xx: np.ndarray, rx: np.ndarray, theta: np.ndarray) -> np.ndarray:
    return -2.0 * (rx - xx @ theta)


def leverage_sums(xx: np.ndarray, bread: np.ndarray) -> np.ndarray:
    """Leverages times the number of subjects: trace of the subject's derivative times the bread."""
    return 2.0 * np.einsum("nrc,cr->n", xx, bread)


def weights(kind: str, leverage: np.ndarray, n: int, q: int) -> np.ndarray:
    """Weights of the subjects' outer products under a small-sample correction."""
    if kind == "none":
        return np.ones(len(leverage))
    if kind == "HC1theta":
        return np.full(len(leverage), n / (n - q) if n != q else np.nan)
    with np.errstate(divide="ignore"):
        return (1.0 - leverage) ** (-1.0 if kind == "HC2theta" else -2.0)


def long_stack(ridge: float):
    """Rows (kind, block, v, is_theta, leverage) of every subject of a bucket."""
    def run(sums: SubjectSums, study: dict) -> pa.Table:
        betas = vectors(study["betas"], sums.b)
        theta, bread = vectors([study["theta"]], sums.q)[0], vectors([study["bread"]], sums.q ** 2)[0]
        users = study["n_users"] or [None] * len(betas)
        parts: list[tuple[str, int, np.ndarray, np.ndarray]] = []
        for k, (phi, have) in enumerate(sums.updates(betas, users, ridge)):
            parts.append(("phi", k, np.flatnonzero(have), phi[have]))
        xx, rx = sums.theta_sums()
        parts.append(("phi", len(betas), np.arange(sums.n), theta_values(xx, rx, theta)))
        scores, have = sums.scores(len(betas))
        parts += [("score", k, np.flatnonzero(have[:, k]), scores[have[:, k], k]) for k in range(len(betas))]
        at = np.concatenate([p[2] for p in parts])
        count = [len(p[2]) for p in parts]
        widths = np.repeat([p[3].shape[1] for p in parts], count)
        is_theta = np.repeat([p[0] == "phi" and p[1] == len(betas) for p in parts], count)
        leverage = leverage_sums(xx, bread.reshape(sums.q, sums.q))[at]
        flat = np.concatenate([p[3].ravel() for p in parts])
        # What has no finite parameter has no values.
        v = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(widths)]), pa.int32()), pa.array(flat))
        return pa.table({
            "study_id": pa.array([study["study_id"]] * len(at), pa.string()),
            "subject_id": sums.subjects.take(pa.array(at)),
            "kind": pa.array(np.repeat([p[0] for p in parts], count), pa.string()),
            "block": pa.array(np.repeat([p[1] for p in parts], count).astype(np.int32)),
            "v": v, "is_theta": pa.array(is_theta),
            "leverage": pa.array(leverage, mask=~is_theta),
        })
    return run


def product_rows(study: str, rows: list[tuple[str, int, int, np.ndarray]]) -> pa.Table:
    return pa.table({
        "study_id": pa.array([study] * len(rows), pa.string()),
        "piece": pa.array([r[0] for r in rows], pa.string()),
        "row_block": pa.array([r[1] for r in rows], pa.int32()),
        "col_block": pa.array([r[2] for r in rows], pa.int32()),
        "width": pa.array([r[3].shape[1] for r in rows], pa.int32()),
        "m": pa.array([r[3].ravel() for r in rows], pa.list_(pa.float64())),
    })


def block_products(ridge: float, correction: str, with_meat: bool):
    """One triangle of the weighted meat, and all blocks times the scores of earlier policies."""
    def run(sums: SubjectSums, study: dict) -> pa.Table:
        betas = vectors(study["betas"], sums.b)
        K, n = len(betas), study["n_subjects"]
        users, wanted = study["n_users"] or [None] * K, study.get("wanted")
        scores, have = sums.scores(K)
        used = np.flatnonzero(have.any(axis=0))
        blocks = [(k, phi) for k, (phi, has) in enumerate(sums.updates(betas, users, ridge))
                  if has.any() and (wanted is None or k in wanted)]
        if wanted is None:
            xx, rx = sums.theta_sums()
            blocks.append((K, theta_values(xx, rx, vectors([study["theta"]], sums.q)[0])))
        rows = [("score", k, int(j), phi.T @ scores[:, j]) for k, phi in blocks for j in used if j < k]
        if with_meat:
            bread = vectors([study["bread"]], sums.q ** 2)[0].reshape(sums.q, sums.q)
            weight = weights(correction, leverage_sums(xx, bread) / n, n, sums.q)
            everything = np.hstack([phi for _, phi in blocks])
            ends = np.cumsum([0, *[phi.shape[1] for _, phi in blocks]])
            for i, (k, phi) in enumerate(blocks):
                below = (phi * weight[:, None]).T @ everything[:, :ends[i + 1]]
                rows += [("meat", k, blocks[j][0], below[:, ends[j]:ends[j + 1]]) for j in range(i + 1)]
        return product_rows(study["study_id"], rows)
    return run
