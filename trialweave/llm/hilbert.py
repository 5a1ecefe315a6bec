"""Approximate nearest neighbours by windows of several Hilbert curves.

Vectors are rotated at random and cut into groups of a few coordinates. Each group, shifted at
random, gives one Hilbert curve over all vectors. For each curve, Spark deals the vectors by ranges
of their place on the curve; a query goes to the range it falls in and to the ranges next to it,
and is measured there against all vectors. The nearest over all curves are measured once more in
double precision and ranked.

Equal vectors are one vector with its smallest ids, since only those can be in a result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialweave.session import ship_package, written


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of cells (rows of ``dims`` whole numbers below 2^bits).

    Skilling's transform: axes are exchanged and inverted from the highest bit down, then the bits
    are taken in turn.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(dims):
            on = (x[i] & bit) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, 0)
            x[0] ^= swap
            x[i] ^= swap
        bit >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        turn ^= np.where((x[-1] & bit) > 0, bit - 1, 0)
        bit >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << 1 | (x[i] >> b & 1)
    return out


class Curves:
    """Random rotations and shifts, and the cells of each curve, fitted on a sample of vectors."""

    def __init__(self, sample: np.ndarray, curves: int, dims: int, bits: int, seed: int) -> None:
        width = sample.shape[1]
        dims = min(dims, width)
        rng = np.random.default_rng(seed)
        self.bits, self.mean = bits, sample.mean(0)
        # As many rotations as it takes to give every curve coordinates of its own.
        basis = np.concatenate([np.linalg.qr(rng.normal(size=(width, width)))[0]
                                for _ in range(-(-curves * dims // (width - width % dims)))], axis=1)
        usable = [c for c in range(basis.shape[1]) if c % width < width - width % dims]
        self.axes = [basis[:, usable[i * dims:(i + 1) * dims]] for i in range(curves)]
        self.low, self.step = [], []
        for axes in self.axes:
            y = (sample - self.mean) @ axes
            low, high = np.quantile(y, (0.002, 0.998), axis=0)
            span = np.maximum(high - low, 1e-300)
            # The grid is a quarter wider than the sample and shifted by up to that quarter.
            self.low.append(low - rng.random(y.shape[1]) * span / 4)
            self.step.append(span * 1.25 / (1 << bits))

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """(curves, vectors)."""
        out = []
        for axes, low, step in zip(self.axes, self.low, self.step):
            cells = np.clip(((vectors - self.mean) @ axes - low) / step, 0, (1 << self.bits) - 1)
            out.append(hilbert_index(cells.astype(np.int64), self.bits))
        return np.array(out)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(ids, v): distinct finite, non-zero vectors of the most frequent width."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"),
                          F.col(vector_col).cast("array<double>").alias("v")).filter(
        F.col("id").isNotNull() & v.isNotNull()
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0))
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (width["n"] if width else -1))


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, curves: int = 16, dims: int = 4,
            bits: int = 12, ranges: int = 32, reach: int = 1, sample: int = 5000, seed: int = 11,
            least: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every vector whose id is a
    multiple of ``every``, by Euclidean distance in double precision, ties to the smaller id.

    Null, zero and non-finite vectors, those with null parts, null ids and vectors of another width
    than the most frequent one take no part. A row given twice is a candidate twice over only if
    its id differs. ``sample`` bounds the vectors that the curves are fitted on; all are indexed.
    A table is cut into ``ranges`` ranges, fewer if one would have under ``least`` vectors, so a
    small table is searched whole. Recall depends on curves, ranges and reach: see the README.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = usable(vectors, id_col, vector_col)
    # Of equal vectors only the smallest ids can be among the k nearest of anything but themselves.
    own = W.partitionBy("v").orderBy("id")
    distinct = written(
        rows.distinct().withColumn("n", F.row_number().over(own)).filter(F.col("n") <= k + 1)
        .groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .withColumn("name", F.xxhash64("v")), "hilbert-vectors")
    queries = written(rows.filter(F.col("id") % every == 0).select("id", "v").distinct(), "hilbert-queries")
    total = distinct.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    fitted = distinct.orderBy(F.xxhash64("name", F.lit(seed))).limit(sample).select("v").collect()
    shared = spark.sparkContext.broadcast(
        Curves(np.array([r["v"] for r in fitted]), curves, dims, min(bits, 60 // dims), seed))
    pieces = max(1, min(ranges, total // least))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = shared.value.places(_matrix(batch.column("v")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("name"),
                 pa.ListArray.from_arrays(np.arange(0, found.size + 1, len(found), dtype=np.int32),
                                          pa.array(found.T.ravel()))], names=["name", "places"])

    placed = written(distinct.select("name", "v").mapInArrow(place, "name long, places array<long>"), "hilbert-places")
    # Borders of the ranges of each curve, a fixed number of them.
    steps = [i / pieces for i in range(1, pieces)]
    cuts = placed.agg(*[F.percentile_approx(F.col("places")[c], steps, 10000)
                        for c in range(curves)]).first() if steps else [[]] * curves
    borders = spark.sparkContext.broadcast([np.array(c, np.int64) for c in cuts])
    slots = max(1, math.ceil(total / ranges / 20000))

    def deal(width: int, spread: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = _matrix(batch.column("v"))
                name = batch.column(0).to_numpy()
                for c, found in enumerate(shared.value.places(v)):
                    at = np.searchsorted(borders.value[c], found, "right")
                    for d in range(-width, width + 1):
                        ok = np.flatnonzero((at + d >= 0) & (at + d < pieces))
                        # A range is cut into slots by name, so that none outgrows a task.
                        for s in range(slots) if spread else (None,):
                            slot = name[ok] % slots if s is None else np.full(len(ok), s)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(ok), c, np.int32)), pa.array((at[ok] + d).astype(np.int32)),
                                 pa.array(slot.astype(np.int32)), pa.array(name[ok]), _lists(v[ok])],
                                names=["curve", "range", "slot", "name", "v"])

        return run

    kind = "curve int, range int, slot int, name long, v array<float>"
    asked = queries.select(F.col("id").alias("name"), "v").mapInArrow(deal(reach, True), kind)
    stored = distinct.select("name", "v").mapInArrow(deal(0, False), kind)
    keep = k + 2

    def measure(candidates: pa.Table, questions: pa.Table) -> pa.Table:
        out = {"query_id": [], "name": [], "square": []}
        if candidates.num_rows and questions.num_rows:
            x, names = _matrix(candidates.column("v")).astype(np.float64), candidates.column("name").to_numpy()
            norms = (x * x).sum(1)
            q, ids = _matrix(questions.column("v")).astype(np.float64), questions.column("name").to_numpy()
            for a in range(0, len(q), 256):
                part = q[a:a + 256]
                square = norms[None] + (part * part).sum(1)[:, None] - 2 * part @ x.T
                n = min(keep, len(names))
                best = np.argpartition(square, n - 1, axis=1)[:, :n]
                out["query_id"].append(np.repeat(ids[a:a + 256], n))
                out["name"].append(names[best].ravel())
                out["square"].append(np.take_along_axis(square, best, 1).ravel())
        return pa.table({c: pa.array(np.concatenate(v) if v else np.zeros(0, t), pa.from_numpy_dtype(t))
                         for (c, v), t in zip(out.items(), (np.int64, np.int64, np.float64))})

    keys = ["curve", "range", "slot"]
    found = (stored.groupBy(*keys).cogroup(asked.groupBy(*keys))
             .applyInArrow(measure, "query_id long, name long, square double"))
    merged = found.groupBy("query_id", "name").agg(F.min("square").alias("square"))
    few = merged.withColumn("n", F.row_number().over(
        W.partitionBy("query_id").orderBy("square", "name"))).filter(F.col("n") <= keep)
    exact = (
        few.join(distinct.withColumnRenamed("v", "other"), "name")
        .join(queries.withColumnRenamed("id", "query_id"), "query_id")
        .withColumn("score", F.sqrt(F.aggregate(
            F.zip_with("v", "other", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)))
        .select("query_id", "score", F.explode("ids").alias("vec_id"))
        .filter(F.col("vec_id") != F.col("query_id"))
        .withColumn("rank", F.row_number().over(
            W.partitionBy("query_id").orderBy("score", "vec_id")))
    )
    return exact.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _lists(rows: np.ndarray) -> pa.ListArray:
    """Single precision is enough to choose what is measured again."""
    return pa.ListArray.from_arrays(
        np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), pa.array(rows.astype(np.float32).ravel()))


def query(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
