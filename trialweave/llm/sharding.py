"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows are dealt to blocks. How many rows of each block go to each shard is drawn from the
distribution that a uniform shuffle of all rows has: block by block, multivariate hypergeometric
in what is left of the shards. The rows of a block are put in random order and cut at those
counts, exchanged, and put in random order once more within their shard. Shard sizes are exact by
construction and no task ever sees a whole shard: the second order is taken in slices by the
leading bits of the random key, whose counts give the first slot of each slice.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialweave.llm.common import fresh, text_of, without
from trialweave.session import written

#: Standard deviations around the mode that the draw looks at; what is outside has less
#: probability than the last bit of a double.
SPREAD = 12.0
#: Rows of the matrix.
MOST_BLOCKS = 8192
#: ``monotonically_increasing_id`` keeps the partition above this bit.
PLACE_BITS = 33


def hypergeometric(good: int, bad: int, draws: int, u: float) -> int:
    """The inverse of the distribution function at ``u``, from ratios of neighbouring weights.

    NumPy's own sampler refuses a thousand million rows and more.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    p = good / total
    sd = math.sqrt(draws * p * (1 - p) * max(0.0, (total - draws) / max(1, total - 1)))
    reach = int(SPREAD * sd) + 12
    first, last = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log((good - k) * (draws - k)) - np.log((k + 1) * (bad - draws + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.exp(logs - logs.max())
    sums = np.cumsum(weights)
    return first + int(min(np.searchsorted(sums, u * sums[-1], side="right"), len(sums) - 1))


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Counts of rows from each block to each shard; rows and columns add up exactly."""
    rng = np.random.default_rng(seed)
    left, out = list(shards), []
    for n in blocks:
        row, rest = [], sum(left)
        for j, room in enumerate(left):
            rest -= room
            row.append(hypergeometric(room, rest, n, rng.random()))
            n -= row[-1]
            left[j] -= row[-1]
        out.append(row)
    return out


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (j < rows % shards) for j in range(shards)]


def _key(uid: Column, seed: int, salt: int) -> Column:
    return F.xxhash64(uid, F.lit(seed), F.lit(salt))


def hypergeometric_shuffle(docs: DataFrame, shards: int = 24, seed: int = 42,
                           rows_per_task: int = 1 << 20, least: int = 64) -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 within the shard).

    Shard sizes differ by one row at most. Null texts, repeated rows and extra columns are rows
    like any other; an empty table gives an empty result. The blocks are the partitions that the
    rows are first written in, each in a random order of its own, so that a row's block and place
    are fixed once and need no exchange; the rows then move once, to their shard and slice. The
    driver holds one count per block, ``MOST_BLOCKS`` at most, and the matrix, and never data.
    ``least`` is the least number of slices over all shards.
    """
    docs = without(docs, "shard", "slot")
    uid, block, cuts, order, part, start = fresh(docs, "uid", "block", "cuts", "order", "part", "start")
    at = F.monotonically_increasing_id()
    blocks = docs.coalesce(MOST_BLOCKS).withColumn(uid, at)
    rows = written(blocks.sortWithinPartitions(_key(F.col(uid), seed, 2), uid).withColumn(uid, at), "shard-rows", codec="zstd")
    # The partition and the place in it, as the id has them.
    own = F.shiftright(uid, PLACE_BITS).cast("int")
    place = F.col(uid).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    counts = {b: n for b, n in rows.groupBy(own.alias("b")).count().collect()}
    names, total = sorted(counts), sum(counts.values())
    matrix = communication_matrix([counts[b] for b in names], shard_sizes(total, shards), seed)
    table = docs.sparkSession.createDataFrame(
        [(b, np.cumsum(row).tolist()) for b, row in zip(names, matrix)],
        f"`{block}` int, `{cuts}` array<bigint>")
    bits = max(0, math.ceil(math.log2(max(least / shards, total / shards / rows_per_task, 1))))
    dealt = (
        rows.join(table, own == F.col(block))
        .withColumn("shard", F.size(F.filter(cuts, lambda c: c <= place)).cast("int"))
        .withColumn(order, _key(F.col(uid), seed, 3).bitwiseAND(F.lit((1 << 62) - 1)))
        .withColumn(part, F.shiftright(F.col(order), 62 - bits).cast("int"))
        .drop(block, cuts))
    earlier = W.partitionBy("shard").orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    # Counted from the ids alone.
    starts = dealt.groupBy("shard", part).count().withColumn(
        start, F.coalesce(F.sum("count").over(earlier), F.lit(0))).drop("count")
    again = W.partitionBy("shard", part).orderBy(order, uid)
    return (
        dealt.withColumn("slot", F.row_number().over(again) - 1)
        .join(written(starts, "shard-starts"), ["shard", part])
        .withColumn("slot", (F.col("slot") + F.col(start)).cast("long"))
        .select(*docs.columns, "shard", "slot")
    )


def query(spark, sf_dir: str) -> DataFrame:
    # The documents themselves are shuffled; what is told of them is read from the result.
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return hypergeometric_shuffle(docs).select(
        "doc_id", (F.octet_length(text_of()).cast("long") + 8).alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
