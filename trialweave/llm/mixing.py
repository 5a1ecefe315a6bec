"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, ``target / source size``.
The prefix sum of expected copies over the source's documents is that number times the rank, so
one random offset per source decides all copies: a document is emitted once for every integer
that the prefix sum crosses. Documents are ranked by size class first, so that each class is
sampled evenly and the words taken come near the target.

The rank needs no task that sees a whole source: rows are ranked within (source, size class,
slice of a hash) and the counts of those cells, a few thousand per source, give the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialweave.llm.common import WORD, fresh, text_of, without
from trialweave.session import written

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def unit(column: Column) -> Column:
    """A number in [0, 1) from the first eight hexadecimal digits of the MD5."""
    return F.conv(F.substring(F.md5(column), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0,
                   weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) -> the same with ``target``; one small row per source.

    ``share`` times all words are split by weight; a source stops at ``cap`` times its size, and
    what it cannot give is split again by weight. Ordered by cap over weight, the sources that
    stop are a prefix, so the final share per unit of weight is the first one that the source at
    its own place can meet.
    """
    everything = W.partitionBy()
    by_name = W.partitionBy().orderBy(F.col("source").asc_nulls_last())
    ranked = W.partitionBy().orderBy("ratio", F.col("source").asc_nulls_last())
    before = ranked.rowsBetween(W.unboundedPreceding, -1)
    here = ranked.rowsBetween(W.currentRow, W.unboundedFollowing)
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"),
    )
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.lit(cap) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("all", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("given", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("all") - F.col("given")) / F.sum("weight").over(here))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"),
                                          F.struct("ratio", "level"))).over(everything))
        .withColumn("level", F.col("level.level"))
        .withColumn("target", F.when(F.col("level").isNull(), F.col("cap"))
                    .otherwise(F.least("cap", F.col("level") * F.col("weight"))))
        .select("source", "source_size", "target")
    )


def systematic_mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0,
                   weights: tuple[int, ...] = WEIGHTS, seed: str = "mix",
                   id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                   slices: int = 64) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (size x copies).

    Null texts have size 0, and null sources are one source that comes last. A document gets at
    most ``cap`` copies, rounded up. Draws depend on the seed and the rows only, so a rerun gives
    the same copies; rows equal in id and text are told apart only by their rank, and each gets
    its own copies. An empty table gives an empty result, a source of empty texts target 0.
    Columns of ``docs`` with the names of the results are replaced; all others stay.
    """
    docs = without(docs, *({"size", "source_size", "target", "copies", "taken"}
                           - {id_col, text_col, source_col}))
    key, kind, part, rank, source = fresh(docs, "key", "kind", "part", "rank", "cell_source")
    bits = F.bin("size")
    sized = (
        docs.withColumn("size", word_count(text_col))
        .withColumn(key, F.md5(F.concat(F.lit(f"{seed}|"),
                                        F.coalesce(F.col(id_col).cast("string"), F.lit("")))))
        .withColumn(kind, F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"),
                                   F.substring(bits, 1, 5)))
        .withColumn(part, F.floor(F.conv(F.substring(key, 1, 4), 16, 10).cast("int")
                                  / F.lit(65536 / slices)).cast("int"))
    )
    # A few thousand cells for a source at most, however many rows it has.
    cells = written(
        sized.groupBy(F.col(source_col).alias("source"), F.col(kind).alias("kind"),
                      F.col(part).alias("part"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "mix-cells")
    sources = source_targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")),
                             share, cap, weights)
    earlier = W.partitionBy("source").orderBy("kind", "part").rowsBetween(
        W.unboundedPreceding, -1)
    starts = cells.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    plan = starts.join(sources, starts["source"].eqNullSafe(sources["source"])).select(
        starts["source"].alias(source), F.col("kind").alias(f"{kind}_c"),
        F.col("part").alias(f"{part}_c"), "start", "source_size", "target")
    within = W.partitionBy(source_col, kind, part).orderBy(key, id_col, F.xxhash64(text_col))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = unit(F.concat(F.lit(f"{seed}|offset|"),
                           F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n"))))
    crossed = lambda r: F.floor(rate * r + offset)
    return (
        sized.withColumn(rank, F.row_number().over(within))
        .join(plan, F.col(source_col).eqNullSafe(F.col(source))
              & (F.col(kind) == F.col(f"{kind}_c")) & (F.col(part) == F.col(f"{part}_c")))
        .withColumn(rank, F.col(rank) + F.col("start"))
        .withColumn("copies", (crossed(F.col(rank)) - crossed(F.col(rank) - 1)).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select(*docs.columns, "size", "source_size", "target", "copies", "taken")
    )


def emitted(mixed: DataFrame) -> DataFrame:
    """One row for each copy."""
    return (mixed.filter(F.col("copies") > 0)
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM {docs}),
named AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM sized GROUP BY source),
leveled AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio,
         (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
          - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
         / sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST
                      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM named),
best AS (SELECT level FROM leveled WHERE level <= ratio ORDER BY ratio, level LIMIT 1),
targets AS (
  SELECT source, source_size,
         CASE WHEN (SELECT level FROM best) IS NULL THEN cap ELSE least(cap, (SELECT level FROM best) * weight) END AS target
  FROM leveled),
ranked AS (
  SELECT doc_id, source, size, row_number() OVER (PARTITION BY source
           ORDER BY lpad(CAST(length(bin(size)) AS VARCHAR), 2, '0') || substr(bin(size), 1, 5),
                    md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) AS r
  FROM sized),
rated AS (
  SELECT x.doc_id, x.size, x.source, t.source_size, t.target, r,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS e,
         CAST(('0x' || substr(md5('mix|offset|' || coalesce('s' || x.source, 'n')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM ranked x JOIN targets t ON x.source IS NOT DISTINCT FROM t.source)
"""

ORACLE_SQL = ORACLE.format(docs="documents") + """
SELECT doc_id, size, source_size, target,
       CAST(floor(e * r + u) - floor(e * (r - 1) + u) AS BIGINT) * size AS taken
FROM rated
"""


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return systematic_mix(docs).select("doc_id", "size", "source_size", "target", "taken")
