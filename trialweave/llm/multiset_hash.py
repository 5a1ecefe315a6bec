"""Homomorphic multiset hash of a document's paragraphs.

A paragraph is hashed to a wide vector, and a document's fingerprint is the sum of the vectors of
its paragraphs, every lane modulo a power of two. Order does not matter, and a paragraph is
inserted or deleted by adding or subtracting its vector (``combined``). The vector has

* 16 lanes modulo 2^32 cut from the paragraph's SHA-512, for equality;
* 126 lanes modulo 2^32 and a count, for likeness: each pair of neighbouring words of the paragraph
  adds one hash bit to each lane. Twice a lane less the count is a sum of random signs, and the
  products of such sums over two documents estimate how many pairs they share.

Bits are summed three lanes to a long, 21 bits apart; pieces of 2^20 pairs are unpacked before
they are added up, so no lane runs into the next whatever the length of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialweave.llm.common import WORD, text_of
from trialweave.session import written

EXACT, EXACT_POWER = 16, 32
HASHES, STEP, PACKED = 2, 21, 3
LANES, LANE_POWER = HASHES * STEP * PACKED, 32
COUNT_POWER = 40
PIECE_BITS = 20
#: Stands for a null id, which is thus the same as this id.
NO_ID = -(1 << 63)


def _modulo(x: Column, power: int) -> Column:
    return x.bitwiseAND(F.lit((1 << power) - 1))


def exact_lanes(text: Column) -> Column:
    """Lanes of all paragraphs, summed modulo 2^32."""
    hashed = F.transform(F.split(text, "\n"), lambda p: F.sha2(p, 512))

    def lane(i: int) -> Column:
        cut = lambda h: F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long")
        return F.aggregate(hashed, F.lit(0).cast("long"),
                           lambda total, h: _modulo(total + cut(h), EXACT_POWER))

    return F.array(*[lane(i) for i in range(EXACT)])


def word_pairs(text: Column) -> Column:
    """A hash for each word of each paragraph together with the word before it."""
    words = F.transform(F.split(text, "\n"), lambda p: F.regexp_extract_all(p, F.lit(WORD), F.lit(0)))
    return F.flatten(F.transform(words, lambda a: F.transform(
        a, lambda w, i: F.xxhash64(w, F.get(a, i - 1)))))


def fingerprints(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys``, ``exact`` array of 16 longs, ``lanes`` array of 126 longs, ``pairs`` long.

    ``keys`` must identify a row. Where the rows are already dealt by some of the keys, nothing
    is shuffled.
    """
    mask = sum(1 << (STEP * i) for i in range(PACKED))
    pair = F.col("_pair")
    hashed = [pair if i == 0 else F.xxhash64(pair, F.lit(i)) for i in range(HASHES)]
    exact = [f"_e{i}" for i in range(EXACT)]
    sums = [f"_s{i}_{j}" for i in range(HASHES) for j in range(STEP)]
    pieces = (
        texts.withColumn("_x", exact_lanes(F.col(text_col)))
        .select(*keys, *[F.col("_x")[i].alias(c) for i, c in enumerate(exact)],
                F.posexplode_outer(word_pairs(F.col(text_col))).alias("_pos", "_pair"))
        .groupBy(*keys, F.shiftright(F.coalesce("_pos", F.lit(0)), PIECE_BITS).alias("_piece"))
        .agg(*[F.max(c).alias(c) for c in exact], F.count("_pair").alias("_n"),
             *[F.coalesce(F.sum(F.shiftrightunsigned(hashed[i], j).bitwiseAND(F.lit(mask))), F.lit(0))
               .alias(f"_s{i}_{j}") for i in range(HASHES) for j in range(STEP)])
    )
    unpacked = F.array(*[
        F.shiftright(F.col(c), STEP * k).bitwiseAND(F.lit((1 << STEP) - 1))
        for c in sums for k in range(PACKED)
    ])
    # A piece for each 2^20 pairs of words: the list of a document is as long as its text.
    return (
        pieces.select(*keys, F.array(*exact).alias("exact"), "_n", unpacked.alias("_lanes"))
        .groupBy(*keys)
        .agg(F.first("exact").alias("exact"), _modulo(F.sum("_n"), COUNT_POWER).alias("pairs"),
             F.collect_list("_lanes").alias("_all"))
        .select(*keys, "exact", "pairs", F.aggregate(
            F.slice("_all", 2, F.size("_all")), F.element_at("_all", 1),
            lambda a, b: F.zip_with(a, b, lambda x, y: x + y),
            lambda a: F.transform(a, lambda x: _modulo(x, LANE_POWER))).alias("lanes"))
    )


def combined(a: dict[str, Column], b: dict[str, Column], sign: int = 1) -> dict[str, Column]:
    """The fingerprint after inserting (``sign`` 1) or deleting (-1) the paragraphs of ``b``."""
    add = lambda x, y: x + y if sign > 0 else x - y
    return {
        "exact": F.zip_with(a["exact"], b["exact"], lambda x, y: _modulo(add(x, y), EXACT_POWER)),
        "lanes": F.zip_with(a["lanes"], b["lanes"], lambda x, y: _modulo(add(x, y), LANE_POWER)),
        "pairs": _modulo(add(a["pairs"], b["pairs"]), COUNT_POWER),
    }


def fingerprint_string(exact: Column, lanes: Column, pairs: Column) -> Column:
    digits = lambda x, n: F.lower(F.lpad(F.hex(x), n, "0"))
    return F.concat(
        F.array_join(F.transform(exact, lambda x: digits(x, EXACT_POWER // 4)), ""),
        F.array_join(F.transform(lanes, lambda x: digits(x, LANE_POWER // 4)), ""),
        digits(pairs, COUNT_POWER // 4))


def signed_lanes(lanes: Column, pairs: Column) -> Column:
    """Sums of signs, taken back from the residue nearest to zero."""
    half = 1 << (LANE_POWER - 1)
    return F.transform(lanes, lambda c: (
        _modulo(c.cast("long") * 2 - pairs + half, LANE_POWER) - half).cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def likeness(a: Column, b: Column, equal: Column) -> Column:
    """Twice the shared weight over both weights, from 0 to 1; exactly 1 for equal fingerprints."""
    both = _dot(a, a) + _dot(b, b)
    return (F.when(equal, 1.0).when(both == 0, 0.0)
            .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * _dot(a, b) / both))))


def _near_zero(x: Column, power: int) -> Column:
    half = 1 << (power - 1)
    return _modulo(x + half, power) - half


def stored(exact: Column, lanes: Column, pairs: Column) -> Column:
    """A fingerprint as it is written and exchanged, in few bytes.

    A lane is kept as its distance from half the count, which is small for random signs: in two bytes
    (``small``) where all lanes of the fingerprint fit, else in four (``wide``).
    """
    off = F.transform(lanes, lambda x: _near_zero(x - F.shiftright(pairs, 1), LANE_POWER))
    fits = F.forall(off, lambda x: F.abs(x) < (1 << 15))
    return F.struct(
        F.transform(exact, lambda x: _near_zero(x, EXACT_POWER).cast("int")).alias("exact"),
        F.when(fits, F.transform(off, lambda x: x.cast("short"))).alias("small"),
        F.when(~fits, F.transform(off, lambda x: x.cast("int"))).alias("wide"), pairs.alias("pairs"))


def restored(name: str) -> tuple[Column, Column, Column]:
    """(exact, lanes, pairs) of the ``stored`` fingerprint in column ``name``."""
    exact, small, wide, pairs = [F.col(f"{name}.{x}") for x in ("exact", "small", "wide", "pairs")]
    off = F.coalesce(F.transform(small, lambda x: x.cast("int")), wide)
    return (F.transform(exact, lambda x: _modulo(x.cast("long"), EXACT_POWER)),
            F.transform(off, lambda x: _modulo(x.cast("long") + F.shiftright(pairs, 1), LANE_POWER)), pairs)


def neighbours(docs: DataFrame) -> DataFrame:
    """(k, h, n_chars, n, next, prev): the place of each distinct row in descending (k, h).

    Keys are range-partitioned and written with their partition; each partition is put in order
    on its own, and one row per partition ties the ends together.
    """
    keys = written(
        docs.groupBy("k", "h").agg(F.count(F.lit(1)).alias("n"),
                                   F.max(F.char_length("text").cast("long")).alias("n_chars"))
        .repartitionByRange("k", "h").withColumn("pid", F.spark_partition_id()), "hash-keys")
    row = F.struct("k", "h", "n_chars")
    chain = W.partitionBy().orderBy("pid")
    whole = W.partitionBy()
    ends = (
        keys.groupBy("pid").agg(F.min(row).alias("lo"), F.max(row).alias("hi"))
        .select("pid",
                F.coalesce(F.lag("hi").over(chain), F.max("hi").over(whole)).alias("after"),
                F.coalesce(F.lead("lo").over(chain), F.min("lo").over(whole)).alias("ahead"))
    )
    down = W.partitionBy("pid").orderBy(F.col("k").desc(), F.col("h").desc())
    return (
        keys.withColumn("next", F.lead(row).over(down)).withColumn("prev", F.lag(row).over(down))
        .join(ends, "pid")
        .select("k", "h", "n", "n_chars", F.coalesce("next", "after").alias("next"),
                F.coalesce("prev", "ahead").alias("prev"))
    )


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """For each row of (doc_id, text): fingerprints of the text and of its edited form.

    Edited: the last floor(n/2) code points give way to the first as many of the next document in
    descending doc_id, the first following the last. Null texts are empty. Rows equal in doc_id
    and text share one place in the order and each give a row; rows of one doc_id with different
    texts are in the order of their hashes; a null doc_id comes after all others. An only document
    is followed by itself. Other columns are left out.
    """
    rows = docs.select(F.col("doc_id"), text_of().alias("text")).select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("k"),
        F.xxhash64("text", F.col("doc_id").isNull()).alias("h"), "text")
    places = neighbours(rows)
    # Both uses of this read the same columns, so that the texts are exchanged once.
    placed = rows.groupBy("k", "h").agg(F.max("text").alias("text")).join(places, ["k", "h"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    heads = placed.select(
        F.col("prev.k").alias("k"), F.col("prev.h").alias("h"),
        F.expr("substring(text, 1, int(floor(prev.n_chars / 2)))").alias("head"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.col("head"))
    both = (
        placed.join(heads, ["k", "h"])
        .withColumn("_edited", edited)
        .select("k", "h", "n", "n_chars", F.col("next.k").alias("nk"),
                F.col("next.h").alias("nh"), F.sha2("_edited", 256).alias("edited_sha256"),
                F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")),
                                  F.struct(F.lit(1).alias("kind"), F.col("_edited").alias("text")))).alias("_t"))
        .select("*", F.col("_t.kind").alias("kind"), F.col("_t.text").alias("_text")).drop("_t")
    )
    keys = ["k", "h", "n", "n_chars", "nk", "nh", "edited_sha256"]
    print_ = stored(F.col("exact"), F.col("lanes"), F.col("pairs"))
    # Rows are dealt by (k, h) since the first exchange, so both aggregations stay in place.
    prints = written(
        fingerprints(both, [*keys, "kind"], "_text").groupBy(*keys).agg(
            F.first(F.when(F.col("kind") == 0, print_), True).alias("own"),
            F.first(F.when(F.col("kind") == 1, print_), True).alias("edited")),
        "multiset-hashes", codec="zstd")
    following = prints.select(F.col("k").alias("nk"), F.col("h").alias("nh"), F.col("own").alias("following"))
    lanes = lambda c: signed_lanes(*restored(c)[1:])
    text = lambda c: fingerprint_string(*restored(c))
    return (
        prints.join(following, ["nk", "nh"])
        .withColumn("doc_id", F.when(F.col("k") != NO_ID, F.col("k")))
        .withColumns({f"_{c}": lanes(c) for c in ("own", "edited", "following")})
        .select("doc_id", "n_chars", "edited_sha256", text("own").alias("fingerprint"),
                text("edited").alias("edited_fingerprint"),
                likeness(F.col("_own"), F.col("_edited"), F.col("own") == F.col("edited"))
                .alias("near_edited"),
                likeness(F.col("_own"), F.col("_following"), F.col("own") == F.col("following"))
                .alias("near_next"),
                F.explode(F.expr("sequence(1L, n)")).alias("_copy"))
        .drop("_copy")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
