"""A training-data pipeline over ``documents``: each stage works on all that the one before kept.

toxicity           rejected documents go
near_duplicates    one document of each group of near-copies stays
repeated_text      byte strings of 100 bytes that also start earlier are cut out of the texts
mixing             sources are mixed to target weights: a document may go, stay or come twice
tokens             texts become token ids; one row per copy
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.llm import mixing, sentencepieces, simhash, suffix_dedup, toxicity
from trialweave.session import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; labels of held-out ids are not used."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs, model).filter(F.col("predicted") == 0).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: five words, similarity 0.8 or more."""
    return simhash.deduplicated(docs)


def cut_repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated byte strings; bytes of a character that was cut in two become U+FFFD."""
    cut = suffix_dedup.remove_repeats(docs)
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return (cut.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long"))
            .select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each copy that the mix takes of a document."""
    return mixing.emitted(mixing.systematic_mix(docs)).select(*docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with the end id last, and the text that they decode to."""
    import public_tokenizers

    coded = sentencepieces.encode_and_decode(
        docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_text", cut_repeated_text),
    ("mixing", mix_sources),
    ("tokens", to_tokens),
]

#: The model of the first stage and the fingerprints of the second have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
