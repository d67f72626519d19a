"""Documents through five corpus operators, one written table after another.

Toxic documents go, one document of each near-duplicate group stays, repeated
passages are cut, sources are mixed to their weights, and the mix is packed.
Each stage takes (spark, docs, sf_dir); all but the last return the columns of
documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthbook.llm import mixing, packing, toxicity
from hearthbook.llm._store import Scratch
from hearthbook.llm.near_dedup import one_of_each
from hearthbook.llm.span_dedup import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on all labels, scores below 0.3.

    Each row is judged by its text alone, repeated rows alike; a null or empty text, or a
    null doc_id, is scored like any other.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return toxicity.score(docs.select(*COLUMNS), model).where(F.col("score") < TOXIC).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8 or more.

    Of a group the row with the least doc_id stays, nulls last; of repeated rows one.  Rows
    without words are in no group and all stay.
    """
    return one_of_each(docs.select(*COLUMNS), width=5, percent=80)


def span_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand in an earlier one; those with nothing left go.

    Earlier is by doc_id, null first; rows alike in doc_id and text keep and lose the same.
    Rows that lose nothing stay as they are, null and empty texts among them.
    """
    cut = remove_repeats(docs.select(*COLUMNS)).where(r"n_removed = 0 or text rlike '[^ \\t-\\r]'")
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, a row per copy of which half or more is taken, in the order of virtual finish times.

    Repeated rows are taken one by one; a null source is a source, the last; rows without
    words are never taken; of equal finish times sources and hashed doc_ids decide.
    """
    return mixing.mix(docs.select(*COLUMNS)).where("2 * mix_words >= mix_size").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens.

    Every row is packed as often as it stands; a null or empty text is its end token alone.
    """
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as vocabulary:
        return packing.pack(docs, vocabulary.read())


STAGES = [("toxicity", drop_toxic), ("near_dedup", near_dedup), ("span_dedup", span_dedup), ("mixing", mix_sources), ("packing", pack)]
#: Trained models, sampled pivots and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
