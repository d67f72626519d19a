"""Search by words over several tables: postings that inserts keep up, read by word.

``postings`` is a table word -> (kind, id) and ``vocabulary`` one of its distinct
words, both partitioned by a hash of the word and sorted by it inside.  A question reads the vocabulary,
which grows with the language and not with the records, and of the postings only the
parts that its words fall in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthbook.operators.written import exists

#: Parts of either table, and the words that a question may ask for.
PARTS, MOST_WORDS = 32, 8


def _part(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(PARTS)).cast("int")


def words(text: Column) -> Column:
    """Distinct lower-case runs of anything but white space; none of null."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""))


def insert(target: str, kind: str, rows: DataFrame, id_column: str, *texts: str) -> None:
    """Adds rows' words under (kind, id); rows must be new to the target.  Only the vocabulary's parts that new words fall in are read."""
    spark = rows.sparkSession
    text = F.concat_ws(" ", *texts)
    posted = rows.select(F.explode(words(text)).alias("word"), F.lit(kind).alias("kind"), F.col(id_column).cast("string").alias("id")).withColumn("part", _part(F.col("word")))
    # one task a part writes it, save where adaptive execution splits a part of many rows
    posted.hint("rebalance", "part").sortWithinPartitions("part", "word").write.mode("append").partitionBy("part").parquet(f"{target}/postings")
    fresh = posted.select("word", "part").distinct()
    if exists(spark, f"{target}/vocabulary"):
        fresh = fresh.join(spark.read.parquet(f"{target}/vocabulary").select("word", "part"), ["word", "part"], "left_anti")
    fresh.hint("rebalance", "part").write.mode("append").partitionBy("part").parquet(f"{target}/vocabulary")


def find(spark: SparkSession, target: str, question: str) -> DataFrame:
    """(kind, id) of the records in which every asked word stands, whole or inside a longer word; eight words at most, none finds nothing."""
    known, postings = spark.read.parquet(f"{target}/vocabulary"), spark.read.parquet(f"{target}/postings")
    asked = list(dict.fromkeys(question.lower().split()))[:MOST_WORDS]
    sides = []
    for word in asked:
        meant = known.where(F.contains("word", F.lit(word)))
        parts = [r["part"] for r in meant.select("part").distinct().collect()]  # PARTS at most
        sides.append(postings.where(F.col("part").isin(parts)).join(meant.select("word"), "word", "left_semi").select("kind", "id").distinct())
    return reduce(lambda a, b: a.join(b, ["kind", "id"], "left_semi"), sides) if sides else postings.select("kind", "id").limit(0)
