"""Writes as pure functions: old state and incoming rows give the new state."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthbook.operators.written import folder, kept


def fingerprints(rows: DataFrame, source: str = "source", order: str = "source_row") -> DataFrame:
    """rows plus ordinal and fingerprint.

    Equal entries of one source are told apart by their ordinal, so a second
    source that repeats them n times gives the same n fingerprints.
    """
    key = ["account_id", "posted_date", "amount_minor", "currency"]
    ordinal = F.row_number().over(W.partitionBy(source, *key).orderBy(order)) - 1
    parts = [F.lit("v1"), *(F.col(k).cast("string") for k in key), F.col("ordinal").cast("string")]
    return rows.withColumn("ordinal", ordinal).withColumn("fingerprint", F.sha2(F.concat_ws(chr(124), *parts), 256))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new plus outcome: inserted, or duplicate where old has the key."""
    have = old.select(*keys).distinct().withColumn("have", F.lit(True))
    return new.join(have, keys, "left").withColumn("outcome", F.when(F.col("have"), "duplicate").otherwise("inserted")).drop("have")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key: the last incoming one, else the last old one."""
    both = old.withColumn("incoming", F.lit(0)).unionByName(new.withColumn("incoming", F.lit(1)))
    last = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("incoming"), F.desc(order)))
    return both.withColumn("k", last).where("k = 1").drop("k", "incoming")


def upsert_guarded(old: DataFrame, new: DataFrame, keys: list[str], keep: Column) -> DataFrame:
    """Incoming rows replace old ones, save where keep (over the aliases old and new) holds."""
    on = reduce(and_, (F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys))
    joined = old.withColumn("here", F.lit(True)).alias("old").join(new.withColumn("here", F.lit(True)).alias("new"), on, "full_outer")
    stays = F.col("new.here").isNull() | (F.col("old.here").isNotNull() & F.coalesce(keep, F.lit(False)))
    return joined.select(*(F.when(stays, F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")).alias(c) for c in old.columns))


def versions(seen: DataFrame, keys: list[str], content: str, order: str, job: str | None = None) -> DataFrame:
    """seen, publications of files in order, plus status.

    Of a file that is not known yet: captured, or duplicate where its bytes are known from
    another file.  Of a known one: recovered_version where its job is older than the
    newest so far, which leaves the current version as it is; else unchanged or
    new_version against that one.  Without a job column none is ever older.
    """
    own = W.partitionBy(*keys).orderBy(order)
    before = own.rowsBetween(W.unboundedPreceding, -1)
    late = F.coalesce(F.col(job) < F.max(job).over(before), F.lit(False)) if job else F.lit(False)
    first = seen.groupBy(F.col(content).alias("_bytes")).agg(F.min(order).alias("_first"))
    marked = seen.withColumns({"_late": late, "_k": F.row_number().over(own)})
    current = F.last(F.when(~F.col("_late"), F.struct(F.col(content).alias("c"))), ignorenulls=True).over(before)
    joined = marked.withColumn("_current", current).join(first, F.col(content).eqNullSafe(F.col("_bytes")))
    status = (
        F.when(F.col("_k") == 1, F.when(F.col("_first") < F.col(order), "duplicate").otherwise("captured"))
        .when(F.col("_late"), "recovered_version").when(F.col("_current.c").eqNullSafe(F.col(content)), "unchanged").otherwise("new_version")
    )
    return joined.select(*seen.columns, status.alias("status"))


def latest_corrections(changes: DataFrame, keys: list[str], field: str, value: str, order: str, fields: list[str]) -> DataFrame:
    """The last value of each field, a column a field."""
    return changes.groupBy(*keys).agg(*(F.max_by(F.when(F.col(field) == f, F.col(value)), F.when(F.col(field) == f, F.col(order))).alias(f) for f in fields))


def closure(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of everything reachable from roots (id) over edges (parent, child), roots included, each once.

    One round a level, until a round finds nothing new; each round's finds are
    written beside the earlier ones, so plans stay small and cycles end.
    """
    spark = roots.sparkSession
    place = folder(spark)
    shape = roots.select("id").schema
    edges = kept(edges.select("parent", "child").where("parent is not null and child is not null").distinct())
    roots.select("id").where("id is not null").distinct().write.parquet(f"{place}/level=0")
    level = 0
    while True:
        front, seen = spark.read.schema(shape).parquet(f"{place}/level={level}"), spark.read.schema(shape).parquet(*(f"{place}/level={k}" for k in range(level + 1)))
        if front.isEmpty():
            return seen
        found = edges.join(front, edges["parent"] == front["id"], "left_semi").select(F.col("child").alias("id")).distinct()
        level += 1
        found.join(seen, "id", "left_anti").write.parquet(f"{place}/level={level}")
