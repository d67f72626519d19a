"""Mixing sources to target weights by weighted fair queueing.

Sources share ``share`` times all words by weight; none gets more than ``most``
times its own words, and what it cannot take goes to the others by weight (water
filling).  Inside a source the documents stand in a hashed order, repeated pass
after pass.  A copy's virtual finish time is the words of its source up to its
end, divided by the source's target.  All copies are range-sorted by that time
and taken until a running total over the sorted ranges has used up the budget.
A copy in service at virtual time 1, when every source has had its target, is
queued as two: the words served by then, and those after.

Running totals are taken per range of a range-sorted table, on top of the totals
of the ranges before, so no task holds a source, an id or a moment of time.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthbook.llm._store import Scratch

WORD = r"[^\x20\x09-\x0D]+"


def running(frame: DataFrame, by: list[str], order: list[str], totals: dict[str, str], scratch: Scratch, name: str) -> DataFrame:
    """frame plus, per name in totals, the sum of a column over the earlier rows of its group in order.

    by and order have no nulls.  The sorted ranges are written, so a lost executor deals no row anew.
    """
    ranged = scratch.keep(name, frame.repartitionByRange(*by, *order).withColumn("range", F.spark_partition_id()))
    parts = ranged.groupBy(*by, "range").agg(*(F.sum(c).alias(t) for t, c in totals.items()))
    earlier = W.partitionBy(*by).orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # over ranges, not rows
    ahead = parts.select(*by, "range", *(F.coalesce(F.sum(t).over(earlier), F.lit(0)).alias(f"ahead_{t}") for t in totals))
    inside = W.partitionBy(*by, "range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = ranged.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(t) for t, c in totals.items())).join(ahead, [*by, "range"])
    return summed.select(*frame.columns, *((F.col(t) + F.col(f"ahead_{t}")).alias(t) for t in totals))


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float, scratch: Scratch) -> DataFrame:
    """sizes (source_key, source_size), a row per source, keys in their order -> plus weight and target."""
    ranked = running(sizes.withColumn("one", F.lit(1)), [], ["source_key"], {"rank": "one"}, scratch, "ranked")
    weighed = ranked.select("source_key", "source_size", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).alias("weight"))
    whole = weighed.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    if whole["words"] is None:
        return weighed.withColumn("target", F.lit(0.0))
    capped = weighed.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("fill", F.col("cap") / F.col("weight"))
    filled = running(capped, [], ["fill", "source_key"], {"words_before": "source_size", "weight_before": "weight"}, scratch, "filled")
    level = (F.lit(share) * whole["words"] - F.lit(most) * F.col("words_before")) / (F.lit(whole["weight"]) - F.col("weight_before"))
    free = filled.withColumn("level", level).where("fill > level").agg(F.min_by("level", F.struct("fill", "source_key")).alias("level")).first()["level"]
    target = F.col("cap") if free is None else F.least("cap", F.lit(free) * F.col("weight"))
    return filled.select("source_key", "source_size", "weight", target.alias("target"))


def _copies(rows: DataFrame, weights: tuple[int, ...], share: float, most: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """rows (row, source_key, hashed, again, size) -> (source_key, source_size, target) per source, and the mix's copies.

    The copies are (row, pass, virtual_finish, copy_words): those that the budget lets through, the last cut to it.
    """
    sizes = scratch.keep("sizes", rows.groupBy("source_key").agg(F.sum("size").alias("source_size")))
    plan = scratch.keep("plan", targets(sizes, weights, share, most, scratch))
    placed = running(rows.where("size > 0"), ["source_key"], ["hashed", "size", "again", "row"], {"before": "size"}, scratch, "placed").join(plan, "source_key")
    queued = placed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(ceil(most) - 1)))).withColumn("start", F.col("pass") * F.col("source_size") + F.col("before"))
    served = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - F.col("start")))  # by virtual time 1
    piece = lambda start, words: F.struct(((start + words) / F.col("target")).alias("virtual_finish"), words.alias("words"))
    queued = queued.withColumn("piece", F.explode(F.array(piece(F.col("start"), served), piece(F.col("start") + served, F.col("size") - served)))).where("piece.words > 0")
    queued = queued.select("row", "source_key", "hashed", "pass", "piece.virtual_finish", "piece.words")
    sorted_ = running(queued, [], ["virtual_finish", "source_key", "hashed", "row", "pass"], {"total": "words"}, scratch, "queued")
    budget = plan.agg(F.coalesce(F.sum(F.floor("target")), F.lit(0)).alias("words")).first()["words"]
    taken = F.least(F.col("words"), F.lit(budget) - F.col("total"))
    return plan, sorted_.where(F.col("total") < budget).select("row", "pass", "virtual_finish", taken.alias("copy_words"))


def _rows(docs: DataFrame) -> list[Column]:
    """What the queue needs of docs: a key in the order of sources, null last, and a hashed place, so that reruns agree."""
    return [
        F.coalesce(F.concat(F.lit("0"), F.col("source").cast("string")), F.lit("1")).alias("source_key"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("hashed"),
        F.xxhash64("text").alias("again"),
        F.coalesce(F.expr(f"regexp_count(text, r'{WORD}')"), F.lit(0)).cast("long").alias("size"),
    ]


def decide(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """docs (doc_id, text, source, ...) -> doc_id, source, size, source_size, target, taken; one row per input row.

    size counts the text's words (null: 0), taken the words that the mix takes of
    it, over all passes.  A null source is a source of its own, last in order.
    Rows that repeat are taken one by one; documents without words are never taken.
    Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.keep("rows", docs.select("doc_id", "source", *_rows(docs), F.monotonically_increasing_id().alias("row")))
    plan, copies = _copies(rows.select("row", "source_key", "hashed", "again", "size"), weights, share, most, scratch)
    taken = copies.groupBy("row").agg(F.sum("copy_words").alias("taken"))
    joined = rows.join(taken, "row", "left").join(plan, "source_key")
    decided = scratch.keep("decided", joined.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))
    scratch.only("decided")
    return decided


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix itself: a row per copy taken, range-sorted by virtual finish time.

    The columns of docs and, last, mix_size, mix_pass, mix_words and
    mix_finish; columns of those names are replaced.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    own = [c for c in docs.columns if c not in ("mix_size", "mix_pass", "mix_words", "mix_finish")]
    # written, so that a text keeps its number; only numbers and sizes are queued
    held = scratch.keep("docs", docs.select(F.struct(*own).alias("doc"), *_rows(docs), F.monotonically_increasing_id().alias("row")))
    _, copies = _copies(held.select("row", "source_key", "hashed", "again", "size"), weights, share, most, scratch)
    copies = scratch.keep("copies", copies.select("row", F.col("pass").alias("mix_pass"), F.col("copy_words").alias("mix_words"), F.col("virtual_finish").alias("mix_finish")))
    scratch.only("docs", "copies")
    full = held.select("row", "doc", F.col("size").alias("mix_size")).join(copies, "row")
    ordered = full.repartitionByRange("mix_finish", "row", "mix_pass").sortWithinPartitions("mix_finish", "row", "mix_pass")
    return ordered.select("doc.*", "mix_size", "mix_pass", "mix_words", "mix_finish")
