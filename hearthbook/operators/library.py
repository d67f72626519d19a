"""The document library: current view, titles, folders, work lists and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest(rows: DataFrame, keys: list[str], order: list[str], *columns: str) -> DataFrame:
    """The columns of each key's newest row."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("row")).select(*keys, "row.*")


def title(merchant: Column, location: Column, description: Column) -> Column:
    """Merchant - Location - Description without missing parts; a description that repeats merchant or location is left out."""
    part = lambda c: F.nullif(F.trim(c), F.lit(""))
    repeats = F.coalesce(F.contains(F.lower(merchant), F.lower(description)), F.lit(False)) | F.coalesce(F.contains(F.lower(location), F.lower(description)), F.lit(False))
    return F.concat_ws(" - ", part(merchant), part(location), F.when(~repeats, part(description)))


def first_known(**columns: Column) -> Column:
    return F.coalesce(*columns.values())


def work(status: Column, text_status: Column, ledger_status: Column) -> Column:
    """Which list a document waits in: failed, needs_text, needs_review, ready_for_ledger, or none."""
    return F.when(status == "failed", "failed").when(text_status.isNull(), "needs_text").when(ledger_status == "needs_review", "needs_review").when(ledger_status.isNull(), "ready_for_ledger").otherwise("none")


def folder_counts(documents: DataFrame, folder: str = "folder", trashed: str = "trashed", waiting: str = "work") -> DataFrame:
    """One pass: documents per folder, in trash, and per work list."""
    alive = F.col(trashed) == 0
    lists = [F.sum((alive & (F.col(waiting) == w)).cast("int")).alias(w) for w in ("failed", "needs_text", "needs_review", "ready_for_ledger")]
    return documents.groupBy(folder).agg(F.sum(alive.cast("int")).alias("documents"), F.sum((~alive).cast("int")).alias("in_trash"), *lists)


def contains_text(query: str, *columns: Column) -> Column:
    """Case-blind, with no wildcards in the query."""
    return F.exists(F.array(*(F.lower(F.coalesce(c, F.lit(""))) for c in columns)), lambda c: F.contains(c, F.lit(query.lower())))


def job_history(**kinds: DataFrame) -> DataFrame:
    """Runs of all kinds (id, status, created_at) in one shape, newest first."""
    shaped = [frame.select(F.lit(kind).alias("kind"), "id", "status", "created_at") for kind, frame in kinds.items()]
    out = shaped[0]
    for more in shaped[1:]:
        out = out.unionByName(more)
    return out.orderBy(F.desc("created_at"), "kind", F.desc("id"))


def document_versions(versions: DataFrame, blobs: DataFrame) -> DataFrame:
    """Versions (doc_id, hash, captured) with their bytes' size, newest first."""
    return versions.join(blobs.select("hash", "bytes"), "hash").select("doc_id", "hash", "captured", "bytes").orderBy("doc_id", F.desc("captured"))


def with_folder(documents: DataFrame, folders: DataFrame, default: str = "Unfiled") -> DataFrame:
    """documents with the folder that replaced their old one; default for a name that nothing replaced."""
    return documents.join(folders.select(F.col("old").alias("folder"), "new"), "folder", "left").withColumn("folder", F.coalesce("new", F.lit(default))).drop("new")


def event_page(events: DataFrame, before: int | None, count: int = 100) -> DataFrame:
    """The newest events below an id, newest first."""
    older = events if before is None else events.where(F.col("event_id") < before)
    return older.orderBy(F.desc("event_id")).limit(count)


def filed(documents: DataFrame, commands: DataFrame) -> DataFrame:
    """documents (doc_id, folder, trashed) after commands (seq, doc_id, action, folder): move, trash, restore, each document's in order.

    A move of a trashed document is refused; trashing keeps the folder to restore to.
    """
    each = commands.where("action in ('move', 'trash', 'restore')").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "action", F.col("folder").alias("to")))).alias("said"))
    joined = documents.join(each, "doc_id", "left")
    start = F.struct(F.col("folder"), F.col("trashed").cast("boolean").alias("trashed"))
    after = F.aggregate(
        F.coalesce("said", F.array().cast("array<struct<seq:bigint,action:string,to:string>>")), start,
        lambda s, c: F.struct(F.when((c["action"] == "move") & ~s["trashed"] & c["to"].isNotNull(), c["to"]).otherwise(s["folder"]).alias("folder"), F.when(c["action"] == "trash", True).when(c["action"] == "restore", False).otherwise(s["trashed"]).alias("trashed")),
    )
    return joined.withColumn("after", after).select("doc_id", "after.folder", "after.trashed")


def facets(runs: DataFrame, *columns: str) -> DataFrame:
    """(facet, value, runs): what a list of runs can be narrowed by."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns)))
    return runs.select(each.alias("f")).select("f.*").where("value is not null").groupBy("facet", "value").agg(F.count("*").alias("runs"))


def history(rows: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """(key, changes): each record's changes in order."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("changes"))


def recovered(runs: DataFrame, to: str = "interrupted") -> DataFrame:
    """Runs that were under way when the process stopped."""
    return runs.withColumn("status", F.when(F.col("status").isin("queued", "running"), to).otherwise(F.col("status")))
