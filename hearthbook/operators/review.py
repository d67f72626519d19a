"""Reviews and publications: user decisions, guarded writes, issues and the queue of open questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANK = {"rejected": 0, "proposed": 1, "needs_review": 1, "verified": 2}


def latest(commands: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """The last command of each record."""
    place = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    return commands.withColumn("k", place).where("k = 1").drop("k")


def apply_status(records: DataFrame, commands: DataFrame, key: str, order: str) -> DataFrame:
    """records with the status of the last command on each, and whether the user set it."""
    last = latest(commands, key, order).select(key, F.col("status").alias("decided"))
    joined = records.join(last, key, "left")
    return joined.withColumn("review_status", F.coalesce("decided", "review_status")).withColumn("by_user", F.col("decided").isNotNull()).drop("decided")


def spread_to_rows(rows: DataFrame, statements: DataFrame) -> DataFrame:
    """Extracted rows nobody decided take their statement's decision."""
    decided = statements.where("review_status in ('verified', 'rejected')").select("statement_id", F.col("review_status").alias("from_statement"))
    open_row = (F.col("origin") == "extraction") & F.col("review_status").isin("proposed", "needs_review") & F.col("from_statement").isNotNull()
    return rows.join(decided, "statement_id", "left").withColumn("review_status", F.when(open_row, F.col("from_statement")).otherwise(F.col("review_status"))).drop("from_statement")


def publish(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, amount_minor, outcome): extracted values replace old ones unless the user verified or rejected them."""
    both = old.select(key, F.col("amount_minor").alias("had"), "by_user").join(new.select(key, F.col("amount_minor").alias("got")), key, "full_outer")
    kept = F.coalesce("by_user", F.lit(False))
    outcome = F.when(F.col("had").isNull(), "created").when(F.col("got").isNull(), "untouched").when(kept, "kept_reviewed").otherwise("replaced")
    return both.select(key, F.when(outcome.isin("untouched", "kept_reviewed"), F.col("had")).otherwise(F.col("got")).alias("amount_minor"), outcome.alias("outcome"))


def publish_assets(old: DataFrame, new: DataFrame) -> DataFrame:
    """(account_id, value_minor, as_of, outcome): a newer statement proposes again; an older one changes nothing."""
    o = old.select("account_id", F.col("value_minor").alias("had"), F.col("as_of").alias("had_on"), "by_user")
    joined = o.join(new.select("account_id", F.col("value_minor").alias("got"), F.col("as_of").alias("got_on")), "account_id", "full_outer")
    outcome = (
        F.when(F.col("had_on").isNull(), "created").when(F.col("got_on").isNull(), "untouched").when(F.col("got_on") < F.col("had_on"), "kept_newer")
        .when((F.col("got_on") == F.col("had_on")) & F.coalesce("by_user", F.lit(False)), "kept_reviewed").otherwise("proposed")
    )
    new_one = outcome.isin("created", "proposed")
    return joined.select("account_id", F.when(new_one, F.col("got")).otherwise(F.col("had")).alias("value_minor"), F.when(new_one, F.col("got_on")).otherwise(F.col("had_on")).alias("as_of"), outcome.alias("outcome"))


def merge_links(links: DataFrame, keys: list[str]) -> DataFrame:
    """One link a pair: a user's choice beats a proposal, the first proposal beats later ones."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("by_user"), "seq"))
    return links.withColumn("k", place).where("k = 1").drop("k")


def reconciliation_status(receipts: DataFrame, links: DataFrame, issues: DataFrame) -> DataFrame:
    """(receipt_id, status): matched, proposed, ambiguous or unmatched."""
    flags = links.where("review_status <> 'rejected'").groupBy("receipt_id").agg(F.max((F.col("review_status") == "verified").cast("int")).alias("verified"))
    asked = issues.select("receipt_id").distinct().withColumn("asked", F.lit(True))
    joined = receipts.select("receipt_id").join(flags, "receipt_id", "left").join(asked, "receipt_id", "left")
    return joined.select("receipt_id", F.when(F.col("verified") == 1, "matched").when(F.col("verified") == 0, "proposed").when(F.col("asked"), "ambiguous").otherwise("unmatched").alias("status"))


def earliest_link(postings: DataFrame, links: DataFrame) -> DataFrame:
    """postings with the receipt of their earliest link that is not rejected."""
    first = links.where("review_status <> 'rejected'").groupBy("posting_id").agg(F.min_by("receipt_id", "link_id").alias("receipt_id"))
    return postings.join(first, "posting_id", "left")


def reasons(**checks: Column) -> Column:
    """Names of the checks that hold, in order: why a record cannot verify itself."""
    return F.array_compact(F.array(*(F.when(F.coalesce(check, F.lit(False)), F.lit(name)) for name, check in checks.items())))


def publish_decision(currency: Column, institution: Column, why: Column) -> Column:
    """blocked without a currency or an institution, needs_review for any reason, else verified."""
    return F.when(currency.isNull() | institution.isNull(), "blocked").when(F.size(why) > 0, "needs_review").otherwise("verified")


def queue(receipts: DataFrame, bills: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, id, status) of everything that waits for the user."""
    waiting = lambda f, kind, key: f.where("review_status in ('proposed', 'needs_review')").select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.col("review_status").alias("status"))
    return waiting(receipts, "receipt", "receipt_id").unionByName(waiting(bills, "bill", "bill_id")).unionByName(waiting(links, "link", "link_id"))
