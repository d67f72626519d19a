"""Corrections that users enter, and publications of extracted records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthbook.functions.dates import iso_date
from hearthbook.functions.text import normalize_name, squeezed
from hearthbook.operators.merge import insert_ignore
from hearthbook.operators.review import latest

# What users may correct of each record, each field's kind, and the label that its issues start with.
CORRECTABLE = {
    "receipt": {"purchase_date": ("date", "Purchase date"), "merchant": ("name", "Merchant"), "location": ("text", "Location")},
    "bill": {"issue_date": ("date", "Issue date"), "due_date": ("date", "Due date"), "provider": ("name", "Provider")},
    "income_record": {"pay_date": ("date", "Pay date"), "payer": ("name", "Payer or employer")},
}
MOST_TEXT, MOST_NAME = 60, 120


def correction_value(kind: Column, text: Column, ascii_only: bool = False) -> Column:
    """Struct (value, error) of an entered text: a full date, up to 60 characters, or a business name of up to 120 with a letter or digit; null clears."""
    entered = squeezed(text)
    name = normalize_name(entered, ascii_only)
    error = (
        F.when((kind == "date") & iso_date(entered).isNull(), "date").when((kind == "text") & (F.length(entered) > MOST_TEXT), "too long")
        .when((kind == "name") & ~F.length(entered).between(1, MOST_NAME), "name").when((kind == "name") & (name == ""), "name without letters")
    )
    value = F.when(kind == "name", name).otherwise(F.nullif(entered, F.lit("")))
    return F.struct(F.when(text.isNotNull() & error.isNull(), value).alias("value"), F.when(text.isNotNull(), error).alias("error"))


def _by_field(fields: dict[str, tuple[str, str]], place: int) -> Column:
    return F.create_map(*(F.lit(x) for field, said in fields.items() for x in (field, said[place])))


def correct(records: DataFrame, changes: DataFrame, record_type: str, key: str, ascii_only: bool = False) -> DataFrame:
    """records (key, issues, review_status, by_user, ...) plus corrected: a map of the last valid change of each field.

    changes are rows (key, seq, field, text); those of unknown fields or with an
    error are left out.  Issues that start with a corrected field's label go; a
    record that waited for review and has none left is verified, unless the user
    had decided on it.
    """
    fields = CORRECTABLE[record_type]
    kind = F.try_element_at(_by_field(fields, 0), F.col("field"))
    read = changes.withColumn("read", correction_value(kind, F.col("text"), ascii_only)).where(kind.isNotNull() & F.col("read.error").isNull())
    last = latest(read, [key, "field"], "seq")
    mine = last.groupBy(key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.col("read.value").alias("value"))))).alias("corrected"),
        F.collect_list(F.try_element_at(_by_field(fields, 1), F.col("field"))).alias("labels"),
    )
    joined = records.join(mine, key, "left")
    left = F.when(F.col("labels").isNull(), F.col("issues")).otherwise(F.filter("issues", lambda i: ~F.exists(F.col("labels"), lambda label: F.startswith(i, label))))
    cleared = F.col("labels").isNotNull() & (F.size(left) == 0) & (F.col("review_status") == "needs_review") & ~F.col("by_user")
    return joined.withColumn("review_status", F.when(cleared, "verified").otherwise(F.col("review_status"))).withColumn("issues", left).drop("labels")


def replace_children(old: DataFrame, new: DataFrame, written: DataFrame, key: str) -> DataFrame:
    """A parent's rows after publishing: those of the parents that were written are the new ones, others stay."""
    return old.join(written, key, "left_anti").unionByName(new.join(written, key, "left_semi"))


def publish_receipt(old: DataFrame, new: DataFrame, old_items: DataFrame, new_items: DataFrame, key: str = "receipt_id") -> tuple[DataFrame, DataFrame]:
    """(receipts with outcome, items): a receipt that the user decided on stays with its items, any other is rewritten with all of its items."""
    had = old.select(key, "by_user")
    told = new.join(had, key, "left").withColumn("outcome", F.when(F.col("by_user"), "kept_reviewed").otherwise("published"))
    written = told.where("outcome = 'published'").select(key)
    same = [c for c in new.columns if c in old.columns]
    kept = old.join(written, key, "left_anti").select(*same).withColumn("outcome", F.lit(None).cast("string"))
    kept = kept.join(told.select(key, F.col("outcome").alias("told")), key, "left").withColumn("outcome", F.coalesce("told", F.lit("untouched"))).drop("told")
    return kept.unionByName(told.where("outcome = 'published'").select(*same, "outcome")), replace_children(old_items, new_items, written, key)


def stale_rows(rows: DataFrame, evidence: DataFrame, statements: DataFrame) -> DataFrame:
    """Extracted rows of the statements (statement_id) being rewritten that nobody decided on and no other source supports.

    evidence is rows (transaction_id, source_key); what an extraction left starts with extraction:.
    """
    open_ = F.col("review_status").isin("proposed", "needs_review") | (F.col("review_source") == "automatic")
    asked = rows.where((F.col("origin") == "extraction") & F.coalesce(open_, F.lit(False))).join(statements, "statement_id", "left_semi")
    return asked.join(evidence.where(~F.startswith("source_key", F.lit("extraction:"))), "transaction_id", "left_anti")


def publish_statement(rows: DataFrame, evidence: DataFrame, statements: DataFrame, accounts: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, new rows with outcome) of statements (statement_id, account_id, currency, by_user) published with new (statement_id, account_id, fingerprint, ...).

    A statement in another currency than its account is refused, one that the user
    decided on is kept; of the others stale rows go, and new rows whose fingerprint
    the account has are duplicates.
    """
    told = statements.join(accounts.select("account_id", F.col("currency").alias("of_account")), "account_id", "left")
    outcome = F.when(F.coalesce(F.col("of_account") != F.col("currency"), F.lit(False)), "refused").when(F.col("by_user"), "kept_reviewed").otherwise("published")
    told = told.select("statement_id", outcome.alias("statement_outcome"))
    written = told.where("statement_outcome = 'published'").select("statement_id")
    stays = rows.join(stale_rows(rows, evidence, written).select("transaction_id"), "transaction_id", "left_anti")
    entered = insert_ignore(stays, new.join(written, "statement_id", "left_semi"), ["account_id", "fingerprint"])
    others = new.join(told.where("statement_outcome <> 'published'"), "statement_id").withColumnRenamed("statement_outcome", "outcome")
    return stays, entered.unionByName(others)


def evidence_of(records: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """records' keys with their distinct sources in order, and how many there are."""
    found = evidence.groupBy(key).agg(F.array_sort(F.collect_set("source_key")).alias("sources"))
    return records.select(key).join(found, key, "left").select(key, F.coalesce("sources", F.array().cast("array<string>")).alias("sources")).withColumn("supported_by", F.size("sources"))
