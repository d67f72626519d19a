"""State changes as functions of the current state and a table of commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthbook.operators.review import latest

# One-tap answers, their event, days before today and precision in days.
ANSWERS = {"still_have": ("still_have", 0, 0), "finished_today": ("finished", 0, 0), "finished_this_week": ("finished", 3, 3), "thrown_out": ("thrown_out", 0, 0), "thrown_out_this_week": ("thrown_out", 3, 3)}


def set_category(rows: DataFrame, commands: DataFrame, by_rule: DataFrame) -> DataFrame:
    """(transaction_id, category, source): a hand-set category wins, a cleared one goes back to the rules, else rules, else as it was."""
    last = latest(commands, "transaction_id", "seq").select("transaction_id", F.col("category").alias("hand"), F.lit(True).alias("named"))
    ruled = by_rule.select("transaction_id", F.col("category").alias("rule"))
    joined = rows.join(last, "transaction_id", "left").join(ruled, "transaction_id", "left")
    source = F.when(F.col("hand").isNotNull(), "user").when(F.col("rule").isNotNull(), "rule").when(F.col("named"), "none").otherwise("import")
    return joined.select("transaction_id", F.when(source == "user", F.col("hand")).when(source == "rule", F.col("rule")).when(source == "import", F.col("category")).alias("category"), source.alias("source"))


def changed(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """How many rows have another value, nulls included."""
    pairs = before.select(key, F.col(value).alias("x")).join(after.select(key, F.col(value).alias("y")), key)
    return pairs.where(~F.col("x").eqNullSafe(F.col("y"))).agg(F.count("*").alias("changed"))


def bill_payment(bills: DataFrame, commands: DataFrame) -> DataFrame:
    """bills with payment_status and payment_id of the last valid command: paid needs a payment of the amount or none at all."""
    last = latest(commands, "bill_id", "seq").select("bill_id", F.col("status").alias("said"), F.col("payment_id").alias("by"), F.col("paid_minor"))
    joined = bills.join(last, "bill_id", "left")
    valid = F.col("said").isNotNull() & (F.col("by").isNull() | ((F.col("said") == "paid") & (F.col("paid_minor") == -F.col("amount_due_minor"))))
    return joined.select("bill_id", F.when(valid, F.col("said")).otherwise(F.col("payment_status")).alias("payment_status"), F.when(valid, F.col("by")).alias("payment_id"))


def find_or_create(accounts: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (institution, account_type, currency) -> outcome found, created, or conflict where the currency differs."""
    have = accounts.groupBy("institution", "account_type").agg(F.min("currency").alias("has"))
    joined = wanted.distinct().join(have, ["institution", "account_type"], "left")
    return joined.select("institution", "account_type", "currency", F.when(F.col("has").isNull(), "created").when(F.col("has") == F.col("currency"), "found").otherwise("conflict").alias("outcome"))


def review_links(links: DataFrame, commands: DataFrame) -> DataFrame:
    """links with the last decision on each, and whether a rejection gives the rows their own types back."""
    last = latest(commands, "link_id", "seq").select("link_id", F.col("status").alias("decided"))
    joined = links.join(last, "link_id", "left")
    return joined.select("link_id", F.coalesce("decided", "review_status").alias("review_status"), F.coalesce((F.col("decided") == "rejected") & (F.col("review_status") != "rejected"), F.lit(False)).alias("restores"))


def answer(kind: Column, today: Column, bought_on: Column) -> Column:
    """Struct (event, day, precision) of a one-tap answer; a day never lies before the purchase."""
    table = F.create_map(*(x for k, (event, days, precision) in ANSWERS.items() for x in (F.lit(k), F.struct(F.lit(event).alias("event"), F.lit(days).alias("days"), F.lit(precision).alias("precision")))))
    found = F.try_element_at(table, kind)
    return F.when(found.isNotNull(), F.struct(found["event"].alias("event"), F.greatest(bought_on, F.date_sub(today, found["days"])).alias("day"), found["precision"].alias("precision")))


def stage_answers(answers: DataFrame, lots: DataFrame) -> DataFrame:
    """answers (lot_id, seq, kind) with reason: the first answer of a lot counts, of lots in stock, of kinds that are known."""
    place = F.row_number().over(W.partitionBy("lot_id").orderBy("seq"))
    joined = answers.withColumn("k", place).join(lots.select("lot_id", "status"), "lot_id", "left")
    reason = F.when(F.col("status").isNull(), "unknown item").when(F.col("status") != "in_stock", "already closed").when(~F.col("kind").isin(*ANSWERS), "unknown answer").when(F.col("k") > 1, "repeated").otherwise("ok")
    return joined.select("lot_id", "seq", reason.alias("reason"))


def apply_answers(answers: DataFrame, lots: DataFrame, applied: DataFrame, today: str) -> DataFrame:
    """Each named lot's state after its first valid answer (lot_id, seq, kind), save the lots that an earlier run applied.

    lots (lot_id, status, bought_on) are those before it.
    """
    staged = stage_answers(answers, lots).where("reason = 'ok'").join(answers, ["lot_id", "seq"]).join(applied, "lot_id", "left_anti")
    day = F.lit(today).cast("date")
    said = staged.join(lots.select("lot_id", "bought_on"), "lot_id").withColumn("a", answer(F.col("kind"), day, F.col("bought_on")))
    closes = F.col("a.event").isin("finished", "thrown_out")
    return said.select("lot_id", F.when(closes, F.col("a.event")).otherwise("in_stock").alias("status"), F.when(closes, F.col("a.day")).alias("closed_on"), F.col("a.precision").alias("closed_precision"))


def created(accounts: DataFrame, wanted: DataFrame) -> DataFrame:
    """accounts with one more for each wanted (institution, account_type, currency) that there is none of, under the least wanted id."""
    key = ["institution", "account_type", "currency"]
    missing = wanted.join(accounts, key, "left_anti").groupBy(*key).agg(F.min("account_id").alias("account_id"))
    return accounts.select(*key, "account_id").unionByName(missing)


def next_checks(lots: DataFrame, today: str) -> DataFrame:
    """Lots in stock that a later purchase of the same product supersedes are asked about at once."""
    newer = F.max("bought_on").over(W.partitionBy("product_id"))
    kept = lots.withColumn("newest", newer).where("status = 'in_stock'")
    usual = F.date_add("bought_on", 28)
    return kept.select("lot_id", F.when(F.col("bought_on") < F.col("newest"), F.least(usual, F.lit(today).cast("date"))).otherwise(usual).alias("next_check_on"))
